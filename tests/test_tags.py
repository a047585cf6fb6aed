import datetime as dt

from cairnflow.operators import tags as t

D = [dt.datetime(2024, 1, k) for k in range(1, 8)]


def frame(spark, rows):
    return spark.createDataFrame(rows, t.SCHEMA)


def sample(spark):
    return frame(
        spark,
        [
            ("a", "function", "rnorm", D[0]),
            ("a", "userTags", "x", D[0]),
            ("a", "accessed", "2024-01-03 00:00:00", D[2]),
            ("b", "function", "runif", D[1]),
            ("b", "userTags", "y", D[1]),
            ("b", "accessed", "2024-01-05 00:00:00", D[4]),
            ("c", "function", "runif", D[3]),
            ("c", "userTags", None, D[3]),
        ],
    )


def ids(df):
    return sorted({r.cacheId for r in df.select("cacheId").collect()})


def test_all_patterns_or_any_text(spark):
    s = sample(spark)
    assert ids(t.show(s, user_tags=["^x$", "^y$"])) == []
    assert ids(t.show(s, user_tags=["^x$|^y$"])) == ["a", "b"]
    assert ids(t.show(s, user_tags=["x", "y"], match="any_exact")) == ["a", "b"]
    assert t.show(s, user_tags=["^x$"]).count() == 3


def test_show_gives_each_row_once(spark):
    s = sample(spark).unionByName(frame(spark, [("b", "userTags", "runif", D[1])]))
    assert t.show(s, user_tags=["runif"]).where("cacheId = 'b'").count() == 4


def test_function_key_value_id(spark):
    s = sample(spark)
    assert ids(t.show(s, function=["runif"])) == ["b", "c"]
    assert ids(t.show(s, function=["runif"], userTags="y")) == ["b"]
    assert ids(t.show(s, cache_id=["c"])) == ["c"]
    assert t.show_one(s, "a", without=["accessed"]).count() == 2


def test_bounds_are_inclusive(spark):
    s = sample(spark)
    keep = s.where("tagKey = 'accessed' or tagKey = 'function'")
    assert ids(t.show(keep.where("tagKey = 'accessed'"), after="2024-01-03 00:00:00", before="2024-01-05 00:00:00")) == ["a", "b"]
    assert ids(t.show(keep.where("tagKey = 'accessed'"), after="2024-01-05 00:00:00")) == ["b"]


def test_keep_and_clear_are_complements(spark):
    s = sample(spark)
    assert ids(t.keep(s, function=["runif"])) == ["b", "c"]
    assert ids(t.clear(s, function=["runif"])) == ["a"]
    assert t.clear(s).count() == 0
    assert ids(t.latest_entry(s)) == ["b"]


def test_merge_is_idempotent(spark):
    s = sample(spark)
    part, rest = t.show(s, cache_id=["a"]), s
    once = t.merge(part, rest)
    assert once.count() == s.count()
    assert t.merge(once, rest).count() == s.count()
    assert {r.cacheId: r.status for r in t.merge_report(part, rest).collect()} == {"a": "skipped", "b": "copied", "c": "copied"}


def test_similar(spark):
    s = sample(spark)
    wanted = spark.createDataFrame([("function", "runif"), ("userTags", "y")], "tagKey string, tagValue string")
    assert [(r.cacheId, r.n_shared) for r in t.most_similar(s, wanted).collect()] == [("b", 2)]
    assert {(r.tagKey, r.status) for r in t.differences(wanted, s, "c").collect()} == {("function", "same"), ("userTags", "other")}
    assert ids(t.carries_all(s, wanted)) == ["b"]
    two = t.matching_ids(s, function=["runif"])
    assert [r.cacheId for r in t.nth_latest(two, s, 2).collect()] == ["c"]
    assert t.nth_latest(two, s, 3).count() == 0


def test_shared_tags_count_once(spark):
    """Repeated tags, tags without a value and entries without any of the wanted ones."""
    s = sample(spark).unionByName(frame(spark, [("b", "userTags", "y", D[5]), ("b", "function", "runif", D[6]), ("d", "userTags", "z", D[0])]))
    wanted = spark.createDataFrame([("function", "runif"), ("userTags", "y"), ("userTags", "y"), ("userTags", None), ("other", "y")], "tagKey string, tagValue string")
    assert sorted(map(tuple, t.shared_counts(s, wanted).collect())) == [("b", 2), ("c", 1)]
    assert t.shared_counts(s, wanted.limit(0)).count() == 0
    assert t.carries_all(s, wanted).count() == 0 and ids(t.carries_all(s, wanted.where("tagValue = 'y' and tagKey = 'userTags'"))) == ["b"]


def dealt(df):
    """The plan of the rows that are not broadcast, node by node."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines, depth = [], None
    for line in plan.split("\n"):
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            continue
        depth = at if "BroadcastExchange" in line else None
        lines.append(line.lstrip(" :+-"))
    return lines


def test_entries_of_a_frequent_tag_are_not_dealt_by_tag(spark):
    """Counting deals rows by entry alone, and holds them in one sort rather than in hash tables."""
    wanted = spark.createDataFrame([("function", "runif"), ("userTags", "y")], "tagKey string, tagValue string")
    plan = dealt(t.carries_all(sample(spark), wanted))
    assert [n.split("(")[1].split("#")[0] for n in plan if n.startswith("Exchange")] == ["cacheId"]
    assert not [n for n in plan if "Aggregate" in n]


def test_most_similar_deals_by_entry(spark):
    """The largest count too is found without dealing rows by tag; of entries with equal counts all stay."""
    s = sample(spark)
    wanted = spark.createDataFrame([("function", "runif"), ("function", "rnorm")], "tagKey string, tagValue string")
    best = t.most_similar(s, wanted)
    assert sorted(map(tuple, best.collect())) == [("a", 1), ("b", 1), ("c", 1)]
    assert [n.split("(")[1].split("#")[0] for n in dealt(t.most_similar(s, wanted)) if n.startswith("Exchange")] == ["cacheId"]


def test_nth_latest_sorts_no_tags(spark):
    """Ties go by id, entries given twice count once; all tags are dealt by entry, not sorted for the join."""
    s = sample(spark).unionByName(frame(spark, [("e", "function", "runif", D[4]), ("f", "function", "runif", D[6])]))
    given = spark.createDataFrame([("b",), ("e",), ("e",), ("a",), ("unknown",)], "cacheId string")
    assert [[r.cacheId for r in t.nth_latest(given, s, n).collect()] for n in (1, 2, 3, 4)] == [["b"], ["e"], ["a"], []]
    plan = dealt(t.nth_latest(given, s, 2))
    assert any(n.startswith("ShuffledHashJoin") for n in plan) and not [n for n in plan if n.startswith(("SortMergeJoin", "Sort ["))]


def test_log_views(spark):
    log = frame(spark, [("a", "inCloud", "FALSE", D[0]), ("a", "inCloud", "TRUE", D[1]), ("a", "accessed", "1", D[0]), ("a", "accessed", "2", D[1])])
    rows = {(r.tagKey, r.tagValue) for r in t.latest_values(log).collect()}
    assert rows == {("inCloud", "TRUE"), ("accessed", "1"), ("accessed", "2")}
    assert t.pivoted(log, ["inCloud"]).first().inCloud == "TRUE"
    assert t.as_map(log).first().tags == {"inCloud": ["FALSE", "TRUE"], "accessed": ["1", "2"]}


def test_parse():
    assert t.parse(["a:b:c", "plain"]) == [("a", "b:c"), ("userTags", "plain")]


def test_empty(spark):
    e = t.empty(spark)
    assert t.show(e, user_tags=["x"]).count() == 0 and t.latest_entry(e).count() == 0 and t.keep(e, function=["f"]).count() == 0
