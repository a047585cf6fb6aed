import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from cairnflow.plans.memo import memo, memoised, wait_for_writes
from cairnflow.plans.store import Store, store_name


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def add(a, b=2):
    return a + b


def test_call_forms_are_one(store):
    assert memo(add, 1, store=store).is_new
    for args, named in (((1, 2), {}), ((1,), {"b": 2}), ((), {"b": 2, "a": 1})):
        again = memo(add, *args, store=store, **named)
        assert not again.is_new and again.value == 3
    assert memo(add, 2, b=1, store=store).is_new


def test_tables_are_read_back_the_same(spark, store):
    def noisy(n):
        return spark.range(n).withColumn("r", F.rand())

    first = memo(noisy, 5, store=store)
    assert first.value.collect() == memo(noisy, 5, store=store).value.collect() == first.value.collect()


def test_content_of_a_table_is_the_key(spark, store):
    def size(df):
        return df.count()

    assert memo(size, spark.range(3), store=store).is_new
    assert not memo(size, spark.range(3).repartition(2), store=store).is_new
    assert memo(size, spark.range(4), store=store).is_new


def test_omit_only_extra(store):
    def f(x, verbose=False):
        return len(x)

    assert memo(f, {"a": 1, "b": 2}, store=store, omit=["verbose"], only={"x": ["a"]}).is_new
    assert not memo(f, {"a": 1, "b": 3}, verbose=True, store=store, omit=["verbose"], only={"x": ["a"]}).is_new
    assert memo(f, {"a": 1, "b": 3}, store=store, omit=["verbose"], only={"x": ["a"]}, extra="v2").is_new


def test_not_older_than_overwrite_and_failure(store):
    first = memo(add, 1, store=store)
    assert not memo(add, 1, store=store, not_older_than=dt.datetime.now() - dt.timedelta(days=1)).is_new
    assert memo(add, 1, store=store, not_older_than=dt.datetime.now() + dt.timedelta(days=1)).is_new
    assert memo(add, 1, store=store, use_cache="overwrite").is_new

    state = {"fail": False}

    def fragile(x):
        if state["fail"]:
            raise ValueError
        return x

    kept = memo(fragile, 1, store=store, cache_id="fragile")
    state["fail"] = True
    with pytest.raises(ValueError):
        memo(fragile, 1, store=store, cache_id="fragile", not_older_than=dt.datetime.now() + dt.timedelta(days=1))
    assert memo(fragile, 1, store=store, cache_id="fragile").value == kept.value
    assert first.cache_id in store.ids()


def test_none_is_none_and_text_is_text(store):
    def nothing():
        return None

    def text():
        return "NULL"

    assert memo(nothing, store=store).is_new and memo(nothing, store=store).value is None
    memo(text, store=store)
    assert memo(text, store=store).value == "NULL"


def test_nested_tags_and_levels(store):
    def inner(x):
        return x

    def outer(x):
        return memo(inner, x, store=store, user_tags=["level:inner"]).value

    memo(outer, 1, store=store, user_tags=["level:outer"])
    rows = {(r.cacheId, r.tagValue) for r in store.show(user_tags=["^level$"]).where("tagKey = 'level'").collect()}
    assert len(rows) == 3  # the inner entry carries both
    store.clear()
    assert memo(outer, 2, store=store, use_cache=1).is_new
    assert not memo(outer, 2, store=store, use_cache=1).is_new


def test_previous_and_similar(store):
    memo(add, 1, b=5, store=store)
    assert memo(add, 99, store=store, cache_id="previous").value == 6
    near = memo(add, 1, b=7, store=store, show_similar=True)
    assert near.is_new and near.similar[0]["differs"] == ["b"]


def test_dev_mode_replaces(store):
    def job(x):
        return x * 10

    memo(job, 1, store=store, user_tags=["step:one"], use_cache="devMode")
    memo(job, 2, store=store, user_tags=["step:one"], use_cache="devMode")
    assert len(store.ids()) == 1 and memo(job, 2, store=store).value == 20


def test_equal_results_are_stored_once(spark, store):
    def a():
        return spark.range(50)

    def b():
        return spark.range(50).repartition(2)

    memo(a, store=store)
    memo(b, store=store)
    objects = {store.find(i)["objectId"][-1] for i in store.ids()}
    assert len(store.ids()) == 2 and len(objects) == 1
    store.remove(store.ids()[:1])
    assert store.load(store.ids()[0]).count() == 50


def test_several_stores_mirror_merge(spark, store, tmp_path):
    other, mirror = Store(spark, str(tmp_path / "other")), Store(spark, str(tmp_path / "mirror"))
    memo(add, 1, store=other)
    assert not memo(add, 1, store=[store, other]).is_new and store.ids() == []
    memo(add, 5, store=store, mirror=mirror)
    assert len(mirror.ids()) == 1
    store.clear()
    assert not memo(add, 5, store=store, mirror=mirror).is_new
    assert set(store.merge(other).values()) == {"copied"} and set(store.merge(other).values()) == {"skipped"}


def test_maintenance(spark, store, tmp_path):
    for k in range(3):
        memo(add, k, store=store, user_tags=[f"k:{k}"])
    assert len(store.keep(k=["1", "2"])) == 2
    assert len(store.clear(k="1")) == 1 and len(store.ids()) == 1
    store.compact()
    assert len(store.ids()) == 1 and store.size() > 0 and store.is_intact()
    store.move(str(tmp_path / "moved"))
    assert not memo(add, 2, store=store).is_new
    assert len(store.clear_recent(60)) == 1 and store.ids() == []


def test_broken_objects_are_made_anew(store):
    found = memo(add, 1, store=store)
    store._delete(store.object_path(store.find(found.cache_id)["objectId"][-1]))
    assert memo(add, 1, store=store).is_new


def test_same_call_from_threads_runs_once(store):
    ran = []

    def slow(x):
        ran.append(x)
        return x

    calls = [threading.Thread(target=lambda k=k: memo(slow, k % 2, store=store, link_result=False)) for k in range(6)]
    [c.start() for c in calls]
    [c.join() for c in calls]
    assert sorted(ran) == [0, 1]


def test_later_write_and_decorator(store):
    memo(add, 1, store=store, wait=False)
    wait_for_writes()
    assert not memo(add, 1, store=store).is_new

    @memoised(store)
    def twice(x):
        return 2 * x

    assert twice(4) == 8 == twice(4)
    assert store_name("/a/b/1c") == "b_1c" and store_name("/a/2b/c") == "_2b_c"


def test_the_log_can_be_followed(spark, store, tmp_path):
    from cairnflow.streaming import follow_log

    memo(add, 1, store=store, user_tags=["k:v"])
    stream = follow_log(spark, store.root).writeStream.format("memory").queryName("followed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    stream.awaitTermination(60)
    assert spark.sql("select * from followed where tagKey = 'k' and tagValue = 'v'").count() == 1


def test_compaction_keeps_what_counts(spark, tmp_path):
    from cairnflow.plans.store import Store

    store = Store(spark, f"file://{tmp_path}/store").create()
    for k in range(3):
        store.save(f"e{k}", k, [("tag", f"t{k}"), ("tag", "all")])
    store.update_tag("e0", "accessed", "x")
    store.update_tag("e0", "accessed", "y")
    store.remove(["e1"])
    before = sorted((r.cacheId, r.tagKey, r.tagValue) for r in store.tags().collect())
    store.compact()
    store.add_tag("e2", "tag", "later")
    after = sorted((r.cacheId, r.tagKey, r.tagValue) for r in store.tags().collect())
    assert after == sorted([*before, ("e2", "tag", "later")]) and store.load("e2") == 2
    folders = [p for p in (tmp_path / "store" / "tags").iterdir() if p.is_dir()]
    assert len(folders) == 2 and not list((tmp_path / "store").glob("compacting-*"))
    store.compact()
    assert sorted((r.cacheId, r.tagKey, r.tagValue) for r in store.tags().collect()) == after


def test_one_holder_of_a_key(spark, tmp_path):
    """Stores of their own, as in other processes, wait for each other; a lock left behind is taken over."""
    import threading
    import time

    from cairnflow.plans.store import Store

    inside, most = [], []

    def work(k):
        store = Store(spark, f"file://{tmp_path}/store")
        with store.locked("key"):
            inside.append(k)
            most.append(len(inside))
            time.sleep(0.05)
            inside.remove(k)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(6)]
    for x in threads:
        x.start()
    for x in threads:
        x.join(30)
    assert most == [1] * 6
    left = tmp_path / "store" / "locks" / "old"
    left.write_text("")
    began = time.time()
    with Store(spark, f"file://{tmp_path}/store").locked("old", stale=0.5):
        assert time.time() - began > 0.2
    assert not left.exists()


def test_algorithm_length_class_options_debug(store, tmp_path):
    file = tmp_path / "data.txt"
    file.write_bytes(b"same start" + b"1" * 10)

    def size(path, model=None):
        return path.stat().st_size

    plain = memo(size, file, store=store, digest_only=True)
    assert len(memo(size, file, store=store, digest_only=True, algorithm="xxhash64").cache_id) == 16
    assert memo(size, file, store=store, length=10).is_new
    file.write_bytes(b"same start" + b"2" * 10)
    assert not memo(size, file, store=store, length=10).is_new
    assert memo(size, file, store=store, digest_only=True).cache_id != plain.cache_id

    class Model:
        def __init__(self, weights, log):
            self.weights, self.log = weights, log

    counted = {Model: lambda m: m.weights}
    assert memo(size, file, Model([1], "a"), store=store, class_options=counted).is_new
    assert not memo(size, file, Model([1], "b"), store=store, class_options=counted).is_new
    assert memo(size, file, Model([2], "b"), store=store, class_options=counted).is_new

    looked = memo(add, 41, store=store, debug="quick")
    assert looked.value is None and looked.arguments == {"a": 41, "b": 2} and not store.find(looked.cache_id)
    assert memo(add, 41, store=store, debug="complete").arguments == {"a": 41, "b": 2}
    with pytest.raises(ValueError):
        memo(add, 41, store=store, debug="all")


def test_options_are_read(spark, store, tmp_path, monkeypatch):
    monkeypatch.setenv("CAIRNFLOW_STORE_PATH", str(tmp_path / "named"))
    assert memo(add, 7).is_new and not memo(add, 7).is_new
    monkeypatch.setenv("CAIRNFLOW_USE_CACHE", "false")
    assert memo(add, 7).is_new and not memo(add, 7, use_cache=True).is_new
    monkeypatch.setenv("CAIRNFLOW_USE_CACHE", "overwrite")
    assert memo(add, 7).is_new
    monkeypatch.delenv("CAIRNFLOW_STORE_PATH")
    with pytest.raises(ValueError):
        memo(add, 7)


def test_tags_change_their_form(spark, store, tmp_path):
    from cairnflow.plans.store import adopt, from_folders, to_folders

    memo(add, 1, store=store, user_tags=["k:1"])
    memo(add, 2, store=store, user_tags=["k:2"])
    rows = lambda df: sorted(map(tuple, df.select("cacheId", "tagKey", "tagValue", "createdDate").collect()), key=str)
    before = rows(store.tags())
    to_folders(store.tags(), str(tmp_path / "folders"))
    assert len(list((tmp_path / "folders").glob("cacheId=*"))) == 2
    kept = from_folders(spark, str(tmp_path / "folders"))
    assert rows(kept) == before
    for log in (tmp_path / "store" / "tags").iterdir():
        store._delete(str(log))
    assert store.ids() == [] and adopt(store, kept) == 2 and adopt(store, kept) == 0
    assert rows(store.tags()) == before
    assert not memo(add, 2, store=store).is_new
