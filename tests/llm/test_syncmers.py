import hashlib
import random

from pyspark.sql import functions as F

from cairnflow.llm import syncmers


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_next_document(spark):
    rng = random.Random(8)
    ids = rng.sample(range(-500, 500), 60)
    docs = [(d, f"text {d}") for d in ids]
    order = sorted(ids, reverse=True)
    want = {d: f"text {order[(k + 1) % len(order)]}" for k, d in enumerate(order)}
    for parts in (1, 3, 16):
        got = {r.doc_id: r.next for r in syncmers.with_next(rows_of(spark, docs), parts).collect()}
        assert got == want
    assert [r.next for r in syncmers.with_next(rows_of(spark, [(1, "only")])).collect()] == ["only"]


def test_anchors_are_closed_syncmers(spark):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randrange(200)}" for _ in range(300))
    df = syncmers.with_anchors(rows_of(spark, [(1, text)]), "text", "a", positions=True)
    got = [(r.position, r.hash) for r in df.first().a]
    words = text.split()
    h = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    pairs = spark.createDataFrame(list(zip(h, h[1:])), "a long, b long").select(F.xxhash64("a", "b")).collect()
    s = [r[0] for r in pairs]
    k, last = syncmers.K, syncmers.K - syncmers.S
    want = [i for i in range(len(words) - k + 1) if min(s[i], s[i + last]) <= min(s[i + 1 : i + last])]
    assert [p for p, _ in got] == want and 0.2 < len(want) / len(words) < 0.5


def test_shared_passages_share_anchors(spark):
    rng = random.Random(10)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(80))
    own = lambda: " ".join(f"q{rng.randrange(10**6)}" for _ in range(80))
    df = rows_of(spark, [(1, f"{own()} {passage}"), (2, f"{passage} {own()}"), (3, own())])
    a = {r.doc_id: set(r.a) for r in syncmers.with_anchors(df, "text", "a").collect()}
    assert len(a[1] & a[2]) > 10 and not a[1] & a[3]


def test_contract(spark):
    texts = {9: "ab cd", 7: None, 5: "", 4: "x" * 40_000, 3: "漢字😀 é", 2: "one two three four five six seven eight nine ten", 1: "one two three four five six seven eight nine ten"}
    df = spark.createDataFrame([(d, t, "z") for d, t in texts.items()], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in syncmers.edited_pairs(df).collect()}
    order = sorted(texts, reverse=True)
    for k, d in enumerate(order):
        text, following = texts[d] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1.0 and got[5].fingerprint == "" and got[7].near_next == 1.0
    assert syncmers.edited_pairs(df.limit(0)).count() == 0
    same = rows_of(spark, [(1, "a"), (1, "a"), (None, "b"), (None, None)])
    assert syncmers.edited_pairs(same).count() == 4


def test_no_python_in_the_plan(spark):
    plan = syncmers.edited_pairs(rows_of(spark, [(1, "a b"), (2, "c d")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_texts_share_anchors_with_their_edits(spark):
    rng = random.Random(11)
    docs = [(n, " ".join(f"w{rng.randrange(10**4, 10**5)}" for _ in range(n))) for n in range(3, 30)] + [(-1, "z" * 400)]
    got = {r.doc_id: r for r in syncmers.edited_pairs(rows_of(spark, docs)).collect()}
    assert all(0 < got[n].near_edited < 1 for n in range(3, 30)) and all(got[n].near_next == 0 for n in range(3, 30))
