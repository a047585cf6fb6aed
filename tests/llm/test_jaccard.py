import random

import numpy as np

from cairnflow.llm import jaccard


def sets_of(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs):
    s = [(d, sets_of(t)) for d, t in docs if d is not None]
    parent = {d: d for d, _ in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in s}


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard.similarity_classes(df).collect()
    want = brute(docs)
    assert len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    return got, want


def test_against_brute_force(spark):
    rng = random.Random(6)
    docs, bases = [], []
    for k in range(14):
        bases.append([f"w{rng.randrange(50)}" for _ in range(rng.choice([3, 6, 8, 9, 12, 14, 17, 20, 24, 30, 80, 300]))])
    passage = [f"p{k}" for k in range(60)]
    for d in range(120):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(50)}"
        if rng.random() < 0.2:
            w = passage + w[:12]
        docs.append((d * 7 % 120, (" " if d % 2 else "\n").join(w)))
    docs = list(dict(docs).items())
    _, want = check(spark, docs)
    assert 3 < len(set(want.values())) < len(want)


def test_chains_reach_through_members(spark):
    words = [f"w{k}" for k in range(120)]
    docs = [(d, " ".join(words[d * 4 : d * 4 + 60])) for d in range(10)]
    _, want = check(spark, docs)
    assert set(want.values()) == {0}


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (3, "A B C D E F"), (1, None), (2, ""), (4, " \n\t"), (6, "one two"), (7, "One  two"), (8, "two one"), (9, "x " * 30_000)]
    got, _ = check(spark, rows)
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == 3 and by[7].component_id == 6 and by[8].component_id == 8 and by[None].component_id is None
    assert [by[k].n_shingles for k in (1, 2, 4, 6, 9)] == [0, 0, 0, 1, 1]
    same = spark.createDataFrame([(1, "q w e r t y", "a"), (1, "q w e r t y", "a"), (2, "q w e r t y", "b")], "doc_id long, text string, n string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.similarity_classes(same).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert jaccard.similarity_classes(same.limit(0)).count() == 0


def test_one_id_with_two_texts_links_both(spark):
    a, b = "a b c d e f g h", "s t u v w x y z"
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.similarity_classes(df).collect()} == {(1, 1), (5, 1), (9, 1)}


def test_small_sets_meet_in_a_subset():
    rng = np.random.default_rng(1)
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for n in (4, 5, 9, 10, 14, 16, 20):
        for m in range(n, n + n // 4 + 1):
            s = np.unique(rng.integers(1, 2**63, size=max(n, m) + 5, dtype=np.uint64))[: m]
            x, y = s[:n], s
            if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
                for bound in (3, 9, 12, 24):
                    assert len(np.intersect1d(jaccard.signatures(x, *none, bound)[0], jaccard.signatures(y, *none, bound)[0]))


def test_boundary_follows_cost():
    assert jaccard.boundary(1.0) < jaccard.boundary(5.0) <= jaccard.boundary(1000.0) <= 24
