import numpy as np

from cairnflow.llm import embeddings as e


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    found = e.decode_e8(x)
    best = ((x - found) ** 2).sum(axis=1)
    for v in e.neighbours():
        assert (best <= ((x - found - v) ** 2).sum(axis=1) + 1e-9).all()
    whole = np.rint(2 * found)
    assert len(e.neighbours()) == 240 and ((whole % 2).sum(axis=1) % 8 == 0).all() and (found.sum(axis=1) % 2 == 0).all()
    assert np.allclose(e.decode_e8(e.neighbours()), e.neighbours())


def make(rng, n, d, copies, cosine):
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(x)
    for k in range(copies):
        a = x[k % n]
        z = rng.normal(size=d)
        z -= z @ a * a
        rows.append((cosine * a + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)) * rng.uniform(0.1, 10))
    return np.array(rows)


def brute(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T >= threshold
    np.fill_diagonal(c, False)
    return c


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs with a cosine of 0.91, the hardest kind: at least 0.9 of them are found, and nothing below the threshold."""
    rng = np.random.default_rng(1)
    x = make(rng, 400, 64, 300, 0.91)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in e.near_duplicates(df).collect()}
    want = brute(x).sum(axis=1)
    assert len(got) == len(x) and all(got[k].n_links <= want[k] for k in got)
    assert sum(r.n_links for r in got.values()) >= 0.9 * want.sum()
    assert all(got[r.component_id].kept for r in got.values())


def test_blocks_give_the_same(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([make(rng, 30, 64, 0, 1), make(rng, 1, 64, 90, 0.99)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    small = sorted(e.near_duplicates(df, block=16).collect())
    assert small == sorted(e.near_duplicates(df).collect())
    want = brute(x).sum(axis=1)
    assert [r.n_links for r in small] == want.tolist() and {r.component_id for r in small[30:]} == {30}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0], "a"), (2, [5.0, 0.1, 0.0], "b"), (3, None, "c"), (4, [0.0, 0.0, 0.0], "d"), (5, [nan, 1.0, 0.0], "e"), (6, [inf, 1.0, 0.0], "f"), (7, [None, 1.0, 0.0], "g"), (8, [], "h"), (None, [1.0, 0.0, 0.0], "i"), (9, [1.0, 0.0], "j"), (2, [5.0, 0.1, 0.0], "b"), (10, [1e-200, 0.0, 0.0], "k"), (11, [1e300, 0.0, 0.0], "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string")
    got = e.near_duplicates(df).collect()
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert len(got) == len(rows)
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[10] == (3, 1, False) and by[11] == (3, 1, False)
    assert all(by[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9)) and by[None] == (0, None, False)
    assert e.near_duplicates(df.limit(0)).count() == 0
