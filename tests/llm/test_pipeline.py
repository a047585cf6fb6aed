import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    from tests.llm.test_jaccard import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == columns
        kept[name] = {r.doc_id: r for r in after.collect()}
        if name == "n-gram Jaccard join":
            classes = brute([(r.doc_id, r.text) for r in before.collect()])
            assert set(kept[name]) == {d for d, c in classes.items() if d == c}
        before = after
    assert set(kept["packing"]) == set(kept["n-gram Jaccard join"])
    assert len(kept["line dedup"]) <= len(kept["toxicity"]) <= len(kept["language identification"]) == docs.count()


def test_run_gives_the_stages_rows(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_components(spark):
    import random

    from cairnflow.llm.shared import components

    rng = random.Random(15)
    edges = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(500, k) for k in range(501, 560)] + [(3, 3)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if x in got} and set(got) >= {a for a, b in edges if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
