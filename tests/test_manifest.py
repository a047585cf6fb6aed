from cairnflow.functions import digest
from cairnflow.operators import manifest as m


def rows(spark, *items):
    return spark.createDataFrame([(f, c, s, "md5") for f, c, s in items], m.SCHEMA)


def results(df):
    return {r.expectedFile: r.result for r in df.collect()}


def test_compare(spark):
    expected = rows(spark, ("a", "1", "10"), ("b", "2", "20"), ("c", "3", "30"), ("d", "dir", "0"))
    measured = rows(spark, ("a", "1", "10"), ("b", "9", "20"), ("d", "dir", "0"), ("z", "5", "1"))
    found = m.compare(expected, measured)
    assert tuple(found.columns) == m.RESULT
    assert results(found) == {"a": "OK", "b": "FAIL", "c": None, "d": "OK"}
    assert results(m.compare(expected, measured, quick=True))["b"] == "OK"
    assert [r.result for r in m.in_order(found).collect()] == ["OK", "OK", "FAIL", None]


def test_best_of_several_rows_counts(spark):
    found = m.compare(rows(spark, ("a", "1", "1"), ("a", "2", "1")), rows(spark, ("a", "2", "1")))
    assert [(r.expectedFile, r.result) for r in found.collect()] == [("a", "OK")]


def test_upsert_replaces(spark):
    old, new = rows(spark, ("a", "1", "1"), ("b", "2", "2")), rows(spark, ("b", "3", "2")).drop("algorithm")
    assert {(r.file, r.checksum, r.algorithm) for r in m.upsert(old, new).collect()} == {("a", "1", "md5"), ("b", "3", None)}


def test_directories_and_needed(spark):
    found = m.compare(rows(spark, ("d", "dir", "0"), ("d/x", "1", "1"), ("e", "dir", "0")), rows(spark, ("d/x", "1", "1")))
    assert results(m.directories_ok(found)) == {"d": "OK", "d/x": "OK", "e": None}
    needed = spark.createDataFrame([("d/x",), ("e",)], "file string")
    assert {r.file: r.ok for r in m.needed_ok(needed, found).collect()} == {"d/x": True, "e": False}
    assert [r.file for r in m.missing(needed, found).collect()] == ["e"]


def test_purge_similar_base_name(spark):
    all_ = rows(spark, ("p/t.shp", "1", "1"), ("p/t.dbf", "2", "1"), ("a.zip", "3", "1"))
    assert m.purge(all_, 1).count() == 0 and m.purge(all_, 0).count() == 3
    assert [r.file for r in m.purge(all_, 6, target=["p/t.shp"], archive=["a.zip"]).collect()] == ["p/t.dbf"]
    assert m.purge(all_, 6, target=["p/t.shp"], archive=["a.zip"], also=["p/t.dbf"]).count() == 0
    assert [r.file for r in m.purge(all_, 7, target=["p/t.shp"], url=["a.zip"]).collect()] == ["p/t.dbf"]
    assert m.similar(all_, "x/t.shp").count() == 2
    moved = m.by_base_name(all_, rows(spark, ("q/t.dbf", "2", "1"), ("new", "1", "1")))
    assert {r.file for r in moved.collect()} == {"p/t.dbf", "new"}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data/a.txt").write_text("hello")
    (tmp_path / "data/b.txt").write_text("")
    for algorithm in ("md5", "sha256", "xxhash64"):
        found = {r.file: r for r in digest.files(spark, str(tmp_path / "data"), algorithm).collect()}
        assert found["a.txt"].checksum == digest.file_hash(str(tmp_path / "data/a.txt"), algorithm) and found["a.txt"].filesize == "5"
    measured = digest.files(spark, str(tmp_path / "data"))
    m.write(measured, str(tmp_path / "manifest"))
    assert set(results(m.compare(m.read(spark, str(tmp_path / "manifest")), measured)).values()) == {"OK"}


def test_old_manifest_and_empty(spark, tmp_path):
    (tmp_path / "old.txt").write_text('"file" "checksum"\n"a" "1"\n')
    assert m.read(spark, str(tmp_path / "old.txt")).first().asDict() == {"file": "a", "checksum": "1", "filesize": None, "algorithm": None}
    assert m.compare(m.empty(spark), m.empty(spark)).count() == 0


def test_saved_columns_come_along(spark):
    from cairnflow.operators import manifest as m

    measured = spark.createDataFrame([("a", "1", None, "x"), ("b", "2", "9", "x"), ("c", "3", "9", "x")], m.SCHEMA)
    saved = spark.createDataFrame([("a", "1", None, "x", "kept"), ("a", "1", None, "x", "kept"), ("b", "other", "9", "x", "gone")], "file string, checksum string, filesize string, algorithm string, note string")
    got = m.with_saved(measured, saved)
    assert got.columns == [*m.COLUMNS, "note"]
    assert sorted((r.file, r.note) for r in got.collect()) == [("a", "kept"), ("b", None), ("c", None)]
    assert m.with_saved(measured, m.empty(spark)).columns == list(m.COLUMNS)
