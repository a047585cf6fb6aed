import gzip
import os
import struct
import tarfile
import zipfile

import pytest

from cairnflow.functions import scalars as sc
from cairnflow.messages import retry, table_text
from cairnflow.options import options
from cairnflow.sources import archives, download, readers
from cairnflow.sources.ingest import Source, acquire, check, ingest, names_of
from cairnflow.sources.writers import file_name, write_data, write_table


def make_zip(path, **files):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return str(path)


def test_archives(tmp_path):
    z = make_zip(tmp_path / "a.zip", d__x_dot_csv="a,b\n1,2\n", y_dot_txt="y")
    assert sorted(archives.members(z)) == ["d/x.csv", "y.txt"]
    assert [os.path.basename(p) for p in archives.extract(z, str(tmp_path / "o"), ["x.csv"])] == ["x.csv"]
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        t.add(z, "inner.zip")
    assert [os.path.basename(p) for p in archives.extract_nested(str(tmp_path / "t.tar.gz"), str(tmp_path / "n"), ["y.txt"])] == ["y.txt"]
    with gzip.open(tmp_path / "g.csv.gz", "wt") as f:
        f.write("a\n1\n")
    assert archives.extract(str(tmp_path / "g.csv.gz"), str(tmp_path / "g"))[0].endswith("g.csv")
    os.rename(z, tmp_path / "nameless")
    assert archives.with_extension(str(tmp_path / "nameless")).endswith("nameless.zip")
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as e:
        e.writestr("../out.txt", "x")
    with pytest.raises(ValueError):
        archives.extract(str(tmp_path / "evil.zip"), str(tmp_path / "o"))
    assert archives.folders_of(["a/b", "a/c", "d"]) == ["a"]


def test_ingest(spark, tmp_path):
    z = make_zip(tmp_path / "src.zip", t_dot_csv="a,b\n1,2\n3,4\n", t_dot_txt="hello", other_dot_txt="o")
    folder = str(tmp_path / "dest")
    got = acquire(Source(url=f"file://{z}", target="t.csv", also="similar"), folder)
    assert got.fetched and sorted(os.path.basename(f) for f in got.files) == ["t.csv", "t.txt"]
    assert not acquire(Source(url=f"file://{z}", target="t.csv", also="similar"), folder).fetched
    assert ingest(spark, Source(url=f"file://{z}", target="t.csv"), folder).count() == 2
    assert ingest(spark, Source(url=f"file://{z}", target="t.csv"), folder, reader=False).endswith("t.csv")
    assert ingest(spark, Source(target="t.csv"), folder, reader=lambda s, p: s.read.text(p)).count() == 3
    with open(f"{folder}/t.csv", "a") as f:
        f.write("5,6\n")
    assert check(folder, ["t.csv", "none"])[0]["result"] == "FAIL" and check(folder, ["none"])[0]["result"] is None
    with pytest.raises(FileNotFoundError):
        acquire(Source(target="absent.csv"), folder)
    with pytest.raises(FileNotFoundError):
        acquire(Source(url=f"file://{z}", target="absent.csv"), str(tmp_path / "d2"))
    pool = tmp_path / "pool"
    pool.mkdir()
    (pool / "p.csv").write_text("a\n1\n")
    assert ingest(spark, Source(target="p.csv"), str(tmp_path / "d3"), input_paths=[str(pool)]).count() == 1
    with pytest.raises(ValueError):
        acquire(Source(url=f"file://{pool}/p.csv", checksum={"p.csv": "0"}), str(tmp_path / "d4"))


def test_names():
    assert names_of(Source(url="https://x.org/a.zip")).archive == "a.zip"
    assert names_of(Source(url="https://x.org/a.csv")).target == "a.csv"
    both = names_of(Source(url="https://x.org/a.zip", target="b.shp"))
    assert (both.archive, both.target) == ("a.zip", "b.shp")
    with pytest.raises(ValueError):
        download.fetch("https://www.dropbox.com/x", "/tmp")


def test_ascii_grid_round_trip(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 1\nyllcorner 2\ncellsize 0.5\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    r = readers.read_ascii_grid(spark, str(tmp_path / "g.asc"))
    assert r.grid.extent.xmax == 2.5 and [x.value for x in r.cells.orderBy("row", "col").collect()] == [1, 2, 3, 4, None, 6]
    write_data(r, str(tmp_path / "h.asc"))
    again = readers.read_ascii_grid(spark, str(tmp_path / "h.asc"))
    assert again.cells.exceptAll(r.cells).count() == 0 and again.grid.extent == r.grid.extent
    with pytest.raises(FileExistsError):
        write_data(r, str(tmp_path / "h.asc"))


def test_shapefile(spark, tmp_path):
    def record(k, body):
        return struct.pack(">ii", k, len(body) // 2) + body

    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d", 5, 0, 0, 1, 1) + struct.pack("<iii", 1, 4, 0) + b"".join(struct.pack("<dd", *p) for p in ring)
    point = struct.pack("<idd", 1, 5.0, 6.0)
    data = record(1, body) + record(2, point)
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(data)) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8)
    (tmp_path / "s.shp").write_bytes(head + data)
    fields = b"name".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    fields += b"n".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([4, 0]) + b"\0" * 14
    dbf = struct.pack("<BBBBihh", 3, 1, 1, 1, 2, 32 + len(fields) + 1, 10) + b"\0" * 20 + fields + b"\x0d" + b" alpha   1" + b" beta    2"
    (tmp_path / "s.dbf").write_bytes(dbf)
    f = readers.read_shapefile(spark, str(tmp_path / "s.shp")).rows.orderBy("fid").collect()
    assert [(r.geom.type, r.name, r.n) for r in f] == [("polygon", "alpha", 1), ("point", "beta", 2)]
    assert not f[0].geom.parts[0].hole


def test_choice_of_readers_and_names(tmp_path):
    assert readers.choose(["a.csv", "b.asc", "c.shp"])[0] == "c.shp" and readers.choose(["a.csv", "b.csv"])[0] == "b.csv"
    with pytest.raises(ValueError):
        readers.choose(["a.xyz"])
    assert file_name(None) is None and file_name("a.csv", folder="f") == "f/a.csv" and file_name(True, "x/a.csv", "f") == "f/Smalla.csv"


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    for kind in ("csv", "json", "parquet", "orc", "tsv"):
        path = str(tmp_path / f"t.{kind}")
        write_table(df, path)
        assert readers.read(spark, path).select("x", "y").orderBy("x").collect()[1].y == "b"


def test_links_listing_retry(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert download.link_or_copy(str(tmp_path / "a.txt"), str(tmp_path / "d/b.txt")) == "hard link"
    assert download.link_or_copy(str(tmp_path / "a.txt"), str(tmp_path / "d/b.txt")) == "same"
    assert download.listing(f"file://{tmp_path}", "txt$") == [str(tmp_path / "a.txt")]
    tries = []

    def once():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "done"

    assert retry(once, wait=lambda s: None) == "done" and len(tries) == 3
    with pytest.raises(OSError):
        retry(lambda: (_ for _ in ()).throw(OSError()), retries=2, wait=lambda s: None)
    assert table_text([{"a": 1, "b": "xy"}]).splitlines() == ["a b ", "1 xy"]


def test_scalars(spark, tmp_path, monkeypatch):
    rows = [(5.0, "/a/b/c.tar.gz"), (12.25, "c"), (None, None)]
    df = spark.createDataFrame(rows, "x double, p string")
    got = df.select(sc.padded_number("x", 3).alias("n"), sc.extension("p").alias("e"), sc.last_component("p").alias("l"), sc.last_components("p", 1).alias("t"), sc.with_prefix("p", "s_").alias("w")).collect()
    assert [tuple(r) for r in got] == [("005", "gz", "c.tar.gz", "b/c.tar.gz", "/a/b/s_c.tar.gz"), ("012.250", "", "c", "c", "s_c"), (None, None, None, None, None)]
    names = spark.createDataFrame([("f",), ("f_2",), ("g",)], "n string")
    assert names.agg(sc.next_free_name("n", "f")).first()[0] == "f_3" and names.agg(sc.next_free_name("n", "h")).first()[0] == "h"
    assert sc.relative_path("/x/data/a/b", "/y/data") == "a/b" and sc.normal_path(None) is None
    assert sc.relative_to_roots("/r/one/two/f", {"a": "/r", "b": "/r/one"}) == ("b", "two/f")
    with pytest.raises(FileNotFoundError):
        sc.checked_path(str(tmp_path / "no"))
    assert os.path.isdir(sc.checked_path(str(tmp_path / "yes"), create=True))
    monkeypatch.setenv("CAIRNFLOW_QUICK", "true")
    assert options().quick and options(quick=False).quick is False


def test_ingested_grids_and_features_are_stored(spark, tmp_path):
    from cairnflow.functions import projections as pr
    from cairnflow.operators import grid as g
    from cairnflow.operators import vector as v
    from cairnflow.operators.conform import Features, Raster
    from cairnflow.plans.memo import memo
    from cairnflow.plans.store import Store
    from cairnflow.sources.ingest import Source, ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "h.asc").write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9\n1 2 3\n4 -9 6\n")
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        got = ingest(spark, Source(url=f"file://{tmp_path}/in/h.asc", target="h.asc"), str(tmp_path / "out"), store=store)
        assert isinstance(got, Raster) and got.grid.ncol == 3 and got.grid.extent == g.Extent(0, 3, 0, 2)
        assert sorted((r.row, r.col, r.value) for r in got.cells.collect() if r.value is not None) == [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0), (1, 2, 6.0)]
    assert len(store.ids()) == 1 and not memo(lambda: None, store=store, cache_id=store.ids()[0]).is_new
    made = Features(v.features(spark, [(4, v.polygon([(0, 0), (1, 0), (1, 1)]))]), pr.WebMercator())
    store.save("f", made)
    back = store.load("f")
    assert isinstance(back, Features) and back.projection == pr.WebMercator() and back.rows.collect() == made.rows.collect()


def test_listing_of_7z():
    from cairnflow.sources.archives import listed

    text = "\n7-Zip\n\n--\nPath = a.7z\nType = 7z\n\n----------\nPath = d\nFolder = +\nAttributes = D_\n\nPath = d/b.shp\nSize = 3\nFolder = -\n\nPath = c.txt\nSize = 1\nAttributes = A_\n\n"
    assert listed(text) == ["d/b.shp", "c.txt"]
