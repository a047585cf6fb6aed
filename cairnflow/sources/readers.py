"""Readers by file extension: tables by Spark's own sources, grids and shapes by readers of their own.

Text grids are split by Spark, so a grid may be larger than any one machine; a shapefile is parsed where it is read.
"""

from __future__ import annotations

import os
import pickle
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions.projections import LonLat, Projection
from cairnflow.operators import vector
from cairnflow.operators.conform import Features, Raster
from cairnflow.operators.grid import Extent, Grid


def read_ascii_grid(spark: SparkSession, path: str, projection: Projection | None = None) -> Raster:
    """An ESRI ASCII grid: a head of names and numbers, then rows from the north. The no-data value reads as null."""
    head: dict[str, float] = {}
    lines = 0
    for row in spark.read.text(path).limit(10).collect():
        parts = row.value.split()
        if len(parts) == 2 and parts[0][0].isalpha():
            head[parts[0].lower()] = float(parts[1])
            lines += 1
        else:
            break
    size = head.get("cellsize", head.get("dx", 1.0))
    ncol, nrow = int(head["ncols"]), int(head["nrows"])
    x0 = head["xllcorner"] if "xllcorner" in head else head.get("xllcenter", 0.0) - size / 2
    y0 = head["yllcorner"] if "yllcorner" in head else head.get("yllcenter", 0.0) - size / 2
    grid = Grid(nrow, ncol, Extent(x0, x0 + ncol * size, y0, y0 + nrow * size), projection or LonLat(), names=(os.path.splitext(os.path.basename(path))[0],))
    whole = spark.read.text(path, wholetext=True)
    numbers = F.slice(F.split(F.trim("value"), "\\s+"), 2 * lines + 1, nrow * ncol)  # a name and a number in each line of the head
    cells = whole.select(F.posexplode(numbers).alias("k", "v"))
    value = F.col("v").cast("double")
    if "nodata_value" in head:
        value = F.when(value != head["nodata_value"], value)
    out = cells.select(F.lit(0).alias("layer"), F.floor(F.col("k") / ncol).cast("int").alias("row"), (F.col("k") % ncol).cast("int").alias("col"), value.alias("value"))
    return Raster(out, grid)


def _shapes(data: bytes) -> list[tuple | None]:
    """Geometries of a .shp: null, point, line, polygon and multipoint records (also with z or m, which are dropped)."""
    if struct.unpack_from(">i", data, 0)[0] != 9994:
        raise ValueError("not a shapefile")
    out, at = [], 100
    while at + 8 <= len(data):
        words = struct.unpack_from(">ii", data, at)[1]
        body = at + 8
        kind = struct.unpack_from("<i", data, body)[0] % 10
        if kind == 0:
            out.append(None)
        elif kind == 1:
            out.append(("point", [(False, [struct.unpack_from("<dd", data, body + 4)])]))
        elif kind == 8:
            n = struct.unpack_from("<i", data, body + 36)[0]
            out.append(("point", [(False, [struct.unpack_from("<dd", data, body + 40 + 16 * k)]) for k in range(n)]))
        else:
            n_parts, n_points = struct.unpack_from("<ii", data, body + 36)
            starts = [*struct.unpack_from(f"<{n_parts}i", data, body + 44), n_points]
            base = body + 44 + 4 * n_parts
            parts = []
            for a, b in zip(starts, starts[1:]):
                ring = [struct.unpack_from("<dd", data, base + 16 * k) for k in range(a, b)]
                area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:]))
                parts.append((kind == 5 and area > 0, ring))
            out.append(("line" if kind == 3 else "polygon", parts))
        at = body + 2 * words
    return out


def _attributes(data: bytes, encoding: str = "utf-8") -> list[dict]:
    """Rows of a .dbf."""
    n, head, size = struct.unpack_from("<ihh", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    rows = []
    for k in range(n):
        place, row = head + k * size + 1, {}
        for name, kind, length, decimals in fields:
            text = data[place : place + length].decode(encoding, "replace").strip()
            place += length
            if kind in "NF":
                row[name] = None if not text or "*" in text else float(text) if decimals or "." in text else int(text)
            else:
                row[name] = text or None
        rows.append(row)
    return rows


def read_shapefile(spark: SparkSession, path: str, projection: Projection | None = None) -> Features:
    """Features of a .shp with the attributes of its .dbf; both come as one row each of the binary source."""
    files = {r.path.rsplit(".", 1)[-1].lower(): bytes(r.content) for r in spark.read.format("binaryFile").load([p for p in (path, path[:-4] + ".dbf") if p == path or _exists(spark, p)]).select("path", "content").collect()}
    shapes = _shapes(files["shp"])
    rows = _attributes(files["dbf"]) if "dbf" in files else [{} for _ in shapes]
    geoms = vector.features(spark, [(k, g) for k, g in enumerate(shapes) if g is not None])
    names = sorted({n for r in rows for n in r})
    if names:
        table = spark.createDataFrame([(k, *(r.get(n) for n in names)) for k, r in enumerate(rows)], ["fid", *names]) if any(any(v is not None for v in r.values()) for r in rows) else None
        if table is not None:
            geoms = geoms.join(table, "fid")
    return Features(geoms, projection or LonLat())


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_pickle(spark: SparkSession, path: str):
    return pickle.loads(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


#: Extension -> (kind, reader). Kinds: table, raster, vector, object.
READERS: dict[str, tuple[str, Callable]] = {
    "csv": ("table", lambda spark, path, **o: spark.read.csv(path, header=True, **({"inferSchema": True} | o))),
    "tsv": ("table", lambda spark, path, **o: spark.read.csv(path, header=True, sep="\t", **({"inferSchema": True} | o))),
    "json": ("table", lambda spark, path, **o: spark.read.json(path, **o)),
    "jsonl": ("table", lambda spark, path, **o: spark.read.json(path, **o)),
    "xml": ("table", lambda spark, path, **o: spark.read.format("xml").options(**({"rowTag": "row"} | o)).load(path)),
    "parquet": ("table", lambda spark, path, **o: spark.read.options(**o).parquet(path)),
    "orc": ("table", lambda spark, path, **o: spark.read.options(**o).orc(path)),
    "txt": ("table", lambda spark, path, **o: spark.read.text(path, **o)),
    "asc": ("raster", read_ascii_grid),
    "shp": ("vector", read_shapefile),
    "pkl": ("object", read_pickle),
}


def register(extension: str, kind: str, reader: Callable) -> None:
    READERS[extension.lower()] = (kind, reader)


def extension_of(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()


def choose(files: list[str]) -> tuple[str, Callable]:
    """(file, reader) of those that can be read: vector before raster before tables; the last of several."""
    known = [f for f in files if extension_of(f) in READERS]
    if not known:
        raise ValueError(f"no reader for {files}; register one, or give a reader")
    rank = {"vector": 0, "raster": 1, "table": 2, "object": 3}
    best = min(rank[READERS[extension_of(f)][0]] for f in known)
    chosen = [f for f in known if rank[READERS[extension_of(f)][0]] == best][-1]
    return chosen, READERS[extension_of(chosen)][1]


def read(spark: SparkSession, path: str, **options):
    return choose([path])[1](spark, path, **options)


def input_files(df: DataFrame) -> list[str]:
    return sorted(df.inputFiles())
