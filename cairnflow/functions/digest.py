"""Content hashes: of plain values, functions, files, and DataFrames.

Two values are the same to a hash if they would give the same result: numbers are rounded half to even to seven digits,
all kinds of missing values are one, and the order of keys doesn't matter. The hash of a DataFrame is that of its schema
and of the multiset of its rows: it doesn't depend on their order or partitioning, and it sees repeated rows.
"""

from __future__ import annotations

import dataclasses
import decimal
import hashlib
import inspect
import json
import math
import os
from collections.abc import Callable, Iterable, Mapping
from functools import singledispatch
from pathlib import PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 7


def text_hash(text: str, algorithm: str = "sha256") -> str:
    if algorithm == "xxhash64":
        import xxhash

        return xxhash.xxh64_hexdigest(text.encode())
    return hashlib.new(algorithm, text.encode()).hexdigest()


@singledispatch
def canonical(value) -> object:
    """A JSON value that is equal for values that count as the same. Register more types as needed."""
    if value is None:
        return None
    if dataclasses.is_dataclass(value):
        return {"fields": {f.name: canonical(getattr(value, f.name)) for f in dataclasses.fields(value)}}
    if callable(value):
        return {"function": function_text(value)}
    if hasattr(value, "tolist"):
        return canonical(value.tolist())
    raise TypeError(f"no hash for {type(value).__name__}; register one with canonical.register")


@canonical.register(bool)
def _(value):
    return {"bool": value}


@canonical.register(int)
def _(value):
    return {"int": value}


@canonical.register(float)
def _(value):
    if math.isnan(value):
        return None
    if math.isinf(value):
        return {"number": repr(value)}
    return {"number": repr(round(value, DIGITS) + 0.0)}


@canonical.register(decimal.Decimal)
def _(value):
    return canonical(float(value))


@canonical.register(str)
def _(value):
    return {"text": value}


@canonical.register(bytes)
def _(value):
    return {"bytes": hashlib.sha256(value).hexdigest()}


@canonical.register(PurePath)
def _(value):
    return {"file": file_hash(str(value)) if os.path.isfile(value) else os.path.basename(value)}


@canonical.register(Mapping)
def _(value):
    return {"map": sorted([str(k), canonical(v)] for k, v in value.items())}


@canonical.register(list)
@canonical.register(tuple)
def _(value):
    return {"list": [canonical(v) for v in value]}


@canonical.register(set)
@canonical.register(frozenset)
def _(value):
    return {"set": sorted(json.dumps(canonical(v), sort_keys=True) for v in value)}


@canonical.register(DataFrame)
def _(value):
    return {"table": frame_hash(value)}


def function_text(fn: Callable) -> object:
    """What a function does: its source (or bytecode), defaults, and the plain values that it closes over."""
    fn = inspect.unwrap(fn)
    parts: dict[str, object] = {}
    if hasattr(fn, "func"):  # functools.partial
        return {"of": function_text(fn.func), "args": canonical(list(fn.args)), "named": canonical(dict(fn.keywords))}
    try:
        parts["source"] = "\n".join(line.strip() for line in inspect.getsource(fn).splitlines() if line.strip())
    except (OSError, TypeError):
        code = getattr(fn, "__code__", None)
        parts["source"] = code.co_code.hex() + repr(code.co_consts) if code else f"{getattr(fn, '__module__', '')}.{getattr(fn, '__qualname__', repr(fn))}"
    parts["defaults"] = [plain(v) for v in getattr(fn, "__defaults__", None) or ()]
    for name, cell in zip(getattr(getattr(fn, "__code__", None), "co_freevars", ()), getattr(fn, "__closure__", None) or ()):
        parts[f"closes over {name}"] = plain(cell.cell_contents)
    return parts


def plain(value) -> object:
    """``canonical``, with the type's name for what has none."""
    try:
        return canonical(value)
    except TypeError:
        return type(value).__name__


def value_hash(value, algorithm: str = "sha256") -> str:
    return text_hash(json.dumps(canonical(value), sort_keys=True, ensure_ascii=False), algorithm)


def arguments_hash(hashes: Mapping[str, str], algorithm: str = "sha256") -> str:
    """One hash of named hashes: the order of names doesn't matter, which value has which name does."""
    return text_hash(json.dumps(sorted(hashes.items()), ensure_ascii=False), algorithm)


def truncated(tree: Mapping, depth: int = 3) -> dict[str, str]:
    """A tree of hashes as dotted names down to ``depth``; what lies below is hashed to one."""
    found: dict[str, str] = {}

    def walk(node, name: str, level: int) -> None:
        if isinstance(node, Mapping) and level < depth:
            for key in sorted(node):
                walk(node[key], f"{name}.{key}" if name else str(key), level + 1)
        else:
            found[name] = node if isinstance(node, str) else value_hash(node)

    walk(tree, "", 0)
    return found


def file_hash(path: str, algorithm: str = "sha256", quick: bool = False, length: int | None = None) -> str:
    """Of a local file's content, in pieces, or of its first ``length`` bytes; ``quick`` takes the size for it."""
    if quick:
        return str(os.path.getsize(path))
    if algorithm == "xxhash64":
        import xxhash

        state = xxhash.xxh64()
    else:
        state = hashlib.new(algorithm)
    left = os.path.getsize(path) if length is None else length
    with open(path, "rb") as file:
        while left > 0 and (piece := file.read(min(left, 1 << 20))):
            state.update(piece)
            left -= len(piece)
    return state.hexdigest()


def files(spark, path: str, algorithm: str = "sha256", quick: bool = False, recursive: bool = False) -> DataFrame:
    """A measured manifest (file, checksum, filesize, algorithm) of the files in a folder of any file system."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    rows = read.load(path)
    size = F.col("length").cast("string")
    if quick:
        checksum: Column = size
    elif algorithm in ("sha1", "sha256", "sha512", "md5"):
        checksum = {"sha1": F.sha1("content"), "md5": F.md5("content")}.get(algorithm, F.sha2("content", int(algorithm[3:]) if algorithm[3:].isdigit() else 256))
    else:

        @F.pandas_udf("string")
        def xxh(content):
            import xxhash

            return content.map(lambda b: xxhash.xxh64_hexdigest(b))

        checksum = xxh("content")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), checksum.alias("checksum"), size.alias("filesize"), F.lit(algorithm).alias("algorithm"))


def _steady(c: Column, kind: T.DataType) -> Column:
    """A column in which values that count as the same are the same."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        return F.when(~F.isnan(d), F.bround(d, DIGITS) + F.lit(0.0))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _steady(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.struct(*(_steady(c[f.name], f.dataType).alias(f.name) for f in kind))
    if isinstance(kind, T.MapType):
        return _steady(F.array_sort(F.map_entries(c)), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    return c


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """64 bits of a row; nulls are told by flags, as the hash itself passes over them."""
    fields = [_steady(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
    return F.xxhash64(F.lit(seed), *(x for c in fields for x in (c.isNull(), c)))


def frame_digest(df: DataFrame, ordered_by: Iterable[str] = ()) -> DataFrame:
    """One row (n, h1, h2): count and sums of two row hashes. Sums, as repeated rows would cancel in an exclusive or.

    ``ordered_by`` makes the order by these columns count: each row is hashed with its predecessor's hash.
    """
    keys = list(ordered_by)
    if keys:
        from pyspark.sql import Window

        base = df.withColumn("__h", row_hash(df))
        df = base.select("*", F.lag("__h").over(Window.orderBy(*keys)).alias("__before"))
    wide = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n"), wide(row_hash(df, 0)).alias("h1"), wide(row_hash(df, 1)).alias("h2"))


def frame_hash(df: DataFrame, ordered_by: Iterable[str] = ()) -> str:
    """Hash of a DataFrame's names, types and rows: one aggregation over it."""
    row = frame_digest(df, ordered_by).first()
    schema = [[f.name, f.dataType.simpleString()] for f in df.schema]
    return text_hash(json.dumps([schema, row.n, str(row.h1), str(row.h2)]))


def study_area_name(values: Iterable[str]) -> str:
    """A name for a set of names: their order doesn't matter."""
    return text_hash("|".join(sorted(values)))[:16]
