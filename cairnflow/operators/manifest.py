"""Manifests: what files should be (expected) against what they are (measured).

Expected and measured tables have the columns file, checksum, filesize, algorithm, all text. A comparison has nine
columns: result (OK, FAIL or null where a file is missing), the two file names, and checksum, algorithm and filesize of
both sides (_x expected, _y measured).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("file", "checksum", "filesize", "algorithm")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
RESULT = ("result", "expectedFile", "actualFile", "checksum_x", "checksum_y", "algorithm_x", "algorithm_y", "filesize_x", "filesize_y")
DEFAULT_ALGORITHM = "xxhash64"
DIRECTORY = "dir"


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def read(spark, path: str) -> DataFrame:
    """A manifest file: blanks between columns, a header, all text; older ones may lack filesize or algorithm."""
    found = spark.read.csv(path, sep=" ", quote='"', header=True, inferSchema=False, nullValue="NA")
    return found.select(*(F.col(c).cast("string") if c in found.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS))


def write(manifest: DataFrame, path: str) -> None:
    """Sorted by file, as one file: a manifest has a row per file and is small."""
    manifest.select(*COLUMNS).orderBy("file").coalesce(1).write.mode("overwrite").csv(path, sep=" ", header=True, quoteAll=True, nullValue="NA")


def base_name(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c, "([^/]*)/*$", 1)


def compare(expected: DataFrame, measured: DataFrame, quick: bool = False) -> DataFrame:
    """Every expected file against the measured ones; ``quick`` compares sizes only.

    Of several rows for one expected file the best counts: OK before FAIL before missing (ties: the smallest actual
    checksum). Directories (checksum ``dir``) are OK where they exist.
    """
    x = expected.select(F.col("file").alias("expectedFile"), F.col("checksum").alias("checksum_x"), F.col("filesize").alias("filesize_x"), F.col("algorithm").alias("algorithm_x"))
    y = measured.select(F.col("file").alias("actualFile"), F.col("checksum").alias("checksum_y"), F.col("filesize").alias("filesize_y"), F.col("algorithm").alias("algorithm_y"))
    joined = x.join(y, F.col("expectedFile") == F.col("actualFile"), "left")
    there = F.col("checksum_y").isNotNull() | F.col("filesize_y").isNotNull()
    same = F.col("filesize_x").eqNullSafe(F.col("filesize_y")) if quick else F.coalesce(F.col("checksum_x") == F.col("checksum_y"), F.lit(False))
    same |= F.coalesce(F.col("checksum_x") == DIRECTORY, F.lit(False))
    result = F.when(there, F.when(same, "OK").otherwise("FAIL"))
    ranked = joined.withColumn("result", result)
    order = Window.partitionBy("expectedFile").orderBy(F.col("result").desc_nulls_last(), F.col("checksum_y").asc_nulls_last())
    return ranked.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(*RESULT)


def by_base_name(expected: DataFrame, measured: DataFrame) -> DataFrame:
    """``measured`` renamed to the expected file with the same last path component, where the full name is unknown."""
    names = expected.select(F.col("file").alias("wanted"), base_name("file").alias("base")).groupBy("base").agg(F.min("wanted").alias("wanted"))
    known = expected.select(F.col("file").alias("known")).distinct()
    left = measured.join(known, F.col("file") == F.col("known"), "left").withColumn("base", base_name("file")).join(names, "base", "left")
    return left.select(F.when(F.col("known").isNull(), F.coalesce("wanted", "file")).otherwise(F.col("file")).alias("file"), *COLUMNS[1:])


def in_order(result: DataFrame) -> DataFrame:
    """OK rows, then FAIL, then missing ones."""
    return result.orderBy(F.when(F.col("result") == "OK", 0).when(F.col("result") == "FAIL", 1).otherwise(2), "expectedFile")


def upsert(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """``manifest`` with the rows of ``new`` in place of those for the same files; columns that one lacks are null."""
    rest = manifest.join(new.select("file").distinct(), "file", "left_anti")
    return rest.unionByName(new, allowMissingColumns=True)


def with_saved(measured: DataFrame, saved: DataFrame, columns: Iterable[str] = COLUMNS) -> DataFrame:
    """``measured`` with the columns that only ``saved`` has, joined on all of ``columns`` (nulls are equal): what a manifest
    that is written anew keeps of the one before. Rows that are unchanged and repeated in ``saved`` count once."""
    columns = list(columns)
    more = [c for c in saved.columns if c not in measured.columns]
    old = saved.select(*(F.col(c).alias(f"__{c}") for c in columns), *more).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
    return measured.join(old, same, "left").select(*measured.columns, *more)


def last_by_file(rows: DataFrame, sequence: str, first: bool = False) -> DataFrame:
    """One row for each file: the last (or first) by an explicit sequence."""
    order = F.col(sequence).asc() if first else F.col(sequence).desc()
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy("file").orderBy(order))).where("__r = 1").drop("__r")


def not_in(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose (file, checksum) the other manifest lacks."""
    return rows.join(other.select("file", "checksum").distinct(), ["file", "checksum"], "left_anti")


def missing(needed: DataFrame, result: DataFrame) -> DataFrame:
    """Needed files (file) that the comparison doesn't find OK."""
    ok = result.where("result = 'OK'").select(F.col("expectedFile").alias("file")).distinct()
    return needed.join(ok, "file", "left_anti")


def needed_ok(needed: DataFrame, result: DataFrame) -> DataFrame:
    """(file, ok): whether each needed file is OK under its expected or its actual name."""
    ok = result.where("result = 'OK'")
    by_expected = ok.select(F.col("expectedFile").alias("file"), F.lit(True).alias("a")).distinct()
    by_actual = ok.select(F.col("actualFile").alias("file"), F.lit(True).alias("b")).distinct()
    found = needed.join(by_expected, "file", "left").join(by_actual, "file", "left")
    return found.select("file", F.coalesce("a", "b", F.lit(False)).alias("ok"))


def directories_ok(result: DataFrame) -> DataFrame:
    """``result`` in which a directory that isn't OK becomes so if a file below it is."""
    parents = result.where("result = 'OK'").select(F.regexp_extract("expectedFile", "^(.*)/[^/]*$", 1).alias("parent")).distinct()
    joined = result.join(parents, F.col("expectedFile") == F.col("parent"), "left")
    is_dir = (F.col("checksum_x") == DIRECTORY) & F.col("parent").isNotNull()
    return joined.withColumn("result", F.when(is_dir, "OK").otherwise(F.col("result"))).select(*RESULT)


#: Which roles' rows are dropped at each level of a purge.
PURGE = {
    1: ("all",),
    2: ("target",),
    3: ("archive",),
    4: ("also",),
    5: ("target", "also"),
    6: ("target", "archive", "also"),
    7: ("target", "archive", "also", "url"),
}


def purge(manifest: DataFrame, level: int, target: Iterable[str] = (), archive: Iterable[str] = (), also: Iterable[str] = (), url: Iterable[str] = ()) -> DataFrame:
    """``manifest`` without the rows of the roles that the level names; 0 keeps all, 1 drops all."""
    if not level:
        return manifest
    if PURGE[level] == ("all",):
        return manifest.where(F.lit(False))
    roles = {"target": target, "archive": archive, "also": also, "url": url}
    gone = sorted({str(f) for role in PURGE[level] for f in roles[role]})
    return manifest.where(~F.col("file").isin(gone)) if gone else manifest


def similar(manifest: DataFrame, target: str) -> DataFrame:
    """Files with the target's stem (its name without the extension)."""
    stem = target.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return manifest.where(F.regexp_replace(base_name("file"), "[.][A-Za-z0-9]+$", "") == stem)


def directory_prefixes(paths: DataFrame, column: str = "file") -> DataFrame:
    """(path, n): path prefixes that occur more than once, so are directories."""
    parts = F.split(column, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return paths.select(F.explode(prefixes).alias("path")).groupBy("path").agg(F.count("*").alias("n")).where("n > 1")


def summary(result: DataFrame) -> DataFrame:
    return result.groupBy("result").agg(F.count("*").alias("n"))
