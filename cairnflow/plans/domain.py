"""A growing spatial table keyed by domain: what is asked for inside what is there is filtered, else computed and added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.operators import vector

ACTIONS = ("append", "replace", "nothing")


def is_covered(domain: DataFrame, existing: DataFrame) -> bool:
    """Whether every feature of ``domain`` lies in a feature of ``existing``."""
    covered = vector.contained(domain, existing).select("fid").distinct()
    return domain.select("fid").join(covered, "fid", "left_anti").isEmpty()


def for_domain(spark, path: str, domain: DataFrame, make: Callable[[DataFrame], DataFrame], action: str = "append") -> tuple[DataFrame, bool]:
    """(rows for the domain, whether they were computed).

    ``path`` holds a table with columns fid, geom and others. ``append`` adds computed rows, ``replace`` takes them
    for those whose domain they cover, ``nothing`` doesn't write.
    """
    if action not in ACTIONS:
        raise ValueError(f"action is one of {ACTIONS}")
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    existing = spark.read.parquet(path) if fs.exists(there) else None
    if existing is not None and is_covered(domain, existing.select("fid", "geom")):
        hits = vector.contained(domain, existing.select("fid", "geom")).select(F.col("within_fid").alias("fid")).distinct()
        return existing.join(hits, "fid", "left_semi"), False
    new = make(domain)
    if action != "nothing":
        old = existing
        if old is not None and action == "replace":
            gone = vector.contained(old.select("fid", "geom"), new.select("fid", "geom")).select("fid").distinct()
            old = old.join(gone, "fid", "left_anti")
        if old is not None:
            ids = old.agg(F.coalesce(F.max("fid"), F.lit(-1))).first()[0]
            shifted = new.withColumn("fid", F.col("fid") + F.lit(ids + 1))
            whole = old.unionByName(shifted, allowMissingColumns=True).dropDuplicates([c for c in old.columns if c not in ("fid", "geom")] + ["geom"])
        else:
            whole = new
        temp = f"{path}.new"
        whole.write.mode("overwrite").parquet(temp)
        fs.delete(there, True)
        fs.rename(jvm.org.apache.hadoop.fs.Path(temp), there)
        new = spark.read.parquet(path)
        hits = vector.contained(domain, new.select("fid", "geom")).select(F.col("within_fid").alias("fid")).distinct()
        found = new.join(hits, "fid", "left_semi")
        return found, True
    return new, True
