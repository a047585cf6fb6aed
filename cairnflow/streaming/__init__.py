"""Streams.

The workflows that this engine covers are batch; nothing here keeps state between batches. A tag log is a folder of
Parquet files that only grows, so Structured Streaming can follow it as it is: see ``follow_log``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def follow_log(spark: SparkSession, store_root: str) -> DataFrame:
    """New rows of a store's tag log as a stream (cacheId, tagKey, tagValue, createdDate, seq, op)."""
    from cairnflow.plans.store import LOG

    return spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{store_root.rstrip('/')}/tags")
