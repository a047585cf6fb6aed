"""Searches and maintenance of the tag table: one row for each tag of a stored result.

Everything here maps DataFrames (cacheId, tagKey, tagValue, createdDate) to DataFrames; nothing has side effects. An
entry is the set of rows with one cacheId. Filters that look at several rows of an entry are one aggregation (combined
before the shuffle) and a semi join, whatever the number of filters.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("cacheId", T.StringType(), False),
        T.StructField("tagKey", T.StringType()),
        T.StructField("tagValue", T.StringType()),
        T.StructField("createdDate", T.TimestampType()),
    ]
)
#: Keys with one value per entry: of several rows the latest counts.
SINGLE_VALUED = ("objectId", "elapsedTimeLoad", "inCloud", "file.size", "function", "class", "object.size", "resultHash")
#: Keys that say nothing about what was computed: left out when entries are compared.
NOT_COMPARED = ("accessed", "elapsedTimeLoad", "elapsedTimeDigest", "elapsedTimeFirstRun", "inCloud", "file.size", "object.size", "resultHash")


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def parse(tags: Iterable[str]) -> list[tuple[str, str]]:
    """(key, value) of strings ``key:value``, split at the first colon; without one the key is ``userTags``."""
    return [(k, v) if mark else ("userTags", k) for k, mark, v in (t.partition(":") for t in tags)]


def parse_column(column: Column | str) -> Column:
    """The same for a column: a struct of tagKey and tagValue."""
    c = F.col(column) if isinstance(column, str) else column
    parts = F.split(c, ":", 2)
    several = F.size(parts) > 1
    key = F.when(several, F.get(parts, F.lit(0))).otherwise(F.lit("userTags"))
    value = F.when(several, F.get(parts, F.lit(1))).otherwise(c)
    return F.struct(key.alias("tagKey"), value.alias("tagValue"))


def _anywhere(test) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(test(F.col(c)), F.lit(False)) for c in ("cacheId", "tagKey", "tagValue"))), F.lit(False))


def matching_ids(
    tags: DataFrame,
    user_tags: Iterable[str] = (),
    match: str = "all_regex",
    function: Iterable[str] = (),
    cache_id: Iterable[str] = (),
    after=None,
    before=None,
    time_of: str = "accessed",
    **key_values: str | Iterable[str],
) -> DataFrame:
    """cacheIds of the entries that pass all filters.

    ``match``: ``all_regex`` (each pattern occurs in some row's id, key or value) or ``any_exact`` (one of the strings
    equals one). ``after``/``before``: inclusive bounds of any ``accessed`` tag, or of createdDate.
    """
    if match not in ("all_regex", "any_exact"):
        raise ValueError("match is all_regex or any_exact")
    if ids := list(cache_id):
        tags = tags.where(F.col("cacheId").isin(ids))
    needs: list[Column] = []
    if names := list(function):
        needs.append((F.col("tagKey") == "function") & F.col("tagValue").isin(names))
    for key, values in key_values.items():
        needs.append((F.col("tagKey") == key) & F.col("tagValue").isin([values] if isinstance(values, str) else list(values)))
    if after is not None or before is not None:
        own = time_of == "accessed"
        at = F.to_timestamp("tagValue") if own else F.col("createdDate")
        bound = F.col("tagKey") == "accessed" if own else F.lit(True)
        if after is not None:
            bound &= at >= F.lit(after).cast("timestamp_ntz" if not own else "timestamp")
        if before is not None:
            bound &= at <= F.lit(before).cast("timestamp_ntz" if not own else "timestamp")
        needs.append(bound)
    texts = list(user_tags)
    if texts and match == "all_regex":
        needs += [_anywhere(lambda c, p=p: c.rlike(p)) for p in texts]
    elif texts:
        needs.append(_anywhere(lambda c: c.isin(texts)))
    if not needs:
        return tags.select("cacheId").distinct()
    if len(needs) == 1:
        return tags.where(needs[0]).select("cacheId").distinct()
    flags = [F.bool_or(F.coalesce(need, F.lit(False))).alias(f"f{k}") for k, need in enumerate(needs)]
    return tags.where(reduce(lambda a, b: a | b, needs)).groupBy("cacheId").agg(*flags).where(reduce(lambda a, b: a & b, (F.col(f"f{k}") for k in range(len(needs))))).select("cacheId")


def show(tags: DataFrame, ordered: bool = False, **filters) -> DataFrame:
    """All rows of the entries that pass ``filters`` (see ``matching_ids``); in order of cacheId if asked."""
    found = tags.join(matching_ids(tags, **filters), "cacheId", "left_semi") if filters else tags
    return found.orderBy("cacheId") if ordered else found


def show_one(tags: DataFrame, cache_id: str, without: Iterable[str] = ()) -> DataFrame:
    """Rows of one entry: a filter that reaches the scan."""
    found = tags.where(F.col("cacheId") == cache_id)
    return found.where(~F.col("tagKey").isin(list(without))) if without else found


def values_of(tags: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """(cacheId, value) of one key for each entry; ``default`` where an entry has none."""
    own = F.max_by(F.when(F.col("tagKey") == key, F.col("tagValue")), F.when(F.col("tagKey") == key, F.col("createdDate")))
    return tags.groupBy("cacheId").agg(F.coalesce(own, F.lit(default)).alias("value"))


def keep(tags: DataFrame, **filters) -> DataFrame:
    """What stays if all but the entries that pass the filters are deleted."""
    return show(tags, **filters)


def clear(tags: DataFrame, **filters) -> DataFrame:
    """What stays if the entries that pass the filters are deleted; without filters nothing."""
    if not filters:
        return tags.where(F.lit(False))
    return tags.join(matching_ids(tags, **filters), "cacheId", "left_anti")


def cleared(tags: DataFrame, **filters) -> DataFrame:
    """The rows that ``clear`` deletes."""
    return show(tags, **filters)


def latest_entry(tags: DataFrame) -> DataFrame:
    """Rows of the entry made last (ties: the largest cacheId)."""
    last = tags.agg(F.max_by("cacheId", F.struct("createdDate", "cacheId")).alias("cacheId"))
    return tags.join(last, "cacheId", "left_semi")


def merge(into: DataFrame, other: DataFrame) -> DataFrame:
    """``into`` with the entries of ``other`` that it lacks."""
    return into.unionByName(other.join(into.select("cacheId").distinct(), "cacheId", "left_anti"))


def merge_report(into: DataFrame, other: DataFrame) -> DataFrame:
    """For each entry of ``other`` whether a merge copies or skips it."""
    have = into.select("cacheId").distinct().withColumn("have", F.lit(True))
    return other.select("cacheId").distinct().join(have, "cacheId", "left").select("cacheId", F.when(F.col("have"), "skipped").otherwise("copied").alias("status"))


def shared_counts(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cacheId, n_shared): how many of the ``wanted`` tags (tagKey, tagValue) each entry has.

    ``wanted`` are one call's tags and go to every task: dealt by tag, all entries with a frequent one would meet in one task.
    An entry's tags are ranked in one sort by cacheId, which can spill; the last one's rank is the count.
    """
    named = tags.join(F.broadcast(wanted.select("tagKey", "tagValue").distinct()), ["tagKey", "tagValue"], "left_semi")
    own = Window.partitionBy("cacheId").orderBy("tagKey", "tagValue")
    ranked = named.select("cacheId", F.dense_rank().over(own).cast("long").alias("n_shared"), F.lead("tagKey").over(own).isNull().alias("last"))
    return ranked.where("last").select("cacheId", "n_shared")


def most_similar(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """The entries that share the most of the ``wanted`` tags (all such), with n_shared."""
    counts = shared_counts(tags, wanted)
    top = counts.agg(F.max("n_shared").alias("top"))
    return counts.join(F.broadcast(top), F.col("n_shared") == F.col("top")).select("cacheId", "n_shared")


def nth_latest(entries: DataFrame, tags: DataFrame, n: int = 1) -> DataFrame:
    """Of ``entries`` (cacheId) the one accessed n-th last (ties: the smaller cacheId first)."""
    own = entries.select("cacheId").hint("shuffle_hash")  # a table of each task's share of the entries; all tags need no sort
    at = tags.join(own, "cacheId", "left_semi").groupBy("cacheId").agg(F.max("createdDate").alias("latest"))
    top = at.orderBy(F.desc("latest"), "cacheId").limit(n)  # n rows at most, before the ranking
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("latest"), "cacheId"))).where(F.col("rank") == n).select("cacheId", "latest")


def differences(wanted: DataFrame, tags: DataFrame, cache_id: Column | str) -> DataFrame:
    """Each of the ``wanted`` (tagKey, tagValue) against one entry: same, other or missing."""
    stored = tags.where(F.col("cacheId") == cache_id).groupBy("tagKey").agg(F.collect_set("tagValue").alias("stored"))
    status = F.when(F.col("stored").isNull(), "missing").when(F.array_contains("stored", F.col("tagValue")), "same").otherwise("other")
    return wanted.join(F.broadcast(stored), "tagKey", "left").select("tagKey", "tagValue", status.alias("status"))


def latest_values(log: DataFrame, keys: Iterable[str] = SINGLE_VALUED, sequence: str = "createdDate") -> DataFrame:
    """The log's view: for single-valued keys the latest row per entry, all rows of the others."""
    single = F.col("tagKey").isin(list(keys))
    last = log.where(single).groupBy("cacheId", "tagKey").agg(F.max_by(F.struct("tagValue", "createdDate"), F.struct(sequence, "tagValue")).alias("x"))
    return log.where(~single).select("cacheId", "tagKey", "tagValue", "createdDate").unionByName(last.select("cacheId", "tagKey", "x.*"))


def pivoted(tags: DataFrame, keys: Iterable[str]) -> DataFrame:
    """One row for each entry, one column for each key (the largest value of several)."""
    return tags.groupBy("cacheId").pivot("tagKey", list(keys)).agg(F.max("tagValue"))


def as_map(tags: DataFrame) -> DataFrame:
    """One row for each entry: its tags as a map from key to values."""
    lists = tags.groupBy("cacheId", "tagKey").agg(F.sort_array(F.collect_set("tagValue")).alias("v"))
    return lists.groupBy("cacheId").agg(F.map_from_entries(F.collect_list(F.struct("tagKey", "v"))).alias("tags"))


def carries_all(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries that carry every one of the ``wanted`` tags: what replaces an entry in development mode, if there is one."""
    n = wanted.select("tagKey", "tagValue").distinct().agg(F.count("*").alias("n"))
    return shared_counts(tags, wanted).join(F.broadcast(n), F.col("n_shared") == F.col("n")).select("cacheId")


def unpivot_hashes(wide: DataFrame, ids: Iterable[str]) -> DataFrame:
    """Wide argument hashes as rows (ids, argument, hash)."""
    ids = list(ids)
    return wide.unpivot(ids, [c for c in wide.columns if c not in ids], "argument", "hash")


def representatives(results: DataFrame, key: str, result_hash: str) -> DataFrame:
    """For each row the smallest key with an equal result: one object is stored, the others point to it."""
    first = results.groupBy(result_hash).agg(F.min(key).alias("objectId"))
    return results.join(first, result_hash).select(key, result_hash, "objectId")


def total_size(tags: DataFrame) -> DataFrame:
    """Bytes of all objects, by the tag object.size."""
    return tags.where("tagKey = 'object.size'").agg(F.sum(F.col("tagValue").cast("long")).alias("bytes"))
