"""URL filters by Bloom filter cascades.

A cascade holds a set of listed keys against a complete universe of keys. Level 1 is a Bloom filter of the listed
keys; level 2 one of the universe's keys that level 1 passes wrongly; level 3 one of the listed keys that level 2
passes wrongly, and so on until a level passes nothing wrongly. A key of the universe is listed if the first level
that rejects it has an even number (or none rejects it and the number of levels is odd). So membership is exact for
every key of the corpus, each row is judged by itself, and nothing is joined.

Lists that need more than MOST_BITS in one filter are cut in shards by a checksum of the key: each shard has a cascade
of its own, and the pages are judged by one shard after the other, so what executors hold stays bounded.

A key is a host suffix (whole labels) with a prefix of the path, such as ``net/`` or ``example.com/en/7``. The
universe is every key that a url of the corpus has, for the path lengths that the listed keys use.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, written

#: A filter may have this many bits (32 MB); longer lists are cut in shards.
MOST_BITS = 1 << 28

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Hosts (with all subdomains) that are blocked where no rule fits.
BLOCKED_HOSTS = ("spam-farm.example.org", "spam-farm.example.com", "spam-farm.example.net")

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://``, lower-cased) and path (without query and fragment); both empty if there is none."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [k for k in (rest.find(c) for c in "/?#") if k >= 0]
    at = min(ends, default=len(rest))
    ends = [k for k in (rest.find(c, at) for c in "?#") if k >= 0]
    return rest[:at].translate(_LOWER), rest[at : min(ends, default=len(rest))]


def keys_of(host: str, path: str, lengths: Iterable[int]) -> list[str]:
    """All keys of a url, the longest first."""
    labels = host.split(".") if host else []
    found = [".".join(labels[k:]) + path[:n] for k in range(len(labels)) for n in lengths if n <= len(path)]
    return sorted(found, key=len, reverse=True)


class TooManyKeys(Exception):
    """A level needs more bits than are sent to executors at once."""


def _bytes(key: str) -> bytes:
    return key.encode("utf-8", "surrogatepass")


@dataclass
class Bloom:
    bits: bytes
    m: int
    k: int
    seed: int

    @staticmethod
    def shape(n: int, rate: float) -> tuple[int, int]:
        m = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2 / 64) * 64)
        return m, max(1, round(m / max(n, 1) * math.log(2)) if n else 1) if m / max(n, 1) < 40 else 20

    @staticmethod
    def places(key: str, m: int, k: int, seed: int) -> list[int]:
        h = xxhash.xxh3_128_intdigest(_bytes(key), seed=seed)
        a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
        return [((a + i * b) & 0xFFFFFFFFFFFFFFFF) % m for i in range(k)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(key, self.m, self.k, self.seed))

    @classmethod
    def build(cls, keys: DataFrame, n: int, rate: float, seed: int, most_bits: int = MOST_BITS) -> Bloom:
        """From a table (key): each task sets bits of its own, and words of 64 bits are combined by ``bit_or``."""
        m, k = cls.shape(n, rate)
        if m > max(64, most_bits):
            raise TooManyKeys(f"{n} keys need {m} bits")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(m // 64, dtype=np.uint64)
            for b in batches:
                for key in b.column(0).to_pylist():
                    for p in cls.places(key, m, k, seed):
                        words[p >> 6] |= np.uint64(1 << (p & 63))
            full = np.nonzero(words)[0]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(words[full].view(np.int64), pa.int64())], names=["at", "word"])

        bits = np.zeros(m // 64, dtype="<i8")
        found = keys.select("key").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # at most m / 64 rows
        bits[found.column("at").to_numpy()] = found.column("word").to_numpy()
        return cls(bits.tobytes(), m, k, seed)


@dataclass
class Cascade:
    """Levels for the keys of one shard; it knows nothing of other shards' keys, which are not in it."""

    levels: list[Bloom]
    shard: int = 0
    shards: int = 1

    def __contains__(self, key: str) -> bool:
        if not self.levels or self.shards > 1 and zlib.crc32(_bytes(key)) % self.shards != self.shard:
            return False
        for number, level in enumerate(self.levels):
            if key not in level:
                return number % 2 == 1
        return len(self.levels) % 2 == 1


def build_cascade(listed: DataFrame, urls: DataFrame, lengths: tuple[int, ...], seed: int = 1, rate: float = 0.5, most_levels: int = 60, n_urls: int | None = None, shard: int = 0, shards: int = 1, most_bits: int = MOST_BITS) -> Cascade:
    """The cascade of ``listed`` (key) over all keys of ``urls`` (url), of those in one of ``shards``.

    Level 1 takes a rate that balances its size with what it passes wrongly. The universe is read once and never
    written: only what passes level 1 is kept, marked by one aggregation as listed or not. ``n_urls`` spares a count.
    """
    spark = urls.sparkSession
    listed = listed.select("key").where("key is not null").distinct()
    if shards > 1:
        listed = listed.where(F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(shards)) == shard)
    n_listed = listed.count()
    if not n_listed:
        return Cascade([], shard, shards)
    if n_urls is None:
        n_urls = urls.count()
    first = min(0.5, max(1e-6, math.sqrt(0.5) * n_listed / max(1, n_urls * len(lengths) * 4 / shards)))
    levels = [Bloom.build(listed, n_listed, first, seed * 1000, most_bits)]
    top = spark.sparkContext.broadcast(Cascade(levels[:1], shard, shards))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {key for url in b.column(0).to_pylist() for key in keys_of(*host_and_path(url), lengths) if key in top.value}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["key"])

    passed = urls.select("url").mapInArrow(passing, "key string")
    marks = passed.select("key", F.lit(1).alias("mark")).union(listed.select("key", F.lit(2)))
    marked = written(marks.groupBy("key").agg(F.bit_or("mark").alias("mark")), "keys")
    tables = [marked]
    held, other = marked.where("mark = 1").select("key"), marked.where("mark = 3").select("key")
    try:
        while n := held.count():  # the next level holds ``held`` and is tried on ``other``
            if len(levels) >= most_levels:
                raise RuntimeError("the cascade does not end")
            levels.append(Bloom.build(held, n, rate, seed * 1000 + len(levels), most_bits))
            last = spark.sparkContext.broadcast(levels[-1])

            def still(batches: Iterator[pa.RecordBatch], last=last) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield pa.RecordBatch.from_arrays([pa.array([key for key in b.column(0).to_pylist() if key in last.value], pa.string())], names=["key"])

            other, held = held, written(other.mapInArrow(still, "key string"), "keys")
            tables.append(held)
    finally:
        for table in tables:
            forget(spark, table)
    return Cascade(levels, shard, shards)


def _lower(host) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame = RULES, blocked_hosts: Iterable[str] | DataFrame = BLOCKED_HOSTS, most_bits: int = MOST_BITS) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules`` (verdict, host, path) and ``blocked_hosts`` (host) are values or tables of any size. Of the rules that fit
    a url the longest decides (of equally long ones that with the longer host; of equal ones, block); else a host in
    ``blocked_hosts`` or below one is blocked; all else is allowed. Null urls and such without ``://`` have an empty host
    and path and are allowed; rules and hosts that are null count for nothing. Repeated rows are judged one by one.
    Columns of ``pages`` named like a new one are replaced.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    if not isinstance(blocked_hosts, DataFrame):
        blocked_hosts = spark.createDataFrame([(h,) for h in blocked_hosts], "host string")
    urls = pages.select(F.col("url").cast("string"))
    n_urls = urls.count()
    lengths = tuple(sorted(r[0] for r in rules.where("path is not null").select(F.length("path")).distinct().collect()))  # as many as lengths of paths
    keys = rules.select("verdict", F.concat(_lower("host"), "path").alias("key"))
    lists = [(keys.where(F.col("verdict") == v), lengths) for v in ("block", "allow")] + [(blocked_hosts.select(_lower("host").alias("key")), (0,))]
    columns = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]

    def judged_by(table: DataFrame, shard: int, shards: int) -> DataFrame:
        """``table`` with what one shard says of each url in column __found."""
        made = [build_cascade(listed, urls, n, seed, n_urls=n_urls, shard=shard, shards=shards, most_bits=most_bits) for seed, (listed, n) in enumerate(lists, 1)]
        told = spark.sparkContext.broadcast(made)

        @F.pandas_udf("host string, path string, place int, rule string, verdict string, blocked boolean")
        def judge(url):
            import pandas as pd

            block, allow, hosts = told.value
            rows = []
            for u in url:
                host, path = host_and_path(u)
                row = (host, path, None, None, None)
                for place, key in enumerate(keys_of(host, path, lengths)):
                    if verdict := "block" if key in block else "allow" if key in allow else None:
                        row = (host, path, place, key, verdict)
                        break
                rows.append((*row, row[2] is None and any(key in hosts for key in keys_of(host, "", (0,)))))
            found = pd.DataFrame(rows, columns=["host", "path", "place", "rule", "verdict", "blocked"])
            return found.astype({"place": "Int32"})

        return table.select("*", judge(F.col("url").cast("string")).alias("__found"))

    def judged(shards: int) -> DataFrame:
        so_far = judged_by(pages, 0, shards)
        for shard in range(1, shards):
            before = written(so_far.withColumnRenamed("__found", "__before"), "judged")
            one, two = F.col("__before"), F.col("__found")
            better = F.coalesce(two["place"] < one["place"], one["place"].isNull() & two["place"].isNotNull())
            field = lambda name: F.when(better, two[name]).otherwise(one[name]).alias(name)
            best = F.struct(two["host"], two["path"], field("place"), field("rule"), field("verdict"), (one["blocked"] | two["blocked"]).alias("blocked"))
            so_far = judged_by(before, shard, shards).withColumn("__found", best).drop("__before")
        return so_far

    shards = 1
    while True:
        try:
            found = judged(shards)
            break
        except TooManyKeys:
            shards *= 2
    otherwise = F.when(F.col("__found.blocked"), "block").otherwise("allow")
    return found.select(*columns, "__found.host", "__found.path", "__found.rule", F.coalesce("__found.verdict", otherwise).alias("verdict"))
