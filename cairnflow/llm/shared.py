"""What several operators of this subpackage need: written tables, columns, connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_KEPT: dict = {}  # of a Python worker
_USED: set = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset and Spark runs in this process a temporary folder is taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get("folder")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _LOCAL["folder"] = f"file://{tempfile.mkdtemp(prefix='cairnflow-')}"
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends here, and a lost executor costs nothing.

    What nobody forgets goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def with_settings(spark: SparkSession, settings: dict[str, str]):
    """SQL settings that hold for the jobs that run inside; afterwards they are as they were."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def release(spark: SparkSession) -> None:
    """Have shuffle files removed that no DataFrame needs any more.

    Executors drop them when the driver's collector finds their owners gone, which in a driver with room to spare can
    take until the end of a job of many steps.
    """
    import gc
    import time

    gc.collect()
    for _ in range(2):  # owners are found gone in the first round, what they owned in the second
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every id in ``edges`` (a, b): columns id, component, as a written table.

    Alternating large-star and small-star steps. Each step keeps at most as many edges as it gets; a hub's
    edges are pre-aggregated (min) before the shuffle, and the join that hands the minimum back can be split
    by adaptive execution. No component is gathered in one place.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node points to the smallest of the node's neighbourhood
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(now.groupBy("a").agg(F.min("b").alias("b"))).distinct()
        # small star: every smaller neighbour of a node, and the node, point to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        new = written(small, "edges")
        if last is not None:
            forget(spark, last)
        same = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        last, now = now, new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("id")).distinct()
    found = written(now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component"))).distinct(), "members")
    for table in (last, now):
        forget(spark, table)
    return found


def kept(key, make):
    """What a Python worker's tasks share, as a cache of words; ``make`` is called where it isn't there."""
    _USED.add(key)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Drop what the last task didn't use and give free memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    for key in set(_KEPT) - _USED:
        del _KEPT[key]
    _USED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    system = ctypes.CDLL(None)
    if hasattr(system, "malloc_trim"):  # glibc
        system.malloc_trim(0)


def tidied(run):
    """``run``, for mapInArrow: when a task is over, its worker gives memory back to the system.

    Workers wait for further tasks, beside JVM stages too. What they kept for tasks of another kind than the last goes.
    """

    def call(batches):
        try:
            yield from run(batches)
        finally:
            give_back()  # of the worker's own module: this function is sent with copies of what it names

    return call


def append(docs: DataFrame, fields: str, make, text: str = "text", rows: int = 1024, as_arrow: bool = False) -> DataFrame:
    """``docs`` with columns that ``make()(texts)`` yields (a list for each of ``fields``), ``rows`` texts at a time.

    ``make`` is called once in each task and returns the function. Columns of ``docs`` with a new column's name are
    replaced. Texts come as str or None, or as the Arrow array with ``as_arrow``.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    kept = [c for c in docs.columns if c.lower() not in {f.name.lower() for f in new}]
    kept += [text] * (text not in kept)
    frame = docs.select(*kept)
    whole = StructType(list(frame.schema) + list(new))
    at = kept.index(text)

    def run(batches):
        types = [f.type for f in to_arrow_schema(new)]
        call = make()
        for b in batches:
            for k in range(0, b.num_rows, rows):
                part = b.slice(k, rows)
                made = call(part.column(at) if as_arrow else part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(made, types))], names=[f.name for f in whole])

    return frame.mapInArrow(tidied(run), whole)


def bounded_sample(rows: DataFrame, key: str, bound: int, spare: float = 0.9) -> DataFrame:
    """About ``spare * bound`` of ``rows`` where there are more: chosen by a hash of ``key``, the same rows every time."""
    n = rows.count()
    if n <= bound:
        return rows
    share = int(spare * bound / n * (1 << 31))
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 31)) < share)


def by_group(df: DataFrame, keys: list[str], make, schema: str) -> DataFrame:
    """Calls ``make()(group)`` for the rows of each combination of ``keys`` (a pyarrow Table), which returns columns or None.

    Rows are dealt by the keys and sorted in each task, which streams over them: it holds one group at a time, so the
    caller keeps groups small.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)

    def run(batches):
        import numpy as np

        types, names, call, held, last = [f.type for f in to_arrow_schema(out)], out.fieldNames(), make(), [], None
        made: list[list] = []
        n_made = 0

        def close():
            nonlocal n_made
            table = pa.Table.from_batches(held)
            found = call(table)
            held.clear()
            if found is not None:
                made.append(found)
                n_made += len(found[0])

        def give():
            nonlocal n_made
            columns = [pa.concat_arrays([pa.array(m[k], t) for m in made]) for k, t in enumerate(types)]
            made.clear()
            n_made = 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(len(keys))]
            change = np.zeros(b.num_rows - 1, dtype=bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            starts = [0, *(np.nonzero(change)[0] + 1).tolist(), b.num_rows]
            if held and last != tuple(c[0] for c in columns):
                close()
            for a, z in zip(starts, starts[1:]):
                if a:
                    close()
                held.append(b.slice(a, z - a))
            last = tuple(c[-1] for c in columns)
            if n_made > 20_000:
                yield give()
        if held:
            close()
        if made:
            yield give()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(*keys, *(c for c in df.columns if c not in keys)).repartition(n, *keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(tidied(run), out)


class IdFilter:
    """A Bloom filter of ids, of at most 2 MB: sent to all executors, it spares rows that a join would drop anyway.

    Beyond some millions of ids it lets more rows pass, so an exact join has to follow.
    """

    MOST_BITS = 1 << 24

    def __init__(self, ids: DataFrame, column: str):
        n = ids.count()
        self.mask = (1 << max(16, min(self.MOST_BITS.bit_length() - 1, (12 * n).bit_length()))) - 1
        spots = F.explode(F.array(*self._spots(column))).alias("p")
        words = ids.select(spots).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        import numpy as np

        bits = np.zeros((self.mask + 1) // 64, dtype=np.int64)
        found = words.toArrow()  # at most 2 ** 18 rows
        bits[found.column("w").to_numpy()] = found.column("b").to_numpy()
        self.bits = bits

    def _spots(self, column: str) -> list:
        hashes = [F.xxhash64(F.lit(seed), F.col(column)) for seed in (0, 1)]
        return [c.bitwiseAND(F.lit(self.mask)) for h in hashes for c in (h, F.shiftrightunsigned(h, 32))]

    def columns(self, column: str) -> list:
        """What ``passes`` needs of each row."""
        return [F.xxhash64(F.lit(seed), F.col(column)).alias(f"__h{seed}") for seed in (0, 1)]

    def passes(self, h0, h1):
        """Which rows may hold one of the ids (numpy arrays of the two hashes)."""
        import numpy as np

        ok = np.ones(len(h0), dtype=bool)
        for h in (h0, h1):
            for p in (h & self.mask, (h.view(np.uint64) >> np.uint64(32)).astype(np.int64) & self.mask):
                ok &= (self.bits[p >> 6] >> (p & 63)) & 1 == 1
        return ok
