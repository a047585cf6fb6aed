"""A store of results on any Hadoop file system: objects by id, and an append-only log of tags.

``<root>/objects/<objectId>/`` holds a table (Parquet), a raster or features (their table and what describes it) or one pickled value; ``<root>/tags/`` the log, a folder of
Parquet for each append, with columns (cacheId, tagKey, tagValue, createdDate, seq, op). An object is written first and its tags last: what has no
tags doesn't exist. Deleting appends a tombstone; ``compact`` rewrites the log without what is dead.
"""

from __future__ import annotations

import datetime as dt
import os
import pickle
import time
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnflow.operators import tags as tag_ops
from cairnflow.operators.conform import Features, Raster

LOG = T.StructType([T.StructField("cacheId", T.StringType()), *tag_ops.SCHEMA.fields[1:], T.StructField("seq", T.LongType()), T.StructField("op", T.StringType())])
VALUE = "value binary"
#: Values that hold a table: their class, the field with the table, the field that describes it.
CODECS: dict[str, tuple[type, str, str]] = {"raster": (Raster, "cells", "grid"), "features": (Features, "rows", "projection")}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.memory: dict[str, object] = {}

    # Paths

    @property
    def tags_path(self) -> str:
        return f"{self.root}/tags"

    def object_path(self, object_id: str) -> str:
        return f"{self.root}/objects/{object_id}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def is_intact(self) -> bool:
        """Whether the store is there and its log can be read."""
        if not self.exists(self.tags_path):
            return False
        try:
            self._read_log().limit(1).collect()
            return True
        except Exception:
            return False

    def create(self, force: bool = False) -> Store:
        if force:
            self.drop()
        if not self.exists(self.tags_path):
            fs, p = self._fs(self.tags_path)
            fs.mkdirs(p)
        return self

    def drop(self) -> None:
        for part in ("tags", "objects", "locks"):
            self._delete(f"{self.root}/{part}")
        self.memory.clear()

    def move(self, new_root: str) -> Store:
        """The store under another path: paths in it are relative, so it is one rename."""
        fs, old = self._fs(self.root)
        _, new = self._fs(new_root)
        if not fs.rename(old, new):
            raise OSError(f"{self.root} could not be moved to {new_root}")
        self.root = new_root.rstrip("/")
        return self

    @contextmanager
    def locked(self, key: str, stale: float = 3600.0):
        """One holder for each key, whatever the process or machine: a file that is made only if it isn't there.

        A lock older than ``stale`` seconds, which a process has left that died, is taken over.
        """
        path = f"{self.root}/locks/{key}"
        fs, place = self._fs(path)
        fs.mkdirs(place.getParent())
        wait = 0.02
        while not self._made(fs, place):
            time.sleep(wait)
            wait = min(1.0, wait * 1.5)
            try:
                if time.time() - fs.getFileStatus(place).getModificationTime() / 1000 > stale:
                    fs.delete(place, False)
            except Py4JJavaError:  # it has gone meanwhile
                pass
        try:
            yield
        finally:
            fs.delete(place, False)

    @staticmethod
    def _made(fs, place) -> bool:
        if fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then
            try:
                os.close(os.open(place.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            fs.create(place, False).close()
        except Py4JJavaError as error:
            if not fs.exists(place) and "Exists" not in str(error.java_exception):
                raise
            return False
        return True

    # Tags

    def _append(self, rows: list[tuple], op: str = "add") -> None:
        now, seq = dt.datetime.now(), time.time_ns()
        full = [(i, k, v, now, seq + n, op) for n, (i, k, v) in enumerate(rows)]
        # a folder for each append: writers at the same time never share their temporary files
        self.spark.createDataFrame(full, LOG).coalesce(1).write.parquet(f"{self.tags_path}/{seq}-{uuid.uuid4().hex}")

    def _read_log(self) -> DataFrame:
        return self.spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(self.tags_path)

    def log(self) -> DataFrame:
        return self._read_log() if self.exists(self.tags_path) else self.spark.createDataFrame([], LOG)

    def tags(self) -> DataFrame:
        """Live rows: after an entry's last tombstone, and the latest of single-valued keys."""
        log = self.log()
        dead = log.where("op = 'delete'").groupBy("cacheId").agg(F.max("seq").alias("dead"))
        live = log.where("op = 'add'").join(dead, "cacheId", "left").where(F.col("dead").isNull() | (F.col("seq") > F.col("dead"))).drop("dead", "op")
        return tag_ops.latest_values(live, sequence="seq")

    def add_tag(self, cache_id: str, key: str, value: str) -> None:
        self._append([(cache_id, key, value)])

    update_tag = add_tag  # of a single-valued key the latest row counts

    def show(self, **filters) -> DataFrame:
        return tag_ops.show(self.tags(), **filters)

    def clear(self, **filters) -> list[str]:
        """Delete the entries that pass; without filters all. Returns their ids."""
        if not filters:
            ids = self.ids()
            self.drop()
            self.create()
            return ids
        ids = [r.cacheId for r in tag_ops.matching_ids(self.tags(), **filters).collect()]
        self.remove(ids)
        return ids

    def keep(self, **filters) -> list[str]:
        """Delete all but the entries that pass. Returns the ids that stay."""
        tags = self.tags()
        stay = tag_ops.matching_ids(tags, **filters)
        gone = [r.cacheId for r in tags.select("cacheId").distinct().join(stay, "cacheId", "left_anti").collect()]
        self.remove(gone)
        return self.ids()

    def clear_latest(self) -> list[str]:
        ids = [r.cacheId for r in tag_ops.latest_entry(self.tags()).select("cacheId").distinct().collect()]
        self.remove(ids)
        return ids

    def clear_recent(self, seconds: float) -> list[str]:
        """Delete what was made or accessed within so many seconds."""
        since = dt.datetime.now() - dt.timedelta(seconds=seconds)
        ids = [r.cacheId for r in self.tags().where(F.col("createdDate") >= F.lit(since)).select("cacheId").distinct().collect()]
        self.remove(ids)
        return ids

    def ids(self) -> list[str]:
        return sorted(r.cacheId for r in self.tags().select("cacheId").distinct().collect())

    def remove(self, ids: Iterable[str]) -> None:
        """Delete entries, and the objects that no other entry points to."""
        ids = list(ids)
        if not ids:
            return
        pointers = self.tags().where("tagKey = 'objectId'").select("cacheId", F.col("tagValue").alias("o"))
        mine = pointers.where(F.col("cacheId").isin(ids)).select("o").distinct()
        used = pointers.where(~F.col("cacheId").isin(ids)).select("o").distinct()
        orphans = [r.o for r in mine.join(used, "o", "left_anti").collect()]
        self._append([(i, None, None) for i in ids], "delete")
        for o in orphans:
            self._delete(self.object_path(o))
        for i in ids:
            self.memory.pop(i, None)

    def compact(self) -> None:
        """Put the live rows of the appends so far into one, which then replaces them.

        The new folder is there before an old one goes, and old ones go from the first on, so a reader, a crash or an
        append at the same time loses nothing: rows keep their sequence, and at worst some are there twice.
        """
        fs, top = self._fs(self.tags_path)
        old = sorted(s.getPath().toString() for s in fs.listStatus(top))
        if not old:
            return
        log = self.spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(*old)
        dead = log.where("op = 'delete'").groupBy("cacheId").agg(F.max("seq").alias("dead"))
        live = log.where("op = 'add'").join(dead, "cacheId", "left").where("dead is null or seq > dead").drop("dead")
        single = F.col("tagKey").isin(list(tag_ops.SINGLE_VALUED))
        last = F.max(F.when(single, F.col("seq"))).over(Window.partitionBy("cacheId", "tagKey"))
        kept = live.withColumn("__last", last).where(~single | (F.col("seq") == F.col("__last"))).select(*LOG.fieldNames()).distinct()
        name = f"{time.time_ns()}-{uuid.uuid4().hex}"
        made = f"{self.root}/compacting-{name}"
        kept.write.parquet(made)
        fs.rename(self._fs(made)[1], self._fs(f"{self.tags_path}/{name}")[1])
        for path in old:
            self._delete(path)

    # Objects

    def find(self, cache_id: str) -> dict[str, list[str]] | None:
        """Tags of one entry, or None."""
        rows = self.tags().where(F.col("cacheId") == cache_id).select("tagKey", "tagValue", "createdDate").collect()
        if not rows:
            return None
        found: dict[str, list[str]] = {}
        for r in sorted(rows, key=lambda r: r.createdDate):
            found.setdefault(r.tagKey, []).append(r.tagValue)
        found["createdDate"] = [min(r.createdDate for r in rows).isoformat()]
        return found

    def write_object(self, object_id: str, value) -> str:
        """Write a table, a raster, features or a plain value; returns its kind."""
        path = self.object_path(object_id)
        if isinstance(value, DataFrame):
            value.write.mode("overwrite").parquet(path)
            return "table"
        for kind, (made, table, described) in CODECS.items():
            if isinstance(value, made):
                getattr(value, table).write.mode("overwrite").parquet(f"{path}/table")
                rows = [(bytearray(pickle.dumps(getattr(value, described))),)]
                self.spark.createDataFrame(rows, VALUE).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
                return kind
        rows = [(bytearray(pickle.dumps(value)),)]
        self.spark.createDataFrame(rows, VALUE).coalesce(1).write.mode("overwrite").parquet(path)
        return "value"

    def read_object(self, object_id: str, kind: str):
        path = self.object_path(object_id)
        if kind in CODECS:
            about = pickle.loads(bytes(self.spark.read.schema(VALUE).parquet(f"{path}/about").first()[0]))
            return CODECS[kind][0](self.spark.read.parquet(f"{path}/table"), about)
        df = self.spark.read.parquet(path)
        return df if kind == "table" else pickle.loads(bytes(df.first()[0]))

    def save(self, cache_id: str, value, tags: Iterable[tuple[str, str]] = (), object_id: str | None = None, kind: str | None = None) -> None:
        """Object first (unless an equal one is there: ``object_id``), tags last."""
        if object_id is None:
            object_id = uuid.uuid4().hex
            kind = self.write_object(object_id, value)
        self._append([(cache_id, "objectId", object_id), (cache_id, "class", kind), *((cache_id, k, v) for k, v in tags)])

    def load(self, cache_id: str, entry: dict[str, list[str]] | None = None):
        entry = entry or self.find(cache_id)
        if entry is None:
            raise KeyError(cache_id)
        return self.read_object(entry["objectId"][-1], entry["class"][-1])

    def same_result(self, result_hash: str) -> tuple[str, str] | None:
        """(object id, kind) of a stored result with this hash."""
        tags = self.tags()
        hit = tags.where((F.col("tagKey") == "resultHash") & (F.col("tagValue") == result_hash)).select("cacheId").limit(1).collect()
        if not hit:
            return None
        entry = self.find(hit[0].cacheId)
        return entry["objectId"][-1], entry["class"][-1]

    def merge(self, other: Store) -> dict[str, str]:
        """Copy the entries of another store that this one lacks: objects, then tags. Returns status by id."""
        mine = set(self.ids())
        status: dict[str, str] = {}
        for i in other.ids():
            status[i] = "skipped" if i in mine else "copied"
            if i in mine:
                continue
            entry = other.find(i)
            value = other.load(i, entry)
            rest = [(k, v) for k, vs in entry.items() for v in vs if k not in ("objectId", "class", "createdDate")]
            self.save(i, value, rest)
        return status

    def size(self) -> int:
        """Bytes of all files of the store."""
        fs, p = self._fs(self.root)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def store_name(path: str, n_parents: int = 1) -> str:
    """A table name for a store's path: its last components, with a leading underscore before a digit."""
    parts = [p for p in os.path.normpath(path).replace("\\", "/").split("/") if p]
    name = "_".join("".join(c if c.isalnum() else "_" for c in p) for p in parts[-(n_parents + 1) :])
    return f"_{name}" if name[:1].isdigit() else name


def to_jdbc(tags: DataFrame, url: str, table: str, **properties: str) -> None:
    """The tag table in an external database (its driver must be on the class path)."""
    tags.write.jdbc(url, table, mode="overwrite", properties=properties)


def from_jdbc(spark: SparkSession, url: str, table: str, **properties: str) -> DataFrame:
    return spark.read.jdbc(url, table, properties=properties).select("cacheId", "tagKey", "tagValue", F.col("createdDate").cast("timestamp").alias("createdDate"))


def to_folders(tags: DataFrame, path: str) -> None:
    """The tag table with a folder for each entry: the other form that a store's tags can have."""
    tags.repartition("cacheId").write.partitionBy("cacheId").mode("overwrite").parquet(path)


def from_folders(spark: SparkSession, path: str) -> DataFrame:
    """What ``to_folders`` wrote; the entry's folder prunes a search for its id."""
    return spark.read.schema(tag_ops.SCHEMA).parquet(path).select(*tag_ops.SCHEMA.fieldNames())


def adopt(store: Store, tags: DataFrame) -> int:
    """Take entries of another form (folders, a database) into a store's log, those that it has left out; returns how many.

    The rows go from table to table, nothing is collected but their count. Objects are taken as they stand.
    """
    store.create()
    new = tags.join(store.tags().select("cacheId").distinct(), "cacheId", "left_anti")
    seq = time.time_ns()
    place = f"{store.tags_path}/{seq}-{uuid.uuid4().hex}"
    rows = new.select("cacheId", "tagKey", "tagValue", "createdDate", (F.lit(seq) + F.monotonically_increasing_id() % F.lit(1 << 32)).alias("seq"), F.lit("add").alias("op"))
    rows.write.parquet(place)
    return store.spark.read.schema(LOG).parquet(place).select("cacheId").distinct().count()
