"""Near-duplicate embeddings by lattice hashing.

In each of several tables a vector is projected at random to eight dimensions and decoded to the nearest point of the
E8 lattice, its cell. A vector is held in its own cell and looks for others there and in the neighbouring cells
nearest to it. Vectors that meet in a cell are compared by cosine in double precision; only such of at least the
threshold link. Cells that hold many vectors are cut in blocks, and pairs of blocks are compared in tasks of their
own; a cell gives a spanning forest of its links, never all pairs. Links are then counted exactly, block by block,
inside each component.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_group, components, forget, written

TABLES = 4
PROBES = 8
CELL = 0.5  #: size of a lattice cell, for unit vectors
THRESHOLD = 0.9
BLOCK = 2048  #: rows in a block of a cell or component


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: the nearer of the nearest points of D8 and of D8 shifted by one half."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        error = y - r
        rows = np.nonzero(r.sum(axis=1) % 2)[0]
        worst = np.abs(error[rows]).argmax(axis=1)
        r[rows, worst] += np.where(error[rows, worst] >= 0, 1, -1)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for (i, j), (s, t) in product(combinations(range(8), 2), product((1, -1), repeat=2)):
        v = np.zeros(8)
        v[i], v[j] = s, t
        found.append(v)
    found += [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(found)


@cache
def projection(dimensions: int, table: int) -> np.ndarray:
    """Orthonormal random directions, scaled so that distances keep their size on average, in cells."""
    d = max(8, dimensions)
    q = np.linalg.qr(np.random.default_rng([table, d]).normal(size=(d, 8)))[0][:dimensions]
    return q * np.sqrt(d / 8) / CELL


def cells(unit: np.ndarray, tables: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of cells [rows, tables, 1 + probes], the first of each its own cell)."""
    out = np.empty((len(unit), tables, 1 + probes), dtype=np.int64)
    around = neighbours()
    for t in range(tables):
        x = unit @ projection(unit.shape[1], t)
        own = decode_e8(x)
        near = np.argpartition(-((x - own) @ around.T), probes - 1, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), int)
        every = np.concatenate([own[:, None, :], own[:, None, :] + around[near]], axis=1)
        whole = np.rint(2 * every).astype(np.int16).reshape(-1, 8)
        points, place = np.unique(whole, axis=0, return_inverse=True)
        ids = np.array([xxhash.xxh3_64_intdigest(p.tobytes(), seed=t * 4096 + unit.shape[1]) for p in points], dtype=np.uint64).view(np.int64)
        out[:, t, :] = ids[place.reshape(len(x), -1)]
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows from binary vectors of one length."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v as packed doubles) of vectors that can link: one for each vec_id (of several, the smallest)."""
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").where(ok).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def pack(batches):
        for b in batches:
            values = b.column(1)
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            # scaled by the largest component: squares of tiny or huge vectors stay in range
            ends = np.cumsum([len(v) for v in values]).tolist()
            rows = [flat[a:z] for a, z in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(r / np.abs(r).max()).tobytes() for r in rows], pa.binary())], names=["vec_id", "v"])

    return rows.mapInArrow(pack, "vec_id long, v binary")


def _forest(ids: np.ndarray, owns: np.ndarray, linked: np.ndarray) -> tuple[list, list]:
    """Edges that span the components of rows and own rows, where ``linked`` [rows, own rows]."""
    where = np.nonzero(owns)[0]
    label = np.arange(len(ids))
    some = linked.any(axis=1)
    while True:
        before = label.copy()
        column = np.where(linked, label[:, None], len(ids)).min(axis=0)  # smallest label among each own row's links
        label[where] = np.minimum(label[where], column)
        row = np.where(linked, label[where][None, :], len(ids)).min(axis=1)
        label = np.where(some, np.minimum(label, row), label)
        if (label == before).all():
            break
    far = np.nonzero(label != np.arange(len(ids)))[0]
    return ids[far].tolist(), ids[label[far]].tolist()


def near_links(packed: DataFrame, threshold: float, tables: int, probes: int, block: int) -> DataFrame:
    """Edges (a, b) that connect what links: found in cells, a spanning forest of each block."""

    def hash_rows(batches):
        for b in batches:
            lengths = np.array([len(v.as_py()) for v in b.column(1)])
            for length in np.unique(lengths):
                rows = pa.array(np.nonzero(lengths == length)[0])
                part = b.take(rows)
                for k in range(0, part.num_rows, 4096):
                    some = part.slice(k, 4096)
                    found = cells(_matrix(some.column(1)), tables, probes)
                    each = tables * (1 + probes)
                    own = np.zeros((some.num_rows, tables, 1 + probes), dtype=bool)
                    own[:, :, 0] = True
                    ids = np.repeat(some.column(0).to_numpy(zero_copy_only=False), each)
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(own.ravel()), pa.array(ids, pa.int64())], names=["cell", "own", "vec_id"])

    hashed = written(packed.mapInArrow(hash_rows, "cell long, own boolean, vec_id long"), "cells")
    counts = hashed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("n_own")).where("n > 1 and n_own > 0")
    counts = counts.select("cell", F.ceil(F.col("n_own") / block).cast("int").alias("own_blocks"), F.ceil(F.col("n") / block).cast("int").alias("all_blocks"))
    # An own row is held in one of the cell's blocks; every row is tried (in one of its blocks) on all of those.
    spot = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    tried = F.transform(F.sequence(F.lit(0), F.col("own_blocks") - 1), lambda o: F.struct(o.alias("o"), spot("all_blocks").alias("q"), F.lit(False).alias("held")))
    held = F.transform(F.sequence(F.lit(0), F.col("all_blocks") - 1), lambda q: F.struct(spot("own_blocks").alias("o"), q.alias("q"), F.lit(True).alias("held")))
    dealt = hashed.join(counts, "cell").select("cell", "vec_id", F.explode(F.when(F.col("own"), F.concat(tried, held)).otherwise(tried)).alias("x"))
    rows = dealt.select("cell", "x.o", "x.q", "x.held", "vec_id").join(packed, "vec_id")

    def make():
        def call(group):
            held = group.column("held").to_numpy()
            if group.num_rows < 2 or not held.any():
                return None
            ids, x = group.column("vec_id").to_numpy(), _matrix(group.column("v"))
            asks = np.nonzero(~held)[0]
            if not len(asks):
                return None
            linked = x[asks] @ x[held].T >= threshold
            linked &= ids[asks][:, None] != ids[held][None, :]
            if not linked.any():
                return None
            # one row for each vector: those that ask, and held ones that another block asks for
            unique, place = np.unique(ids, return_inverse=True)
            full = np.zeros((len(unique), int(held.sum())), dtype=bool)
            full[place[asks]] = linked
            owns = place[held]
            full[owns, np.arange(len(owns))] = True
            order = np.argsort(owns)
            mark = np.zeros(len(unique), dtype=bool)
            mark[owns] = True
            return _forest(unique, mark, full[:, order])

        return call

    edges = written(by_group(rows, ["cell", "o", "q"], make, "a long, b long").distinct(), "links")
    forget(hashed.sparkSession, hashed)
    return edges


def link_counts(packed: DataFrame, members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(vec_id, n_links): all links inside each component of ``members`` (id, component), block against block."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = members.join(sizes, "component").join(packed, F.col("id") == F.col("vec_id")).select("component", "vec_id", "v", "blocks", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("own"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = rows.select("component", "vec_id", "v", "own", others).select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "vec_id", "v")

    def make():
        def call(group):
            ids, m, own = group.column("vec_id").to_numpy(), _matrix(group.column("v")), group.column("own").to_numpy()
            x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
            if x == y:
                linked = m @ m.T >= threshold
                np.fill_diagonal(linked, False)
                return ids.tolist(), linked.sum(axis=1).tolist()
            a, b = own == x, own == y
            linked = m[a] @ m[b].T >= threshold
            return [*ids[a].tolist(), *ids[b].tolist()], [*linked.sum(axis=1).tolist(), *linked.sum(axis=0).tolist()]

        return call

    return by_group(dealt, ["component", "x", "y"], make, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n_links"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, zero, empty or hold null or non-finite components link with nothing; so do those of
    different lengths with each other. Rows with an equal vec_id are one vector (the smallest of them) and get equal
    results; a null vec_id has no component and is not kept. Other columns are ignored.
    """
    spark = vectors.sparkSession
    packed = written(usable(vectors), "vectors")
    edges = near_links(packed, threshold, tables, probes, block)
    members = components(edges)
    counts = link_counts(packed, members, threshold, block)
    found = written(members.join(counts, F.col("id") == F.col("vec_id"), "left").select(F.col("id"), "component", "n_links"), "found")
    for table in (packed, edges, members):
        forget(spark, table)
    out = vectors.select(F.col("vec_id").cast("long")).join(found, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
