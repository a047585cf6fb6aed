"""Set-similarity join on word shingles: size-aware, with heavy and light sets.

A text's set holds its distinct five-word shingles (as 64-bit hashes). Equal sets are taken once. Of two sets that
link, at Jaccard 0.8 or more, each shares at least four fifths of its own elements with the other. So

* small sets (up to a boundary) are light work: all their subsets of that size or larger are enumerated, and sets that
  link have such a subset in common, whatever else is in the corpus;
* large sets are found through inverted lists: elements are ordered by how common they are, the rarest first, and sets
  that link share one of the elements of their prefixes, one fifth of the set and one more.

The boundary is where enumerating costs more than scanning, from the mean length of a list in the corpus; sets near it
do both. Each list first gives only pairs of a member with the list's smallest id (per class of sizes). Pairs that a small
sketch of both sets cannot rule out are verified on the whole sets. What the verified pairs leave in different components is then compared with each other. So groups of near copies never give
all their pairs, and no link between components is lost.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import IdFilter, components, forget, kept, release, tidied, written

WORDS = 5
SHARE = (4, 5)  #: link where intersection * 5 >= union * 4
COMMON = 100_000  #: at most so many common shingles are told to executors; others count as rare, which costs only time
CHUNK = 1024
ROUNDS = 4  #: lists are made in so many parts, one after the other, which bounds the disk that their shuffles take
COUNTED = 2_000_000  #: shingles of so many texts' sets are counted together in a task; less than three there isn't common
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 250_000:
                self.clear()
            self[word] = value
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; of all words, if there are fewer; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(kept("words", _Words).__getitem__, found), dtype=np.uint64, count=len(found))
    run = min(words, len(found))
    factors = _FACTORS if words <= len(_FACTORS) else np.random.default_rng(words).integers(1, 2**63, words, dtype=np.uint64) | np.uint64(1)
    n = len(found) - run + 1
    total = np.full(n, run, dtype=np.uint64)
    for k in range(run):
        total += h[k : k + n] * factors[k]
    return np.unique(_mixed(total))


def least_overlap(n: int, share: tuple[int, int] = SHARE) -> int:
    return -(-share[0] * n // share[1])


def n_subsets(n: int, share: tuple[int, int] = SHARE) -> int:
    return sum(comb(n, d) for d in range(n - least_overlap(n, share) + 1))


def boundary(mean_list: float, share: tuple[int, int] = SHARE, most: int = 24) -> int:
    """The largest size up to which enumerating subsets costs no more than scanning the prefix's lists."""
    size = 0
    for n in range(1, most + 1):
        if n_subsets(n, share) > (n - least_overlap(n, share) + 1) * max(1.0, mean_list):
            break
        size = n
    return size


def signatures(s: np.ndarray, common: np.ndarray, counts: np.ndarray, bound: int, share: tuple[int, int] = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(what a set is found by, place of each in its order): hashes of its subsets if it is small (place 0), the rarest
    elements if it is large, both if near."""
    n = len(s)
    parts, places = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int32)]
    if not n:
        return parts[0], places[0]
    if n <= bound:
        salt = np.uint64(0xA0761D6478BD642F)
        every, h = int(_mixed(s * salt).sum(dtype=np.uint64)), _mixed(s * salt)
        sums = [every]
        for d in range(1, n - least_overlap(n, share) + 1):
            sums += [(every - int(h[list(out)].sum(dtype=np.uint64))) & 0xFFFFFFFFFFFFFFFF for out in combinations(range(n), d)]
        parts.append(_mixed(np.array(sums, dtype=np.uint64) ^ salt))
        places.append(np.zeros(len(sums), dtype=np.int32))
    if n > bound or share[1] * n >= share[0] * (bound + 1):
        prefix = n - least_overlap(n, share) + 1
        weight = np.zeros(n, dtype=np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            weight = np.where(common[at] == s, counts[at], 0)
        parts.append(s[np.lexsort((s, weight))[:prefix]] if weight.any() else s[:prefix])
        places.append(np.arange(prefix, dtype=np.int32))
    return np.concatenate(parts), np.concatenate(places)


def sketch(s: np.ndarray) -> bytes:
    """How many elements fall in each of some equal ranges of hashes (saturated at 255), about two in each; the number
    of ranges is a power of two, so that sketches of different lengths can be compared."""
    bits = min(16, max(6, (len(s) // 2).bit_length()))
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_link(u: np.ndarray, v: np.ndarray, n: int, share: tuple[int, int] = SHARE) -> bool:
    """Whether the overlap that two sketches allow, of sets with n elements together, is enough."""
    if (u == 255).any() or (v == 255).any():
        return True
    if len(u) > len(v):
        u, v = v, u
    most = int(np.minimum(u, v.reshape(len(u), -1).sum(axis=1)).sum())
    return share[1] * most >= share[0] * (n - most)


def _of_pairs(docs: DataFrame, pairs: DataFrame, make, words: int) -> DataFrame:
    """``make(set)`` (n and bytes) of the documents in ``pairs`` (x, y), and of some others, as a table (id, n, s)."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(some := IdFilter(ids, "doc_id"))

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(wanted.value.passes(b.column(2).to_numpy(), b.column(3).to_numpy())))
            for k in range(0, b.num_rows, CHUNK):
                part = b.slice(k, CHUNK)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([make(s) for s in sets], pa.binary())], names=["id", "n", "s"])

    return docs.select("doc_id", "text", *some.columns("doc_id")).mapInArrow(tidied(run), "id long, n long, s binary")


def _possible(docs: DataFrame, pairs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (x, y) whose sketches do not rule a link out, as a written table."""
    sketches = written(_of_pairs(docs, pairs, sketch, words), "sketches")
    side = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("s").alias(f"s_{c}"))

    def keep(batches):
        for b in batches:
            n = b.column(2).to_numpy() + b.column(4).to_numpy()
            ok = [may_link(np.frombuffer(u.as_buffer(), dtype=np.uint8), np.frombuffer(v.as_buffer(), dtype=np.uint8), k, share) for u, v, k in zip(b.column(3), b.column(5), n.tolist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], names=["x", "y"])

    wide = pairs.join(side("y"), "y").join(side("x"), "x").select("x", "y", "n_x", "s_x", "n_y", "s_y")
    found = written(wide.mapInArrow(tidied(keep), "x long, y long").distinct(), "possible")
    forget(docs.sparkSession, sketches)
    return found


def _survey(docs: DataFrame, words: int) -> DataFrame:
    """One pass over all texts: a row (doc_id, n, digest) for each, and (shingle, count) for what is common in a part."""

    names = ["doc_id", "n", "digest", "shingle", "count", "total"]

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        every, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= 3
        m = int(often.sum()) + 1
        none = pa.nulls(m, pa.int64())
        count, total = np.append(counts[often], 0), np.append(np.zeros(m - 1, np.int64), len(every))
        return pa.RecordBatch.from_arrays([none, none, pa.nulls(m, pa.binary()), pa.array(np.append(every[often].view(np.int64), 0)), pa.array(count), pa.array(total)], names=names)

    def run(batches):
        held: dict[bytes, np.ndarray] = {}
        size = 0
        for b in batches:
            for k in range(0, b.num_rows, CHUNK):
                part = b.slice(k, CHUNK)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), none, none, none], names=names)
                held |= zip(digests, sets)
                size += sum(map(len, sets))
                if size > COUNTED:
                    yield counted(list(held.values()))
                    held, size = {}, 0
        if held:
            yield counted(list(held.values()))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), "doc_id long, n long, digest binary, shingle long, count long, total long")


def _verified(docs: DataFrame, pairs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (x, y) whose sets link, as a written table (a, b)."""
    found = written(_of_pairs(docs, pairs, np.ndarray.tobytes, words), "sets")

    def check(batches):
        for b in batches:
            keep = []
            for s, t in zip(b.column(2), b.column(3)):
                u, v = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (s, t))
                at = np.minimum(np.searchsorted(v, u), len(v) - 1) if len(v) else np.zeros(len(u), int)
                both = int((v[at] == u).sum()) if len(v) else 0
                keep.append(both > 0 and share[1] * both >= share[0] * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (b.column(0), b.column(1))], names=["a", "b"])

    left = pairs.join(found.select(F.col("id").alias("y"), F.col("s").alias("t")), "y")
    wide = left.join(found.select(F.col("id").alias("x"), "s"), "x").select("x", "y", "s", "t")
    out = written(wide.mapInArrow(tidied(check), "a long, b long"), "edges")
    forget(docs.sparkSession, found)
    return out


def similarity_classes(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach, the document's own included. A null or empty text, or one
    of white space, has no shingles and links with nothing. Rows with an equal doc_id are one node, and any of their
    texts links it; equal rows get equal results. A null doc_id links with nothing and has no component. Other
    columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    survey = written(_survey(docs, words), "survey")
    narrow = survey.where("shingle is null").select("doc_id", "n", "digest")
    some = narrow.where("n > 0 and doc_id is not null")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classed = written(some.join(classes, "digest").select("doc_id", "digest", "n", "rep"), "classed")
    # documents that another one stands for; an id with several texts stays if any of them stands for itself
    copies = written(classed.where("doc_id <> rep").select("doc_id").distinct().join(classed.where("doc_id = rep").select("doc_id"), "doc_id", "left_anti"), "copies")
    singles = docs.where("doc_id is not null").join(copies, "doc_id", "left_anti")

    heavy = survey.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("c")).where("c > 0").orderBy(F.desc("c"), "shingle").limit(COMMON)
    listed = np.array([(r.shingle, r.c) for r in heavy.collect()], dtype=np.int64).reshape(-1, 2)  # at most COMMON rows
    shingle = listed[:, 0].view(np.uint64)
    order = np.argsort(shingle)
    common, counts = np.ascontiguousarray(shingle[order]), np.ascontiguousarray(listed[order, 1])
    total = survey.agg(F.sum("total")).first()[0] or 1
    bound = boundary(1 + float((counts.astype(float) ** 2).sum()) / total, share)
    told = spark.sparkContext.broadcast((common, counts))

    def sign(batches):
        common, counts = told.value
        for b in batches:
            for k in range(0, b.num_rows, CHUNK):
                part = b.slice(k, CHUNK)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                made = [signatures(s, common, counts, bound, share) for s in sets]
                ends = pa.array(np.cumsum([0, *(len(x) for x, _ in made)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x for x, _ in made]).view(np.int64)))
                places = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([y for _, y in made])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int32()), lists, places], names=["id", "n", "sigs", "places"])

    signed = written(singles.mapInArrow(tidied(sign), "id long, n int, sigs array<long>, places array<int>").where("n > 0"), "signed")
    size_class = F.floor(F.log(F.col("n").cast("double")) / np.log(share[1] / share[0])).cast("int")
    rows = signed.select("id", "n", F.explode(F.arrays_zip("sigs", "places")).alias("x")).select("id", "n", F.col("x.sigs").alias("sig"), F.col("x.places").alias("i"))
    # lists with more than one member: narrow rows, combined before they are shuffled, some lists at a time
    parts = []
    for k in range(ROUNDS):
        some_rows = rows.where(F.pmod("sig", F.lit(ROUNDS)) == k)
        lists = some_rows.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig")
        parts.append(written(some_rows.join(lists, "sig", "left_semi"), "lists"))
        release(spark)
    shared_rows = reduce(DataFrame.union, parts)

    def near(n, m, i, j):
        """Sizes allow a link; and so do the places, if this is the first element that both have: all that they share
        comes after it. Sets that link pass in the list of their first shared element."""
        return (F.least(n, m) * share[1] >= F.greatest(n, m) * share[0]) & (F.least(n - i, m - j) * (share[0] + share[1]) >= share[0] * (n + m))

    leaders = shared_rows.groupBy("sig", size_class.alias("k")).agg(F.min(F.struct("id", "n", "i")).alias("l"))
    first = shared_rows.withColumn("k", size_class).join(leaders, ["sig", "k"]).where((F.col("id") > F.col("l.id")) & near(F.col("n"), F.col("l.n"), F.col("i"), F.col("l.i")))
    pairs = written(first.select(F.col("l.id").alias("x"), F.col("id").alias("y")).distinct(), "pairs")
    release(spark)
    edges = _verified(docs, _possible(docs, pairs, words, share), words, share)
    forget(spark, pairs)
    release(spark)

    # what is in one list but in different components so far
    joined = components(edges)
    marked = shared_rows.join(joined.withColumnRenamed("id", "m"), F.col("id") == F.col("m"), "left").select("sig", "id", "n", "i", F.coalesce("component", "id").alias("c"))
    marked = written(marked, "marked")
    mixed = marked.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("sig")
    left = marked.join(mixed, "sig", "left_semi")
    other = left.select("sig", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("c").alias("c2"))
    second = left.join(other, "sig").where((F.col("c") < F.col("c2")) & near(F.col("n"), F.col("n2"), F.col("i"), F.col("i2")))
    again = written(second.select(F.least("id", "id2").alias("x"), F.greatest("id", "id2").alias("y")).distinct(), "pairs")
    release(spark)
    more = _verified(docs, _possible(docs, again, words, share), words, share)
    release(spark)
    # an id with several texts links the classes of all of them
    several = classed.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("doc_id")
    same_id = classed.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    members = components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more).union(same_id))

    out = narrow.join(classes, "digest", "left").join(members.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    result = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    for table in (*parts, signed, edges, again, more, joined, marked, copies):
        forget(spark, table)
    return result
