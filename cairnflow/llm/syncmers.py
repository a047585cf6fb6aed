"""Document fingerprints by closed syncmers, with DataFrame functions only.

A text is a row of words (runs of other than white space; of more than 16 characters each one is a word, so scripts
without blanks have words too, and where these begin doesn't depend on what is before them). Of every run of K words, the smallest hash of an inner run of S words is sought; if it stands at the first or
the last place, the run is an anchor. Whether a run is one depends on its own words alone, so texts that share a passage
share its anchors, wherever it stands. Runs of SHORT words, chosen the same way by single words, are a second level for
texts of any length; marks of the start stand before the first word, so even one word is in a run. A fingerprint is the
row of the anchors' hashes of both levels; the likeness of two is the share of anchors that they have in common (Dice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 7, 2
SHORT = 3  #: words in a run of the second level
_START = -(1 << 63)  #: stands for a word before the first; no hash is smaller, so runs with it are always chosen
_WORD = "(?<!\\S)\\S{1,16}+(?!\\S)|\\S"


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S, positions: bool = False, short: bool = False) -> DataFrame:
    """``df`` with the anchors of column ``text`` in ``out``: hashes of 32 bits, or (position, hash) of each.

    A null or empty text has none. A text without any anchor (too short, or by chance) has one, the hash of all of it.
    ``short`` adds the anchors of the second level after these; they have no positions.
    """
    h, g = f"__{out}_h", f"__{out}_g"
    words = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_WORD), F.lit(0)), lambda w: F.xxhash64(w))
    df = df.select("*", words.alias(h))
    inner = F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*(F.get(h, i + d) for d in range(s)))))
    df = df.select("*", F.coalesce(inner, F.array().cast("array<bigint>")).alias(g))
    last = k - s

    def closed(i: Column) -> Column:
        rest = [F.get(g, i + d) for d in range(1, last)]
        return F.least(F.get(g, i), F.get(g, i + last)) <= (F.least(*rest) if len(rest) > 1 else rest[0])

    places = F.filter(F.sequence(F.lit(0), F.size(h) - k), closed)
    low = lambda x: F.shiftright(x, 32).cast("int")
    hashed = lambda i: low(F.xxhash64(F.slice(h, i + 1, k)))
    whole = F.when(F.length(F.coalesce(F.col(text), F.lit(""))) > 0, low(F.xxhash64(F.lit(1), text)))
    if positions:
        made = F.when(F.size(h) >= k, F.transform(places, lambda i: F.struct(i.alias("position"), hashed(i).alias("hash"))))
        one = F.array(F.struct(F.lit(0).alias("position"), whole.alias("hash")))
        none = F.array().cast("array<struct<position:int,hash:int>>")
    else:
        made = F.when(F.size(h) >= k, F.transform(places, hashed))
        one, none = F.array(whole), F.array().cast("array<int>")
    df = df.select("*", made.alias(out)).drop(g)
    df = df.withColumn(out, F.when(F.size(F.coalesce(out, none)) > 0, F.col(out)).when(whole.isNotNull(), one).otherwise(none))
    if short:
        df = df.select("*", F.concat(F.array_repeat(F.lit(_START), SHORT - 1), h).alias(g))
        ends = lambda i: F.least(F.get(g, i), F.get(g, i + SHORT - 1)) <= F.least(F.get(g, i), *(F.get(g, i + d) for d in range(1, SHORT - 1)))
        run = lambda i: low(F.xxhash64(F.lit(SHORT), *(F.get(g, i + d) for d in range(SHORT))))
        runs = F.when(F.size(h) > 0, F.transform(F.filter(F.sequence(F.lit(0), F.size(h) - 1), ends), run)).otherwise(none)
        df = df.withColumn(out, F.concat(out, runs)).drop(g)
    return df.drop(h)


def as_text(anchors: str) -> Column:
    """Anchors as one string: eight hex digits each."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.right(F.lower(F.hex(x)), F.lit(8)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Dice of two sets of anchors: 1 for two empty ones, 0 for one."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * both / total)


def with_next(docs: DataFrame, parts: int | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, next): each text and that of the next document by descending doc_id; after the last the first.

    Columns ``carried`` come along, and the next document's as ``next_`` and their name.

    Ids are cut in ranges (their bounds, at most ``parts``, are all that reaches the driver); a range is sorted in one
    task, and the last document of a range is also sent to the next one, so texts are shuffled once. Null texts
    count as empty; a null doc_id comes after all others; rows with an equal doc_id follow each other by their texts.
    """
    n = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"), *carried)
    ranges = rows.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("low").collect()
    lows, highs = [r.low for r in ranges], [r.high for r in ranges]
    if not lows:
        return rows.select("doc_id", "text", F.lit("").alias("next"), *carried, *(F.col(c).alias(f"next_{c}") for c in carried))
    literal = lambda values: F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")
    step = max(1, round(len(lows) ** 0.5))
    block = F.size(F.filter(literal(lows[::step]), lambda b: b <= F.col("key"))) - 1
    inside = F.size(F.filter(F.slice(literal(lows), block * step + 1, step), lambda b: b <= F.col("key"))) - 1
    rows = rows.withColumn("p", (block * step + inside).cast("int"))
    own = F.struct(F.col("p").alias("part"), F.lit(False).alias("ghost"))
    ghost = F.struct(((F.col("p") + 1) % len(lows)).cast("int").alias("part"), F.lit(True).alias("ghost"))
    spread = rows.select("doc_id", "text", "key", *carried, F.explode(F.when(F.col("key").isin(highs), F.array(own, ghost)).otherwise(F.array(own))).alias("x"))
    order = Window.partitionBy("part").orderBy(F.desc("ghost"), "key", "text")
    led = spread.select("doc_id", "text", "key", *carried, "x.*").select("*", F.lag("text").over(order).alias("next"), *(F.lag(c).over(order).alias(f"next_{c}") for c in carried))
    return led.where("not ghost").select("doc_id", "text", "next", *carried, *(f"next_{c}" for c in carried))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text: its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next text. A
    null text counts as empty: its fingerprint is empty too. Rows with an equal doc_id get a row each; one without a
    doc_id comes after all others. Other columns are ignored, whatever their names. An empty table gives no rows.
    A document's anchors are computed once and go to its neighbour with its text.
    """
    docs = with_anchors(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "text", "a", short=True)
    df = with_next(docs, carried=("a",)).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring("next", F.lit(1), half))
    df = df.withColumn("edited", edited)
    df = with_anchors(df, "edited", "b", short=True)
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("a").alias("fingerprint"),
        as_text("b").alias("edited_fingerprint"),
        likeness("a", "b").alias("near_edited"),
        likeness("a", "next_a").alias("near_next"),
    )
