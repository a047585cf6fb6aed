"""The query of each operator over the driver tables, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, jaccard, langid, lines, packing, pieces, syncmers, toxicity, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that go from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.summary(docs, lines.removed_lines(docs))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: number of pieces, a hash of the ids, and whether the text came back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded=True)
    same = F.col("decoded").eqNullSafe(F.translate("text", pieces.MARK, " "))
    return both.select("doc_id", F.size(F.coalesce("ids", F.array().cast("array<int>"))).alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.char_length("decoded").alias("n_chars_decoded"), same.alias("same"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, the field fitted on labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    field = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    tagged = toxicity.tag(docs.select("doc_id", "text"), field)
    return tagged.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, by the production rules."""
    return urls.url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, prototypes fitted on rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    names, prototypes = langid.fit(docs)
    found = langid.identify(docs.select("doc_id", "text"), names, prototypes)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return syncmers.edited_pairs(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as archives, then read the archives."""
    path = warc.archive_path(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).drop("stored_bytes")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_url_filters": op4_url_filters,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_embeddings": op7_embeddings,
    "op8_syncmer_fingerprints": op8_syncmer_fingerprints,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
}

ORACLES = {
    "op4_url_filters": """
        WITH u AS (
          SELECT page_id,
                 translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
          FROM pages),
        r AS (
          SELECT page_id, host, path, '.' || host AS h,
                 CASE WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                      WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                      WHEN '.' || host LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
                      WHEN '.' || host LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
                      WHEN '.' || host LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
          FROM u)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
                    WHEN rule IS NOT NULL THEN 'allow'
                    WHEN h LIKE '%.spam-farm.example.org' OR h LIKE '%.spam-farm.example.com' OR h LIKE '%.spam-farm.example.net' THEN 'block'
                    ELSE 'allow' END AS verdict
        FROM r
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
        FROM m
    """,
}
