"""The queries over the driver tables and their SQL.

The tables stand in for the engine's own: tags are made of orders, manifests of documents, a grid of parts, points of
customers, a log of events, paths of page addresses.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions import projections as pr
from cairnflow.functions import scalars as sc
from cairnflow.operators import grid as g
from cairnflow.operators import manifest as m
from cairnflow.operators import tags as t
from cairnflow.operators import vector as v
from cairnflow.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return put


# Stand-in relations, and the same in SQL

TAGS_SQL = """tags AS (
  SELECT md5(CAST(o_orderkey AS VARCHAR)) AS cacheId, 'function' AS tagKey, o_orderpriority AS tagValue, o_orderdate AS createdDate FROM orders
  UNION ALL SELECT md5(CAST(o_orderkey AS VARCHAR)), 'class', o_orderstatus, o_orderdate FROM orders
  UNION ALL SELECT md5(CAST(o_orderkey AS VARCHAR)), 'userTag', 'cust' || CAST(o_custkey % 50 AS VARCHAR), o_orderdate FROM orders)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cacheId, tagKey, tagValue, createdDate): one scan of orders, three rows for each."""
    o = table(spark, sf_dir, "orders")
    user = F.concat(F.lit("cust"), (F.col("o_custkey") % 50).cast("string"))
    rows = F.array(*(F.struct(F.lit(k).alias("tagKey"), c.alias("tagValue")) for k, c in (("function", F.col("o_orderpriority")), ("class", F.col("o_orderstatus")), ("userTag", user))))
    wide = o.select(F.md5(F.col("o_orderkey").cast("string")).alias("cacheId"), F.explode(rows).alias("r"), F.col("o_orderdate").alias("createdDate"))
    return wide.select("cacheId", "r.tagKey", "r.tagValue", "createdDate")


MANIFEST_SQL = """expected AS (
  SELECT CAST(doc_id AS VARCHAR) AS file, md5(text) AS checksum, CAST(n_chars AS VARCHAR) AS filesize, 'md5' AS algorithm FROM documents),
measured AS (
  SELECT CAST(doc_id AS VARCHAR) AS file, md5(CASE WHEN doc_id % 11 = 0 THEN text || 'x' ELSE text END) AS checksum,
         CAST(CASE WHEN doc_id % 11 = 0 THEN n_chars + 1 ELSE n_chars END AS VARCHAR) AS filesize, 'md5' AS algorithm
  FROM documents WHERE doc_id % 7 <> 0)"""

COMPARED_SQL = (
    MANIFEST_SQL
    + """, compared AS (
  SELECT CASE WHEN m.file IS NULL THEN NULL WHEN e.checksum = m.checksum THEN 'OK' ELSE 'FAIL' END AS result,
         e.file AS expectedFile, m.file AS actualFile, e.checksum AS checksum_x, m.checksum AS checksum_y,
         e.algorithm AS algorithm_x, m.algorithm AS algorithm_y, e.filesize AS filesize_x, m.filesize AS filesize_y
  FROM expected e LEFT JOIN measured m ON e.file = m.file)"""
)


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    file, algorithm = F.col("doc_id").cast("string").alias("file"), F.lit("md5").alias("algorithm")
    expected = d.select(file, F.md5("text").alias("checksum"), F.col("n_chars").cast("string").alias("filesize"), algorithm)
    odd = F.col("doc_id") % 11 == 0
    text = F.when(odd, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    size = F.when(odd, F.col("n_chars") + 1).otherwise(F.col("n_chars")).cast("string")
    measured = d.where("doc_id % 7 <> 0").select(file, F.md5(text).alias("checksum"), size.alias("filesize"), algorithm)
    return expected, measured


GRID_SQL = """cells AS (
  SELECT 0 AS layer, CAST(p_partkey // 20 AS INTEGER) AS "row", CAST(p_partkey % 20 AS INTEGER) AS col, p_retailprice AS value, p_size FROM part)"""


def grid_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, g.Grid]:
    """Cells of one layer, 20 columns wide; y grows to the south, so the extent is turned: a row's centre is -row - 0.5."""
    p = table(spark, sf_dir, "part")
    cells = g.from_table(p, 0, F.floor(F.col("p_partkey") / 20), F.col("p_partkey") % 20, F.col("p_retailprice"))
    return cells, g.Grid(100, 20, g.Extent(0, 20, -100, 0), pr.WebMercator(), names=("price",))


def mask_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    value = F.when(F.col("p_size") > 25, F.col("p_size").cast("double"))
    return g.from_table(p, 0, F.floor(F.col("p_partkey") / 20), F.col("p_partkey") % 20, value)


RING = [(2.0, -2.0), (15.0, -5.0), (12.0, -40.0), (4.0, -30.0)]

INSIDE_SQL = """edges(x1, y1, x2, y2) AS (VALUES (2e0,-2e0,15e0,-5e0),(15e0,-5e0,12e0,-40e0),(12e0,-40e0,4e0,-30e0),(4e0,-30e0,2e0,-2e0)),
inside AS (
  SELECT c."row", c.col FROM (SELECT "row", col, col + 0.5e0 AS x, -("row" + 0.5e0) AS y FROM cells) c, edges e
  WHERE (e.y1 > c.y) <> (e.y2 > c.y) AND c.x < e.x1 + (c.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
  GROUP BY c."row", c.col HAVING count(*) % 2 = 1)"""


# Searches of the tag table


@query(f"WITH {TAGS_SQL} SELECT tagKey, count(*) AS n, count(DISTINCT tagValue) AS n_values FROM tags GROUP BY tagKey")
def tags_eav_summary(spark, d):
    return tags(spark, d).groupBy("tagKey").agg(F.count("*").alias("n"), F.countDistinct("tagValue").alias("n_values"))


_ALL = "SELECT cacheId, tagKey, tagValue, createdDate FROM tags WHERE cacheId IN"


@query(f"""WITH {TAGS_SQL} {_ALL} (SELECT cacheId FROM tags GROUP BY cacheId
  HAVING bool_or(regexp_matches(tagValue, '^1-URG') OR regexp_matches(tagKey, '^1-URG') OR regexp_matches(cacheId, '^1-URG'))
     AND bool_or(regexp_matches(tagValue, '^cust7$') OR regexp_matches(tagKey, '^cust7$') OR regexp_matches(cacheId, '^cust7$')))""")
def tags_show_and(spark, d):
    """Two patterns, both of which an entry must match."""
    return t.show(tags(spark, d), user_tags=["^1-URG", "^cust7$"])


@query(f"WITH {TAGS_SQL} {_ALL} (SELECT cacheId FROM tags WHERE tagValue IN ('cust7', 'F') OR tagKey IN ('cust7', 'F'))")
def tags_show_exact_any(spark, d):
    return t.show(tags(spark, d), user_tags=["cust7", "F"], match="any_exact")


@query(f"WITH {TAGS_SQL} {_ALL} (SELECT cacheId FROM tags WHERE regexp_matches(tagValue, '^cust7$|^cust8$'))")
def tags_show_or(spark, d):
    """One pattern with alternatives."""
    return t.show(tags(spark, d), user_tags=["^cust7$|^cust8$"])


@query(f"WITH {TAGS_SQL} {_ALL} (SELECT cacheId FROM tags WHERE tagKey = 'function' AND tagValue IN ('1-URGENT', '2-HIGH'))")
def tags_show_fun(spark, d):
    return t.show(tags(spark, d), function=["1-URGENT", "2-HIGH"])


@query(f"""WITH {TAGS_SQL} {_ALL} (SELECT cacheId FROM tags GROUP BY cacheId
  HAVING bool_or(tagKey = 'class' AND tagValue = 'O') AND bool_or(tagKey = 'userTag' AND tagValue = 'cust3'))""")
def tags_show_keyval(spark, d):
    return t.show(tags(spark, d), **{"class": "O", "userTag": "cust3"})


@query(f"WITH {TAGS_SQL} SELECT * FROM tags WHERE cacheId = md5('1')")
def tags_show_id(spark, d):
    from hashlib import md5

    return t.show_one(tags(spark, d), md5(b"1").hexdigest())


@query(f"WITH {TAGS_SQL} {_ALL} (SELECT cacheId FROM tags WHERE createdDate >= TIMESTAMP '1995-01-01' AND createdDate <= TIMESTAMP '1996-12-31')")
def tags_show_between(spark, d):
    return t.show(tags(spark, d), after="1995-01-01 00:00:00", before="1996-12-31 00:00:00", time_of="createdDate")


_WANTED = "wanted(tagKey, tagValue) AS (VALUES ('function', '3-MEDIUM'), ('class', 'P'), ('userTag', 'cust11'))"


def _wanted(spark):
    return spark.createDataFrame([("function", "3-MEDIUM"), ("class", "P"), ("userTag", "cust11")], "tagKey string, tagValue string")


_COUNTS = "counts AS (SELECT cacheId, count(*) AS n_shared FROM (SELECT DISTINCT cacheId, tagKey, tagValue FROM tags) x JOIN wanted USING (tagKey, tagValue) GROUP BY cacheId)"


@query(f"WITH {TAGS_SQL}, {_WANTED}, {_COUNTS} SELECT cacheId, n_shared FROM counts WHERE n_shared = (SELECT max(n_shared) FROM counts)")
def tags_similar(spark, d):
    return t.most_similar(tags(spark, d), _wanted(spark))


@query(f"""WITH {TAGS_SQL}, {_WANTED}, s AS (SELECT tagKey, tagValue FROM tags WHERE cacheId = md5('1'))
SELECT w.tagKey, w.tagValue, CASE WHEN s.tagKey IS NULL THEN 'missing' WHEN s.tagValue = w.tagValue THEN 'same' ELSE 'other' END AS status
FROM wanted w LEFT JOIN s ON w.tagKey = s.tagKey""")
def tags_similar_diff(spark, d):
    from hashlib import md5

    return t.differences(_wanted(spark), tags(spark, d), md5(b"1").hexdigest())


@query(f"""WITH {TAGS_SQL}, {_WANTED}, {_COUNTS}, c AS (SELECT cacheId FROM counts WHERE n_shared = (SELECT max(n_shared) FROM counts)),
  a AS (SELECT cacheId, max(createdDate) AS latest FROM tags WHERE cacheId IN (SELECT cacheId FROM c) GROUP BY cacheId),
  r AS (SELECT *, row_number() OVER (ORDER BY latest DESC, cacheId) AS k FROM a)
SELECT cacheId, latest FROM r WHERE k = 2""")
def tags_similar_nth_latest(spark, d):
    tg = tags(spark, d)
    return t.nth_latest(t.most_similar(tg, _wanted(spark)), tg, 2)


@query(f"WITH {TAGS_SQL} SELECT tagKey, count(*) AS n FROM tags WHERE cacheId IN (SELECT cacheId FROM tags WHERE regexp_matches(tagValue, '^cust1[0-9]$')) GROUP BY tagKey")
def tags_keep(spark, d):
    return t.keep(tags(spark, d), user_tags=["^cust1[0-9]$"]).groupBy("tagKey").agg(F.count("*").alias("n"))


@query(f"WITH {TAGS_SQL} SELECT tagKey, count(*) AS n FROM tags WHERE cacheId NOT IN (SELECT cacheId FROM tags WHERE tagKey = 'function' AND tagValue = '1-URGENT') GROUP BY tagKey")
def tags_clear(spark, d):
    return t.clear(tags(spark, d), function=["1-URGENT"]).groupBy("tagKey").agg(F.count("*").alias("n"))


@query(f"WITH {TAGS_SQL} SELECT * FROM tags WHERE cacheId = (SELECT cacheId FROM tags ORDER BY createdDate DESC, cacheId DESC LIMIT 1)")
def tags_latest_entry(spark, d):
    return t.latest_entry(tags(spark, d))


@query(f"""WITH {TAGS_SQL}, into_ AS (SELECT * FROM tags WHERE cacheId IN (SELECT cacheId FROM tags WHERE tagKey = 'class' AND tagValue = 'O')),
  other AS (SELECT * FROM tags WHERE cacheId IN (SELECT cacheId FROM tags WHERE tagKey = 'function' AND tagValue = '2-HIGH')),
  merged AS (SELECT * FROM into_ UNION ALL SELECT * FROM other WHERE cacheId NOT IN (SELECT cacheId FROM into_))
SELECT tagKey, count(*) AS n, count(DISTINCT cacheId) AS n_entries FROM merged GROUP BY tagKey""")
def tags_merge(spark, d):
    tg = tags(spark, d)
    merged = t.merge(t.show(tg, **{"class": "O"}), t.show(tg, function=["2-HIGH"]))
    return merged.groupBy("tagKey").agg(F.count("*").alias("n"), F.countDistinct("cacheId").alias("n_entries"))


@query("""SELECT user_id AS cacheId, max_by(event_type, struct_pack(ts := ts, event_id := event_id)) AS tagValue, max(ts) AS updated FROM events GROUP BY user_id""")
def tags_upsert(spark, d):
    """The latest row of a log for each key."""
    e = table(spark, d, "events")
    log = e.select(F.col("user_id").alias("cacheId"), F.lit("kind").alias("tagKey"), F.col("event_type").alias("tagValue"), F.col("ts").alias("createdDate"), F.struct("ts", "event_id").alias("seq"))
    return t.latest_values(log, ["kind"], "seq").select("cacheId", "tagValue", F.col("createdDate").alias("updated"))


@query("WITH h AS (SELECT doc_id, md5(text) AS resultHash FROM documents), f AS (SELECT resultHash, min(doc_id) AS objectId FROM h GROUP BY resultHash) SELECT doc_id, resultHash, objectId FROM h JOIN f USING (resultHash)")
def tags_dedup_objects(spark, d):
    h = table(spark, d, "documents").select("doc_id", F.md5("text").alias("resultHash"))
    return t.representatives(h, "doc_id", "resultHash")


@query(f"""WITH {TAGS_SQL} SELECT cacheId, max(CASE WHEN tagKey = 'function' THEN tagValue END) AS function, max(CASE WHEN tagKey = 'class' THEN tagValue END) AS class,
  max(CASE WHEN tagKey = 'userTag' THEN tagValue END) AS userTag FROM tags GROUP BY cacheId""")
def tags_pivot(spark, d):
    return t.pivoted(tags(spark, d), ["function", "class", "userTag"])


@query(f"""WITH {TAGS_SQL}, {_WANTED}, {_COUNTS} SELECT cacheId FROM counts WHERE n_shared = 3""")
def tags_devmode_unique(spark, d):
    return t.carries_all(tags(spark, d), _wanted(spark))


@query(f"WITH {TAGS_SQL} SELECT cacheId, coalesce(max(CASE WHEN tagKey = 'class' THEN tagValue END), 'none') AS value FROM tags GROUP BY cacheId")
def tags_extract(spark, d):
    return t.values_of(tags(spark, d), "class", "none")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, 'priority' AS argument, md5(o_orderpriority) AS hash FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'status', md5(o_orderstatus) FROM orders""")
def tags_unpivot(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.md5("o_orderpriority").alias("priority"), F.md5("o_orderstatus").alias("status"))
    return t.unpivot_hashes(o, ["id"])


@query("""SELECT o_orderkey, CASE WHEN strpos(s, ':') > 0 THEN split_part(s, ':', 1) ELSE 'userTags' END AS tagKey,
  CASE WHEN strpos(s, ':') > 0 THEN substr(s, strpos(s, ':') + 1) ELSE s END AS tagValue
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'k' || CAST(o_orderkey % 5 AS VARCHAR) || ':' || o_orderpriority || ':z' END AS s FROM orders)""")
def tags_parse(spark, d):
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(F.concat(F.lit("k"), (F.col("o_orderkey") % 5).cast("string"), F.lit(":"), "o_orderpriority", F.lit(":z")))
    return o.select("o_orderkey", t.parse_column(text).alias("p")).select("o_orderkey", "p.*")


# Manifests


@query(f"WITH {COMPARED_SQL} SELECT * FROM compared")
def manifest_compare(spark, d):
    return m.compare(*manifests(spark, d))


@query(f"""WITH {MANIFEST_SQL} SELECT CASE WHEN m.file IS NULL THEN NULL WHEN e.filesize = m.filesize THEN 'OK' ELSE 'FAIL' END AS result, count(*) AS n
FROM expected e LEFT JOIN measured m ON e.file = m.file GROUP BY 1""")
def manifest_quick(spark, d):
    return m.summary(m.compare(*manifests(spark, d), quick=True))


@query(f"WITH {MANIFEST_SQL} SELECT file, checksum, filesize, algorithm FROM measured UNION ALL SELECT file, checksum, filesize, algorithm FROM expected WHERE file NOT IN (SELECT file FROM measured)")
def manifest_append(spark, d):
    return m.upsert(*manifests(spark, d))


@query(f"WITH {MANIFEST_SQL} SELECT file, checksum, filesize, algorithm FROM expected e WHERE NOT EXISTS (SELECT 1 FROM measured m WHERE m.file = e.file AND m.checksum = e.checksum)")
def manifest_not_in(spark, d):
    return m.not_in(*manifests(spark, d)).select(*m.COLUMNS)


@query(f"WITH {COMPARED_SQL} SELECT CAST(doc_id AS VARCHAR) AS file FROM documents WHERE doc_id % 2 = 0 AND CAST(doc_id AS VARCHAR) NOT IN (SELECT expectedFile FROM compared WHERE result = 'OK')")
def manifest_missing(spark, d):
    needed = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("file"))
    return m.missing(needed, m.compare(*manifests(spark, d)))


@query(f"WITH {COMPARED_SQL} SELECT CAST(doc_id AS VARCHAR) AS file FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT expectedFile FROM compared WHERE result = 'OK')")
def manifest_missing_all(spark, d):
    """The same for all documents."""
    needed = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"))
    return m.missing(needed, m.compare(*manifests(spark, d)))


@query(f"""WITH {MANIFEST_SQL} SELECT m.file, m.checksum, m.filesize, m.algorithm, CASE WHEN e.file IS NOT NULL THEN 'known' END AS note FROM measured m
LEFT JOIN (SELECT DISTINCT file, checksum, filesize, algorithm FROM expected) e
ON m.file IS NOT DISTINCT FROM e.file AND m.checksum IS NOT DISTINCT FROM e.checksum AND m.filesize IS NOT DISTINCT FROM e.filesize AND m.algorithm IS NOT DISTINCT FROM e.algorithm""")
def manifest_saved(spark, d):
    expected, measured = manifests(spark, d)
    return m.with_saved(measured.select(*m.COLUMNS), expected.select(*m.COLUMNS, F.lit("known").alias("note")))


@query(f"""WITH {COMPARED_SQL} SELECT CAST(doc_id AS VARCHAR) AS file, CAST(doc_id AS VARCHAR) IN (SELECT expectedFile FROM compared WHERE result = 'OK') AS ok FROM documents""")
def manifest_needed_ok(spark, d):
    needed = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"))
    return m.needed_ok(needed, m.compare(*manifests(spark, d)))


@query(f"WITH {MANIFEST_SQL} SELECT file, checksum, filesize, algorithm FROM expected WHERE file NOT IN ('1', '2', '3')")
def manifest_purge(spark, d):
    return m.purge(manifests(spark, d)[0], 7, target=["1"], archive=["2"], also=["3"])


@query(f"""WITH {MANIFEST_SQL}, roles(file, role) AS (VALUES ('1', 'target'), ('2', 'archive'), ('3', 'also'), ('4', 'url')),
dropped(level, role) AS (VALUES (2, 'target'), (3, 'archive'), (4, 'also'), (5, 'target'), (5, 'also'), (6, 'target'), (6, 'also'), (6, 'archive'), (7, 'target'), (7, 'also'), (7, 'archive'), (7, 'url'))
SELECT CAST(l.level AS INTEGER) AS level, e.file FROM expected e, range(8) l(level)
WHERE l.level <> 1 AND e.file NOT IN (SELECT r.file FROM dropped x JOIN roles r ON r.role = x.role WHERE x.level = l.level)""")
def manifest_purge_levels(spark, d):
    """What each level of a purge leaves."""
    rows = manifests(spark, d)[0]
    left = [m.purge(rows, k, target=["1"], archive=["2"], also=["3"], url=["4"]).select(F.lit(k).alias("level"), "file") for k in range(8)]
    return reduce(DataFrame.union, left)


@query("""WITH f AS (SELECT regexp_extract(url, '://(.*?)([?#].*)?$', 1) AS p, page_id FROM pages),
r AS (SELECT 'd/' || CAST(page_id % 5 AS VARCHAR) || '/' || CAST(page_id AS VARCHAR) AS expectedFile, CASE WHEN page_id % 3 = 0 THEN 'OK' ELSE 'FAIL' END AS result FROM f
  UNION ALL SELECT 'd/' || CAST(k AS VARCHAR), 'FAIL' FROM range(7) x(k))
SELECT expectedFile, CASE WHEN expectedFile IN (SELECT regexp_extract(expectedFile, '^(.*)/[^/]*$', 1) FROM r WHERE result = 'OK') AND length(expectedFile) = 3 THEN 'OK' ELSE result END AS result FROM r""")
def manifest_dirs_ok(spark, d):
    p = table(spark, d, "pages")
    files = p.select(F.concat(F.lit("d/"), (F.col("page_id") % 5).cast("string"), F.lit("/"), F.col("page_id").cast("string")).alias("expectedFile"), F.when(F.col("page_id") % 3 == 0, "OK").otherwise("FAIL").alias("result"), F.lit("x").alias("checksum_x"))
    folders = spark.range(7).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("expectedFile"), F.lit("FAIL").alias("result"), F.lit(m.DIRECTORY).alias("checksum_x"))
    rows = files.union(folders)
    for c in m.RESULT:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    return m.directories_ok(rows).select("expectedFile", "result")


@query(f"WITH {COMPARED_SQL} SELECT result, count(*) AS n FROM compared GROUP BY result")
def manifest_summary(spark, d):
    return m.summary(m.compare(*manifests(spark, d)))


@query("""WITH l AS (SELECT CAST(user_id AS VARCHAR) AS file, event_type AS checksum, event_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY event_id DESC) AS k FROM l)
SELECT file, checksum, event_id FROM r WHERE k = 1""")
def manifest_keep_last(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_type").alias("checksum"), "event_id")
    return m.last_by_file(log, "event_id")


# Paths and scalars


@query("""WITH p AS (SELECT string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS parts FROM pages),
x AS (SELECT array_to_string(parts[1:k], '/') AS path FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS k FROM p))
SELECT path, count(*) AS n FROM x GROUP BY path HAVING count(*) > 1""")
def path_prefix_dirs(spark, d):
    return m.directory_prefixes(table(spark, d, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("file")))


@query("""SELECT page_id, regexp_extract(p, '[.]([A-Za-z0-9]+)$', 1) AS ext, regexp_extract(p, '([^/]*)$', 1) AS base, regexp_replace(p, '[.][A-Za-z0-9]+$', '') AS stem,
  regexp_replace(p, '[.][A-Za-z0-9]+$', '') || '_x' || regexp_extract(p, '([.][A-Za-z0-9]+)?$', 1) AS suffixed
FROM (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS p FROM pages)""")
def path_ext_base(spark, d):
    p = F.regexp_extract("url", "://([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", sc.extension(p).alias("ext"), sc.last_component(p).alias("base"), sc.without_extension(p).alias("stem"), sc.with_suffix(p, "_x").alias("suffixed"))


@query("""SELECT page_id, array_to_string(parts[greatest(len(parts) - 1, 1):], '/') AS tail FROM (SELECT page_id, string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS parts FROM pages)""")
def path_last_parts(spark, d):
    return table(spark, d, "pages").select("page_id", sc.last_components(F.regexp_extract("url", "://([^?#]*)", 1), 1).alias("tail"))


@query("SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 5, '0') AS padded FROM part")
def padded_number(spark, d):
    return table(spark, d, "part").select("p_partkey", sc.padded_number("p_size", 5).alias("padded"))


@query("SELECT count(*) AS n, sum(CASE WHEN a IS NOT DISTINCT FROM b THEN 1 ELSE 0 END) AS n_same FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS b FROM orders)")
def null_safe_equal(spark, d):
    o = table(spark, d, "orders")
    a, b = (F.when(F.col("o_orderkey") % k != 0, F.col("o_orderstatus")) for k in (3, 2))
    return o.select(sc.equal_or_both_null(a, b).alias("same")).agg(F.count("*").alias("n"), F.sum(F.col("same").cast("int")).cast("long").alias("n_same"))


@query("SELECT l_orderkey, l_linenumber, md5(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)) AS hash FROM lineitem")
def digest_rows(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.md5(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("hash"))


@query("""SELECT l_returnflag, count(*) AS n, count(DISTINCT struct_pack(q := l_quantity, d := l_discount, t := l_tax, s := l_linestatus)) AS n_different
FROM lineitem GROUP BY l_returnflag""")
def digest_different_rows(spark, d):
    """Rows told apart by their hashes."""
    from cairnflow.functions.digest import row_hash

    rows = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linestatus", "l_returnflag")
    hashed = rows.select("l_returnflag", row_hash(rows).alias("h"))
    return hashed.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("h").alias("n_different"))


@query("SELECT round_even(c_acctbal, 1) AS rounded, count(*) AS n FROM customer GROUP BY 1")
def round_half_even(spark, d):
    return table(spark, d, "customer").groupBy(sc.round_fraction("c_acctbal", 1).alias("rounded")).agg(F.count("*").alias("n"))


# Grids


@query(f"""WITH {GRID_SQL} SELECT layer, CAST("row" - 10 AS INTEGER) AS "row", CAST(col - 5 AS INTEGER) AS col, value FROM cells WHERE "row" BETWEEN 10 AND 29 AND col BETWEEN 5 AND 14""")
def grid_crop(spark, d):
    cells, grid = grid_of(spark, d)
    return g.crop(cells, grid, g.Extent(5, 15, -30, -10))[0]


@query(f"""WITH {GRID_SQL} SELECT layer, "row", col, CASE WHEN p_size > 25 THEN value END AS value FROM cells""")
def grid_mask(spark, d):
    return g.mask(grid_of(spark, d)[0], mask_grid(spark, d))


@query(f"""WITH {GRID_SQL}, {INSIDE_SQL} SELECT c.layer, c."row", c.col, CASE WHEN i.col IS NOT NULL THEN c.value END AS value FROM cells c LEFT JOIN inside i ON c."row" = i."row" AND c.col = i.col""")
def grid_mask_polygon(spark, d):
    cells, grid = grid_of(spark, d)
    return v.mask_cells(cells, grid, v.features(spark, [(0, v.polygon(RING))]))


_TARGET = g.Grid(50, 10, g.Extent(0, 20, -100, 0), pr.WebMercator())


@query(f"""WITH {GRID_SQL}, t AS (SELECT CAST(i // 10 AS INTEGER) AS "row", CAST(i % 10 AS INTEGER) AS col FROM range(500) r(i))
SELECT 0 AS layer, t."row", t.col, c.value FROM t LEFT JOIN cells c ON c."row" = CAST(floor((t."row" + 0.5e0) * 2) AS INTEGER) AND c.col = CAST(floor((t.col + 0.5e0) * 2) AS INTEGER)""")
def grid_resample_near(spark, d):
    return g.resample_nearest(*grid_of(spark, d), _TARGET)


@query(f"""WITH {GRID_SQL}, t AS (SELECT CAST(i // 10 AS INTEGER) AS "row", CAST(i % 10 AS INTEGER) AS col FROM range(500) r(i)),
k AS (SELECT t."row", t.col, t."row" * 2 + a.dr AS r, t.col * 2 + b.dc AS c FROM t, (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(dc)),
j AS (SELECT k."row", k.col, cells.value FROM k LEFT JOIN cells ON cells."row" = k.r AND cells.col = k.c)
SELECT 0 AS layer, "row", col, round(CASE WHEN count(value) = 4 THEN sum(value) / 4 END, 6) AS value FROM j GROUP BY "row", col""")
def grid_resample_bilinear(spark, d):
    return g.resample_bilinear(*grid_of(spark, d), _TARGET).withColumn("value", F.round("value", 6))


@query(f"""WITH {GRID_SQL} SELECT 0 AS layer, min(value) AS low, max(value) AS high,
  CASE WHEN bool_and(value = floor(value)) THEN CASE WHEN min(value) >= 0 AND max(value) <= 255 THEN 'INT1U' WHEN min(value) >= 0 AND max(value) <= 65534 THEN 'INT2U' ELSE 'INT4S' END ELSE 'FLT4S' END AS datatype FROM cells""")
def grid_datatype(spark, d):
    return g.datatypes(grid_of(spark, d)[0])


@query(f"""WITH {GRID_SQL}, {INSIDE_SQL} SELECT c.layer, CAST(c."row" - 2 AS INTEGER) AS "row", CAST(c.col - 2 AS INTEGER) AS col, CASE WHEN i.col IS NOT NULL THEN c.value END AS value
FROM cells c LEFT JOIN inside i ON c."row" = i."row" AND c.col = i.col WHERE c."row" BETWEEN 2 AND 39 AND c.col BETWEEN 2 AND 14""")
def grid_conform(spark, d):
    """Padded crop, mask by a polygon, crop."""
    from cairnflow.operators.conform import Features, Raster, conform

    area = Features(v.features(spark, [(0, v.polygon(RING))]), pr.WebMercator())
    return conform(Raster(*grid_of(spark, d)), area).cells


@query(f"""WITH {GRID_SQL} SELECT layer, min(value) AS min, max(value) AS max FROM cells GROUP BY layer""")
def grid_min_max(spark, d):
    return g.min_max(grid_of(spark, d)[0])


# Projections and features

_LON = "(c_custkey % 100 - 50)"
_LAT = "(c_acctbal / 200)"


def _points(spark, d):
    return table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 100 - 50).cast("double").alias("lon"), (F.col("c_acctbal") / 200).alias("lat"))


def _projected(spark, d, projection, digits=4):
    x, y = projection.forward("lon", "lat")
    return _points(spark, d).select("c_custkey", F.round(x, digits).alias("x"), F.round(y, digits).alias("y"))


@query(f"SELECT c_custkey, round(radians({_LON}) * 6378137e0, 4) AS x, round(ln(tan(pi() / 4 + radians({_LAT}) / 2)) * 6378137e0, 4) AS y FROM customer")
def crs_web_mercator(spark, d):
    return _projected(spark, d, pr.WebMercator())


def _lcc_sql() -> str:
    p = pr.LambertConic(49, 77, 63.390675, -91.8667, 6.2e6, 3e6, spherical=True)
    n, f, rho0 = p._constants()
    rho = f"({f!r}e0 / pow(tan(pi() / 4 + radians({_LAT}) / 2), {n!r}e0))"
    theta = f"({n!r}e0 * radians({_LON} - (-91.8667e0)))"
    return f"SELECT c_custkey, round(6200000e0 + 6378137e0 * {rho} * sin({theta}), 4) AS x, round(3000000e0 + 6378137e0 * ({rho0!r}e0 - {rho} * cos({theta})), 4) AS y FROM customer"


@query(_lcc_sql())
def crs_lcc(spark, d):
    return _projected(spark, d, pr.LambertConic(49, 77, 63.390675, -91.8667, 6.2e6, 3e6, spherical=True))


@query(f"SELECT c_custkey, CAST({_LON} AS DOUBLE) AS x, round({_LAT}, 6) AS y FROM customer")
def crs_utm_round_trip(spark, d):
    """To a zone of the transverse Mercator projection and back, near its meridian."""
    utm = pr.TransverseMercator.utm(31)
    p = _points(spark, d).select("c_custkey", "lon", "lat", (F.col("lon") / 50 + 3).alias("near"))
    x, y = utm.forward("near", "lat")
    lon, lat = utm.inverse("px", "py")
    there = p.select("c_custkey", x.alias("px"), y.alias("py"))
    return there.select("c_custkey", F.round((lon - 3) * 50, 4).alias("x"), F.round(lat, 6).alias("y"))


@query(f"SELECT c_custkey, CAST({_LON} AS DOUBLE) AS x, round({_LAT}, 6) AS y FROM customer")
def crs_albers_round_trip(spark, d):
    albers = pr.Albers(29.5, 45.5, 23, -96)
    x, y = albers.forward("lon", "lat")
    lon, lat = albers.inverse("px", "py")
    return _points(spark, d).select("c_custkey", x.alias("px"), y.alias("py")).select("c_custkey", F.round(lon, 6).alias("x"), F.round(lat, 6).alias("y"))


@query("""WITH edges(x1, y1, x2, y2) AS (VALUES (10e0,5e0,80e0,10e0),(80e0,10e0,60e0,90e0),(60e0,90e0,15e0,70e0),(15e0,70e0,10e0,5e0)),
p AS (SELECT c_custkey, CAST(c_custkey % 100 AS DOUBLE) AS x, c_acctbal / 100 AS y FROM customer)
SELECT c_custkey FROM p, edges e WHERE (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) GROUP BY c_custkey HAVING count(*) % 2 = 1""")
def vector_points_inside(spark, d):
    p = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 100).cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("y"))
    area = v.features(spark, [(0, v.polygon([(10, 5), (80, 10), (60, 90), (15, 70)]))])
    return v.inside(p, area, key=["c_custkey"]).select("c_custkey")


def _squares(spark, d):
    """A square for each nation."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("fid"), (F.col("n_nationkey") % 5 * 10).cast("double").alias("x"), (F.floor(F.col("n_nationkey") / 5) * 10).cast("double").alias("y"))
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    ring = F.array(corner(1, 1), corner(9, 1), corner(9, 9), corner(1, 9))
    part = F.array(F.struct(F.lit(False).alias("hole"), ring.alias("ring")))
    return n.select("fid", F.struct(F.lit("polygon").alias("type"), part.alias("parts")).alias("geom"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS fid FROM nation WHERE n_nationkey % 5 <= 2 AND n_nationkey // 5 <= 1")
def vector_contains_domain(spark, d):
    """The squares that lie in a larger one."""
    return v.contained(_squares(spark, d), v.features(spark, [(0, v.polygon([(0, 0), (30, 0), (30, 20), (0, 20)]))])).select("fid")


@query("SELECT CAST(n_nationkey AS BIGINT) AS fid, n_nationkey % 5 * 10 + 1e0 AS xmin, n_nationkey % 5 * 10 + 9e0 AS xmax, n_nationkey // 5 * 10 + 1e0 AS ymin, n_nationkey // 5 * 10 + 9e0 AS ymax FROM nation WHERE n_nationkey % 5 * 10 + 9 >= 12 AND n_nationkey % 5 * 10 + 1 <= 25 AND n_nationkey // 5 * 10 + 9 >= 12 AND n_nationkey // 5 * 10 + 1 <= 25")
def vector_crop(spark, d):
    return v.boxes(v.crop(_squares(spark, d), g.Extent(12, 25, 12, 25)))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS fid, greatest(n_nationkey % 5 * 10 + 1e0, 12e0) AS xmin, least(n_nationkey % 5 * 10 + 9e0, 35e0) AS xmax,
  greatest(n_nationkey // 5 * 10 + 1e0, 5e0) AS ymin, least(n_nationkey // 5 * 10 + 9e0, 27e0) AS ymax
FROM nation WHERE greatest(n_nationkey % 5 * 10 + 1e0, 12e0) < least(n_nationkey % 5 * 10 + 9e0, 35e0) AND greatest(n_nationkey // 5 * 10 + 1e0, 5e0) < least(n_nationkey // 5 * 10 + 9e0, 27e0)""")
def vector_clip(spark, d):
    """Squares cut by a rectangle: their boxes."""
    return v.boxes(v.clip(_squares(spark, d), [(12, 5), (35, 5), (35, 27), (12, 27)]))


_L = "5e0 AS ax0, 25e0 AS ax1, 5e0 AS ay0, 12e0 AS ay1, 5e0 AS bx0, 12e0 AS bx1, 12e0 AS by0, 30e0 AS by1, 30e0 AS cx0, 45e0 AS cx1, 30e0 AS cy0, 48e0 AS cy1"


def _overlap(k: str) -> str:
    return f"greatest(least(x + 9, {k}x1) - greatest(x + 1, {k}x0), 0) * greatest(least(y + 9, {k}y1) - greatest(y + 1, {k}y0), 0)"


@query(f"""WITH s AS (SELECT CAST(n_nationkey AS BIGINT) AS fid, n_nationkey % 5 * 10e0 AS x, n_nationkey // 5 * 10e0 AS y, {_L} FROM nation),
a AS (SELECT fid, {_overlap('a')} + {_overlap('b')} + {_overlap('c')} AS area FROM s)
SELECT fid, round(area, 6) AS area FROM a WHERE area > 0""")
def vector_clip_mask(spark, d):
    """Squares cut by two features, one of them concave: what is left of their areas."""
    from cairnflow.operators.conform import Features, mask_to

    shapes = v.features(spark, [(0, v.polygon([(5, 5), (25, 5), (25, 12), (12, 12), (12, 30), (5, 30)])), (1, v.polygon([(30, 30), (45, 30), (45, 48), (30, 48)]))])
    cut = mask_to(Features(_squares(spark, d), pr.LonLat()), Features(shapes, pr.LonLat()))
    return cut.rows.select("fid", F.round(v.area(F.col("geom")), 6).alias("area"))


@query(f"""WITH s AS (SELECT CAST(n_nationkey AS BIGINT) AS fid, n_nationkey % 5 * 10e0 AS x, n_nationkey // 5 * 10e0 AS y,
  2e0 AS ax0, 38e0 AS ax1, 2e0 AS ay0, 38e0 AS ay1, 14e0 AS bx0, 27e0 AS bx1, 3e0 AS by0, 26e0 AS by1 FROM nation),
a AS (SELECT fid, {_overlap('a')} - {_overlap('b')} AS area FROM s) SELECT fid, round(area, 6) AS area FROM a WHERE area > 0""")
def vector_clip_hole(spark, d):
    """Squares cut by a feature with a hole."""
    ring = v.features(spark, [(0, v.polygon([(2, 2), (38, 2), (38, 38), (2, 38)], [(14, 3), (27, 3), (27, 26), (14, 26)]))])
    return v.intersect(_squares(spark, d), ring).select("fid", F.round(v.area(F.col("geom")), 6).alias("area"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS fid, TRUE AS valid, CAST(2 AS INTEGER) AS n_parts FROM nation")
def vector_repair(spark, d):
    """A bow-tie for each nation, split where it crosses itself."""
    s = _squares(spark, d)
    ring = F.col("geom.parts")[0]["ring"]
    bow = F.array(ring[0], ring[2], ring[1], ring[3])
    parts = F.array(F.struct(F.lit(False).alias("hole"), bow.alias("ring")))
    fixed = v.repaired(s.withColumn("geom", F.struct(F.lit("polygon").alias("type"), parts.alias("parts"))))
    return v.validity(fixed).join(fixed.select("fid", F.size("geom.parts").alias("n_parts")), "fid")


# Side effects


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared.rstrip('/')}/{os.urandom(8).hex()}" if shared else f"file://{tempfile.mkdtemp()}"


@query("SELECT o_orderpriority AS priority, count(*) AS n, FALSE AS new_again FROM orders GROUP BY 1")
def memo_roundtrip(spark, d):
    """A memoised aggregation: made once, read the second time."""
    from cairnflow.plans.memo import memo
    from cairnflow.plans.store import Store

    def counts(path: str):
        return table(spark, path, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))

    store = Store(spark, _folder(spark))
    memo(counts, d, store=store, user_tags=["job:counts"])
    again = memo(counts, d, store=store)
    return again.value.withColumn("new_again", F.lit(again.is_new))


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def memo_nested(spark, d):
    """A memoised call in another one: its entry inherits the outer one's tags."""
    from cairnflow.plans.memo import memo
    from cairnflow.plans.store import Store

    store = Store(spark, _folder(spark))

    def inner(path: str):
        return table(spark, path, "orders").where("o_orderstatus = 'F'")

    def outer(path: str):
        rows = memo(inner, path, store=store, user_tags=["level:inner"]).value
        return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))

    return memo(outer, d, store=store, user_tags=["level:outer"]).value


@query("SELECT * FROM (VALUES ('inner', 'inner'), ('inner', 'outer'), ('outer', 'outer')) x(function, level)")
def memo_nested_tags(spark, d):
    """The tags of a call and of the one in it, which has inherited the outer one's."""
    from cairnflow.plans.memo import memo
    from cairnflow.plans.store import Store

    store = Store(spark, _folder(spark))
    inner = lambda: table(spark, d, "region").count()
    outer = lambda: memo(inner, store=store, user_tags=["level:inner"], function_name="inner").value
    memo(outer, store=store, user_tags=["level:outer"], function_name="outer")
    tags = store.tags()
    names = tags.where("tagKey = 'function'").select("cacheId", F.col("tagValue").alias("function"))
    return names.join(tags.where("tagKey = 'level'").select("cacheId", F.col("tagValue").alias("level")), "cacheId").select("function", "level")


@query("""SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1""")
def store_compacted(spark, d):
    """A store whose log is compacted after an entry was made anew: the entry is there with its last value."""
    from cairnflow.plans.memo import memo
    from cairnflow.plans.store import Store

    def counts(path: str):
        return table(spark, path, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))

    store = Store(spark, _folder(spark))
    memo(counts, d, store=store)
    memo(counts, d, store=store, use_cache="overwrite")
    store.compact()
    again = memo(counts, d, store=store)
    return again.value.where(F.lit(not again.is_new))


@query("""SELECT 0 AS layer, CAST(r - 1 AS INTEGER) AS "row", CAST(c - 1 AS INTEGER) AS col, CASE WHEN (r + c) % 5 <> 0 THEN CAST(r * 6 + c AS DOUBLE) END AS value
FROM range(1, 3) x(r), range(1, 5) y(c)""")
def ingest_zip(spark, d):
    """A text grid in an archive within an archive: taken out, read, stored, read from the store, cropped."""
    from cairnflow.plans.memo import memo
    from cairnflow.plans.store import Store
    from cairnflow.operators.conform import Features, conform
    from cairnflow.sources.ingest import Source
    from cairnflow.sources.readers import read_ascii_grid

    folder = tempfile.mkdtemp()
    text = "ncols 6\nnrows 4\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9\n" + "\n".join(" ".join(str(r * 6 + c if (r + c) % 5 else -9) for c in range(6)) for r in range(4)) + "\n"
    with zipfile.ZipFile(f"{folder}/inner.zip", "w") as z:
        z.writestr("data/heights.asc", text)
    with zipfile.ZipFile(f"{folder}/outer.zip", "w") as z:
        z.write(f"{folder}/inner.zip", "inner.zip")
    from cairnflow.sources.ingest import acquire

    got = acquire(Source(url=f"file://{folder}/outer.zip", target="heights.asc"), f"{folder}/out")
    with open(got.target) as file:
        lines = file.read()
    remote = f"{_folder(spark)}/heights.asc"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(remote)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(lines.encode()))
    out.close()
    store = Store(spark, _folder(spark))
    for _ in range(2):
        raster = memo(lambda: read_ascii_grid(spark, remote), store=store, function_name="heights").value
    area = Features(v.features(spark, [(0, v.polygon([(1, 1), (5, 1), (5, 3), (1, 3)]))]), pr.LonLat())
    return conform(raster, area).cells
