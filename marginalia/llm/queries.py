"""The operators as queries over the whole tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, fingerprint, langid, license_scan, ngram_join, packing, quality, token_counts, url_filter
from .common import cut, table


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, each fetched at a minute of 2024 that follows from its id."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr("timestamp_seconds(1704067200 + (page_id * 7919 % 525600) * 60)").alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list events on the tables' own hosts, by rules on a digest of the host; some write hosts, and paths, in other cases."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    v = hosts.withColumn("v", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))
    parent = F.regexp_replace("host", r"^[^.]+\.([^.]+\.[^.]+\..*)$", "$1")
    rules = [  # list, pattern, when, day, added
        ("adult", F.col("host"), "v % 3 = 0", "v % 200", True),
        ("adult", F.upper("host"), "v % 6 = 0", "v % 200 + 90", False),
        ("adult", F.col("host"), "v % 12 = 0", "v % 200 + 150", True),
        ("malware", parent, "v % 5 = 0", "v % 100", True),
        ("paths", F.concat("host", F.lit("/en")), "v % 7 = 0", "v % 300", True),
        ("paths", F.concat(F.initcap("host"), F.lit("/en/")), "v % 14 = 0", "v % 300 + 30", False),
        ("paths", F.concat("host", F.lit("/EN")), "v % 5 = 1", "v % 300", True),
        ("case", F.concat(F.upper("host"), F.lit(".")), "v % 4 = 1", "v % 250", True),
        ("case", F.col("host"), "v % 4 = 1", "v % 250", False),
        ("case", F.col("host"), "v % 8 = 1", "v % 250 + 20", False),
    ]
    event = lambda name, pattern, day, added: F.struct(F.lit(name).alias("list"), pattern.alias("pattern"), F.expr(f"timestamp_seconds(1704067200 + ({day}) * 86400)").alias("at"), F.lit(added).alias("added"))
    events = F.array_compact(F.array(*[F.when(F.expr(when), event(name, pattern, day, added)) for name, pattern, when, day, added in rules]))
    return v.select(F.explode(events).alias("e")).select("e.*")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = captures(spark, sf_dir)
    out = url_filter.evaluate(seen, cut(list_entries(seen)))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select(F.col("id").alias("page_id"), "host", text("fetched_at").alias("fetched_at"), "lists", "n_entries", text("listed_since").alias("listed_since"), "blocked")


OP1_SQL = r"""
WITH p AS (SELECT page_id, url, make_timestamp((1704067200 + (page_id * 7919 % 525600) * 60) * 1000000) AS fetched_at,
      nullif(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1)), '\.+$', ''), '') AS host,
      regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)', 1) AS segment FROM pages),
h AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 4))::INT AS v FROM p WHERE host IS NOT NULL),
e AS (
  SELECT 'adult' AS list, host AS pattern, v % 200 AS day, true AS added FROM h WHERE v % 3 = 0
  UNION ALL SELECT 'adult', upper(host), v % 200 + 90, false FROM h WHERE v % 6 = 0
  UNION ALL SELECT 'adult', host, v % 200 + 150, true FROM h WHERE v % 12 = 0
  UNION ALL SELECT 'malware', regexp_replace(host, '^[^.]+\.([^.]+\.[^.]+\..*)$', '\1'), v % 100, true FROM h WHERE v % 5 = 0
  UNION ALL SELECT 'paths', host || '/en', v % 300, true FROM h WHERE v % 7 = 0
  UNION ALL SELECT 'paths', upper(host[1]) || host[2:] || '/en/', v % 300 + 30, false FROM h WHERE v % 14 = 0
  UNION ALL SELECT 'paths', host || '/EN', v % 300, true FROM h WHERE v % 5 = 1
  UNION ALL SELECT 'case', upper(host) || '.', v % 250, true FROM h WHERE v % 4 = 1
  UNION ALL SELECT 'case', host, v % 250, false FROM h WHERE v % 4 = 1
  UNION ALL SELECT 'case', host, v % 250 + 20, false FROM h WHERE v % 8 = 1),
d AS (SELECT list, regexp_replace(lower(regexp_extract(trim(pattern), '^[^/]*')), '\.+$', '') || regexp_replace(regexp_extract(trim(pattern), '/.*$'), '/+$', '') AS pattern, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * day AS moment, bool_or(added) AS added FROM e GROUP BY 1, 2, 3),
t AS (SELECT *, lag(added) OVER (PARTITION BY list, pattern ORDER BY moment) AS was FROM d),
c AS (SELECT *, lead(moment) OVER (PARTITION BY list, pattern ORDER BY moment) AS until FROM t WHERE added <> coalesce(was, false)),
i AS (SELECT list, pattern, moment AS since, until FROM c WHERE added),
k AS (SELECT page_id, fetched_at, unnest(list_distinct(list_concat(
        list_transform(range(1, CASE WHEN regexp_matches(host, '^([0-9]+([.][0-9]+){3}|\[.*\])$') THEN 1 ELSE greatest(len(string_split(host, '.')) - 1, 1) END + 1), lambda x: array_to_string(string_split(host, '.')[x:], '.')),
        CASE WHEN segment <> '' THEN [host || '/' || segment] ELSE [] END))) AS pattern FROM p WHERE host IS NOT NULL),
m AS (SELECT page_id, list, k.pattern, since FROM k JOIN i ON k.pattern = i.pattern AND since <= fetched_at AND (until IS NULL OR fetched_at < until)),
g AS (SELECT page_id, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, count(DISTINCT (list, pattern, since)) AS n_entries, min(since) AS listed_since FROM m GROUP BY page_id)
SELECT p.page_id, host, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, coalesce(lists, '') AS lists, coalesce(n_entries, 0) AS n_entries,
  strftime(listed_since, '%Y-%m-%d %H:%M:%S') AS listed_since, n_entries IS NOT NULL AS blocked
FROM p LEFT JOIN g USING (page_id)
"""


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), percent=75)


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT x AS doc_id, x AS node FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(node) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), langid.held_out(3, 1)
    labels = table(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("quality").alias("label"))
    return quality.score(docs, quality.learn(docs, labels)).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT x AS vec_id, x AS node FROM l UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.node),
c AS (SELECT vec_id, min(node) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), limit=512)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), langid.held_out(4, 2)
    return langid.predict(docs, langid.learn(docs.where(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024)


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_ngram_jaccard_join, op3_quality_classifier, op4_embedding_near_dedup, op5_license_scans,
    op6_token_counts, op7_bpe_round_trip, op8_language_id, op9_document_fingerprints, op10_best_fit_packing,
)}
ORACLE_SQL = {"op1_url_filters": OP1_SQL, "op2_ngram_jaccard_join": OP2_SQL, "op4_embedding_near_dedup": OP4_SQL}
