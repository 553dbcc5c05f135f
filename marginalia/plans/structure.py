"""Queries over chunks, pages and concepts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import prose as N
from ..functions import text as T
from ..operators import concepts as C
from ..operators import structure as S
from ..operators.joins import as_of_join, top_per_group
from ..sources import tables
from .prose import LINE_RULES as PROSE_RULES
from .prose import MARKED
from .text import CHUNKS, LINES, _ngrams


def build_outline(spark, d):
    return S.outline(tables.chunks(spark, d))


def compute_outline_id(spark, d):
    return S.outline_digest(S.outline(tables.chunks(spark, d)))


def fallback_outline(spark, d):
    return S.page_buckets(tables.chunks(spark, d))


def filter_chunks_by_page_ranges(spark, d):
    """Chunks whose pages meet any range of their book's chapters 1 to 3."""
    c = tables.chunks(spark, d)
    ranges = S.outline(c).where("level = 1 and id in ('ch_1', 'ch_2', 'ch_3')").select(F.col("book").alias("r_book"), "lo", "hi")
    meets = (F.col("book") == F.col("r_book")) & (F.col("page_start") <= F.col("hi")) & (F.col("lo") <= F.col("page_end"))
    return c.join(F.broadcast(ranges), meets, "left_semi").select("chunk_id").distinct()


def build_page_to_sections(spark, d):
    c = tables.chunks(spark, d)
    return c.select("book", "section", F.explode(F.sequence("page_start", "page_end")).alias("page")).groupBy("book", "page").agg(F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"))


def lookup_section(spark, d):
    """The narrowest chunk that covers a page, of equal ones the earliest, then the lowest id."""
    c = tables.chunks(spark, d).select("book", "chunk_id", "page_start", (F.col("page_end") - F.col("page_start")).alias("width"), F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return c.groupBy("book", "page").agg(F.min(F.struct("width", "page_start", "chunk_id")).alias("m")).select("book", "page", "m.chunk_id")


def get_chapter_info(spark, d):
    """The chapter that a page belongs to: that of the last chunk that starts on or before it."""
    c = tables.chunks(spark, d)
    pages = c.select("book", F.col("page_end").alias("page")).distinct()
    return as_of_join(pages, c.select("book", "page_start", "chapter"), ["book"], "page", "page_start", "chapter").select("book", "page", "chapter")


def scan_sections(spark, d):
    """Chunks as section starts: each section ends before the next one of its book."""
    c = tables.chunks(spark, d)
    starts = c.groupBy("book", "page_start").agg(F.min("chunk_id").alias("section_number"))
    return S.section_spans(starts, ["book"], "page_start", c.groupBy("book").agg(F.max("page_end").alias("last_page")))


def chunk_long_sections(spark, d):
    w = S.word_windows(tables.chunks(spark, d), "chunk_id", F.col("text"))
    return w.select("id", "chunk_index", "total_chunks", F.size("words").alias("word_count"), F.md5(F.array_join("words", " ")).alias("digest"))


def subchunk_text(spark, d):
    """Sub-chunks of whole paragraphs, or of the parts of long ones, in order, with digests of their texts."""
    packs = S.subchunks(tables.chunks(spark, d), "chunk_id", F.col("text"))
    return packs.select("id", "pos", "n_words", F.md5("text").alias("digest"))


def get_catalog(spark, d):
    c = tables.chunks(spark, d)
    return c.rollup("book").agg(F.count("*").alias("chunks"), F.grouping("book").cast("int").alias("total"))


def stats(spark, d):
    c = tables.chunks(spark, d).select("book", T.word_count(F.col("text")).alias("n"))
    return c.agg(F.count_distinct("book").alias("books"), F.count("*").alias("chunks"), F.sum("n").alias("words"), F.floor(F.avg("n")).alias("mean_words"), (F.avg("n") > 600).alias("long"))


def exact_dedupe(spark, d):
    """The first document of each text."""
    return tables.table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def extract_headings(spark, d):
    """Lines like headings, where each comes first; those that differ in case and spaces are one."""
    s = F.col("s")
    found = tables.probe_lines(spark, d).where(N.heading_like(s)).select("doc_id", "pos", F.lower(T.squeeze(s)).alias("heading"))
    return found.groupBy("heading").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.count("*").alias("n")).select("heading", "at.doc_id", "at.pos", "n")


def _term_lists(spark, d):
    """(sid, terms): the n-grams of each line."""
    return tables.lines(spark, d).select(F.struct("doc_id", "pos").alias("sid"), T.term_ngrams(F.col("s")).alias("terms"))


def _terms(spark, d):
    return _term_lists(spark, d).select("sid", F.explode("terms").alias("term"))


def build_term_stats(spark, d):
    return C.term_stats(_term_lists(spark, d))


def _chosen(spark, d):
    """The forty best terms: what a bundle is built from."""
    return C.term_stats(_term_lists(spark, d)).orderBy(F.desc("score"), "term").limit(40)


def build_cooccurrence_graph(spark, d):
    return C.cooccurrence(_terms(spark, d), _chosen(spark, d))


def bundle_terms(spark, d):
    """The five terms that each chosen term meets most often."""
    e = C.cooccurrence(_terms(spark, d), _chosen(spark, d))
    return top_per_group(e.union(e.select("b", "a", "n")), ["a"], [F.desc("n"), F.col("b")], 5)


def get_ranked_gaps(spark, d):
    """Parts' names as concepts: mastery from sizes, settledness from event-like states, books from brands."""
    p = tables.table(spark, d, "part")
    c = p.groupBy(F.col("p_name").alias("name")).agg(F.avg(F.col("p_size") / 50.0).alias("mastery"), F.count_distinct("p_brand").alias("n_books"))
    return C.ranked_gaps(c, p.select(F.col("p_name").alias("name"), ((F.col("p_partkey") % 10) / 10).alias("terminality")), 20)


def get_prereqs(spark, d):
    """Words of part names as concepts that meet in a name; their sections are brand and size."""
    p = tables.table(spark, d, "part").withColumn("w", F.array_sort(F.array_distinct(F.split("p_name", " "))))
    pairs = p.where(F.size("w") > 1).select(F.element_at("w", 1).alias("a"), F.element_at("w", 2).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    sections = p.select(F.explode("w").alias("name"), T.section_key(F.concat_ws(".", F.regexp_extract("p_brand", r"(\d+)", 1), F.col("p_size").cast("string"))).alias("key"))
    return C.prerequisites(pairs, sections).select("a", "b", "n", "rank")


def get_active_version_per_family(spark, d):
    """The last book file of each family of names that is ready."""
    p = tables.table(spark, d, "part").where("p_partkey % 3 <> 1")
    family = F.regexp_replace(F.trim(F.lower("p_name")), r"\s+", " ")
    return top_per_group(p.select(family.alias("family"), "p_partkey"), ["family"], [F.desc("p_partkey")], 1).drop("rank")


def get_books_union(spark, d):
    """Suppliers and customers as two libraries of books by nation: the first source of a key wins."""
    a = tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("book_id"), F.col("s_name").alias("title"), F.lit(0).alias("source"))
    b = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_name").alias("title"), F.lit(1).alias("source"))
    return top_per_group(a.union(b), ["book_id"], [F.col("source"), F.col("title")], 1).drop("rank")


def compare_results(spark, d):
    """Two evaluations of every brand, metric by metric, and which way each moved."""
    p = tables.table(spark, d, "part")
    run = lambda k: p.where(F.col("p_partkey") % 2 == k).groupBy("p_brand").agg(F.round(F.avg("p_size"), 6).alias("size"), F.round(F.avg("p_retailprice"), 6).alias("price"))
    long = lambda df, v: df.unpivot(["p_brand"], ["size", "price"], "metric", v)
    both = long(run(0), "base").join(long(run(1), "now"), ["p_brand", "metric"])
    change = F.col("now") - F.col("base")
    return both.withColumn("status", F.when(change < -0.01, "regression").when(change > 0.01, "improvement").otherwise("same"))


_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
OUTLINE = f"""{CHUNKS}, s AS (SELECT book, chapter, section, min(page_start) AS lo, max(page_end) AS hi FROM l WHERE page_start <> 0 OR page_end <> 0 GROUP BY ALL),
o AS (SELECT book, 'ch_' || chapter AS id, 'Chapter ' || chapter AS title, 1 AS level, min(lo) AS lo, max(hi) AS hi, NULL AS parent_id FROM s GROUP BY book, chapter
  UNION ALL SELECT book, 'ch_' || chapter || '_sec_' || replace(section, '.', '_'), 'Section ' || chapter || '.' || section, 2, lo, hi, 'ch_' || chapter FROM s WHERE section <> '')"""
TERMS = f"""{LINES}, t AS (SELECT (doc_id, pos) AS sid, unnest({_ngrams()}) AS term FROM l),
p AS (SELECT term, count(*) AS df, sum(n) AS tf FROM (SELECT sid, term, count(*) AS n FROM t GROUP BY ALL) GROUP BY term),
w AS (SELECT *, len(string_split(term, ' ')) AS k FROM p),
r AS (SELECT term, df, tf, df * CASE WHEN k >= 2 THEN 1.0::DOUBLE + 0.3::DOUBLE * (k - 1) ELSE 1.0 END * CASE WHEN df < 2 AND k = 1 THEN 0.5::DOUBLE ELSE 1.0 END AS raw FROM w),
ts AS (SELECT term, df, tf, round(raw / (SELECT max(raw) FROM r), 6) AS score FROM r)"""
GRAPH = TERMS + """, ch AS (SELECT term FROM ts ORDER BY score DESC, term LIMIT 40), kt AS (SELECT DISTINCT sid, term FROM t JOIN ch USING (term)),
e AS (SELECT a.term AS a, b.term AS b, count(*) AS n FROM kt a JOIN kt b ON a.sid = b.sid AND a.term < b.term GROUP BY ALL)"""
_words = r"list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')"

QUERIES = {f.__name__: f for f in (
    build_outline, compute_outline_id, fallback_outline, filter_chunks_by_page_ranges, build_page_to_sections, lookup_section, get_chapter_info, scan_sections, chunk_long_sections, subchunk_text,
    get_catalog, stats, exact_dedupe, extract_headings, build_term_stats, build_cooccurrence_graph, bundle_terms, get_ranked_gaps, get_prereqs,
    get_active_version_per_family, get_books_union, compare_results,
)}
ORACLE_SQL = {
    "build_outline": f"{OUTLINE} SELECT * FROM o",
    "compute_outline_id": f"{OUTLINE} SELECT book, substr(sha256(string_agg(x, ';' ORDER BY x)), 1, 16) AS outline_id FROM (SELECT book, id || '|' || title || '|' || lo || '|' || hi AS x FROM o) GROUP BY book",
    "fallback_outline": f"{CHUNKS}, g AS (SELECT book, least(min(page_start), min(page_end)) AS low, greatest(max(page_start), max(page_end)) AS high FROM l GROUP BY book), x AS (SELECT book, high, unnest(range(low, high + 1, 20)) AS start FROM g) SELECT book, start, least(start + 19, high) AS \"end\" FROM x",
    "filter_chunks_by_page_ranges": f"{OUTLINE} SELECT DISTINCT doc_id AS chunk_id FROM l JOIN (SELECT book, lo, hi FROM o WHERE id IN ('ch_1', 'ch_2', 'ch_3')) r ON l.book = r.book AND page_start <= r.hi AND r.lo <= page_end",
    "build_page_to_sections": f"{CHUNKS}, x AS (SELECT book, section, unnest(range(page_start, page_end + 1)) AS page FROM l) SELECT book, page, array_to_string(list_sort(list(DISTINCT section)), ',') AS sections FROM x GROUP BY ALL",
    "lookup_section": f"{CHUNKS}, x AS (SELECT book, doc_id, page_start, page_end - page_start AS width, unnest(range(page_start, page_end + 1)) AS page FROM l) SELECT book, page, doc_id AS chunk_id FROM x QUALIFY row_number() OVER (PARTITION BY book, page ORDER BY width, page_start, doc_id) = 1",
    "get_chapter_info": f"{CHUNKS}, p AS (SELECT DISTINCT book, page_end AS page FROM l), c AS (SELECT book, page_start, max(chapter) AS chapter FROM l GROUP BY ALL) SELECT p.book, page, chapter FROM p ASOF LEFT JOIN c ON p.book = c.book AND page >= page_start",
    "scan_sections": f"{CHUNKS}, s AS (SELECT book, page_start, min(doc_id) AS section_number FROM l GROUP BY ALL), z AS (SELECT book, max(page_end) AS last_page FROM l GROUP BY book) SELECT book, page_start, section_number, coalesce(greatest(lead(page_start) OVER (PARTITION BY book ORDER BY page_start, section_number) - 1, page_start), last_page) AS page_end FROM s JOIN z USING (book)",
    "chunk_long_sections": f"{CHUNKS}, w AS (SELECT doc_id AS id, {_words} AS w FROM l), t AS (SELECT *, (greatest(ceil((len(w) - 1000) / 900), 0) + 1)::INT AS total_chunks FROM w), x AS (SELECT id, w, total_chunks, unnest(range(total_chunks)) AS chunk_index FROM t), y AS (SELECT id, chunk_index, total_chunks, w[chunk_index * 900 + 1:chunk_index * 900 + 1000] AS words FROM x) SELECT id, chunk_index, total_chunks, len(words) AS word_count, md5(array_to_string(words, ' ')) AS digest FROM y",
    "get_catalog": f"{CHUNKS} SELECT book, count(*) AS chunks, grouping(book) AS total FROM l GROUP BY ROLLUP (book)",
    "stats": f"{CHUNKS}, x AS (SELECT book, len({_words}) AS n FROM l) SELECT count(DISTINCT book) AS books, count(*) AS chunks, sum(n) AS words, floor(avg(n))::BIGINT AS mean_words, avg(n) > 600 AS long FROM x",
    "exact_dedupe": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "extract_headings": f"{MARKED}, h AS (SELECT doc_id, pos, lower(q) AS heading FROM m WHERE {PROSE_RULES['is_heading_like'][1]}) SELECT heading, doc_id, pos, n FROM (SELECT *, count(*) OVER (PARTITION BY heading) AS n, row_number() OVER (PARTITION BY heading ORDER BY doc_id, pos) AS k FROM h) WHERE k = 1",
    "build_term_stats": f"{TERMS} SELECT * FROM ts",
    "build_cooccurrence_graph": f"{GRAPH} SELECT * FROM e",
    "bundle_terms": f"{GRAPH}, b2 AS (SELECT * FROM e UNION ALL SELECT b, a, n FROM e) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank FROM b2) WHERE rank <= 5",
    "get_ranked_gaps": "WITH c AS (SELECT p_name AS name, avg(p_size / 50.0::DOUBLE) AS m, count(DISTINCT p_brand) AS nb, avg((p_partkey % 10) / 10) AS t FROM part GROUP BY 1) SELECT name, round(1.0::DOUBLE - m + (1.0::DOUBLE - t) * 0.2::DOUBLE + CASE WHEN nb >= 2 AND m < 0.5 THEN least(0.3::DOUBLE, (nb - 1) * 0.1::DOUBLE) ELSE 0 END, 6) AS gap FROM c ORDER BY gap DESC, name LIMIT 20",
    "get_prereqs": """WITH p AS (SELECT list_sort(list_distinct(string_split(p_name, ' '))) AS w, [regexp_extract(p_brand, '(\\d+)', 1)::INT, p_size] AS key FROM part), e AS (SELECT w[1] AS a, w[2] AS b, count(*) AS n FROM p WHERE len(w) > 1 GROUP BY ALL),
        k AS (SELECT name, min(key) AS key FROM (SELECT unnest(w) AS name, key FROM p) GROUP BY name), z AS (SELECT * FROM e UNION ALL SELECT b, a, n FROM e)
        SELECT * FROM (SELECT z.a, z.b, n, row_number() OVER (PARTITION BY z.a ORDER BY kb.key, n DESC, z.b) AS rank FROM z JOIN k ka ON ka.name = z.a JOIN k kb ON kb.name = z.b WHERE kb.key <= ka.key) WHERE rank <= 10""",
    "get_active_version_per_family": r"SELECT regexp_replace(trim(lower(p_name)), '\s+', ' ', 'g') AS family, max(p_partkey) AS p_partkey FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1",
    "get_books_union": "WITH u AS (SELECT s_suppkey AS book_id, s_name AS title, 0 AS source FROM supplier UNION ALL SELECT c_custkey, c_name, 1 FROM customer) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY source, title) = 1",
    "compare_results": """WITH g AS (SELECT p_partkey % 2 AS k, p_brand, round(avg(p_size), 6) AS size, round(avg(p_retailprice), 6) AS price FROM part GROUP BY ALL),
        u AS (SELECT k, p_brand, 'size' AS metric, size AS v FROM g UNION ALL SELECT k, p_brand, 'price', price FROM g)
        SELECT a.p_brand, a.metric, a.v AS base, b.v AS now, CASE WHEN b.v - a.v < -0.01 THEN 'regression' WHEN b.v - a.v > 0.01 THEN 'improvement' ELSE 'same' END AS status FROM u a JOIN u b ON a.p_brand = b.p_brand AND a.metric = b.metric AND a.k = 0 AND b.k = 1""",
}
