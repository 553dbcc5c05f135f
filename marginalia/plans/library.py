"""Queries for citations, tags, keywords, cloze cards and the library's own bookkeeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.graphs import pagerank, scaled_to_one
from ..operators.joins import top_per_group
from ..sources import tables
from .text import CHUNKS, LINES, _list


def list_books(spark, d):
    return tables.chunks(spark, d).groupBy("book").agg(F.count("*").alias("chunks"))


def analyze_field(spark, d):
    """Filled, empty and distinct values of each column of the documents."""
    fields = ["text", "lang", "source"]
    return tables.table(spark, d, "documents").unpivot(["doc_id"], fields, "field", "v").groupBy("field").agg(F.count("v").alias("filled"), F.count_if(F.col("v").isNull()).alias("empty"), F.count_distinct("v").alias("n_distinct"))


def naive_keywords(spark, d):
    """The three most frequent words of four letters or more, those that come first before others."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0), lambda w: (F.length(w) >= 4) & ~w.isin(T.CONTENT_STOPWORDS))
    each = tables.chunks(spark, d).select("chunk_id", F.posexplode(words).alias("pos", "word")).groupBy("chunk_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return top_per_group(each, ["chunk_id"], [F.desc("n"), F.col("pos")], 3).select("chunk_id", "word", "n", "rank")


def extract_key_terms(spark, d):
    """The eight words of four letters or more that are in most lines of a document."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("s"), F.lit("[a-z]+"), 0), lambda w: (F.length(w) >= 4) & ~w.isin(T.CONTENT_STOPWORDS)))
    n = tables.lines(spark, d).select("doc_id", F.explode(words).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return top_per_group(n, ["doc_id"], [F.desc("n"), F.col("word")], 8)


def compute_redundancy(spark, d):
    """The mean Jaccard similarity of the turns of a conversation, by pairs; pairs without any word are left out. A conversation's turns are few and stay one array."""
    c = tables.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", T.simple_tokens(F.col("text")).alias("w")))).alias("t"))
    either = lambda a, b: F.size(F.array_union(a["w"], b["w"]))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.when(either(a, b) > 0, F.size(F.array_intersect(a["w"], b["w"])) / either(a, b)))))
    known = c.select("conv_id", F.filter(pairs, lambda x: x.isNotNull()).alias("p"))
    return known.select("conv_id", F.round(F.when(F.size("p") > 0, F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.size("p")).otherwise(0.0), 6).alias("redundancy"))


def make_card_id(spark, d):
    c = tables.cards(spark, d)
    ids = F.array_join(F.array_sort(F.array(F.col("card_id").cast("string"), F.col("book"))), "|")
    return c.select("card_id", F.substring(F.sha2(F.concat_ws("|", F.lower(F.trim("prompt")), ids), 256), 1, 16).alias("value"))


def format_citation(spark, d):
    pages = F.when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(F.concat_ws("-", F.col("page_start").cast("string"), F.col("page_end").cast("string")))
    return tables.chunks(spark, d).select("chunk_id", F.concat(F.col("book"), F.lit(", §"), F.col("section"), F.lit(", p."), pages).alias("value"))


def extract_tags(spark, d):
    """The book and the words of three letters or more of a card's prompt, each once."""
    words = F.filter(F.regexp_extract_all(F.lower("prompt"), F.lit("[a-z]+"), 0), lambda w: F.length(w) >= 3)
    return tables.cards(spark, d).select("card_id", F.array_join(F.array_distinct(F.concat(F.array("book"), words)), ",").alias("value"))


def make_cloze_cards(spark, d):
    """Declarative lines of 40 to 200 characters with their longest word of five letters or more blanked, of equal ones the first."""
    words = F.filter(F.regexp_extract_all(F.col("s"), F.lit("[A-Za-z]+"), 0), lambda w: F.length(w) >= 5)
    key = F.expr("filter(w, x -> length(x) = array_max(transform(w, y -> length(y))))[0]")
    s = tables.lines(spark, d).where(F.length("s").between(40, 200) & ~F.col("s").contains("?")).select("doc_id", "pos", "s", words.alias("w")).where(F.size("w") > 0).withColumn("answer", key)
    at = F.instr("s", F.col("answer"))
    return s.select("doc_id", "pos", "answer", F.concat(F.substring("s", F.lit(1), at - 1), F.lit("_____"), F.substring("s", at + F.length("answer"), F.length("s"))).alias("prompt"))


def extract_list_items(spark, d):
    """HTML list items of pages that have three or more."""
    items = F.regexp_extract_all("html", F.lit("(?s)<li[^>]*>(.*?)</li>"), 1)
    return tables.table(spark, d, "pages").select("page_id", F.size(items).alias("n_items"), F.element_at(items, 1).alias("first")).where("n_items >= 3")


def check_quality_gates(spark, d):
    """By source: the share of labelled documents that is good, and whether it reaches a half."""
    j = tables.table(spark, d, "documents").join(tables.table(spark, d, "labels"), "doc_id")
    g = j.groupBy("source").agg(F.count("*").alias("requested"), F.sum("quality").cast("long").alias("emitted"))
    return g.withColumn("passed", F.col("emitted") / F.col("requested") >= 0.5)


def rejection_reasons(spark, d):
    """Why lines fail the quality filters, most frequent first, with each reason's share."""
    s = T.squeeze(F.col("s"))
    reason = F.when(F.length(s) < 20, "short_text").when(T.structural_noise(s), "structural").when(T.exercise_prompt(s), "exercise").when(T.reference_line(s), "reference").when(T.numeric_overload(s), "numeric").when(T.content_ratio(s) <= 0.6, "content").when(T.too_short(s), "few_words")
    n = tables.lines(spark, d).select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("reason", "n", (F.col("n") / F.col("total") >= 0.4).alias("dominant"))


def apply_diversity_order(spark, d):
    """Chunks of a book with the first of each section before the rest."""
    c = tables.chunks(spark, d).withColumn("again", F.row_number().over(Window.partitionBy("book", "section").orderBy("chunk_id")) > 1)
    return c.select("chunk_id", F.row_number().over(Window.partitionBy("book").orderBy("again", "chunk_id")).alias("place"))


def detect_negation(spark, d):
    """Lines that hold a word of negation."""
    negation = ["not", "no", "never", "neither", "nor", "cannot", "without", "none", "nothing", "nowhere", "hardly", "barely"]
    return tables.lines(spark, d).select("doc_id", "pos", F.arrays_overlap(T.simple_tokens(F.col("s")), F.array(*map(F.lit, negation))).alias("value"))


def _turn_graph(spark, d):
    """The turns of each conversation as a graph, weighted by the words that two turns share."""
    w = tables.table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.array_distinct(F.flatten(F.collect_list(T.simple_tokens(F.col("text"))))).alias("w"))
    a, b = w.select("conv_id", F.col("turn").alias("src"), F.col("w").alias("x")), w.select("conv_id", F.col("turn").alias("dst"), F.col("w").alias("y"))
    shared = F.size(F.array_intersect("x", "y")) / F.greatest(F.size(F.array_union("x", "y")), F.lit(1))
    return a.join(b, "conv_id").where("src <> dst").select(F.col("conv_id").alias("graph_id"), "src", "dst", shared.alias("w"))


def pagerank_stable(spark, d):
    return pagerank(_turn_graph(spark, d))


def textrank(spark, d):
    return scaled_to_one(pagerank(_turn_graph(spark, d)))


_KEY = f"list_filter(regexp_extract_all(lower(s), '[a-z]+'), lambda w: length(w) >= 4 AND NOT list_contains({_list(T.CONTENT_STOPWORDS)}, w))"
_CLOZE = "list_filter(regexp_extract_all(s, '[A-Za-z]+'), lambda w: length(w) >= 5)"
_SETS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))"
from .study import CARDS  # noqa: E402
from .text import SQUEEZE, _exercise, _noise, _overload, _ratio, _reference, _short  # noqa: E402

QUERIES = {f.__name__: f for f in (
    list_books, analyze_field, naive_keywords, extract_key_terms, compute_redundancy, make_card_id, format_citation, extract_tags, make_cloze_cards, extract_list_items, check_quality_gates,
    rejection_reasons, apply_diversity_order, detect_negation, pagerank_stable, textrank,
)}
ORACLE_SQL = {
    "list_books": "SELECT source AS book, count(*) AS chunks FROM documents GROUP BY 1",
    "analyze_field": " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS filled, count(*) - count({f}) AS empty, count(DISTINCT {f}) AS n_distinct FROM documents" for f in ("text", "lang", "source")),
    "naive_keywords": f"{CHUNKS}, w AS (SELECT doc_id, unnest({_KEY}) AS word, unnest(range(len({_KEY}))) AS pos FROM l), g AS (SELECT doc_id AS chunk_id, word, count(*) AS n, min(pos) AS pos FROM w GROUP BY ALL) SELECT chunk_id, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, pos) AS rank FROM g) WHERE rank <= 3",
    "extract_key_terms": f"{LINES}, w AS (SELECT doc_id, unnest(list_distinct({_KEY})) AS word FROM l), g AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM g) WHERE rank <= 8",
    "compute_redundancy": f"""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k, {_SETS} AS w FROM conversations),
        p AS (SELECT a.conv_id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS j FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.k < b.k WHERE len(a.w) + len(b.w) > 0)
        SELECT conv_id, round(coalesce(avg(j), 0), 6) AS redundancy FROM (SELECT DISTINCT conv_id FROM c) LEFT JOIN p USING (conv_id) GROUP BY conv_id""",
    "make_card_id": f"{CARDS} SELECT card_id, substr(sha256(lower(trim(prompt)) || '|' || array_to_string(list_sort([card_id::VARCHAR, book]), '|')), 1, 16) AS value FROM c",
    "format_citation": f"{CHUNKS} SELECT doc_id AS chunk_id, book || ', §' || section || ', p.' || CASE WHEN page_start = page_end THEN page_start::VARCHAR ELSE page_start || '-' || page_end END AS value FROM l",
    "extract_tags": f"{CARDS}, x AS (SELECT card_id, list_concat([book], list_filter(regexp_extract_all(lower(prompt), '[a-z]+'), lambda w: length(w) >= 3)) AS w FROM c) SELECT card_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ',') AS value FROM x",
    "make_cloze_cards": f"""{LINES}, w AS (SELECT doc_id, pos, s, {_CLOZE} AS w FROM l WHERE length(s) BETWEEN 40 AND 200 AND NOT contains(s, '?')),
        a AS (SELECT doc_id, pos, s, list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))))[1] AS answer FROM w WHERE len(w) > 0)
        SELECT doc_id, pos, answer, substr(s, 1, instr(s, answer) - 1) || '_____' || substr(s, instr(s, answer) + length(answer)) AS prompt FROM a""",
    "extract_list_items": "WITH x AS (SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS i FROM pages) SELECT page_id, len(i) AS n_items, i[1] AS first FROM x WHERE len(i) >= 3",
    "check_quality_gates": "SELECT *, emitted / requested >= 0.5 AS passed FROM (SELECT source, count(*) AS requested, sum(quality)::BIGINT AS emitted FROM documents JOIN labels USING (doc_id) GROUP BY source)",
    "rejection_reasons": f"""{LINES}, q AS (SELECT {SQUEEZE} AS s FROM l), r AS (SELECT CASE WHEN length(s) < 20 THEN 'short_text' WHEN {_noise()} THEN 'structural' WHEN {_exercise()} THEN 'exercise' WHEN {_reference()} THEN 'reference'
        WHEN {_overload()} THEN 'numeric' WHEN {_ratio()} <= 0.6 THEN 'content' WHEN {_short()} THEN 'few_words' END AS reason FROM q), n AS (SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason) SELECT reason, n, n / sum(n) OVER () >= 0.4 AS dominant FROM n""",
    "apply_diversity_order": f"{CHUNKS}, a AS (SELECT doc_id AS chunk_id, book, row_number() OVER (PARTITION BY book, section ORDER BY doc_id) > 1 AS again FROM l) SELECT chunk_id, row_number() OVER (PARTITION BY book ORDER BY again, chunk_id) AS place FROM a",
    "detect_negation": f"{LINES} SELECT doc_id, pos, list_has_any(regexp_extract_all(lower(s), '[a-z0-9_]+'), ['not', 'no', 'never', 'neither', 'nor', 'cannot', 'without', 'none', 'nothing', 'nowhere', 'hardly', 'barely']) AS value FROM l",
}
