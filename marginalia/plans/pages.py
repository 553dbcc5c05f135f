"""Queries of page structure: the augmented corpus lines as page lines, documents as pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import prose as N
from ..functions import text as T
from ..operators.joins import as_of_join
from ..operators.structure import subchunks
from ..sources import files, tables
from .prose import LINES as PROBE_LINES
from .prose import PROBE_ROWS, hits, strip, words
from .text import CHUNKS, LINES
from .text import ORACLE_SQL as _TEXT_SQL


def _over_lines(column):
    return lambda spark, d: tables.lines(spark, d).select("doc_id", "pos", column(F.col("s")).alias("value"))


def extract_pages(spark, d):
    """HTML pages as text pages: host, characters and words."""
    p = tables.table(spark, d, "pages").select("page_id", files.page_text(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").alias("n_chars"), T.word_count(F.col("t")).alias("n_words"), F.md5("t").alias("digest"))


def has_answer(spark, d):
    return tables.probe_lines(spark, d).select("doc_id", "pos", P.announces(F.col("s"), P.ANSWERS).alias("value"))


def _field_query(column, fields):
    return lambda spark, d: tables.probe_lines(spark, d).select("doc_id", "pos", column(F.col("s")).alias("v")).where("v is not null").select("doc_id", "pos", *[F.col(f"v.{f}").alias(f) for f in fields])


def _page_query(column, fields):
    return lambda spark, d: tables.probe_pages(spark, d).select("doc_id", column(F.col("s")).alias("v")).where("v is not null").select("doc_id", *[F.col(f"v.{f}").alias(f) for f in fields])


def extract_detected_numbers(spark, d):
    n = P.detected_numbers(F.col("s"))
    return tables.probe_pages(spark, d).select("doc_id", F.array_join(n["sections"], ",").alias("sections"), F.array_join(n["chapters"].cast("array<string>"), ",").alias("chapters"))




def book_pages(spark, d):
    """(doc_id, book, page, s): documents as the pages of their sources, probes as those of a book of their own."""
    docs = tables.table(spark, d, "documents").select("doc_id", F.col("source").alias("book"), F.expr(tables.AUGMENTED).alias("s"))
    return tables.with_probes(docs, "'probes' AS book").select("doc_id", "book", F.expr("if(doc_id < 0, -7 * doc_id, doc_id % 400 + 1)").alias("page"), "s")


def compute_signals(spark, d):
    return tables.probe_pages(spark, d).select("doc_id", P.signals(F.col("s")).alias("g")).select("doc_id", "g.*")


def page_classes(spark, d):
    """(doc_id, book, page, type, confidence) of every page; the signals are computed once."""
    return book_pages(spark, d).select("doc_id", "book", "page", P.signals(F.col("s")).alias("g")).select("doc_id", "book", "page", P.page_class(F.col("g"), F.col("page")).alias("c")).select("doc_id", "book", "page", "c.*")


def classify_page(spark, d):
    return page_classes(spark, d)


def classify_pagerecords(spark, d):
    """Pages and mean confidence of each class."""
    return page_classes(spark, d).groupBy("type").agg(F.count("*").alias("pages"), F.round(F.avg("confidence"), 4).alias("confidence"))


def load_page_classifications(spark, d):
    """The class of each page of a book; of several records the last counts."""
    return page_classes(spark, d).groupBy("book", "page").agg(F.max_by(F.struct("type", "confidence"), "doc_id").alias("c")).select("book", "page", "c.*")


def get_page_types_in_range(spark, d):
    """The classes of the three pages from each chunk's first: content where an excluded class is unsure, unknown where a page has none."""
    spans = tables.chunks(spark, d).select("chunk_id", "book", F.posexplode(F.sequence(F.col("page_start"), F.col("page_start") + 2)).alias("pos", "page"))
    unsure = F.col("type").isin("toc", "index", "front_matter", "blankish") & (F.col("confidence") < 0.7)
    named = F.when(F.col("type").isNull(), "unknown").when(unsure, "content").otherwise(F.col("type"))
    kinds = spans.join(load_page_classifications(spark, d), ["book", "page"], "left").select("chunk_id", F.struct("pos", named.alias("t")).alias("p"))
    return kinds.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), ",").alias("types"))


def scan_pagerecords_for_chapters(spark, d):
    """Chapters of each book that count, with the special pages after them: those of pages without a chapter heading, by the chapter begun last."""
    pages = book_pages(spark, d).groupBy("book", "page").agg(F.max_by("s", "doc_id").alias("s"))
    seen = pages.select("book", "page", P.chapter_start(F.col("s")).alias("c"), P.special_page(F.col("s")).alias("special"))
    heads = seen.where("c is not null").groupBy("book").agg(F.array_sort(F.collect_list(F.struct("page", F.col("c.number").alias("number"), F.col("c.title").alias("title")))).alias("found"))
    chapters = heads.select("book", F.explode(P.accepted_chapters(F.col("found"))).alias("k")).select("book", F.col("k.page").alias("page"), F.col("k.number").alias("number"), F.col("k.title").alias("title"))
    special = seen.where("c is null and special is not null").select("book", F.col("page").alias("at"), F.col("special.type").alias("type"))
    placed = as_of_join(special, chapters, ["book"], "at", "page", "number").where("number is not null")
    counts = placed.groupBy("book", "number").agg(F.count("*").alias("special_pages"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("special_types"))
    return chapters.join(counts, ["book", "number"], "left").select("book", "number", "page", "title", F.coalesce("special_pages", F.lit(0)).alias("special_pages"), F.coalesce("special_types", F.lit("")).alias("special_types"))


def scan_pagerecords_for_sections(spark, d):
    """Sections of each book: the first page of each number, up to the page before the next section, the last to the book's last page."""
    pages = book_pages(spark, d).groupBy("book", "page").agg(F.max_by("s", "doc_id").alias("s"))
    found = pages.select("book", "page", P.section_start(F.col("s")).alias("n")).where("n is not null").select("book", "page", "n.*")
    first = found.groupBy("book", "number").agg(F.min(F.struct("page", "title", "depth")).alias("f")).select("book", "number", "f.*")
    last = pages.groupBy("book").agg(F.max("page").alias("last_page"))
    after = F.lead("page").over(Window.partitionBy("book").orderBy("page", "number"))
    chapter = F.substring_index("number", ".", 1).try_cast("int")
    return first.withColumn("after", after).join(last, "book").select("book", "number", "title", "depth", chapter.alias("chapter"), F.col("page").alias("page_start"), F.coalesce(F.col("after") - 1, "last_page").alias("page_end"))


def get_chapter_id(spark, d):
    """The chapter that each page of a book is in, as ch and two digits; ch00 before the first."""
    chapters = scan_pagerecords_for_chapters(spark, d).select("book", F.col("page").alias("at"), "number")
    pages = book_pages(spark, d).select("book", "page").distinct()
    return as_of_join(pages, chapters, ["book"], "page", "at", "number").select("book", "page", F.format_string("ch%02d", F.coalesce("number", F.lit(0))).alias("chapter_id"))


def group_sections_per_page(spark, d):
    """Whether a page holds exercises or solutions, by phrases or a heading of their own."""
    low = F.lower("s")
    practice = low.rlike("practice exercises|practice problems|practice questions|review questions|review problems|review exercises|self[- ]test questions|self[- ]test problems|homework problems|homework questions|homework exercises|end of chapter exercises|end of chapter problems|chapter exercises|suggested exercises|suggested problems|worked examples|study questions|discussion questions|comprehension questions|conceptual questions|thought questions") | F.col("s").rlike(r"(?im)^(Exercises?|Problems?|Questions?)\s*$")
    solutions = low.rlike("exercise solutions|answer keys?|solutions to exercises|solutions to problems|solution to exercises|solution to problems|selected answers|selected solutions|answers to exercises|answers to problems|answers to questions|hints and solutions|solutions to selected|answers to selected|solutions to odd-numbered|answers to odd-numbered|solutions manual") | F.col("s").rlike(r"(?im)^(Solutions?|Answers?)\s*$")
    return tables.probe_pages(spark, d).select("doc_id", practice.alias("practice"), solutions.alias("solutions"))


def build_lookup_from_pages(spark, d):
    """Pages of exercises or solutions by the words in their text."""
    low = F.lower("s")
    label = F.when(low.contains("practice exercises"), "practice").when(low.contains("solutions"), "solutions")
    return book_pages(spark, d).select("doc_id", "book", "page", label.alias("label")).where("label is not null")


def check_filters(spark, d):
    """The first reason to leave a chunk of three pages out, null if it stays: a page of an excluded class, contents words or form, dot leaders, a padded title without content."""
    spans = tables.chunks(spark, d).select("chunk_id", "book", F.explode(F.sequence(F.col("page_start"), F.col("page_start") + 2)).alias("page"))
    bad = load_page_classifications(spark, d).where("type in ('toc', 'index', 'front_matter', 'blankish') and confidence >= 0.7")
    paged = spans.join(bad, ["book", "page"]).groupBy("chunk_id").agg(F.min_by(F.concat(F.lit("page_"), "type", F.lit("_confidence_"), F.col("confidence").cast("string")), "page").alias("page_reason"))
    s, title = F.col("text"), F.regexp_extract("text", "^[^\n]*", 0)
    dots = F.size(F.filter(F.split(s, "\n"), lambda x: x.rlike(P.DOT_LEADER)))
    reason = F.coalesce(
        "page_reason", F.when(s.rlike(r"(?i)table\s+of\s+contents"), "contains_toc_phrase").when(T.looks_like_contents(s), "looks_like_toc")
        .when(dots > 4, F.concat(F.lit("dot_leader_heavy_"), dots.cast("string"), F.lit("_lines"))).when(title.rlike(r"(?:\.\s*){4,}") & (T.word_count(s) < 50), "dot_padded_title_no_content"),
    )
    return tables.chunks(spark, d).select("chunk_id", "text").join(paged, "chunk_id", "left").select("chunk_id", reason.alias("reason"))


def build_corpus(spark, d):
    """Chunks that no filter leaves out, cleaned and packed into sub-chunks: what goes in, out and stays, by book."""
    kept = tables.chunks(spark, d).join(check_filters(spark, d), "chunk_id")
    counts = kept.groupBy("book").agg(F.count("*").alias("input"), F.count_if(F.col("reason").isNotNull()).alias("filtered"))
    packs = subchunks(kept.where("reason is null"), "chunk_id", N.corpus_text(F.col("text")))
    sizes = packs.join(kept.select(F.col("chunk_id").alias("id"), "book"), "id").groupBy("book").agg(F.count("*").alias("output"), F.round(F.avg("n_words"), 1).alias("avg_words"))
    return counts.join(sizes, "book", "left").select("book", "input", "filtered", F.coalesce("output", F.lit(0)).alias("output"), "avg_words")


_re = lambda p: f"regexp_matches(s, '{P.either(p)}')"
_chapter_fields, _section_fields = ("number", "title"), ("number", "title", "depth")
QUERIES = {
    "has_chapter": _over_lines(lambda s: P.announces(s, P.CHAPTER)),
    "has_section": _over_lines(lambda s: P.announces(s, P.SECTION)),
    "has_question": _over_lines(lambda s: P.announces(s, P.EXERCISES)),
    "detect_special_page_type": _page_query(P.special_page, ("type", "title")),
    "detect_chapter_at_page_start": _page_query(P.chapter_start, _chapter_fields),
    "detect_section_at_page_start": _page_query(P.section_start, _section_fields),
    "parse_toc_line": _field_query(P.contents_line, ("chapter", "title", "page")),
    "detect_chapter": _field_query(P.chapter_mention, _chapter_fields),
    "find_chapters": _field_query(P.chapter_heading, _chapter_fields),
    "find_sections": _field_query(P.section_heading, ("number", "title", "level")),
} | {f.__name__: f for f in (
    has_answer, extract_pages, extract_detected_numbers, compute_signals, classify_page, classify_pagerecords, load_page_classifications, get_page_types_in_range,
    scan_pagerecords_for_chapters, scan_pagerecords_for_sections, get_chapter_id, group_sections_per_page, build_lookup_from_pages, check_filters, build_corpus,
)}

_lines15 = f"list_transform(string_split(s, chr(10))[1:15], lambda x: {strip('x')})"
_NEXT = f"""x AS (SELECT doc_id, book, page, unnest({_lines15}) AS t, unnest(range(len({_lines15}))) AS i, {_lines15} AS ls FROM b), y AS (SELECT doc_id, book, page, t, i, coalesce(ls[i + 2], '') AS nx FROM x)"""
BOOKS = f"""WITH b0 AS (SELECT doc_id, source AS book, doc_id % 400 + 1 AS page, {tables.AUGMENTED} AS s FROM documents UNION ALL SELECT doc_id, 'probes', -7 * doc_id, s FROM {PROBE_ROWS})"""
ALL_PAGES = f"{BOOKS}, b AS (SELECT * FROM b0)"
LAST_PAGES = f"{BOOKS}, b AS (SELECT max(doc_id) AS doc_id, book, page, arg_max(s, doc_id) AS s FROM b0 GROUP BY book, page)"
_CH = r"regexp_extract(t, '(?i)^Chapter\s+([0-9]+)(?:[.:]\s+.+)?$', 1)"
CHAPTERS = rf"""{_NEXT}, ch AS (SELECT doc_id, book, page, {_CH}::INT AS number, CASE WHEN nx <> '' AND NOT regexp_matches(nx, '^[0-9]+\.[0-9]+') THEN nx END AS title FROM y WHERE {_CH} <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1)"""
_SN = r"regexp_extract(t, '^([0-9]+\.[0-9]+(?:\.[0-9]+)?)(?:\s+(.+))?$', {})"
SECTIONS = rf"""{_NEXT}, s0 AS (SELECT doc_id, book, page, i, {_SN.format(1)} AS number, coalesce(nullif({_SN.format(2)}, ''), CASE WHEN length(nx) >= 3 AND NOT regexp_matches(nx, '^[0-9]+\.') THEN nx END) AS title FROM y WHERE {_SN.format(1)} <> ''),
sc AS (SELECT doc_id, book, page, number, regexp_replace(title, '^\.+|\.+$', '', 'g') AS title, length(number) - length(replace(number, '.', '')) AS depth FROM s0 WHERE NOT coalesce(regexp_matches(title, '(?i)^(Chapter|Page|[0-9]+)$'), false) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1)"""
_head = "array_to_string(string_split(s, chr(10))[1:20], chr(10))"
_kinds = [("practice", r"Chapter\s+[0-9]+\s+Practice\s+Exercises?"), ("practice", r"Practice\s+Problems?"), ("practice", r"Chapter\s+Exercises?"), ("practice", r"Exercises?\s*$"), ("practice", r"Problems?\s*$"), ("solutions", r"Chapter\s+[0-9]+\s+Exercise\s+Solutions?"), ("solutions", r"Solutions?\s+to\s+Exercises?"), ("solutions", r"Answer\s+Key"), ("summary", r"Chapter\s+[0-9]+\s+Summary"), ("summary", r"Chapter\s+Review"), ("review", r"Chapter\s+[0-9]+\s+Review"), ("review", r"Review\s+Questions?")]
_case = lambda value: "CASE " + " ".join(f"WHEN regexp_matches(h, '(?im){p}') THEN {value(k, p)}" for k, p in _kinds) + " END"
SPECIALS = f"sp AS (SELECT doc_id, book, page, {_case(lambda k, p: repr(k))} AS type, {_case(lambda k, p: f'regexp_extract(h, {chr(39)}(?im){p}{chr(39)})')} AS title FROM (SELECT *, {_head} AS h FROM b))"
_ln = "string_split(s, chr(10))"
_ct = lambda p: f"len(list_filter({_ln}, lambda x: regexp_matches(x, '{p}')))"
_solid5 = rf"list_filter({_ln}, lambda x: regexp_matches(x, '\S'))"
SIGNALS = rf"""g AS (SELECT doc_id, book, page, contains(lower(s), 'contents') AS toc_word, {_ct(r'(?:\.\s*){3,}.*\b[0-9]+\s*$')} AS dot_leaders, {_ct(r'^\s*[0-9]+(\.[0-9]+){1,3}\s*$')} AS bare_numbers, {_ct(r'\S\s+[0-9]{1,4}\s*$')} AS page_ends,
 contains(lower(array_to_string({_solid5}[1:5], chr(10))), 'index') AS index_word, {hits('s', r'\b[0-9]{1,4}(?:\s*[,–—-]\s*[0-9]{1,4})+')} AS page_lists,
 len(list_filter({_ln}, lambda x: length(trim(x)) < 80 AND regexp_matches(lower(x), 'practice (exercises|problems|questions)|review (questions|problems|exercises)|self-test (questions|problems)|homework (problems|questions|exercises)|study questions|discussion questions|comprehension questions|conceptual questions|worked examples|exercises|problems'))) > 0 AS practice_word,
 {_ct(r'^\s*[0-9]+\.\s')} AS questions, {_ct(r'^\s*\(?[A-E]\)?[.)]\s')} AS options, regexp_matches(lower(s), 'preface|acknowledge?ments|copyright|isbn|all rights reserved|published by|foreword|about the authors?|dedication') AS front_word,
 len({words('s')}) AS words, length({strip('s')}) AS chars, {hits('s', r'[a-zA-Z]{2}[.!?]\s')} AS sentences,
 round(coalesce(list_sum(list_transform({_solid5}, lambda x: length(x))) / len({_solid5}), 0.0), 1) AS line_length, round({hits('s', '[.!?;:]')} / greatest(length(s), 1), 4) AS stops FROM b)"""
_p = lambda c, v: f"CASE WHEN {c} THEN {v}::DOUBLE ELSE 0.0 END"
CLASSES = f"""{SIGNALS}, k0 AS (SELECT *, {_p('toc_word', .5)} + {_p('dot_leaders >= 5', .4)} + {_p('bare_numbers >= 6', .2)} + {_p('page_ends >= 5', .15)} AS toc,
 {_p('index_word', .4)} + {_p('page_lists >= 5', .4)} + {_p('dot_leaders >= 5', .2)} + {_p('stops < 0.01 AND words > 100', .1)} AS idx, {_p('practice_word', .45)} + {_p('questions >= 3', .35)} + {_p('options >= 4', .25)} AS prac FROM g),
k1 AS (SELECT doc_id, book, page, CASE WHEN words < 40 OR chars < 200 THEN ['blankish', '0.95'] WHEN round(toc, 6) >= 0.5 THEN ['toc', least(toc, 1.0)::VARCHAR] WHEN round(idx, 6) >= 0.5 THEN ['index', least(idx, 1.0)::VARCHAR] WHEN front_word AND page <= 10 THEN ['front_matter', '0.8']
 WHEN round(prac, 6) >= 0.45 THEN ['practice', least(prac, 1.0)::VARCHAR] WHEN sentences >= 3 AND line_length >= 40 THEN ['content', '0.85'] WHEN words > 100 AND sentences >= 2 THEN ['content', '0.6'] ELSE ['unknown', '0.3'] END AS v FROM k0),
kl AS (SELECT doc_id, book, page, v[1] AS type, round(v[2]::DOUBLE, 3) AS confidence FROM k1), lc AS (SELECT book, page, arg_max(type, doc_id) AS type, arg_max(confidence, doc_id) AS confidence FROM kl GROUP BY book, page)"""
_chunk_pages = "cp AS (SELECT doc_id AS chunk_id, book, page_start + u AS page, u FROM l, (SELECT unnest([0, 1, 2]) AS u))"
_chunks = CHUNKS.removeprefix("WITH ")
_ACCEPT = """, f0 AS (SELECT book, list({'page': page, 'number': number, 'title': title} ORDER BY page, number) AS f FROM ch GROUP BY book),
 ac AS (SELECT book, list_reduce(list_transform(list_prepend({'page': -1, 'number': -1, 'title': ''}, f), lambda x: [x]), lambda a, x: CASE WHEN x[1].number BETWEEN 1 AND 50 AND len(list_filter(a, lambda y: y.number = x[1].number)) = 0 AND (a[-1].page <= 0 OR x[1].page - a[-1].page >= 5) THEN list_concat(a, x) ELSE a END) AS a FROM f0),
 chap AS (SELECT book, u.page AS page, u.number AS number, u.title AS title FROM (SELECT book, unnest(a[2:]) AS u FROM ac))"""
_SCAN = f"{LAST_PAGES}, {CHAPTERS}, {SPECIALS}{_ACCEPT}"
_REASON = rf"""bad AS (SELECT chunk_id, arg_min('page_' || type || '_confidence_' || confidence, cp.page) AS r FROM cp JOIN lc ON cp.book = lc.book AND cp.page = lc.page WHERE type IN ('toc', 'index', 'front_matter', 'blankish') AND confidence >= 0.7 GROUP BY chunk_id),
 rs AS (SELECT doc_id AS chunk_id, l.book, s, coalesce(r, CASE WHEN regexp_matches(s, '(?i)table\s+of\s+contents') THEN 'contains_toc_phrase' WHEN @contents THEN 'looks_like_toc' WHEN {_ct(r'(?:\.\s*){3,}.*\b[0-9]+\s*$')} > 4 THEN 'dot_leader_heavy_' || {_ct(r'(?:\.\s*){3,}.*\b[0-9]+\s*$')} || '_lines'
  WHEN regexp_matches(regexp_extract(s, '^[^\n]*'), '(?:\.\s*){{4,}}') AND len({words('s')}) < 50 THEN 'dot_padded_title_no_content' END) AS reason FROM l LEFT JOIN bad ON chunk_id = doc_id)"""
_toc = _TEXT_SQL["looks_like_toc"].split(" SELECT doc_id, ")[1].removesuffix(" AS value FROM l")
_reasons = f"{ALL_PAGES}, {CLASSES}, {_chunks}, {_chunk_pages}, {_REASON.replace('@contents', _toc)}"
_line = lambda sql: f"{PROBE_LINES} {sql}"
_t = f"(SELECT *, {strip('s')} AS t FROM l)"
_toc_rows = [r"(?i)Chapter\s+([0-9]+)[:\-\s]*([^.]*?)\.+\s*([0-9]+)", r"(?i)^([0-9]+)[.\s]+([A-Z][^.]*?)\.+\s*([0-9]+)", r"(?i)^([0-9]+)\s+([A-Z][^0-9]*?)\s+([0-9]+)$"]
_pick = lambda rows, value: "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {value(p)}" for p in rows) + " END"
_mention = [r"(?i)Chapter\s+([0-9]+)", r"(?i)^([0-9]+)\.\s+[A-Z][a-z]+", r"(?i)^([0-9]+)\s+[A-Z][A-Z\s]+$"]
_numbered = [r"^((?:[0-9]+\.)+[0-9]+)\s+(.+?)$", r"^((?:[0-9]+\.)+[0-9]+)\.\s+(.+?)$", r"^Section\s+((?:[0-9]+\.)+[0-9]+)\s*[:\-–—]\s*(.+?)$", r"^§\s*((?:[0-9]+\.)+[0-9]+)\s+(.+?)$", r"^([A-Z])\.\s+([A-Z][^.]{5,})$"]
_headings = [r"(?i)^Chapter\s+([0-9]+)\s*[:\-–—]\s*(.+?)$", r"(?i)^Chapter\s+([0-9]+)\s*()$", r"(?i)^Chapter\s+(One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|Eleven|Twelve)\s*[:\-–—]\s*(.+?)$", r"(?i)^Ch\.?\s+([0-9]+)\s*[:\-–—]\s*(.+?)$"]
ORACLE_SQL = {
    "has_chapter": f"{LINES} SELECT doc_id, pos, {_re(P.CHAPTER)} AS value FROM l",
    "has_section": f"{LINES} SELECT doc_id, pos, {_re(P.SECTION)} AS value FROM l",
    "has_question": f"{LINES} SELECT doc_id, pos, {_re(P.EXERCISES)} AS value FROM l",
    "has_answer": _line(r"SELECT doc_id, pos, regexp_matches(s, '(?i)Chapter\s+[0-9]+\s+(Exercise\s+)?Solutions|^(Solutions|Answers)\s*$|Solutions?\s+to\s+(Exercises|Problems|Questions)|Answer\s+Key|Selected\s+(Answers|Solutions)') AS value FROM l"),
    "detect_special_page_type": f"{ALL_PAGES}, {SPECIALS} SELECT doc_id, type, title FROM sp WHERE type IS NOT NULL",
    "detect_chapter_at_page_start": f"{ALL_PAGES}, {CHAPTERS} SELECT doc_id, number, title FROM ch",
    "detect_section_at_page_start": f"{ALL_PAGES}, {SECTIONS} SELECT doc_id, number, title, depth FROM sc",
    "find_sections": _line(f"SELECT doc_id, pos, number, trim(title) AS title, length(number) - length(replace(number, '.', '')) + 1 AS level FROM (SELECT doc_id, pos, {_pick(_numbered, lambda p: f'regexp_extract(t, {chr(39)}{p}{chr(39)}, 1)')} AS number, {_pick(_numbered, lambda p: f'regexp_extract(t, {chr(39)}{p}{chr(39)}, 2)')} AS title FROM {_t}) WHERE number IS NOT NULL"),
    "parse_toc_line": _line(f"SELECT doc_id, pos, {_pick(_toc_rows, lambda p: f'regexp_extract(t, {chr(39)}{p}{chr(39)}, 1)::INT')} AS chapter, regexp_replace(regexp_replace({_pick(_toc_rows, lambda p: f'regexp_extract(t, {chr(39)}{p}{chr(39)}, 2)')}, '{chr(92)}s+', ' ', 'g'), '^[. {chr(92)}-:]+|[. {chr(92)}-:]+$', '', 'g') AS title, {_pick(_toc_rows, lambda p: f'regexp_extract(t, {chr(39)}{p}{chr(39)}, 3)')} AS page FROM {_t} WHERE page IS NOT NULL"),
    "detect_chapter": _line(f"SELECT doc_id, pos, {_pick(_mention, lambda p: f'regexp_extract(t, {chr(39)}{p}{chr(39)}, 1)::INT')} AS number, trim(nullif(regexp_extract(t, '(?i)Chapter{chr(92)}s+[0-9]+[{chr(92)}s{chr(92)}-:]*(.+?)$', 1), '')) AS title FROM {_t} WHERE number IS NOT NULL"),
    "find_chapters": _line(f"SELECT doc_id, pos, coalesce(try_cast(n AS INT), list_position(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve'], lower(n))) AS number, trim(v) AS title FROM (SELECT doc_id, pos, {_pick(_headings, lambda p: f'regexp_extract(t, {chr(39)}{p}{chr(39)}, 1)')} AS n, {_pick(_headings, lambda p: f'regexp_extract(t, {chr(39)}{p}{chr(39)}, 2)')} AS v FROM {_t}) WHERE n IS NOT NULL"),
    "extract_detected_numbers": rf"{ALL_PAGES} SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(s, '\b([0-9]+(?:\.[0-9]+){{1,3}})\b', 1))), ',') AS sections, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(s, '(?i)Chapter\s+([0-9]+)', 1), lambda x: x::INT))), ',') AS chapters FROM b",
    "compute_signals": f"{ALL_PAGES}, {SIGNALS} SELECT * EXCLUDE (book, page) FROM g",
    "classify_page": f"{ALL_PAGES}, {CLASSES} SELECT * FROM kl",
    "classify_pagerecords": f"{ALL_PAGES}, {CLASSES} SELECT type, count(*) AS pages, round(avg(confidence), 4) AS confidence FROM kl GROUP BY type",
    "load_page_classifications": f"{ALL_PAGES}, {CLASSES} SELECT * FROM lc",
    "get_page_types_in_range": f"{ALL_PAGES}, {CLASSES}, {_chunks}, {_chunk_pages} SELECT chunk_id, string_agg(CASE WHEN type IS NULL THEN 'unknown' WHEN type IN ('toc', 'index', 'front_matter', 'blankish') AND confidence < 0.7 THEN 'content' ELSE type END, ',' ORDER BY u) AS types FROM cp LEFT JOIN lc ON cp.book = lc.book AND cp.page = lc.page GROUP BY chunk_id",
    "scan_pagerecords_for_chapters": f"{_SCAN}, sa AS (SELECT s.book, c.number, s.type FROM (SELECT * FROM sp WHERE type IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM ch)) s ASOF JOIN chap c ON s.book = c.book AND s.page >= c.page), n AS (SELECT book, number, count(*) AS k, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM sa GROUP BY book, number) SELECT chap.book, chap.number, page, title, coalesce(k, 0) AS special_pages, coalesce(types, '') AS special_types FROM chap LEFT JOIN n ON chap.book = n.book AND chap.number = n.number",
    "scan_pagerecords_for_sections": f"{LAST_PAGES}, {SECTIONS}, f AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY book, number ORDER BY page) = 1), z AS (SELECT book, max(page) AS last_page FROM b GROUP BY book) SELECT f.book, number, title, depth, split_part(number, '.', 1)::INT AS chapter, page AS page_start, coalesce(lead(page) OVER (PARTITION BY f.book ORDER BY page, number) - 1, last_page) AS page_end FROM f JOIN z ON f.book = z.book",
    "get_chapter_id": f"{_SCAN}, p AS (SELECT DISTINCT book, page FROM b) SELECT p.book, p.page, 'ch' || lpad(coalesce(number, 0)::VARCHAR, 2, '0') AS chapter_id FROM p ASOF LEFT JOIN chap ON p.book = chap.book AND p.page >= chap.page",
    "group_sections_per_page": rf"{ALL_PAGES} SELECT doc_id, regexp_matches(lower(s), 'practice (exercises|problems|questions)|review (questions|problems|exercises)|self[- ]test (questions|problems)|homework (problems|questions|exercises)|end of chapter (exercises|problems)|chapter exercises|suggested (exercises|problems)|worked examples|(study|discussion|comprehension|conceptual|thought) questions') OR regexp_matches(s, '(?im)^(Exercises?|Problems?|Questions?)\s*$') AS practice, regexp_matches(lower(s), 'exercise solutions|answer key|solutions? to (exercises|problems)|selected (answers|solutions)|answers to (exercises|problems|questions)|hints and solutions|(solutions|answers) to (selected|odd-numbered)|solutions manual') OR regexp_matches(s, '(?im)^(Solutions?|Answers?)\s*$') AS solutions FROM b",
    "build_lookup_from_pages": f"{ALL_PAGES} SELECT * FROM (SELECT doc_id, book, page, CASE WHEN contains(lower(s), 'practice exercises') THEN 'practice' WHEN contains(lower(s), 'solutions') THEN 'solutions' END AS label FROM b) WHERE label IS NOT NULL",
    "check_filters": f"{_reasons} SELECT chunk_id, reason FROM rs",
}
