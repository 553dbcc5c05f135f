"""Queries of single text functions over all lines of the corpus, and over whole chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables

LINES = f"WITH d AS (SELECT doc_id, {tables.AUGMENTED} AS t FROM documents), l AS (SELECT doc_id, unnest(range(len(string_split(t, chr(10))))) AS pos, unnest(string_split(t, chr(10))) AS s FROM d)"
CHUNKS = f"WITH l AS (SELECT doc_id, source AS book, lang AS section, doc_id % 12 + 1 AS chapter, doc_id % 400 + 1 AS page_start, doc_id % 400 + 1 + n_chars // 2000 AS page_end, {tables.AUGMENTED} AS s FROM documents)"

_words = r"list_filter(regexp_split_to_array({s}, '\s+'), lambda w: w <> '')"
WORDS = _words.format(s="s")
_count = lambda p, s="s": f"len(regexp_extract_all({s}, '{p}'))"
_list = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
SQUEEZE = r"trim(regexp_replace(s, '\s+', ' ', 'g'))"


def _noise(s="s"):
    return rf"(length(trim({s})) < 10 OR regexp_matches(lower(trim({s})), '^({T.any_of(T.STRUCTURAL_PREFIXES)})[ :]|\b(chapter|section|figure|table)\s+\d+'))"


def _exercise(s="s"):
    return f"({s} = '' OR regexp_matches(lower(trim({s})), '{T.any_of(T.EXERCISE_PHRASES)}'))"


def _reference(s="s"):
    return (
        rf"(length(trim({s})) >= 15 AND (regexp_matches(lower(trim({s})), '{T.any_of(T.REFERENCE_PATTERNS)}') OR ({_count(',', s)} >= 4 AND len({_words.format(s=s)}) < 15)"
        rf" OR (regexp_matches({s}, '\d{{4}}\s*[,.]') AND {_count(chr(92) + 'd{4}', s)} >= 2)))"
    )


def _ratio(s="s"):
    tokens = f"regexp_extract_all(lower({s}), '[a-z]+')"
    return f"(CASE WHEN len({tokens}) > 0 THEN len(list_filter({tokens}, lambda t: NOT list_contains({_list(T.CONTENT_STOPWORDS)}, t) AND length(t) > 1)) / len({tokens}) ELSE 0.0 END)"


def _overload(s="s"):
    solid = f"length(regexp_replace({s}, '[ \n]', '', 'g'))"
    return f"(CASE WHEN {solid} > 0 THEN {_count('[0-9]', s)} / {solid} > 0.12 ELSE false END)"


def _defines(s="s"):
    return f"regexp_matches(lower({s}), '{T.any_of(T.DEFINITION_CUES)}')"


def _short(s="s"):
    return f"(len({_words.format(s=s)}) < 8 AND NOT {_defines(s)})"


def _passes(s):
    return f"(length({s}) >= 20 AND NOT {_noise(s)} AND NOT {_exercise(s)} AND NOT {_reference(s)} AND NOT {_overload(s)} AND {_ratio(s)} > 0.6 AND NOT {_short(s)})"


def _ngrams(s="s"):
    run = lambda n: (
        f"list_transform(list_filter(list_transform(range(1, greatest(len(tk) - {n} + 1, 0) + 1), lambda i: tk[i:i + {n} - 1]), lambda g: NOT list_has_any(g, {_list(T.TERM_STOPWORDS)})), lambda g: array_to_string(g, ' '))"
    )
    return f"list_filter(list_transform([regexp_extract_all(lower({s}), '[a-z]+')], lambda tk: list_concat(list_concat({run(1)}, {run(2)}), {run(3)}))[1], lambda g: length(g) >= 3)"


_symbols = T.CODE_SYMBOLS.replace("'", "''")
_key = r"array_to_string(list_transform(string_split(trim(replace({s}, '§', '')), '.'), lambda p: coalesce(try_cast(p AS INT), 999)), '.')"

#: name: (Column function, the same in SQL), over each line s.
LINE_FUNCTIONS = {
    "normalize_ws": (T.squeeze, SQUEEZE),
    "word_count": (T.word_count, f"len({WORDS})"),
    "is_structural_noise": (T.structural_noise, _noise()),
    "is_exercise_prompt": (T.exercise_prompt, _exercise()),
    "is_reference_line": (T.reference_line, _reference()),
    "content_ratio": (lambda s: F.round(T.content_ratio(s), 9), f"round({_ratio()}, 9)"),
    "numeric_overload": (T.numeric_overload, _overload()),
    "too_short": (T.too_short, _short()),
    "passes_quality_filters": (T.passes_quality, _passes(SQUEEZE)),
    "is_summary_type_question": (T.summary_question, f"regexp_matches(lower(trim(s)), '{T.any_of(T.SUMMARY_PHRASES)}')"),
    "is_definition_question": (T.definition_question, r"regexp_matches(trim(s), '(?i)^(?:what\s+is|what\s+are|define|explain|describe)\b')"),
    "is_comparison_question": (T.comparison_question, r"regexp_matches(s, '(?i)\b(?:compare|comparing|comparison|difference|differences|differ|vs\.?|versus|distinguish|contrast)\b')"),
    "tokenize_simple": (lambda s: F.array_join(T.simple_tokens(s), " "), "array_to_string(list_sort(list_distinct(regexp_extract_all(lower(s), '[a-z0-9_]+'))), ' ')"),
    "tokenize_index": (lambda s: F.array_join(T.index_tokens(s), " "), f"array_to_string(list_concat(regexp_extract_all(lower(s), '[a-z0-9_]+'), regexp_extract_all(s, '{_symbols}')), ' ')"),
    "extract_ngrams": (lambda s: F.array_join(T.term_ngrams(s), ","), f"array_to_string({_ngrams()}, ',')"),
    "clean_section_title": (
        T.clean_title,
        r"coalesce(nullif(regexp_replace(trim(regexp_replace(s, '(?s)(?:\.\s*){4,}.*$', '')), '[. ]+$', ''), ''), s)",
    ),
    "parse_page": (lambda s: T.page_number(F.regexp_extract(s, r"(\d+)$", 1)), r"greatest(coalesce(try_cast(regexp_extract(s, '(\d+)$', 1) AS INT), 0), 0)"),
    "truncate_definition": (T.first_words, f"array_to_string({WORDS}[1:28], ' ')"),
    "make_concept_id": (T.digest_id, "substr(sha256(lower(trim(s))), 1, 16)"),
    "section_sort_key": (
        lambda s: F.array_join(T.section_key(F.regexp_extract(s, r"^(\S*)", 1)).cast("array<string>"), "."),
        _key.format(s=r"regexp_extract(s, '^(\S*)', 1)"),
    ),
    "has_definition_cue": (T.defines, _defines()),
}

_solid = "list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_n = lambda p: f"len(list_filter({_solid}, lambda x: regexp_matches(x, '{p}')))"
_sent = "list_filter(list_transform(regexp_split_to_array(trim(s), '[.!?]+'), lambda x: trim(x)), lambda x: x <> '')"
_mean = f"(list_sum(list_transform({_sent}, lambda x: len({_words.format(s='x')}))) / len({_sent}))"
_structural = rf"""(trim(s) = '' OR (
  ({_count('[.]{4,}|[.]' + chr(92) + 's+[.]' + chr(92) + 's+[.]', 'trim(s)')} > 3)::INT
  + coalesce({_n('.' + chr(92) + 's*[0-9]+$|' + chr(92) + 's[0-9]{1,4}$')} / len({_solid}) > 0.30, false)::INT
  + ({_count('[0-9]', 'trim(s)')} / greatest(length(regexp_replace(trim(s), '[ \n]', '', 'g')), 1) > 0.12)::INT
  + coalesce({_mean} < 8 AND len(list_filter({_solid}, lambda x: len({_words.format(s='x')}) < 6)) >= greatest(2.0, len({_solid}) * 0.4), false)::INT) >= 2)"""

CHUNK_FUNCTIONS = {
    "looks_like_toc": (
        T.looks_like_contents,
        rf"({_n('(?:[.]' + chr(92) + 's*){3,}.*' + chr(92) + 'b' + chr(92) + 'd+' + chr(92) + 's*$|(?:[.]' + chr(92) + 's*){4,}' + chr(92) + 's*$')} >= 5 OR {_n('^' + chr(92) + 'd+(?:[.]' + chr(92) + 'd+)+' + chr(92) + 's+.*' + chr(92) + 'b' + chr(92) + 'd+' + chr(92) + 's*$')} >= 5 OR {_n('^' + chr(92) + 'd+(?:[.]' + chr(92) + 'd+)+' + chr(92) + 's*$')} >= 8)",
    ),
    "is_structural_chunk": (T.structural_chunk, _structural),
    "is_structural_chunk_strict": (lambda s: T.structural_chunk(s, True), f"({_structural} OR coalesce(len({_sent}) < 2 OR {_mean} < 10, false))"),
    "split_into_paragraphs": (lambda s: F.size(T.paragraphs(s)), r"len(list_filter(list_transform(regexp_split_to_array(s, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> ''))"),
    "split_sentences_long": (
        lambda s: F.array_join(F.transform(T.long_sentences(s), lambda x: F.length(x).cast("string")), ","),
        r"array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(regexp_replace(s, '([.!?])\s+([A-Z])', '\1'||chr(10)||'\2', 'g'), chr(13), '', 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) > 30), lambda x: length(x)), ',')",
    ),
}


def _line_query(fn):
    return lambda spark, d: tables.lines(spark, d).select("doc_id", "pos", fn(F.col("s")).alias("value"))


def _chunk_query(fn):
    return lambda spark, d: tables.chunks(spark, d).select(F.col("chunk_id").alias("doc_id"), fn(F.col("text")).alias("value"))


def make_chunk_id(spark, d):
    c = tables.chunks(spark, d)
    none = F.lit(None).cast("int")
    return c.select(F.col("chunk_id").alias("doc_id"), T.chunk_id(F.col("book"), F.when(F.col("chapter") != 3, F.col("chapter")), F.col("section"), F.col("page_start"), F.col("page_end"), none, F.lit(0)).alias("value"))


def partition_chunks(spark, d):
    """Explanatory and structural chunks of each book; a book without explanatory ones falls back to all of its own."""
    c = tables.chunks(spark, d).select("book", T.structural_chunk(F.col("text")).alias("structural"))
    out = c.groupBy("book").agg(F.count_if(~F.col("structural")).alias("explanatory"), F.count_if("structural").alias("structural"))
    return out.withColumn("used", F.when(F.col("explanatory") > 0, F.col("explanatory")).otherwise(F.col("structural")))


QUERIES = (
    {k: _line_query(f) for k, (f, _) in LINE_FUNCTIONS.items()}
    | {k: _chunk_query(f) for k, (f, _) in CHUNK_FUNCTIONS.items()}
    | {"make_chunk_id": make_chunk_id, "partition_chunks": partition_chunks}
)
ORACLE_SQL = (
    {k: f"{LINES} SELECT doc_id, pos, {sql} AS value FROM l" for k, (_, sql) in LINE_FUNCTIONS.items()}
    | {k: f"{CHUNKS} SELECT doc_id, {sql} AS value FROM l" for k, (_, sql) in CHUNK_FUNCTIONS.items()}
    | {
        "make_chunk_id": f"{CHUNKS} SELECT doc_id, book || '|ch' || CASE WHEN chapter = 3 THEN 'X' ELSE chapter::VARCHAR END || '|sec' || coalesce(nullif(section, ''), 'X') || '|p' || page_start || '-' || page_end || '|i0|s0' AS value FROM l",
        "partition_chunks": f"{CHUNKS}, c AS (SELECT book, {_structural} AS st FROM l), g AS (SELECT book, count(*) FILTER (NOT st) AS explanatory, count(*) FILTER (st) AS structural FROM c GROUP BY book) SELECT *, CASE WHEN explanatory > 0 THEN explanatory ELSE structural END AS used FROM g",
    }
)
