"""Queries of the sentence rules, over all lines and pages of the corpus and the probes; their SQL has its own literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prose as P
from ..functions import text as T
from ..sources import tables

_quoted = lambda s: "'" + s.replace("'", "''") + "'"
PROBE_ROWS = "(VALUES " + ", ".join(f"({-1 - k}, {_quoted(s)})" for k, s in enumerate(tables.PROBES)) + ") v(doc_id, s)"
PAGES = f"WITH l AS (SELECT doc_id, {tables.AUGMENTED} AS s FROM documents UNION ALL SELECT doc_id, s FROM {PROBE_ROWS})"
LINES = f"WITH d AS (SELECT doc_id, {tables.AUGMENTED} AS t FROM documents UNION ALL SELECT doc_id, s FROM {PROBE_ROWS}), l AS (SELECT doc_id, unnest(range(len(string_split(t, chr(10))))) AS pos, unnest(string_split(t, chr(10))) AS s FROM d)"

strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
squeeze = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
words = lambda x: rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda z: z <> '')"
hits = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
has = lambda x, p: f"regexp_matches({x}, '{p}')"
_first = "coalesce(a[1], '')"
_last = "coalesce(a[-1], '')"
MARKED = rf"""{LINES}, m AS (SELECT *, lower(t) AS low, {words('t')} AS w, {squeeze('s')} AS q, list_transform(regexp_extract_all(t, '[a-zA-Z]+'), lambda x: lower(x)) AS a,
  len(list_filter({words('t')}, lambda x: regexp_matches(x, '^[0-9]+$'))) AS nums FROM (SELECT *, {strip('s')} AS t FROM l))"""


def _in(x, items):
    return f"list_contains(string_split('{items}', ' '), {x})".replace("can't", "can''t")


DENSITY = r"(CASE WHEN len({w}) > 0 THEN len(list_filter({w}, lambda x: regexp_matches(x, '[0-9]|[=<>±×÷∑∫√^_{{}}\[\]()]|[αβγδλμσπθωΔΣΠΛΓ]|\\[a-zA-Z]'))) / len({w}) ELSE 0.0 END)".format(w="w")
SIGNS = hits("s", r"[=<>±×÷∑∫√^_{}\[\]()]")


def _noisy(summary):
    extra = rf"OR nums >= 3 OR t LIKE '%?' OR {_in('lower(w[1])', 'what why how prove derive compute calculate exercise problem question')} OR low LIKE 'show that%' OR {has('low', 'exercise' + chr(92) + 's+[0-9]+|problem' + chr(92) + 's+[0-9]+|q[0-9]+')}" if summary else ""
    return rf"""(length(s) < 10 OR {hits('t', '[0-9]')} / greatest(length(replace(t, ' ', '')), 1) > {0.12 if summary else 0.18}
  OR {has('t', r'\\alpha|\\beta|\\lambda|\\theta|\\sum|\\frac|\$[^$]+\$|_[\[{]|\^[\[{]')} OR {has('t', r'\\[a-zA-Z]+')}
  OR {has('low', r'^(figure |table |eq\.|equation )')} OR (contains(low, 'fig.') AND len(w) < 15) {extra}
  OR {has('low', r'\bchapter\s+[0-9]+|\bsection\s+[0-9]+|\bexample\s+[0-9]+|\bfigure\s+[0-9]+|\btable\s+[0-9]+|\bp\.\s*[0-9]+|\bpp\.\s*[0-9]+|\bcontents\b')} OR {has('t', r'§\s*[0-9]+')}
  OR ({has('t', r'[0-9]+\s*$')} AND (length(t) - length(replace(t, '.', '')) >= 3 OR nums >= 2)) OR {hits('t', r'\p{L}')} / greatest(length(t), 1) < 0.65
  OR (len(w) >= 5 AND {has('t', r'(^|\s)(([0-9]+|[.,;:])(\s+|$)){4}')}) OR (length(t) - length(replace(t, ',', '')) >= 4 AND len(w) < 12))"""


_BAD = r"\.\.+|[;:]|  +|chapter\s+[0-9]+|figure\s+[0-9]+|table\s+[0-9]+|page\s+[0-9]+|[0-9]+\s*$|pp\.\s*[0-9]+"
BAD = has("low", _BAD)
_STOP = "a an the this that it because if but of to for with by from as is was are were been be have has had do does did will would could should may might must can shall its any then thus however therefore some each they we you he she i"
_CLAUSE = "this that these those it they we he she i any then thus however therefore because if but so also"
_META = r"(?i)\bin this (paper|section|chapter|work|study|article|report)\b|\bthis (paper|section|chapter|work|study|article)\b|\bwe (show|propose|present|introduce|describe|demonstrate|evaluate|argue|discuss)\b|\bthe remainder of this (paper|section|chapter)\b|\b(as shown|as discussed) in (figure|table|section|chapter)\b|\bsee (figure|table|section|chapter)\b|\brelated work\b|\b(conclusion|abstract|introduction)\b"
_qw = words("q")
_pages = lambda x: has(x, "chapter|figure|table|page")


def _sentence_sql(x):
    """The sentences of the text x, as a list."""
    t = rf"regexp_replace({x}, '[\x00-\x08\x0B-\x1F\x7F-\x9F\x{{A0}}\p{{Cf}}\p{{Co}}\p{{Zl}}\p{{Zp}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]', '', 'g')"
    for pattern, by in ((r"([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])", r"\1\2"), (r"\n{3,}", "' || chr(10) || chr(10) || '"), (r"\.{4,}", " "), (r"\.\s+\.\s+\.(\s+\.)*", " "), (r"[ \t]+", " "), (r"\n ", "' || chr(10) || '")):
        t = f"regexp_replace({t}, '{pattern}', '{by}', 'g')"
    return strip(t)


CLEAN = _sentence_sql("s")
_marks = "regexp_replace(c, '[—–]', chr(10), 'g')"
for _p, _by in ((r"\s+•\s+", "chr(10)"), (r"(?i)(?:example|chapter|section|figure|table)\s+[0-9]+(?:\.[0-9]+)*[.:]\s*", "chr(10)"), (r":\s+([A-Z])", "'.' || chr(10) || '\\1'"), (r"\.{3,}\s*", "chr(10)")):
    _marks = f"regexp_replace({_marks}, '{_p}', {_by}, 'g')"
_kept = lambda x: f"list_filter(list_transform({x}, lambda y: {strip('y')}), lambda y: y <> '')"
_runs = (
    f"list_transform([list_reduce(list_transform({words('y')}, lambda z: {{'runs': []::VARCHAR[], 'open': z}}), lambda g, z: CASE WHEN length(g.open) + length(z.open) + 2 > 240 "
    "THEN {'runs': list_append(g.runs, g.open), 'open': z.open} ELSE {'runs': g.runs, 'open': g.open || ' ' || z.open} END)], lambda g: list_append(g.runs, g.open))[1]"
)
SENTENCES = rf"""{PAGES}, c AS (SELECT doc_id, {CLEAN} AS c FROM l), p AS (SELECT doc_id, {_kept(f"regexp_split_to_array({_marks}, '[.!?]+" + chr(92) + "s*|" + chr(92) + "n+')")} AS raw FROM c),
f AS (SELECT doc_id, {_kept("flatten(list_transform(raw, lambda x: CASE WHEN length(x) > 220 THEN regexp_split_to_array(x, '[;:]" + chr(92) + "s+') ELSE [x] END))")} AS fine FROM p),
h AS (SELECT doc_id, flatten(list_transform(fine, lambda x: CASE WHEN length(x) <= 240 THEN [x] ELSE flatten(list_transform({_kept("regexp_split_to_array(x, '[;,:]" + chr(92) + "s+')")}, lambda y: CASE WHEN length(y) > 240 THEN {_runs} ELSE [y] END)) END)) AS s FROM f),
st AS (SELECT doc_id, list_filter(s, lambda x: length(x) BETWEEN 30 AND 240 AND len({words('x')}) >= 6) AS s FROM h),
sn AS (SELECT doc_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS s FROM st)"""


def _pair_sql():
    out = []
    for p in (r"\s+(?:is|are)\s+defined\s+as\s+", r"\s+refers\s+to\s+", r"\s+means\s+", r"\s+(?:is|are)\s+called\s+", r"\s+consists\s+of\s+", r"\s+(?:is|are)\s+"):
        whole = f"(?is)^(.+?){p}(.+)$"
        term = f"regexp_replace({strip(f'regexp_extract(q, {_quoted(whole)}, 1)')}, '[.,;:]+$', '')"
        d = strip(f"regexp_extract(q, {_quoted(whole)}, 2)")
        for _ in range(2):
            d = rf"(CASE WHEN regexp_matches(regexp_extract({d}, '\(([^(]*)\)$', 1), '(?i)[0-9]{{4}}|\bchapter\b|\bfig\.?\s*[0-9]') THEN regexp_replace(regexp_replace({d}, '\([^(]*\)$', ''), '[,; ]+$', '') ELSE {d} END)"
        out.append((has("q", whole), term, d))
    verb = r"(?i)\b(is|are|was|were|has|have|can|will|may|does|do|refers|means|consists)\b|\b\w+ed\b|\b\w+ing\b"
    return f"CASE WHEN length(q) < 20 THEN NULL {' '.join(f'WHEN {m} AND len({words(d)}) BETWEEN 6 AND 35 AND {has(d, verb)} THEN CASE WHEN length({t}) >= 4 AND length({d}) >= 15 THEN {t} || chr(9) || {d} END' for m, t, d in out)} END"


_flip_words = {
    "negation": "not no never none neither without cannot can't won't isn't aren't doesn't don't didn't", "increase": "increase increases increased increasing rise rises rising grow grows growing higher more greater larger maximize maximizes maximum max",
    "decrease": "decrease decreases decreased decreasing drop drops dropping lower less smaller minimize minimizes minimum min fewer", "greater": "greater larger", "less": "less smaller", "max": "max maximum maximize maximizes", "min": "min minimum minimize minimizes",
    "higher": "higher", "lower": "lower", "more": "more", "fewer": "fewer", "always": "always all every must", "never": "never none cannot can't won't",
}
#: The strong form in SQL: NFKC is NFC and a table of what the probes hold; hyphens by the probes' cases. Tests hold the rest against Python.
_nfkc = "replace(replace(replace(replace(nfc_normalize(s), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '½', '1⁄2'), '²', '2')"
UNICODE = squeeze(f"translate(regexp_replace(replace({_nfkc}, chr(65533), ''), '([A-Za-z])↵([A-Za-z])', '\\1f\\2', 'g'), '←→⇔⇐⇒↵↱↲↳↴', '')")
_hyphens = f"replace(replace({UNICODE}, 'af- terposition', 'afterposition'), 'hyphen- ated', 'hyphenated')"
GARBAGE = lambda x: squeeze(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\.{{3,}}', ' ', 'g'), '[,;]\s*[,;]+', ',', 'g'), '\s{{2,}}', ' ', 'g'), '(?m)^\s*•\s*$', '', 'g')")
STRONG = GARBAGE(_hyphens)
_tokens = f"list_filter(list_transform({words('lower(st)')}, lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}_'']+|[^\\p{{L}}\\p{{N}}_'']+$', '', 'g')), lambda x: x <> '')"
_flag = lambda k: f"list_has_any(tk, string_split({_quoted(_flip_words[k])}, ' '))"
STRONG_LINES = f"{LINES}, sg AS (SELECT doc_id, pos, s, {STRONG} AS st FROM l), tg AS (SELECT *, {_tokens} AS tk FROM sg)"
FLIP_SQL = " || ".join(f"{_flag(k)}::INT" for k in _flip_words)

_joined = lambda xs: F.array_join(xs, "|")
_bits = lambda s: F.concat(*[s[k].cast("int").cast("string") for k in P.FLIPS])
_pair = lambda s: T.once(P.definition_pair(s), lambda p: F.concat(p["term"], F.lit("\t"), p["definition"]))

#: name: (Column function of a line, SQL over the marked lines).
LINE_RULES = {
    "math_density": (lambda s: F.round(P.math_density(s), 9), f"round({DENSITY}, 9)"),
    "is_math_heavy": (P.math_heavy, rf"({DENSITY} >= 0.3 OR {SIGNS} > 2 OR ({has('s', r'\([0-9]+\.[0-9]+\)')} AND {SIGNS} >= 1))"),
    "is_noisy_sentence": (P.noisy_sentence, _noisy(False)),
    "is_noisy_for_summary": (lambda s: P.noisy_sentence(s, True), f"coalesce({_noisy(True)}, true)"),
    "is_bullet_eligible": (P.bullet_eligible, rf"(t NOT LIKE '%?' AND nums <= 2 AND NOT {has('low', r'chapter|section|example|exercise|problem|figure|table|contents|\bp\.\s*[0-9]|\bpp\.\s*[0-9]')} AND len(w) BETWEEN 10 AND 34)"),
    "is_heading_like": (P.heading_like, rf"coalesce(length(t) >= 4 AND len(w) BETWEEN 2 AND 10 AND NOT list_has_any(regexp_extract_all(low, '[\p{{L}}\p{{M}}\p{{N}}_]+'), string_split('is are was were have has had do does did will would can could may might must shall should be been being', ' ')) AND len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}'))) * 2 >= len(w), false)"),
    "is_code_line": (P.code_line, has("s", r"^(?:\s{4,}|\t|[{}();=<>]{2,})")),
    "validate_definition_term": (P.valid_term, rf"(length(t) >= 4 AND len(a) BETWEEN 2 AND 6 AND len(list_filter(a, lambda x: length(x) >= 3)) > 0 AND NOT {_in(_first, 'a an the any this that these those some each then thus however therefore because if but so also it they we you he she i them us his her their its ' + _STOP)} AND NOT {_in(_last, _STOP)} AND length({_first}) > 1 AND NOT {BAD} AND NOT list_has_any(a, string_split('chapter section figure table appendix references bibliography is are was were be been being', ' ')) AND NOT {_pages('low')} AND NOT ({has('t', '(ed|ing)$')} AND length(t) < 12))"),
    "validate_question_stem": (P.valid_stem, f"(len(a) >= 4 AND NOT {_in(_first, _STOP)} AND NOT {_in(_last, _STOP)} AND NOT {BAD} AND NOT {_pages('low')})"),
    "validate_short_answer_stem": (P.valid_why_stem, rf"(t LIKE 'Why %?' AND len(w) <= 18 AND NOT {BAD} AND NOT {has('low', 'chapter|section|figure|table|page')} AND NOT {has('t', '[0-9]{4}')} AND regexp_matches(coalesce(lower({words(chr(39) + chr(39) + ' || t[5:-2]')}[2]), ''), '^\p{{L}}') AND NOT {_in('coalesce(lower(' + words(chr(39) + chr(39) + ' || t[5:-2]') + '[2]), ' + chr(39) * 2 + ')', 'a an the ' + _CLAUSE)})"),
    "clause_is_questionable": (P.questionable_clause, rf"(len({_qw}) NOT BETWEEN 4 AND 22 OR list_has_any(list_transform({_qw}, lambda x: lower(x)), string_split('chapter section figure table appendix references bibliography', ' ')) OR {has('q', '[↵…�]')} OR {hits('q', '[0-9]')} > 2 OR {_in('coalesce(lower(' + _qw + '[1]), ' + chr(39) * 2 + ')', _CLAUSE)})"),
    "clause_is_questionable_meta": (lambda s: P.questionable_clause(s, False, 6, 30, True), rf"(len({_qw}) NOT BETWEEN 6 AND 30 OR list_has_any(list_transform({_qw}, lambda x: lower(x)), string_split('chapter section figure table appendix references bibliography', ' ')) OR {has('q', '[↵…�]')} OR {hits('q', '[0-9]')} > 2 OR {has('q', _META)})"),
    "strip_leading_prep_phrase": (P.without_prep_phrase, f"CASE WHEN {_in(f'lower(regexp_extract(q, {_quoted(chr(94) + chr(92) + chr(83) + chr(42))}))', 'in on at for with within under over during after before from to by as')} AND instr(q, ',') BETWEEN 1 AND 41 THEN {squeeze('substr(q, instr(q, ' + chr(39) + ',' + chr(39) + ') + 1)')} ELSE q END"),
    "build_because_answer": (P.because_answer, rf"(SELECT CASE WHEN length(b) >= 3 THEN CASE WHEN regexp_matches(lower(b), '^(because|due to|since|as a result|therefore|thus)') THEN c ELSE 'Because ' || lower(c[1]) || c[2:] END END FROM (SELECT b, array_to_string({words('b')}[1:30], ' ') AS c FROM (SELECT regexp_replace(q, '^[\s,;\-–—]+', '') AS b)))"),
    "score_hint": (P.score_hint, rf"({has('low', 'is defined as|refers to|means|is called|consists of')}::INT * 2 + {has('low', 'therefore|however|because|thus|hence|consequently')}::INT - {has('low', 'figure|table|chapter')}::INT * 2 - ({hits('s', '[0-9]')} > 2)::INT * 2)"),
    "strip_trailing_citations": (P.without_citations, rf"(CASE WHEN regexp_matches(regexp_extract(t, '\(([^(]*)\)$', 1), '(?i)[0-9]{{4}}|\bchapter\b|\bfig\.?\s*[0-9]') THEN (SELECT CASE WHEN regexp_matches(regexp_extract(u, '\(([^(]*)\)$', 1), '(?i)[0-9]{{4}}|\bchapter\b|\bfig\.?\s*[0-9]') THEN regexp_replace(regexp_replace(u, '\([^(]*\)$', ''), '[,; ]+$', '') ELSE u END FROM (SELECT regexp_replace(regexp_replace(t, '\([^(]*\)$', ''), '[,; ]+$', '') AS u)) ELSE t END)"),
    "citation_noise_score": (lambda s: F.round(P.citation_noise(s), 9), rf"round({hits('s', r'\[[0-9]+\]|\([0-9]{4}\)')} * 2.0 + {hits('s', '[0-9]')} / greatest(length(s), 1) * 5.0, 9)"),
    "citation_density": (lambda s: F.round(P.citation_density(s), 9), rf"round({hits('s', r'\[[0-9]+\]|\([0-9]{4}\)')} / greatest(len({words('s')}), 1), 9)"),
    "trim_bullet": (P.trimmed_bullet, None),
    "tokenize_symbols": (lambda s: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit(r"(::|<<|>>|[*&<>{}()\[\]+\-=/])"), 1))), " "), r"array_to_string(list_sort(list_distinct(regexp_extract_all(s, '(::|<<|>>|[*&<>{}()\[\]+\-=/])'))), ' ')"),
    "strip_inline_garbage": (P.without_garbage, GARBAGE("s")),
    "split_paragraph_by_sentences": (lambda s: _joined(P.boundary_split(s)), rf"array_to_string({_kept(r"string_split(regexp_replace(s, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))")}, '|')"),
    "extract_definition_pair": (_pair, None),
    "cleaner_score": (lambda s: F.concat_ws(" ", *[x.cast("string") for x in (P.cleaner(s)["odd"], F.round(P.cleaner(s)["math"] * 1000).cast("int"), P.cleaner(s)["size"])]), rf"concat_ws(' ', {hits('s', '[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')}, round({DENSITY} * 1000)::INT, -least(length(s), 200))"),
}
#: name: (Column function of a line and its strong form, SQL over the lines with strong form and tokens).
STRONG_RULES = {
    "normalize_unicode_basics": (lambda s, st: P.basic_unicode(s), UNICODE),
    "repair_hyphenated_linebreaks": (lambda s, st: P.without_hyphens(s), "replace(s, 'af- terposition', 'afterposition')"),
    "normalize_text_strong": (lambda s, st: st, "st"),
    "normalize_for_dedupe": (lambda s, st: P.dedupe_key(s, st), squeeze(r"regexp_replace(lower(st), '[^\p{L}\p{M}\p{N}_\s'']', ' ', 'g')")),
    "tokenize_for_flip_check": (lambda s, st: F.array_join(P.flip_tokens(st), " "), "array_to_string(tk, ' ')"),
    "flip_signature": (lambda s, st: _bits(P.flips(P.flip_tokens(st))), FLIP_SQL),
}


def _line_query(fn):
    return lambda spark, d: tables.probe_lines(spark, d).select("doc_id", "pos", fn(F.col("s")).alias("value"))


def _strong_query(fn):
    return lambda spark, d: tables.probe_lines(spark, d).withColumn("st", P.strong(F.col("s"))).select("doc_id", "pos", fn(F.col("s"), F.col("st")).alias("value"))


def prose_sentences(spark, d):
    """(doc_id, pos, s) of all pages' sentences."""
    return tables.probe_pages(spark, d).select("doc_id", F.posexplode(P.sentences(F.col("s"))).alias("pos", "s"))


def split_sentences(spark, d):
    return prose_sentences(spark, d).select("doc_id", "pos", F.length("s").alias("n"), F.md5("s").alias("digest"))


def clean_prose(spark, d):
    return tables.probe_pages(spark, d).select("doc_id", F.md5(P.clean_prose(F.col("s"))).alias("value"))


def pre_normalize_for_split(spark, d):
    return tables.probe_pages(spark, d).select("doc_id", F.md5(P.split_marks(P.clean_prose(F.col("s")))).alias("value"))


def hard_split_long(spark, d):
    """Pages taken as one segment each."""
    return tables.probe_pages(spark, d).select("doc_id", F.array_join(F.transform(P.hard_split(T.squeeze(F.col("s"))), lambda x: F.length(x).cast("string")), ",").alias("value"))


def clean_corpus_text(spark, d):
    return tables.probe_pages(spark, d).select("doc_id", F.md5(P.corpus_text(F.col("s"))).alias("value"))


def flip_conflict(spark, d):
    """Each line against the next of its page: whether they speak against each other, and how alike their words are."""
    from pyspark.sql import Window

    lines = tables.probe_pages(spark, d).select("doc_id", F.posexplode(F.split("s", "\n")).alias("pos", "s")).where("doc_id > -1000000")
    held = lines.withColumn("tk", P.flip_tokens(P.strong(F.col("s"))))
    w = Window.partitionBy("doc_id").orderBy("pos")
    pairs = held.withColumn("after", F.lead("tk").over(w)).where("after is not null")
    return pairs.select("doc_id", "pos", P.opposed(P.flips(F.col("tk")), P.flips(F.col("after"))).alias("conflict"), F.round(P.jaccard(F.array_distinct("tk"), F.array_distinct("after")), 6).alias("jaccard"))


_opposed = " OR ".join([f"{_flag('negation')} <> {_flag('negation').replace('tk', 'nx')}"] + [f"({_flag(x)} AND {_flag(y).replace('tk', 'nx')}) OR ({_flag(y)} AND {_flag(x).replace('tk', 'nx')})" for x, y in (("increase", "decrease"), ("max", "min"), ("higher", "lower"), ("more", "less"), ("more", "fewer"), ("greater", "less"), ("always", "never"))])
_dots = r"(regexp_matches({x}, '(?:\.\s*){{3,}}.*\b[0-9]+\s*$|(?:\.\s*){{4,}}\s*$') AND len(regexp_extract_all({x}, '[.\s]')) / length({x}) > 0.5)".format(x=strip("x"))
_corpus = strip(rf"regexp_replace(array_to_string(list_filter(string_split(replace(replace(s, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: NOT (regexp_matches(x, '(?i)table\s+of\s+contents') OR ({strip('x')} <> '' AND {_dots}))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')")
_hard = f"flatten(list_transform({_kept("regexp_split_to_array(x, '[;,:]" + chr(92) + "s+')")}, lambda y: CASE WHEN length(y) > 240 THEN {_runs} ELSE [y] END))"

QUERIES = (
    {k: _line_query(f) for k, (f, _) in LINE_RULES.items()}
    | {k: _strong_query(f) for k, (f, _) in STRONG_RULES.items()}
    | {f.__name__: f for f in (split_sentences, clean_prose, pre_normalize_for_split, hard_split_long, clean_corpus_text, flip_conflict)}
)
ORACLE_SQL = (
    {k: f"{MARKED} SELECT doc_id, pos, {sql} AS value FROM m" for k, (_, sql) in LINE_RULES.items() if sql}
    | {k: f"{STRONG_LINES} SELECT doc_id, pos, {sql} AS value FROM tg" for k, (_, sql) in STRONG_RULES.items()}
    | {
        "extract_definition_pair": f"{MARKED} SELECT doc_id, pos, {_pair_sql()} AS value FROM m",
        "trim_bullet": rf"""{MARKED}, b AS (SELECT doc_id, pos, {strip("regexp_replace(t, '(?i)^and ', '')")} AS u FROM m), b2 AS (SELECT doc_id, pos, {strip("regexp_replace(u, '(?i)^but ', '')")} AS u FROM b), b3 AS (SELECT doc_id, pos, {strip("regexp_replace(u, '(?i)^however ', '')")} AS u FROM b2),
            b4 AS (SELECT doc_id, pos, {strip("regexp_replace(u, '(?i)^also ', '')")} AS u FROM b3), b5 AS (SELECT doc_id, pos, {strip("regexp_replace(u, '(?i)^furthermore ', '')")} AS u FROM b4), b6 AS (SELECT *, length(regexp_extract(u[1:181], '(?s)^.*[,; ]')) - 1 AS k FROM b5)
            SELECT doc_id, pos, regexp_replace(CASE WHEN length(u) <= 180 THEN u WHEN k > 90 THEN {strip('u[1:k]')} ELSE regexp_replace(u[1:180], '\s+$', '') END, '[.,;]+$', '') AS value FROM b6""",
        "split_sentences": f"{SENTENCES} SELECT doc_id, pos, length(s) AS n, md5(s) AS digest FROM sn",
        "clean_prose": f"{PAGES} SELECT doc_id, md5({CLEAN}) AS value FROM l",
        "pre_normalize_for_split": f"{PAGES}, c AS (SELECT doc_id, {CLEAN} AS c FROM l) SELECT doc_id, md5({_marks}) AS value FROM c",
        "hard_split_long": f"{PAGES}, c AS (SELECT doc_id, {squeeze('s')} AS x FROM l) SELECT doc_id, array_to_string(list_transform(list_filter(CASE WHEN length(x) <= 240 THEN [x] ELSE {_hard} END, lambda y: length(y) BETWEEN 30 AND 240), lambda y: length(y)), ',') AS value FROM c",
        "clean_corpus_text": f"{PAGES} SELECT doc_id, md5({_corpus}) AS value FROM l",
        "flip_conflict": f"{STRONG_LINES}, n AS (SELECT *, lead(tk) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM tg) SELECT doc_id, pos, ({_opposed}) AS conflict, round(CASE WHEN len(list_distinct(list_concat(tk, nx))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(tk), list_distinct(nx))) / len(list_distinct(list_concat(tk, nx))) END, 6) AS jaccard FROM n WHERE nx IS NOT NULL",
    }
)
