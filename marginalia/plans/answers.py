"""Answers composed from retrieved documents: scored sentences, comparisons, contradictions and the cards made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prose as P
from ..functions import text as T
from ..operators.joins import top_per_group
from ..sources.tables import table
from .prose import strip
from .search import BM25, _RANK, bm25_search

# Signs of code, headings in brackets and words of negation.
SYMBOLS = r"(::|<<|>>|[*&<>{}()\[\]+\-=/])"
BRACKETED = r"(?i)\((?:Section|Chapter|Fig(?:ure)?|Table|Eq(?:uation)?)\s+[\d.]+\)\s*[.!?]?\s*$"
NEGATION_WORDS = ["not", "no", "never", "neither", "nor", "cannot", "n't", "without", "none", "nothing", "nowhere", "hardly", "barely"]
COMPARES = r"(?i)\b(?:compare|comparing|comparison|difference|differences|differ|vs\.?|versus|distinguish|contrast)\b"


def questions(spark, d) -> DataFrame:
    """(q_id, question): benchmark passages asked in three ways, by their ids: for a definition, plainly, and as a comparison of their halves."""
    w = T.words(F.col("text"))
    half = (F.size(w) / 2).cast("int")
    compared = F.concat(F.array_join(F.slice(w, 1, half), " "), F.lit(" versus "), F.array_join(F.slice(w, half + 1, F.size(w)), " "), F.lit("?"))
    asked = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("What is "), "text")).when(F.col("item_id") % 3 == 1, F.col("text")).otherwise(compared)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), asked.alias("question"))


def symbols(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(T.text_or_empty(s), F.lit(SYMBOLS), 1))


def sentence_score(s: Column, tokens: Column, asked: Column, asked_symbols: Column, defines: Column) -> Column:
    """How well a sentence answers: the share of the question's words and signs it has, less for headings and signs, more for a definition if one is asked for; -1 under six words."""
    share = lambda a, b: F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(b)).otherwise(0.0)
    base = share(tokens, asked) + 0.3 * share(symbols(s), asked_symbols)
    plain = T.hits(s, r"[\p{L}\p{N} ]") / F.greatest(F.length(s), F.lit(1)) < 0.70
    worth = base * F.when(s.rlike(BRACKETED), 0.2).otherwise(1.0) * F.when(plain, 0.5).otherwise(1.0)
    low = F.lower(s)
    bonus = F.when(defines, F.when(low.rlike(" is | are "), 0.15).otherwise(0.0) + F.when(low.contains("defined as"), 0.20).otherwise(0.0)).otherwise(0.0)
    return F.when(T.word_count(s) < 6, -1.0).otherwise(worth + bonus)


def candidates(spark, d) -> DataFrame:
    """(q_id, rank, doc, book, i, s, tokens, question, asked): the lines and sentences of 20 characters or more of each question's first three documents."""
    top = bm25_search(spark, d).where("rank <= 3").select("q_id", "rank", "doc")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("book"), "text")
    lines = F.filter(F.transform(F.flatten(F.transform(F.split("text", r"(?<=[.!?])\s+(?=[A-Z])"), lambda x: F.split(x, "\n"))), P.trimmed), lambda x: F.length(x) >= 20)
    rows = docs.join(top, "doc").select("q_id", "rank", "doc", "book", F.posexplode(lines).alias("i", "s")).join(questions(spark, d), "q_id")
    return rows.select("*", T.simple_tokens(F.col("s")).alias("tokens"), T.simple_tokens(F.col("question")).alias("asked"))


def scored(spark, d) -> DataFrame:
    rows = candidates(spark, d)
    value = sentence_score(F.col("s"), F.col("tokens"), F.col("asked"), symbols(F.col("question")), T.definition_question(F.col("question")))
    return rows.withColumn("score", F.round(value + 1e-9, 6))


def score_answer_sentence(spark, d):
    return scored(spark, d).select("q_id", "rank", "i", "score")


def selected(spark, d) -> DataFrame:
    """The four best sentences of a question, at most two of a document, with a score over 0; the best one alone where none has."""
    rows = scored(spark, d)
    fit = top_per_group(rows.where("score > 0"), ["q_id", "rank"], [F.desc("score"), F.col("i")], 2, "in_doc")
    good = top_per_group(fit, ["q_id"], [F.desc("score"), F.col("rank"), F.col("i")], 4, "place")
    alone = top_per_group(rows.where("score > -1").join(good.select("q_id").distinct(), "q_id", "left_anti"), ["q_id"], [F.desc("score"), F.col("rank"), F.col("i")], 1, "place")
    return good.drop("in_doc").unionByName(alone)


def _evidence(rows: DataFrame) -> DataFrame:
    """(q_id, n, coverage, books, redundancy, contradiction, level, picks) of each question's picked sentences; they are few."""
    pick = F.struct("rank", F.col("place").alias("k"), "s", "tokens", "asked", "book")
    g = rows.groupBy("q_id").agg(F.avg("score").alias("coverage"), F.count_distinct("book").alias("books"), F.array_sort(F.collect_list(pick)).alias("picks"), F.count("*").alias("n"))
    pairs = F.flatten(F.transform("picks", lambda a, i: F.transform(F.slice("picks", i + 2, F.size("picks")), lambda b: F.struct(a["tokens"].alias("x"), b["tokens"].alias("y"), a["asked"].alias("q")))))
    alike = F.transform(F.filter(pairs, lambda p: F.size(F.array_union(p["x"], p["y"])) > 0), lambda p: F.size(F.array_intersect(p["x"], p["y"])) / F.size(F.array_union(p["x"], p["y"])))
    negated = lambda t: F.arrays_overlap(t, F.array(*map(F.lit, NEGATION_WORDS)))
    both = lambda a, b: F.size(F.array_intersect(a, b))
    against = F.exists(pairs, lambda p: (both(p["x"], p["q"]) >= 2) & (both(p["y"], p["q"]) >= 2) & (both(p["x"], p["y"]) >= 3) & (negated(p["x"]) != negated(p["y"])))
    mean = F.when(F.size(alike) > 0, F.aggregate(alike, F.lit(0.0), lambda a, x: a + x) / F.size(alike)).otherwise(0.0)
    out = g.select("q_id", "n", F.round(F.col("coverage") + 1e-9, 3).alias("coverage"), "books", F.round(mean + 1e-9, 3).alias("redundancy"), against.alias("contradiction"), "picks")
    level = F.when((F.col("coverage") >= 0.3) & (F.col("books") >= 2) & ~F.col("contradiction"), "high").when((F.col("coverage") >= 0.15) & ~F.col("contradiction"), "medium").otherwise("low")
    return out.withColumn("level", level)


def compose_answer(spark, d):
    """The answer of each question: its sentences in order of their documents, with coverage, diversity, redundancy, contradiction and a level of confidence."""
    text = F.array_join(F.transform("picks", lambda p: F.concat(F.regexp_replace(p["s"], r"\.+$", ""), F.lit("."))), "  ")
    return _evidence(selected(spark, d)).select("q_id", "n", "coverage", "books", "redundancy", "contradiction", "level", F.md5(text).alias("answer"))


def detect_contradiction(spark, d):
    return _evidence(selected(spark, d)).select("q_id", "contradiction")


def extract_cited_books(spark, d):
    """The books that a question's documents come from."""
    return candidates(spark, d).groupBy("q_id").agg(F.array_join(F.array_sort(F.collect_set("book")), ",").alias("books"))


def extract_cited_chunks(spark, d):
    """Each question's documents in order of rank, each once."""
    return bm25_search(spark, d).groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"].cast("string")), ",").alias("docs"))


def _sides(spark, d) -> DataFrame:
    """The two best sentences for either half of a comparison: those that share more words with it, two at least."""
    parts = F.filter(F.transform(F.split("question", COMPARES), F.trim), lambda x: x != "")
    a = F.trim(F.regexp_replace(F.element_at(parts, 1), r"(?i)^(?:what|how|why|when|where)\s+(?:is|are|do|does)\s+(?:the\s+)?", ""))
    b = F.trim(F.regexp_replace(F.element_at(parts, -1), r"\?+$", ""))
    rows = candidates(spark, d).where(T.comparison_question(F.col("question"))).withColumn("parts", F.size(parts)).where("parts >= 2").withColumn("a", a).withColumn("b", b).where("a <> '' and b <> ''")
    rows = rows.withColumn("ta", T.simple_tokens(F.col("a"))).withColumn("tb", T.simple_tokens(F.col("b")))
    na, nb = F.size(F.array_intersect("tokens", "ta")), F.size(F.array_intersect("tokens", "tb"))
    side = F.when((na > nb) & (na >= 2), "a").when((nb > na) & (nb >= 2), "b")
    sided = rows.withColumn("side", side).where("side is not null")
    value = sentence_score(F.col("s"), F.col("tokens"), F.when(F.col("side") == "a", F.col("ta")).otherwise(F.col("tb")), symbols(F.col("question")), F.lit(False))
    return top_per_group(sided.withColumn("score", F.round(value + 1e-9, 6)), ["q_id", "side"], [F.desc("score"), F.col("rank"), F.col("i")], 2, "place")


def compose_comparison(spark, d):
    """Comparisons: how many sentences speak for either side, their coverage and books, and the first of each."""
    g = _sides(spark, d).groupBy("q_id").agg(
        F.count_if(F.col("side") == "a").alias("for_a"), F.count_if(F.col("side") == "b").alias("for_b"), F.round(F.avg("score") + 1e-9, 3).alias("coverage"), F.count_distinct("book").alias("books"),
        F.md5(F.min(F.when((F.col("side") == "a") & (F.col("place") == 1), F.col("s")))).alias("first_a"), F.md5(F.min(F.when((F.col("side") == "b") & (F.col("place") == 1), F.col("s")))).alias("first_b"),
    )
    return g


def card_id(prompt: Column, ids: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lower(F.trim(prompt)), F.lit("|"), F.array_join(F.array_sort(ids), "|")), 256), 1, 16)


def generate_cards(spark, d):
    """Cards of each answer, each once: a definition if one was asked for, up to two clozes of its first points, and the question itself."""
    picks = _evidence(selected(spark, d)).join(questions(spark, d), "q_id")
    cited = bm25_search(spark, d).where("rank <= 3").groupBy("q_id").agg(F.array_sort(F.collect_set(F.col("doc").cast("string"))).alias("ids"))
    rows = picks.join(cited, "q_id")
    plain = rows.select("q_id", "ids", F.col("question").alias("prompt"), F.when(T.definition_question(F.col("question")), "definition").otherwise("short_answer").alias("kind"), F.lit(0).alias("o"))
    points = rows.select("q_id", "ids", F.posexplode(F.slice("picks", 1, 2)).alias("k", "p")).select("q_id", "ids", "k", F.col("p.s").alias("s"))
    key = F.regexp_extract("s", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b|\b[A-Z][a-z]{3,}\b|\b[a-z]+(?:[-_][a-z]+)+\b", 0)
    long = F.filter(F.split("s", r"\s+"), lambda w: (F.length(w) >= 5) & w.rlike(r"^\p{L}+$"))
    longest = F.try_element_at(F.filter(long, lambda w: F.length(w) == F.array_max(F.transform(long, F.length))), F.lit(1))
    term = F.coalesce(F.nullif(key, F.lit("")), longest)
    blanked = points.withColumn("term", term).where("term is not null").withColumn("at", F.instr("s", F.col("term")))
    cloze = F.concat(F.substr("s", F.lit(1), F.col("at") - 1), F.lit("______"), F.substr("s", F.col("at") + F.length("term")))
    clozes = blanked.select("q_id", "ids", cloze.alias("prompt"), F.lit("cloze").alias("kind"), (F.col("k") + 1).alias("o"))
    cards = plain.union(clozes).select("q_id", "o", "kind", card_id(F.col("prompt"), F.col("ids")).alias("card_id"))
    return top_per_group(cards, ["q_id", "card_id"], [F.col("o")], 1).select("q_id", "card_id", "kind")


QUERIES = {f.__name__: f for f in (score_answer_sentence, compose_answer, detect_contradiction, extract_cited_books, extract_cited_chunks, compose_comparison, generate_cards)}

_w = r"list_filter(regexp_split_to_array(text, '\s+'), lambda z: z <> '')"
_tk = lambda x: f"list_sort(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9_]+')))"
_sy = lambda x: rf"list_distinct(regexp_extract_all({x}, '(::|<<|>>|[*&<>{{}}()\[\]+\-=/])'))"
_share = lambda a, b: f"CASE WHEN len({b}) > 0 THEN len(list_intersect({a}, {b})) / len({b}) ELSE 0.0 END"


def _score(asked, defines):
    return rf"""round(CASE WHEN len(list_filter(regexp_split_to_array(s, '\s+'), lambda z: z <> '')) < 6 THEN -1.0 ELSE ({_share('tokens', asked)} + 0.3 * {_share('sym', 'qsym')})
 * CASE WHEN regexp_matches(s, '(?i)\((?:Section|Chapter|Fig(?:ure)?|Table|Eq(?:uation)?)\s+[0-9.]+\)\s*[.!?]?\s*$') THEN 0.2 ELSE 1.0 END * CASE WHEN len(regexp_extract_all(s, '[\p{{L}}\p{{N}} ]')) / greatest(length(s), 1) < 0.7 THEN 0.5 ELSE 1.0 END
 + CASE WHEN {defines} THEN CASE WHEN regexp_matches(lower(s), ' is | are ') THEN 0.15 ELSE 0 END + CASE WHEN contains(lower(s), 'defined as') THEN 0.2 ELSE 0 END ELSE 0 END END + 1e-9, 6)"""


ASKED = f"""{BM25}, tp AS ({_RANK.format(t='bm', n=5)}), qs AS (SELECT item_id AS q_id, CASE item_id % 3 WHEN 0 THEN 'What is ' || text WHEN 1 THEN text ELSE array_to_string({_w}[1:len({_w}) // 2], ' ') || ' versus ' || array_to_string({_w}[len({_w}) // 2 + 1:], ' ') || '?' END AS question FROM benchmark),
 dl AS (SELECT doc_id AS doc, source AS book, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(10) || '\\2', 'g'), chr(10)), lambda x: {strip('x')}), lambda x: length(x) >= 20) AS ls FROM documents),
 cn AS (SELECT q_id, rank, doc, book, question, unnest(range(len(ls))) AS i, unnest(ls) AS s FROM tp JOIN dl USING (doc) JOIN qs USING (q_id) WHERE rank <= 3),
 ct AS (SELECT *, {_tk('s')} AS tokens, {_tk('question')} AS asked, {_sy('s')} AS sym, {_sy('question')} AS qsym FROM cn)"""
_isdef = r"regexp_matches(trim(question), '(?i)^(?:what\s+is|what\s+are|define|explain|describe)\b')"
ANSWERED = f"""{ASKED}, sc AS (SELECT *, {_score('asked', _isdef)} AS score FROM ct),
 in_doc AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q_id, rank ORDER BY score DESC, i) <= 2),
 gd AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, rank, i) AS place FROM in_doc QUALIFY place <= 4),
 al AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, rank, i) AS place FROM sc WHERE score > -1 AND q_id NOT IN (SELECT q_id FROM gd) QUALIFY place <= 1), pk AS (SELECT * FROM gd UNION ALL SELECT * FROM al),
 pr AS (SELECT a.q_id, a.tokens AS x, b.tokens AS y, a.asked AS q FROM pk a JOIN pk b ON a.q_id = b.q_id AND a.place < b.place),
 ev AS (SELECT q_id, avg(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))) FILTER (len(x) + len(y) > 0) AS red, bool_or(len(list_intersect(x, q)) >= 2 AND len(list_intersect(y, q)) >= 2 AND len(list_intersect(x, y)) >= 3
   AND list_has_any(x, ['not', 'no', 'never', 'neither', 'nor', 'cannot', 'without', 'none', 'nothing', 'nowhere', 'hardly', 'barely']) <> list_has_any(y, ['not', 'no', 'never', 'neither', 'nor', 'cannot', 'without', 'none', 'nothing', 'nowhere', 'hardly', 'barely'])) AS con FROM pr GROUP BY q_id),
 an AS (SELECT q_id, count(*) AS n, round(avg(score) + 1e-9, 3) AS coverage, count(DISTINCT book) AS books, string_agg(regexp_replace(s, '\\.+$', '') || '.', '  ' ORDER BY rank, place) AS answer FROM pk GROUP BY q_id),
 ax AS (SELECT an.*, round(coalesce(red, 0) + 1e-9, 3) AS redundancy, coalesce(con, false) AS contradiction FROM an LEFT JOIN ev USING (q_id))"""
_prefix = r"(?i)^(?:what|how|why|when|where)\s+(?:is|are|do|does)\s+(?:the\s+)?"
_cmp = r"(?i)\b(?:compare|comparing|comparison|difference|differences|differ|vs\.?|versus|distinguish|contrast)\b"
COMPARED = rf"""{ASKED}, ha AS (SELECT *, list_filter(list_transform(regexp_split_to_array(question, '{_cmp}'), lambda x: trim(x)), lambda x: x <> '') AS hp FROM ct WHERE regexp_matches(question, '{_cmp}')),
 hb AS (SELECT *, {_tk(f"trim(regexp_replace(hp[1], '{_prefix}', ''))")} AS ta, {_tk(r"trim(regexp_replace(hp[-1], '\?+$', ''))")} AS tb FROM ha WHERE len(hp) >= 2),
 hc AS (SELECT *, len(list_intersect(tokens, ta)) AS na, len(list_intersect(tokens, tb)) AS nb FROM hb), hd AS (SELECT *, CASE WHEN na > nb AND na >= 2 THEN 'a' WHEN nb > na AND nb >= 2 THEN 'b' END AS side, CASE WHEN na > nb THEN ta ELSE tb END AS ts FROM hc),
 he AS (SELECT *, {_score('ts', 'false')} AS score FROM hd WHERE side IS NOT NULL), hf AS (SELECT *, row_number() OVER (PARTITION BY q_id, side ORDER BY score DESC, rank, i) AS place FROM he QUALIFY place <= 2)"""
ORACLE_SQL = {
    "score_answer_sentence": f"{ASKED} SELECT q_id, rank, i, {_score('asked', _isdef)} AS score FROM ct",
    "compose_answer": f"{ANSWERED} SELECT q_id, n, coverage, books, redundancy, contradiction, CASE WHEN coverage >= 0.3 AND books >= 2 AND NOT contradiction THEN 'high' WHEN coverage >= 0.15 AND NOT contradiction THEN 'medium' ELSE 'low' END AS level, md5(answer) AS answer FROM ax",
    "detect_contradiction": f"{ANSWERED} SELECT q_id, contradiction FROM ax",
    "extract_cited_books": f"{ASKED} SELECT q_id, array_to_string(list_sort(list(DISTINCT book)), ',') AS books FROM ct GROUP BY q_id",
    "extract_cited_chunks": f"{BM25}, tp AS ({_RANK.format(t='bm', n=5)}) SELECT q_id, string_agg(doc::VARCHAR, ',' ORDER BY rank) AS docs FROM tp GROUP BY q_id",
    "compose_comparison": f"{COMPARED} SELECT q_id, count(*) FILTER (side = 'a') AS for_a, count(*) FILTER (side = 'b') AS for_b, round(avg(score) + 1e-9, 3) AS coverage, count(DISTINCT book) AS books, md5(min(s) FILTER (side = 'a' AND place = 1)) AS first_a, md5(min(s) FILTER (side = 'b' AND place = 1)) AS first_b FROM hf GROUP BY q_id",
    "generate_cards": rf"""{ANSWERED}, ci AS (SELECT q_id, array_to_string(list_sort(list(DISTINCT doc::VARCHAR)), '|') AS ids FROM tp WHERE rank <= 3 GROUP BY q_id),
        c1 AS (SELECT q_id, question AS prompt, CASE WHEN {_isdef} THEN 'definition' ELSE 'short_answer' END AS kind, 0 AS o FROM qs WHERE q_id IN (SELECT q_id FROM pk)),
        pt AS (SELECT q_id, s, row_number() OVER (PARTITION BY q_id ORDER BY rank, place) AS k FROM pk QUALIFY k <= 2),
        tm AS (SELECT q_id, s, k, coalesce(nullif(regexp_extract(s, '(?:^|[^\p{{L}}\p{{N}}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+|[A-Z][a-z]{{3,}}|[a-z]+(?:[-_][a-z]+)+)(?:$|[^\p{{L}}\p{{N}}_])', 1), ''), list_filter(lw, lambda x: length(x) = list_max(list_transform(lw, lambda y: length(y))))[1]) AS term FROM (SELECT *, list_filter(regexp_split_to_array(s, '\s+'), lambda x: length(x) >= 5 AND regexp_matches(x, '^\p{{L}}+$')) AS lw FROM pt)),
        c2 AS (SELECT q_id, substr(s, 1, instr(s, term) - 1) || '______' || substr(s, instr(s, term) + length(term)) AS prompt, 'cloze' AS kind, k AS o FROM tm WHERE term IS NOT NULL),
        c3 AS (SELECT c.q_id, kind, o, substr(sha256(lower(trim(prompt)) || '|' || ids), 1, 16) AS card_id FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2) c JOIN ci USING (q_id)) SELECT q_id, card_id, kind FROM c3 QUALIFY row_number() OVER (PARTITION BY q_id, card_id ORDER BY o) = 1""",
}
