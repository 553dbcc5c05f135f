"""Queries of concepts, bundles, definitions, summaries and exam questions; each document and probe is a scope of its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import prose as P
from ..functions import text as T
from ..operators import exam as E
from ..operators import notes as N
from ..operators import sentences as S
from ..operators.joins import top_per_group
from ..sources import tables
from .prose import LINE_RULES, SENTENCES, _pair_sql, hits, squeeze, strip, words
from .text import _defines, _exercise, _ngrams, _noise, _overload, _passes, _reference

BY = ["doc_id"]


def prose_sentences(spark, d):
    """(doc_id, pos, s) of all pages' sentences."""
    return S.of_pages(tables.probe_pages(spark, d))


def good(spark, d):
    """(doc_id, pos, s): the sentences of each page that pass the quality filters, squeezed."""
    return S.of_pages(tables.probe_pages(spark, d), good=True)


def pool(spark, d):
    """(doc_id, pos, s): the good sentences of each page, those of equal text once."""
    return good(spark, d).groupBy("doc_id", "s").agg(F.min("pos").alias("pos")).select("doc_id", "pos", "s")


def term_stats_by_scope(spark, d):
    return N.term_stats(good(spark, d), BY, pooled=True)


def sentence_centrality(spark, d):
    return N.centralities(good(spark, d), BY, pooled=True).select("doc_id", "pos", "centrality")


def count_matched_terms(spark, d):
    return N.centralities(good(spark, d), BY, pooled=True).select("doc_id", "pos", "matched")


def get_top_term(spark, d):
    return N.centralities(good(spark, d), BY, pooled=True).select("doc_id", "pos", "top_term")


def build_bundles(spark, d):
    b = N.bundles(good(spark, d), BY, pooled=True)
    return b.select("doc_id", "label", "place", F.array_join("supporting", ",").alias("supporting"), F.size("sentences").alias("n_sentences"), F.md5(F.array_join("sentences", "\n")).alias("digest"))


def select_sentences_across_bundles(spark, d):
    return N.selected(good(spark, d), BY, pooled=True).select("doc_id", "place", F.md5("s").alias("digest"))


def dedupe_sentences(spark, d):
    return N.deduped(prose_sentences(spark, d)).select("doc_id", "pos", F.md5("s").alias("digest"))


def build_candidate_pool(spark, d):
    """Sentences of each page by centrality, then hint, then text: what is asked from."""
    c = N.centralities(N.deduped(good(spark, d), pooled=True), BY, pooled=True, together=True)

    def fold(_, columns):
        ranked = sorted((-c, -hint, s) for c, hint, s in zip(*columns))
        return [(k + 1, -c, -hint, s) for k, (c, hint, s) in enumerate(ranked[:4000])]

    ranked = N.folded(c.select("doc_id", "centrality", P.score_hint(F.col("s")).alias("hint"), "s"), BY, fold, "place int, centrality double, hint int, s string")
    return ranked.select("doc_id", "place", "centrality", "hint", F.md5("s").alias("digest"))


def score_sentence(spark, d):
    """Sentences against the line that a fixed question makes of their document's first sentence: the share of their words in it, more for early ones and definitions."""
    s = prose_sentences(spark, d)
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0))
    asked = s.where("pos = 0").select("doc_id", tokens(F.col("s")).alias("q"))
    own = tokens(F.col("s"))
    value = F.when(F.size(own) > 0, F.size(F.array_intersect(own, "q")) / F.size(own) + 0.15 / (1 + F.col("pos")) + F.when(F.lower("s").rlike("is defined as|refers to|means|denotes"), 0.1).otherwise(0.0)).otherwise(0.0)
    return s.join(asked, "doc_id").select("doc_id", "pos", F.round(value + 1e-9, 6).alias("score"))


def cluster_sentences(spark, d):
    """How many sentences of each document's pool are in each of its themes, largest first."""
    rows = pool(spark, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("r"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = [",".join(map(str, sorted((len(g) for g in N.themes(r)), reverse=True))) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.string())], ["doc_id", "sizes"])

    return rows.mapInArrow(run, "doc_id long, sizes string")


def compose_bulleted_summary(spark, d):
    return N.summaries(N.centralities(N.deduped(prose_sentences(spark, d)), BY, together=True), together=True)


DEFINING = 500_000  # scopes with a definition whose ids are held at once; beyond, the sentences of all are shuffled


def definitions(spark, d, given=None):
    """(doc_id, pos, s, key, term, definition, centrality, score): sentences of the pool that define a fit term, with that term's own score."""
    s, x = F.col("s"), F.col("p")["definition"]
    fit = ~T.structural_noise(x) & ~T.exercise_prompt(x) & ~T.reference_line(x) & P.valid_term(F.col("p")["term"])
    pair = F.when(P.score_hint(s) >= 2, P.definition_pair(s))
    key = F.lower(F.regexp_replace(F.col("p")["term"], r"^\p{Zs}+|\p{Zs}+\z", ""))
    if given is not None:
        return N.scored_keys(given, BY, pair, fit, key, together=True)
    return N.scored_keys(S.of_pages(_of_defining(tables.probe_pages(spark, d), pair, fit), good=True), BY, pair, fit, key)


def _of_defining(pages, pair, fit, most=None):
    """The pages of all scopes in which a sentence defines a fit term: no other scope gives a row, and its sentences needn't meet."""
    most = DEFINING if most is None else most
    some = S.of_pages(pages, good=True, holding=T.DEFINITION_CUES).select("doc_id", pair.alias("p"))
    ids = some.where(F.col("p").isNotNull()).where(fit).select("doc_id").distinct().limit(most + 1).collect()  # at most so many ids
    if len(ids) > most:
        return pages
    held = F.broadcast(pages.sparkSession.createDataFrame([(r["doc_id"],) for r in ids], "held long"))
    return pages.join(held, F.col("doc_id").eqNullSafe(F.col("held")), "left_semi")


def _registry(spark, d, given=None):
    """Of each term of a scope the best definition: the most central, then the shortest of six to 28 words, then the least noisy, then the first."""
    n = T.word_count(F.col("definition"))
    order = [F.desc("fit"), F.desc("centrality"), n, P.citation_noise(F.col("definition")), F.col("pos")]
    return top_per_group(definitions(spark, d, given).withColumn("fit", n.between(6, 28)), ["doc_id", "key"], order, 1)


def extract_definitions(spark, d):
    return _registry(spark, d).select("doc_id", "key", "term", "definition", "centrality", "pos")


def _ordered(spark, d, given=None):
    """The registry's terms by their own score, then their definition's centrality, then name, all falling."""
    return _registry(spark, d, given).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("centrality"), F.desc("key"))))


def registry_terms_ordered_by_centrality(spark, d):
    return _ordered(spark, d).select("doc_id", "place", "key")


def registry_to_card_format(spark, d):
    page = F.expr("pmod(doc_id, 400) + 1").cast("string")
    return _ordered(spark, d).select("doc_id", "place", "term", "definition", page.alias("pages"))


def generate_definitions(spark, d, given=None):
    """Up to five questions of each scope for its registry's terms."""
    asked = _ordered(spark, d, given).withColumn("prompt", F.concat(F.lit("What is "), "term", F.lit("?"))).withColumn("answer", T.first_words(F.col("definition")))
    fit = asked.where(P.valid_stem(F.col("prompt")) & T.word_count(F.col("answer")).between(5, 30))
    return top_per_group(fit, ["doc_id"], [F.col("place")], 5, "n").select("doc_id", "n", "prompt", "answer")


def generate_short_answer(spark, d):
    s = S.of_pages(tables.probe_pages(spark, d), holding=("because", "due to", "since", "therefore", "thus")).where(P.score_hint(F.col("s")) >= 0)
    return N.why_questions(s)


def phrase_frequency(spark, d):
    """How often phrases of one to three words stand in hinted sentences of 12 to 28 words, none of them a function word or next to a form of be."""
    never = "this that the a an it is are was were have has had do does the method way any some each then thus however therefore because if but so also they we you he she i them us his her their its function value method thing stuff part element type form way".split()
    s = pool(spark, d).where(P.score_hint(F.col("s")) >= 1).withColumn("w", F.transform(P.letters_tokens(F.col("s")), F.lower)).where(F.size("w").between(12, 28))
    each = s.select("doc_id", "w", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).select("doc_id", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i"))
    phrase = F.slice("w", F.col("i"), F.col("n"))
    be = lambda x: F.coalesce(x.isin(P.BE_FORMS), F.lit(False))
    before, after = F.when(F.col("i") > 1, F.try_element_at("w", F.col("i") - 1)), F.try_element_at("w", F.col("i") + F.col("n"))
    kept = each.where(~F.exists(phrase, lambda x: x.isin(never)) & ~be(F.try_element_at(phrase, F.lit(-1))) & ~be(before) & ~be(after)).select("doc_id", F.array_join(phrase, " ").alias("phrase"))
    return kept.where(F.length("phrase").between(3, 25)).groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


def generate_tf(spark, d, given=None):
    """Statements to judge: central sentences of 40 to 200 characters with a verb and few citations. The sentence itself is validated, not its label."""
    verb = F.exists(F.regexp_extract_all(F.lower("s"), F.lit(r"[\p{L}\p{M}\p{N}_]+"), 0), lambda w: w.rlike("^(has|have|can|will|may|do|are|were)$|.(ed|ing|s)$"))
    c = N.centralities(good(spark, d) if given is None else given, BY, pooled=True, together=given is not None).where(F.length("s").between(40, 200) & (P.score_hint(F.col("s")) >= -1) & (P.citation_density(F.col("s")) < 0.05) & verb & P.valid_stem(F.col("s")))
    return top_per_group(c, ["doc_id"], [F.desc("centrality"), F.col("s")], 4, "n").select("doc_id", "n", F.concat(F.lit("True or False: "), "s").alias("prompt"))


def generate_list(spark, d, given=None):
    """Questions for the terms that a bundle's label meets."""
    b = N.bundles(good(spark, d) if given is None else given, BY, n_sentences=0, pooled=True, together=given is not None).where(F.size("supporting") >= 2).withColumn("prompt", F.concat(F.lit("List the key aspects of "), F.initcap("label"), F.lit("."))).where(P.valid_stem(F.col("prompt")))
    return top_per_group(b, ["doc_id"], [F.col("place")], 3, "n").select("doc_id", "n", "prompt", F.array_join(F.transform("supporting", lambda t: F.concat(F.lit("- "), t)), "\n").alias("answer"))


def generate_exam_questions(spark, d):
    """An exam of each scope: five definitions, four blanks, four statements, four reasons and three lists; kinds with more to ask fill it up to twenty."""
    return E.exams(good(spark, d), BY)


QUERIES = {f.__name__: f for f in (
    term_stats_by_scope, sentence_centrality, count_matched_terms, get_top_term, build_bundles, select_sentences_across_bundles, dedupe_sentences, build_candidate_pool, score_sentence, cluster_sentences,
    compose_bulleted_summary, extract_definitions, registry_terms_ordered_by_centrality, registry_to_card_format, generate_definitions, generate_short_answer, phrase_frequency, generate_tf, generate_list,
    generate_exam_questions,
)}

POOL = f"{SENTENCES}, q0 AS (SELECT doc_id, pos, {squeeze('s')} AS s FROM sn), pool AS (SELECT doc_id, min(pos) AS pos, s FROM q0 WHERE {_passes('s')} GROUP BY doc_id, s)"
SCORED = f"""{POOL}, ng AS (SELECT doc_id, pos, unnest({_ngrams()}) AS term, unnest(range(len({_ngrams()}))) AS i FROM pool), pr AS (SELECT doc_id, term, count(DISTINCT pos) AS df, count(*) AS tf FROM ng GROUP BY ALL),
 rw AS (SELECT *, df * CASE WHEN len(string_split(term, ' ')) >= 2 THEN 1.0::DOUBLE + 0.3::DOUBLE * (len(string_split(term, ' ')) - 1) ELSE 1.0 END * CASE WHEN df < 2 AND len(string_split(term, ' ')) = 1 THEN 0.5::DOUBLE ELSE 1.0 END AS raw FROM pr),
 ts AS (SELECT doc_id, term, df, tf, round(raw / max(raw) OVER (PARTITION BY doc_id), 9) AS score FROM rw)"""
CENTRAL = f"""{SCORED}, pp AS (SELECT ng.doc_id, ng.pos, sum(score) AS total, count(*) AS matched, max(score) AS best, arg_max(ng.term, (score, -i)) AS top_term FROM ng JOIN ts ON ng.doc_id = ts.doc_id AND ng.term = ts.term GROUP BY ng.doc_id, ng.pos),
 ce AS (SELECT p.doc_id, p.pos, s, coalesce(matched, 0) AS matched, top_term, round(CASE WHEN {_overload()} OR {_noise()} OR total IS NULL THEN 0.0 ELSE total / greatest(len({words('s')}), 1) + CASE WHEN {_defines()} AND best >= 0.3 THEN 0.1::DOUBLE ELSE 0.0 END END + 1e-9, 6) AS centrality FROM pool p LEFT JOIN pp ON p.doc_id = pp.doc_id AND p.pos = pp.pos)"""
BUNDLES = f"""{CENTRAL}, bt AS (SELECT doc_id, term AS label, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS place FROM ts QUALIFY place <= 15), hd AS (SELECT DISTINCT ng.doc_id, ng.pos, term FROM ng JOIN bt ON ng.doc_id = bt.doc_id AND term = label),
 e AS (SELECT a.doc_id, a.term AS label, b.term AS other, count(*) AS n FROM hd a JOIN hd b ON a.doc_id = b.doc_id AND a.pos = b.pos AND a.term <> b.term GROUP BY ALL), sp AS (SELECT doc_id, label, list(other ORDER BY n DESC, other)[1:5] AS sup FROM e GROUP BY ALL),
 tl AS (SELECT doc_id, pos, list(term) AS terms FROM hd GROUP BY ALL), ft AS (SELECT tl.doc_id, tl.pos, hd.term AS label FROM tl JOIN hd ON tl.doc_id = hd.doc_id AND tl.pos = hd.pos LEFT JOIN sp ON sp.doc_id = hd.doc_id AND sp.label = hd.term WHERE sup IS NULL OR list_has_any(terms, sup)),
 ss AS (SELECT ft.doc_id, label, list(s ORDER BY centrality DESC, s, ft.pos)[1:8] AS sents FROM ft JOIN ce ON ft.doc_id = ce.doc_id AND ft.pos = ce.pos GROUP BY ft.doc_id, label),
 bu AS (SELECT bt.doc_id, bt.label, place, coalesce(sup, []) AS sup, coalesce(sents, []) AS sents FROM bt LEFT JOIN sp ON bt.doc_id = sp.doc_id AND bt.label = sp.label LEFT JOIN ss ON bt.doc_id = ss.doc_id AND bt.label = ss.label)"""
_hint = LINE_RULES["score_hint"][1]
_MARKS = f"(SELECT *, {strip('s')} AS t, lower({strip('s')}) AS low, {squeeze('s')} AS q FROM ce)"
_term_marks = f"(SELECT *, {strip('term')} AS t, lower({strip('term')}) AS low, list_transform(regexp_extract_all(term, '[a-zA-Z]+'), lambda x: lower(x)) AS a FROM pd)"
DEFINED = f"""{CENTRAL}, pd0 AS (SELECT *, {_pair_sql()} AS p FROM {_MARKS} WHERE {_hint} >= 2), pd AS (SELECT doc_id, pos, s, centrality, string_split(p, chr(9))[1] AS term, string_split(p, chr(9))[2] AS definition FROM pd0 WHERE p IS NOT NULL),
 df0 AS (SELECT * FROM {_term_marks} WHERE NOT {_noise('definition')} AND NOT {_exercise('definition')} AND NOT {_reference('definition')} AND {LINE_RULES['validate_definition_term'][1]}),
 rg AS (SELECT doc_id, lower(trim(term)) AS key, term, definition, centrality, pos FROM df0 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(trim(term)) ORDER BY len({words('definition')}) BETWEEN 6 AND 28 DESC, centrality DESC, len({words('definition')}),
   {hits('definition', r'\[[0-9]+\]|\([0-9]{4}\)')} * 2.0 + {hits('definition', '[0-9]')} / greatest(length(definition), 1) * 5.0, pos) = 1),
 od AS (SELECT rg.*, row_number() OVER (PARTITION BY rg.doc_id ORDER BY coalesce(score, 0) DESC, centrality DESC, key DESC) AS place FROM rg LEFT JOIN ts ON ts.doc_id = rg.doc_id AND ts.term = key)"""
_never = "this that the a an it is are was were have has had do does method way any some each then thus however therefore because if but so also they we you he she i them us his her their its function value thing stuff part element type form"
_stem = f"(SELECT *, t AS t2, lower(t) AS low, list_transform(regexp_extract_all(t, '[a-zA-Z]+'), lambda x: lower(x)) AS a FROM (SELECT *, {strip('prompt')} AS t FROM pq))"
_stem_ok = LINE_RULES["validate_question_stem"][1]
ORACLE_SQL = {
    "term_stats_by_scope": f"{SCORED} SELECT * FROM ts",
    "sentence_centrality": f"{CENTRAL} SELECT doc_id, pos, centrality FROM ce",
    "count_matched_terms": f"{CENTRAL} SELECT doc_id, pos, matched FROM ce",
    "get_top_term": f"{CENTRAL} SELECT doc_id, pos, top_term FROM ce",
    "build_bundles": f"{BUNDLES} SELECT doc_id, label, place, array_to_string(sup, ',') AS supporting, len(sents) AS n_sentences, md5(array_to_string(sents, chr(10))) AS digest FROM bu",
    "score_sentence": f"{SENTENCES}, tk AS (SELECT doc_id, pos, s, list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')) AS w FROM sn), a AS (SELECT doc_id, w AS q FROM tk WHERE pos = 0) SELECT doc_id, pos, round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, q)) / len(w) + 0.15 / (1 + pos) + CASE WHEN regexp_matches(lower(s), 'is defined as|refers to|means|denotes') THEN 0.1 ELSE 0 END ELSE 0 END + 1e-9, 6) AS score FROM tk JOIN a USING (doc_id)",
    "extract_definitions": f"{DEFINED} SELECT * FROM rg",
    "registry_terms_ordered_by_centrality": f"{DEFINED} SELECT doc_id, place, key FROM od",
    "registry_to_card_format": f"{DEFINED} SELECT doc_id, place, term, definition, (((doc_id % 400) + 400) % 400 + 1)::VARCHAR AS pages FROM od",
    "generate_definitions": f"{DEFINED}, pq AS (SELECT doc_id, place, 'What is ' || term || '?' AS prompt, array_to_string({words('definition')}[1:28], ' ') AS answer FROM od) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n, prompt, answer FROM {_stem} WHERE {_stem_ok} AND len({words('answer')}) BETWEEN 5 AND 30 QUALIFY n <= 5",
    "phrase_frequency": f"""{POOL}, w AS (SELECT doc_id, w FROM (SELECT doc_id, list_transform(regexp_extract_all(s, '[a-zA-Z]+'), lambda x: lower(x)) AS w FROM (SELECT *, lower(s) AS low FROM pool) WHERE {_hint} >= 1) WHERE len(w) BETWEEN 12 AND 28),
        x AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS n)), y AS (SELECT doc_id, w[i:i + n - 1] AS p, CASE WHEN i > 1 THEN w[i - 1] END AS b, w[i + n] AS a FROM x)
        SELECT doc_id, array_to_string(p, ' ') AS phrase, count(*) AS n FROM y WHERE NOT list_has_any(p, string_split('{_never}', ' ')) AND NOT list_has_any([p[-1], coalesce(b, ''), coalesce(a, '')], ['is', 'are', 'was', 'were', 'be', 'been', 'being']) AND length(array_to_string(p, ' ')) BETWEEN 3 AND 25 GROUP BY ALL""",
    "generate_tf": rf"{CENTRAL}, pq AS (SELECT doc_id, s, s AS prompt, centrality, lower(s) AS lw FROM ce WHERE length(s) BETWEEN 40 AND 200), tfq AS (SELECT * FROM {_stem} WHERE {_stem_ok} AND {_hint} >= -1 AND {hits('s', r'\[[0-9]+\]|\([0-9]{4}\)')} / greatest(len({words('s')}), 1) < 0.05 AND len(list_filter(regexp_extract_all(lower(s), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^(has|have|can|will|may|do|are|were)$|.(ed|ing|s)$'))) > 0) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY centrality DESC, s) AS n, 'True or False: ' || s AS prompt FROM tfq QUALIFY n <= 4",
    "generate_list": f"{BUNDLES}, pq AS (SELECT *, 'List the key aspects of ' || array_to_string(list_transform(string_split(label, ' '), lambda x: upper(x[1]) || x[2:]), ' ') || '.' AS prompt FROM bu WHERE len(sup) >= 2) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n, prompt, array_to_string(list_transform(sup, lambda x: '- ' || x), chr(10)) AS answer FROM {_stem} WHERE {_stem_ok} QUALIFY n <= 3",
}
