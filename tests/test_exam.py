"""Exams: every kind and both passes, the rules in Python against the Columns, blanks against a plain loop."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from test_odd_lines import LINES
from test_queries import SF

from marginalia import catalog
from marginalia.functions import prose as P
from marginalia.functions import text as T
from marginalia.operators import exam as E
from marginalia.operators import notes as N
from marginalia.operators import sentences as S
from marginalia.plans import notes

MORE = [
    "Gradient descent is defined as a method that uses repeated steps toward some minimum value (Chapter 3) (2019) (see fig. 2).",
    "1.2 Chapter 3: The café naïve loss falls slowly because the chosen steps are small everywhere, since noise is large.",
    "In wide shallow networks, sparse linear models can generalize well due to strong shared weights that limit noise.",
    "Wide layers use much shared memory thus training is slow on small machines with 4 of 12 cores.",
    "Page ranks are stable; therefore table scans can use cached blocks, however (2004) many readers wait for them.",
    "Soŗt ﬁles co- operate , , with the old→new names • and ſolid Kelvin K values it means that readers use them ......",
]


@pytest.fixture(scope="module")
def sentences(spark):
    """(doc_id, pos, s) of the smallest tables' good sentences and odd ones, those squeezed but not filtered."""
    odd = [(-900 - k, 0, " ".join(re.sub(r"[^\S \n\t]", "", s or "").split())) for k, s in enumerate([*LINES, *MORE])]
    return notes.good(spark, SF).union(spark.createDataFrame(odd, "doc_id long, pos int, s string")).where("s <> ''").cache()


def test_rules_are_those_of_the_columns(spark, sentences):
    s, d = F.col("s"), F.col("p")["definition"]
    noisy = T.structural_noise(d) | T.exercise_prompt(d) | T.reference_line(d)
    verb = F.exists(F.regexp_extract_all(F.lower("s"), F.lit(r"[\p{L}\p{M}\p{N}_]+"), 0), lambda w: w.rlike("^(has|have|can|will|may|do|are|were)$|.(ed|ing|s)$"))
    columns = sentences.select("s", P.definition_pair(s).alias("p"), P.score_hint(s).alias("hint"), P.valid_stem(s).alias("stem"), P.valid_term(s).alias("term"), verb.alias("verb"), P.strong(s).alias("strong"), P.dedupe_key(s).alias("key"))
    defined = 0
    for r in columns.withColumn("marked", noisy).withColumn("fit", P.valid_term(F.col("p")["term"])).collect():
        low = r.s.lower()
        assert (E.hint(r.s, low), E.fit_stem(r.s), E.fit_term(r.s), E.has_verb(low)) == (r.hint, r.stem, r.term, r.verb), r.s
        assert (E.strong(r.s), E.keyed(r.s)[1]) == (r.strong, r.key), r.s
        if not re.search(r"(\([^(]*\)[ ,;.]*){3}$", r.s):  # the Columns take off two citations, as the SQL does
            assert E.definition_pair(r.s) == (tuple(r.p) if r.p else None), r.s
        if r.p:
            defined += 1
            assert (S.marked(r.p.definition), E.fit_term(r.p.term)) == (r.marked, r.fit), r.s
    assert defined > 5 and E.definition_pair(MORE[0].rstrip("."))[1] == "a method that uses repeated steps toward some minimum value"


def test_reasons_are_those_of_the_columns(sentences, spark):
    want = {(r.doc_id, r.pos, r.question, r.answer) for r in N.why_questions(sentences).collect()}
    got = {(r.doc_id, r.pos, *q) for r in sentences.collect() if (q := E.why(r.s))}
    assert got == want and len(got) > 3


def test_pool_is_that_of_the_candidates(spark):
    want = {(r.doc_id, r.place, r.centrality, r.hint, r.digest) for r in catalog.QUERIES["build_candidate_pool"](spark, SF).collect()}
    scopes = {}
    for r in sorted(notes.good(spark, SF).collect(), key=lambda r: (r.doc_id, r.pos)):
        scopes.setdefault(r.doc_id, []).append(r.s)
    pools = {i: E.pooled((i,), s)[0] for i, s in scopes.items()}
    assert {(i, k + 1, c.central, c.hint, hashlib.md5(c.s.encode()).hexdigest()) for i, pool in pools.items() for k, c in enumerate(pool)} == want


def test_exam_fills_what_kinds_leave(spark):
    """Scopes have few definitions: others fill their place up to twenty, and every kind is asked for."""
    exams, pool = {}, {}
    for r in catalog.QUERIES["generate_exam_questions"](spark, SF).collect():
        exams.setdefault(r.doc_id, []).append(r)
    assert {r.kind for some in exams.values() for r in some} == set(E.WANTED)
    assert all(sorted(r.place for r in some) == list(range(1, len(some) + 1)) and len(some) <= 20 for some in exams.values())
    assert max(map(len, exams.values())) == 20 and all(r.answer for some in exams.values() for r in some)
    assert max(sum(r.kind == "tf" for r in some) for some in exams.values()) > E.WANTED["tf"]


def test_shares_and_passes():
    ask = lambda kind, n: (E.Question(kind, f"What is {kind} number {'x' * k} called?", "True" if kind == "tf" else "one two three four five", None) for k in range(1, n + 1))
    kinds = lambda **n: {k: ask(k, n.get(k, 0)) for k in E.WANTED}
    got = lambda *a, **n: [q.kind for q in E.drawn(kinds(**n), *a)]
    assert got(definition=9, fib=9, tf=9, short=9, list=9) == ["definition"] * 5 + ["fib"] * 4 + ["tf"] * 4 + ["short"] * 4 + ["list"] * 3
    assert got(tf=6, short=5, list=30) == ["tf"] * 4 + ["short"] * 4 + ["list"] * 3 + ["tf"] * 2 + ["short"] + ["list"] * 6
    assert got(definition=30) == ["definition"] * 20 and got(list=2) == ["list"] * 2
    assert got({"fib": 5}, 5, fib=3, tf=1) == ["fib"] * 3 + ["tf"]
    assert E.shares(dict.fromkeys(E.WANTED, 5), 5) == dict.fromkeys(E.WANTED, 1) and E.shares({"definition": 9, "tf": 8}, 10) == {"definition": 6, "tf": 4}
    assert E.drawn({k: iter([E.Question(k, "What is here?", "one two", None)]) for k in E.WANTED}) == [E.Question(k, "What is here?", "one two", None) for k in ("fib", "list")]


def plain_blanks(pool, supporting):
    """As blanks(), each phrase tried in each sentence."""
    count = E.phrases(pool)
    value = {p: 10 * n + 50 * (n >= 2) + 80 * (p in supporting) + 20 * any(len(w) >= 5 for w in p.split()) for p, n in count.items()}
    out, used = [], set()
    for p in sorted(count, key=lambda p: -value[p]):
        for c in E.diverse(c for c in pool if c.hint >= 1 and 12 <= len(c.s.split()) <= 28):
            s = re.sub(re.escape(p), "______", c.s, count=1, flags=re.I)
            left, right = (re.findall("[a-zA-Z]+", x.lower()) for x in (s.split("______", 1) + [""])[:2])
            beside = left and right and left[-1] in P.BE_FORMS and right[0] in P.BE_FORMS
            if p in c.low and s not in used and not beside and s.split()[0] != "______" and s.split()[-1] != "______" and E.fit_stem(s):
                used.add(s)
                out.append((s, p))
    return out


def test_blanks_are_those_of_a_plain_loop():
    r = random.Random(5)
    words = 3 * "the tables mean heap heaps ordering keys are is stable because trees that hat x (graph with-in Old orders".split() + "of page of: pp. 7 Kelvin end.".split()
    found = mended = 0
    for _ in range(60):
        pool = []
        for _ in range(12):
            s = " ".join(r.choice(words) for _ in range(r.randrange(11, 31)))
            pool.append(E.Candidate(s, s.lower(), len(s.split()), r.randrange(3), 0.0, r.choice(["heap", "keys", None])))
        supporting = {"heap", "ordering keys"}
        got = [(q.stem, q.answer) for q in E.blanks(pool, supporting)]
        assert got == plain_blanks(pool, supporting)
        found += len(got)
        mended += sum(not E.fit_stem(s.replace("______", p)) for s, p in got)
        assert not list(E.blanks(pool, supporting, True))
    assert found > 200 and mended > 20


def test_lists_and_statements():
    enumerated = "The steps are planning, careful writing, review and slow release"
    cand = lambda s, hint=0, top="t": E.Candidate(s, s.lower(), len(s.split()), hint, 0.0, top)
    bundles = [("heap order", 1, ["keys", "trees"], []), ("heap", 2, ["keys"], [])]
    got = [(q.prompt, q.answer) for q in E.lists([cand(enumerated), cand(enumerated)], bundles)]
    assert got == [("List the key aspects of Heap Order.", "- keys\n- trees"), ("List the following:", "- The steps are planning\n- careful writing\n- review\n- slow release")]
    assert len(list(E.lists([cand(enumerated)], bundles, True))) == 1
    same = [cand("Binary heaps keep their keys in partial order", top="heaps"), cand("Wide heaps keep their keys in partial order", top="heaps"), cand("Sorted lists keep their keys in total order", top="lists")]
    assert [q.prompt for q in E.statements(same)] == [f"True or False: {same[k].s}" for k in (0, 2, 1)] and not list(E.statements(same, True))


def test_near_duplicates_are_asked_once(spark):
    s = "Several quiet rivers carried wooden boats toward distant harbors during early winter mornings"
    rows = spark.createDataFrame([(1, 0, s), (1, 1, s.lower()), (None, 0, s), (2, 0, s)], "doc_id long, pos int, s string")
    got = [(r.doc_id, r.prompt) for r in E.exams(rows, ["doc_id"]).where("kind = 'tf'").collect()]
    assert sorted(got, key=str) == sorted([(i, f"True or False: {s}") for i in (1, 2, None)], key=str)
    assert E.exams(rows, ["doc_id"])._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_rare_words_find_the_same_near_duplicates(monkeypatch):
    r = random.Random(7)
    words = [f"w{k}" for k in range(40)] + ["not", "increase", "decrease"]
    base = [" ".join(["because", *(r.choice(words) for _ in range(25))]) for _ in range(30)]
    rows = []
    for _ in range(400):
        w = r.choice(base).split()
        w[r.randrange(len(w))] = r.choice(words)
        rows.append((" ".join(w) + r.choice(("", " = 1")), " ".join(w), " ".join(w)))
    want = N.distinct_sentences(rows)
    monkeypatch.setattr(N, "MANY", 0)
    assert N.distinct_sentences(rows) == want and 30 <= len(want) < 300
    assert N.distinct_sentences([]) == []
