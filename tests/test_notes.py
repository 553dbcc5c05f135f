"""Folds of sentences against plain loops, and hand cases of questions and answers."""

import random

from pyspark.sql import functions as F
from test_queries import SF

from marginalia import catalog
from marginalia.operators import notes as N


def plain_dedupe(rows, least=N.NEAR):
    """As distinct_sentences, comparing with every kept sentence in turn."""
    kept, seen = [], set()
    for place, (s, key, low) in enumerate(rows):
        if not key or key in seen:
            continue
        words = set(key.split())
        for k, other in enumerate(kept):
            theirs = set(rows[other][1].split())
            if len(words & theirs) / len(words | theirs) >= least and not N._against(N._sides(low), N._sides(rows[other][2])):
                if N._untidiness(s) < N._untidiness(rows[other][0]):
                    seen.discard(rows[other][1])
                    seen.add(key)
                    kept[k] = place
                break
        else:
            kept.append(place)
            seen.add(key)
    return kept


def test_dedupe_is_that_of_a_plain_loop():
    r = random.Random(3)
    words = [f"w{k}" for k in range(30)] + ["not", "increase", "decrease", "max", "min"]
    for _ in range(30):
        base = [[r.choice(words) for _ in range(r.choice((5, 14, 30)))] for _ in range(6)]
        rows = []
        for _ in range(50):
            w = list(r.choice(base))
            for _ in range(r.choice((0, 0, 1, 2))):
                w[r.randrange(len(w))] = r.choice(words)
            key = " ".join(w)
            rows.append((key + r.choice(("", " é", " = 1")), key, key))
        rows.append(("", "", ""))
        assert N.distinct_sentences(rows) == plain_dedupe(rows)


def test_deduped_rows(spark):
    rows = [(1, 0, "The step size must increase here."), (1, 1, "the step size must increase here"), (1, 2, "The step size must decrease here."), (2, 0, "The step size must increase here."), (3, 0, None)]
    got = sorted(map(tuple, N.deduped(spark.createDataFrame(rows, "doc_id long, pos int, s string")).collect()))
    assert got == [(1, 0, "The step size must increase here."), (1, 1, "The step size must decrease here."), (2, 0, "The step size must increase here.")]


def test_themes_and_bullets():
    a = ["heaps keep order", "heaps keep keys", "graphs have edges", "graphs have cycles", "the of and"]
    assert N.themes(a) == [a[:2], a[2:4]]
    assert [len(g) for g in N.themes([f"word{k} alone{k}" for k in range(9)])] and len(N.themes([f"word{k} alone{k}" for k in range(9)])) == 6
    assert N.bullets([*a[:2], "heaps keep sizes", *a[2:4]]) == [*a[:2], *a[2:4]]


def test_bundles_in_turn(spark):
    df = spark.createDataFrame([([["a", "b"], ["a", "c"], ["d"], []],)], "b array<array<string>>")
    assert df.select(N.across(F.col("b")).alias("x")).first().x == ["a", "c", "d", "b"]
    assert df.select(N.across(F.col("b"), 2).alias("x")).first().x == ["a", "c"]


def test_why_questions(spark):
    assert N.causal_split("The loss falls slowly because the steps are small") == ("The loss falls slowly", "because", "the steps are small")
    assert N.causal_split("because it is so the loss falls") is None
    assert N.causal_split("training was long, therefore results improve much") == ("training was long", "therefore", "results improve much")
    assert N.causal_split("long training therefore tired eyes everywhere") is None
    assert N.without_numbering("4.1 Heaps keep order well") == "Heaps keep order well" and N.without_numbering("Section 3: the heap") == "the heap"
    assert N.without_numbering("Binary Heap Order Trees Of Keys in order") == "in order"
    assert N.auxiliary("sparse models can generalize well") == ("can", "sparse models generalize well") and N.auxiliary("in practice it works well") is None
    assert N.auxiliary("trees use much memory") == ("do", "trees use much memory") and N.auxiliary("a tree provide order") == ("does", "a tree provide order")
    rows = spark.createDataFrame([(1, 0, "Sparse linear models can generalize well since fewer active weights limit memorized noise patterns"), (1, 1, "Nothing here gives any reason at all"), (2, 0, None)], "doc_id long, pos int, s string")
    got = N.why_questions(rows).collect()
    assert [(r.doc_id, r.question, r.answer) for r in got] == [(1, "Why can Sparse linear models generalize well?", "Because fewer active weights limit memorized noise patterns")]


def test_scopes_without_sentences(spark):
    none = spark.createDataFrame([], "doc_id long, pos int, s string")
    assert N.deduped(none).count() == 0 and N.centralities(none, ["doc_id"]).count() == 0 and N.bundles(none, ["doc_id"]).count() == 0 and N.why_questions(none).count() == 0


def test_pool_and_exam(spark):
    pool = catalog.QUERIES["build_candidate_pool"](spark, SF).collect()
    by_doc = {}
    for r in sorted(pool, key=lambda r: (r.doc_id, r.place)):
        by_doc.setdefault(r.doc_id, []).append((-r.centrality, -r.hint))
    assert pool and all(v == sorted(v) for v in by_doc.values())
    assert all(b.bullet and len(b.bullet) <= 180 for b in catalog.QUERIES["compose_bulleted_summary"](spark, SF).collect())
    assert {r.question for r in catalog.QUERIES["generate_short_answer"](spark, SF).collect()} >= {"Why are smooth convex losses much easier targets?"}


def test_only_scopes_with_a_definition_are_folded(spark):
    """The pages kept are those of scopes that define a term, whichever of their rows does and whatever splits its words; beyond the number of ids held all are kept."""
    from pyspark.sql import functions as F

    from marginalia.functions import prose as P
    from marginalia.functions import text as T
    from marginalia.operators import sentences as S
    from marginalia.plans import notes

    definition = "Gradient descent is de-\nfined as an optimization method that uses slopes to find the least value of functions."
    plain = "Several quiet rivers carried wooden boats toward distant harbors during early winter mornings."
    assert any("is defined as" in s for s in S.split(definition))
    assert S.may_hold(definition, ("is defined as",)) and not S.may_hold(plain, tuple(T.DEFINITION_CUES)) and not S.may_hold(None, ("means",))
    pages = spark.createDataFrame([(1, definition), (1, plain), (2, plain), (3, None), (None, definition), (None, plain)], "doc_id long, s string")
    s = F.col("s")
    pair, fit = F.when(P.score_hint(s) >= 2, P.definition_pair(s)), P.valid_term(F.col("p")["term"])
    kept = lambda most: sorted((r.doc_id or 0, r.s or "") for r in notes._of_defining(pages, pair, fit, most).collect())
    assert kept(None) == sorted([(1, definition), (1, plain), (0, definition), (0, plain)])
    assert len(kept(1)) == pages.count()
