"""Cases worked out by hand."""

from datetime import date

from pyspark.sql import functions as F

from marginalia.functions import study as U
from marginalia.functions import text as T
from marginalia.operators.joins import as_of_join, overlap_join
from marginalia.operators.study import fold_reviews
from marginalia.operators.structure import greedy_pack, word_windows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_schedule(spark):
    lit = F.lit
    step = lambda q, reps, ease, days, lapses: tuple(one(spark, U.next_review(lit(q), lit(reps), lit(ease), lit(days), lit(lapses))))
    assert step(5, 0, 2.5, 1, 0) == (1, 2.6, 1, 0)
    assert step(4, 1, 2.5, 1, 0) == (6, 2.5, 2, 0)
    assert step(3, 2, 2.5, 6, 0) == (15, 2.36, 3, 0)
    assert step(2, 3, 1.4, 10, 1) == (1, 1.3, 0, 2)
    assert step(4, 2, 2.5, 5, 0)[0] == 12  # 12.5 to the even day
    assert tuple(one(spark, U.next_review_by_book(lit(4), lit(2), lit(2.5), lit(6.0)))) == (15.0, 2.58)


def test_mastery(spark):
    lit = F.lit
    m = lambda days, ease, lapses, seen: one(spark, U.card_mastery(lit(days), lit(ease), lit(lapses), lit(seen).cast("date"), lit(date(2024, 5, 15))))
    assert m(15, 2.5, 0, date(2024, 5, 5)) == 0.5
    assert abs(m(30, 2.5, 2, date(2024, 3, 31)) - 0.765) < 1e-12
    assert m(15, 2.5, 0, None) == 0.25


def test_grades(spark):
    g = lambda a, e, k="basic": one(spark, U.grade(F.lit(a), F.lit(e), F.lit(k)))
    assert g("quick method", "fast function") == 5
    assert g("a stack.", "Stack", "cloze") == 5
    assert g("", "x") == 0
    assert g("anything", "!!") == 3


def test_scores(spark):
    assert abs(one(spark, U.terminality(F.lit("medium"), F.lit(0.5), F.lit(False))) - 0.69) < 1e-12
    assert abs(one(spark, U.gap(F.lit(0.0), F.lit(0.3), F.lit(2))) - 1.24) < 1e-12
    found = F.array(F.lit("gradient"))
    assert one(spark, U.concept_coverage(F.array(F.lit("gradient descent"), F.lit("prior")), found)) == 0.5
    assert one(spark, T.section_key(F.lit("2.10")) > T.section_key(F.lit("2.9.1")))
    none = F.lit(None).cast("string")
    assert one(spark, T.chunk_id(F.lit("b"), none, none, none, none, none, F.lit(0))) == "b|chX|secX|p0-0|i0|s0"


def test_windows_and_packs(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(2000)))), (2, None), (3, "a b")], "id long, text string")
    rows = {(r.id, r.chunk_index): r.words for r in word_windows(docs, "id", F.col("text")).collect()}
    assert rows[1, 0][0] == "0" and rows[1, 1][0] == "900" and rows[1, 1][-1] == "1899" and rows[2, 0] == [] and rows[3, 0] == ["a", "b"]
    sizes = spark.createDataFrame([(1, [100, 100, 100, 600, 100]), (2, [])], "id long, s array<int>")
    assert {r.id: r.packs for r in greedy_pack(sizes, "id", F.col("s")).collect()} == {1: [300, 600, 100], 2: []}


def test_joins(spark):
    a = spark.createDataFrame([(1, 10, 12), (2, 0, 0), (3, 100, 300)], "id long, lo long, hi long")
    b = spark.createDataFrame([(9, 12, 20), (8, 150, 160)], "r long, r_lo long, r_hi long")
    assert sorted((r.id, r.r) for r in overlap_join(a, b, "lo", "hi", "r_lo", "r_hi", bucket=8).collect()) == [(1, 9), (3, 8)]
    left = spark.createDataFrame([("k", 5), ("k", 1), ("x", 9)], "k string, t long")
    right = spark.createDataFrame([("k", 2, 7), ("k", 5, 8)], "k string, at long, v long")
    assert sorted(((r.k, r.t, r.v) for r in as_of_join(left, right, ["k"], "t", "at", "v").collect())) == [("k", 1, None), ("k", 5, 8), ("x", 9, None)]


def test_fold_follows_time_not_row_order(spark):
    rows = [(1, 1, 3, 5), (1, 1, 1, 4), (1, 1, 2, 1)]
    df = spark.createDataFrame([(u, c, t, t, q) for u, c, t, q in rows], "user_id long, card_id long, ts long, event_id long, quality int")
    r = fold_reviews(df, ["user_id", "card_id"]).first()
    assert (r.n_reviews, r.interval_days, r.reps, r.lapses) == (3, 1, 1, 1)


def test_ranks(spark):
    import numpy as np

    from marginalia.operators.graphs import pagerank, stable_rank

    assert np.allclose(stable_rank(np.zeros((3, 3))), 1 / 3)
    m = np.random.default_rng(0).random((6, 6)) * (np.random.default_rng(1).random((6, 6)) < 0.5)
    step = np.where(m.sum(1, keepdims=True) > 0, m / np.where(m.sum(1, keepdims=True) > 0, m.sum(1, keepdims=True), 1), 1 / 6)
    want = np.linalg.solve(np.eye(6) - 0.85 * step.T, np.full(6, 0.15 / 6))
    assert np.allclose(stable_rank(m, most=500), want, atol=1e-7)
    edges = spark.createDataFrame([(1, 10, 20, 1.0), (1, 20, 10, 1.0), (2, 5, 6, 1.0)], "graph_id long, src long, dst long, w double")
    got = {(r.graph_id, r.node): r["rank"] for r in pagerank(edges).collect()}
    assert got[1, 10] == got[1, 20] == 0.5 and got[2, 6] > got[2, 5]
