"""Sentences in Python against the Column rules, and folds of scopes that repeat ids or have none."""

from pyspark.sql import functions as F
from test_odd_lines import LINES, rows
from test_queries import SF

from marginalia.functions import prose as P
from marginalia.functions import text as T
from marginalia.operators import notes as N
from marginalia.operators import sentences as S
from marginalia.sources import tables


def test_split_and_filters_as_the_columns(spark):
    odd = spark.createDataFrame([(-900 - k, s) for k, s in enumerate([*LINES, "a" * 300 + ", " + "wörd " * 90, "x y co-\n operate  — tail of words that goes on and on; " * 9])], "doc_id long, s string")
    pages = tables.probe_pages(spark, SF).union(odd)
    want = pages.select("doc_id", F.posexplode(P.sentences(F.col("s"))).alias("pos", "s"))
    assert sorted(S.of_pages(pages).collect()) == sorted(want.collect())
    want = want.withColumn("s", T.squeeze(F.col("s"))).where(T.passes_quality(F.col("s")))
    assert sorted(S.of_pages(pages, good=True).collect()) == sorted(want.collect())


def test_a_scope_is_shuffled_once(spark):
    df = spark.createDataFrame([(1, 0, "gradient descent lowers loss")], "doc_id long, pos int, s string")
    for made in (N.term_stats(df, ["doc_id"]), N.centralities(df, ["doc_id"]), N.bundles(df, ["doc_id"]), N.selected(df, ["doc_id"]), N.summaries(N.centralities(N.deduped(df), ["doc_id"], together=True), together=True)):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_scopes_as_in_sql(spark, tmp_path):
    lines = [*LINES, "Gradient descent is defined as a rule moving steadily toward some minimum value. Gradient descent lowers training loss across many small steps taken. Gradient descent lowers training loss across many small steps taken."]
    for name in ("term_stats_by_scope", "sentence_centrality", "get_top_term", "build_bundles", "generate_tf", "generate_list", "registry_to_card_format"):
        got, want = rows(spark, name, tmp_path, lines)
        assert got == want, name
