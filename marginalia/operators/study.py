"""Review folds, mastery roll-ups and planning over card and review tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.study import next_review
from .joins import top_per_group

START = "named_struct('interval_days', 0, 'ease', 2.5D, 'reps', 0, 'lapses', 0)"


def fold_reviews(reviews: DataFrame, keys: list[str], time: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """The review state of each key after all its reviews in order of time.

    An ordered fold in the JVM: the reviews of a key are sorted and aggregated as one array. A key is one learner's
    card, so that its reviews are few.
    """
    ordered = F.array_sort(F.collect_list(F.struct(time, tiebreak, "quality")))
    step = lambda s, r: next_review(r["quality"], s["reps"], s["ease"], s["interval_days"], s["lapses"])
    folded = reviews.groupBy(*keys).agg(ordered.alias("r")).select(*keys, F.size("r").cast("long").alias("n_reviews"), F.aggregate("r", F.expr(START), step).alias("s"), F.element_at("r", -1)[time].alias("last_ts"))
    return folded.select(*keys, "n_reviews", "last_ts", "s.*")


def mastery_rollup(cards: DataFrame, mastery: Column) -> DataFrame:
    """Mean mastery over all, by book and by section, in one pass of grouping sets."""
    m = cards.select("book", "section", mastery.alias("m"))
    return m.groupingSets([["book"], ["section"], []], "book", "section").agg(F.grouping_id("book", "section").alias("level"), F.count("*").alias("n_cards"), F.round(F.avg("m"), 4).alias("mastery"))


def interleaved(cards: DataFrame, group: list[str], first: Column, order: list[Column], n: int) -> DataFrame:
    """n cards of each group: two of the first kind, one of the other, in turn; either goes on alone when the other runs out."""
    kind = F.when(first, 0).otherwise(1)
    k = F.row_number().over(Window.partitionBy(*group, "kind").orderBy(*order)) - 1
    slot = F.when(F.col("kind") == 0, F.floor(F.col("k") / 2) * 3 + F.col("k") % 2).otherwise(F.col("k") * 3 + 2)
    ranked = cards.withColumn("kind", kind).withColumn("k", k).withColumn("slot", slot)
    return top_per_group(ranked, group, [F.col("slot"), F.col("kind")], n)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return top_per_group(rows, keys, [c.desc() for c in order], 1).drop("rank")
