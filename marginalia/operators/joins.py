"""Joins and selections that the engine uses again and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in a total order, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def overlap_join(left: DataFrame, right: DataFrame, lo: str, hi: str, r_lo: str, r_hi: str, bucket: int = 64, how: str = "inner") -> DataFrame:
    """Rows whose intervals [lo, hi] and [r_lo, r_hi] meet, by equal buckets of the axis and then the exact test.

    Each pair comes once: in the bucket where the later of the two starts lies. how may be left_semi.
    """
    spread = lambda df, a, b, name: df.withColumn(name, F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))))
    a, b = spread(left.where(F.col(lo) <= F.col(hi)), lo, hi, "_bucket"), spread(right.where(F.col(r_lo) <= F.col(r_hi)), r_lo, r_hi, "_r_bucket")
    on = (F.col("_bucket") == F.col("_r_bucket")) & (F.col(lo) <= F.col(r_hi)) & (F.col(r_lo) <= F.col(hi)) & (F.floor(F.greatest(lo, r_lo) / bucket) == F.col("_bucket"))
    if how == "left_semi":
        return a.join(b, on, "left_semi").drop("_bucket").distinct()
    return a.join(b, on, how).drop("_bucket", "_r_bucket")


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """left with the value of the last row of right at or before its time, per key; one sort by key and time for both sides.

    Of rows of right at one time the largest value counts.
    """
    once = right.groupBy(*by, F.col(right_time).alias("_t")).agg(F.max(value).alias("_v"))
    a = left.select("*", F.col(left_time).alias("_t"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = once.select(*by, "_t", "_v", F.lit(0).alias("_side"))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_t", "_v", "_side")
