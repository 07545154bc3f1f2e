"""Aggregates: marks, ratios, histograms, medians, budgeted selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def high_water_marks(df: DataFrame, group: Sequence[str], marks: dict[str, str]) -> DataFrame:
    """The largest value of some columns for each group (result name -> column)."""
    return df.groupBy(*group).agg(*[F.max(c).alias(name) for name, c in marks.items()])


def lower_median(df: DataFrame, group: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The row at place (n - 1) div 2 of each group's order."""
    window = W.partitionBy(*group)
    ranked = df.withColumns({"__at": F.row_number().over(window.orderBy(*order)), "__n": F.count(F.lit(1)).over(window)})
    return ranked.where("__at = (__n - 1) div 2 + 1").select(*group, *fields)


def distinct_below(df: DataFrame, group: Sequence[str], item: str, condition: Column, name: str) -> DataFrame:
    """For each group how many distinct items satisfy a condition."""
    return df.groupBy(*group).agg(F.countDistinct(F.when(condition, F.col(item))).alias(name))


def weighted_mean(df: DataFrame, group: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    mean = F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))
    return df.groupBy(*group).agg(F.round(mean, 6).alias(name))


def histogram(df: DataFrame, value: str, low: float, high: float, buckets: int) -> DataFrame:
    """bucket (0 to buckets - 1, values outside clamped), n, least, most, total. Counts of
    parts add up, so it merges across partitions and batches."""
    place = F.floor((F.col(value) - low) / ((high - low) / buckets))
    bucket = F.least(F.greatest(place, F.lit(0)), F.lit(buckets - 1)).cast("int").alias("bucket")
    return df.where(F.col(value).isNotNull()).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def percentiles(df: DataFrame, group: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    return df.groupBy(*group).agg(*[F.round(F.percentile(value, q), 6).alias(name) for name, q in at.items()])


def generations(blocks: DataFrame, generation: str, fill: str, valid: str, most: int = 19) -> DataFrame:
    """Blocks by generation (older ones together): count, total fill, least valid."""
    return blocks.groupBy(F.least(F.col(generation), F.lit(most)).alias("generation")).agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(fill).alias("fill"), F.min(valid).alias("least_valid")
    )


def within_budget(df: DataFrame, group: Sequence[str], order: Sequence[Column], size: str, budget: float) -> DataFrame:
    """Rows of each group in an order until their sizes reach a budget: those before whose
    start the budget isn't reached yet."""
    earlier = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("__before", F.coalesce(F.sum(size).over(earlier), F.lit(0))).where(F.col("__before") < budget).drop("__before")


def sample_rows(df: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """A random ``count`` rows, the same for the same rows and seed: the first by a digest."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(count)
