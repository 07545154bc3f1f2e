"""Joins that need more than an equality: as-of, interval and content joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(probes: DataFrame, history: DataFrame, group: Sequence[str], at: str, fields: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Each probe with the fields of the latest history row of its group at or before it.

    Both sides are laid into one order for each group and the last history value is carried
    forward: one shuffle by group, no pair of rows is ever formed. ``tie`` orders history
    rows of one time; history comes before a probe of the same time.
    """
    extra = [c for c in probes.columns if c not in (*group, at)]
    left = probes.select(*group, at, F.struct(*extra).alias("__probe"), F.lit(None).alias("__row"), F.lit(1).alias("__side"), *[F.lit(None).alias(f"__t{i}") for i in range(len(tie))])
    right = history.select(*group, at, F.lit(None).alias("__probe"), F.struct(*fields).alias("__row"), F.lit(0).alias("__side"), *[F.col(t).alias(f"__t{i}") for i, t in enumerate(tie)])
    order = W.partitionBy(*group).orderBy(at, "__side", *[f"__t{i}" for i in range(len(tie))]).rowsBetween(W.unboundedPreceding, 0)
    seen = left.unionByName(right).withColumn("__seen", F.last("__row", ignorenulls=True).over(order))
    return seen.where("__side = 1").select(*group, at, *[F.col(f"__probe.{c}").alias(c) for c in extra], *[F.col(f"__seen.{f}").alias(f) for f in fields])


def with_bounds(cumulative: DataFrame, by: str, key: str, low: str = "low", high: str = "high") -> DataFrame:
    """Half-open intervals [low, high) of a running total ``by``, in the order of ``key``."""
    lag = F.coalesce(F.lag(by).over(W.orderBy(key)), F.lit(0))
    return cumulative.withColumn(low, lag).withColumn(high, F.col(by))


def assign_interval(values: DataFrame, value: Column, bounds: DataFrame, low: str, high: str) -> DataFrame:
    """values with the row of the interval [low, high) that ``value`` falls in.

    Intervals don't overlap. The line is cut in as many cells as there are intervals, so
    these lie in twice as many cells at most, and the join is an equality on the cell with
    the bounds as a residue: no pair of a value and every interval is ever tried.
    """
    span = bounds.agg(F.count(F.lit(1)).alias("n"), F.min(low).alias("lo"), F.max(high).alias("hi")).first()
    if not span.n:
        return values.withColumn("__v", value).join(bounds, F.lit(False)).drop("__v")
    start, width = float(span.lo), max((float(span.hi) - float(span.lo)) / span.n, 1e-300)
    cell = lambda c: F.floor((c - F.lit(start)) / F.lit(width)).cast("long")
    celled = bounds.withColumn("__cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    probe = values.withColumn("__v", value).withColumn("__cell", cell(F.col("__v")))
    inside = (F.col("__v") >= F.col(low)) & (F.col("__v") < F.col(high))
    return probe.join(celled, "__cell").where(inside).drop("__v", "__cell")


def content_join(left: DataFrame, right: DataFrame, left_content: str, right_content: str, how: str = "inner") -> DataFrame:
    """Equality of large values by their SHA-256, so that digests travel and not contents."""
    a = left.withColumn("__d", F.sha2(F.col(left_content).cast("binary"), 256))
    b = right.withColumn("__d", F.sha2(F.col(right_content).cast("binary"), 256)).drop(right_content)
    return a.join(b, "__d", how).drop("__d")
