"""Keyed mutations as functions from relation to relation.

Files are immutable: a mutation is one deterministic program whose result is published as
a new version of the relation. NULL keys never match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_if_absent(base: DataFrame, new: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """base and those rows of new whose key it lacks; of several the first to arrive.

    ``arrival`` orders new; ties are broken by all columns, so the result is determined.
    """
    order = F.struct(*arrival, *[c for c in new.columns if c not in arrival])
    first = new.groupBy(*keys).agg(F.min(order).alias("first"))
    first = first.select(*[F.col(f"first.{c}").alias(c) for c in new.columns])
    return base.unionByName(first.join(base.select(*keys), list(keys), "left_anti").select(*base.columns))


def update_if_present(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base with the fields of updates (one row for each key) where the key is present.

    A field is replaced where the key matches, even by NULL.
    """
    fields = [c for c in updates.columns if c not in keys]
    renamed = updates.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__hit"))
    joined = base.join(renamed, list(keys), "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])


def modify(base: DataFrame, deltas: DataFrame, keys: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Read-modify-write of additive fields: base field -> delta column that is added to it.

    Deltas of a key are summed before the join, so a hot key costs one row for each task.
    """
    totals = deltas.groupBy(*keys).agg(*[F.sum(d).alias(f"__{f}") for f, d in sums.items()])
    joined = base.join(totals, list(keys), "left")
    return joined.select(*[(F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) if c in sums else F.col(c) for c in base.columns])


def fold(base: DataFrame, requests: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, field: str, step) -> DataFrame:
    """Read-modify-write where order matters: field := step(field, value) for each request of
    a key in the order given. Requests of one key are folded in one expression, so their
    number is bounded by what a key receives in a batch."""
    queue = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    queued = requests.groupBy(*keys).agg(queue.alias("__queue"))
    joined = base.join(queued, list(keys), "left")
    folded = F.aggregate(F.col("__queue"), F.col(field), lambda acc, r: step(acc, r["__v"]))
    return joined.select(*[F.coalesce(folded, F.col(c)).alias(c) if c == field else F.col(c) for c in base.columns])


def erase(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base without the keys given."""
    return base.join(gone.select(*keys), list(keys), "left_anti")


def erased(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each distinct key asked for, whether it was there to erase."""
    present = base.select(*keys).distinct().withColumn("erased", F.lit(True))
    return gone.select(*keys).distinct().join(present, list(keys), "left").withColumn("erased", F.coalesce("erased", F.lit(False)))


def erase_range(base: DataFrame, condition: Column) -> DataFrame:
    """base without the rows of a key range."""
    return base.where(~F.coalesce(condition, F.lit(False)))


def retain_window(base: DataFrame, group: Sequence[str], sequence: str, window: int) -> DataFrame:
    """Sliding retention: rows of each group within ``window`` of its highest sequence."""
    high = base.groupBy(*group).agg(F.max(sequence).alias("__high"))
    return base.join(high, list(group)).where(F.col(sequence) > F.col("__high") - window).select(*base.columns)


def assign_sequence(requests: DataFrame, group: Sequence[str], arrival: Sequence[str], first: Column, name: str = "seq") -> DataFrame:
    """Consecutive numbers from ``first`` on in each group, in order of arrival."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(*group).orderBy(*arrival))
    return requests.withColumn(name, first + place - 1)
