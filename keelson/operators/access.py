"""Point and range access over ordered relations.

A relation is a DataFrame with key columns; its order is ascending by them, NULL first.
Bounds become plain comparisons on the leading key column as well, so that they reach the
file scan's statistics.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point_lookup(relation: DataFrame, key: dict[str, Any], fields: Sequence[str] = ("*",)) -> DataFrame:
    """The row of a key (no row where there is none), some fields of it."""
    return relation.where(reduce(and_, [F.col(k) == v for k, v in key.items()])).select(*fields)


def batch_lookup(relation: DataFrame, keys: DataFrame, on: Sequence[str], found: str = "found") -> DataFrame:
    """Every key with its row's fields and whether there was one."""
    marked = relation.withColumn(found, F.lit(True))
    return keys.join(marked, list(on), "left").withColumn(found, F.coalesce(found, F.lit(False)))


def after(keys: Sequence[str], bound: Sequence[Any], inclusive: bool = True) -> Column:
    """Lexicographic key >= bound (or >)."""
    return _beyond(keys, bound, inclusive, Column.__gt__, Column.__ge__)


def before(keys: Sequence[str], bound: Sequence[Any], inclusive: bool = True) -> Column:
    """Lexicographic key <= bound (or <)."""
    return _beyond(keys, bound, inclusive, Column.__lt__, Column.__le__)


def _beyond(keys, bound, inclusive, strict, loose) -> Column:
    keys = list(keys)[: len(bound)]
    cases = []
    for i in range(len(keys)):
        last = i == len(keys) - 1
        compare = loose if last and inclusive else strict
        equal = [F.col(k) == b for k, b in zip(keys[:i], bound)]
        cases.append(reduce(and_, [*equal, compare(F.col(keys[i]), bound[i])]))
    return loose(F.col(keys[0]), bound[0]) & reduce(or_, cases)


def scan(relation: DataFrame, keys: Sequence[str], low: Sequence[Any] | None = None, high: Sequence[Any] | None = None, descending: bool = False, high_inclusive: bool = True) -> DataFrame:
    """Rows from low to high in key order, or from high down to low."""
    rows = relation
    if low is not None:
        rows = rows.where(after(keys, low))
    if high is not None:
        rows = rows.where(before(keys, high, high_inclusive))
    return rows.orderBy(*[F.col(k).desc() if descending else F.col(k).asc() for k in keys])


def prefix_scan(relation: DataFrame, keys: Sequence[str], prefix: Sequence[Any]) -> DataFrame:
    """Rows whose leading key columns equal the prefix, in key order."""
    same = [F.col(k) == v for k, v in zip(keys, prefix)]
    return relation.where(reduce(and_, same)).orderBy(*keys)


def take_while(relation: DataFrame, keys: Sequence[str], predicate: Column) -> DataFrame:
    """The longest prefix of the key order on which the predicate holds.

    The first key that fails is one aggregate; rows below it are one filter. Neither needs
    the rows in order in one place, as a running flag over the whole order would.
    """
    key = F.struct(*keys)
    stop = relation.where(~F.coalesce(predicate, F.lit(False))).agg(F.min(key))
    return relation.where(F.coalesce(key < stop.scalar(), F.lit(True)))


def latest(relation: DataFrame, group: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """For each group the fields of its largest row in an order: a seek to the last key."""
    top = F.max(F.struct(*order, *[f for f in fields if f not in order])).alias("top")
    return relation.groupBy(*group).agg(top).select(*group, *[F.col(f"top.{f}").alias(f) for f in fields])


def earliest(relation: DataFrame, group: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """For each group the fields of its smallest row in an order."""
    top = F.min(F.struct(*order, *[f for f in fields if f not in order])).alias("top")
    return relation.groupBy(*group).agg(top).select(*group, *[F.col(f"top.{f}").alias(f) for f in fields])


def count_entries(relation: DataFrame) -> DataFrame:
    return relation.agg(F.count(F.lit(1)).alias("entries"))


def not_empty(relation: DataFrame) -> DataFrame:
    """One row: whether there is any record. Stops at the first one."""
    return relation.limit(1).agg((F.count(F.lit(1)) > 0).alias("not_empty"))


def size_in_pages(relation: DataFrame, page: int = 4096) -> DataFrame:
    """Bytes of all values as text, and the pages that so many bytes fill."""
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in relation.columns])
    total = F.coalesce(F.sum(size), F.lit(0)).cast("long")
    return relation.agg(total.alias("bytes")).withColumn("pages", F.ceil(F.col("bytes") / page))


def map_records(relation: DataFrame, change, schema: str) -> DataFrame:
    """Records through a function of a pandas table, batch by batch, for what expressions
    can't say. The function may run again on the same batch, so it has no side effects."""
    return relation.mapInPandas(lambda batches: map(change, batches), schema)
