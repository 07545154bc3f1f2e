"""Where writes land and what to reclaim: page versions, lifetimes, victims, bins.

Blocks, pages and groups are rows of analytic tables; each policy is a query over them.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.operators.running import CELL

#: A bin is a page of so many bytes; items take this much at least, so a bin has two at most.
BIN_BYTES, LEAST_ITEM = 4096, 2048


def latest_versions(writes: DataFrame, page: str, version: str, fields: Sequence[str]) -> DataFrame:
    """Each page's last write: the current mapping of pages to places."""
    last = F.max(F.struct(version, *fields)).alias("last")
    return writes.groupBy(page).agg(last).select(page, f"last.{version}", *[f"last.{f}" for f in fields])


def validity(writes: DataFrame, page: str, version: str, block: str) -> DataFrame:
    """Blocks with their writes, how many are current, and how many a later write replaced."""
    current = F.lead(version).over(W.partitionBy(page).orderBy(version)).isNull()
    return writes.withColumn("__valid", current.cast("long")).groupBy(block).agg(
        F.count(F.lit(1)).alias("total"), F.sum("__valid").alias("valid"), (F.count(F.lit(1)) - F.sum("__valid")).alias("invalid")
    )


def invalidations(writes: DataFrame, page: str, version: str, block: str) -> DataFrame:
    """Each replaced write with its block and when it was replaced."""
    later = F.lead(version).over(W.partitionBy(page).orderBy(version))
    return writes.withColumn("replaced_at", later).where("replaced_at is not null").select(page, version, block, "replaced_at")


def size_by_state(blocks: DataFrame, state: str, size: str, capacity: int) -> DataFrame:
    """Bytes in use: full blocks count whole, open ones by what they hold, others not."""
    used = F.when(F.col(state) == "FULL", F.lit(capacity)).when(F.col(state).isin("OPEN", "IN_USE", "GC_READ", "GC_WRITE"), F.col(size)).otherwise(0)
    return blocks.agg(F.coalesce(F.sum(used), F.lit(0)).cast("long").alias("bytes"))


def _first(blocks: DataFrame, group: Sequence[str], *order: Column) -> DataFrame:
    best = F.min(F.struct(*order, F.struct(*[c for c in blocks.columns if c not in group]).alias("__row"))).alias("best")
    return blocks.groupBy(*group).agg(best).select(*group, "best.__row.*")


def greedy_victim(blocks: DataFrame, group: Sequence[str], valid: str, total: str, place: str) -> DataFrame:
    """The block with the fewest valid pages, first in place; fully valid ones never."""
    return _first(blocks.where(F.col(valid) < F.col(total)), group, F.col(valid), F.col(place))


def lifetime_victim(blocks: DataFrame, group: Sequence[str], edt: str, valid: str, place: str) -> DataFrame:
    """The block that dies first; of equals the one with the fewest valid pages."""
    return _first(blocks, group, F.col(edt), F.col(valid), F.col(place))


def sampled_victim(blocks: DataFrame, group: Sequence[str], count: int, by: Column, valid: str, place: str) -> DataFrame:
    """Of the ``count`` lowest blocks by an order (a counter, or a hash: random ones) the
    one with the fewest valid pages."""
    ranked = blocks.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(by, place)))
    return _first(ranked.where(F.col("__r") <= count).drop("__r"), group, F.col(valid), F.col(place))


def accumulate_victims(blocks: DataFrame, group: Sequence[str], invalid: str, edt: str, place: str, capacity: int, most: int) -> DataFrame:
    """Blocks with most reclaimable space until they free one block's capacity, at most
    ``most``; ``order`` is their rank by falling lifetime."""
    order = W.partitionBy(*group).orderBy(F.col(invalid).desc(), place)
    ranked = blocks.withColumns({"__n": F.row_number().over(order), "__before": F.coalesce(F.sum(invalid).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    chosen = ranked.where((F.col("__before") < capacity) & (F.col("__n") <= most)).drop("__n", "__before")
    return chosen.withColumn("order", F.row_number().over(W.partitionBy(*group).orderBy(F.col(edt).desc(), place)))


def lifetime_bucket(pages: DataFrame, edt: str, groups: int, name: str = "bucket") -> DataFrame:
    """Pages by lifetime in ``groups`` ranges whose widths grow like 1, 2, ..., groups.

    Bounds are found in one aggregate; the last range takes what lies beyond the bounds.
    """
    span = pages.agg(F.min(edt).alias("lo"), (F.max(edt) - F.min(edt) + 1).alias("width"), F.max(edt).alias("hi"))
    weight = groups * (groups + 1) // 2
    limits, assigned = [], F.lit(0).cast("long")
    for i in range(groups - 1):
        step = F.greatest(F.floor(F.lit(i + 1) * F.col("width") / weight).cast("long"), F.lit(1))
        assigned = assigned + step
        limits.append(F.least(F.col("lo") + assigned, F.col("hi")).alias(f"t{i}"))
    bounds = span.select(*limits)
    passed = F.lit(0)
    for i in range(groups - 1):
        passed = passed + (F.col(edt) >= bounds.select(f"t{i}").scalar()).cast("int")
    return pages.withColumn(name, passed)


def equal_groups(pages: DataFrame, order: Sequence[Column], count: int, within: Sequence[str] = (), name: str = "slice") -> DataFrame:
    """Contiguous slices of n div count rows in an order, the rest in the last one."""
    window = W.partitionBy(*within)
    n = F.count(F.lit(1)).over(window)
    place = F.row_number().over(window.orderBy(*order)) - 1
    size = F.greatest(F.floor(n / count), F.lit(1))
    return pages.withColumn(name, F.least(F.floor(place / size), F.lit(count - 1)).cast("int"))


def imbalanced_groups(members: DataFrame, group: Sequence[str], invalidations_column: str, threshold: int = 1) -> DataFrame:
    """Groups of two blocks or more whose invalidation counts lie ``threshold`` apart."""
    spread = (F.max(invalidations_column) - F.min(invalidations_column)).alias("spread")
    return members.groupBy(*group).agg(F.count(F.lit(1)).alias("blocks"), spread).where((F.col("blocks") > 1) & (F.col("spread") >= threshold))


def candidates_below_average(members: DataFrame, group: str, valid: str) -> DataFrame:
    """Blocks with fewer valid pages than the mean of their group."""
    mean = F.avg(valid).over(W.partitionBy(group))
    return members.withColumn("group_mean", mean).where(F.col(valid) < F.col("group_mean")).withColumn("group_mean", F.round("group_mean", 6))


def closest_block(wanted: DataFrame, blocks: DataFrame, on: Sequence[str], target: str, edt: str, block: str, cell: int = CELL) -> DataFrame:
    """For each wanted lifetime the open block of nearest lifetime, smaller block first.

    The nearest one is the last at or before the wanted lifetime or the first at or after it,
    so both sides are laid into one order and no pair of them is formed. Lifetimes fall in
    cells of ``cell`` values, each ordered on its own; of a cell only its first and last block
    take part in the order of a group's cells. Null lifetimes and groups take no part.
    """
    key, found = [F.col(c) for c in on], F.struct("__at", "__block")
    asked = wanted.select(*key, F.col(target).alias("__at"), F.lit(1).alias("__asked"), F.lit(None).cast(blocks.schema[block].dataType).alias("__block"))
    held = blocks.select(*key, F.col(edt).alias("__at"), F.lit(0).alias("__asked"), F.col(block).alias("__block"))
    rows = asked.unionByName(held).dropna(subset=[*on, "__at"]).groupBy(*on, "__at").agg(F.max("__asked").alias("__asked"), F.min("__block").alias("__block"))
    rows = rows.withColumns({"__cell": F.floor(F.col("__at") / cell).cast("long"), "__found": F.when(F.col("__block").isNotNull(), found)})
    # __asked is kept here so that the rows of both uses are one shuffle
    cells = rows.groupBy(*on, "__cell").agg(F.min("__found").alias("__first"), F.max("__found").alias("__last"), F.max("__asked").alias("__any"))
    carry = lambda c, order, end: F.last(c, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, end))
    group, inside = W.partitionBy(*on), W.partitionBy(*on, "__cell")
    cells = cells.withColumns({"__before": carry("__last", group.orderBy("__cell"), -1), "__after": carry("__first", group.orderBy(F.desc("__cell")), -1)})
    near = rows.withColumns({"__low": carry("__found", inside.orderBy("__at"), 0), "__high": carry("__found", inside.orderBy(F.desc("__at")), 0)}).where("__asked = 1")
    near = near.join(cells.where("__any = 1").select(*on, "__cell", "__before", "__after"), [*on, "__cell"])
    ends = [F.coalesce("__low", "__before"), F.coalesce("__high", "__after")]
    best = F.array_min(F.array_compact(F.array(*[F.when(e.isNotNull(), F.struct(F.abs(e["__at"] - F.col("__at")).alias("gap"), e["__block"].alias("block"))) for e in ends])))
    return near.withColumn("__best", best).where("__best is not null").select(*on, F.col("__at").alias(target), F.col("__best.block").alias(block), "__best.gap")


def range_gaps(ranges: DataFrame, group: Sequence[str], low: str, high: str) -> DataFrame:
    """Ranges with the gap that precedes each: how far it begins beyond all earlier ends."""
    earlier = W.partitionBy(*group).orderBy(low, high).rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(high).over(earlier)
    return ranges.withColumn("gap", F.greatest(F.col(low) - reach - 1, F.lit(0))).withColumn("gap", F.coalesce("gap", F.lit(0)))


def fill_gaps(ranges: DataFrame, group: Sequence[str], low: str, high: str) -> DataFrame:
    """Ranges lengthened so that each one reaches the next one's beginning."""
    following = F.lead(low).over(W.partitionBy(*group).orderBy(low, high))
    return ranges.withColumn(high, F.greatest(F.col(high), F.coalesce(following - 1, F.col(high))))


def needs_collection(blocks: DataFrame, state: str, open_blocks: int) -> DataFrame:
    """One row: whether collection must run: no block is empty and all but the open ones are
    full, or all are full and none is open."""
    count = lambda s: F.count_if(F.col(state) == s)
    total = F.count(F.lit(1))
    due = ((count("FULL") >= total - open_blocks) & (count("EMPTY") == 0)) | ((count("FULL") == total) & (count("OPEN") == 0))
    return blocks.agg(due.alias("collect"))


def pack_best_fit(items: DataFrame, group: str, item: str, size: str, bin_bytes: int = BIN_BYTES, most: int = BIN_BYTES // LEAST_ITEM) -> DataFrame:
    """group, item, size, bin: best fit, largest first, ``most`` items in a bin at most.

    The next choice depends on all earlier ones of a group (a write buffer), so each group
    is one task's work; groups are as small as a write buffer. Items larger than a bin have
    one of their own.
    """
    kind = {f.name: f.dataType.simpleString() for f in items.schema}
    schema = f"{group} {kind[group]}, {item} {kind[item]}, {size} {kind[size]}, bin long"

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_left, insort

        part = part.sort_values([size, item], ascending=[False, True], kind="stable")
        room, held, chosen = [], [], []
        for need in part[size].tolist():
            at = bisect_left(room, (need, -1))
            if at < len(room):
                left, bin_no = room.pop(at)
            else:
                left, bin_no = bin_bytes, len(held)
                held.append(0)
            held[bin_no] += 1
            chosen.append(bin_no)
            if held[bin_no] < most and left > need:
                insort(room, (left - need, bin_no))
        return part.assign(bin=chosen)[[group, item, size, "bin"]]

    return items.select(group, item, size).groupBy(group).applyInPandas(pack, schema)


def rewrite_candidates(pages: DataFrame, valid: str, next_gc: str, group: Sequence[str], size: str, budget: int) -> DataFrame:
    """Valid pages in falling order of their next rewrite, until a block's budget is filled."""
    from keelson.operators.aggregates import within_budget

    return within_budget(pages.where(F.col(valid)), group, [F.col(next_gc).desc()], size, budget)


def oldest_victim(blocks: DataFrame, group: Sequence[str], place: str) -> DataFrame:
    """First in, first out: the block that comes first in its list."""
    return _first(blocks, group, F.col(place))


def random_victim(blocks: DataFrame, group: Sequence[str], place: str, seed: int) -> DataFrame:
    """A random block of each group, the same for the same seed."""
    return _first(blocks, group, F.md5(F.concat(F.lit(f"{seed}:"), F.col(place).cast("string")).cast("binary")), F.col(place))
