"""Running totals and history windows, without one task for a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Keys in a cell of a running total, and cells in a block of cells.
CELL = 4096


def running_total(df: DataFrame, key: str, values: dict[str, str], cell: int = CELL) -> DataFrame:
    """df with running sums of its columns (result name -> column) in the order of an
    integer key, which is unique.

    Keys fall in cells of ``cell`` values; each cell is summed on its own, cells are totalled
    within blocks of cells, and only block totals are put in one order.
    """
    number = lambda width: F.floor(F.col(key) / width).cast("long")
    rows = df.withColumns({"__cell": number(cell), "__block": number(cell * cell)})
    sums = rows.groupBy("__block", "__cell").agg(*[F.sum(c).alias(f"__s{i}") for i, c in enumerate(values.values())])
    blocks = sums.groupBy("__block").agg(*[F.sum(f"__s{i}").alias(f"__b{i}") for i in range(len(values))])
    earlier = lambda order: order.rowsBetween(W.unboundedPreceding, -1)
    over = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    whole, block = earlier(W.orderBy("__block")), earlier(W.partitionBy("__block").orderBy("__cell"))
    blocks = blocks.select("__block", *[over(f"__b{i}", whole).alias(f"__b{i}") for i in range(len(values))])
    cells = sums.join(blocks, "__block").select("__cell", *[(over(f"__s{i}", block) + F.col(f"__b{i}")).alias(f"__s{i}") for i in range(len(values))])
    inner = W.partitionBy("__cell").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumns({f"__l{i}": F.sum(c).over(inner) for i, c in enumerate(values.values())})
    return local.join(cells, "__cell").select(*df.columns, *[(F.col(f"__l{i}") + F.col(f"__s{i}")).alias(name) for i, name in enumerate(values)])


def write_history(writes: DataFrame, page: str, version: str, keep: int = 8, name: str = "history") -> DataFrame:
    """Each write with the versions of its page's last ``keep`` writes, itself included."""
    frame = W.partitionBy(page).orderBy(version).rowsBetween(1 - keep, 0)
    return writes.withColumn(name, F.collect_list(version).over(frame))


def estimated_death(writes: DataFrame, page: str, version: str, keep: int = 8, name: str = "edt") -> DataFrame:
    """Each write with its page's estimated death: the last version plus the mean gap of the
    last ``keep`` writes, rounded down. The gaps of a run add up to its last less its first."""
    frame = W.partitionBy(page).orderBy(version).rowsBetween(1 - keep, 0)
    first, n = F.min(version).over(frame), F.count(F.lit(1)).over(frame)
    gap = F.when(n > 1, F.floor((F.col(version) - first) / (n - 1))).otherwise(0)
    return writes.withColumn(name, (F.col(version) + gap).cast("long"))


def estimate_error(estimates: DataFrame, page: str, version: str, edt: str, name: str = "error") -> DataFrame:
    """How far each write came from what was estimated at the write before."""
    before = F.lag(edt).over(W.partitionBy(page).orderBy(version))
    return estimates.withColumn(name, F.abs(before - F.col(version)))


def mean_gap(values: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """The mean gap between sorted values: their range over their number less one."""
    mean = (F.max(value) - F.min(value)) / F.nullif(F.count(value) - 1, F.lit(0))
    return values.groupBy(*group).agg(mean.alias("mean_gap"))


def next_collection(writes: DataFrame, edt: str, last: str, previous_gc: str, count: str, now: Column, name: str = "next_gc") -> DataFrame:
    """When a page should be rewritten by collection: its estimated death if it has three
    writes, was written since the last collection and that lies ahead; else twice now."""
    usable = (F.col(count) > 2) & (F.col(previous_gc) < F.col(last)) & (F.col(edt) > now)
    return writes.withColumn(name, F.when(usable, F.col(edt)).otherwise(2 * now))


def merge_runs(trace: DataFrame, order: str, kind: str, size: str, mergeable: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Consecutive rows of one mergeable kind become one with the sum of their sizes."""
    window = W.partitionBy(*group).orderBy(order)
    opens = (F.lag(kind).over(window) == F.col(kind)) & F.col(kind).isin(*mergeable)
    marked = trace.withColumn("__new", F.when(F.coalesce(opens, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("__run", F.sum("__new").over(window.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*group, "__run").agg(F.min(order).alias(order), F.first(kind).alias(kind), F.sum(size).alias(size), F.count(F.lit(1)).alias("merged")).drop("__run")


def count_before(trace: DataFrame, order: str, event: Column, name: str, group: Sequence[str] = ()) -> DataFrame:
    """How many events came strictly before each row: the number of the current file."""
    earlier = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return trace.withColumn(name, F.coalesce(F.sum(event.cast("long")).over(earlier), F.lit(0)))
