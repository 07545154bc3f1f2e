"""Windowed metrics over event streams; the same programs run over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_window(events: DataFrame, ts: str, width: str, metrics: dict[str, Column], group: Sequence[str] = (), slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, the group and metrics of each window. ``late`` is the watermark of a stream."""
    if late:
        events = events.withWatermark(ts, late)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    found = events.groupBy(window.alias("w"), *group).agg(*[c.alias(name) for name, c in metrics.items()])
    return found.select(F.col("w.start").alias("start"), *group, *metrics)


def sessions(events: DataFrame, ts: str, gap: str, key: Sequence[str], metrics: dict[str, Column], late: str | None = None) -> DataFrame:
    """Runs of a key's events without a pause longer than ``gap``."""
    if late:
        events = events.withWatermark(ts, late)
    found = events.groupBy(*key, F.session_window(ts, gap).alias("w")).agg(*[c.alias(name) for name, c in metrics.items()])
    return found.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *metrics)


def first_arrivals(events: DataFrame, ts: str, key: Sequence[str], late: str) -> DataFrame:
    """Insert-if-absent on a stream: one row of each key; state is kept within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))


def latest_places(writes: DataFrame, page: str, version: str, fields: Sequence[str]) -> DataFrame:
    """The current place of each page, updated with each batch. By version and not by
    arrival, so late writes change nothing. State has a row for each page."""
    last = F.max(F.struct(version, *fields)).alias("last")
    return writes.groupBy(page).agg(last).select(page, f"last.{version}", *[f"last.{f}" for f in fields])


def commit_horizon(entries: DataFrame, worker: str, gsn: str) -> DataFrame:
    """Each worker's highest hardened number; what lies at or below the least one is durable."""
    return entries.groupBy(worker).agg(F.max(gsn).alias("hardened"))


def transactions(entries: DataFrame, ts: str, key: Sequence[str], kind: str, opens: str, closes: str, late: str) -> DataFrame:
    """Opened transactions with their end, if it follows within the watermark's delay."""
    started = entries.where(F.col(kind) == opens).select(*key, F.col(ts).alias("started")).withWatermark("started", late)
    ended = entries.where(F.col(kind) == closes).select(*[F.col(k).alias(f"__{k}") for k in key], F.col(ts).alias("ended")).withWatermark("ended", late)
    same = [started[k] == ended[f"__{k}"] for k in key]
    bound = F.expr(f"ended >= started AND ended <= started + INTERVAL {late}")
    condition = bound
    for s in same:
        condition = condition & s
    return started.join(ended, condition, "leftOuter").select(*key, "started", "ended")


def write_metrics(metrics: DataFrame, path: str, checkpoint: str, every: str = "1 second"):
    """Starts writing closed windows as CSV rows; returns the streaming query."""
    sink = metrics.writeStream.format("csv").option("header", True).outputMode("append")
    return sink.option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def write_relation_versions(changes: DataFrame, apply, checkpoint: str):
    """Starts a stream of mutations: each batch of changes goes through ``apply(batch, id)``,
    which publishes the next version of a relation. A batch that is run again after a
    failure has the same id, so publishing by id makes it take effect once."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
