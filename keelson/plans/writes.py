"""Queries over page writes, lifetimes, reclaiming and metrics; events stand for writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import placement, running
from keelson.plans.tables import Catalogue, Tables

CATALOGUE = Catalogue()
add = CATALOGUE.add


def writes(t: Tables):
    """A page is a user, a version the event's id, a block 100 consecutive events."""
    return t.events.select(F.col("user_id").alias("pid"), F.col("event_id").alias("gsn"), F.floor(F.col("event_id") / 100).cast("long").alias("block"), "value")


_W = "(SELECT user_id AS pid, event_id AS gsn, event_id // 100 AS block, value FROM events)"
_FRAME = "(PARTITION BY pid ORDER BY gsn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
_EDT = f"(SELECT *, gsn + CASE WHEN count(*) OVER {_FRAME} > 1 THEN (gsn - min(gsn) OVER {_FRAME}) // (count(*) OVER {_FRAME} - 1) ELSE 0 END AS edt FROM {_W})"
_VALID = f"(SELECT block, count(*) AS total, sum(CASE WHEN nxt IS NULL THEN 1 ELSE 0 END)::BIGINT AS valid, sum(CASE WHEN nxt IS NULL THEN 0 ELSE 1 END)::BIGINT AS invalid FROM (SELECT *, lead(gsn) OVER (PARTITION BY pid ORDER BY gsn) AS nxt FROM {_W}) GROUP BY block)"
_BLOCKS = f"(SELECT v.*, block % 7 AS grp, e.edt FROM {_VALID} v JOIN (SELECT block AS b, CAST(max(edt) AS BIGINT) AS edt FROM {_EDT} GROUP BY block) e ON v.block = e.b)"


def estimates(t: Tables):
    return running.estimated_death(writes(t), "pid", "gsn")


def blocks(t: Tables):
    """block, total, valid, invalid, grp, edt."""
    lifetimes = estimates(t).groupBy("block").agg(F.max("edt").alias("edt"))
    return placement.validity(writes(t), "pid", "gsn", "block").join(lifetimes, "block").withColumn("grp", F.col("block") % 7)


@add("page_write_history", f"SELECT pid, gsn, array_to_string(list(gsn) OVER {_FRAME}, ',') AS history FROM {_W}")
def _(t):
    history = running.write_history(writes(t), "pid", "gsn")
    return history.select("pid", "gsn", F.array_join(F.transform("history", lambda g: g.cast("string")), ",").alias("history"))


@add("death_time_estimate", f"SELECT pid, gsn, CAST(edt AS BIGINT) AS edt FROM {_EDT}")
def _(t):
    return estimates(t).select("pid", "gsn", "edt")


@add("edt_error", f"SELECT pid, count(e) AS n, round(avg(e), 6) AS error FROM (SELECT pid, abs(lag(edt) OVER (PARTITION BY pid ORDER BY gsn) - gsn) AS e FROM {_EDT}) GROUP BY pid")
def _(t):
    errors = running.estimate_error(estimates(t), "pid", "gsn", "edt")
    return errors.groupBy("pid").agg(F.count("error").alias("n"), F.round(F.avg("error"), 6).alias("error"))


@add("edt_mean_gap", f"SELECT block, round((max(edt) - min(edt)) * 1.0 / nullif(count(edt) - 1, 0), 6) AS mean_gap FROM {_EDT} WHERE edt > 8 GROUP BY block")
def _(t):
    gaps = running.mean_gap(estimates(t).where("edt > 8"), "edt", ["block"])
    return gaps.withColumn("mean_gap", F.round("mean_gap", 6))


@add("next_collection", f"SELECT pid, gsn, CASE WHEN n > 2 AND gsn - 50 < gsn AND edt > 5000 THEN edt ELSE 10000 END AS next_gc FROM (SELECT *, count(*) OVER (PARTITION BY pid ORDER BY gsn) AS n FROM {_EDT})")
def _(t):
    from pyspark.sql import Window as W

    counted = estimates(t).withColumns({"n": F.count(F.lit(1)).over(W.partitionBy("pid").orderBy("gsn")), "gc": F.col("gsn") - 50})
    return running.next_collection(counted, "edt", "gsn", "gc", "n", F.lit(5000)).select("pid", "gsn", F.col("next_gc").cast("long").alias("next_gc"))


_LIMITS = "(SELECT lo, width, hi, lo + greatest(1 * width // 10, 1) AS t0, lo + greatest(1 * width // 10, 1) + greatest(2 * width // 10, 1) AS t1, lo + greatest(1 * width // 10, 1) + greatest(2 * width // 10, 1) + greatest(3 * width // 10, 1) AS t2 FROM (SELECT min(edt) AS lo, max(edt) AS hi, max(edt) - min(edt) + 1 AS width FROM {e}))"


@add("edt_bucket", "SELECT pid, gsn, CASE WHEN edt < least(t0, hi) THEN 0 WHEN edt < least(t1, hi) THEN 1 WHEN edt < least(t2, hi) THEN 2 ELSE 3 END AS bucket FROM " + _EDT + ", " + _LIMITS.format(e=_EDT))
def _(t):
    return placement.lifetime_bucket(estimates(t), "edt", 4).select("pid", "gsn", "bucket")


@add("edt_equal_groups", f"SELECT block, pid, gsn, least((row_number() OVER w - 1) // greatest(count(*) OVER (PARTITION BY block) // 4, 1), 3) AS slice FROM {_EDT} WINDOW w AS (PARTITION BY block ORDER BY edt DESC, gsn)")
def _(t):
    return placement.equal_groups(estimates(t), [F.desc("edt"), F.col("gsn")], 4, ["block"]).select("block", "pid", "gsn", "slice")


@add("page_latest_location", f"SELECT pid, max(gsn) AS gsn, arg_max(block, gsn) AS block FROM {_W} GROUP BY pid")
def _(t):
    return placement.latest_versions(writes(t), "pid", "gsn", ["block"])


@add("page_invalidations", f"SELECT pid, gsn, block, nxt AS replaced_at FROM (SELECT *, lead(gsn) OVER (PARTITION BY pid ORDER BY gsn) AS nxt FROM {_W}) WHERE nxt IS NOT NULL")
def _(t):
    return placement.invalidations(writes(t), "pid", "gsn", "block")


@add("block_validity", f"SELECT block, total, valid, invalid FROM {_VALID}")
def _(t):
    return placement.validity(writes(t), "pid", "gsn", "block")


@add("state_size", f"SELECT CAST(sum(CASE WHEN invalid = total THEN 0 WHEN valid = 0 THEN 0 WHEN block % 2 = 0 THEN 4096 ELSE valid END) AS BIGINT) AS bytes FROM {_VALID}")
def _(t):
    state = F.when(F.col("valid") == 0, "EMPTY").when(F.col("block") % 2 == 0, "FULL").otherwise("OPEN")
    return placement.size_by_state(blocks(t).withColumn("state", state), "state", "valid", 4096)


def _victim(order: str, where: str = "TRUE") -> str:
    return f"SELECT grp, block, valid, edt FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {order}) AS r FROM {_BLOCKS} WHERE {where}) WHERE r = 1"


@add("gc_greedy", _victim("valid, block", "valid < total"))
def _(t):
    return placement.greedy_victim(blocks(t), ["grp"], "valid", "total", "block").select("grp", "block", "valid", "edt")


@add("gc_edt", _victim("edt, valid, block"))
def _(t):
    return placement.lifetime_victim(blocks(t), ["grp"], "edt", "valid", "block").select("grp", "block", "valid", "edt")


@add("gc_min_invalidation", f"SELECT grp, block, valid, edt FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY valid, block) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY invalid, block) AS r FROM {_BLOCKS}) WHERE r <= 3) WHERE r2 = 1")
def _(t):
    return placement.sampled_victim(blocks(t), ["grp"], 3, F.col("invalid"), "valid", "block").select("grp", "block", "valid", "edt")


@add("gc_2r_accumulate", f"SELECT grp, block, invalid, row_number() OVER (PARTITION BY grp ORDER BY edt DESC, block) AS place FROM (SELECT *, row_number() OVER w AS n, coalesce(sum(invalid) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {_BLOCKS} WINDOW w AS (PARTITION BY grp ORDER BY invalid DESC, block)) WHERE b < 250 AND n <= 8")
def _(t):
    chosen = placement.accumulate_victims(blocks(t), ["grp"], "invalid", "edt", "block", 250, 8)
    return chosen.select("grp", "block", "invalid", F.col("order").cast("long").alias("place"))


@add("gc_fifo", _victim("block"))
def _(t):
    return placement.oldest_victim(blocks(t), ["grp"], "block").select("grp", "block", "valid", "edt")


@add("gc_random", _victim("md5('7:' || block), block"))
def _(t):
    return placement.random_victim(blocks(t), ["grp"], "block", 7).select("grp", "block", "valid", "edt")


@add("gc_trigger", f"SELECT count(*) FILTER (valid > 0) >= count(*) - 5 AND count(*) FILTER (valid = 0) = 0 AS collect FROM {_VALID}")
def _(t):
    state = F.when(F.col("valid") > 0, "FULL").otherwise("EMPTY")
    return placement.needs_collection(placement.validity(writes(t), "pid", "gsn", "block").withColumn("state", state), "state", 5)


@add("imbalance_groups", f"SELECT grp, count(*) AS blocks, max(invalid) - min(invalid) AS spread FROM {_BLOCKS} GROUP BY grp HAVING count(*) > 1 AND max(invalid) - min(invalid) >= 1")
def _(t):
    return placement.imbalanced_groups(blocks(t), ["grp"], "invalid")


@add("imbalance_candidates", f"SELECT grp, block, round(m, 6) AS group_mean FROM (SELECT *, avg(valid) OVER (PARTITION BY grp) AS m FROM {_BLOCKS}) WHERE valid < m")
def _(t):
    return placement.candidates_below_average(blocks(t), "grp", "valid").select("grp", "block", "group_mean")


@add("closest_edt_block", f"SELECT grp, want, arg_min(block, (abs(edt - want), block)) AS block, min(abs(edt - want)) AS gap FROM {_BLOCKS} JOIN (SELECT DISTINCT block % 7 AS g, block * 90 AS want FROM {_W}) ON grp = g GROUP BY grp, want")
def _(t):
    wanted = writes(t).select((F.col("block") % 7).alias("grp"), (F.col("block") * 90).alias("want")).distinct()
    return placement.closest_block(wanted, blocks(t), ["grp"], "want", "edt", "block")


_RANGES = f"(SELECT block, block % 7 AS grp, min(edt) AS lo, CAST(quantile_disc(edt, 0.2) AS BIGINT) AS hi FROM {_EDT} GROUP BY block)"


def ranges(t: Tables):
    """Each block's least lifetime and the one that a fifth of its pages don't exceed."""
    from pyspark.sql import Window as W

    ranked = estimates(t).withColumns({"r": F.row_number().over(W.partitionBy("block").orderBy("edt")), "n": F.count(F.lit(1)).over(W.partitionBy("block"))})
    fifth = F.min(F.when(F.col("r") >= F.ceil(F.col("n") * 0.2), F.col("edt"))).alias("hi")
    return ranked.groupBy("block").agg(F.min("edt").alias("lo"), fifth).withColumn("grp", F.col("block") % 7)


@add("edt_range_gaps", f"SELECT grp, block, coalesce(greatest(lo - max(hi) OVER (PARTITION BY grp ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0), 0) AS gap FROM {_RANGES}")
def _(t):
    return placement.range_gaps(ranges(t), ["grp"], "lo", "hi").select("grp", "block", "gap")


@add("edt_fill_gaps", f"SELECT grp, block, greatest(hi, coalesce(lead(lo) OVER (PARTITION BY grp ORDER BY lo, hi) - 1, hi)) AS hi FROM {_RANGES}")
def _(t):
    return placement.fill_gaps(ranges(t), ["grp"], "lo", "hi").select("grp", "block", "hi")


@add("bin_pack_bfd", None)
def _(t):
    items = writes(t).select("block", "gsn", F.pmod(F.col("gsn") * 2654435761, F.lit(2049)).alias("size"))
    return placement.pack_best_fit(items.withColumn("size", F.col("size") + 1000), "block", "gsn", "size")


@add("gc_write_back", f"SELECT block, gsn, edt FROM (SELECT *, coalesce(sum(10) OVER (PARTITION BY block ORDER BY edt DESC, gsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {_EDT} WHERE gsn % 3 = 0) WHERE b < 200")
def _(t):
    from keelson.operators.aggregates import within_budget

    pages = estimates(t).where("gsn % 3 = 0").withColumn("size", F.lit(10))
    return within_budget(pages, ["block"], [F.desc("edt"), F.col("gsn")], "size", 200).select("block", "gsn", "edt")


@add("per_second_metrics", "SELECT date_trunc('second', ts) AS second, count(*) AS tx, count(*) FILTER (event_type = 'view') AS reads, round(sum(value), 4) AS bytes FROM events GROUP BY 1")
def _(t):
    from keelson.streaming.metrics import per_window

    metrics = per_window(t.events, "ts", "1 second", {"tx": F.count(F.lit(1)), "reads": F.count_if(F.col("event_type") == "view"), "bytes": F.round(F.sum("value"), 4)})
    return metrics.select(F.col("start").alias("second"), "tx", "reads", "bytes")


@add("cumulative_metrics", "SELECT second, tx, CAST(sum(tx) OVER (ORDER BY second) AS BIGINT) AS total FROM (SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS second, count(*) AS tx FROM events GROUP BY 1)")
def _(t):
    second = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("second")
    counts = t.events.groupBy(second).agg(F.count(F.lit(1)).alias("tx"))
    return running.running_total(counts, "second", {"total": "tx"}).select("second", "tx", "total")


@add("dirty_checkpoint_set", f"SELECT pid, gsn FROM {_W} WHERE gsn % 2 = 0 AND gsn > 0 AND gsn <= 5000 AND block <= 40")
def _(t):
    return writes(t).where((F.col("gsn") % 2 == 0) & F.col("gsn").between(1, 5000) & (F.col("block") <= 40)).select("pid", "gsn")


@add("commit_horizon", "SELECT min(last_gsn) AS horizon, max(last_gsn) AS newest, count(*) AS workers FROM (SELECT user_id % 8 AS w, max(event_id) AS last_gsn FROM events GROUP BY 1)")
def _(t):
    last = t.events.groupBy((F.col("user_id") % 8).alias("w")).agg(F.max("event_id").alias("last_gsn"))
    return last.agg(F.min("last_gsn").alias("horizon"), F.max("last_gsn").alias("newest"), F.count(F.lit(1)).alias("workers"))


@add("committed_transactions", "SELECT event_id FROM events WHERE event_type = 'purchase' AND event_id <= (SELECT min(g) FROM (SELECT max(event_id) AS g FROM events GROUP BY user_id % 8))")
def _(t):
    last = t.events.groupBy((F.col("user_id") % 8).alias("w")).agg(F.max("event_id").alias("g"))
    return t.events.where((F.col("event_type") == "purchase") & (F.col("event_id") <= last.agg(F.min("g")).scalar())).select("event_id")


@add("trace_run_merge", "SELECT user_id, min(event_id) AS event_id, event_type, count(*) AS merged, round(sum(value), 4) AS value FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type AND event_type IN ('view', 'click') THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, event_type, run")
def _(t):
    runs = running.merge_runs(t.events.select("user_id", "event_id", "event_type", "value"), "event_id", "event_type", "value", ["view", "click"], ["user_id"])
    return runs.select("user_id", "event_id", "event_type", "merged", F.round("value", 4).alias("value"))


@add("trace_file_keys", "SELECT event_id, coalesce(count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS file_key FROM events")
def _(t):
    return running.count_before(t.events, "event_id", F.col("event_type") == "purchase", "file_key", ["user_id"]).select("event_id", "file_key")


@add("transaction_spans", "SELECT user_id, tx, count(*) AS entries, min(event_id) AS first, max(event_id) AS last FROM (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS tx FROM events) WHERE tx > 0 GROUP BY user_id, tx")
def _(t):
    from pyspark.sql import Window as W

    opened = F.count_if(F.col("event_type") == "signup").over(W.partitionBy("user_id").orderBy("event_id"))
    spans = t.events.withColumn("tx", opened).where("tx > 0").groupBy("user_id", "tx")
    return spans.agg(F.count(F.lit(1)).alias("entries"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@add("session_users", "SELECT user_id, min(ts) AS start, count(*) AS events FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, s")
def _(t):
    sessions = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "4 hours").alias("w"))
    return sessions.agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events")
