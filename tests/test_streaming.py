"""The streaming programs over files that arrive in batches."""

import uuid

import pytest
from pyspark.sql import functions as F

from keelson.streaming import metrics

SCHEMA = "ts timestamp, worker int, pid int, gsn long, kind string, block int"


@pytest.fixture
def feed(spark, tmp_path):
    """feed(program, mode, batches): the program's output over batches of rows."""

    def run(program, mode, batches):
        source, name = tmp_path / "in", f"out_{uuid.uuid4().hex[:8]}"
        source.mkdir()
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        out = program(stream).writeStream.outputMode(mode).format("memory").queryName(name)
        query = out.option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            for i, rows in enumerate(batches):
                part = spark.createDataFrame(rows, SCHEMA).coalesce(1)
                part.write.json(str(tmp_path / f"part{i}"))
                for file in (tmp_path / f"part{i}").glob("*.json"):
                    file.rename(source / f"{i}-{file.name}")
                query.processAllAvailable()
        finally:
            query.stop()
        return spark.table(name).collect()

    return run


def at(seconds):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


def row(s, worker=0, pid=0, gsn=0, kind="data", block=0):
    return (at(s), worker, pid, gsn, kind, block)


def test_windows_close_behind_the_watermark(feed):
    batches = [[row(0.1), row(0.9), row(1.5)], [row(5.0), row(0.5)], [row(20.0), row(1.0)], [row(21.0)]]
    program = lambda s: metrics.per_window(s, "ts", "1 second", {"n": F.count(F.lit(1))}, late="10 seconds")
    got = {r.start.second: r.n for r in feed(program, "append", batches)}
    assert got[0] == 3 and got[1] in (1, 2) and got[5] == 1


def test_latest_place_is_by_version(feed):
    batches = [[row(0, pid=1, gsn=5, block=7), row(0, pid=2, gsn=1, block=1)], [row(1, pid=1, gsn=3, block=9), row(1, pid=2, gsn=8, block=4)]]
    out = feed(lambda s: metrics.latest_places(s, "pid", "gsn", ["block"]), "complete", batches)
    assert {(r.pid, r.gsn, r.block) for r in out} == {(1, 5, 7), (2, 8, 4)}


def test_first_arrival_wins(feed):
    batches = [[row(0, pid=1, block=1)], [row(1, pid=1, block=2), row(1, pid=2, block=3)], [row(2, pid=2, block=4)]]
    out = feed(lambda s: metrics.first_arrivals(s, "ts", ["pid"], "1 minute").select("pid", "block"), "append", batches)
    assert {(r.pid, r.block) for r in out} == {(1, 1), (2, 3)}


def test_commit_horizon(feed):
    batches = [[row(0, worker=1, gsn=4), row(0, worker=2, gsn=9)], [row(1, worker=1, gsn=7)]]
    out = feed(lambda s: metrics.commit_horizon(s, "worker", "gsn"), "complete", batches)
    assert min(r.hardened for r in out) == 7


def test_sessions(feed):
    batches = [[row(0, worker=1), row(3, worker=1), row(30, worker=1)], [row(200, worker=2)], [row(201, worker=2)]]
    program = lambda s: metrics.sessions(s, "ts", "10 seconds", ["worker"], {"n": F.count(F.lit(1))}, late="5 seconds")
    assert sorted((r.worker, r.n) for r in feed(program, "append", batches)) == [(1, 1), (1, 2)]


def test_transactions_are_paired(feed):
    batches = [
        [row(0, worker=1, gsn=1, kind="start"), row(0, worker=2, gsn=2, kind="start")],
        [row(2, worker=1, gsn=1, kind="commit")],
        [row(300, worker=3, gsn=3, kind="start"), row(300, worker=3, gsn=3, kind="commit")],
        [row(600, worker=4, gsn=4, kind="start"), row(600, worker=4, gsn=4, kind="commit")],
    ]
    program = lambda s: metrics.transactions(s, "ts", ["worker", "gsn"], "kind", "start", "commit", "60 seconds")
    ends = {r.worker: r.ended for r in feed(program, "append", batches)}
    assert ends[1] == at(2) and ends[2] is None and ends[3] == at(300)


def test_metrics_sink_and_versions(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([row(0.2), row(0.4), row(90)], SCHEMA).coalesce(1).write.json(str(source))
    stream = spark.readStream.schema(SCHEMA).json(str(source))
    windows = metrics.per_window(stream, "ts", "1 second", {"n": F.count(F.lit(1))}, late="5 seconds")
    query = metrics.write_metrics(windows, str(tmp_path / "out"), str(tmp_path / "c1"))
    query.processAllAvailable()
    query.stop()
    assert [r.n for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == ["2"]
    publish = lambda batch, number: batch.write.mode("overwrite").parquet(str(tmp_path / f"v{number}"))
    query = metrics.write_relation_versions(spark.readStream.schema(SCHEMA).json(str(source)), publish, str(tmp_path / "c2"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "v0")).count() == 3
