"""Contracts of the operators on small fixtures, beside the SQL comparison."""

import random

import pytest
from pyspark.sql import functions as F

from keelson.functions import generate, scalar
from keelson.operators import access, blob, joins, mutate, placement, running
from keelson.sources import files


@pytest.fixture(scope="module")
def relation(spark):
    return spark.createDataFrame([(i, 5 * i) for i in range(100)], "primary_id int, data int").repartition(4)


def test_relation_contract(spark, relation):
    assert access.count_entries(relation).first().entries == 100
    assert all(access.point_lookup(relation, {"primary_id": i}).first().data == 5 * i for i in (0, 42, 99))
    assert access.point_lookup(relation, {"primary_id": 100}).count() == 0
    deltas = spark.createDataFrame([(i, 5 * i) for i in range(120)], "primary_id int, d int")
    doubled = mutate.modify(relation, deltas, ["primary_id"], {"data": "d"})
    assert {(r.primary_id, r.data) for r in doubled.collect()} == {(i, 10 * i) for i in range(100)}
    stopped = access.take_while(relation, ["primary_id"], F.col("primary_id") != 50)
    assert sorted(r.primary_id for r in stopped.collect()) == list(range(50))
    assert access.take_while(relation, ["primary_id"], F.lit(True)).count() == 100
    gone = mutate.erase(relation, relation, ["primary_id"])
    assert access.not_empty(gone).first().not_empty is False
    flags = mutate.erased(relation, deltas, ["primary_id"]).collect()
    assert {r.primary_id: r.erased for r in flags} == {i: i < 100 for i in range(120)}
    assert not any(r.erased for r in mutate.erased(gone, deltas, ["primary_id"]).collect())


def test_model_of_mutations(spark):
    rng = random.Random(1)
    model = {k: rng.randrange(1000) for k in rng.sample(range(300), 150)}
    table = spark.createDataFrame(list(model.items()), "k int, v int")
    new = [(rng.randrange(300), rng.randrange(1000), s) for s in range(200)]
    arrived = spark.createDataFrame(new, "k int, v int, s int")
    base = table.withColumn("s", F.lit(-1))
    inserted = mutate.insert_if_absent(base, arrived, ["k"], ["s"])
    for k, v, _ in new:
        model.setdefault(k, v)
    assert {r.k: r.v for r in inserted.collect()} == model
    again = mutate.insert_if_absent(inserted, arrived, ["k"], ["s"])
    assert sorted(again.collect()) == sorted(inserted.collect())
    updates = spark.createDataFrame([(k, None if k % 7 == 0 else -k) for k in range(0, 300, 3)], "k int, v int")
    model |= {k: None if k % 7 == 0 else -k for k in range(0, 300, 3) if k in model}
    assert {r.k: r.v for r in mutate.update_if_present(inserted, updates, ["k"]).collect()} == model


def test_scans(spark):
    rng = random.Random(2)
    rows = sorted({(rng.randrange(6), rng.randrange(6), rng.randrange(6)) for _ in range(120)})
    table = spark.createDataFrame(rows, "a int, b int, c int").repartition(3)
    for low, high in (((1, 4), (3, 2)), ((0, 0, 3), (5, 1, 1)), ((2,), (2,))):
        want = [r for r in rows if low <= r[: len(low)] and r[: len(high)] <= high]
        assert [tuple(r) for r in access.scan(table, ["a", "b", "c"], low, high).collect()] == want
        assert [tuple(r) for r in access.scan(table, ["a", "b", "c"], low, high, descending=True).collect()] == want[::-1]
    assert [tuple(r) for r in access.prefix_scan(table, ["a", "b", "c"], [2, 3]).collect()] == [r for r in rows if r[:2] == (2, 3)]


def test_range_filter_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = access.scan(orders, ["o_orderkey"], [10], [20])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderkey,10)" in plan and "LessThanOrEqual(o_orderkey,20)" in plan


def test_running_total(spark):
    rng = random.Random(3)
    keys = sorted(rng.sample(range(-5000, 100000), 700))
    rows = [(k, rng.randrange(50)) for k in keys]
    got = running.running_total(spark.createDataFrame(rows, "k long, v long"), "k", {"t": "v"}, cell=16).orderBy("k").collect()
    total, want = 0, []
    for _, v in rows:
        total += v
        want.append(total)
    assert [r.t for r in got] == want


def test_death_time(spark):
    rng = random.Random(4)
    rows = [(p, g) for g in range(400) for p in [rng.randrange(9)]]
    got = {(r.p, r.g): r.edt for r in running.estimated_death(spark.createDataFrame(rows, "p int, g long"), "p", "g").collect()}
    seen = {}
    for p, g in rows:
        h = seen.setdefault(p, [])
        h.append(g)
        last = h[-8:]
        gaps = [b - a for a, b in zip(last, last[1:])]
        assert got[p, g] == g + (sum(gaps) // len(gaps) if gaps else 0)


def test_blobs(spark):
    pages = [bytes([11 + 11 * (k + 1) * p for p in range(3) for _ in range(4096)]) for k in range(3)]
    table = spark.createDataFrame(list(enumerate(pages)) + [(7, pages[0]), (8, b"")], "id int, blob binary")
    ranked = blob.rank_by_content(table.where("id < 3"), [], "blob", "id").orderBy("rank").collect()
    assert [r.id for r in ranked] == [0, 1, 2]
    index = blob.content_index(table, "id", "blob")
    assert {r.id: r.copies for r in index.collect()} == {0: 2, 1: 1, 2: 1, 8: 1}
    assert {(r.id, r.first) for r in blob.duplicates(table, "id", "blob").collect()} == {(7, 0)}
    assert {r.id for r in blob.describe(table, "id", "blob").collect()} == {0, 1, 2, 7}
    part = table.where("id = 1").select(blob.load("blob").alias("p"), blob.read_range("blob", F.lit(4095), F.lit(3)).alias("r"), blob.read_range("blob", F.lit(99999), F.lit(3)).alias("n")).first()
    assert bytes(part.p) == pages[1][:4096] and bytes(part.r) == pages[1][4095:4098] and part.n is None
    grown = blob.grow(table.where("id = 2"), table.where("id = 2").withColumnRenamed("blob", "more"), "id", "blob", "more").first()
    assert bytes(grown.blob) == pages[2] * 2


def test_compression(spark):
    import zlib

    table = spark.createDataFrame([(0, bytes(1024)), (1, bytes(range(256)) * 40), (2, None)], "id int, blob binary")
    got = {r.id: (r.z.bytes, r.z.stored) for r in table.select("id", blob.compressed_size("blob").alias("z")).collect()}
    assert got[0] == (len(zlib.compress(bytes(1024), 1)), 4096) and got[1][1] % 4096 == 0 and got[2] == (None, None)


def test_extents(spark):
    sizes = blob.tier_sizes(100)
    assert sizes[:9] == [1, 2, 4, 8, 16, 32, 64, 128, 256] and sizes[9] == 384
    tiers = blob.tier_table(spark, 100)
    ends = tiers.select("tier", blob.extent_count(F.col("low") + 1).alias("first"), blob.extent_count(F.col("cumulative_pages")).alias("last"))
    assert all(r.first == r.last == r.tier + 1 for r in ends.collect())
    got = spark.createDataFrame([(0,), (1,), (7,), (1000,), (12345,)], "n long").select("n", blob.tail_split(F.col("n")).alias("t")).collect()
    assert [sum(sizes[t] for t in r.t) for r in got] == [0, 1, 7, 1000, 12345]
    assert all(r.t == sorted(r.t, reverse=True) for r in got)


def test_best_fit(spark):
    rng = random.Random(5)
    rows = [(i % 4, i, rng.randrange(500, 4097)) for i in range(400)] + [(9, 1000, 5000)]
    got = placement.pack_best_fit(spark.createDataFrame(rows, "g int, i long, s long"), "g", "i", "s").collect()
    assert sorted((r.g, r.i, r.s) for r in got) == sorted(rows)
    bins = {}
    for r in got:
        bins.setdefault((r.g, r.bin), []).append(r.s)
    assert all(len(b) <= 2 and (sum(b) <= 4096 or len(b) == 1) for b in bins.values())


def test_intervals(spark):
    bounds = spark.createDataFrame([(i, i * i, (i + 1) * (i + 1)) for i in range(50)], "i int, low long, high long")
    got = joins.assign_interval(spark.range(-10, 2600), F.col("id"), bounds, "low", "high")
    assert {r.id: r.i for r in got.collect()} == {v: int(v**0.5) for v in range(2500)}
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert joins.assign_interval(spark.range(5), F.col("id"), bounds.limit(0), "low", "high").count() == 0


def test_scalars(spark):
    edge = [-(2**31), -1, 0, 1, 256, 2**31 - 1]
    df = spark.createDataFrame([(v,) for v in edge], "v int")
    assert [r.v for r in df.orderBy(scalar.fold_int(F.col("v"))).collect()] == edge
    big = [-(2**63), -1, 0, 1, 2**63 - 1]
    longs = spark.createDataFrame([(v,) for v in big], "v long")
    assert [r.v for r in longs.orderBy(scalar.fold_long(F.col("v"))).collect()] == big
    texts = spark.createDataFrame([("abc", "abd"), ("", "x"), ("same", "same"), ("ab", "abc")], "a string, b string")
    assert [r[0] for r in texts.select(scalar.shared_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 4, 2]
    words = sorted({"apple", "apply", "applying", "b", "bad", "z"})
    pairs = spark.createDataFrame(list(zip(words, words[1:])), "a string, b string").withColumn("s", scalar.separator(F.col("a"), F.col("b")))
    assert all(r.a < r.s <= r.b for r in pairs.collect())
    one = spark.range(1).select(scalar.last_name(F.lit(371)).alias("n"), scalar.pages_of(F.lit(4097)).alias("p"), scalar.write_amplification(F.lit(True), F.lit(True), F.lit(0.5), F.lit(1.0)).alias("w"), scalar.device_path(F.lit("use /dev/nvme2n1 now")).alias("d")).first()
    assert tuple(one) == ("PRICALLYOUGHT", 2, 2.0, "/dev/nvme2")


def test_generators(spark):
    n, pages = 20000, 1000
    for kind in ("sequential", "uniform", "zipf"):
        pattern = generate.access_pattern(spark, n, pages, kind)
        low, high, kinds = pattern.agg(F.min("pid"), F.max("pid"), F.countDistinct("pid")).first()
        assert 0 <= low and high < pages and kinds > 900
    hot = generate.access_pattern(spark, n, pages, "zones", zones="s0.9 f0.1 uniform s0.1 f0.9 uniform")
    assert abs(hot.where("pid < 100").count() / n - 0.9) < 0.02
    skewed = generate.access_pattern(spark, n, pages, "zipf", theta=0.99).groupBy("pid").count().orderBy(F.desc("count")).first()
    assert 0.05 < skewed["count"] / n < 0.25
    with pytest.raises(ValueError):
        generate.parse_zones("s0.9 f0.1 uniform")
    moved = spark.range(997).select(generate.permutation(997, 5, F.col("id")).alias("p"))
    assert moved.distinct().count() == 997
    sizes = spark.range(4000).select(generate.gamma_sizes(1.5, 16384, 1)(F.col("id")).alias("s"))
    assert abs(sizes.agg(F.avg("s")).first()[0] / 16384 - 1) < 0.1


def most_rows_of_a_join(node):
    """The most rows that any join of an executed plan gave."""
    own = node.metrics().get("numOutputRows") if "Join" in node.nodeName() else None
    children = node.children()
    return max([own.get().value() if own and own.isDefined() else 0, *[most_rows_of_a_join(children.apply(i)) for i in range(children.size())]])


def test_closest_block(spark):
    rng = random.Random(4)
    blocks = [(g, rng.randrange(-3000, 3000) * rng.choice([1, 1, 50]), b) for b, g in enumerate([1] * 400 + [2] * 3 + [3, None])]
    wanted = sorted({(g, rng.randrange(-4000, 4000) * rng.choice([1, 1, 60])) for g in [1] * 600 + [2] * 40 + [3, 3, 4]})
    held = spark.createDataFrame(rng.sample(blocks, len(blocks)), "g int, edt long, b long").repartition(3)
    asked = spark.createDataFrame([*wanted, (None, 5)], "g int, want long")
    nearest = {(g, w): min((abs(e - w), b) for h, e, b in blocks if h == g) for g, w in wanted if g != 4}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for cell in (7, placement.CELL):
            got = placement.closest_block(asked, held, ["g"], "want", "edt", "b", cell)
            assert sorted(tuple(r) for r in got.collect()) == sorted((*k, b, gap) for k, (gap, b) in nearest.items())
            assert most_rows_of_a_join(got._jdf.queryExecution().executedPlan()) <= len(wanted)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("monthly_views, page_len,x\n# note\n 5,100,z\n6 , 200,z\n")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), files.SCHEMAS["page_views"], comment="#", ignore_extra=True).collect()
    assert [tuple(r) for r in got] == [(100, 5), (200, 6)]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "a.csv"), files.SCHEMAS["page_views"])
    (tmp_path / "a.json").write_text('{"text": "one", "id": 1}\n{"text": "two"}\n')
    assert [r.text for r in files.read_json_lines(spark, str(tmp_path / "a.json"), "text string").collect()] == ["one", "two"]
    trace = [
        'SYS_openat(0xffffff9c, 0x7ff, 0x80000, 0) = 3', "SYS_read(3, 0x7ff, 832) = 832", "SYS_read(4, 0x7ff, 100) = 100",
        "SYS_newfstatat(0xffffff9c, 0x1, 0x2, 256) = 0", "SYS_openat(0xffffff9c, 0x7ff, 0, 0) = -2", "SYS_write(3, 0x1, 10) = 10",
        "SYS_brk(0) = 5", "SYS_write(3, 0x1, 20) = 20", "SYS_close(3) = 0", "SYS_write(5, 0x1, 7) = 7", "not a call",
    ]
    lines = spark.createDataFrame(list(enumerate(trace)), "n int, line string")
    rows = files.replay(files.parse_trace(lines, "n", "line"), "n").orderBy("n").collect()
    assert [(r.op, r.fd, r.size, r.flags, r.file_key) for r in rows] == [
        ("SYS_openat", 3, 0, 0x80000, 0), ("SYS_read", 3, 932, 0, 0), ("SYS_newfstatat", 100, 0, 256, 0),
        ("SYS_write", 3, 30, 0, 0), ("SYS_close", 3, 0, 0, 0), ("SYS_write", 5, 7, 0, 1),
    ]
    stats = files.file_stat(files.read_files(spark, str(tmp_path), "a.*"), spark.createDataFrame([("a.json",), ("none",)], "name string"))
    assert {r.name: r.length for r in stats.collect()} == {"a.json": (tmp_path / "a.json").stat().st_size, "none": None}
    files.write_relation(spark.range(1000), str(tmp_path / "rel"), ["id"], 4)
    assert spark.read.parquet(str(tmp_path / "rel")).count() == 1000
    files.append_trace(lines, str(tmp_path / "log"))
    files.append_trace(lines, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log")).count() == 2 * len(trace)
