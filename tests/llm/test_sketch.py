import hashlib
import random

import pytest
from pyspark.sql import functions as F

from keelson.llm import sketch


def rows():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i * rng.choice([1, 1, 700, 90000]) + 3, text(rng.choice([0, 1, 4, 5, 6, 40, 400])), "x") for i in range(160)]
    out = list({r[0]: r for r in out}.values())
    out += [(2, None, "x"), (1, "", "x"), (0, " \t\n", "x"), (-5, "É é " * 9000, "x"), (1 << 60, text(300), "x")]
    return out


def test_pairs_by_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, fingerprint string").repartition(7)
    got = {r.doc_id: r for r in sketch.edited_pairs(docs).collect()}
    order = sorted(((i, t or "") for i, t, _ in data), reverse=True)
    prints = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got.pop(i)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        kept = [int(r.fingerprint[k : k + 16], 16) for k in range(0, len(r.fingerprint), 16)]
        signed = [h - (1 << 64) if h >> 63 else h for h in kept]
        assert signed == sorted(set(signed))
        prints[i] = (text, signed)
        split = text.lower().split()
        n = len({tuple(split[k : k + 5]) for k in range(len(split) - 4)})
        if n >= 290:
            assert 0.4 < r.near_edited < 0.9 and r.near_next < 0.2
            assert n / 16 < len(signed) < n / 4
    assert not got
    assert prints[1][1] == prints[0][1] == prints[2][1] == []


def test_sketch_keeps_exactly_the_low_hashes(spark):
    texts = [(i, r[1]) for i, r in enumerate(rows())]
    df = spark.createDataFrame(texts, "id int, text string").withColumn("words", sketch.words_of(F.col("text")))
    df = df.withColumn("hashes", sketch.shingle_hashes(F.col("words"))).withColumn("s", sketch.sketch_of_hashes(F.col("hashes")))
    for r in df.collect():
        words = (r.text or "").lower().split()
        assert r.words == words
        assert len(r.hashes) == (max(1, len(words) - 4) if words else 0)
        low = sorted({h for h in r.hashes if h < sketch.THRESHOLD})
        want = low if len(low) >= sketch.FLOOR else sorted(set(r.hashes))[: sketch.FLOOR]
        assert r.s == want


def test_merge_and_containment(spark):
    rng = random.Random(2)
    book = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(20000)]
    note, other = book[:100], [rng.randrange(-(1 << 63), 1 << 63) for _ in range(5000)]
    df = spark.createDataFrame([(book, note, other, book[:12000], book[9000:])], "b array<bigint>, n array<bigint>, o array<bigint>, l array<bigint>, r array<bigint>")
    df = df.select(*[sketch.sketch_of_hashes(F.col(c)).alias(c) for c in df.columns])
    c = sketch.containment
    r = df.select(
        c(F.col("n"), F.col("b")).alias("bn"), c(F.col("b"), F.col("o")).alias("bo"), c(F.col("b"), F.col("b")).alias("bb"),
        (sketch.merge(F.col("l"), F.col("r")) == F.col("b")).alias("merged"), c(F.col("b"), F.array().cast("array<bigint>")).alias("none"),
    ).first()
    assert (r.bn, r.bo, r.bb, r.merged, r.none) == (1.0, 0.0, 1.0, True, 0.0)


@pytest.mark.parametrize("count", [0, 1])
def test_tiny_tables(spark, count):
    docs = spark.createDataFrame([(4, "a b c d e f")][:count], "doc_id long, text string")
    got = sketch.edited_pairs(docs).collect()
    assert [r.near_next for r in got] == [1.0] * count


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None), (7, "d")], "doc_id long, text string")
    got = sorted(sketch.edited_pairs(docs).collect(), key=str)
    assert len(got) == 5 and [r.near_next for r in got if r.doc_id == 1].count(1.0) == 1


@pytest.mark.parametrize("kind", ["long", "string"])
def test_sparse_and_textual_ids(spark, kind):
    rng = random.Random(5)
    make = (lambda: rng.randrange(-(1 << 62), 1 << 62)) if kind == "long" else (lambda: f"{rng.choice('aZé_')}{rng.randrange(10**9)}")
    data = list({make(): f"{'word ' * rng.randrange(9)}{i} " + "x" * rng.randrange(30) for i in range(400)}.items())
    docs = spark.createDataFrame(data, f"doc_id {kind}, text string").repartition(6)
    order = sorted(data, key=lambda r: r[0] if kind == "long" else r[0].encode(), reverse=True)
    got = {r.doc_id: r.edited_sha256 for r in sketch.edited_pairs(docs).collect()}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        third = len(text) // 3
        assert got.pop(i) == hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
    assert not got


def test_pure_threshold(spark):
    df = spark.createDataFrame([([5, sketch.THRESHOLD - 1, -7, 5],), ([],)], "h array<bigint>").withColumn("s", sketch.sketch_of_hashes(F.col("h"), 0))
    got = df.select("s", sketch.containment(F.col("s"), F.col("s"), 0).alias("c")).collect()
    assert sorted((r.s, r.c) for r in got) == [([], 1.0), ([sketch.THRESHOLD - 1], 1.0)]


def test_texts_are_shuffled_once(spark, tmp_path):
    spark.createDataFrame([(i, f"text number {i} of some words") for i in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    pairs = sketch.edited_pairs(spark.read.parquet(str(tmp_path / "d")))
    assert len(pairs.collect()) == 50
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    scans, reused = plan.count("FileScan"), plan.count("ReusedExchange")
    assert (scans, reused) == (1, 1)
