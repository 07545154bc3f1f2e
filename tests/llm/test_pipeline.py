import random

from keelson.llm import simhash


def variants(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(len(words) * share))):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(rng):
    rows, groups = [], []
    for g in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 200, 600]))]
        ids = [len(rows)]
        rows.append((len(rows), " ".join(words), "en", "s", 1))
        if g < 25:
            for _ in range(rng.randrange(1, 4)):
                ids.append(len(rows))
                rows.append((len(rows), variants(rng, words, 0.01), "en", "s", 1))
        if g % 5 == 0:
            ids.append(len(rows))
            rows.append((len(rows), " ".join(words), "en", "s", 1))
        groups.append(ids)
    return rows, groups


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_dedup_keeps_one_of_each_class(spark):
    rng = random.Random(4)
    rows, groups = corpus(rng)
    rows += [(9000, None, "en", "s", 1), (9001, "", "en", "s", 1), (9002, "short one", "en", "s", 1), (9002, "short one", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    text = {r[0]: r[1] for r in rows}
    missed = pairs = 0
    for group in groups:
        assert group[0] in ids
        sets = {i: shingles(text[i]) for i in group}
        for j in group[1:]:  # near copies of the first, and which of them stay
            near = len(sets[j] & sets[group[0]]) >= 0.8 * len(sets[j] | sets[group[0]])
            pairs += near
            missed += near and j in ids
            alone = all(len(sets[j] & sets[i]) < 0.8 * len(sets[j] | sets[i]) for i in group if i != j)
            assert not alone or j in ids
    assert pairs > 40 and missed <= 0.05 * pairs
    assert [i for i in ids if i >= 9000] == [9000, 9002]
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from keelson.llm import bpe

    rng = random.Random(5)
    rows, _ = corpus(rng)
    junk = [(5000 + i, " ".join(f"W{rng.randrange(900)}!!" for _ in range(80)), "en", "t", 1) for i in range(40)]
    secret = (7000, "the w1 of w2 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" and w3", "en", "t", 1)
    docs = spark.createDataFrame(rows + junk + [secret], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows[::2]] + [(r[0], 0, 0) for r in junk[::2]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "encode":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
    good = {r.doc_id for r in seen["quality"].collect()}
    assert good >= {r[0] for r in rows} and not good & {r[0] for r in junk}
    assert 7000 in good and seen["near_dedup"].count() < len(good)
    masked = {r.doc_id: r for r in seen["secrets"].collect()}
    assert "24be" not in masked[7000].text and masked[7000].n_chars == len(masked[7000].text)
    mixed = {(r.doc_id, r.text) for r in seen["mix"].collect()}
    assert all(t in masked[i].text for i, t in mixed)
    codec = bpe.Codec(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    coded = now.collect()
    assert {(r.doc_id, codec.decode(r.token_ids).decode()) for r in coded} == mixed
    assert all(r.n_tokens == len(r.token_ids) for r in coded)
    result = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda rows: sorted((r.doc_id, tuple(r.token_ids)) for r in rows)
    assert key(result.collect()) == key(coded)


def test_stages_hold_few_texts_at_once(spark):
    import corpus_pipeline as pipeline
    from pyspark.sql import functions as F

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    count = F.arrow_udf(lambda x: x.__class__.from_pandas(x.to_pandas() * 0 + len(x)), "bigint")
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        for name, stage in (s for s in pipeline.STAGES if s[0] in ("quality", "secrets", "encode")):
            spark.conf.unset(setting)
            stage(spark, docs, "/root/testdata/sf0.001")
            most = spark.range(5000, numPartitions=1).select(count("id").alias("n")).agg(F.max("n")).first()[0]
            assert most <= 1000, name
            spark.conf.set(setting, 50)
            stage(spark, docs, "/root/testdata/sf0.001")
            assert spark.conf.get(setting) == "50"
    finally:
        spark.conf.unset(setting)
