import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from keelson.llm import quality


def test_scores_match_the_textbook_densities():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, (400, 3)), rng.normal(1.5, 2, (300, 3))
    moments = [(len(x), x.sum(axis=0), x.T @ x) for x in (a, b)]
    model = quality.Discriminant.fit(*zip(*moments))
    pooled = (400 * np.cov(a.T, bias=True) + 300 * np.cov(b.T, bias=True)) / 700
    density = []
    for x in (a, b):
        c = 0.85 * np.cov(x.T, bias=True) + 0.15 * pooled
        c = 0.95 * c + 0.05 * np.diag(np.diag(c)) + 1e-3 * np.eye(3)
        d = a - x.mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.log(np.linalg.det(c)))
    want = 1 / (1 + np.exp(density[0] - density[1] - np.log(300 / 400)))
    assert np.allclose(model.score(a), want)


def test_statistics_of_odd_texts():
    rows = quality.statistics(pa.array(["", None, "   ", "Word", "é" * 100000, "a a a b\nx\nx\n", "A!! B!!"]))
    assert rows.shape == (7, len(quality.FEATURES)) and np.isfinite(rows).all()
    assert (rows[0] == rows[1]).all()
    assert rows[5][quality.FEATURES.index("repeated_neighbours")] == np.log((3 + 0.1) / (3 + 9.9))  # 3 of 6 words
    assert quality.statistics(pa.array([], pa.string())).shape == (0, len(quality.FEATURES))


def test_documents(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        good = i % 3 > 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 90))]
        rows.append((i, " ".join(w if good else w.upper() + "!!" for w in words), 5.0))
        marks.append((i, int(good), None))
    rows += [(900, None, 1.0), (901, "", 1.0), (1, rows[1][1], 5.0)]
    marks += [(900, None, 1), (7777, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, labels, F.col("doc_id") % 2 == 1).collect()
    assert len(got) == 403
    score = {r.doc_id: r.score for r in got}
    right = sum((score[i] >= 0.5) == (i % 3 > 0) for i in range(1, 400, 2))
    assert right >= 195
    assert score[900] == score[901] and all(0 <= r.score <= 1 for r in got)
    none = quality.score_documents(docs, labels.limit(0), F.lit(False)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert quality.score_documents(docs.limit(0), labels, F.lit(True)).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sum(i % 3 > 0 for i in {r.doc_id for r in kept.collect()} if i < 400) >= 260
