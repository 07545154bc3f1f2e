import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import lblm


def data():
    rng = random.Random(1)
    kinds = [[f"{c}{i}" for i in range(60)] for c in ("The", "el", "là")]
    rows = []
    for i in range(240):
        words = [rng.choice(rng.choice([kinds[i % 3][:8], kinds[i % 3]])) for _ in range(rng.randrange(0, 60))]
        rows.append((i, rng.choice([" ", "\t\n"]).join(words), 0.0))
    rows += [(900, None, 0.0), (901, "", 0.0), (902, "never seen before", 0.0), (1, rows[1][1], 0.0), (903, "the1 el2 " * 30000, 0.0)]
    return rows


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


@pytest.mark.parametrize("frequent,units", [(200_000, 1900), (60, 10)])
def test_scores_by_brute_force(spark, monkeypatch, frequent, units):
    monkeypatch.setattr(lblm, "BROADCAST_WORDS", frequent)
    monkeypatch.setattr(lblm, "WORDS", units)
    rows = data()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(4)
    model, counts = lblm.train_model(docs, F.col("doc_id") % 7 != 2)
    held = (F.col("doc_id") % 7 == 2).alias("held_out")
    got = lblm.score_documents(docs, model, counts, keep=(held,)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    train = [tokens(r[1]) for r in rows if r[0] % 7 != 2]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()) + len(train), len(count) + 1
    own = model.frequent[: model.own]
    assert own == sorted(count, key=lambda w: (-count[w], w.encode()))[: len(own)]
    assert len(model.frequent) <= frequent and len(own) == min(units, len(model.frequent))
    class_tokens, class_kinds = Counter(), Counter()
    for w, c in count.items():
        if w not in own:
            class_tokens[lblm.class_of(w)] += c
            class_kinds[lblm.class_of(w)] += 1
    p = {k: x.astype(np.float64) for k, x in model.vectors.items()}
    text = {r[0]: r[1] for r in rows}
    for r in got:
        words = tokens(text[r.doc_id])
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(train) + 1) / (n + v + 1))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(count[w] > 0 for w in words) + 1, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (r.doc_id % 7 == 2)
        if r.doc_id == 903:
            continue
        score, one, two = 0.0, 0, 0
        for w in [*words, None]:
            unit = 0 if w is None else own.index(w) + 1 if w in own else 1 + len(own) + lblm.class_of(w)
            odds = (p["context"][one] * p["position"][0] + p["context"][two] * p["position"][1]) @ p["target"].T + p["bias"]
            score += (odds[unit] - np.log(np.exp(odds).sum())) / math.log(10)
            if unit > len(own):
                k = lblm.class_of(w)
                score += math.log10((count[w] + 1) / (class_tokens[k] + class_kinds[k] + 1))
            one, two = unit, one
        assert r.score == pytest.approx(score, rel=2e-4, abs=1e-3)
    unseen = [r for r in got if r.held_out and r.n_tokens > 10]
    assert sum(r.score > r.base_score for r in unseen) > 0.9 * len(unseen)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model, counts = lblm.train_model(docs, F.lit(False))
    got = {r.doc_id: r for r in lblm.score_documents(docs, model, counts).collect()}
    assert [(got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].base_score) for i in (1, 2)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(r.score < 0 for r in got.values())
    assert lblm.score_documents(docs.limit(0), model, counts).count() == 0


def test_word_batches_of_slices():
    import pyarrow as pa

    from keelson.llm.common import WordBatch, slices

    texts = ["aé B\x1fc", None, "", " \t", "É dd éé " * 40, "x y"] * 50
    at = 0
    for start, part in slices(pa.array(texts), 500):
        assert start == at
        at += len(part)
        words = WordBatch(part)
        flat = words.vocabulary.take(pa.array(words.codes)).to_pylist()
        for i, text in enumerate(texts[start:at]):
            assert flat[words.bounds[i] : words.bounds[i + 1]] == tokens(text)
    assert at == len(texts)


def test_classes_of_whole_vocabularies():
    words = ["", "a", "ab", "abc", "xabc", "là", "é", "日本", "a" * 5000, "abc"]
    assert lblm.classes_of(lblm.pa.array(words, lblm.pa.large_string())).tolist() == [lblm.class_of(w) for w in words]
    assert len(lblm.classes_of(lblm.pa.array([], lblm.pa.large_string()))) == 0


def test_a_step_by_sums_over_rows():
    rng = np.random.default_rng(3)
    share = rng.random(40) + 0.01
    trainer = lblm.Trainer(share / share.sum(), 8)
    word, one, two = rng.integers(0, 40, (3, 300))
    p = {k: v.astype(np.float64) for k, v in trainer.p.items()}
    noise = np.minimum(np.searchsorted(trainer.cumulative, np.random.default_rng(8).random(lblm.NOISE)), 39)
    gradient = {k: np.zeros_like(v) for k, v in p.items()}
    log_noise = np.log(share / share.sum() * lblm.NOISE)
    for w, a, b in zip(word, one, two):
        c = [p["context"][a], p["context"][b]]
        predicted = c[0] * p["position"][0] + c[1] * p["position"][1]
        odds = lambda u: predicted @ p["target"][u] + p["bias"][u, 0] - log_noise[u]  # noqa: B023, E731
        slopes = [(w, -1 / (1 + math.exp(odds(w)))), *[(u, 1 / (1 + math.exp(-odds(u)))) for u in noise]]
        back = sum(s * p["target"][u] for u, s in slopes) / lblm.BATCH
        for u, s in slopes:
            gradient["bias"][u] += s / lblm.BATCH
            gradient["target"][u] += s * predicted / lblm.BATCH
        for k, u in enumerate((a, b)):
            gradient["context"][u] += back * p["position"][k]
            gradient["position"][k] += back * c[k]
    trainer._step(word, one, two)
    for k, g in gradient.items():
        past = 1e-6 + g**2
        assert np.allclose(trainer.past[k], past, rtol=1e-3, atol=1e-9)
        assert np.allclose(trainer.p[k], p[k] - lblm.RATE * g / np.sqrt(past), atol=2e-3)
