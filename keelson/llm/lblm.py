"""LM scoring: a log-bilinear neural model trained in numpy by noise-contrastive estimation.

Tokens are words (A-Z lowered) and one end after each text. The ``WORDS`` most frequent
words are units of their own, the end is one, and every other word falls in one of
``CLASSES`` units by its last three bytes. The model predicts a unit from the two before it:
the two unit vectors, each scaled by a weight vector of its position, add up to a predicted
vector whose products with all unit vectors, plus biases, are the log-odds. One matrix
product gives the normalisers of all contexts at once, so every token log-probability is
normalised. A word in a class has its share of the class's training tokens, one added.

Counts of all training words are aggregated in Spark, over every training document. The
``BROADCAST_WORDS`` most frequent ones go to the tasks (a fixed bound); what a document has
beyond them joins the count table by word, where no key is frequent any more. The vectors
are fitted in the tasks, on every training document once, in ``ROUNDS`` parts; after each the
parameters of all tasks are averaged.

Defined results: null and empty texts are one end token; without training documents base
scores are 0 and all units equally likely; equal rows give equal rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import WordBatch, cut_lineage, slices

WORDS, CLASSES = 1900, 128
BROADCAST_WORDS = 200_000
SIZE, BATCH, NOISE, ROUNDS, RATE = 32, 512, 128, 4, 0.2
END = 0


def class_of(word: str) -> int:
    return zlib.crc32(word.encode()[-3:]) % CLASSES


def classes_of(words: pa.Array) -> np.ndarray:
    """class_of each word, once for each distinct ending."""
    if not len(words):
        return np.zeros(0, np.int64)
    ends = pc.binary_slice(words.cast(pa.large_binary()), -3).dictionary_encode()
    return np.array([zlib.crc32(x) % CLASSES for x in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]


class Trainer:
    """Unit vectors and biases under noise-contrastive estimation with Adagrad.

    ``share`` is the noise: each unit's share of all training tokens. Noise units are drawn
    anew for each batch and shared by it, so a step is a few matrix products. ``p`` holds the
    parameters, ``past`` the sums of squared gradients, ``seen`` how often a unit took part.
    """

    NAMES = ("context", "target", "bias")

    def __init__(self, share: np.ndarray, seed: int, state: dict | None = None):
        self.share, self.rng = share, np.random.default_rng(seed)
        start = state or initial_state(share)
        self.p = {k: v.copy() for k, v in start["p"].items()}
        self.past = {k: v.copy() for k, v in start["past"].items()}
        self.seen = np.zeros(len(share))
        self.cumulative, self.log_noise = np.cumsum(share), np.log(share * NOISE).astype(np.float32)
        # what a step fills anew
        self.scores, self.targets, self.contexts = (np.empty(x, np.float32) for x in ((BATCH, NOISE), (BATCH + NOISE, SIZE), (2 * BATCH, SIZE)))

    def _descend(self, rows: np.ndarray, **gradients: np.ndarray) -> None:
        """A step of the parameters named, by gradients of these rows of theirs."""
        order = np.argsort(rows.astype(np.int16), kind="stable")  # radix sort
        placed = rows[order]
        starts = np.flatnonzero(np.append(True, placed[1:] != placed[:-1]))
        own = placed[starts]
        for name, gradient in gradients.items():
            total = np.add.reduceat(gradient.take(order, axis=0), starts, axis=0)
            past = self.past[name].take(own, axis=0)
            past += total * total
            self.past[name][own] = past
            total *= RATE
            total /= np.sqrt(past, out=past)
            self.p[name][own] = self.p[name].take(own, axis=0) - total

    def learn(self, units: np.ndarray, first: np.ndarray) -> None:
        """One pass over a run of units; ``first`` is where each one's text begins. Before a
        text lie two ends."""
        age = np.arange(len(units)) - first
        before = np.stack([np.where(age >= k, np.roll(units, k), END) for k in (1, 2)])
        order = self.rng.permutation(len(units))
        for at in range(0, len(order), BATCH):
            self._step(units[order[at : at + BATCH]], *before[:, order[at : at + BATCH]])
        for x in (units, before[0], before[1]):
            self.seen += np.bincount(x, minlength=len(self.share))

    def _step(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p, n = self.p, len(word)
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), len(self.share) - 1)
        c1, c2 = p["context"].take(one, axis=0), p["context"].take(two, axis=0)
        target, noise_target = p["target"].take(word, axis=0), p["target"].take(noise, axis=0)
        predicted = c1 * p["position"][0] + c2 * p["position"][1]
        odds = np.einsum("ij,ij->i", predicted, target) + p["bias"][word, 0] - self.log_noise[word]
        # derivative of the loss by each score; the matrix is the odds' negative first
        scale = np.float32(1 / BATCH)
        real = -scale / (1 + np.exp(np.minimum(odds, 30)))
        fake = np.matmul(predicted, -noise_target.T, out=self.scores[:n])
        fake += self.log_noise[noise] - p["bias"][noise, 0]
        np.minimum(fake, 30, out=fake)
        np.exp(fake, out=fake)
        fake += 1
        np.divide(scale, fake, out=fake)
        back = real[:, None] * target
        back += fake @ noise_target
        rows, targets, contexts = np.concatenate([word, noise]), self.targets[: n + NOISE], self.contexts[: 2 * n]
        np.multiply(real[:, None], predicted, out=targets[:n])
        np.matmul(fake.T, predicted, out=targets[n:])
        for k in (0, 1):
            np.multiply(back, p["position"][k], out=contexts[k * n : k * n + n])
        position = np.stack([np.einsum("ij,ij->j", back, c) for c in (c1, c2)])
        self._descend(rows, bias=np.concatenate([real, fake.sum(axis=0)])[:, None], target=targets)
        self._descend(np.concatenate([one, two]), context=contexts)
        self.past["position"] += position**2
        p["position"] -= RATE * position / np.sqrt(self.past["position"])

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, weight, values) of each unit that took part, and of the positions as unit -1:
        parameters, then sums of squares, as they are averaged over tasks."""
        own = np.flatnonzero(self.seen)
        values = np.concatenate([x[k][own] for x in (self.p, self.past) for k in self.NAMES], axis=1)
        last = np.zeros((1, values.shape[1]), np.float32)
        flat = np.concatenate([self.p["position"].ravel(), self.past["position"].ravel()])
        last[0, : len(flat)] = flat
        weight = np.append(self.seen[own], self.seen.sum())
        return np.append(own, -1), weight, np.concatenate([values, last])


def initial_state(share: np.ndarray) -> dict:
    rng, count = np.random.default_rng(5), len(share)
    p = {
        "context": rng.normal(0, 0.1, (count, SIZE)), "target": rng.normal(0, 0.1, (count, SIZE)),
        "position": np.ones((2, SIZE)), "bias": np.log(share)[:, None],
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    return {"p": p, "past": {k: np.full_like(v, 1e-6) for k, v in p.items()}}


def averaged(state: dict, rows: list) -> dict:
    """The state with the averages of all tasks: rows of unit, weight, weighted sums of values."""
    p, past = ({k: v.copy() for k, v in state[n].items()} for n in ("p", "past"))
    for unit, weight, *sums in rows:
        values = np.array(sums, np.float64) / weight
        if unit < 0:
            n = p["position"].size
            p["position"], past["position"] = (values[i * n : (i + 1) * n].reshape(2, SIZE).astype(np.float32) for i in (0, 1))
            continue
        at = 0
        for table in (p, past):
            for k in Trainer.NAMES:
                width = table[k].shape[1]
                table[k][unit] = values[at : at + width]
                at += width
    return {"p": p, "past": past}


@dataclass
class Model:
    """Counts of frequent words, class totals, vectors; ``tables`` is made where it is used."""

    frequent: list[str]
    own: int
    counts: np.ndarray
    tokens: int
    distinct: int
    documents: int
    class_tokens: np.ndarray
    class_distinct: np.ndarray
    vectors: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def units(self) -> int:
        return 1 + self.own + CLASSES

    @property
    def base_log(self) -> float:
        return float(np.log10(self.tokens + self.distinct + 1))

    def prepare(self) -> None:
        """The score of each unit after each other one, and the normaliser of each pair."""
        if hasattr(self, "following"):
            return
        v = self.vectors
        scores = [(v["context"] * v["position"][k]) @ v["target"].T for k in (0, 1)]
        scores[0] = scores[0] + v["bias"]
        top = [x.max(axis=1, keepdims=True) for x in scores]
        weighted = [np.exp(x - m) for x, m in zip(scores, top)]
        self.norm = np.log(weighted[0] @ weighted[1].T) + top[0] + top[1].T
        self.following = scores

    def look_up(self, vocabulary: pa.Array, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Unit of each word, and its place among the frequent words, or among ``most`` of
        them (-1: not there)."""
        if not hasattr(self, "value_set"):
            self.value_set = pa.array(self.frequent, pa.large_string())
        place = pc.fill_null(pc.index_in(vocabulary, value_set=self.value_set[:most]), -1).to_numpy(zero_copy_only=False)
        own = self.own
        unit = np.where((place >= 0) & (place < own), place + 1, 0)
        loose = np.flatnonzero(unit == 0)
        unit[loose] = 1 + own + classes_of(vocabulary.take(pa.array(loose)))
        return unit.astype(np.int64), place.astype(np.int64)

    def log_probabilities(self, unit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of each unit's probability after the two before it; ``first`` is where
        each one's text begins."""
        self.prepare()
        age = np.arange(len(unit)) - first
        one, two = (np.where(age >= k, np.roll(unit, k), END) for k in (1, 2))
        return (self.following[0][one, unit] + self.following[1][two, unit] - self.norm[one, two]) / np.log(10)


def with_ends(words: WordBatch, unit_of_code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of a batch with an end after each text, the end's places, and text starts."""
    n = words.counts
    ends = words.bounds[1:] + np.arange(len(n))
    unit = np.full(len(words.codes) + len(n), END, np.int64)
    inner = np.ones(len(unit), bool)
    inner[ends] = False
    unit[inner] = unit_of_code[words.codes] if len(words.codes) else 0
    return unit, inner, np.repeat(ends - n, n + 1)


def _count(batches):
    for part in (part for batch in batches for _, part in slices(batch.column(0), 8 << 20)):
        words = WordBatch(part)
        number = np.bincount(words.codes, minlength=len(words.vocabulary))
        yield pa.RecordBatch.from_arrays([words.vocabulary.cast(pa.string()), pa.array(number, pa.int64())], ["word", "c"])


def _class_totals(own: frozenset):
    def totals(batches):
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            loose = [i for i, w in enumerate(words) if w not in own]
            group = np.array([class_of(words[i]) for i in loose], np.int64)
            tokens = np.bincount(group, counts[loose], CLASSES).astype(np.int64)
            kinds = np.bincount(group, minlength=CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(tokens), pa.array(kinds)], ["k", "tokens", "kinds"])

    return totals


def frequent_words(counts: DataFrame, most: int) -> list:
    """The rows of the most frequent words, at most ``most``, by count, then word.

    A histogram of counts in sixteenths of powers of two gives the least count to ask for,
    so that only so many rows come to the driver, whatever the number of tasks.
    """
    step = F.floor(F.log2("c") * 16).alias("step")
    histogram = sorted(counts.groupBy(step).count().collect(), reverse=True)
    total, least = 0, None
    for r in histogram:
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return []
    return sorted(counts.where(F.floor(F.log2("c") * 16) >= least).collect(), key=lambda r: (-r.c, r.word))


def train_model(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the table (word, c) of all training words' counts."""
    rows = docs.where(train).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = rows.select("text").mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = cut_lineage(counts)
    documents = rows.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = frequent_words(counts, BROADCAST_WORDS)
    own = [r.word for r in top[:WORDS]]
    classes = counts.mapInArrow(_class_totals(frozenset(own)), "k int, tokens long, kinds long")
    sums = {r[0]: r[1:] for r in classes.groupBy("k").agg(F.sum("tokens"), F.sum("kinds")).collect()}
    model = Model(
        [r.word for r in top], len(own), np.array([r.c for r in top], np.int64), int(total.n) + documents, int(total.v) + (documents > 0), documents,
        np.array([sums.get(k, (0, 0))[0] for k in range(CLASSES)]), np.array([sums.get(k, (0, 0))[1] for k in range(CLASSES)]),
    )
    model.vectors = fit_vectors(rows, model)
    return model, counts


def fit_vectors(rows: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """Vectors and biases learned from every row (doc_id, text), each once.

    The rows are dealt to ROUNDS by a hash of the id and text. In a round each task goes on from
    the same parameters over its own texts; these come back as one row for each unit, are
    averaged by how often the unit took part, and start the next round. The driver holds
    parameters only, whose number is fixed.
    """
    own = model.own
    first = np.array(model.counts[:own], np.float64)
    share = np.concatenate([[model.documents], first, model.class_tokens]) + 1.0
    share /= share.sum()
    state, context = initial_state(share), rows.sparkSession.sparkContext
    width = 2 * (2 * SIZE + 1)
    for number in range(ROUNDS):
        shared = context.broadcast((model, share, state))

        def learn(batches, shared=shared, number=number):
            m, noise, start = shared.value
            trainer = Trainer(noise, 1000 * number + (TaskContext.get().partitionId() if TaskContext.get() else 0), start)
            for part in (part for batch in batches for _, part in slices(batch.column(0), 2 << 20)):
                words = WordBatch(part)
                unit, _ = m.look_up(words.vocabulary, m.own) if len(words.vocabulary) else (np.zeros(0, np.int64), None)
                run, _, begin = with_ends(words, unit)
                trainer.learn(run, begin)
            if trainer.seen.any():
                unit, weight, values = trainer.blocks()
                ends = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * width)
                lists = pa.ListArray.from_arrays(ends, pa.array(values.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array(weight), lists], ["unit", "weight", "v"])

        dealt = rows.where(F.pmod(F.xxhash64(F.lit(13), "doc_id", "text"), F.lit(ROUNDS)) == number)
        learned = dealt.select("text").mapInArrow(learn, "unit int, weight double, v array<float>")
        sums = learned.groupBy("unit").agg(F.sum("weight"), *[F.sum(F.col("v")[i] * F.col("weight")) for i in range(width)])
        state = averaged(state, [tuple(r) for r in sums.collect()])
        shared.unpersist()
    return state["p"] | {"bias": state["p"]["bias"][:, 0]}


def score_documents(docs: DataFrame, model: Model, counts: DataFrame, keep: tuple[Column, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``keep``, n_tokens, n_known, train_tokens, base_score, score for each row.

    One pass over the texts gives each row its share from frequent words and one row for
    each of its rarer words; these join the count table and everything is summed by row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.select(*keep).columns if keep else []
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(F.col(doc_id).alias("doc_id"), *keep).alias("kept"), F.col(text).alias("text"))
    kept = rows.schema["kept"].dataType.simpleString()
    schema = f"row long, kept {kept}, word string, n long, n_tokens long, n_known long, base double, score double"

    def measure(batches):
        m = shared.value
        own = m.own
        log_count = np.log10(np.append(m.counts, 0) + 1.0)
        class_log = np.log10(m.class_tokens + m.class_distinct + 1.0)
        for whole, at, texts in ((b, at, part) for b in batches for at, part in slices(b.column(2), 6 << 20)):
            batch = whole.slice(at, len(texts))
            row, words = batch.column(0), WordBatch(texts)
            unit, place = m.look_up(words.vocabulary) if len(words.vocabulary) else (np.zeros(0, np.int64),) * 2
            run, inner, first = with_ends(words, unit)
            unit_log = m.log_probabilities(run, first)
            total = np.concatenate([[0.0], np.cumsum(unit_log)])
            bounds = words.bounds + np.arange(len(words.bounds))
            score = total[bounds[1:]] - total[bounds[:-1]]
            seen = np.where(place >= 0, log_count[place], 0.0)
            loose = unit > own
            within = np.where(loose, seen - class_log[np.where(loose, unit - own - 1, 0)], 0.0)
            n = words.counts
            by_text = lambda x: words.sum_by_text(x[words.codes]) if len(words.codes) else np.zeros(len(n))  # noqa: B023, E731
            end = np.log10(m.documents + 1.0) - m.base_log
            base = by_text(seen - m.base_log) + end
            known = by_text((place >= 0).astype(np.float64)) + (m.documents > 0)
            marker = pc.binary_join_element_wise("", row.cast(pa.string()), " ")
            size = len(row)
            yield pa.RecordBatch.from_arrays(
                [row, batch.column(1), marker, pa.array(np.zeros(size, np.int64)), pa.array(n + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score + by_text(within))],
                ["row", "kept", "word", "n", "n_tokens", "n_known", "base", "score"],
            )
            rare = (place < 0)[words.codes] if len(words.codes) else np.zeros(0, bool)
            owner = np.repeat(np.arange(size), n)[rare]
            width = max(len(words.vocabulary), 1)
            pair, times = np.unique(owner * width + words.codes[rare], return_counts=True)
            if len(pair):
                none = lambda t: pa.nulls(len(pair), t)  # noqa: B023, E731
                word = words.vocabulary.take(pa.array(pair % width)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [row.take(pa.array(pair // width)), none(batch.column(1).type), word, pa.array(times, pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64())],
                    ["row", "kept", "word", "n", "n_tokens", "n_known", "base", "score"],
                )

    parts = rows.mapInArrow(measure, schema).join(counts, "word", "left")
    found = F.coalesce(F.col("n") * F.log10(F.col("c") + 1), F.lit(0.0))
    totals = parts.groupBy("row").agg(
        F.first("kept", ignorenulls=True).alias("kept"), F.max("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.lit(0))).alias("n_known"),
        (F.sum("base") + F.sum(found)).alias("base_score"), (F.sum("score") + F.sum(found)).alias("score"),
    )
    return totals.select(
        "kept.doc_id", *[F.col(f"kept.`{n}`").alias(n) for n in names], "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
