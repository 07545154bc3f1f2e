"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

A document becomes a short vector of transformed statistics of its whole text. For each
class the moments (count, sum, outer products) of all labelled training rows are summed in
Spark, so the model sees every label and the driver only a few small matrices. Each class
covariance is shrunk towards the pooled one and towards its diagonal; its Cholesky factor
is kept, so a score is two triangular solves for a whole batch: the difference of the
class log-densities, plus the log prior ratio, through a logistic function.

Defined results: a null or empty text has the vector of an empty text and a score like any
other; a label that is null is no label; with fewer than two labelled classes every score
is the share of label 1 (0.5 without labels); equal texts have equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import WordBatch, cut_lineage, slices, worker_model

FEATURES = (
    "log_words", "mean_word", "word_deviation", "upper", "digits", "marks", "symbols", "line_ends",
    "distinct_words", "repeated_neighbours", "mark_words", "upper_words", "sentence_words", "repeated_lines", "other_bytes",
)
PRIOR_COUNT, USUAL_WORD = 10.0, 5.0
SHRINK_TO_POOLED, SHRINK_TO_DIAGONAL, RIDGE = 0.15, 0.05, 1e-3
#: Bytes of text whose words are held at once.
SLICE = 2 << 20
#: Byte classes: 1 lower case, 2 upper case, 3 digit, 4 sentence mark, 5 symbol, 6 line end, 7 space, 8 non-ASCII.
CLASS = np.full(256, 5, np.int64)
for _range, _class in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b".,;:?!'\"()-", 4), (b"\n\r", 6), (b" \t\x0b\x0c", 7), (range(128, 256), 8)):
    CLASS[list(_range)] = _class


def _share(part, whole, usual: float):
    """Log odds of a share, smoothed by ``PRIOR_COUNT`` cases of the usual share, so that
    short texts stay near what is usual."""
    return np.log((part + PRIOR_COUNT * usual) / (whole - part + PRIOR_COUNT * (1 - usual)))


def _class_counts(texts: pa.Array) -> np.ndarray:
    """For each text, how many of its bytes fall in each class."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    out = np.zeros((len(texts), 9), np.int64)
    for i in range(len(texts)):
        out[i] = np.bincount(CLASS[raw[bounds[i] : bounds[i + 1]]], minlength=9)
    return out


def _repeated_lines(text: str) -> tuple[int, int]:
    lines = [x for x in text.split("\n") if x.strip()]
    return len(lines) - len(set(lines)), len(lines)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros((0, len(FEATURES)))
    kinds = _class_counts(texts)
    words = WordBatch(texts, lower=False)
    n = words.counts.astype(np.float64)
    vocabulary = words.vocabulary
    length = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.float64)
    per_word = lambda x: words.sum_by_text(x[words.codes] if len(x) else np.zeros(0))
    flag = lambda x: per_word(np.asarray(x.to_numpy(zero_copy_only=False), np.float64))
    mean = (per_word(length) + PRIOR_COUNT * USUAL_WORD) / (n + PRIOR_COUNT)
    square = (per_word(length**2) + PRIOR_COUNT * 1.5 * USUAL_WORD**2) / (n + PRIOR_COUNT)
    deviation = np.sqrt(np.maximum(square - mean**2, 0))
    codes, owner = words.codes, np.repeat(np.arange(len(texts)), words.counts)
    pair = np.unique(owner * max(len(vocabulary), 1) + codes) // max(len(vocabulary), 1)
    distinct = np.bincount(pair, minlength=len(texts))
    same = np.zeros(len(codes))
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    lines = np.array([_repeated_lines(x) for x in texts.to_pylist()], np.float64).reshape(-1, 2)
    size = kinds.sum(axis=1)
    return np.column_stack([
        np.log(n + 2 * PRIOR_COUNT), np.log1p(mean), np.log1p(deviation),
        _share(kinds[:, 2], kinds[:, 1] + kinds[:, 2], 0.02),
        _share(kinds[:, 3], size, 0.005), _share(kinds[:, 4], size, 0.03),
        _share(kinds[:, 5], size, 0.002), _share(kinds[:, 6], size, 0.005),
        _share(distinct, n, 0.8), _share(words.sum_by_text(same), n, 0.01),
        _share(flag(pc.match_substring_regex(vocabulary, r"[#$%&*|!@~^_=+<>/\\]")), n, 0.01),
        _share(flag(pc.match_substring_regex(vocabulary, r"^[^a-z]*[A-Z][^a-z]*$")), n, 0.02),
        _share(flag(pc.match_substring_regex(vocabulary, r"[.?]$")), n, 0.1),
        _share(lines[:, 0], lines[:, 1], 0.02), _share(kinds[:, 8], size, 0.02),
    ])


def text_statistics(text: Column) -> Column:
    """array<double>: FEATURES of a text."""

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        worker_model("quality")
        parts = [statistics(part) for _, part in slices(texts, SLICE)]
        rows = np.concatenate(parts) if parts else statistics(texts)
        places = np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32)
        return pa.ListArray.from_arrays(places, pa.array(rows.ravel()))

    return measure(text)


@dataclass
class Discriminant:
    """Means, Cholesky factors and log-determinants of both classes, and the log prior ratio."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float
    constant: float | None = None

    @classmethod
    def fit(cls, counts, sums, products) -> Discriminant:
        """From the moments of class 0 and class 1."""
        if min(counts) < 2:
            share = float(counts[1] / sum(counts)) if sum(counts) else 0.5
            return cls(np.zeros((2, 1)), np.zeros((2, 1, 1)), np.zeros(2), 0.0, share)
        means = np.stack([s / n for n, s in zip(counts, sums)])
        own = [p / n - np.outer(m, m) for n, p, m in zip(counts, products, means)]
        pooled = sum(n * c for n, c in zip(counts, own)) / sum(counts)
        factors, log_dets = [], []
        for covariance in own:
            mixed = (1 - SHRINK_TO_POOLED) * covariance + SHRINK_TO_POOLED * pooled
            mixed = (1 - SHRINK_TO_DIAGONAL) * mixed + SHRINK_TO_DIAGONAL * np.diag(np.diag(mixed))
            factor = np.linalg.cholesky(mixed + RIDGE * np.eye(len(mixed)))
            factors.append(np.linalg.inv(factor))
            log_dets.append(2 * np.log(np.diag(factor)).sum())
        return cls(means, np.stack(factors), np.array(log_dets), float(np.log(counts[1] / counts[0])))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        density = [
            -0.5 * (((rows - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d
            for m, f, d in zip(self.means, self.factors, self.log_dets)
        ]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -500, 500)))


def _moments(batches):
    """Partial moments: for each label of a batch its count, sums and outer products."""
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        kept = [k for k in (0, 1) if (label == k).any()]
        values = [np.concatenate([[(label == k).sum()], rows[label == k].sum(axis=0), (rows[label == k].T @ rows[label == k]).ravel()]) for k in kept]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([v.tolist() for v in values], pa.list_(pa.float64()))], ["label", "v"])


def fit(labelled: DataFrame, label: str, statistics_column: str) -> Discriminant:
    """The model of all rows with label 0 or 1; what comes to the driver is two vectors."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int"), statistics_column)
    parts = rows.mapInArrow(_moments, "label int, v array<double>")
    width = 1 + len(FEATURES) + len(FEATURES) ** 2
    totals = parts.groupBy("label").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width)]).collect()
    moments = {r[0]: np.array(r[1:], np.float64) for r in totals}
    both = [moments.get(k, np.zeros(width)) for k in (0, 1)]
    size = len(FEATURES)
    return Discriminant.fit([m[0] for m in both], [m[1 : 1 + size] for m in both], [m[1 + size :].reshape(size, size) for m in both])


def probability(model: Discriminant, statistics_column: Column) -> Column:
    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        values = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        return pa.array(model.score(values))

    return score(statistics_column)


def train_on(measured: DataFrame, labels: DataFrame, label: str) -> Discriminant:
    """The model of the rows of ``measured`` (doc_id, statistics) whose id has a label."""
    marks = labels.select("doc_id", F.col(label).alias("label"))
    return fit(measured.select("doc_id", "statistics").join(marks, "doc_id"), "label", "statistics")


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score for each row of docs.

    The model is fitted on the rows that aren't held out and whose id has a 0 or 1 in
    labels; an id with several labels counts once for each. Statistics are taken once.
    """
    measured = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), text_statistics(F.col(text)).alias("statistics"))
    measured = cut_lineage(measured)
    model = train_on(measured.where("not held_out"), labels, label)
    return measured.select("doc_id", "held_out", probability(model, F.col("statistics")).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score at least the threshold under a model of
    all labelled ones. Only statistics are kept between the two passes over the texts."""
    train = cut_lineage(docs.select("doc_id", text_statistics(F.col("text")).alias("statistics")))
    model = train_on(train, labels, label)
    packed = docs.select(F.struct("*").alias("row"), probability(model, text_statistics(F.col("text"))).alias("score"))
    return packed.where(F.col("score") >= threshold).select("row.*")
