"""Language ID: interpolated Kneser-Ney character models, one for each language.

Texts are reduced to lower-case words of letters; a word with its two boundary marks is one
sequence of characters. Each language has n-gram models of orders 1 to ``ORDER``: absolute
discounting, continuation counts below the highest order, interpolated down to a uniform
distribution. Hashes of all n-grams lie in one sorted array for each order, with a column
of weights for each language, so a character costs one binary search for each order.
The language of the lowest cross-entropy for each character wins. It is marked as rejected
where the cross-entropy lies beyond what calibration documents of that language showed.

The models are fitted on a bounded sample: about ``SAMPLE`` training documents for each
language, chosen by a hash of the id, whole texts. A further ``CALIBRATION`` share of that
many others sets the rejection bounds. Every document is scored on its whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0; without
training documents all are; equal texts have equal results; a language that is null is no
label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import cut_lineage, slices

ORDER, DISCOUNT = 5, 0.75
SAMPLE, CALIBRATION = 800, 0.25
#: N-grams seen once in the sample are left out above this order.
KEEP_ALL = 3
#: How far, in deviations above the mean, a cross-entropy may lie; and the score's slope.
REJECT_DEVIATIONS, SLOPE = 4.0, 12.0
#: Languages of one model, the columns of its tables; more are an error.
MAX_LANGUAGES = 512
NON_LETTERS = r"[^\p{L}\p{M}]+"


@dataclass
class Words:
    """Distinct words of a batch of texts as one run of characters, and who has them."""

    owner: np.ndarray
    code: np.ndarray
    chars: np.ndarray
    starts: np.ndarray


def letters(texts: pa.Array) -> Words:
    """The words of letters of each text, in lower case, distinct ones spelled once.

    A word's characters follow its opening mark (a space); the mark after it opens the next.
    """
    plain = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.split_pattern(pc.replace_substring_regex(plain, NON_LETTERS, " "), " ")
    flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    filled = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[filled.to_numpy(zero_copy_only=False)]
    coded = flat.filter(filled).dictionary_encode()
    vocabulary = coded.dictionary
    code = coded.indices.to_numpy().astype(np.int64)
    lettered = pc.match_substring_regex(vocabulary, r"\p{L}").to_numpy(zero_copy_only=False)
    if not lettered.all():  # marks alone are no word
        kept = lettered[code]
        owner, code = owner[kept], (np.cumsum(lettered) - 1)[code[kept]]
        vocabulary = vocabulary.filter(pa.array(lettered))
    text = " " + "".join(w + " " for w in vocabulary.to_pylist())
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return Words(owner, code, chars, starts)


def ngram_hashes(words: Words) -> list[np.ndarray]:
    """For each order n, the hash of the n characters that end at each place; 0 where they
    would reach over a word's opening mark. Place p belongs to the word whose mark is last
    before p; the closing mark belongs to the word it closes."""
    chars = words.chars
    place = np.arange(len(chars))
    opening = words.starts[np.maximum(np.searchsorted(words.starts, place, side="left") - 1, 0)]
    out, value = [], np.zeros(len(chars), np.uint64)
    with np.errstate(over="ignore"):
        mixed = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for n in range(1, ORDER + 1):
            value = np.concatenate([np.zeros(1, np.uint64), value[:-1]]) if n > 1 else value
            value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixed
            inside = (place - opening >= n - 1) & (place > 0)
            out.append(np.where(inside, value | np.uint64(1), np.uint64(0)))
    return out


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, n, gram, tail, context, count: n-grams of a batch, each with its last n - 1
    characters (tail) and its first n - 1 (context), as hashes."""
    for batch in batches:
        for at, texts in slices(batch.column(1)):
            yield from _count_part(batch.column(0).slice(at, len(texts)), texts)


def _count_part(names: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    langs = names.dictionary_encode()
    words = letters(texts)
    code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.owner]
    pair, weight = np.unique(code * max(len(words.starts), 1) + words.code, return_counts=True)
    lang, word = np.divmod(pair, max(len(words.starts), 1))
    hashes = ngram_hashes(words)
    size = words.starts[word + 1] - words.starts[word]
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = np.repeat(words.starts[word], size) + step + 1
    lang, weight = np.repeat(lang, size), np.repeat(weight, size)
    for n in range(1, ORDER + 1):
        gram = hashes[n - 1][place]
        tail = hashes[n - 2][place] if n > 1 else np.zeros_like(gram)
        context = hashes[n - 2][place - 1] if n > 1 else np.zeros_like(gram)
        if n == 2:  # the opening mark alone is a context too
            context = np.where(step == 0, np.uint64(1), context)
        have = gram != 0
        order = np.lexsort((gram[have], lang[have]))
        g, ln = gram[have][order], lang[have][order]
        new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (ln[1:] != ln[:-1])])) if len(g) else np.zeros(0, np.int64)
        total = np.add.reduceat(weight[have][order], new) if len(new) else np.zeros(0, np.int64)
        signed = lambda x: pa.array(x[have][order][new].view(np.int64))  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.cast(pa.string()).take(pa.array(ln[new])), pa.array([n] * len(new), pa.int32()), signed(gram), signed(tail), signed(context), pa.array(total, pa.int64())],
            ["lang", "n", "gram", "tail", "context", "count"],
        )


class LanguageModels:
    """Sorted hashes for each order, and for each language the weights of n-gram and context.

    With a(g) the discounted share of n-gram g in its context and b(c) what context c leaves
    to lower orders, p_n = a(g_n) + b(c_n) * p_{n-1}.
    """

    def __init__(self, languages: list[str], grams, shares, leftovers, uniform: float):
        self.languages, self.grams, self.shares, self.leftovers = languages, grams, shares, leftovers
        self.uniform = uniform
        self.bounds = np.full(len(languages), np.inf)

    @classmethod
    def fit(cls, counts, languages: list[str]) -> LanguageModels:
        """counts: pandas table of lang, n, gram, tail, context, count."""
        import pandas as pd

        counts = counts.assign(lang=pd.Categorical(counts["lang"], languages).codes)
        by_order = {n: t for n, t in counts.groupby("n")}
        grams, shares, leftovers = [], [], [np.ones((1, len(languages)), np.float32)]
        for n in range(1, ORDER + 1):
            table = by_order.get(n, counts.iloc[:0])
            if n < ORDER and n + 1 in by_order:
                wider = by_order[n + 1].groupby(["lang", "tail"]).size().rename("kinds").reset_index()
                table = table.merge(wider, left_on=["lang", "gram"], right_on=["lang", "tail"], how="left", suffixes=("", "_w"))
                value = table["kinds"].fillna(0).to_numpy(np.float64)
                value = np.where(value > 0, value, np.minimum(table["count"].to_numpy(), 1))
            else:
                value = table["count"].to_numpy(np.float64)
            table = table.assign(value=value)
            sums = table.groupby(["lang", "context"])["value"].agg(["sum", "size"]).reset_index()
            table = table.merge(sums, on=["lang", "context"])
            hashes = np.unique(table["gram"].to_numpy(np.int64).view(np.uint64))
            share = np.zeros((len(hashes) + 1, len(languages)), np.float32)
            at = np.searchsorted(hashes, table["gram"].to_numpy(np.int64).view(np.uint64))
            share[at, table["lang"]] = (table["value"] - DISCOUNT) / table["sum"]
            grams.append(hashes)
            shares.append(share)
            below = grams[n - 2] if n > 1 else np.zeros(0, np.uint64)
            left = leftovers[0] if n == 1 else np.ones((len(below) + 2, len(languages)), np.float32)
            context = sums["context"].to_numpy(np.int64).view(np.uint64)
            if n == 1:
                left = np.ones((1, len(languages)), np.float32)
                left[0, sums["lang"]] = DISCOUNT * sums["size"] / sums["sum"]
            else:
                where = np.minimum(np.searchsorted(below, context), len(below) - 1 if len(below) else 0)
                where = np.where(context == 1, len(below) + 1, np.where(below[where] == context if len(below) else False, where, len(below)))
                known = where != len(below)
                left[where[known], sums["lang"].to_numpy()[known]] = (DISCOUNT * sums["size"] / sums["sum"]).to_numpy()[known]
            leftovers.append(left)
        alphabet = max(len(grams[0]), 1) + 1
        return cls(languages, grams, shares, leftovers[1:], 1.0 / alphabet)

    def word_costs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct word its cost in nats under each language, and its characters."""
        hashes = ngram_hashes(words)
        chars = len(words.chars)
        p = np.full((chars, len(self.languages)), self.uniform, np.float32)
        before = None
        for n in range(1, ORDER + 1):
            grams = self.grams[n - 1]
            at = np.searchsorted(grams, hashes[n - 1])
            at = np.minimum(at, max(len(grams) - 1, 0))
            found = (grams[at] == hashes[n - 1]) if len(grams) else np.zeros(chars, bool)
            at = np.where(found, at, len(grams))
            live = hashes[n - 1] != 0
            if n == 1:
                left = self.leftovers[0][0]
                p = np.where(live[:, None], self.shares[0][at] + left * p, p)
            else:
                context = np.concatenate([[len(self.grams[n - 2])], before[:-1]])
                if n == 2:  # right after an opening mark
                    context[words.starts[:-1] + 1] = len(self.grams[0]) + 1
                left = self.leftovers[n - 1][context]
                p = np.where(live[:, None], self.shares[n - 1][at] + left * p, p)
            before = at
        cost = -np.log(np.maximum(p[1:], 1e-12)).astype(np.float64)
        sizes = np.diff(words.starts)
        if not len(sizes):
            return np.zeros((0, len(self.languages))), sizes
        return np.add.reduceat(cost, words.starts[:-1], axis=0), sizes

    def cross_entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text the cost of a character under each language, and its characters."""
        words = letters(texts)
        cost, sizes = self.word_costs(words)
        length = np.bincount(words.owner, sizes[words.code], minlength=len(texts))
        total = np.column_stack([np.bincount(words.owner, cost[words.code, i], minlength=len(texts)) for i in range(len(self.languages))]) if self.languages else np.zeros((len(texts), 0))
        return total / np.maximum(length, 1)[:, None], length

    def predict(self, texts: pa.Array):
        """Language (None: no letters), score, lowest cross-entropy, whether rejected."""
        parts = [self.cross_entropies(part) for _, part in slices(texts)] or [self.cross_entropies(texts)]
        entropy, length = (np.concatenate(x) for x in zip(*parts))
        if not self.languages:
            n = len(texts)
            return [None] * n, np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        score = 1 / np.exp(-SLOPE * (entropy - low[:, None])).sum(axis=1)
        some = length > 0
        names = [self.languages[b] if s else None for b, s in zip(best, some)]
        return names, np.where(some, score, 0.0), np.where(some, low, np.nan), some & (low > self.bounds[best])


def sample(train: DataFrame, lang: str, doc_id: str, bound: float) -> DataFrame:
    """About ``bound`` rows of each language, by a hash of the id; all of rarer ones."""
    sizes = {r[0]: r[1] for r in train.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return train.withColumn("place", F.lit(0.0)).where(F.lit(False))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, bound / n))])[F.col(lang)]
    place = F.pmod(F.xxhash64(F.lit(11), doc_id), F.lit(1 << 30)) / (1 << 30)
    return train.withColumn("place", place / share).where("place < 1")


def train_models(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModels:
    """Models of the languages of the rows where ``train`` holds and the language isn't null."""
    rows = docs.where(train & F.col(lang).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    drawn = cut_lineage(sample(rows.where("text is not null"), "lang", "doc_id", SAMPLE * (1 + CALIBRATION)))
    fitted = drawn.where(F.col("place") < 1 / (1 + CALIBRATION))
    kinds = "lang string, n int, gram long, tail long, context long, count long"
    counts = fitted.select("lang", "text").mapInArrow(_count_ngrams, kinds)
    counts = counts.groupBy("lang", "n", "gram").agg(F.first("tail").alias("tail"), F.first("context").alias("context"), F.sum("count").alias("count"))
    kept = counts.where((F.col("count") > 1) | (F.col("n") <= KEEP_ALL)).toPandas()
    models = LanguageModels.fit(kept, sorted(set(kept["lang"])))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf("double")
    def entropy(langs: pa.Array, texts: pa.Array) -> pa.Array:
        model = shared.value
        parts = [model.cross_entropies(part) for _, part in slices(texts)] or [model.cross_entropies(texts)]
        values, length = (np.concatenate(x) for x in zip(*parts))
        column = [model.languages.index(x) if x in model.languages else None for x in langs.to_pylist()]
        return pa.array([None if c is None or not n else float(v[c]) for c, v, n in zip(column, values, length)], pa.float64())

    rest = drawn.where(F.col("place") >= 1 / (1 + CALIBRATION))
    bounds = rest.groupBy("lang").agg(F.avg(entropy("lang", "text")).alias("m"), F.stddev_pop(entropy("lang", "text")).alias("d"))
    for r in bounds.collect():
        if r["lang"] in models.languages and r["m"] is not None:
            models.bounds[models.languages.index(r["lang"])] = r["m"] + REJECT_DEVIATIONS * r["d"]
    return models


def predict_languages(docs: DataFrame, models: LanguageModels, doc_id: str = "doc_id", text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, lang_pred, score, cross_entropy, rejected for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf("struct<lang_pred:string,score:double,cross_entropy:double,rejected:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        names, score, low, rejected = shared.value.predict(texts)
        columns = [pa.array([n or "und" for n in names], pa.string()), pa.array(score), pa.array(low, from_pandas=True), pa.array(rejected)]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(F.col(doc_id).alias("doc_id"), *keep, predict(F.col(text)).alias("r")).select("doc_id", *[k for k in _names(docs, keep)], "r.*")


def _names(docs: DataFrame, columns: tuple[Column, ...]) -> list[str]:
    return docs.select(*columns).columns if columns else []
