import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from keelson.llm import langid


def brute(train, order, discount, keep_all=99):
    """Interpolated Kneser-Ney over strings, taken straight from its definition."""
    grams = defaultdict(Counter)
    for word, n in train.items():
        seq = " " + word + " "
        for end in range(1, len(seq)):
            for k in range(1, order + 1):
                if end - k + 1 >= 0:
                    grams[k][seq[end - k + 1 : end + 1]] += n
    alphabet = len({g for g in grams[1]}) + 1

    def value(gram):
        k = len(gram)
        if k == order:
            return grams[k][gram]
        kinds = sum(1 for g in grams[k + 1] if g[1:] == gram)
        return kinds or min(grams[k][gram], 1)

    values = {g: value(g) for k in range(1, order + 1) for g in grams[k]}
    sums, sizes = Counter(), Counter()
    for g, v in values.items():
        sums[len(g), g[:-1]] += v
        sizes[len(g), g[:-1]] += 1

    def p(history, c):
        prob = 1.0 / alphabet
        for k in range(1, order + 1):
            if k - 1 > len(history):
                break
            context = history[len(history) - k + 1 :] if k > 1 else ""
            if not sums[k, context]:
                continue
            own = values.get(context + c)
            prob = (max(own - discount, 0) / sums[k, context] if own else 0) + discount * sizes[k, context] / sums[k, context] * prob
        return prob

    return lambda word: -sum(math.log(p((" " + word + " ")[:i], (" " + word + " ")[i])) for i in range(1, len(word) + 2))


def test_costs_by_brute_force(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))) for _ in range(60)) for _ in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 4), pa.array(texts)], ["lang", "text"])
    parts = pd.concat([b.to_pandas() for b in langid._count_ngrams(iter([batch]))])
    counts = parts.groupby(["lang", "n", "gram"], as_index=False).agg({"tail": "first", "context": "first", "count": "sum"})
    models = langid.LanguageModels.fit(counts, ["x"])
    cost = brute(Counter(w for t in texts for w in t.split()), langid.ORDER, langid.DISCOUNT)
    probe = ["abc", "é", "cabé", "zzz", "aazb"] + texts[0].split()[:5]
    words = langid.letters(pa.array([" ".join(probe)]))
    got, sizes = models.word_costs(words)
    order = list(dict.fromkeys(probe))
    assert np.allclose(got[:, 0], [cost(w) for w in order], rtol=1e-4)
    assert sizes.tolist() == [len(w) + 1 for w in order]


def test_documents(spark):
    rng = random.Random(2)
    kinds = {"aa": "abcde", "bb": "defgh", "cc": "жзикл"}
    rows = []
    for i in range(300):
        lang = rng.choice(list(kinds))
        rows.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(5)) for _ in range(rng.randrange(3, 40))), lang, 0.5))
    rows += [(900, None, "aa", 0.1), (901, "", "bb", 0.1), (902, "12 !! 34", None, 0.1), (1, rows[1][1], rows[1][2], 0.5), (903, "жзик " * 30000, None, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(4)
    models = langid.train_models(docs, F.col("doc_id") % 3 != 1)
    assert models.languages == ["aa", "bb", "cc"]
    got = langid.predict_languages(docs, models, keep=((F.col("doc_id") % 3 == 1).alias("held_out"),)).collect()
    assert len(got) == len(rows)
    want = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "cc"]
    odd = langid.predict_languages(spark.createDataFrame([(1, "qqqq xxyx yyxx " * 20)], "doc_id long, text string"), models).first()
    assert odd.rejected and not by_id[903].rejected
    none = langid.train_models(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predict_languages(docs, none).collect()} == {"und"}


def test_marks_alone_are_no_letters():
    import pyarrow as pa

    from keelson.llm import langid

    words = langid.letters(pa.array(["\u0301\u0308 12", "e\u0301 \u0301 b", None]))
    assert sorted(words.owner.tolist()) == [1, 1] and len(words.starts) == 3
