import random
from collections import Counter, defaultdict

from keelson.llm import mixing


def table(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "é", "Z", None])
        words = rng.choice([0, 1, 3, 50, 400, 3000]) if source != "c" else rng.randrange(1, 9)
        rows.append((i, " ".join("w%d" % rng.randrange(90) for _ in range(words)) if words else rng.choice([None, "", " \n"]), source, 1))
    rows += [rows[5], rows[5]] + [(5000, None, "only nulls", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, taken int").repartition(5)


def fill(sizes, weights):
    """Water filling by bisection on the level, another way than the operator's."""
    total, low, high = sum(sizes), 0.0, float(sum(sizes) * 4)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(3 * s, mid * w) for s, w in zip(sizes, weights)) < total:
            low = mid
        else:
            high = mid
    return [min(3 * s, high * w) for s, w in zip(sizes, weights)]


def test_report(spark):
    rows, docs = table(spark)
    got = mixing.mix_report(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(names, fill([sizes[n] for n in names], [1 + i % 3 for i in range(len(names))])))
    source = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    for r in got:
        name = source[r.doc_id]
        assert r.source_size == sizes[name] and abs(r.target - target[name]) < 1e-6 * max(1, target[name])
        assert 0 <= r.taken <= 3 * r.size
        taken[name] += r.taken
    assert all(abs(taken[n] - target[n]) <= 1 for n in names)
    again = mixing.mix_report(docs.coalesce(1)).collect()
    key = lambda x: sorted((r.doc_id, r.size, r.taken) for r in x if r.doc_id != 5)
    assert key(got) == key(mixing.mix_report(docs).collect())
    assert sum(r.taken for r in again) == sum(r.taken for r in got)


def test_schedule_is_even(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 100)
    sources = mixing.set_targets([mixing.Source(n, s, w) for n, s, w in (("a", 10**6, 1.0), ("b", 3 * 10**5, 2.0), ("c", 10, 3.0), ("d", 0, 1.0))])
    rows = sorted(mixing.schedule(spark, sources, 4).collect())
    for i, s in enumerate(sources):
        assert [r.rank for r in rows if r.source_no == i] == list(range(s.slots))
    half = [r for r in rows if r.slot < rows[-1].slot / 2]
    for i in (0, 1):
        assert abs(sum(r.source_no == i for r in half) - sources[i].slots / 2) < 40


def test_documents_of_the_mix(spark):
    rows, docs = table(spark, 2)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    got, texts = mixed.collect(), {r[0]: r[1] for r in rows}
    taken = Counter()
    for r in got:
        assert r.text and r.text in texts[r.doc_id]
        taken[r.doc_id] += len(r.text.split())
    report = Counter()
    for r in mixing.mix_report(docs).collect():
        report[r.doc_id] += r.taken
    assert taken == +report
    assert mixing.mix_documents(docs.limit(0)).count() == 0 == mixing.mix_report(docs.limit(0)).count()
