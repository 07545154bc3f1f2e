import pathlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from keelson.llm import bktree, common, simhash
from keelson.llm.graph import connected_components


def brute_print(text, size):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, radius):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def cluster(rng, size):
    centre = rng.getrandbits(64)
    out = []
    for _ in range(size):
        value = centre
        for _ in range(rng.randrange(7)):
            value ^= 1 << rng.randrange(64)
        out.append(value)
    return out


def test_fingerprints():
    rng = random.Random(1)
    words = ["The", "a", "Éa", "b\x1fc", "D", "\xa0x", "\n", "\x0b"]
    for size in (1, 3, 5):
        for n in range(40):
            text = " ".join(rng.choice(words) for _ in range(n))
            assert simhash.fingerprint_of(text, size) % (1 << 64) == brute_print(text, size)


def test_forest_finds_all_within_radius():
    rng = random.Random(2)
    values = np.array([v for _ in range(20) for v in cluster(rng, 30)], np.uint64)
    values = np.unique(values)
    shard = np.sort(np.array([rng.randrange(3) for _ in values]))
    forest = bktree.Forest(values, shard)
    for radius in (0, 2, 6):
        got = {(int(q), int(v)) for qs, vs, _ in forest.within(np.arange(len(values)), radius) for q, v in zip(qs, vs)}
        want = {(i, j) for i in range(len(values)) for j in range(len(values)) if shard[i] == shard[j] and bin(int(values[i]) ^ int(values[j])).count("1") <= radius}
        assert got == want


def test_masks_cover_the_radius():
    rng = random.Random(3)
    for radius in (1, 2, 3):
        masks = simhash.shard_masks(radius)
        for _ in range(500):
            flips = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not flips & m for m in masks)


def test_components_of_edges(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400, x) for x in range(401, 460)] + [(x, x + 1) for x in range(500, 600)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    label = bktree.components(700, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert got == {n: int(label[n]) for n in {x for e in edges if e[0] != e[1] for x in e}}


def check(spark, prints, monkeypatch=None):
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    table = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    got = {r.node: r.root for r in simhash.print_components(table, 2).collect()}
    groups, want = {}, {}
    for i, x in enumerate(brute_components(prints, 2)):
        want.setdefault(x, set()).add(rows[i][1])
    for _, p in rows:
        groups.setdefault(got.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_links_by_brute_force(spark):
    rng = random.Random(5)
    check(spark, [v for _ in range(12) for v in cluster(rng, 25)])


def test_large_shards_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_SHARD", 5)
    rng = random.Random(6)
    check(spark, [v for _ in range(4) for v in cluster(rng, 60)])


def test_documents(spark):
    words = [f"w{i}" for i in range(200)]
    rng = random.Random(7)
    long = " ".join(rng.choice(words) for _ in range(20000))
    rows = [(5, long, 1), (3, long + " end", 1), (9, None, 1), (8, "", 1), (7, " \t", 1), (2, "one two", 1), (2, "one two", 1), (4, "ONE  two", 1), (6, "other words here now", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_components(docs, 2, 3).collect()}
    by_id = {k[0]: v for k, v in got.items()}
    assert by_id == {5: 3, 3: 3, 9: 7, 8: 7, 7: 7, 2: 2, 4: 2, 6: 6}
    assert got[(7, "0" * 16)] == 7
    assert simhash.near_components(docs.limit(0), 2, 3).count() == 0


def test_outlines_exclude_no_similar_pair(spark):
    draw = random.Random(5)
    texts = [None, "", "one two", "ONE two", "É a b c d e", "é a b c d e"]
    for _ in range(12):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.choice([4, 30, 90, 1500]))]
        texts.append(" ".join(words))
        for share in (0.01, 0.03, 0.3):
            texts.append(" ".join(f"x{draw.randrange(99)}" if draw.random() < share else w for w in words))
    rows = [(i, x, [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", (x or "").lower()) if w]) for i, x in enumerate(texts)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1 if w else 0))} for i, _, w in rows}
    drawn = spark.createDataFrame([r[:2] for r in rows], "i int, text string").select("i", simhash.outline(F.col("text")).alias("o")).cache()
    both = drawn.crossJoin(drawn.select(F.col("i").alias("j"), F.col("o").alias("p")))
    kept = {(r.i, r.j) for r in both.where(simhash.may_be_similar(F.col("o"), F.col("p"))).collect()}
    similar = {(i, j) for i in sets for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert similar <= kept
    assert len(kept) < 2 * len(similar)


def word_sets(texts):
    split = [[w for w in re.split(r"[ \t\n\x0b\x0c\r]+", x.lower()) if w] for x in texts]
    return [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1 if w else 0))} for w in split]


def check_near_copies(spark, texts):
    """One document of each class by all pairs that overlap by 0.8 stays: the first."""
    sets, label = word_sets(texts), list(range(len(texts)))
    near = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while any(label[i] != label[j] for i, j in near):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(r.doc_id for r in simhash.deduplicate(docs).collect())
    assert got == sorted(set(label))
    return len(near)


def test_all_near_copies_are_found(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 1, raising=False)
    monkeypatch.setattr(simhash, "BLOCK", 5, raising=False)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    texts = ["", " \t", "one two", "ONE  two", "É a b c d e"]
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 12, 40, 150]))]
        words += passage if rng.random() < 0.5 else []
        texts.append(" ".join(words))
        for _ in range(3):  # word order and a few edits: fingerprints of most differ in many bits
            copy = list(words)
            for _ in range(max(1, int(len(words) * rng.choice([0.01, 0.02, 0.025, 0.03])))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = word_sets(texts)
    prints = [simhash.fingerprint_of(x, 3) % (1 << 64) for x in texts]
    far = sum(bin(prints[i] ^ prints[j]).count("1") > 12 for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert check_near_copies(spark, texts) > 60 and far > 0


def test_texts_of_one_fingerprint_are_all_compared(spark, monkeypatch):
    """Near copies whose fingerprint's smallest text, or nearest neighbours, aren't similar."""
    monkeypatch.setattr(simhash, "fingerprint", lambda text, size=5: F.lit(7).cast("long"))
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        texts += [" ".join(words), " ".join([*words[:-1], "end"])]
    assert check_near_copies(spark, texts) == 12


def test_short_outlines_exclude_no_similar_pair():
    draw = np.random.default_rng(5)
    owner, value, sets = [], [], []
    for size in (1, 2, 9, 60, 300, 900):
        base = draw.integers(0, 1 << 63, size, dtype=np.uint64)
        for kept in (1.0, 0.95, 0.9, 0.8, 0.5):
            own = np.unique(np.concatenate([base[: max(1, round(size * kept))], draw.integers(0, 1 << 63, size // 12, dtype=np.uint64)]))
            owner += [len(sets)] * len(own)
            value += own.tolist()
            sets.append(set(own.tolist()))
    count = len(sets)
    drawn = simhash.short_outlines(np.array(value, np.uint64), np.array(owner), count)
    bits = drawn.flatten().to_numpy().view(np.uint64).reshape(-1, simhash.SHORT)
    x, y = np.triu_indices(count, 1)
    near = simhash._near_by_outlines(bits, np.array([len(s) for s in sets]), x, y)
    alike = np.array([len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in zip(x, y)])
    assert alike.any() and not (alike & ~near).any()
    assert near.sum() < len(x) / 2


def test_filter_loses_no_key(spark, monkeypatch):
    keys, rows = spark.range(0, 3000, 3).select((F.col("id") - 900).alias("k")), spark.range(3000).select((F.col("id") - 900).alias("k"), F.lit("x").alias("bits"))
    rows = rows.unionByName(spark.createDataFrame([(None, "x")], "k long, bits string"))
    for bits, passed in ((common.FILTER_BITS, 1010), (1 << 11, 2500), (64, 3001)):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        held = common.key_filter(keys, "k")
        may, not_in = common.may_be_in(rows, "k", held), common.may_be_in(rows, "k", held, False)
        assert may.columns == not_in.columns == rows.columns
        may, not_in = [r.k for r in may.collect()], [r.k for r in not_in.collect()]
        assert len(may) + len(not_in) == 3001 and not {r.k for r in keys.collect()} & set(not_in)
        assert {r.k for r in keys.collect()} <= set(may) and len(may) <= passed
    none = common.key_filter(keys.limit(0), "k")
    assert common.may_be_in(rows, "k", none).count() == 0 and common.may_be_in(rows, "k", none, False).count() == 3001


def written(spark):
    """Bytes of shuffle files now on disk."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in folders for f in pathlib.Path(str(d)).rglob("shuffle_*.data"))


def test_texts_without_copies_are_not_shuffled(spark):
    rng = random.Random(10)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(200)) for _ in range(800)]
    rows = [(i, x) for i, x in enumerate(texts)] + [(900 + i, x) for i, x in enumerate(texts[:20])] + [(5, texts[5]), (None, texts[6]), (None, None)]
    docs = common.cut_lineage(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    before = written(spark)
    kept = sorted(r.doc_id if r.doc_id is not None else -1 for r in simhash.deduplicate(docs).collect())
    assert kept == [-1, *range(800)]
    assert written(spark) - before < 0.5 * sum(map(len, texts))


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 64)
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(150)]
    assert check_near_copies(spark, texts + [f"{x} end" for x in texts[:40]] + texts[30:60]) >= 70
