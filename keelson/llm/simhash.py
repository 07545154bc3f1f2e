"""SimHash near-dedup: fingerprints, BK-tree shards, connected components.

A shard is what shares some bits of the fingerprint; every fingerprint joins a shard for
each mask of ``shard_masks``. For radius r the 64 bits are cut into r + 2 blocks and each
pair of blocks is a mask: two fingerprints at r or fewer differing bits agree on at least
two blocks, so they meet in a shard and no link is lost. Each shard's BK-tree is built in
the task that the shard is dealt to and searched with the shard's own members; broadcasting
trees of all fingerprints would have no size bound. A shard with more than ``MAX_SHARD``
members is dealt again by pairs of blocks of the bits that its mask leaves free, which
again loses nothing. Out of a shard go only links of each member to the smallest one that
it reaches there: never all pairs.

Exact copies share a fingerprint and enter the shards once. Defined results: a null or
empty text has fingerprint zero and links like any other; equal rows give equal rows;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.bktree import Forest, components
from keelson.llm.common import WordBatch, cut_lineage, in_tasks, key_filter, may_be_in, slices, worker_model
from keelson.llm.graph import connected_components
from keelson.llm.lblm import frequent_words

SEED = 42
MAX_SHARD = 4096
#: deduplicate(): fingerprints this near are compared first; what counts as a near copy;
#: words in a shingle of the comparison.
FIRST_RADIUS, SIMILARITY, SHINGLE = 2, 0.8, 5
#: Common shingles are counted in one of so many texts; those in at least so many texts of
#: these, and no more than so many shingles, come last in a text's order.
COUNTED, COMMON, MOST_COMMON = 16, 4, 100_000
#: Texts that share a shingle are paired in blocks of about so many.
BLOCK = 1024
#: Bits of an outline for each shingle of a text, and the least number of 64-bit words.
OUTLINE, LEAST_WORDS = 4, 4
#: 64-bit words of the outline of one length that goes with a text into the lists of those
#: that share a shingle.
SHORT = 8
#: Bytes of text whose shingles are held at once.
SLICE = 2 << 20
#: Odd numbers that mix the hashes of a shingle's words by their place.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
NONE_COMMON = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def fingerprint_of(text: str, size: int) -> int:
    """The SimHash of a text's shingles of ``size`` words, as a signed 64-bit number."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        whole = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a : b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1 :])]
    bits = np.zeros(64, np.int64)
    packed = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    for at in range(0, len(packed), 1 << 16):
        bits += np.unpackbits(packed[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(packed), bitorder="little").view(np.int64)[0])


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes (uint64) of the shingles of ``size`` words of each of a batch's texts,
    in lower case, and the number of the text that each belongs to; sorted by text and hash.

    Each distinct word is hashed once, and a shingle's words are mixed in numpy over the whole
    run of words. Where a text has fewer words than a shingle, nothing stands for those that
    lack.
    """
    words = WordBatch(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), lower=False)
    named = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words.vocabulary.to_pylist()], np.uint64)
    run = np.concatenate([named[words.codes], np.zeros(size - 1, np.uint64)])
    counts, bounds = words.counts, words.bounds
    with np.errstate(over="ignore"):
        mixed = sum(run[k : len(run) - size + 1 + k] * FACTORS[k % len(FACTORS)] for k in range(size))
        for i in np.flatnonzero((counts > 0) & (counts < size)):
            at = bounds[i]
            mixed[at] = sum(run[at + k] * FACTORS[k % len(FACTORS)] for k in range(counts[i]))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * FACTORS[1]
    mixed ^= mixed >> np.uint64(29)
    spans = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    own = [mixed[a : a + n] for a, n in zip(bounds[:-1].tolist(), spans.tolist())]
    for values in own:  # of one text
        values.sort()
    value, owner = np.concatenate([*own, NONE_COMMON[0]]), np.repeat(np.arange(len(counts)), spans)
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], owner[new]


def as_lists(value: np.ndarray, owner: np.ndarray, count: int) -> pa.ListArray:
    """The values of each of ``count`` owners as one list of signed numbers."""
    ends = np.searchsorted(owner, np.arange(count + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))


def outlines_of(value: np.ndarray, owner: np.ndarray, count: int) -> pa.ListArray:
    """For each text OUTLINE or more bits for each of its hashes, in 64-bit words whose number
    is a power of two: those bits are set that some hash names, modulo their number."""
    size = np.bincount(owner, minlength=count)
    words = np.left_shift(1, np.ceil(np.log2(np.maximum(size * OUTLINE / 64, LEAST_WORDS))).astype(np.int64))
    starts = np.cumsum(words) - words
    bits = np.zeros(int(words.sum()) * 64, bool)
    bits[starts[owner] * 64 + (value & (words[owner] * 64 - 1).astype(np.uint64)).astype(np.int64)] = True
    return as_lists(np.packbits(bits, bitorder="little").view(np.uint64), np.repeat(np.arange(count), words), count)


def short_outlines(value: np.ndarray, owner: np.ndarray, count: int) -> pa.ListArray:
    """outlines_of, but of SHORT words whatever the number of hashes: those of a long text have
    nearly all bits set and exclude nothing."""
    bits = np.zeros((count, SHORT * 64), bool)
    bits[owner, (value & np.uint64(SHORT * 64 - 1)).astype(np.int64)] = True
    return as_lists(np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.uint64), np.repeat(np.arange(count), SHORT), count)


def prefixes_of(value: np.ndarray, owner: np.ndarray, count: int, common: tuple[np.ndarray, np.ndarray]) -> tuple[pa.ListArray, np.ndarray]:
    """Each text's first hashes in an order that all share: common ones last, by how common;
    and how many of these, at the front, aren't common.

    There are so many that two texts that overlap by SIMILARITY have one of theirs in common:
    of n at least SIMILARITY * n are shared, so no more than the rest can come before it.
    A text without shingles has one of its own kind, as such texts are alike; it counts as
    common.
    """
    size = np.bincount(owner, minlength=count)
    bare = np.flatnonzero(size == 0)
    value, owner = np.concatenate([value, np.zeros(len(bare), np.uint64)]), np.concatenate([owner, bare])
    order = np.argsort(owner, kind="stable")
    value, owner = value[order], owner[order]
    known, held = common
    usual = np.repeat(size == 0, np.maximum(size, 1))
    if len(known):
        at = np.minimum(np.searchsorted(known, value), len(known) - 1)
        often = np.where(known[at] == value, held[at], 0)
        starts = np.searchsorted(owner, np.arange(count + 1))
        for i in np.unique(owner[often > 0]):
            own = slice(starts[i], starts[i + 1])
            order = np.argsort(often[own], kind="stable")
            value[own], usual[own] = value[own][order], usual[own] | (often[own][order] > 0)
    place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(count))[owner]
    first = place < (size - np.ceil(SIMILARITY * size - 1e-6).astype(np.int64) + 1)[owner]
    return as_lists(value[first], owner[first], count), np.bincount(owner[first & ~usual], minlength=count)


def outline(text: Column, size: int = SHINGLE, common=None) -> Column:
    """struct<size: bigint, bits, short, prefix: array<bigint>, rare: bigint>: the number of
    distinct shingles of a text; see outlines_of, short_outlines and prefixes_of. Null counts as
    empty. ``common`` is a broadcast of the hashes and counts of common shingles."""
    names = ["size", "bits", "short", "prefix", "rare"]

    @F.arrow_udf("struct<size:bigint,bits:array<bigint>,short:array<bigint>,prefix:array<bigint>,rare:bigint>")
    def draw(texts: pa.Array) -> pa.Array:
        worker_model("simhash")
        order = NONE_COMMON if common is None else common.value
        parts = []
        for _, part in slices(texts, SLICE):
            value, owner = shingle_sets(part, size)
            count = len(part)
            prefix, rare = prefixes_of(value, owner, count, order)
            drawn = [outlines_of(value, owner, count), short_outlines(value, owner, count), prefix, pa.array(rare)]
            parts.append(pa.StructArray.from_arrays([pa.array(np.bincount(owner, minlength=count)), *drawn], names))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, pa.int64() if n in ("size", "rare") else pa.list_(pa.int64())) for n in names]))

    return draw(text)


def sets_of(texts: DataFrame) -> DataFrame:
    """node, s (array<bigint>: the distinct hashes of shingles) for texts (node, text)."""

    def gather(batches):
        for batch in batches:
            for at, part in slices(batch.column(1), SLICE):
                value, owner = shingle_sets(part, SHINGLE)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), as_lists(value, owner, len(part))], ["node", "s"])

    return texts.select("node", "text").mapInArrow(gather, "node long, s array<long>")


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many texts (node, text) hold, and in how many of those
    counted. It decides how fast pairs are found, not which."""
    drawn = texts.where(F.pmod(F.xxhash64(F.lit(29), "node"), F.lit(COUNTED)) == 0)
    drawn = drawn.groupBy("node").agg(F.first("text").alias("text"))
    held = sets_of(drawn).select(F.explode("s").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    rows = frequent_words(cut_lineage(held.where(F.col("c") >= COMMON)), MOST_COMMON)[:MOST_COMMON]
    known, counts = np.array([r.word for r in rows], np.int64).view(np.uint64), np.array([r.c for r in rows], np.int64)
    order = np.argsort(known)
    return known[order], counts[order]


def may_be_similar(x: Column, y: Column) -> Column:
    """False only where no overlap of SIMILARITY is possible, by the outlines of two texts.

    Each bit of x that y lacks stands for at least one shingle that y lacks, so both sizes
    less such bits bound what is common. Of outlines of two lengths the longer is folded to
    the shorter; where it is more than twice as long, the sizes differ too much.
    """
    length = F.least(F.size(x["bits"]), F.size(y["bits"]))
    either = lambda m, n: m.bitwiseOR(n)
    folded = lambda p: F.when(F.size(p["bits"]) == length, p["bits"]).otherwise(F.zip_with(F.slice(p["bits"], F.lit(1), length), F.slice(p["bits"], length + 1, length), either))
    alone = lambda p, q: F.aggregate(F.zip_with(folded(p), folded(q), lambda m, n: F.bit_count(m.bitwiseAND(F.bitwise_not(n)))), F.lit(0), lambda total, n: total + n)
    far = F.least(x["size"], y["size"]) < SIMILARITY * F.greatest(x["size"], y["size"]) - 1e-6
    most = F.least(x["size"] - alone(x, y), y["size"] - alone(y, x))
    return F.when(far, False).otherwise(most >= SIMILARITY * (x["size"] + y["size"] - most))


def fingerprint(text: Column, size: int = 5) -> Column:
    """bigint: the SimHash of a text; null counts as empty."""

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        worker_model("simhash")
        return pa.array([fingerprint_of(x.as_py() or "", size) for x in texts], pa.int64())

    return simhash(text)


def blocks(bits: int, count: int) -> list[int]:
    """``count`` masks that part the set bits of ``bits`` into runs of nearly equal size."""
    places = [i for i in range(64) if bits >> i & 1]
    cuts = [len(places) * i // count for i in range(count + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(cuts, cuts[1:])]


def shard_masks(radius: int, free: int = (1 << 64) - 1) -> list[int]:
    """Masks of which any two fingerprints within the radius agree on at least one."""
    return [a | b for a, b in combinations(blocks(free, radius + 2), 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _deal(rows: DataFrame, masks: list[int], keys: list[str]) -> DataFrame:
    """rows for each mask, with its number and the fingerprint's bits under it as keys."""
    table = F.array(*[F.struct(F.lit(i).alias(keys[0]), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)])
    dealt = rows.withColumn("deal", F.explode(table))
    bits = F.col("fingerprint").bitwiseAND(F.col("deal.mask")).alias(keys[1])
    return dealt.select(*rows.columns, F.col(f"deal.{keys[0]}").alias(keys[0]), bits)


def shards(prints: DataFrame, masks: list[int], again_masks) -> DataFrame:
    """array<bigint> ``members``: each shard of two or more distinct fingerprints.
    ``again_masks`` gives the masks by which a large shard is dealt again, from its free bits."""
    dealt = _deal(prints, masks, ["m", "bits"])
    sizes = dealt.groupBy("m", "bits").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > MAX_SHARD).select("m", "bits")
    gather = F.collect_list("fingerprint").alias("members")
    small = dealt.join(large, ["m", "bits"], "left_anti").groupBy("m", "bits").agg(gather)
    hot = dealt.join(large, ["m", "bits"], "left_semi")
    table = F.array(*[F.array(*[F.lit(_signed(x)) for x in again_masks(~m & (1 << 64) - 1)]) for m in masks])
    again = hot.select("fingerprint", "m", "bits", F.posexplode(F.get(table, F.col("m"))).alias("m2", "mask"))
    again = again.withColumn("bits2", F.col("fingerprint").bitwiseAND(F.col("mask")))
    split = again.groupBy("m", "bits", "m2", "bits2").agg(gather)
    return small.select("members").unionByName(split.select("members")).where(F.size("members") > 1)


def _shard_roots(radius: int):
    def links(batches):
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            shard = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            order = np.lexsort((values, shard))
            values, shard = values[order], shard[order]
            forest = Forest(values.view(np.uint64), shard)
            label = np.arange(len(values))
            for query, node, _ in forest.within(np.arange(len(values)), radius):
                label = components(len(values), query, node, label)
            linked = np.flatnonzero(label != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(values[linked]), pa.array(values[label[linked]])], ["a", "b"])

    return links


def print_components(prints: DataFrame, radius: int) -> DataFrame:
    """node, root over distinct fingerprints that have at least one link within the radius."""
    found = shards(prints.select("fingerprint").distinct(), shard_masks(radius), lambda free: shard_masks(radius, free))
    return connected_components(found.mapInArrow(_shard_roots(radius), "a bigint, b bigint"), "a", "b")


def near_components(docs: DataFrame, radius: int = 2, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    component_id is the smallest doc_id that links of at most ``radius`` differing bits
    reach. Null ids keep their row and count as no id.
    """
    prints = cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), size).alias("fingerprint")))
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots = print_components(prints, radius).withColumnRenamed("node", "fingerprint")
    classes = least.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    heads = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(heads, "root").select("fingerprint", "component_id")
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return prints.join(named, "fingerprint").select("doc_id", shown.alias("fingerprint"), "component_id")


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts (node, text) whose shingle sets overlap by SIMILARITY.

    Texts that are in no pair are left where they are, by a filter of those that are.
    """
    pairs = cut_lineage(pairs)
    pairs = in_tasks(pairs, pairs.count())
    named = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    named = in_tasks(named, named.count())
    once = may_be_in(texts, "node", key_filter(named, "node")).groupBy("node").agg(F.first("text").alias("text"))
    sets = sets_of(once.join(named, "node", "left_semi"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= SIMILARITY * (F.size("x") + F.size("y") - common)).select("a", "b")


def _possible(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of items (node, size, bits) that may be similar, a above b."""
    end = lambda key: items.select(F.col("node").alias(key), F.struct("size", "bits").alias(f"{key}_outline"))
    pairs = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return pairs.join(end("a"), "a").join(end("b"), "b").where(may_be_similar(F.col("a_outline"), F.col("b_outline"))).select("a", "b")


def _near_by_outlines(bits: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """may_be_similar of the texts numbered x and y, by their short outlines."""
    near = np.zeros(len(x), bool)
    for at in range(0, len(x), 1 << 17):
        i, j = x[at : at + (1 << 17)], y[at : at + (1 << 17)]
        alone = lambda p, q: np.bitwise_count(bits[p] & ~bits[q]).sum(axis=1, dtype=np.int64)
        most = np.minimum(size[i] - alone(i, j), size[j] - alone(j, i))
        near[at : at + (1 << 17)] = most * (1 + SIMILARITY) >= SIMILARITY * (size[i] + size[j]) - 1e-6
    return near


def _cross_pairs(batches):
    """Pairs of each list's members that are in different classes and blocks to be paired,
    whose overlap can reach SIMILARITY if this is the first shingle that they share, and whose
    short outlines don't exclude it."""
    for batch in batches:
        lists = batch.column(0)
        length = np.diff(lists.offsets.to_numpy())
        first = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
        flat = lists.flatten()
        node, label, size, left, block = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
        bits = flat.field(5).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SHORT)
        across = batch.column(1).to_numpy(zero_copy_only=False)
        for n in np.unique(length):
            i, j = np.triu_indices(n, 1)
            rows = np.flatnonzero(length == n)
            for part in np.array_split(rows, max(1, len(rows) * len(i) >> 18)):
                x, y = (first[part][:, None] + k for k in (i, j))
                most = np.minimum(left[x], left[y])
                met = (label[x] != label[y]) & (most * (1 + SIMILARITY) >= SIMILARITY * (size[x] + size[y]) - 1e-6)
                met &= ~across[part][:, None] | (block[x] != block[y])
                x, y = x[met], y[met]
                near = _near_by_outlines(bits, size, x, y)
                a, b = node[x[near]], node[y[near]]
                pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])


def _pairs_left(shared: DataFrame, roots: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that share a prefix shingle and aren't in one class by roots, less
    those that the short outlines in items exclude.

    A shingle of many texts is dealt by pairs of blocks of them, so no task holds them all;
    one whose texts are all in one class by now adds nothing and is left out. Shingles of
    the same texts, as of one passage, count once, each text with the most it has left at any
    of them; where others meet them by chance, more pairs are formed, never fewer.
    """
    named = shared.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    texts = F.xxhash64(F.min("node"), F.max("node"), F.count(F.lit(1)), F.bit_xor(F.xxhash64("node")))
    kinds = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), texts.alias("texts"))
    held = named.join(kinds.where("low <> high").select("token", "texts"), "token").withColumn("token", F.col("texts"))
    held = cut_lineage(held.groupBy("token", "node", "label").agg(F.first("size").alias("size"), F.max("left").alias("left")))
    held = in_tasks(held, held.count())
    sizes = held.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    held = held.join(items.select("node", "short"), "node")
    dealt = held.join(sizes, "token").withColumn("block", F.pmod(F.xxhash64(F.lit(31), "node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.struct("node", "label", "size", "left", "block", "short").alias("m"))
    lists = dealt.groupBy("token", "low", "high").agg(F.collect_list("m").alias("members")).where(F.size("members") > 1)
    return lists.select("members", (F.col("low") != F.col("high")).alias("across")).mapInArrow(_cross_pairs, "a long, b long")


def near_links(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """Links (a, b) between similar distinct texts, which join all that all similar pairs join.

    First each text is compared with those that SimHash shards name (FIRST_RADIUS) and with
    the texts of lowest and highest node, and one more, that share a prefix shingle. Of all other
    pairs that share a prefix shingle those within one class by then add nothing; the rest
    are compared too, so nothing is missed and a group of thousands isn't compared pair by
    pair. ``prints`` has node, fingerprint, size, bits, short, prefix, rare, for each distinct text.

    A shingle that isn't common is shuffled once, to see in one pass whether a second text has
    it; common ones, of which a third of all texts may have one, aren't gathered for that.
    """
    items = prints.select("node", "fingerprint", "size", "bits", "short")
    values = cut_lineage(items.select("fingerprint").distinct())
    values = in_tasks(values, values.count())
    found = shards(values, shard_masks(FIRST_RADIUS), lambda free: shard_masks(FIRST_RADIUS, free))
    near = found.mapInArrow(_shard_roots(FIRST_RADIUS), "a long, b long").distinct()
    heads = items.groupBy("fingerprint").agg(F.min("node").alias("head"))
    same = items.join(heads, "fingerprint").select(F.col("node").alias("a"), F.col("head").alias("b"))
    end = lambda key, name: heads.select(F.col("fingerprint").alias(key), F.col("head").alias(name))
    across = near.join(end("a", "x"), "a").join(end("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    tokens = prints.select("node", "size", "rare", F.posexplode("prefix").alias("at", "token"))
    # size and number left in one number: most of these rows meet no other one
    packed = F.shiftleft("size", 32).bitwiseOR(F.col("size") - F.col("at"))
    usual = F.col("at") >= F.col("rare")
    row = ["token", "node", packed.alias("packed")]
    met = tokens.where(~usual).select(*row).withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("texts > 1")
    shared = cut_lineage(met.drop("texts").unionByName(tokens.where(usual).select(*row)))
    drawn = F.xxhash64("token", "node")  # another one for each shingle that a group shares
    ends = shared.groupBy("token").agg(
        F.min("node").alias("first"), F.max("node").alias("last"),
        F.min_by("packed", "node").alias("first_packed"), F.max_by("packed", "node").alias("last_packed"),
        F.min_by("node", drawn).alias("any"), F.min_by("packed", drawn).alias("any_packed"),
    )
    size, left = lambda x: F.shiftright(x, 32), lambda x: F.col(x).bitwiseAND(0xFFFFFFFF)
    each = F.explode(F.array(*[F.struct(F.col(c).alias("b"), F.col(f"{c}_packed").alias("packed")) for c in ("first", "last", "any")]))
    starred = shared.join(ends, "token").select(F.col("node").alias("a"), "packed", each.alias("end"))
    stars = starred.where(_may_reach(size("packed"), size("end.packed"), left("packed"), left("end.packed"))).select("a", "end.b")
    links = cut_lineage(_similar(_possible(reduce(DataFrame.unionByName, [same, across, stars]), items), texts))
    roots = cut_lineage(connected_components(links, "a", "b"))
    rest = _possible(_pairs_left(shared.select("node", "token", size("packed").cast("int").alias("size"), left("packed").cast("int").alias("left")), roots, items), items)
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_similar(rest, texts))


def _may_reach(size_x: Column, size_y: Column, left_x: Column, left_y: Column) -> Column:
    """Whether two texts can overlap by SIMILARITY if the shingle from which on they have so
    many left is the first that they share."""
    return F.least(left_x, left_y) * (1 + SIMILARITY) >= SIMILARITY * (size_x + size_y) - 1e-6


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """node, doc_id, rows, keep for each distinct text: its smallest id, its number of rows, and
    whether that id is the smallest of its class of near copies. node is a 64-bit hash of the
    text.

    Near copies are texts whose sets of shingles of SHINGLE words have SIMILARITY or more
    of their union in common; all such pairs are found, whatever their fingerprints. Only texts
    of more than one row are shuffled, to have them once.
    """
    node = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    texts = docs.select(node.alias("node"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    firsts = cut_lineage(texts.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first"), F.count(F.lit(1)).alias("rows")))
    texts = texts.select("node", "text")
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(texts))
    copied = key_filter(firsts.where("rows > 1"), "node")
    again = may_be_in(texts, "node", copied).groupBy("node").agg(F.first("text").alias("text"))
    once = may_be_in(texts, "node", copied, False).unionByName(again)
    prints = cut_lineage(once.select("node", fingerprint(F.col("text"), SHINGLE).alias("fingerprint"), outline(F.col("text"), SHINGLE, common).alias("o")).select("node", "fingerprint", "o.*"))
    roots = connected_components(near_links(texts, prints), "a", "b")
    classes = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = classes.groupBy("root").agg(F.min(F.struct("first", "node")).alias("best"))
    return classes.join(best, "root").select("node", F.col("first.doc_id").alias("doc_id"), "rows", (F.col("node") == F.col("best.node")).alias("keep"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with one row of each class of exact and near copies: the one of
    smallest id. Of rows that share text and that id any one stays.

    A row stays without a shuffle if its text has no other row and is kept."""
    own = F.coalesce(F.col(doc_id).cast("string"), F.lit("-"))
    node = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    found = cut_lineage(near_copies(docs, doc_id, text))
    kept = found.where("keep").select(F.col("node").alias("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("own"))
    unsure = key_filter(found.where("rows > 1 or not keep"), "node")
    rows = docs.select(node.alias("key"), own.alias("own"), F.struct("*").alias("row"))
    # by text and id, not by text alone: copies of one text are dealt to many tasks
    some = may_be_in(rows, "key", unsure).join(kept, ["key", "own"], "left_semi").dropDuplicates(["key", "own"])
    return may_be_in(rows, "key", unsure, False).unionByName(some).select("row.*")
