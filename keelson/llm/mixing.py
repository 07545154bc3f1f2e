"""Mixing sources to target weights with a low-discrepancy schedule.

Slot t of the schedule takes the fractional part of (t + 1) times the golden ratio's
inverse through the cumulative weights of the sources, which names a source for each slot;
any stretch of slots holds each source nearly in proportion. Slots are ranked within their
source, and rank r takes the r-th block of that source: its documents, shuffled by a keyed
hash, laid end to end and cut into blocks of ``BLOCK`` words, again from the front when
they end. A source's last slot is cut where its target is met, so a source takes its target
to within one word.

The schedule is made by counting slots in runs of ``RUN``, so ranks need no global sort; a
document's place in its source comes from sums over runs of documents, not from one window
over a source, so a source with a third of all rows is spread over many tasks.

Defined results: a null text has size 0 and is never taken; a source of size 0 has target
0; null is a source of its own and comes last; equal rows are distinct documents; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm.common import WORD, cut_lineage, word_count

BLOCK = 1024
#: Slots in a run of the schedule, and documents in a run of a source, on average.
RUN, DOCS_IN_RUN = 1 << 16, 1000
#: Sources come to the driver with one number each; more than this is an error.
MAX_SOURCES = 100_000
MAX_PASSES = 3
#: 2**64 over the golden ratio, made odd: multiplication by it visits the points in turn.
GOLDEN = 0x9E3779B97F4A7C15


@dataclass
class Source:
    name: str | None
    size: int
    weight: float
    target: float = 0.0

    @property
    def words(self) -> int:
        """Whole words that the mix takes of it."""
        return min(int(math.floor(self.target + 0.5)), MAX_PASSES * self.size)

    @property
    def slots(self) -> int:
        """Slots that hold so many words, when each pass over the source ends in a short block."""
        if not self.size:
            return 0
        passes, rest = divmod(self.words, self.size)
        return passes * -(-self.size // BLOCK) + -(-rest // BLOCK)


def set_targets(sources: list[Source]) -> list[Source]:
    """Shares all sizes by weight; a source stops at MAX_PASSES times its size and what it
    can't take is shared again among the others."""
    free, rest = [s for s in sources if s.size], float(sum(s.size for s in sources))
    while free:
        total = sum(s.weight for s in free)
        full = [s for s in free if rest * s.weight / total > MAX_PASSES * s.size]
        if not full:
            for s in free:
                s.target = rest * s.weight / total
            break
        for s in full:
            s.target = float(MAX_PASSES * s.size)
            rest -= s.target
        free = [s for s in free if not s.target]
    return sources


def cyclic_weights(count: int) -> list[float]:
    return [1.0 + i % 3 for i in range(count)]


def find_sources(sized: DataFrame, weights=cyclic_weights) -> list[Source]:
    """The sources by code point, null last, with sizes, weights and targets."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    given = weights(len(rows))
    return set_targets([Source(r.source, int(r["size"]), w) for r, w in zip(rows, given)])


def schedule(spark, sources: list[Source], parts: int | None = None) -> DataFrame:
    """slot, source_no, rank: the slots in order, each with its rank within its source.

    Beyond the slots that a source needs, its weight has room for the discrepancy of the
    golden-ratio points, so that every source finds its slots; superfluous ranks are left
    out. ``parts`` is the number of tasks, by default one for each run.
    """
    needed = np.array([s.slots for s in sources], np.int64)
    total = int(needed.sum())
    spare = 2 * math.ceil(3 + 1.5 * math.log(total + len(sources) + 2))
    room = np.where(needed > 0, needed + spare, 0)
    edges = np.concatenate([[0.0], np.cumsum(room)]) / max(int(room.sum()), 1)
    slots = int(room.sum())
    runs = -(-slots // RUN)

    def source_of(slot: np.ndarray) -> np.ndarray:
        point = ((slot.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN) >> np.uint64(11)).astype(np.float64) / 2.0**53
        return np.minimum(np.searchsorted(edges, point, side="right") - 1, len(room) - 1)

    def slots_of(run: int) -> np.ndarray:
        return np.arange(run * RUN, min((run + 1) * RUN, slots), dtype=np.int64)

    def count(batches):
        for batch in batches:
            for run in batch.column(0).to_pylist():
                number = np.bincount(source_of(slots_of(run)), minlength=len(room))
                have = np.flatnonzero(number)
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(have), pa.int64()), pa.array(have, pa.int32()), pa.array(number[have], pa.int64())], ["run", "source_no", "n"])

    def rank(batches):
        for batch in batches:
            for run, numbers, starts in zip(*(c.to_pylist() for c in batch.columns)):
                slot = slots_of(run)
                source = source_of(slot)
                base = np.zeros(len(room), np.int64)
                base[numbers] = starts
                order = np.argsort(source, kind="stable")
                first = np.searchsorted(source[order], source[order])
                place = np.empty(len(slot), np.int64)
                place[order] = np.arange(len(slot)) - first
                place += base[source]
                kept = place < needed[source]
                yield pa.RecordBatch.from_arrays([pa.array(slot[kept]), pa.array(source[kept], pa.int32()), pa.array(place[kept])], ["slot", "source_no", "rank"])

    ids = spark.range(0, runs, 1, parts or max(1, runs))
    counts = ids.mapInArrow(count, "run long, source_no int, n long")
    before = W.partitionBy("source_no").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    runs_of = starts.groupBy("run").agg(F.collect_list("source_no"), F.collect_list("start"))
    return runs_of.mapInArrow(rank, "slot long, source_no int, rank long")


def _numbered(spark, sources: list[Source]) -> DataFrame:
    kind = "source string, source_no int, source_size long, target double, words long"
    rows = [(s.name, i, s.size, s.target, s.words) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, kind)


def place_documents(sized: DataFrame, sources: list[Source], seed: int) -> DataFrame:
    """sized (key, copy, doc_id, source, size) with source_no, source_size, target, words, and
    ``first``: how many words of its source come before the document."""
    spark = sized.sparkSession
    table = F.broadcast(_numbered(spark, sources))
    known = sized.join(table, sized["source"].eqNullSafe(table["source"])).drop(table["source"])
    runs = sized.count() // DOCS_IN_RUN + 1
    mixed = F.xxhash64(F.lit(seed), "key", "copy")
    shuffled = known.withColumn("mixed", mixed).withColumn("run", F.pmod(F.shiftrightunsigned("mixed", 20), F.lit(runs)))
    inside = W.partitionBy("source_no", "run").orderBy("mixed", "key", "copy").rowsBetween(W.unboundedPreceding, -1)
    sums = shuffled.groupBy("source_no", "run").agg(F.sum("size").alias("n"))
    across = W.partitionBy("source_no").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("source_no", "run", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base"))
    local = shuffled.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.join(bases, ["source_no", "run"]).withColumn("first", F.col("base") + F.col("local")).drop("mixed", "run", "local", "base")


def take_blocks(spark, sources: list[Source]) -> DataFrame:
    """source_no, block, slot, pass_no, used: each slot's block and how many of its words,
    from the front, the mix takes."""
    blocks_in = F.ceil(F.col("source_size") / BLOCK)
    table = F.broadcast(_numbered(spark, sources).drop("source"))
    slots = schedule(spark, sources).join(table, "source_no")
    slots = slots.withColumn("pass_no", F.expr("rank").cast("long") - F.pmod("rank", blocks_in))
    slots = slots.withColumn("pass_no", (F.col("pass_no") / blocks_in).cast("long")).withColumn("block", F.pmod("rank", blocks_in))
    length = F.least(F.lit(BLOCK), F.col("source_size") - F.col("block") * BLOCK)
    done = F.col("pass_no") * F.col("source_size") + F.col("block") * BLOCK
    used = F.least(length, F.col("words") - done)
    return slots.select("source_no", "block", "slot", "pass_no", used.alias("used")).where("used > 0")


def mix_pieces(placed: DataFrame, sources: list[Source]) -> DataFrame:
    """key, copy, slot, pass_no, start, length: the words that each slot takes of a document.

    A document meets the blocks that its words fall in; a block meets its slots (one for
    each pass). Pieces of one document in one pass follow each other without gaps.
    """
    spark = placed.sparkSession
    last = F.col("first") + F.col("size")
    span = placed.where("size > 0").select("key", "copy", "source_no", "first", last.alias("last"), F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"(first + size - 1) div {BLOCK}"))).alias("block"))
    met = span.join(take_blocks(spark, sources), ["source_no", "block"])
    start = F.greatest(F.col("first"), F.col("block") * BLOCK)
    end = F.least(F.col("last"), F.col("block") * BLOCK + F.col("used"))
    return met.where(end > start).select("key", "copy", "slot", "pass_no", (start - F.col("first")).alias("start"), (end - start).alias("length"))


def word_range(text: Column, start: Column, length: Column) -> Column:
    """The part of a text from its word number ``start`` on, ``length`` words long."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, starts: pa.Array, lengths: pa.Array) -> pa.Array:
        out = []
        for value, a, n in zip(texts, starts.to_pylist(), lengths.to_pylist()):
            words = islice(re.finditer(WORD, value.as_py() or ""), a, a + n)
            spans = [m.span() for m in words]
            out.append(value.as_py()[spans[0][0] : spans[-1][1]] if spans else None)
        return pa.array(out, pa.string())

    return cut(text, start, length)


def _content_key() -> Column:
    """Tells documents apart by id, source and text, in any evaluation of the same rows."""
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), F.coalesce(F.col("source"), F.lit("\x00")), F.coalesce(F.col("text"), F.lit(""))]
    return F.md5(F.concat_ws("\x1f", *parts).cast("binary"))


def size_documents(docs: DataFrame) -> DataFrame:
    """key, copy, doc_id, source, size for each row of docs; equal rows are counted before
    they are dealt out and differ in copy."""
    rows = docs.select(_content_key().alias("key"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    units = cut_lineage(rows.groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return units.select("key", copies, "doc_id", "source", "size")


def mix_report(docs: DataFrame, seed: int = 20240501) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    sized = size_documents(docs)
    sources = find_sources(sized)
    placed = place_documents(sized, sources, seed)
    taken = mix_pieces(placed, sources).groupBy("key", "copy").agg(F.sum("length").alias("taken"))
    full = placed.join(taken, ["key", "copy"], "left")
    return full.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 20240501) -> DataFrame:
    """The mix as documents, all columns of docs: a row for each document and pass, its
    text cut to the words taken where a source's last slot ends inside it. n_chars, where
    docs has it, is the length of the text returned. Rows that share id, source and text take
    their other columns from one of them."""
    sized = size_documents(docs)
    sources = find_sources(sized)
    pieces = mix_pieces(place_documents(sized, sources, seed), sources)
    passes = pieces.groupBy("key", "copy", "pass_no").agg(F.min("start").alias("start"), F.sum("length").alias("length"))
    texts = docs.select(F.struct("*").alias("row"), _content_key().alias("key"), word_count(F.col("text")).alias("size"))
    rows = texts.dropDuplicates(["key"]).join(passes, "key")
    part = (F.col("start") > 0) | (F.col("length") < F.col("size"))
    cut = word_range(F.when(part, F.col("row.text")), F.col("start"), F.col("length"))
    text = F.when(part, cut).otherwise(F.col("row.text"))
    made = rows.select("row", text.alias("text"))
    return made.select(*[
        F.col("text").alias(c) if c == "text" else F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ])
