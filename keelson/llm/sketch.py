"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions.

A sketch keeps every shingle hash in the lowest ``1 / SCALE`` of the hash range, and at
least the ``FLOOR`` lowest ones, so that short texts have something to compare. The kept
hashes of two sketches are comparable up to the lower of the two ranges that they cover
completely; sketches of parts merge into the sketch of the whole by keeping the union's
low hashes. The containment of a text in another is the share of its sketch that the other
one holds, which stays meaningful between a note and a book.

The next document in descending id order is found without a task that sorts more than its
share: ids alone (as 128-bit keys of id and text) are dealt to ranges, each range is ordered
by one task, and the last id of a range is followed by the first one of the next range. A
text is then shuffled once, to its key; what goes from a document to the one before it is its
sketch and as much of its text as that one takes.

Defined results: null and empty texts have an empty sketch; two empty sketches are alike
(1.0), and where the covered range holds nothing of the first text the result is 0.0; equal
texts have equal sketches; ids are ordered as their type orders them, null ids come last;
rows that share an id follow each other in an order of their own by a hash of the text,
rows that share both one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm.common import GAP, cut_lineage

SHINGLE = 5
SCALE = 8
FLOOR = 16
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
THRESHOLD = LOWEST + (1 << 64) // SCALE


def words_of(text: Column) -> Column:
    """The words of a text in reading order, in lower case; null and blank texts have none."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed != "", F.split(trimmed, GAP)).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """A 64-bit hash of each run of ``size`` words; fewer words make one shingle."""
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)])
    last = F.greatest(F.size(words) - size, F.lit(0))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<bigint>"))


def sketch_of_hashes(hashes: Column, floor: int = FLOOR) -> Column:
    """Sorted distinct hashes below the threshold, or the ``floor`` lowest if those are more;
    0 is a pure threshold."""
    low = F.array_distinct(F.filter(hashes, lambda h: h < F.lit(THRESHOLD)))
    few = F.slice(F.array_sort(F.array_distinct(hashes)), 1, floor)
    return F.when(F.size(low) >= floor, F.array_sort(low)).otherwise(few)


def sketch_texts(rows: DataFrame, text: str, into: str, floor: int = FLOOR) -> DataFrame:
    """rows with the column ``into`` (array<bigint>): the sketch of a text column."""
    words = rows.withColumn("__words", words_of(F.col(text)))
    hashed = words.withColumn("__hashes", shingle_hashes(F.col("__words"))).drop("__words")
    return hashed.withColumn(into, sketch_of_hashes(F.col("__hashes"), floor)).drop("__hashes")


def merge(a: Column, b: Column, floor: int = FLOOR) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    return sketch_of_hashes(F.concat(a, b), floor)


def covered(sketch: Column, floor: int = FLOOR) -> Column:
    """Up to where a sketch holds every hash of its text."""
    top = F.get(sketch, F.size(sketch) - 1)
    return F.when(F.size(sketch) < floor, F.lit(HIGHEST)).otherwise(F.greatest(top, F.lit(THRESHOLD - 1)))


def containment(a: Column, b: Column, floor: int = FLOOR) -> Column:
    """0 to 1: the share of a's sketch that b's holds too, within what both cover."""
    limit = F.least(covered(a, floor), covered(b, floor))
    own = F.filter(a, lambda h: h <= limit)
    share = F.size(F.array_intersect(own, b)) / F.size(own)
    both = F.greatest(F.size(a), F.size(b)) == 0
    return F.when(both, F.lit(1.0)).when(F.size(own) == 0, F.lit(0.0)).otherwise(share)


def shown(sketch: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def next_keys(keys: DataFrame) -> DataFrame:
    """k1, k2, third, n1, n2: each key with the one that follows it in descending order of id,
    the first one for the last. ``keys`` has doc_id, k1, k2, third, one row for each key."""
    order = [F.col("doc_id").desc_nulls_last(), "k1", "k2"]
    ranged = cut_lineage(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = W.partitionBy("part").orderBy(*order)
    here = F.struct("k1", "k2")
    placed = ranged.select("part", "k1", "k2", "third", F.lead(here).over(inside).alias("lead"), F.row_number().over(inside).alias("place"))
    heads = placed.where("place = 1").select("part", here.alias("head"))  # one row for each range
    whole = W.orderBy("part")
    after = heads.select("part", F.coalesce(F.lead("head").over(whole), F.first("head").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    following = F.coalesce("lead", "after")
    return placed.join(after, "part").select("k1", "k2", "third", following["k1"].alias("n1"), following["k2"].alias("n2"))


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of its code points replaced by the first as many of
    the next document's.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = named.select("doc_id", "text", *[F.xxhash64(F.lit(salt), "doc_id", "text").alias(k) for salt, k in ((1, "k1"), (2, "k2"))])
    third = F.expr("char_length(text) div 3").cast("int")
    order = cut_lineage(next_keys(rows.select("doc_id", "k1", "k2", third.alias("third")).distinct()))
    # both uses of the held texts name all their columns, so that one shuffle serves both
    held = sketch_texts(rows, "text", "own").groupBy("k1", "k2").agg(F.first(F.struct("doc_id", "text", "own")).alias("doc"), F.count(F.lit(1)).alias("times"))
    wanted = order.select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "third")
    head = F.substring("doc.text", F.lit(1), F.col("third")).alias("head")
    given = held.join(wanted, ["k1", "k2"]).where("times > 0").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.struct(head, "doc.own").alias("next"))
    paired = held.join(given, ["k1", "k2"]).select("doc.*", "times", "next").withColumn("n_chars", F.char_length("text")).withColumn("third", third)
    last = F.struct("next", F.lit(1).cast("long").alias("times"))
    others = F.struct(F.struct(F.substring("text", F.lit(1), F.col("third")).alias("head"), "own").alias("next"), (F.col("times") - 1).alias("times"))
    each = paired.select("doc_id", "text", "own", "n_chars", "third", F.explode(F.when(F.col("times") > 1, F.array(last, others)).otherwise(F.array(last))).alias("case"))
    kept = F.substring("text", F.lit(1), F.col("n_chars") - F.col("third"))
    edited = each.withColumn("edited", F.concat(kept, F.col("case.next.head")))
    edited = sketch_texts(edited, "edited", "changed")
    shaped = edited.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"),
        containment(F.col("own"), F.col("changed")).alias("near_edited"), containment(F.col("own"), F.col("case.next.own")).alias("near_next"),
        F.col("case.times").alias("times"),
    )
    return shaped.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("time", "times")
