"""Large objects: description, growth, ordering, content and prefix indexes, extents."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of the prefix in a description, of a partial load, of a prefix index key, and the
#: largest value that stays in its row.
HEAD, PARTIAL, PREFIX, IN_ROW = 32, 4096, 1024, 1276
#: Extent tiers come in levels of eight.
LEVEL, TIERS = 8, 120


def content(column: str) -> Column:
    return F.col(column).cast("binary")


def digest(column: str) -> Column:
    return F.sha2(content(column), 256)


def describe(blobs: DataFrame, key: str, column: str) -> DataFrame:
    """key, prefix (hexadecimal), size, sha256 of each value; empty values are none."""
    size = F.octet_length(content(column))
    rows = blobs.where(size > 0)
    return rows.select(key, F.hex(F.substring(content(column), 1, HEAD)).alias("prefix"), size.cast("long").alias("size"), digest(column).alias("sha256"))


def load(column: str, partial: bool = True) -> Column:
    return F.substring(content(column), 1, PARTIAL) if partial else content(column)


def read_range(column: str, offset: Column, size: Column) -> Column:
    """``size`` bytes from an offset on; NULL when the offset lies past the end."""
    value = content(column)
    return F.when(offset <= F.octet_length(value), F.substring(value, (offset + 1).cast("int"), size.cast("int")))


def append(chunks: DataFrame, key: Sequence[str], order: Sequence[str], column: str, separator: str = "") -> DataFrame:
    """Each key's chunks in order as one value: repeated growth as one aggregate."""
    queue = F.array_sort(F.collect_list(F.struct(*order, column)))
    joined = F.array_join(F.transform(queue, lambda c: c[column]), separator)
    return chunks.groupBy(*key).agg(joined.alias("content"), F.count(F.lit(1)).alias("appends"))


def grow(blobs: DataFrame, chunks: DataFrame, key: str, column: str, chunk: str) -> DataFrame:
    """blobs whose value is followed by the chunk of the same key, and its new digest."""
    joined = blobs.join(chunks.select(key, F.col(chunk).alias("__more")), key, "left")
    grown = F.concat(F.col(column), F.coalesce(F.col("__more"), F.lit("")))
    return joined.withColumn(column, grown).drop("__more").withColumn("sha256", digest(column))


def rank_by_content(blobs: DataFrame, group: Sequence[str], column: str, tie: str, name: str = "rank") -> DataFrame:
    """Place of each value in the unsigned byte order of its group; shorter ones first."""
    order = W.partitionBy(*group).orderBy(content(column), tie)
    return blobs.withColumn(name, F.row_number().over(order))


def content_index(blobs: DataFrame, key: str, column: str) -> DataFrame:
    """sha256 -> the smallest key with that content, and how many have it."""
    return blobs.groupBy(digest(column).alias("sha256")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def look_up_content(probes: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """Probes with the key of their content; probes without one are left out."""
    return probes.withColumn("sha256", digest(column)).join(index, "sha256")


def duplicates(blobs: DataFrame, key: str, column: str) -> DataFrame:
    """key, first: rows whose content was there before under a smaller key.

    Counts come first, so that only digests with copies meet their rows again.
    """
    digests = blobs.select(key, digest(column).alias("sha256"))
    firsts = digests.groupBy("sha256").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return digests.join(firsts, "sha256").where(F.col(key) > F.col("first")).select(key, "first")


def prefix_key(column: str) -> list[Column]:
    size = F.least(F.octet_length(content(column)), F.lit(PREFIX)).alias("prefix_length")
    return [size, F.substring(content(column), 1, PREFIX).alias("prefix")]


def prefix_index(blobs: DataFrame, key: str, column: str) -> DataFrame:
    """prefix_length, prefix -> smallest key and its digest, and how many were rejected."""
    first = F.min(F.struct(F.col(key), digest(column).alias("sha256"))).alias("first")
    return blobs.groupBy(*prefix_key(column)).agg(first, (F.count(F.lit(1)) - 1).alias("rejected")).select(
        "prefix_length", "prefix", F.col(f"first.{key}").alias(key), "first.sha256", "rejected"
    )


def look_up_prefix(probes: DataFrame, index: DataFrame, key: str, column: str, hit: str = "hit") -> DataFrame:
    """key, hit (NULL: not found) for each probe: the prefix must be there, and for longer
    values the digest must agree too."""
    size = F.octet_length(content(column))
    asked = probes.select(F.col(key).alias("__k"), size.alias("__n"), digest(column).alias("__d"), *prefix_key(column))
    joined = asked.join(index.select("prefix_length", "prefix", F.col(key).alias("__hit"), "sha256"), ["prefix_length", "prefix"], "left")
    verified = F.when((F.col("__n") <= PREFIX) | (F.col("__d") == F.col("sha256")), F.col("__hit"))
    return joined.select(F.col("__k").alias(key), verified.alias(hit))


def placement(column: str, limit: int = IN_ROW) -> Column:
    return F.when(F.octet_length(content(column)) > limit, "offrow").otherwise("inrow")


def tier_sizes(count: int = TIERS) -> list[int]:
    """Pages of each extent tier: within level n sizes go from (n + 1)**8 up by the factor
    (n + 2) / (n + 1), which is a whole number at each step."""
    levels = (divmod(tier, LEVEL) for tier in range(count))
    return [(n + 1) ** (LEVEL - i) * (n + 2) ** i for n, i in levels]


def tier_table(spark, count: int = TIERS) -> DataFrame:
    """tier, size_pages, low, cumulative_pages: pages (low, cumulative] need tier + 1 extents."""
    rows, total = [], 0
    for tier, size in enumerate(tier_sizes(count)):
        rows.append((tier, size, total, total + size))
        total += size
    return spark.createDataFrame(rows, "tier int, size_pages long, low long, cumulative_pages long")


def extent_count(pages: Column, count: int = TIERS) -> Column:
    """How many extents, from the first tier on, hold so many pages: 1 for none. A chain of
    comparisons that ends at the first tier that suffices; NULL beyond the last one."""
    chain, total = F, 0
    for tier, size in enumerate(tier_sizes(count)):
        total += size
        chain = chain.when(pages <= total, tier + 1)
    return chain.cast("long")


def tail_split(pages: Column, count: int = TIERS) -> Column:
    """array<int>: the tiers, largest first, that add up to so many pages."""
    tiers = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).cast("long").alias("s")) for t, s in reversed(list(enumerate(tier_sizes(count))))])
    start = F.struct(pages.cast("long").alias("rest"), F.array().cast("array<int>").alias("out"))

    def step(acc, tier):
        times = F.floor(acc["rest"] / tier["s"]).cast("int")
        return F.struct((acc["rest"] - times * tier["s"]).alias("rest"), F.concat(acc["out"], F.array_repeat(tier["t"], times)).alias("out"))

    return F.aggregate(tiers, start, step)["out"]


def compressed_size(column: str, level: int = 1, block: int = 4096) -> Column:
    """Bytes of a value compressed by zlib, and those of the whole blocks that hold them.
    No built-in function compresses, so this goes through Arrow batches."""

    @F.arrow_udf("struct<bytes:bigint,stored:bigint>")
    def measure(values: pa.Array) -> pa.Array:
        sizes = [None if v.as_py() is None else len(zlib.compress(v.as_py(), level)) for v in values]
        whole = [None if s is None else -(-s // block) * block for s in sizes]
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(whole, pa.int64())], ["bytes", "stored"])

    return measure(content(column))
