"""Readers and writers for the formats that workloads come in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Explicit schemas of the workload files: nothing is inferred.
SCHEMAS = {
    "page_views": "page_len bigint, monthly_views int",
    "syscalls": "op string, fd int, size bigint, flags int",
    "keyed_text": "key bigint, text string",
    "articles": "text string",
    "metrics": "second timestamp, tx bigint, reads bigint, bytes double",
}
#: Fixed values of the trace format: the calls that count, what stands for the working
#: directory in a call, and the descriptor that it gets here.
TRACED = ("SYS_openat", "SYS_newfstatat", "SYS_close", "SYS_read", "SYS_write")
AT_WORKING_DIRECTORY, WORKING_DIRECTORY = "0xffffff9c", 100


def read_csv(spark: SparkSession, path: str, schema: str, *, trim: bool = True, comment: str | None = None, ignore_extra: bool = False, on_error: str = "FAILFAST", **options) -> DataFrame:
    """A CSV file with a header, columns matched by name.

    Extra columns are an error unless ``ignore_extra``; a value that doesn't fit its type
    fails the query, or (``on_error="PERMISSIVE"``) becomes NULL.
    """
    wanted = spark.createDataFrame([], schema).schema
    reader = spark.read.options(header=True, mode=on_error, ignoreLeadingWhiteSpace=trim, ignoreTrailingWhiteSpace=trim, **options)
    if comment:
        reader = reader.option("comment", comment)
    names = reader.csv(path).columns
    lacking, extra = [c for c in wanted.names if c not in names], [c for c in names if c not in wanted.names]
    if lacking or (extra and not ignore_extra):
        raise ValueError(f"columns of {path}: missing {lacking}, extra {extra}")
    whole = ", ".join(f"`{n}` {wanted[n].dataType.simpleString() if n in wanted.names else 'string'}" for n in names)
    return reader.schema(whole).csv(path).select(*wanted.names)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def call_parts(line: Column) -> dict[str, Column]:
    """op, args, result of a line ``name(arguments) = result``. The name ends at the first
    bracket, the result begins after the last equals sign, and the arguments end with the
    bracket before it; other lines have a null op."""
    op = F.substring_index(line, "(", 1)
    rest = F.substring(line, F.length(op) + 2, F.length(line))
    result = F.substring_index(rest, "=", -1)
    before = F.rtrim(F.substring(rest, F.lit(1), F.length(rest) - F.length(result) - 1))
    whole = line.contains("(") & rest.contains("=") & before.endswith(")")
    args = F.substring(before, F.lit(1), F.length(before) - 1)
    return {"op": F.when(whole, op), "args": F.trim(args), "result": F.trim(result)}


def parse_trace(lines: DataFrame, order: str, line: str) -> DataFrame:
    """op, fd, size, flags, merged of traced syscalls, in order; failed calls are left out.

    Consecutive reads, or writes, become one with the sum of their sizes (descriptors
    aren't compared, the first one stays). ``order`` numbers the lines of the trace.
    """
    from keelson.operators.running import merge_runs

    rows = lines.select(order, *[c.alias(n) for n, c in call_parts(F.col(line)).items()]).where(F.col("op").isin(*TRACED))
    rows = rows.withColumn("result", F.regexp_extract("result", r"^-?\d+", 0).cast("bigint")).where("result >= 0")
    args = F.split("args", r"\s*,\s*")
    number = lambda i: F.try_element_at(args, F.lit(i))
    whole = lambda c: F.when(c.startswith("0x"), F.conv(F.substring(c, 3, 16), 16, 10)).otherwise(c).cast("bigint")
    first = F.when(number(1) == AT_WORKING_DIRECTORY, F.lit(WORKING_DIRECTORY)).otherwise(whole(number(1)))
    moves = F.col("op").isin("SYS_read", "SYS_write")
    rows = rows.select(
        order, "op",
        F.when(F.col("op") == "SYS_openat", F.col("result")).otherwise(first).alias("fd"),
        F.when(moves, whole(number(-1))).otherwise(0).alias("size"),
        F.when(F.col("op") == "SYS_openat", whole(number(3))).when(F.col("op") == "SYS_newfstatat", whole(number(4))).otherwise(0).alias("flags"),
    )
    merged = merge_runs(rows, order, "op", "size", ["SYS_read", "SYS_write"])
    return merged.join(rows.select(order, "fd", "flags"), order)


def replay(trace: DataFrame, order: str, group: Sequence[str] = ()) -> DataFrame:
    """A trace with the key of the file that each row works on: files change at each close."""
    earlier = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    closes = F.sum((F.col("op") == "SYS_close").cast("long")).over(earlier)
    return trace.withColumn("file_key", F.coalesce(closes, F.lit(0)))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of each file: a relation keyed by path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def file_stat(files: DataFrame, names: DataFrame) -> DataFrame:
    """Asked names with the size of their file; NULL where there is none. Contents aren't read."""
    sizes = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return names.join(sizes, "name", "left")


def read_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A relational table over JDBC, read in ranges of its integer key."""
    ranges = {"partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **ranges, **options).load()


def write_relation(relation: DataFrame, path: str, keys: Sequence[str], parts: int) -> None:
    """A relation as files in key order, so that a range of keys touches few of them."""
    relation.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def append_trace(rows: DataFrame, path: str) -> None:
    """Rows of an I/O trace as CSV lines, after those already there."""
    rows.write.mode("append").csv(path)
