"""What several operators share: reading a table, checkpoints, word batches."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in all word-based contracts (ASCII only).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (single-machine tests) a temporary one is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder.

    Recomputing after a lost executor then starts from these files, and a costly column is
    computed once for all readers.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def in_tasks(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df in no more partitions than its number of rows asks for, so that a small table
    doesn't go through a shuffle in hundreds of nearly empty files."""
    return df.coalesce(rows // each + 1)


#: Bits of a filter of keys: 4 MB, whatever the number of keys.
FILTER_BITS = 1 << 25


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(37), key), F.lit(FILTER_BITS)) + 1


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """The bits that keys' column ``key`` sets, in parts of 4 kB, for ``may_be_in``."""
    bits = keys.select(_bit(key).alias("bit"))
    return cut_lineage(bits.groupBy(F.bitmap_bucket_number("bit").alias("filter_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("filter_bits")))


def may_be_in(rows: DataFrame, key: str, held: DataFrame, wanted: bool = True) -> DataFrame:
    """The rows whose ``key`` may be one of a filter's keys, or, if not wanted, those whose key
    surely isn't: these needn't be shuffled to find that out.

    The more keys there are, the more rows with other keys pass as well, so a join follows.
    """
    place = F.bitmap_bit_position(_bit(key)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("filter_bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10)
    found = F.coalesce(F.getbit(byte.cast("int"), place % 8) == 1, F.lit(False))
    marked = rows.join(F.broadcast(held), F.bitmap_bucket_number(_bit(key)) == F.col("filter_part"), "left")
    return marked.where(found if wanted else ~found).select(*rows.columns)


#: Rows of a batch between the JVM and a Python worker, for whole texts beside large heaps.
BATCH_ROWS = 1000


def modest_batches(spark: SparkSession) -> None:
    """From now on no more than BATCH_ROWS rows go to a Python worker at once: both sides hold
    several copies of a batch of texts. It changes no result."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if not 0 < now <= BATCH_ROWS:  # 0 or less: no limit
        spark.conf.set(setting, BATCH_ROWS)


_HELD: list = [None, None]


def worker_model(key, build=lambda: None):
    """What a Python worker holds between tasks: one operator's model at a time.

    Asking with another key drops the last one, so that the operators of a long session
    don't add up in a worker; an operator without a model asks to free the memory.
    """
    if _HELD[0] != key:
        _HELD[:] = [None, None]
        pa.default_memory_pool().release_unused()
        _HELD[:] = [key, build()]
    return _HELD[1]


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo: the split that held-out contracts use."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(texts: pa.Array, most: int = 6 << 20):
    """(start, part) for consecutive parts of a batch with about ``most`` bytes of text or
    one text, so that what a task holds for a batch has a bound. Parts are copies: some
    Arrow functions misread the offsets of a slice."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, texts.take(pa.array(np.arange(start, stop)))
        start = stop


class WordBatch:
    """The words of a batch of texts, each distinct word held once.

    ``codes`` has a number for each word in reading order, ``bounds[i]:bounds[i+1]`` are
    those of text i, ``vocabulary`` the distinct words as an Arrow array.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        filled = pc.greater(pc.binary_length(flat), 0)
        kept = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
        self.bounds = kept[bounds - bounds[0]] if len(bounds) else np.zeros(1, np.int64)
        coded = flat.filter(filled).dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.vocabulary = coded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def sum_by_text(self, values: np.ndarray) -> np.ndarray:
        """Sum of one number for each word, for each text."""
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]
