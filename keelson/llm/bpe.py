"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is merged with a queue that has one bucket for each merge rank. A bucket
holds positions in the pre-token's linked list of symbols, a two-level bitmap marks the
ranks whose bucket is in use, and find-first-set on each level gives the lowest one. Entries
whose pair has changed since are stale and are skipped when met. The cost is O(n log n) for a
pre-token of n bytes, so a run of a million letters is no special case.

Defined results: a null or empty text has no tokens; equal rows give equal rows; columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import worker_model

#: A rank file has at most this many bytes; what is broadcast is checked against it.
MAX_RANK_FILE = 64 << 20
#: Chunks and pre-tokens that a worker remembers in each of two generations, about 200 bytes
#: each: for a pass that does nothing else, and beside other work.
CACHE_ENTRIES, SMALL_CACHE = 650_000, 60_000
#: Unicode's White_Space, as \s means in the pattern.
SPACE = "\t-\r \x85\xa0  -     　"
#: Pre-tokens of PATTERN never cross from such a chunk to the next one, and letters alone are
#: one of them; with another pattern a text is not cut into chunks.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def load_ranks(path: str) -> bytes:
    """The rank file's bytes (base64 token, space, rank on each line), size checked."""
    with open(path, "rb") as file:
        raw = file.read(MAX_RANK_FILE + 1)
    if len(raw) > MAX_RANK_FILE:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE} bytes")
    return raw


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in raw.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Codec:
    """Encodes and decodes with one rank table. A worker keeps one."""

    def __init__(self, raw: bytes, pattern: str, entries: int = SMALL_CACHE):
        self.ranks = parse_ranks(raw)
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.chunks = CHUNK.findall if pattern == PATTERN else None
        # a level of the bitmap has words of 256 bits
        self.low = [0] * ((max(self.ranks.values(), default=0) >> 8) + 1)
        self.bit = [1 << i for i in range(max(256, len(self.low)))]
        self.known = _Remembered(self._spell_chunk, entries)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. Symbol i spans piece[i:following[i]].

        ``low[w]`` has a bit for each rank from 256*w on whose bucket is in use, ``top`` a
        bit for each word of ``low`` that isn't 0; all are 0 again at the end.
        """
        ranks, low, bit, size = self.ranks, self.low, self.bit, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        following, previous = list(range(1, size + 1)), list(range(-1, size))
        pair, buckets, top = [-1] * (size + 1), {}, 0
        for i in range(size - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    low[rank >> 8] |= bit[rank & 255]
                    top |= bit[rank >> 8]
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = (word << 8) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            while bucket:
                i = heappop(bucket)
                if pair[i] != rank:  # stale
                    continue
                gone = following[i]
                after = following[gone]
                before = previous[i]
                following[i], previous[after], pair[gone], pair[i] = after, i, -1, -1
                lowest = rank
                if after < size:
                    new = ranks.get(piece[i : following[after]])
                    if new is not None:
                        pair[i] = new
                        if new < lowest:
                            lowest = new
                        if new in buckets:
                            heappush(buckets[new], i)
                        else:
                            buckets[new] = [i]
                            low[new >> 8] |= bit[new & 255]
                            top |= bit[new >> 8]
                if before >= 0:
                    new = ranks.get(piece[before:after])
                    if new is None:
                        pair[before] = -1
                    elif pair[before] != new:
                        pair[before] = new
                        if new < lowest:
                            lowest = new
                        if new in buckets:
                            heappush(buckets[new], before)
                        else:
                            buckets[new] = [before]
                            low[new >> 8] |= bit[new & 255]
                            top |= bit[new >> 8]
                if lowest < rank:  # a merge can open a lower rank
                    break
            if not bucket:
                del buckets[rank]
                low[word] ^= bit[rank & 255]
                if not low[word]:
                    top ^= bit[word]
        ids, i = [], 0
        while i < size:
            ids.append(ranks[piece[i : following[i]]])
            i = following[i]
        return ids

    def _spell_chunk(self, chunk: str) -> str:
        """Ids of a chunk: a space at most, then no white space; or white space only. One of
        letters alone is one pre-token, which saves the pattern's work. Where there are no
        chunks, of one pre-token."""
        if self.chunks is None:
            return " ".join(map(str, self.merge(chunk.encode())))
        body = chunk[1:] if chunk[0] == " " else chunk
        parts = [chunk] if body.isalpha() else self.split(chunk)
        if len(parts) > 1:
            return " ".join(map(self.known.__getitem__, parts))
        return " ".join(map(str, self.merge(chunk.encode())))

    def spell(self, text: str) -> str:
        """The ids of a text in decimal, joined by one space."""
        if self.chunks is None:
            pieces = (m.group() for m in self.pattern.finditer(text) if m.group())
            return " ".join(map(self.known.__getitem__, pieces))
        return " ".join(map(self.known.__getitem__, self.chunks(text)))

    def encode(self, text: str) -> list[int]:
        spelled = self.spell(text)
        return list(map(int, spelled.split(" "))) if spelled else []

    @cached_property
    def token_bytes(self) -> dict[int, bytes]:
        return {rank: token for token, rank in self.ranks.items()}

    @cached_property
    def spelled(self) -> dict[str, bytes]:
        return {str(rank): token for token, rank in self.ranks.items()}

    def decode_spelled(self, spelled: str) -> bytes:
        return b"".join(map(self.spelled.__getitem__, spelled.split(" "))) if spelled else b""

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


class _Remembered(dict):
    """A bounded memory of a function of a string: two generations, no long strings."""

    def __init__(self, compute, entries: int):
        super().__init__()
        self.compute, self.entries, self.older = compute, entries, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 48:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def _share(spark: SparkSession, rank_path: str, pattern: str, entries: int = SMALL_CACHE):
    """A function for tasks that gives the worker's codec of this table and pattern."""
    raw = load_ranks(rank_path)
    key, shared = (hashlib.sha256(raw).hexdigest(), pattern, entries), spark.sparkContext.broadcast(raw)
    return lambda: worker_model(key, lambda: Codec(shared.value, pattern, entries))


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """docs with the column ``into`` (array<int>): the ids of the text."""
    own_codec = _share(docs.sparkSession, rank_path, pattern)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = own_codec()
        for batch in batches:
            parts = [np.fromstring(codec.spell(x.as_py() or ""), np.int32, sep=" ") for x in batch]
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return docs.withColumn(into, encode(F.col(text)))


def decode_ids(rows: DataFrame, rank_path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """rows with the column ``into`` (binary): the bytes that the ids stand for. Null ids
    decode to null; an id outside the table fails the query."""
    own_codec = _share(rows.sparkSession, rank_path, "")

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = own_codec()
        for batch in batches:
            yield pa.array([None if x is None else codec.decode(x) for x in batch.to_pylist()], pa.binary())

    return rows.withColumn(into, decode(F.col(ids)))


def round_trip_digests(docs: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row: encoded, then decoded.

    Ids stay inside the task; only digests leave it, so no shuffle and no wide column.
    """
    own_codec = _share(docs.sparkSession, rank_path, pattern, CACHE_ENTRIES)
    kind = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"

    @F.arrow_udf(kind)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = own_codec()
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            counts, ids, decoded = [], [], []
            for value in batch:
                spelled = codec.spell(value.as_py() or "")
                counts.append(spelled.count(" ") + 1 if spelled else 0)
                ids.append(sha(spelled.encode()))
                decoded.append(sha(codec.decode_spelled(spelled)))
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("r")).select("doc_id", "r.*")
