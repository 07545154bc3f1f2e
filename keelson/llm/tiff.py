"""Media columns: TIFF files read page by page, and texts stored losslessly as TIFF.

The reader walks the chain of image directories, decodes strips and tiles (stored,
PackBits, LZW, deflate), undoes the horizontal predictor and gives one row for each page.
The writer stores any payload as 8-bit grey samples, 64 to a row, on pages of at most 128
rows; pages take the four layouts of ``LAYOUTS`` in turn, so that reading back a long
payload goes through each codec.

Defined results: a null file has no page; a file that breaks the format has one row with
its ``error`` and no samples; a directory chain that loops ends where it closes; equal rows
give equal rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 64, 128, 64, 64
BLOCK = 64
#: Fixed values of the format: compression codes, and field types with their sizes.
STORED, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: "B", 3: "H", 4: "I"}
#: Code, tiled, predictor: the layout of page n is LAYOUTS[n % 4].
LAYOUTS = ((DEFLATE, False, 2), (PACKBITS, True, 1), (LZW, False, 2), (DEFLATE, True, 1))
#: A page may hold so many samples at most; larger claims are errors, not allocations.
MAX_SAMPLES = 1 << 28


@dataclass
class Page:
    number: int
    width: int
    height: int
    compression: int
    samples: bytes


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more bytes become repeats, the rest literals of at most 128."""
    out, done = bytearray(), 0

    def literals(end: int) -> None:
        for at in range(done, end, 128):
            piece = data[at : min(at + 128, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for run in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        literals(run.start())
        out.append(257 - (run.end() - run.start()))
        out.append(data[run.start()])
        done = run.end()
    literals(len(data))
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i = [], 0
    while i < len(data):
        head = data[i]
        if head < 128:
            out.append(data[i + 1 : i + 2 + head])
            i += head + 2
        elif head > 128:
            out.append(data[i + 1 : i + 2] * (257 - head))
            i += 2
        else:
            i += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widened one code early as TIFF asks."""
    bits, used = 256, 9  # the clear code opens the stream
    table: dict[bytes, int] = {bytes([i]): i for i in range(256)}
    width, following, prefix = 9, 258, b""
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        bits, used = bits << width | table[prefix], used + width
        table[longer] = following
        following += 1
        if following == 4095:
            bits, used = bits << width | 256, used + width
            table = {bytes([j]): j for j in range(256)}
            width, following = 9, 258
        elif following + 1 > 1 << width:
            width += 1
        prefix = data[i : i + 1]
    if prefix:
        bits, used = bits << width | table[prefix], used + width
        if following + 2 > 1 << width and width < 12:
            width += 1
    bits, used = bits << width | 257, used + width
    return (bits << -used % 8).to_bytes((used + 7) // 8, "big")


def lzw_decode(data: bytes) -> bytes:
    out: list[bytes] = []
    table, width, before, at, held, bits = [], 9, b"", 0, 0, 0
    while True:
        while held < width:
            if at == len(data):
                return b"".join(out)
            bits = (bits & (1 << held) - 1) << 8 | data[at]
            at, held = at + 1, held + 8
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            return b"".join(out)
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise ValueError("LZW code outside the table")
        out.append(entry)
        if before:
            table.append(before + entry[:1])
        before = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1


def _pack(kind: int, data: bytes) -> bytes:
    if kind == PACKBITS:
        return packbits_encode(data)
    return lzw_encode(data) if kind == LZW else zlib.compress(data, 6)


def _unpack(kind: int, data: bytes, size: int) -> bytes:
    if kind == STORED:
        return data[:size]
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if kind == PACKBITS:
        return packbits_decode(data)[:size]
    if kind == LZW:
        return lzw_decode(data)[:size]
    raise ValueError(f"compression {kind} is not supported")


def write_tiff(payload: bytes, layouts=LAYOUTS) -> bytes:
    """A little-endian TIFF of a payload whose length is a positive multiple of 64."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("a payload has a positive multiple of 64 bytes")
    out = bytearray(b"II*\0\0\0\0\0")
    link, grid = 4, np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    for number, top in enumerate(range(0, len(grid), PAGE_ROWS)):
        rows = grid[top : top + PAGE_ROWS]
        kind, tiled, predictor = layouts[number % len(layouts)]
        if predictor == 2:
            rows = np.diff(rows, axis=1, prepend=np.uint8(0))
        parts, places = [], []
        for at in range(0, len(rows), TILE if tiled else STRIP_ROWS):
            part = rows[at : at + (TILE if tiled else STRIP_ROWS)]
            if tiled:
                part = np.pad(part, ((0, TILE - len(part)), (0, 0)))
            parts.append(_pack(kind, part.tobytes()))
        for part in parts:
            places.append(len(out))
            out += part + b"\0" * (len(part) % 2)
        sizes = [len(part) for part in parts]
        fields = [(256, 4, [WIDTH]), (257, 4, [len(rows)]), (258, 3, [8]), (259, 3, [kind]), (262, 3, [1])]
        fields += [] if tiled else [(273, 4, places)]
        fields += [(277, 3, [1])] + ([] if tiled else [(278, 4, [STRIP_ROWS]), (279, 4, sizes)])
        fields += [(317, 3, [predictor])]
        fields += [(322, 4, [TILE]), (323, 4, [TILE]), (324, 4, places), (325, 4, sizes)] if tiled else []
        extra = {}
        for tag, code, values in fields:
            if len(values) * (2 if code == 3 else 4) > 4:
                extra[tag] = len(out)
                out += struct.pack(f"<{len(values)}{FIELD[code]}", *values)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields))
        for tag, code, values in fields:
            own = struct.pack("<I", extra[tag]) if tag in extra else struct.pack(f"<{len(values)}{FIELD[code]}", *values).ljust(4, b"\0")
            out += struct.pack("<HHI", tag, code, len(values)) + own
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_pages(file: bytes) -> Iterator[Page]:
    """The pages of a TIFF with one 8-bit sample for each pixel."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(file[:4])
    if order is None:
        raise ValueError("not a TIFF")
    at, seen, number = struct.unpack_from(f"{order}I", file, 4)[0], set(), 0
    while at and at not in seen:
        seen.add(at)
        (count,) = struct.unpack_from(f"{order}H", file, at)
        tags: dict[int, tuple] = {}
        for i in range(count):
            entry = at + 2 + 12 * i
            tag, code, n = struct.unpack_from(f"{order}HHI", file, entry)
            if code in FIELD and n <= len(file):
                size = n * struct.calcsize(FIELD[code])
                place = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", file, entry + 8)[0]
                tags[tag] = struct.unpack_from(f"{order}{n}{FIELD[code]}", file, place)
        yield _page(file, tags, number)
        number += 1
        (at,) = struct.unpack_from(f"{order}I", file, at + 2 + 12 * count)


def _page(file: bytes, tags: dict[int, tuple], number: int) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    width, height, kind = one(256), one(257), one(259, STORED)
    if not width or not height or width * height > MAX_SAMPLES:
        raise ValueError("a page without usable dimensions")
    if one(258, 8) != 8 or one(277, 1) != 1:
        raise ValueError("only one 8-bit sample for each pixel is supported")
    if 324 in tags:
        across, down, places, sizes = one(322), one(323), tags[324], tags[325]
    else:
        across, down, places, sizes = width, min(one(278, height), height), tags[273], tags[279]
    if not across or not down or (height + down) * (width + across) > 4 * MAX_SAMPLES:
        raise ValueError("strips or tiles without usable dimensions")
    grid = np.zeros((-(-height // down) * down, -(-width // across) * across), np.uint8)
    columns = grid.shape[1] // across
    for i, (place, size) in enumerate(zip(places, sizes)):
        top, left = i // columns * down, i % columns * across
        rows = down if 324 in tags else min(down, height - top)
        part = np.frombuffer(_unpack(kind, file[place : place + size], rows * across), np.uint8)
        part = part.reshape(rows, across)
        if one(317, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        grid[top : top + rows, left : left + across] = part
    return Page(number, width, height, kind, grid[:height, :width].tobytes())


def pad(data: bytes) -> bytes:
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0")


def describe(samples: bytes, pages: int) -> str:
    """Page count, mean, deviation and an average hash over 8 x 8 equal runs of samples."""
    grey = np.frombuffer(samples, np.uint8)
    runs = grey[: len(grey) // 64 * 64].reshape(64, -1).mean(axis=1)
    bits = np.packbits(runs > runs.mean()).tobytes().hex()
    return f"pages={pages};mean={grey.mean():.3f};dev={grey.std():.3f};ahash={bits}"


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "media") -> DataFrame:
    """doc_id and the TIFF of each text's UTF-8 bytes (null: empty), padded to blocks of 64."""

    @F.arrow_udf("binary")
    def store(texts: pa.Array) -> pa.Array:
        return pa.array([write_tiff(pad((x.as_py() or "").encode())) for x in texts], pa.binary())

    return docs.select(F.col(doc_id).alias("doc_id"), store(F.col(text)).alias(into))


def tiff_pages(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, page, width, height, compression, samples, error: one row for each page."""
    kind = files.schema[key].dataType.simpleString()
    schema = f"key {kind}, page int, width int, height int, compression int, samples binary, error string"

    def walk(batches):
        for batch in batches:
            keys, contents = batch.column(0), batch.column(1)
            for i in range(len(keys)):
                data = contents[i].as_py()
                rows = []
                try:
                    for p in read_pages(data) if data is not None else ():
                        rows.append((p.number, p.width, p.height, p.compression, p.samples, None))
                except (ValueError, KeyError, struct.error, zlib.error, TypeError, IndexError) as problem:
                    rows.append((len(rows), None, None, None, None, f"{type(problem).__name__}: {problem}"))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(),) * 4 + (pa.binary(), pa.string()))]
                    owner = pa.array([keys[i].as_py()] * len(rows), keys.type)
                    yield pa.RecordBatch.from_arrays([owner, *columns], ["key", "page", "width", "height", "compression", "samples", "error"])

    return files.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInArrow(walk, schema)


def stored_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as TIFF, its pages read back, and digests of both, by document."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    spark_kinds = ["bigint", "bigint", "string", "bigint", "bigint", "string", "string"]

    @F.arrow_udf(f"struct<{','.join(f'{n}:{k}' for n, k in zip(names, spark_kinds))}>")
    def digest(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            data = (value.as_py() or "").encode()
            media = write_tiff(pad(data))
            pages = [page.samples for page in read_pages(media)]
            back = b"".join(pages)
            rows.append(
                (
                    len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]),
                    len(media), hashlib.sha256(media).hexdigest(), describe(back, len(pages)),
                )
            )
        columns = list(zip(*rows)) or [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("r")).select("doc_id", "r.*")
