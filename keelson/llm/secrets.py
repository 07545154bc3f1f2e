"""Secret scans: patterns over a text and over whatever is encoded inside it.

A worklist starts with the text itself. Each layer is scanned. Its percent-encoded bytes
and Unicode escapes are decoded in place, so that the whole layer with them decoded is a
layer of its own; each base64 run (also one over several lines) and hex run gives a layer
(of bytes that open a gzip, zlib, bzip2 or xz stream, what this stream and those after it
hold), until no layer yields a new one. Bytes that aren't text count as U+FFFD. A layer
whose text was seen before from the same places of the document is not scanned again, which
ends cycles: what is inflated has one place for all its characters. Every layer keeps, for
each of its characters, the range of the original text that it came from, so spans found in
any layer are spans of the original, in code points, end exclusive.

Defined results: null and empty texts have no spans; what inflates beyond ``WINDOW`` bytes
is scanned in windows that overlap by ``OVERLAP`` or more, which begin between words where a
run of up to ``WINDOW`` bytes would be cut; equal rows give equal rows.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import worker_model

KINDS = ("assign", "access", "hex")
#: The three patterns that every text is scanned for: fixed values.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
ESCAPES = re.compile(rf"(?:{ESCAPE.pattern})+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines; ends of lines may be escaped, as in a JSON string.
LINE_END = r"[\x20\t]*+(?:\r?\n|(?:\\r)?\\n)[\x20\t]*+"
BASE64_LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+{LINE_END}(?:[A-Za-z0-9+/_-]{{16,}}+{LINE_END})*+[A-Za-z0-9+/_-]*={{0,2}}")
BASE64_PART = re.compile(rf"{LINE_END}|[A-Za-z0-9+/_-]+")
HEX_BYTES = re.compile(r"(?:[0-9a-fA-F]{2}){16,}")
MAGIC = (b"\x1f\x8b", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda", b"BZh", b"\xfd7zXZ\0")
#: How a stream begins where something may stand before it.
STREAM = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\0")
PIECE, WINDOW, OVERLAP = 1 << 20, 16 << 20, 1 << 20
#: Without it bytes hold neither a match (12 characters at least) nor a run to unwrap.
PLAIN = re.compile(rb"[\t\n\r\x20-~]{12,}")


@dataclass
class Layer:
    """A text and, for each character, the start and end of its source in the original."""

    text: str
    starts: np.ndarray
    ends: np.ndarray

    def key(self) -> tuple:
        """What tells the layer from others: the same text from elsewhere is another one."""
        place = [x[:1] if x.strides == (0,) else x for x in (self.starts, self.ends)]
        parts = [self.text.encode("utf-8", "surrogatepass"), *[x.tobytes() for x in place]]
        return tuple(xxhash.xxh3_128_digest(x) for x in parts)


def scan(text: str) -> list[tuple[str, int, int]]:
    """The base matches of one text: kind, start, end."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low or not text.isascii():
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _engine(data: bytes):
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor(memlimit=256 << 20)
    return zlib.decompressobj()


def _inflate(pieces):
    """What the stream and those after it hold, in pieces; what is no stream as it is."""
    engine, data, raw, given = None, b"", False, False
    for piece in pieces:
        data = data + piece if data else piece
        while data or engine is not None:
            if raw or engine is None and not data.startswith(MAGIC):
                raw = True
                yield data
                data = b""
                break
            if engine is None:
                engine, given = _engine(data), False
            taken = data
            try:
                out = engine.decompress(data, PIECE)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                raw, engine = True, None
                if given:
                    return
                continue
            if out:
                given = True
                yield out
            if engine.eof:
                data = engine.unused_data.lstrip(b"\0")  # zeros fill up a last block
                engine = None
            elif hasattr(engine, "unconsumed_tail"):
                data = engine.unconsumed_tail
                if not data and len(out) < PIECE:
                    break
            else:
                data = b""
                if engine.needs_input or not out and not taken:
                    break


def _windows(data: bytes):
    """(bytes, whether inflated): data, or what it holds if it is a stream, in windows."""
    pieces, head, inflated = iter(()), data, False
    while head.startswith(MAGIC):
        inner = _inflate(chain([head], pieces))
        first = next(inner, b"")
        pieces = inner
        if first == head or not first:
            break
        head, inflated = first, True
    held, most = head, WINDOW
    for piece in pieces:
        held += piece
        if len(held) >= most:
            yield held, inflated
            cut = max(held.rfind(b" ", 0, max(len(held) - OVERLAP, 0)), len(held) - WINDOW, 0)
            held, most = held[cut:], len(held) - cut + WINDOW
    yield held, inflated


def _decode(data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """Text of bytes, and the first and last byte of each character."""
    if data.isascii():
        place = np.arange(len(data))
        return data.decode(), place, place
    text = data.decode("utf-8", "surrogateescape")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    bad = (code >= 0xDC80) & (code <= 0xDCFF)
    size = np.where(bad, 1, 1 + (code >= 0x80) + (code >= 0x800).astype(int) + (code >= 0x10000))
    last = np.cumsum(size) - 1
    text = np.where(bad, 0xFFFD, code).astype(np.uint32).tobytes().decode("utf-32-le")
    return text, last - size + 1, last


def _from_bytes(data: bytes, place):
    """Layers from decoded bytes; place() gives the starts and ends of each byte's source."""
    if not data.startswith(MAGIC) and not PLAIN.search(data):
        return
    for window, inflated in _windows(data):
        if not PLAIN.search(window):
            continue
        text, first, last = _decode(window)
        starts, ends = place()
        if inflated:
            yield Layer(text, np.broadcast_to(starts.min(), len(text)), np.broadcast_to(ends.max(), len(text)))
        else:
            yield Layer(text, starts[first], ends[last])


def _in_place(layer: Layer, pattern, decode):
    """The layer with all matches decoded: decode gives the text of a match and the first
    and last character of each one's source in it."""
    texts, starts, ends, done = [], [], [], 0
    for m in pattern.finditer(layer.text):
        at, to = m.span()
        text, first, last = decode(m.group())
        texts += [layer.text[done:at], text]
        starts += [layer.starts[done:at], layer.starts[at + first]]
        ends += [layer.ends[done:at], layer.ends[at + last]]
        done = to
    if texts:
        joined = "".join([*texts, layer.text[done:]])
        yield Layer(joined, np.concatenate([*starts, layer.starts[done:]]), np.concatenate([*ends, layer.ends[done:]]))


def _percent_text(run: str) -> tuple[str, np.ndarray, np.ndarray]:
    text, first, last = _decode(bytes.fromhex(run.replace("%", "")))
    return text, first * 3, last * 3 + 2


def _escape_text(run: str) -> tuple[str, np.ndarray, np.ndarray]:
    out, first, last = [], [], []
    for m in ESCAPE.finditer(run):
        digits = m.group().strip("&#;\\")
        number = int(digits[1:], 16) if digits[0] in "uUx" else int(digits)
        if out and 0xD800 <= out[-1] < 0xDC00 <= number < 0xE000:  # a surrogate pair
            out[-1] = 0x10000 + (out[-1] - 0xD800 << 10) + number - 0xDC00
            last[-1] = m.end() - 1
            continue
        out.append(number)
        first.append(m.start())
        last.append(m.end() - 1)
    text = "".join("\ufffd" if n > 0x10FFFF or 0xD800 <= n < 0xE000 else chr(n) for n in out)
    return text, np.array(first), np.array(last)


def _base64(layer: Layer, kept: np.ndarray, run: str):
    """Layers of a run of base64 characters, which stand at ``kept`` in the layer. What was
    encoded may begin at any of them, so all four ways to cut the run in fours are decoded,
    and a stream that begins inside is inflated too."""
    if run.isdigit():
        return
    for shift in range(min(4, len(run) - 15)):
        yield from _base64_from(layer, kept[shift:], run[shift:])


def _base64_from(layer: Layer, kept: np.ndarray, run: str):
    run = run[: len(run) - (len(run) % 4 == 1)]
    data = base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))

    def place():
        at = np.arange(len(data))
        last = np.minimum((at * 4 + 3) // 3 + (at % 3 == 0), len(run) - 1)
        return layer.starts[kept[at * 4 // 3]], layer.ends[kept[last]]

    yield from _from_bytes(data, place)
    for m in STREAM.finditer(data):
        if m.start():
            yield from _from_bytes(data[m.start() :], lambda m=m: tuple(x[m.start() :] for x in place()))


def _hex(layer: Layer, at: int, to: int):
    data = bytes.fromhex(layer.text[at : to - (to - at) % 2])
    yield from _from_bytes(data, lambda: (layer.starts[at:to][: 2 * len(data) : 2], layer.ends[at:to][1 : 2 * len(data) : 2]))


def _inner_layers(layer: Layer):
    text = layer.text
    if "%" in text:
        yield from _in_place(layer, PERCENT, _percent_text)
    if "\\" in text or "&#" in text:
        yield from _in_place(layer, ESCAPES, _escape_text)
    for m in BASE64.finditer(text):
        run = m.group().rstrip("=")
        yield from _base64(layer, np.arange(m.start(), m.start() + len(run)), run)
    for m in BASE64_LINES.finditer(text):
        parts = [p for p in BASE64_PART.finditer(text, *m.span()) if p.group()[0] not in " \t\r\n\\"]
        kept = np.concatenate([np.arange(*p.span()) for p in parts])
        yield from _base64(layer, kept, "".join(p.group() for p in parts))
    for m in HEX_BYTES.finditer(text):
        yield from _hex(layer, *m.span())


def find_secrets(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans of the text, and all spans including those of decoded layers."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(scan(text), key=order)
    spans = set(base)
    if not (BASE64.search(text) or "%" in text or "\\" in text or "&#" in text):
        return base, base
    place = np.arange(len(text))
    whole = Layer(text, place, place + 1)
    work, seen = [_inner_layers(whole)], {whole.key()}
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
        elif (key := inner.key()) not in seen:
            seen.add(key)
            for kind, start, end in scan(inner.text):
                spans.add((kind, int(inner.starts[start:end].min()), int(inner.ends[start:end].max())))
            work.append(_inner_layers(inner))
    return base, sorted(spans, key=order)


def _join(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def secret_spans(text: Column) -> Column:
    """array<struct<kind,start,end>>: all spans of a text, by start, then kind."""

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        found = (find_secrets(x.as_py() or "")[1] for x in texts)
        return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in one] for one in found], kind)

    return spans(text)


def redact(text: Column, mask: str = "[SECRET]") -> Column:
    """The text with each union of overlapping spans replaced by a mask; null stays null."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        worker_model("secrets")
        out = []
        for value in texts:
            whole = value.as_py()
            parts, done = [], 0
            for _, start, end in find_secrets(whole)[1] if whole else ():
                if start >= done:
                    parts += [whole[done:start], mask]
                done = max(done, end)
            out.append("".join([*parts, whole[done:]]) if parts else whole)
        return pa.array(out, pa.string())

    return clean(text)


def scan_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base spans, their digest, and all spans as one string."""
    kind = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string>"

    @F.arrow_udf(kind)
    def report(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            base, spans = find_secrets(value.as_py() or "")
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((*counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans)))
        columns = list(zip(*rows)) or [[]] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col(doc_id).alias("doc_id"), report(F.col(text)).alias("r")).select("doc_id", "r.*")
