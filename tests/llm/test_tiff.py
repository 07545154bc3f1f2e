import hashlib
import random
import zlib

import pytest

from keelson.llm import tiff


def payloads():
    rng = random.Random(7)
    for size in (64, 128, 4096, 8192, 8256, 20480, 70016):
        yield bytes(rng.randrange(256) for _ in range(size))
        yield b"ab" * (size // 2)
        yield bytes(size)
        yield "".join(rng.choice("the of and é, \n") for _ in range(size)).encode()[:size]


@pytest.mark.parametrize("layout", tiff.LAYOUTS)
def test_every_layout_reads_back(layout):
    for payload in payloads():
        pages = list(tiff.read_pages(tiff.write_tiff(payload, (layout,))))
        assert b"".join(p.samples for p in pages) == payload
        assert len(pages) == -(-len(payload) // (64 * 128))


def test_codecs_alone():
    for payload in payloads():
        assert tiff.packbits_decode(tiff.packbits_encode(payload)) == payload
        assert tiff.lzw_decode(tiff.lzw_encode(payload)) == payload


def test_big_endian_stored_page_and_loop():
    import struct

    head = b"MM\0*" + struct.pack(">I", 8 + 4)
    fields = [(256, 4, 2), (257, 4, 2), (258, 3, 8 << 16), (259, 3, 1 << 16), (273, 4, 8), (279, 4, 4)]
    body = struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", t, c, 1, v) for t, c, v in fields)
    pages = list(tiff.read_pages(head + b"abcd" + body + struct.pack(">I", 12)))
    assert [p.samples for p in pages] == [b"abcd"]


def test_pages_and_errors(spark):
    rows = [(1, tiff.write_tiff(b"x" * 64 * 300)), (2, b"nonsense"), (3, None), (4, b"II*\0\xff\xff\0\0")]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()
    assert sorted((r.key, r.page, r.height) for r in got if r.error is None) == [(1, 0, 128), (1, 1, 128), (1, 2, 44)]
    assert sorted(r.key for r in got if r.error) == [2, 4]


def test_digests_by_brute_force(spark):
    rows = [(1, "a", 9), (2, None, 9), (3, "", 9), (4, "é" * 70000, 9), (1, "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media long")
    got = sorted(tiff.stored_digests(docs).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [1, 1, 2, 3, 4]
    for r, text in zip(got, ["a", "a", "", "", "é" * 70000]):
        data = text.encode()
        padded = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
    assert got[0][1:] == got[1][1:] and got[2][1:] == got[3][1:]
    assert tiff.stored_digests(docs.limit(0)).count() == 0


def test_unusable_strips_and_tiles_give_error_rows(spark):
    import struct

    from keelson.llm import tiff

    files = []
    for layout, tag, value in (((tiff.DEFLATE, False, 1), 278, 0), ((tiff.DEFLATE, True, 1), 322, 0), ((tiff.DEFLATE, True, 1), 323, 1 << 31)):
        file = bytearray(tiff.write_tiff(b"x" * 256, (layout,)))
        at = file.index(struct.pack("<HHI", tag, 4, 1))
        struct.pack_into("<I", file, at + 8, value)
        files.append((len(files), bytes(file)))
    got = tiff.tiff_pages(spark.createDataFrame(files, "id int, f binary"), "id", "f").collect()
    assert len(got) == 3 and all(r.error and r.samples is None for r in got)
