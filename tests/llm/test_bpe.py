import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from keelson.llm import bpe

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")]
PARTS = [
    "a", "b", "th", "e", "ing", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "　", "​", "'s", "'", "'ll", "1", "23",
    "½", "é", "漢", "🙂", "٣", "ſ", "!", "..", "́", "\r\n", "\x00", "A", "THE", "the the", "<|endoftext|>", "aaaaaaa", " ",
]


def library(path):
    ranks = bpe.parse_ranks(bpe.load_ranks(path))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("path", PATHS)
def test_ids_equal_the_library(path):
    rng = random.Random(1)
    codec, other = bpe.Codec(bpe.load_ranks(path), public_tokenizers.PATTERN), library(path)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(30)))
        ids = codec.encode(text)
        assert ids == other.encode_ordinary(text), text
        assert codec.decode(ids) == codec.decode_spelled(codec.spell(text)) == text.encode()
    assert not any(codec.low)


def test_very_long_pre_tokens():
    rng = random.Random(2)
    codec, other = bpe.Codec(bpe.load_ranks(PATHS[0]), public_tokenizers.PATTERN), library(PATHS[0])
    for text in ("".join(rng.choice("abcdefghij") for _ in range(100_000)), "a" * 50_000, " " * 30_000, "漢字" * 20_000, "=" * 10_001):
        assert codec.encode(text) == other.encode_ordinary(text)


def test_memory_is_bounded():
    small = bpe._Remembered(str.upper, 3)
    assert [small[k] for k in "abcdeab"] == list("ABCDEAB")
    assert len(small) <= 3 and len(small.older) <= 3
    assert small["x" * 100] == "X" * 100 and "x" * 100 not in small


def test_documents(spark):
    other = library(PATHS[0])
    rows = [(1, "the the then", 5), (2, None, 5), (3, "", 5), (4, "é漢🙂 " * 5000, 5), (1, "the the then", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted(bpe.round_trip_digests(docs, PATHS[0], public_tokenizers.PATTERN).collect())
    assert [r.doc_id for r in got] == [1, 1, 2, 3, 4]
    for r, text in zip(got, ["the the then"] * 2 + ["", "", "é漢🙂 " * 5000]):
        ids = other.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    coded = bpe.decode_ids(bpe.encode_texts(docs, PATHS[0], public_tokenizers.PATTERN), PATHS[0])
    assert {(r.doc_id, bytes(r.decoded).decode()) for r in coded.collect()} == {(i, t or "") for i, t, _ in rows}
    assert bpe.decode_ids(docs.select(F.lit(None).cast("array<int>").alias("token_ids")), PATHS[0]).first().decoded is None
    assert bpe.round_trip_digests(docs.limit(0), PATHS[0], public_tokenizers.PATTERN).count() == 0


def test_oversized_rank_file(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_RANK_FILE", 10)
    (tmp_path / "r").write_bytes(b"x" * 11)
    with pytest.raises(ValueError):
        bpe.load_ranks(str(tmp_path / "r"))


def test_other_patterns_have_no_shortcuts():
    path = PATHS[0]
    ranks = bpe.parse_ranks(bpe.load_ranks(path))
    rng = random.Random(4)
    for pattern in (r"\p{Lu}?\p{Ll}+|\s+|.", r"\w+|[^\w]", r"(?s:.{1,7})"):
        codec, other = bpe.Codec(bpe.load_ranks(path), pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for _ in range(300):
            text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(30)))
            assert codec.encode(text) == other.encode_ordinary(text), (pattern, text)


def test_tables_of_more_than_a_million_ranks():
    import base64

    raw = b"\n".join(base64.b64encode(x) + b" " + str(r).encode() for x, r in ((b"a", 1), (b"b", 2), (b"ab", 3_000_000), (b"aba", 2_999_999)))
    assert bpe.Codec(raw, r"\w+").encode("abaab") == [2_999_999, 3_000_000]
