"""Every operator's query over its whole table, at the small size."""

import hashlib
import zlib

import pytest

from keelson.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_a_row_for_each_document(spark, documents, name):
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)


def test_held_out_accuracy(spark, documents):
    rows = queries.QUERIES["op4_language"](spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) > 0.97 * len(held)
    rows = queries.QUERIES["op9_quality"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) > 0.95 * len(held)
    rows = queries.QUERIES["op6_log_bilinear"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out and r.n_tokens > 50]
    assert sum(r.score > r.base_score for r in held) > 0.9 * len(held)


def test_tiff_payloads(spark, documents):
    for r in queries.QUERIES["op2_tiff_media"](spark, FOLDER).collect():
        data = documents[r.doc_id].text.encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
