"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, langid, lblm, mixing, pii, quality, secrets, simhash, sketch, tiff
from keelson.llm.common import crc_mod, read

RANKS = "byte_bpe_50k.tiktoken"
#: For these synthetic tables only.
SURROGATE_KEY = "synthetic-tables"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids again, and return counts and digests."""
    docs = read(spark, sf_dir, "documents")
    return bpe.round_trip_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document's bytes as TIFF pages, read the pages back, digest both."""
    return tiff.stored_digests(read(spark, sf_dir, "documents"))


def op3_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold-scaled sketches of every document and of its edited text, compared."""
    return sketch.edited_pairs(read(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; one third of the ids is held out of the training."""
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    models = langid.train_models(docs, ~held_out)
    return langid.predict_languages(docs, models, keep=(held_out.alias("held_out"),))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes by 3-word SimHash at two or fewer differing bits."""
    return simhash.near_components(read(spark, sf_dir, "documents"), radius=2, size=3)


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document; one seventh of the ids is held out of the training."""
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    model, counts = lblm.train_model(docs, ~held_out)
    return lblm.score_documents(docs, model, counts, keep=(held_out.alias("held_out"),))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document and in what is encoded inside it."""
    return secrets.scan_report(read(spark, sf_dir, "documents"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by consistent surrogates.

    A deployment passes a key of its own from its secret store.
    """
    return pii.replace_private(read(spark, sf_dir, "documents"), key=SURROGATE_KEY)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; one third of the ids is held out of the training."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = quality.score_documents(docs, labels, crc_mod(F.col("doc_id"), 3) == 1)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources by weights 1, 2, 3 takes."""
    return mixing.mix_report(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_tiff_media": op2_tiff_media,
    "op3_sketch": op3_sketch,
    "op4_language": op4_language,
    "op5_simhash": op5_simhash,
    "op6_log_bilinear": op6_log_bilinear,
    "op7_secret_scan": op7_secret_scan,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_quality": op9_quality,
    "op10_source_mix": op10_source_mix,
}

#: None of the ten is expressible in SQL as a whole; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {}
