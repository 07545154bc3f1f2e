"""A training corpus from raw documents: five stages, each on all that the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, mixing, quality, secrets, simhash
from keelson.llm.common import modest_batches, read, shared_folder
from keelson.llm.queries import RANKS


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    modest_batches(spark)
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    modest_batches(spark)
    return simhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and their lengths taken anew."""
    modest_batches(spark)
    clean = docs.withColumn("text", secrets.redact(F.col("text")))
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: documents as often as the schedule takes them."""
    modest_batches(spark)
    return mixing.mix_documents(docs)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, token_ids of each document of the mix."""
    modest_batches(spark)
    coded = bpe.encode_texts(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality", keep_good_documents),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("encode", encode_documents),
]

#: Models, fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written in the shared folder and
    read again by the next."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
