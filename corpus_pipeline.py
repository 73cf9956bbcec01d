"""From raw documents to token ids: language, near copies, secrets, mix, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; each
result is written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bpe, langid, mixing, secrets, simhash
from sieveline.llm.queries import vocabulary
from sieveline.storage import free, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without letters go, and those whose
    best language holds less than half of the likelihood."""
    return langid.accept(docs, langid.Model(langid.learn(docs, F.lit(True))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id: fingerprints within three bits, or
    five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    return simhash.keep_one(docs, similar=0.8)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by the kind of secret."""
    return secrets.redact_column(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to three times."""
    return mixing.apply(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and a digest of what they decode to."""
    found = bpe.encode(docs, vocabulary())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language id", language), ("near copies", near_copies), ("secrets", redacted), ("mix", mixed), ("bpe", encoded)]

#: SQL can't express the language model, the links of fingerprints or BPE; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        free(spark)
        docs = spark.read.parquet(path)
    return docs
