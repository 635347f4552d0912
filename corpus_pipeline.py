"""A corpus pipeline of four stages over `documents`; counted as part of the subpackage llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabplan.llm.common import ensure_checkpoint_dir, table
from tabplan.llm.mixing import mix_documents
from tabplan.llm.queries import bpe_digests
from tabplan.llm.simhash import keep_one_each
from tabplan.llm.toxicity import drop_toxic
from tabplan.sources.files import Files


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs but for those that the classifier, fitted on the labelled ones among them, calls toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group that SimHash links join."""
    return keep_one_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix of their sources takes them."""
    return mix_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes, a row for each copy of a document."""
    return bpe_digests(docs)


STAGES = [("toxicity", toxicity), ("simhash_dedup", simhash_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: A fitted classifier and hashed chance can't be put in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`, each written to the shared folder and read again; the last one's rows stay there."""
    folder, files, before = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}", Files(spark), None
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        written = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before is not None:  # no one reads it any more
            files.delete(before)
        before = written
    return docs
