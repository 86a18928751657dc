"""From documents to packed training sequences: toxic documents go, then exact and near copies, then what the mixture has too
much of; the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
stages hold the corpus in written tables only, so that a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.common import forget_written, n_written, table, written
from folioflow.llm.exact_dedup import without_duplicates
from folioflow.llm.mixing import sampled_to_mixture
from folioflow.llm.packing import packed_documents
from folioflow.llm.queries import MIXTURE, byte_bpe
from folioflow.llm.simhash import without_near_duplicates
from folioflow.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sampled_to_mixture(docs, table(spark, sf_dir, "labels"), MIXTURE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs, byte_bpe())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Trained classifiers and the tokenizer are beyond SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = table(spark, sf_dir, "documents"), n_written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
            forget_written(spark, first, n_written() - 1)  # what the stage read and left; its output stays
    return docs
