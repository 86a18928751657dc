"""The queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets as secret
from .common import table
from .exact_dedup import exact_duplicates
from .lattice_lm import lattice_scores
from .mixing import mixed
from .packing import Tokenizer, packed_documents
from .personal_data import PATTERNS, personal_data, span_text
from .quality import weak_quality
from .simhash import simhash_components
from .toxicity import toxicity
from .warc import derivatives, page_responses


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> Tokenizer:
    return Tokenizer(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), end_id=2)


#: Shares of tokens by domain that the mixture aims at; high-quality text keeps its tokens.
MIXTURE = {"high": 0.96, "low": 0.03, "toxic": 0.01}


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), byte_bpe())


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIXTURE)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret.secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(secret.KINDS)]
    base = secret.span_text(F.filter("spans", lambda s: s["kind"] < secret.KINDS.index("random")))
    return spans.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret.span_text(F.col("spans")).alias("spans"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in (*PATTERNS, "term")]
    base = span_text(F.filter("spans", lambda s: s["kind"] != "term"))
    return spans.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), "sanitised")


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality(table(spark, sf_dir, "documents")).drop("votes")


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(page_responses(table(spark, sf_dir, "pages")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lattice_lm": op1_lattice_lm,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op6_personal_data": op6_personal_data,
    "op7_weak_quality": op7_weak_quality,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES = {
    "op10_exact_dedup": r"""
        with d as (
            select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents
        ), r as (
            select doc_id, body, first_value(doc_id) over w as keep_id, count(*) over (partition by body) as group_size
            from d window w as (partition by body order by length(text) desc, doc_id)
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256 from r
    """,
}
