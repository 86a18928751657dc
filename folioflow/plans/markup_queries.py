"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mathtext, numbers
from ..operators import events, segments
from ..sources.tables import lines, shared_folder, table
from . import sql


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")


def pages_strict_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.verdicts(_pages(spark, sf_dir))


def segments_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segments(_pages(spark, sf_dir)).select("doc_id", "seg_id", "start", "end", "kind", "source", F.size("fragments").alias("n_fragments"))


def protect_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.roundtrip(segments.segments(_pages(spark, sf_dir)))


def byte_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.byte_batches(segments.segments(_pages(spark, sf_dir)).select("doc_id", "seg_id", "source"))


def translation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of a stand-in translator over the segments of all pages, and what they cover."""
    out = segments.translated(spark, segments.segments(_pages(spark, sf_dir)), segments.stand_in, f"{shared_folder(spark)}/rounds")
    return segments.coverage(out, "doc_id")


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in lines that have any."""
    each = lines(table(spark, sf_dir, "documents")).filter(F.col("line").rlike("[0-9]"))
    return numbers.with_numbers(each.select("doc_id", "line_no", "line"), "line").filter(F.size("numbers") > 0).select("doc_id", "line_no", F.array_join("numbers", " ").alias("numbers"))


def math_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = mathtext.with_math(lines(table(spark, sf_dir, "documents")).select("doc_id", "line"), "line")
    return each.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("is_math").alias("n_math"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the language that their html element names."""
    lang = F.regexp_extract("html", r'<html[^>]*\blang="([^"]*)"', 1)
    return table(spark, sf_dir, "pages").groupBy(lang.alias("page_lang")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("n_chars"))


QUERIES = {f.__name__: f for f in (pages_strict_verdict, segments_tolerant, protect_roundtrip, byte_batches, page_languages, translation_coverage, line_numbers, math_lines)}
ORACLES = {
    "math_lines": f"with {sql.LINES}, t as (select doc_id, {sql.math_source('line')} as t from lines) select doc_id, count(*) as n_lines, count_if({sql.math_text('t')})::bigint as n_math from t group by 1",
    "page_languages": r"""select regexp_extract(html, '<html[^>]*\blang="([^"]*)"', 1) as page_lang, count(*) as n, sum(length(html))::bigint as n_chars from pages group by 1""",
}
