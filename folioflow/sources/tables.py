"""Input tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, source, line_no, line) of the lines of documents that aren't blank."""
    each = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.filter(F.trim("line") != "")


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: spark.checkpoint.dir; where that is unset, one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", "") or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return found.rstrip("/")


def line_elements(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements and pages made from documents: a source is a file, a document a page, a line an element with a box where a typewriter
    would have put it."""
    each = lines(docs).select(
        F.conv(F.substring(F.md5("source"), 1, 12), 16, 10).cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("page_no"), F.col("line_no").cast("int").alias("elem_idx"), F.col("line").alias("content")
    )
    n = F.length("content")
    x0 = F.lit(72.0) + F.when(n < 40, F.pmod(n, F.lit(5)) * 4.0).otherwise(0.0)
    y0 = F.lit(72.0) + 14.0 * F.pmod("elem_idx", F.lit(48))
    elements = each.withColumns({"x0": x0, "y0": y0}).withColumns(
        {"x1": F.least(F.col("x0") + 5.0 * n, F.lit(540.0)), "y1": F.col("y0") + 11.0 * F.ceil(n / 94), "fontsize": F.lit(10.0), "bold": F.lit(False), "color": F.lit(0), "non_horizontal": F.lit(False)}
    )
    pages = each.select("doc_id", "page_no").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    return elements, pages
