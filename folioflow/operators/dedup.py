"""Duplicates and repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, font_bucket, is_light_gray
from ..functions.fixed import STAMP_WORDS


def primaries(df: DataFrame, text: str, key: str, *scope: str) -> DataFrame:
    """df with `primary`: the least key among rows of the scope with the same text.

    The minimum is aggregated by a hash of the text before anything is shuffled, and joined back, so that a text with very many
    copies isn't gathered anywhere; texts themselves don't move.
    """
    marked = df.withColumn("__h", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withColumn("__n", F.col(text).isNull())
    by = [*scope, "__h", "__n"]
    first = marked.groupBy(*by).agg(F.min(key).alias("primary"))
    return marked.join(first, by).drop("__h", "__n")


def repeated_lines(df: DataFrame, *, least_docs: int = 3, shortest: int = 4, longest: int = 120) -> DataFrame:
    """Lines of df (source, doc_id, text) that stand in that many documents of a source."""
    lines = df.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "[ \t\r]+", " "))).filter(F.length("line").between(shortest, longest))
    each = lines.groupBy("source", "line", "doc_id").agg(F.count("*").alias("n"))  # so that no set of documents is held
    return each.groupBy("source", "line").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines")).filter(F.col("n_docs") >= least_docs)


def dominant_value(df: DataFrame, value: str, weight: Column, *by: str) -> DataFrame:
    """The value with the greatest total weight, each weight at least 0.1; of equal totals the larger value."""
    totals = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(F.greatest(weight.cast("double"), F.lit(0.1))).alias("weight"))
    return totals.groupBy(*by).agg(F.max(F.struct("weight", value)).alias("m")).select(*by, F.col(f"m.{value}").alias(value), F.col("m.weight").alias("weight"))


def stamps(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements to drop as page stamps: (doc_id, page_no, elem_idx).

    elements: doc_id, page_no, elem_idx, content, x0, y0, x1, y1, fontsize, color, non_horizontal; pages: doc_id, page_no, width,
    height. A text is judged where it sits on the most pages; one stamped across two thirds of the pages is dropped wherever
    it looks like a stamp and repeats, and single copies of the same look go with it.
    """
    text = F.lower(collapsed("content"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    e = elements.join(pages, ["doc_id", "page_no"]).withColumn("text", text).filter(F.length("text").between(4, 120))
    cx, cy = (F.col("x0") + F.col("x1")) / 2 / F.greatest("width", F.lit(1.0)), (F.col("y0") + F.col("y1")) / 2 / F.greatest("height", F.lit(1.0))
    e = e.withColumns({"cx": cx, "cy": cy}).withColumns(
        {
            "bx": F.bround("cx", 1), "by": F.bround("cy", 1), "centre": F.col("cx").between(0.18, 0.82) & F.col("cy").between(0.18, 0.82),
            "edge": (F.col("cy") <= 0.14) | (F.col("cy") >= 0.86), "gray": is_light_gray("color"), "turned": F.coalesce("non_horizontal", F.lit(False)),
            "large": (F.col("fontsize") >= 18) | (area / F.greatest(F.col("width") * F.col("height"), F.lit(1.0)) >= 0.035),
            "word": F.col("content").rlike(STAMP_WORDS), "look": F.struct(font_bucket("fontsize"), F.col("color")),
        }
    )
    e = e.withColumn("like", (F.col("word") & (F.col("gray") | F.col("turned") | F.col("large"))) | F.col("turned") | (F.col("gray") & (F.col("centre") | F.col("edge"))) | (F.col("centre") & F.col("large")))
    e = e.withColumn("stamp", F.col("large") & (F.col("centre") | F.col("word")))
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages")).join(elements.select("doc_id", "page_no").distinct().groupBy("doc_id").agg(F.count("*").alias("n_used")), "doc_id")
    sizes = sizes.withColumn("repeat", F.when(F.col("n_pages") <= 6, 2).otherwise(3))
    sizes = sizes.withColumn("wide", F.greatest("repeat", F.least("n_used", F.lit(3)), F.ceil(F.col("n_used") * 2 / 3)))
    by_page = e.groupBy("doc_id", "text", "bx", "by", "page_no").agg(F.max("like").alias("like"), F.max("stamp").alias("stamp"), F.min(F.struct("page_no", "elem_idx")).alias("first"))
    places = by_page.groupBy("doc_id", "text", "bx", "by").agg(F.count("*").alias("n"), F.count_if("like").alias("n_like"), F.count_if("stamp").alias("n_stamp"), F.min("first").alias("first")).join(sizes, "doc_id")
    w = Window.partitionBy("doc_id", "text")
    places = places.withColumn("top", F.row_number().over(w.orderBy(F.desc("n"), "first")) == 1).withColumn("is_wide", F.max(F.col("n_stamp") >= F.col("wide")).over(w))
    places = places.withColumn("enough", F.max(F.when(F.col("top"), F.col("n") >= F.col("repeat"))).over(w)).filter("enough")
    places = places.withColumn("goes", F.col("top") | (F.col("is_wide") & (F.col("n_like") >= F.col("repeat"))))
    seen = e.filter("like").join(places.select("doc_id", "text", "bx", "by", "goes", "is_wide"), ["doc_id", "text", "bx", "by"])
    looks = seen.filter("goes").select("doc_id", "text", "look").distinct().withColumn("same_look", F.lit(True))
    out = seen.join(looks, ["doc_id", "text", "look"], "left").filter(F.col("goes") | (F.col("is_wide") & F.coalesce("same_look", F.lit(False))))
    return out.select("doc_id", "page_no", "elem_idx")
