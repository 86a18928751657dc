"""Queries over boxes on pages: layout, merges, tables, spatial joins. Pages are made from documents or from the numbers of other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.text import font_bucket
from ..functions.validation import reference_reason
from ..operators import dedup, joins, layout, policy
from ..sources.tables import line_elements, lines, table
from . import shape_queries, sql


def layout_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, pages = line_elements(table(spark, sf_dir, "documents"))
    return layout.classified(elements, pages).groupBy("doc_id", "page_no", "layout_class").agg(F.count("*").alias("n"))


def element_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, pages = line_elements(table(spark, sf_dir, "documents"))
    return policy.requires_translation(layout.classified(elements, pages)).groupBy("layout_class", "rule").agg(F.count("*").alias("n"))


def _merged(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    """Lines of documents, changed so that the rule finds something to merge: items with bullets, unfinished lines, headings, entries."""
    elements, pages = line_elements(table(spark, sf_dir, "documents"))
    k, line = F.col("elem_idx") % 3, F.col("content")
    changed = {
        "wrapped": (line, F.col("x0")),
        "list": (F.when(k == 0, F.concat(F.lit("• "), line)).otherwise(line), F.when(k == 0, 72.0).otherwise(84.0)),
        "strong": (F.when(k == 0, line).otherwise(F.lower(F.regexp_replace(line, r"[.!?]+\s*$", ""))), F.lit(72.0)),
        "heading": (F.when(k < 2, F.upper(F.replace(F.substring(line, 1, 60), F.lit("ß"), F.lit("ss")))).otherwise(line), F.lit(72.0)),
        "reference": (F.when(k == 0, F.concat(F.lit("Smith, J. (1999). "), line)).otherwise(F.lower(line)), F.when(k == 0, 72.0).otherwise(80.0)),
    }[rule]
    made = elements.withColumns({"content": changed[0], "x0": changed[1].cast("double")})
    boxed = made.withColumns({"x1": F.least(F.col("x0") + 5.0 * F.length("content"), F.lit(540.0)), "y1": F.col("y0") + 11.0 * F.ceil(F.length("content") / 94)})
    return layout.merged(boxed, pages, rule).select("doc_id", "page_no", F.col("elem_idx").cast("long").alias("elem_idx"), F.md5("content").alias("content"), F.col("n_merged").cast("long").alias("n_merged"))


def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "wrapped")


def merged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "list")


def merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "strong")


def merged_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "heading")


def merged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "reference")


def page_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat on a source's pages, as if printed large in their middle."""
    elements, pages = line_elements(table(spark, sf_dir, "documents"))
    middle = {"x0": F.lit(100.0), "x1": F.lit(500.0), "y0": F.lit(380.0), "y1": F.lit(400.0), "fontsize": F.lit(20.0)}
    return dedup.stamps(elements.withColumns(middle), pages).select("doc_id", "page_no", F.col("elem_idx").cast("long").alias("elem_idx"))


def reading_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, _ = line_elements(table(spark, sf_dir, "documents"))
    ranked = layout.reading_order(elements)
    return ranked.groupBy("doc_id", "page_no").agg(F.sum(F.col("rank") * F.col("elem_idx")).cast("long").alias("mark"), F.max("rank").cast("long").alias("last"))


def cross_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the pages of one book: sentences that run from a page to the next."""
    elements, pages = line_elements(table(spark, sf_dir, "documents"))
    book = lambda df: df.withColumn("doc_id", F.lit(1).cast("long"))
    body = book(elements).withColumn("layout_class", F.lit("body")).withColumn("fontsize", 9.0 + F.col("elem_idx") % 4)
    found = layout.cross_page(body, book(pages), 10.5)
    return found.select("page_no", F.col("from_idx").cast("long").alias("from_idx"), F.col("to_idx").cast("long").alias("to_idx"), "dangling", "lower_start")


def main_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("source", font_bucket(8 + F.col("doc_id") % 13 / 3.0).alias("size"), "n_chars")
    return dedup.dominant_value(sized, "size", F.col("n_chars"), "source").select("source", "size")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as spans of lines."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (k % 5).alias("doc_id"), (k % 3).alias("page_no"), (k % 11).alias("line_no"), "p_partkey", (F.col("p_size") * 7.0 + k % 13).alias("x0"), (F.col("p_size") * 7.0 + k % 13 + 20.0 + k % 17).alias("x1"), F.lit(6.0).alias("fontsize")
    ).groupBy("doc_id", "page_no", "line_no", "x0", "fontsize").agg(F.max("x1").alias("x1"))


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = layout.cells(_spans(spark, sf_dir))
    return cells.groupBy("doc_id", "page_no", "line_no").agg(F.count("*").alias("n"), (F.max("cell") + 1).cast("long").alias("n_cells"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as lines of blocks."""
    each = lines(table(spark, sf_dir, "documents")).withColumn("n", F.length("line"))
    return each.select(
        "doc_id", F.lit(0).cast("long").alias("page_no"), F.lit(0).cast("long").alias("block"), F.col("line_no").cast("long").alias("line_no"), F.col("line").alias("plain"),
        (72.0 + F.col("n") % 4 * 6.0).alias("x0"), (72.0 + F.col("n") % 4 * 6.0 + F.least(F.col("n") * 5.0, F.lit(400.0))).alias("x1"), (14.0 * F.col("line_no") + F.col("n") % 3 * 2.0).alias("y0"), (14.0 * F.col("line_no") + F.col("n") % 3 * 2.0 + 10.0).alias("y1"),
        F.lit(10.0).alias("fontsize"), F.lit(60.0).alias("bx0"), F.lit(500.0).alias("bx1"),
    )


def block_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = layout.paragraphs(_blocks(spark, sf_dir))
    return each.groupBy("doc_id", F.col("paragraph").cast("long").alias("paragraph")).agg(F.min("line_no").alias("first"), F.count("*").alias("n"))


def block_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir)
    moved = rows.withColumns({"x0": F.when(F.col("doc_id") % 3 == 0, 500.0 - F.col("x1") + F.col("x0")).otherwise(F.col("x0")), "x1": F.when(F.col("doc_id") % 3 == 0, 500.0).otherwise(F.col("x1")), "plain": F.substring("plain", 1, 60)})
    return policy.text_align(moved).select("doc_id", "align")


def _box(k: Column, w: float) -> Column:
    x, y = k * 37 % 500 * 1.0, k * 53 % 700 * 1.0
    return F.struct(x.alias("x0"), y.alias("y0"), (x + w + k % 7).alias("x1"), (y + 12.0 + k % 5).alias("y1"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((k % 4).alias("doc_id"), (k % 6).alias("page_no"), k.alias("elem_idx"), _box(k, 60.0).alias("box"), F.col("p_name").alias("content"), F.lit(10.0).alias("fontsize"))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((k % 4).alias("doc_id"), (k % 6).alias("page_no"), k.alias("table_idx"), _box(k * 3, 90.0).alias("box"))


def touching_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that meet a formula's or a table's box, and by how much."""
    return joins.touching(_texts(spark, sf_dir).select("doc_id", "page_no", "elem_idx", "box"), _tables(spark, sf_dir), 0.5).select("elem_idx", "table_idx", "shared")


def shallow_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that formulae promote: all that touch one but for slivers of prose at an edge."""
    return layout.promoted_by_formulae(_texts(spark, sf_dir), _tables(spark, sf_dir)).select("elem_idx", "promoted")


def images_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.outside_tables(_texts(spark, sf_dir), _tables(spark, sf_dir), 0.1).select("elem_idx")


def marker_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return joins.nearest_right(texts.filter("elem_idx % 9 = 0"), texts.filter("elem_idx % 9 > 0"), F.lit(500.0)).select("marker_idx", "target_idx", "score")


def groups_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, tables = _texts(spark, sf_dir), _tables(spark, sf_dir)
    below = texts.select("doc_id", "page_no", F.col("elem_idx").alias("line_idx"), F.col("box.y0").alias("line_y0"))
    return joins.nearest_above(below, tables.select("doc_id", "page_no", F.col("table_idx").alias("group_idx"), F.col("box.y1").alias("group_y1"))).select("line_idx", "group_idx")


def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the one after it: the share of its words that the answer has too."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    words = lambda c: F.array_remove(F.split(F.lower(c), "[^a-z]+"), "")
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(joins.overlap_ratio(words("text"), words("answer")), 6).alias("ratio"))


def glossary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark's passages as a glossary over the documents."""
    word = F.explode(F.slice(F.split("text", "[^A-Za-z]+"), 2, 3))
    glossary = table(spark, sf_dir, "benchmark").select(word.alias("source")).filter(F.length("source") >= 5).distinct().select("source", F.upper("source").alias("target"), F.lit(0).alias("ord"))
    hits = joins.glossary_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), glossary)
    return hits.select("doc_id", "source", "target", F.col("n").cast("long").alias("n"), F.col("first_offset").cast("long").alias("first_offset"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as elements of pages: an order is a page."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    content = F.when(k % 3 == 0, F.concat(F.lit("Units "), F.col("l_quantity").cast("long").cast("string"))).when(k % 3 == 1, "No figure stands in this sentence of the cell").otherwise("x")
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return each.select(
        (F.col("l_orderkey") % 10).alias("doc_id"), F.floor(F.col("l_orderkey") / 40).alias("page_no"), k.alias("elem_idx"), content.alias("content"), F.when(F.col("l_linenumber") % 4 == 0, "body").otherwise("table").alias("layout_class")
    )


def tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.tabular_pages(_cells(spark, sf_dir)).select("doc_id", "page_no")


def frozen_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = policy.preserved_tables(_cells(spark, sf_dir), F.length("content") > 20)
    return kept.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))


def formula_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    kept = cells.filter("layout_class = 'body'")
    return policy.formula_summary(cells, F.regexp_count("content", F.lit("[0-9]")), kept).select("doc_id", "page_no", F.col("n_protected").cast("long").alias("n_protected"), F.col("n_unprotected").cast("long").alias("n_unprotected"), "status")


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as warnings of pages; some have no page."""
    page = F.when(F.col("event_id") % 50 > 0, F.col("event_id") % 7)
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("doc_id"), page.alias("page_no"), F.col("event_type").alias("kind"))
    return policy.warnings_by_page(rows).select("doc_id", "page_no", "n", F.array_join("kinds", ",").alias("kinds"), "unscoped")


def fallback_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that fall back with those that merges link them to."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("doc_id"), (F.col("event_id") % 400).alias("page_no"), "event_type", "event_id")
    merges = e.filter("event_type = 'click' and event_id % 5 > 1").select("doc_id", F.col("page_no").alias("source_page"), F.lit("accepted").alias("decision"))
    return policy.fallback_pages(e.filter("event_id % 61 = 0").select("doc_id", "page_no").distinct(), merges)


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as glyphs: those that are drawn again at the same place."""
    at = F.col("l_quantity") + F.col("l_linenumber") * 0.125
    spans = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 5).alias("doc_id"), (F.col("l_orderkey") % 3).alias("page_no"), F.col("l_shipdate").cast("string").substr(1, 7).alias("text"), F.col("l_returnflag").alias("font"), F.lit(10.0).alias("size"),
        at.alias("x0"), at.alias("y0"), (at + 5).alias("x1"), (at + 9).alias("y1"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    ).distinct()
    return layout.last_glyphs(spans).select("doc_id", "page_no", "ord")


def formula_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, _ = line_elements(table(spark, sf_dir, "documents"))
    marked = elements.withColumn("layout_class", F.when(F.col("elem_idx") % 5 == 0, "table").otherwise("body"))
    formulae = elements.filter("elem_idx % 3 = 1").select("doc_id", "page_no", F.col("x0").alias("fx0"), F.col("y0").alias("fy0"), F.col("x1").alias("fx1"), F.col("y1").alias("fy1"))
    return policy.formula_stubs(marked, formulae).select("doc_id", "page_no", F.col("elem_idx").cast("long").alias("elem_idx"))


def page_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, pages = line_elements(table(spark, sf_dir, "documents"))
    colored = layout.classified(elements, pages).withColumns({"fontsize": 7.0 + F.col("elem_idx") % 9, "color": (F.col("elem_idx") % 3 * 1_118_481).cast("int")})
    return layout.page_styles(colored).select("doc_id", "page_no", "layout_class", "fontsize", F.round("line_height", 6).alias("line_height"), F.col("color").cast("long").alias("color"), "color_hex", "padding")


def kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents' first lines, cut short and set to the right in every third document, that stay lines."""
    rows = _blocks(spark, sf_dir).filter("line_no < 5").withColumn("plain", F.substring("plain", 1, 20))
    moved = rows.withColumns({"x0": F.when(F.col("doc_id") % 3 == 0, 500.0 - F.col("x1") + F.col("x0")).otherwise(F.col("x0")), "x1": F.when(F.col("doc_id") % 3 == 0, 500.0).otherwise(F.col("x1"))})
    return layout.kept_apart(moved, policy.text_align(moved)).select("doc_id")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as lines of blocks: an order is a block, three to a row."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber") - 1
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    x0 = 80.0 * (n % 2) + F.when(k % 5 == 0, 9.0 * (n % 4)).otherwise(0.0)
    return each.select((k % 7).alias("doc_id"), F.lit(0).cast("long").alias("page_no"), k.alias("block"), n.cast("long").alias("line_no"), F.concat("f", F.lit(" "), F.when(k % 3 == 0, "goes on").otherwise("Total.")).alias("plain"),
        x0.cast("double").alias("x0"), (x0 + 60.0).cast("double").alias("x1"), (14.0 * F.floor(n / 2)).cast("double").alias("y0"), F.lit(10.0).alias("fontsize"))


def repeated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.repeated_columns(_grid(spark, sf_dir))
    return found.groupBy("doc_id", "block").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))


def sentence_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines carry on of a sentence, and how much follows it."""
    each = lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.leading_tail("line", 120).alias("p"))
    return each.filter("p is not null").select("doc_id", "line_no", F.length("p.tail").cast("long").alias("n_tail"), F.length("p.rest").cast("long").alias("n_rest"))


def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.concat(F.initcap("p_name"), F.lit(" "), F.initcap("p_type"), F.when(k % 4 == 0, " Bank").when(k % 4 == 1, ", ABC").otherwise(""))
    shown = policy.is_display_title(title, 10.0 + k % 10, F.floor(k / 10) % 3, exempt=k % 6 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("is_title"))


def reference_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations of bibliography entries: whole, with the lead changed, echoed, without an address or a number, or too short."""
    k = F.col("c_custkey")
    lead = F.concat(F.initcap("c_mktsegment"), F.lit(", "), F.substring("c_name", 1, 1), F.lit(". ("), (F.lit(1900) + k % 100).cast("string"), F.lit("). "))
    rest = F.concat(F.lit("Notes on the market of "), F.lower("c_mktsegment"), F.lit(" in "), (F.lit(100) + k % 800).cast("string"), F.lit(" cases, https://x.example/"), k.cast("string"))
    said = F.when(k % 7 == 0, F.concat(lead, F.lit("关于市场的若干说明，"), (F.lit(100) + k % 800).cast("string"), F.lit("例，https://x.example/"), k.cast("string"))).when(k % 7 == 1, F.concat(F.lit("x"), lead, rest)).when(k % 7 == 2, F.concat(lead, rest)).when(
        k % 7 == 3, F.concat(lead, F.lit("关于市场的若干说明"))).when(k % 7 == 4, F.concat(lead, F.lit("关于市场的若干说明 https://x.example/"), k.cast("string"), F.lit(" x"))).when(k % 7 == 5, F.concat(lead, F.lit("文 "), rest)).otherwise(F.concat(lead, rest, F.lit(" 关于市场的")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", lead.alias("lead"), rest.alias("rest"), F.concat(lead, rest).alias("source"), said.alias("said"))
    return rows.select("c_custkey", reference_reason("source", "said", F.col("lead"), F.col("rest")).alias("reason"))


def merge_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as elements of pages and merges of each turn into the next: those that the turns don't bear out."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.lit(0).cast("long").alias("elem_idx"), F.when(F.col("turn") % 5 == 4, "table").otherwise("body").alias("layout_class"), F.col("text").alias("content"))
    k = F.col("doc_id") * 3 + F.col("page_no") * 5
    made = turns.select(
        "doc_id", F.col("page_no").alias("decision_idx"), F.when(k % 9 == 0, "rejected").otherwise("accepted").alias("decision"), F.when(k % 7 == 0, "other").otherwise("cross-page-merge").alias("kind"), F.when(k % 8 == 0, "weak").otherwise("accepted").alias("reason"),
        F.col("page_no").alias("source_page"), F.lit(0).cast("long").alias("source_element"), (F.col("page_no") + 1).alias("destination_page"), F.lit(0).cast("long").alias("destination_element"), F.when(k % 4 == 0, "lower").otherwise("upper").alias("destination_start"),
        F.lit("h").alias("source_orientation"), F.when(k % 5 == 0, "v").otherwise("h").alias("destination_orientation"),
    )
    return joins.merge_violations(made, turns)


def paragraph_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a paragraph for each word of every third, an element for each."""
    texts = _texts(spark, sf_dir).select("doc_id", "page_no", "elem_idx", "content", "box.*")
    parts = F.transform(F.split("content", " "), lambda w, i: F.struct(w.alias("plain"), F.lit(1.0).alias("x0"), (12.0 * i).alias("y0"), (1.0 + 6.0 * F.length(w)).alias("x1"), (12.0 * i + 10.0).alias("y1")))
    made = layout.paragraph_elements(texts.withColumn("paragraphs", F.when(F.col("elem_idx") % 3 == 0, parts)))
    return made.select("elem_idx", F.col("part").cast("long").alias("part"), "content", "x0", "y1")


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a page as the cells of one table: their rows and columns."""
    texts = _texts(spark, sf_dir).select("doc_id", "page_no", F.lit(0).alias("region"), F.col("elem_idx").cast("int").alias("elem_idx"), "box.*", "fontsize")
    return layout.table_cells(texts).select(*(F.col(c).cast("long").alias(c) for c in ("elem_idx", "row_no", "col_no")))


def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in columns, on pages of which some say that they list members."""
    k = F.col("p_partkey")
    y0 = 14.0 * (k % 47)
    elements = table(spark, sf_dir, "part").select(
        (k % 3).alias("doc_id"), (k % 4).alias("page_no"), k.alias("elem_idx"), F.when(k % 24 == 0, "List of members").when(k % 11 == 0, F.col("p_name")).otherwise(F.initcap("p_name")).alias("content"),
        (k % 2 * 200.0).alias("x0"), y0.alias("y0"), (y0 + 10).alias("y1"), F.lit(10.0).alias("fontsize"), F.lit(False).alias("bold"), F.when(k % 13 == 0, "body").otherwise("table").alias("layout_class"),
    )
    return policy.entity_rows(elements).select("elem_idx")


def tracking_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as texts of pages, every fourth a code of mixed case: beyond the page, at its edge, or in its middle."""
    k = F.col("p_partkey")
    code = F.concat(F.lit("qX"), (k % 3).cast("string"), F.lit("b"), (k % 2).cast("string"), F.lit("Zt7"))
    x0 = F.when(k % 3 == 0, -5.0).when(k % 3 == 1, 2.0).otherwise(300.0)
    y0 = (k * 53 % 5 * 140.0).cast("double")
    elements = table(spark, sf_dir, "part").select(
        (k % 2).alias("doc_id"), F.floor(k / 3).alias("page_no"), k.alias("elem_idx"), F.when(k % 4 == 0, code).otherwise(F.col("p_name")).alias("content"), F.when(k % 28 == 0, "body").otherwise("scattered").alias("layout_class"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 30.0).alias("x1"), (y0 + 10.0).alias("y1"),
    )
    pages = elements.select("doc_id", "page_no").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    return policy.distribution_codes(elements, pages).select("elem_idx")


QUERIES = {
    f.__name__: f
    for f in (
        layout_classes, element_rules, merged_lines, merged_items, merged_blocks, merged_headings, merged_entries, page_stamps, reading_ranks, cross_page, main_fonts, line_cells, block_paragraphs, block_alignment, touching_boxes, shallow_overlaps, images_outside, marker_targets, groups_above,
        word_overlap, glossary_hits, tabular, frozen_tables, formula_summary, warnings, fallback_closure, glyphs, formula_stubs, page_styles, kept_lines, repeated_columns,
        sentence_tails, display_titles, reference_verdicts, merge_violations, paragraph_elements, table_cells, directories, tracking_codes,
    )
}



def _elements_sql(content: str = "line", x0: str = "72.0 + case when length(line) < 40 then length(line) % 5 * 4 else 0 end") -> str:
    return rf"""
    {sql.LINES}, b as (select ('0x' || md5(source)[1:12])::bigint as doc_id, doc_id as page_no, line_no as elem_idx, {content} as content, length({content}) as len, {x0} as x0, 72.0 + 14 * (line_no % 48) as y0 from lines),
    e as (select doc_id, page_no, elem_idx, content, len, x0::double as x0, y0::double as y0, least(x0 + 5.0 * len, 540)::double as x1, (y0 + 11.0 * ceil(len / 94))::double as y1, {sql.collapsed('content')} as p from b)
"""


_ELEMENTS = _elements_sql()
_CLASSES = rf"""
    {_ELEMENTS}, m as (select *, length(p) as n, (y0 + y1) / 2 / 792 as cy, (x1 - x0) / 612 as wide, {sql.disclaimer('p')} as out from e),
    z as (select doc_id, page_no, count(*) as n_mid, min(x0) as zx0, min(y0) as zy0, max(x1) as zx1, max(y1) as zy1 from m where n > 0 and not out and cy between 0.20 and 0.88 and n <= 140 and wide <= 0.45 group by 1, 2),
    f as (select m.*, coalesce(n_mid, 0) as n_mid, coalesce(x0 < zx1 + 12 and x1 > zx0 - 12 and y0 < zy1 + 12 and y1 > zy0 - 12, false) as in_zone, cy <= 0.20 or cy >= 0.90 as edge,
        n >= 180 or (n >= 120 and wide >= 0.42) or (n >= 90 and wide >= 0.55 and y1 - y0 >= 20) as body from m left join z using (doc_id, page_no)),
    c as (select *, case when out then 'scattered' when body and not (edge and n < 180) then 'body' when not edge and not body and (in_zone or (n <= 140 and n_mid >= 8) or (n <= 140 and wide <= 0.35) or (n <= 40 and wide <= 0.25 and cy >= 0.22) or (n <= 80 and wide <= 0.30 and cy >= 0.22))
        then 'table' else 'scattered' end as layout_class from f)
"""
_ATOM = r"(?:\d+(?:\.\d+)*|[A-Za-z]|[ivxlcdmIVXLCDM]{1,8})"
_LEAD = rf"((regexp_matches(t, '^(?:{_ATOM}[.)]|\({_ATOM}\))\s+\S') and not regexp_matches(t, '^\((?:18|19|20)\d{{2}}\)\s')) or regexp_matches(t, '^[•▪●◦⁃∙\-*·]+\s+\S'))"
_MARKER = r"(length(t) <= 12 and regexp_full_match(t, '[•▪●◦⁃∙\-*·]+|\(?(?:\d{1,3}|[A-Za-z]|[ivxlcdmIVXLCDM]{1,8})[.)]\)?|[一-鿿]{1,3}[、.)]'))"
_HEADING = r"(length(t) <= 130 and len(regexp_extract_all(t, '\p{L}')) >= 4 and len(regexp_extract_all(t, '\p{Lu}')) >= 0.8 * len(regexp_extract_all(t, '\p{L}')))"
_YEAR = r"(?:18\d{2}|19\d{2}|20[0-2]\d)[a-z]?"
_REFERENCE = rf"(length(t) >= 18 and regexp_matches(t, '^\p{{Lu}}') and regexp_matches(t[1:180], '(^|[^\d]){_YEAR}([^\d]|$)') and regexp_matches(t[1:180], '([,(&]|(?i:\b(?:and|et\s+al)\b)).*?{_YEAR}'))"
_PLAIN = "b.t <> '' and not b.lead and not b.marker and not b.heading"
_BELOW = "b.y0 - g.y1 between -{up} * least(g.y1 - g.y0, b.y1 - b.y0) and {most}"
_SHARED = "greatest(least(g.x1, b.x1) - greatest(g.x0, b.x0), 0) / greatest(least(g.x1 - g.x0, b.x1 - b.x0), 1)"


def _merged_sql(opens: str, goes_on: str, elements: str = _ELEMENTS) -> str:
    """Groups of a page's lines in order: opens (over a line) lets a group begin, goes_on (over the last line g of a group, and the next
    line b) lets it grow."""
    return rf"""
        with recursive {elements}, o as (select *, trim(regexp_replace(content, '\s+', ' ', 'g')) as t from e),
        i as (select *, {_LEAD} as lead, {_MARKER} as marker, {_HEADING} as heading, {_REFERENCE} as entry, row_number() over (partition by doc_id, page_no order by y0, x0, elem_idx) as r from o),
        k as (select *, ({opens}) as opens from i),
        g as (
            select doc_id, page_no, r, elem_idx as head, opens, heading, x0 as first_x, null::double as rest_x, x0, y0, x1, y1, t from k where r = 1
            union all
            select b.doc_id, b.page_no, b.r, case when m.go then g.head else b.elem_idx end, case when m.go then g.opens else b.opens end, case when m.go then g.heading else b.heading end, case when m.go then g.first_x else b.x0 end,
                case when m.go then least(coalesce(g.rest_x, b.x0), b.x0) end, b.x0, b.y0, b.x1, b.y1, b.t
            from g join k b on b.doc_id = g.doc_id and b.page_no = g.page_no and b.r = g.r + 1, lateral (select g.opens and {goes_on} as go) m
        )
        select doc_id, page_no, head as elem_idx, md5(coalesce(string_agg(t, ' ' order by r) filter (where t <> ''), '')) as content, count(*) as n_merged from g group by 1, 2, 3
    """


_TEXTS = """
    t as (select p_partkey % 4 as doc_id, p_partkey % 6 as page_no, p_partkey as elem_idx, p_name as content, (p_partkey * 37 % 500)::double as x0, (p_partkey * 53 % 700)::double as y0, (p_partkey * 37 % 500)::double + 60 + p_partkey % 7 as x1, (p_partkey * 53 % 700)::double + 12 + p_partkey % 5 as y1 from part),
    s as (select s_suppkey % 4 as doc_id, s_suppkey % 6 as page_no, s_suppkey as table_idx, (s_suppkey * 3 * 37 % 500)::double as sx0, (s_suppkey * 3 * 53 % 700)::double as sy0, (s_suppkey * 3 * 37 % 500)::double + 90 + s_suppkey * 3 % 7 as sx1, (s_suppkey * 3 * 53 % 700)::double + 12 + s_suppkey * 3 % 5 as sy1 from supplier),
    j as (select t.*, table_idx, sx0, sy0, sx1, sy1, greatest(least(x1, sx1) - greatest(x0, sx0), 0) * greatest(least(y1, sy1) - greatest(y0, sy0), 0) as shared from t join s using (doc_id, page_no))
"""
_MET = "x0 < sx1 + 0.5 and sx0 - 0.5 < x1 and y0 < sy1 + 0.5 and sy0 - 0.5 < y1"
_CELLS = """
    l as (select l_orderkey % 10 as doc_id, l_orderkey // 40 as page_no, l_orderkey * 10 + l_linenumber as k, l_linenumber, max(l_quantity) as l_quantity from lineitem group by 1, 2, 3, l_linenumber),
    cells as (select doc_id, page_no, k as elem_idx, case k % 3 when 0 then 'Units ' || l_quantity::bigint when 1 then 'No figure stands in this sentence of the cell' else 'x' end as content, case when l_linenumber % 4 = 0 then 'body' else 'table' end as layout_class from l),
    tab as (select doc_id, page_no from cells group by 1, 2 having 5 * count_if(layout_class = 'table' and regexp_matches(content, '[0-9]')) >= 2 * count_if(layout_class = 'table')
        and (count_if(layout_class = 'table') >= 10 or (count_if(layout_class = 'table') >= 4 and 2 * count_if(layout_class = 'table') >= count(*))))
"""
_BLOCKS = f"{sql.LINES}, l as (select doc_id, line_no, line, length(line) as n from lines)"

ORACLES = {
    "layout_classes": f"with {_CLASSES} select doc_id, page_no, layout_class, count(*) as n from c group by 1, 2, 3",
    "element_rules": rf"""
        with {_CLASSES}, u as ({sql.rule('doc_id, page_no, elem_idx, layout_class, p', 'c')}), {shape_queries.label_steps('rule, layout_class', 'u')},
        g as (select layout_class, case when rule is not null then rule when layout_class = 'body' then 'translate' when {sql.structured_row('p')} then 'structured_row' when {shape_queries.IS_CONTACT} then 'contact'
            when regexp_matches(p, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') then 'date' when {shape_queries.IS_LABEL} then 'translate' when {shape_queries.IS_NAME} then 'proper_name' when {shape_queries.IS_TINY} then 'tiny_label' else 'translate' end as rule from w)
        select layout_class, rule, count(*) as n from g group by 1, 2
    """,
    "merged_lines": _merged_sql(
        "lead or length(t) >= 45", f"{_PLAIN} and {_BELOW.format(up=0.35, most='greatest(14.5, 8, 1.3 * greatest(g.y1 - g.y0, b.y1 - b.y0, 1))')} and {_SHARED} >= 0.35 and abs(b.x0 - g.x0) <= greatest(50, 42, 0.14 * 612) and not coalesce(b.x0 - g.rest_x >= 18, false) and not (abs(b.x0 - g.first_x) <= 5 and b.entry)"
    ),
    "merged_items": _merged_sql("lead", f"{_PLAIN} and {_BELOW.format(up=0.25, most='11.5')} and {_SHARED} >= 0.30 and b.x0 - g.first_x between 4.5 and greatest(55, 48, 0.16 * 612)", _elements_sql("case when line_no % 3 = 0 then '• ' || line else line end", "case when line_no % 3 = 0 then 72 else 84 end")),
    "merged_blocks": _merged_sql(
        "length(t) >= 35", rf"length(g.t) >= 8 and length(b.t) >= 12 and not regexp_matches(g.t, '[.!?。！？][\"''’”）)\]]*$') and not regexp_matches(g.t || b.t, '[.․‥…·]{{6,}}') and not b.lead and not b.marker and {_BELOW.format(up=0.40, most='5.5')} and {_SHARED} >= 0.35 "
        r"and b.x0 - g.x0 between -3.5 and greatest(40, 32, 0.08 * 612) and (not regexp_matches(regexp_replace(b.t, '^[\s\"''“”‘’(\[]+', ''), '^[\p{Lu}\p{Nd}]') or b.x0 - g.x0 >= 8)",
        _elements_sql(r"case when line_no % 3 = 0 then line else lower(regexp_replace(line, '[.!?]+\s*$', '')) end", "72"),
    ),
    "merged_headings": _merged_sql("t <> ''", f"g.heading and b.heading and not b.lead and {_BELOW.format(up=0.35, most='8')}", _elements_sql("case when line_no % 3 < 2 then upper(replace(line[1:60], 'ß', 'ss')) else line end", "72")),
    "merged_entries": _merged_sql("entry", rf"b.t <> '' and {_BELOW.format(up=0.35, most='12')} and (b.x0 >= g.first_x + 5 or not (b.entry or regexp_matches(b.t, '^\p{{Lu}}')))", _elements_sql("case when line_no % 3 = 0 then 'Smith, J. (1999). ' || line else lower(line) end", "case when line_no % 3 = 0 then 72 else 80 end")),
    "page_stamps": rf"""
        with {_ELEMENTS}, t as (select doc_id, page_no, elem_idx, lower(p) as t from e where length(p) between 4 and 120), n as (select doc_id, count(distinct page_no) as n_pages from e group by 1),
        r as (select doc_id, t from t join n using (doc_id) group by 1, 2, n_pages having count(distinct page_no) >= case when n_pages <= 6 then 2 else 3 end)
        select doc_id, page_no, elem_idx from t join r using (doc_id, t)
    """,
    "reading_ranks": f"with {_ELEMENTS}, r as (select doc_id, page_no, elem_idx, row_number() over (partition by doc_id, page_no order by y0, x0, elem_idx) - 1 as rank from e) select doc_id, page_no, sum(rank * elem_idx)::bigint as mark, max(rank) as last from r group by 1, 2",
    "cross_page": rf"""
        with {_ELEMENTS}, d as (select page_no, elem_idx, p, y0, x0 from e where (y0 + y1) / 2 / 792 > 0.08 and (y0 + y1) / 2 / 792 < 0.88 and 9.0 + elem_idx % 4 >= 0.88 * 10.5 and 9.0 + elem_idx % 4 < 1.18 * 10.5),
        w as (select page_no, last(elem_idx order by y0, x0, elem_idx) as l, last(p order by y0, x0, elem_idx) as lp, first(elem_idx order by y0, x0, elem_idx) as f, first(p order by y0, x0, elem_idx) as fp from d group by 1),
        j as (select a.page_no, a.l as from_idx, n.f as to_idx, not {sql.ends_sentence('a.lp')} as dangling, regexp_extract(n.fp, '\p{{L}}') as c from w a join w n on n.page_no = a.page_no + 1),
        k as (select page_no, from_idx, to_idx, dangling, c <> '' and lower(c) = c and upper(c) <> c as lower_start from j) select * from k where dangling or lower_start
    """,
    "main_fonts": "with s as (select source, round_even(2 * (8 + doc_id % 13 / 3.0::double), 0) / 2 as size, sum(greatest(n_chars::double, 0.1)) as w from documents group by 1, 2) select source, size from s qualify row_number() over (partition by source order by w desc, size desc) = 1",
    "line_cells": """
        with p as (select p_partkey % 5 as doc_id, p_partkey % 3 as page_no, p_partkey % 11 as line_no, p_size * 7.0::double + p_partkey % 13 as x0, p_size * 7.0::double + p_partkey % 13 + 20 + p_partkey % 17 as x1 from part),
        s as (select doc_id, page_no, line_no, x0, max(x1) as x1 from p group by 1, 2, 3, 4),
        c as (select doc_id, page_no, line_no, x0 - lag(x1) over (partition by doc_id, page_no, line_no order by x0, x1) > 12 as cut from s)
        select doc_id, page_no, line_no, count(*) as n, 1 + count_if(coalesce(cut, false))::bigint as n_cells from c group by 1, 2, 3
    """,
    "block_paragraphs": rf"""
        with {_BLOCKS}, b as (select doc_id, line_no, 72.0::double + n % 4 * 6 as x0, 14.0::double * line_no + n % 3 * 2 as y0 from l),
        q as (select *, min(x0) over (partition by doc_id) as base, lag(x0) over w as px, lag(y0 + 10) over w as py from b window w as (partition by doc_id order by line_no)),
        o as (select doc_id, line_no, case when px is null or y0 - py > 5.5 or (abs(x0 - px) > 9 and (x0 - base > 4.5 or px - base > 4.5)) or (x0 - base > 9 and px - base <= 4.5) then 1 else 0 end as new from q),
        r as (select doc_id, line_no, sum(new) over (partition by doc_id order by line_no) - 1 as paragraph from o) select doc_id, paragraph::bigint as paragraph, min(line_no) as first, count(*) as n from r group by 1, 2
    """,
    "block_alignment": rf"""
        with {_BLOCKS}, b as (select doc_id, length(trim(line[1:60])) as len, 72.0::double + n % 4 * 6 as a, 72.0::double + n % 4 * 6 + least(n * 5.0::double, 400) as z from l),
        m as (select doc_id, len, case when doc_id % 3 = 0 then 500 - z + a else a end as x0, case when doc_id % 3 = 0 then 500 else z end as x1 from b),
        g as (select doc_id, count(*) as n, avg(greatest(x0 - 60, 0)) as l, avg(greatest(500 - x1, 0)) as r, max(x0) - min(x0) as s0, max(x1) - min(x1) as s1, max(abs((x0 + x1) / 2 - 280)) as c, max(len) as longest from m group by 1)
        select doc_id, case when n = 1 then case when l >= 20 and r <= 6 then 'right' else 'left' end when longest <= 80 and s1 <= 7 and s0 >= s1 + 8 and r <= 4.5 then 'right' when longest <= 80 and c <= 18 and abs(l - r) <= 10 then 'center'
            when s0 <= 7 and l <= r + 7 then 'left' when s1 <= 7 and r < l then 'right' else 'left' end as align from g
    """,
    "touching_boxes": f"with {_TEXTS} select elem_idx, table_idx, shared from j where {_MET}",
    "shallow_overlaps": f"""with {_TEXTS}, o as (select elem_idx, content, least(y1, sy1) - greatest(y0, sy0) as deep, {_MET} as met from j)
        select elem_idx, bool_or(deep > 3.5 or length(content) < 20) as promoted from o where met group by 1""",
    "images_outside": f"with {_TEXTS} select elem_idx from t where elem_idx not in (select elem_idx from j where x0 < sx1 and sx0 < x1 and y0 < sy1 and sy0 < y1 and shared > 0.1 * ((x1 - x0) * (y1 - y0)))",
    "marker_targets": f"""
        with {_TEXTS}, p as (select m.elem_idx as marker_idx, o.elem_idx as target_idx, o.x0 - m.x1 as gap, abs((m.y0 + m.y1) / 2 - (o.y0 + o.y1) / 2) as centre, greatest(least(m.y1, o.y1) - greatest(m.y0, o.y0), 0) / greatest(least(m.y1 - m.y0, o.y1 - o.y0), 1e-6) as shared
            from t m join t o using (doc_id, page_no) where m.elem_idx % 9 = 0 and o.elem_idx % 9 > 0 and length(o.content) >= 8)
        select marker_idx, target_idx, centre + 0.1 * gap as score from p where gap between 0 and 60 and (shared >= 0.35 or centre <= 6.5) qualify row_number() over (partition by marker_idx order by centre + 0.1 * gap, target_idx) = 1
    """,
    "groups_above": f"with {_TEXTS} select elem_idx as line_idx, table_idx as group_idx from j where sy1 <= y0 qualify row_number() over (partition by elem_idx order by sy1 desc, table_idx) = 1",
    "word_overlap": r"""
        with w as (select conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) as w from conversations)
        select a.conv_id, a.turn, round(case when len(a.w) > 0 then len(list_intersect(a.w, b.w)) / len(a.w) end, 6) as ratio from w a join w b on b.conv_id = a.conv_id and b.turn = a.turn + 1
    """,
    "glossary_hits": r"""
        with g as (select distinct unnest(string_split_regex(text, '[^A-Za-z]+')[2:4]) as source from benchmark), k as (select doc_id, text, unnest(string_split_regex(text, '[^A-Za-z0-9]+')) as w from documents),
        h as (select doc_id, text, w as source, count(*) as n from k join g on w = source where length(w) >= 5 group by 1, 2, 3)
        select doc_id, source, upper(source) as target, n, length(regexp_extract(text, '(?s)^(.*?[^A-Za-z0-9]|)' || source || '(?:[^A-Za-z0-9]|$)', 1)) as first_offset from h
    """,
    "tabular": f"with {_CELLS} select * from tab",
    "frozen_tables": f"""
        with {_CELLS}, s as (select c.*, tab.doc_id is not null and layout_class = 'table' as marked, case when length(content) > 20 then length(content) else 0 end as n from cells c left join tab using (doc_id, page_no)),
        free as (select doc_id, page_no from s group by 1, 2 having sum(n) >= 200 and 2 * coalesce(sum(n) filter (where marked), 0) > sum(n))
        select doc_id, page_no, count(*) as n from s where marked and (doc_id, page_no) not in (select doc_id, page_no from free) group by 1, 2
    """,
    "formula_summary": f"""
        with {_CELLS}, s as (select doc_id, page_no, coalesce(sum(len(regexp_extract_all(content, '[0-9]'))) filter (where layout_class = 'body'), 0)::bigint as n_protected, coalesce(sum(len(regexp_extract_all(content, '[0-9]'))) filter (where layout_class <> 'body'), 0)::bigint as n_unprotected from cells group by 1, 2)
        select *, case when n_unprotected > 0 then 'review' when n_protected > 0 then 'protected' else 'none' end as status from s
    """,
    "warnings": """
        with w as (select user_id % 97 as doc_id, case when event_id % 50 > 0 then event_id % 7 end as page_no, event_type as kind from events), g as (select doc_id, page_no, count(*) as n, string_agg(distinct kind, ',' order by kind) as kinds from w group by 1, 2)
        select *, bool_or(page_no is null) over (partition by doc_id) as unscoped from g
    """,
    "fallback_closure": """
        with recursive e as (select user_id % 9 as doc_id, event_id % 400 as page_no, event_type, event_id from events), m as (select distinct doc_id, page_no from e where event_type = 'click' and event_id % 5 > 1),
        f as (select distinct doc_id, page_no from e where event_id % 61 = 0), c as (
            select * from f union select m.doc_id, case when m.page_no = c.page_no then m.page_no + 1 else m.page_no end from c join m on m.doc_id = c.doc_id and (m.page_no = c.page_no or m.page_no + 1 = c.page_no)
        ) select * from c
    """,
    "glyphs": """
        with s as (select l_orderkey % 5 as doc_id, l_orderkey % 3 as page_no, strftime(l_shipdate, '%Y-%m') as text, l_returnflag as font, l_quantity + l_linenumber * 0.125::double as q, l_orderkey * 10 + l_linenumber as ord from lineitem)
        select doc_id, page_no, ord from (select distinct * from s) qualify row_number() over (partition by doc_id, page_no, text, font, round_even(q / 0.5, 0), round_even((q + 5) / 0.5, 0), round_even((q + 9) / 0.5, 0) order by ord desc) = 1
    """,
    "formula_stubs": rf"""
        with {_ELEMENTS}, t as (select *, trim(content) as h, regexp_replace(p, '([.!?])\s*\d{{1,3}}\s*$', '\1') as q from e where elem_idx % 5 > 0),
        o as (select * from t where q <> '' and not {sql.ends_sentence('q')} and not (length(h) between 1 and 130 and len(regexp_extract_all(h, '\p{{L}}')) >= 4 and 5 * len(regexp_extract_all(h, '\p{{Lu}}')) >= 4 * len(regexp_extract_all(h, '\p{{L}}'))))
        select distinct o.doc_id, o.page_no, o.elem_idx from o join e f on f.doc_id = o.doc_id and f.page_no = o.page_no and f.elem_idx % 3 = 1 and f.y0 - o.y1 between -5 and 15 and f.x0 < o.x1 and o.x0 < f.x1 where o.y1 - o.y0 <= 2.6 * 12
    """,
    "page_styles": rf"""
        with {_CLASSES}, w as (select doc_id, page_no, layout_class, 7.0::double + elem_idx % 9 as size, elem_idx % 3 * 1118481 as color, greatest(length(trim(content)), 1)::double as w from c),
        s as (select doc_id, page_no, layout_class, size, sum(w) as w from w group by doc_id, page_no, layout_class, size qualify row_number() over (partition by doc_id, page_no, layout_class order by sum(w) desc, size desc) = 1),
        o as (select doc_id, page_no, layout_class, color, sum(w) as w from w group by doc_id, page_no, layout_class, color qualify row_number() over (partition by doc_id, page_no, layout_class order by sum(w) desc, color desc) = 1),
        a as (select doc_id, page_no, size as a, sum(w) as w from w group by doc_id, page_no, size qualify row_number() over (partition by doc_id, page_no order by sum(w) desc, size desc) = 1),
        k as (select doc_id, page_no, color as c, sum(w) as w from w group by doc_id, page_no, color qualify row_number() over (partition by doc_id, page_no order by sum(w) desc, color desc) = 1),
        l(layout_class, height, padding) as (values ('body', 1.42::double, 0.34::double), ('table', 1.24, 0.26), ('scattered', 1.30, 0.30)),
        j as (select a.doc_id, a.page_no, l.layout_class, height, padding, a, coalesce(o.color, c) as color, coalesce(s.size, case l.layout_class when 'body' then a when 'table' then greatest(7, case when a > 9 then a - 1 else a end) else greatest(8, least(a, 12)) end) as size
            from a join k using (doc_id, page_no) cross join l left join s on s.doc_id = a.doc_id and s.page_no = a.page_no and s.layout_class = l.layout_class left join o on o.doc_id = a.doc_id and o.page_no = a.page_no and o.layout_class = l.layout_class),
        y as (select *, case layout_class when 'body' then greatest(9, least(size, 13)) when 'table' then greatest(7, least(size, greatest(a, 9.5))) else greatest(8, least(size, 12)) end::double as fontsize from j)
        select doc_id, page_no, layout_class, fontsize, round(fontsize * height, 6) as line_height, color, '#' || lower(lpad(to_hex(color), 6, '0')) as color_hex, padding from y
    """,
    "kept_lines": rf"""
        with {_BLOCKS}, b as (select doc_id, trim(line[1:20]) as p, 72.0::double + n % 4 * 6 as a, 72.0::double + n % 4 * 6 + least(n * 5.0::double, 400) as z from l where line_no < 5),
        m as (select doc_id, p, case when doc_id % 3 = 0 then 500 - z + a else a end as x0, case when doc_id % 3 = 0 then 500 else z end as x1 from b),
        g as (select doc_id, count(*) as n, avg(greatest(x0 - 60, 0)) as l, avg(greatest(500 - x1, 0)) as r, max(x0) - min(x0) as s0, max(x1) - min(x1) as s1, max(abs((x0 + x1) / 2 - 280)) as c, sum(length({sql.squeezed('p')})) as al, min(length({sql.squeezed('p')})) as le from m group by 1)
        select doc_id from g where n between 2 and 8 and le > 0 and al <= 180 and s0 <= 25 and ((s1 <= 7 and s0 >= s1 + 8 and r <= 4.5) or (c <= 18 and abs(l - r) <= 10) or (not (s0 <= 7 and l <= r + 7) and s1 <= 7 and r < l))
    """,
    "repeated_columns": r"""
        with d as (select l_orderkey as k, l_linenumber - 1 as n, min(l_returnflag) as f from lineitem group by 1, 2),
        c as (select k % 7 as doc_id, k as block, n::bigint as line_no, f || ' ' || case when k % 3 = 0 then 'goes on' else 'Total.' end as plain, 80.0::double * (n % 2) + case when k % 5 = 0 then 9 * (n % 4) else 0 end as x0, 14.0::double * (n // 2) as y0 from d),
        q as (select *, x0 + 60 as x1, coalesce(abs(y0 - lag(y0) over w) <= 3.5 and x0 >= lag(x0 + 60) over w - 0.5, false) as level from c window w as (partition by block order by line_no)),
        r as (select *, sum(case when level then 0 else 1 end) over (partition by block order by line_no) as row from q),
        g as (select doc_id, block, row, min(line_no) as line_no, min(y0) as y0, list(x0 order by line_no) as a, list(x1 order by line_no) as z, last(plain order by line_no) as tail, first(plain order by line_no) as head from r group by 1, 2, 3 having count(*) >= 2),
        p as (select *, lead(line_no) over w as nl, lead(y0) over w as ny, lead(a) over w as na, lead(z) over w as nz, lead(head) over w as nh from g window w as (partition by block order by line_no)),
        o as (select * from p where nl is not null and len(a) = len(na) and ny - y0 > 0.5 and ny - y0 <= 22 and abs(a[1] - na[1]) <= 3.5 and abs(z[len(z)] - nz[len(nz)]) <= 3.5
            and len(list_filter(range(1, len(a) + 1), lambda i: not (abs(a[i] - na[i]) <= 3.5 or abs(z[i] - nz[i]) <= 3.5))) = 0 and len(list_filter(range(1, len(a)), lambda i: not (abs(z[i] - nz[i]) <= 3.5 and abs(a[i + 1] - na[i + 1]) <= 3.5))) = 0
            and not (not regexp_matches(tail, '[.!?]$') and regexp_matches(nh, '^\p{Ll}')))
        select doc_id, block, count(*) as n, min(line_no) as first from (select doc_id, block, line_no from o union select doc_id, block, nl from o) group by 1, 2
    """,
    "sentence_tails": rf"""
        with {sql.LINES}, a as (select doc_id, line_no, regexp_replace({sql.collapsed('line')}, '(?i)(^|[^\p{{L}}\p{{N}}_])({'|'.join(fixed.ABBREVIATIONS).replace('.', chr(92) + '.')}|et\s+al)\.(\s)', '\1\2_\3', 'g') as p from lines),
        p as (select doc_id, line_no, regexp_replace(p, '((?:^|[^\p{{L}}\p{{N}}_])[A-Za-z]\.[A-Za-z])\.(\s)', '\1_\2', 'g') as p from a),
        t as (select doc_id, line_no, regexp_extract(p, '(?s)^(.*?[!-#%-''*./:;?@\\¡§¶·¿…‰′″)\]}}»’”][\"''’”)\]}}》〉」』]*(?:(?:\d{{1,3}}|[*†‡§¶]{{1,3}}))?)($|\s+[^\p{{L}}\p{{N}}]*[\p{{Lu}}\p{{N}}⺀-鿿].*$)', ['tail', 'rest']) as r from p)
        select doc_id, line_no, length(r.tail) as n_tail, length(trim(r.rest)) as n_rest from t where r.tail <> '' and length(r.tail) <= 120
    """,
    "display_titles": rf"""
        with i as (select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
            || case p_partkey % 4 when 0 then ' Bank' when 1 then ', ABC' else '' end as p from part), w as (select *, {shape_queries.words('p')} as w from i)
        select p_partkey, 10 + p_partkey % 10 >= 15 and p_partkey // 10 % 3 >= 2 and p_partkey % 6 <> 0 and length(p) <= 180 and not regexp_matches(p, ',\s*[A-Z][A-Z0-9&.\-]{{1,11}}\s*$') and len(w) between 4 and 20
            and lower(w[1]) not in {sql.names(policy.HONORIFICS)} and lower(w[len(w)]) not in {sql.names(fixed.IDENTITY_END_WORDS)} as is_title from w
    """,
    "reference_verdicts": "select c_custkey, case c_custkey % 7 when 1 then 'lead changed' when 2 then 'not translated' when 3 then 'identifiers changed' when 4 then 'numbers lost' when 5 then 'too little Chinese' when 6 then 'title not translated' end as reason from customer",
    "merge_violations": rf"""
        with t as (select conv_id as doc_id, turn, case when turn % 5 = 4 then 'table' else 'body' end as layout, {sql.collapsed('text')} as p, conv_id * 3 + turn * 5 as k from conversations),
        d as (select a.doc_id, a.turn as decision_idx, a.k, a.layout as sl, b.layout as dl, b.p as dp, a.p as sp, regexp_extract(b.p, '[\p{{L}}\p{{N}}]') as f from t a left join t b on b.doc_id = a.doc_id and b.turn = a.turn + 1 where a.k % 9 <> 0),
        s as (select *, case when f = '' then 'none' when regexp_matches(f, '^\p{{Ll}}') then 'lower' when regexp_matches(f, '^\p{{Lu}}') then 'upper' when regexp_matches(f, '^\p{{N}}') then 'digit' else 'letter' end as start from d),
        v as (select doc_id, decision_idx, case when k % 7 = 0 then 'unknown-merge-kind' when k % 8 = 0 then 'accepted-reason' when dp is null then 'merge-evidence-missing' when sl <> 'body' or dl <> 'body' then 'body-layout'
            when case when k % 4 = 0 then 'lower' else 'upper' end <> start then 'destination-start-metadata-mismatch' when {sql.ends_sentence('sp')} and start <> 'lower' then 'complete-source' when k % 5 = 0 then 'page-orientation' end as invariant from s)
        select * from v where invariant is not null
    """,
    "paragraph_elements": f"""
        with {_TEXTS}, w as (select elem_idx, x0, y0, x1, y1, content, case when elem_idx % 3 = 0 then string_split(content, ' ') end as ws from t),
        u as (select elem_idx, x0, y0, ws, unnest(range(1, len(ws) + 1)) as i from w where ws is not null)
        select elem_idx, i - 1 as part, ws[i] as content, x0 + 1 as x0, y0 + 12 * (i - 1) + 10 as y1 from u union all select elem_idx, 0, content, x0, y1 from w where ws is null
    """,
    "table_cells": f"""
        with recursive {_TEXTS}, o as (select doc_id, page_no, elem_idx, x0, y0, row_number() over (partition by doc_id, page_no order by y0, x0) as r, row_number() over (partition by doc_id, page_no order by x0) as c from t),
        b as (select doc_id, page_no, elem_idx, r, y0, 0 as band, y0 as total, 1 as n from o where r = 1
            union all select o.doc_id, o.page_no, o.elem_idx, o.r, o.y0, case when m.go then b.band else b.band + 1 end, case when m.go then b.total + o.y0 else o.y0 end, case when m.go then b.n + 1 else 1 end
            from b join o on o.doc_id = b.doc_id and o.page_no = b.page_no and o.r = b.r + 1, lateral (select abs(o.y0 - b.total / b.n) <= 4.2::double as go) m),
        a as (select doc_id, page_no, c, x0 as anchor from o where c = 1
            union all select o.doc_id, o.page_no, o.c, case when o.x0 - a.anchor > 14 then o.x0 else a.anchor end from a join o on o.doc_id = a.doc_id and o.page_no = a.page_no and o.c = a.c + 1),
        h as (select doc_id, page_no, band, avg(y0) as top from b group by 1, 2, 3),
        g as (select *, top - lag(top) over (partition by doc_id, page_no order by band) as gap from h),
        p as (select doc_id, page_no, list_sort(list(gap) filter (where gap is not null)) as gaps from g group by 1, 2),
        q as (select *, least(list_aggregate(gaps[1:(len(gaps) + 1) // 2], 'median'), 14) as pitch from p),
        w as (select g.doc_id, g.page_no, band, coalesce(gap > greatest(1.35::double * pitch, pitch + 0.3::double * 10), false) as wide from g join q using (doc_id, page_no)),
        v as (select *, bool_or(wide) over (partition by doc_id, page_no) as parted from w),
        z as (select doc_id, page_no, band, sum(case when band = 0 or wide or not parted then 1 else 0 end) over (partition by doc_id, page_no order by band) - 1 as row_no from v),
        k as (select doc_id, page_no, anchor, row_number() over (partition by doc_id, page_no order by anchor) - 1 as col from (select distinct doc_id, page_no, anchor from a)),
        f as (select o.elem_idx, arg_min(k.col, (abs(k.anchor - o.x0), k.col)) as col, min(abs(k.anchor - o.x0)) as far from o join k using (doc_id, page_no) group by 1)
        select b.elem_idx, z.row_no::bigint as row_no, case when far <= 28 then col end as col_no from b join z using (doc_id, page_no, band) join f on f.elem_idx = b.elem_idx
    """,
    "directories": rf"""
        with e as (select p_partkey % 3 as doc_id, p_partkey % 4 as page_no, p_partkey as k, case when p_partkey % 24 = 0 then 'List of members' when p_partkey % 11 = 0 then p_name else array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') end as p,
            p_partkey % 2 * 200.0::double as x0, 14.0::double * (p_partkey % 47) as y0 from part),
        l as (select distinct doc_id, page_no from e where p = 'List of members'),
        r as (select doc_id, page_no, k, x0, y0, regexp_replace(p, '\s+[a-z]\s*$', '') as p from e join l using (doc_id, page_no) where k % 13 <> 0 and length(p) between 1 and 90),
        w as (select *, {shape_queries.words('p')} as w from r),
        f as (select * from w where len(w) between 1 and 10 and {shape_queries.capitalised('w')} and regexp_matches({shape_queries.bare('p')}, '^[\s,&''’()\-./]*$')),
        c as (select *, case when x0 - lag(x0) over (partition by doc_id, page_no order by x0, y0, k) > 15 then 1 else 0 end as cut from f), d as (select *, sum(cut) over (partition by doc_id, page_no order by x0, y0, k) as col from c),
        g as (select *, case when y0 - lag(y0 + 10) over (partition by doc_id, page_no, col order by y0, k) > 50 then 1 else 0 end as far from d), u as (select *, sum(far) over (partition by doc_id, page_no, col order by y0, k) as run from g)
        select k as elem_idx from u qualify count(*) over (partition by doc_id, page_no, col, run) >= 5
    """,
    "tracking_codes": """
        with e as (select p_partkey % 2 as doc_id, p_partkey // 3 as page_no, p_partkey as k, case when p_partkey % 4 = 0 then 'qX' || p_partkey % 3 || 'b' || p_partkey % 2 || 'Zt7' else p_name end as t, p_partkey % 28 = 0 as body,
            case p_partkey % 3 when 0 then -5.0::double when 1 then 2 else 300 end as x0, p_partkey * 53 % 5 * 140.0::double as y0 from part),
        c as (select *, count(*) over (partition by doc_id, page_no) as n from e where not body and regexp_full_match(t, '[A-Za-z0-9]{8,40}') and regexp_matches(t, '[a-z]') and regexp_matches(t, '[A-Z]') and len(regexp_extract_all(t, '[A-Za-z]+|[0-9]+')) >= 4 and not regexp_matches(t, '[A-Z][a-z]{3,}|[a-z]{4,}')),
        b as (select *, x0 <= -0.5 or y0 <= -0.5 or x0 + 30 >= 612.5 or y0 + 10 >= 792.5 as out from c where n <= 3 and (x0 <= -0.5 or y0 <= -0.5 or x0 + 30 >= 612.5 or y0 + 10 >= 792.5 or x0 + 30 <= 0.06 * 612 or x0 >= 0.94 * 612 or y0 + 10 <= 0.06 * 792 or y0 >= 0.94 * 792)),
        a as (select * from b where not exists (select 1 from e where e.doc_id = b.doc_id and e.page_no = b.page_no and e.k <> b.k and b.x0 < e.x0 + 30 and e.x0 < b.x0 + 30 and b.y0 < e.y0 + 10 and e.y0 < b.y0 + 10)),
        p as (select doc_id, t, round_even(x0 / 612 / 0.03::double, 0) as qx, round_even(y0 / 792 / 0.03::double, 0) as qy, count(distinct page_no) as n_pages from a group by 1, 2, 3, 4)
        select k as elem_idx from a join p on p.doc_id = a.doc_id and p.t = a.t and qx = round_even(x0 / 612 / 0.03::double, 0) and qy = round_even(y0 / 792 / 0.03::double, 0) where out or n_pages >= 2
    """,
}
