"""Boxes of text on pages: classes, paragraphs, merges of what a page's layout has split, tables.

elements: doc_id, page_no, elem_idx, content, x0, y0, x1, y1, fontsize, bold, color, and optional hints (table_hint, align, n_paragraphs,
non_horizontal, skip). pages: doc_id, page_no, width, height. Passes that compare only neighbours are windows; those whose rule
looks at the open group run over one page at a time, and a page is small.
"""

from __future__ import annotations

import re
import statistics
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, font_bucket, has_terminal_boundary, is_disclaimer, plain_text, squeezed

ELEMENTS = "doc_id long, page_no long, elem_idx int, content string, x0 double, y0 double, x1 double, y1 double, fontsize double, bold boolean, color int"
PAGE = ["doc_id", "page_no"]


def classified(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """elements with layout_class: body, table or scattered.

    Body is long or wide text. Eight or more short pieces in the middle of a page make it a dense table page, and the box around
    them its table zone.
    """

    def hint(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in elements.columns else F.lit(default)

    e = elements.join(pages, PAGE).withColumn("plain", collapsed("content"))
    e = e.withColumns(
        {
            "n": F.length("plain"), "cy": (F.col("y0") + F.col("y1")) / 2 / F.greatest("height", F.lit(1.0)), "wide": (F.col("x1") - F.col("x0")) / F.greatest("width", F.lit(1.0)),
            "aside": hint("align", "left") != "left", "paras": hint("n_paragraphs", 1), "stamped": hint("skip", "") == "watermark", "bucket": font_bucket("fontsize"),
        }
    )
    weights = e.groupBy(*PAGE, "bucket").agg(F.sum(F.greatest(F.col("n").cast("double"), F.lit(1.0))).alias("w"))
    fonts = weights.groupBy(*PAGE).agg(F.max(F.struct("w", "bucket"))["bucket"].alias("main_font"))
    out_of_play = F.col("stamped") | is_disclaimer("plain")
    short = (F.col("n") <= 140) & (F.col("paras") <= 2)
    middle = (F.col("n") > 0) & ~out_of_play & F.col("cy").between(0.20, 0.88) & short & ((F.col("wide") <= 0.45) | F.col("aside"))
    zone = e.filter(middle).groupBy(*PAGE).agg(F.count("*").alias("n_mid"), F.min("x0").alias("zx0"), F.min("y0").alias("zy0"), F.max("x1").alias("zx1"), F.max("y1").alias("zy1"))
    e = e.join(fonts, PAGE).join(zone, PAGE, "left")
    edge = (F.col("cy") <= 0.20) | (F.col("cy") >= 0.90)
    stacked = (F.col("paras") >= 2) & (F.col("n") <= 140) & (F.col("wide") <= 0.45)
    height = F.col("y1") - F.col("y0")
    body = (
        ((F.col("paras") >= 2) & ~stacked) | (F.col("n") >= 180) | ((F.col("n") >= 120) & (F.col("wide") >= 0.42))
        | ((F.col("n") >= 90) & (F.col("wide") >= 0.55) & (height >= F.greatest(2 * F.col("fontsize"), F.lit(18.0))))
    )
    in_zone = F.coalesce((F.col("x0") < F.col("zx1") + 12) & (F.col("x1") > F.col("zx0") - 12) & (F.col("y0") < F.col("zy1") + 12) & (F.col("y1") > F.col("zy0") - 12), F.lit(False))
    table = ~edge & ~body & (
        in_zone | (short & (F.coalesce("n_mid", F.lit(0)) >= 8)) | (short & ((F.col("wide") <= 0.35) | F.col("aside"))) | stacked
        | ((F.col("n") <= 40) & (F.col("wide") <= 0.25) & (F.col("cy") >= 0.22))
        | ((F.col("n") <= 80) & (F.col("fontsize") <= F.col("main_font")) & (F.col("wide") <= 0.30) & (F.col("cy") >= 0.22))
    )
    layout = F.when(out_of_play, "scattered").when(hint("table_hint", False), "table").when(body & ~(edge & (F.col("n") < 180)), "body").when(table, "table").otherwise("scattered")
    return e.withColumn("layout_class", layout).select(*elements.columns, "layout_class")


def is_body_prose(main_font: Column) -> Column:
    """Body type, eight words, and either twelve or more than one line."""
    n = F.regexp_count(collapsed("content"), F.lit("[A-Za-z][A-Za-z'’-]*"))
    wraps = (F.col("y1") - F.col("y0")) > 1.6 * F.greatest(1.2 * F.col("fontsize"), F.lit(8.0))
    return (n >= 8) & (F.col("fontsize") >= 0.92 * main_font) & ((n >= 12) | wraps)


def formula_risk(symbols: Column) -> Column:
    """More unprotected symbols than prose of that length may carry: none under four long words, else 2 and one for sixty, 8 at most."""
    words = F.regexp_count(collapsed("content"), F.lit("[A-Za-z]{4,}"))
    allowed = F.when(words < 4, 0).otherwise(F.least(F.lit(8), 2 + F.floor(words / 60)))
    return symbols > allowed


def reading_order(elements: DataFrame) -> DataFrame:
    """elements with their rank on the page, by top and left edge."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "elem_idx")
    return elements.withColumn("rank", F.row_number().over(w) - 1)


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page_no, block, line_no, plain, x0, y0, x1, y1, fontsize) with the paragraph each is in.

    A new one begins at a gap, at a shift from or to an indent, and at a fresh indent.
    """
    block = Window.partitionBy(*PAGE, "block")
    order = block.orderBy("line_no")
    high, base = F.avg(F.col("y1") - F.col("y0")).over(block), F.min("x0").over(block)
    rows = lines.withColumns({"__h": high, "__base": base, "__px": F.lag("x0").over(order), "__py": F.lag("y1").over(order)})
    indent, gap = F.greatest(0.9 * F.col("fontsize"), 0.8 * F.col("__h"), F.lit(8.0)), F.greatest(0.55 * F.col("fontsize"), 0.4 * F.col("__h"), F.lit(4.0))
    here, before = F.col("x0") - F.col("__base"), F.col("__px") - F.col("__base")
    new = ((F.col("y0") - F.col("__py")) > gap) | ((F.abs(F.col("x0") - F.col("__px")) > indent) & ((here > indent / 2) | (before > indent / 2))) | ((here > indent) & (before <= indent / 2))
    opened = rows.withColumn("__new", F.coalesce(new.cast("int"), F.lit(1)))
    return opened.withColumn("paragraph", F.sum("__new").over(order) - 1).drop("__h", "__base", "__px", "__py", "__new")


def cells(spans: DataFrame, gap_em: float = 2.0) -> DataFrame:
    """Spans of a visual line (doc_id, page_no, line_no, x0, x1, fontsize) with the cell each is in: cut where the gap is wide."""
    w = Window.partitionBy(*PAGE, "line_no").orderBy("x0", "x1")
    cut = F.coalesce((F.col("x0") - F.lag("x1").over(w) > F.greatest(gap_em * F.col("fontsize"), F.lit(12.0))).cast("int"), F.lit(0))
    return spans.withColumn("__cut", cut).withColumn("cell", F.sum("__cut").over(w)).drop("__cut")


def kept_apart(lines: DataFrame, aligned: DataFrame) -> DataFrame:
    """(doc_id, page_no, block) of blocks whose lines stay lines: two to eight short ones that aren't set to the left. aligned: of
    policy.text_align."""
    plain = squeezed(F.col("plain"))
    sums = lines.withColumn("__n", F.length(plain)).groupBy(*PAGE, "block").agg(
        F.count("*").alias("n"), F.min("__n").alias("least"), F.max("__n").alias("most"), F.sum("__n").alias("all"), (F.max("x0") - F.min("x0")).alias("spread"), F.max("fontsize").alias("em")
    )
    small = F.col("n").between(2, 8) & (F.col("least") > 0) & (F.col("most") <= 40) & (F.col("all") <= 180) & (F.col("spread") <= F.greatest(2.5 * F.col("em"), F.lit(24.0)))
    return sums.filter(small).join(aligned.filter("align <> 'left'"), [*PAGE, "block"]).select(*PAGE, "block")


def repeated_columns(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, block, line_no) of the first lines of rows that repeat their columns right below each other: a table that
    nobody drew. Lines (also with plain) that follow each other on one baseline are a row."""
    order = Window.partitionBy(*PAGE, "block").orderBy("line_no")
    level = (F.abs(F.col("y0") - F.lag("y0").over(order)) <= F.greatest(0.35 * F.col("fontsize"), F.lit(2.0))) & (F.col("x0") >= F.lag("x1").over(order) - 0.5)
    rows = lines.withColumn("__opens", F.coalesce((~level).cast("int"), F.lit(1))).withColumn("__row", F.sum("__opens").over(order))
    cells = F.array_sort(F.collect_list(F.struct("line_no", "x0", "x1", "plain")))
    rows = rows.groupBy(*PAGE, "block", "__row").agg(F.min("line_no").alias("line_no"), F.min("y0").alias("y0"), F.max("fontsize").alias("em"), cells.alias("cells")).filter(F.size("cells") >= 2)
    after = Window.partitionBy(*PAGE, "block").orderBy("line_no")
    nxt = F.lead(F.struct("line_no", "y0", "em", "cells")).over(after)
    pairs = rows.withColumn("b", nxt).filter("b is not null")
    a, b = F.col("cells"), F.col("b.cells")
    em = F.greatest("em", "b.em")
    tolerance, down = F.greatest(F.lit(2.0), 0.35 * em), F.col("b.y0") - F.col("y0")
    near = lambda x, y: F.abs(x - y) <= tolerance
    last = lambda c, k: F.element_at(c, -1)[k]
    columns = F.forall(F.arrays_zip(a.alias("l"), b.alias("r")), lambda z: near(z["l"]["x0"], z["r"]["x0"]) | near(z["l"]["x1"], z["r"]["x1"]))
    inner = F.arrays_zip(F.slice(a, 1, F.size(a) - 1).alias("l"), F.slice(b, 1, F.size(b) - 1).alias("r"), F.slice(a, 2, F.size(a)).alias("ln"), F.slice(b, 2, F.size(b)).alias("rn"))
    dividers = F.forall(inner, lambda z: near(z["l"]["x1"], z["r"]["x1"]) & near(z["ln"]["x0"], z["rn"]["x0"]))
    tail, head = squeezed(last(a, "plain")), squeezed(b[0]["plain"])
    wraps = (tail != "") & (head != "") & ~has_terminal_boundary(tail) & head.rlike(r"^\p{Ll}")
    same = (F.size(a) == F.size(b)) & (down > 0.5) & (down <= F.greatest(2.2 * em, F.lit(18.0))) & near(a[0]["x0"], b[0]["x0"]) & near(last(a, "x1"), last(b, "x1")) & columns & dividers & ~wraps
    found = pairs.filter(same).select(*PAGE, "block", F.explode(F.array(F.col("line_no"), F.col("b.line_no"))).alias("line_no"))
    return found.distinct()


#: Of each class of layout: line height and padding in shares of the type.
CLASS_STYLES = {"body": (1.42, 0.34), "table": (1.24, 0.26), "scattered": (1.30, 0.30)}


def page_styles(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, layout_class, fontsize, line_height, color, color_hex, padding): the commonest type and colour of each class on
    each page, by length of text (of equals the larger value), in bounds; a class that a page lacks goes by the whole page."""
    weighed = elements.select(*PAGE, "layout_class", font_bucket("fontsize").alias("size"), F.coalesce("color", F.lit(0)).alias("color"), F.greatest(F.length(F.trim(plain_text("content"))), F.lit(1)).cast("double").alias("w"))

    def most(value: str, *by: str) -> DataFrame:
        sums = weighed.groupBy(*by, value).agg(F.sum("w").alias("w"))
        return sums.groupBy(*by).agg(F.max(F.struct("w", value))[value].alias(value))

    whole = most("size", *PAGE).withColumnRenamed("size", "all_size").join(most("color", *PAGE).withColumnRenamed("color", "all_color"), PAGE)
    classes = F.explode(F.array(*(F.struct(F.lit(k).alias("layout_class"), F.lit(h).alias("height"), F.lit(p).alias("padding")) for k, (h, p) in CLASS_STYLES.items()))).alias("c")
    each = whole.select("*", classes).select(*PAGE, "all_size", "all_color", "c.*")
    each = each.join(most("size", *PAGE, "layout_class"), [*PAGE, "layout_class"], "left").join(most("color", *PAGE, "layout_class"), [*PAGE, "layout_class"], "left")
    a, is_class = F.col("all_size"), lambda k: F.col("layout_class") == k
    between = lambda x, low, high: F.greatest(F.lit(low), F.least(x, high if isinstance(high, Column) else F.lit(high)))
    fallback = F.when(is_class("body"), a).when(is_class("table"), F.greatest(F.lit(7.0), F.when(a > 9.0, a - 1.0).otherwise(a))).otherwise(between(a, 8.0, 12.0))
    size = F.coalesce("size", fallback)
    size = F.when(is_class("body"), between(size, 9.0, 13.0)).when(is_class("table"), between(size, 7.0, F.greatest(a, F.lit(9.5)))).otherwise(between(size, 8.0, 12.0))
    color = F.coalesce("color", "all_color")
    return each.select(*PAGE, "layout_class", size.alias("fontsize"), (size * F.col("height")).alias("line_height"), color.alias("color"), F.concat(F.lit("#"), F.lower(F.lpad(F.hex(color), 6, "0"))).alias("color_hex"), "padding")


def paragraph_elements(elements: DataFrame) -> DataFrame:
    """An element for each of an element's paragraphs (array<struct<plain, x0, y0, x1, y1>>, boxes relative to its corner): doc_id,
    page_no, elem_idx, part, content, x0, y0, x1, y1; one without paragraphs stays as it is."""
    own = F.array(F.struct(F.col("content").alias("plain"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("x1") - F.col("x0")).alias("x1"), (F.col("y1") - F.col("y0")).alias("y1")))
    parts = F.when(F.size(F.coalesce("paragraphs", F.array())) > 0, F.col("paragraphs")).otherwise(own)
    each = elements.select(*PAGE, "elem_idx", "x0", "y0", F.posexplode(parts).alias("part", "p"))
    return each.select(*PAGE, "elem_idx", "part", F.col("p.plain").alias("content"), *((F.col(o) + F.col(f"p.{n}")).alias(n) for o, n in (("x0", "x0"), ("y0", "y0"), ("x0", "x1"), ("y0", "y1"))))


@dataclass
class Box:
    idx: int
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    em: float
    bold: bool
    color: int

    @property
    def height(self) -> float:
        return self.y1 - self.y0


_ATOM = r"(?:\d+(?:\.\d+)*|[A-Za-z]|[ivxlcdmIVXLCDM]{1,8})"
_BULLETS = r"[•▪●◦⁃∙\-*·]+"
_LEAD = re.compile(rf"(?!\((?:18|19|20)\d{{2}}\)\s)(?:{_ATOM}[.)]|\({_ATOM}\))\s+\S|{_BULLETS}\s+\S")
_MARKER = re.compile(rf"{_BULLETS}|\(?(?:\d{{1,3}}|[A-Za-z]|[ivxlcdmIVXLCDM]{{1,8}})[.)]\)?|[一-鿿]{{1,3}}[、.)]")
_TERMINAL = re.compile("[.!?。！？][\"'’”）)\\]]*$")


def _is_lead(text: str) -> bool:
    return bool(_LEAD.match(text))


def _is_marker(text: str) -> bool:
    return len(text) <= 12 and bool(_MARKER.fullmatch(text))


def _is_heading(b: Box) -> bool:
    letters = [c for c in b.text if c.isalpha()]
    return b.bold or (len(b.text) <= 130 and len(letters) >= 4 and sum(c.isupper() for c in letters) >= 0.8 * len(letters))


def _is_reference_lead(text: str) -> bool:
    year = re.search(r"(?<!\d)(?:18\d{2}|19\d{2}|20[0-2]\d)[a-z]?(?!\d)", text[:180])
    return len(text) >= 18 and text[0].isupper() and bool(year) and bool(re.search(r"[,(&]|(?i:\b(?:and|et\s+al)\b)", text[: year.start()]))


def _shared_width(a: Box, b: Box) -> float:
    return max(0.0, min(a.x1, b.x1) - max(a.x0, b.x0)) / max(min(a.x1 - a.x0, b.x1 - b.x0), 1.0)


def _like_color(a: int, b: int) -> bool:
    """The same, or two near blacks."""
    p, q = (((c or 0) >> 16 & 255, (c or 0) >> 8 & 255, (c or 0) & 255) for c in (a, b))
    neutral = all(max(c) - min(c) <= 6 and max(c) <= 80 for c in (p, q))
    return p == q or neutral and max(abs(x - y) for x, y in zip(p, q, strict=True)) <= 40


@dataclass(frozen=True)
class Limit:
    """The greatest of so many em, so much of the page's width, so much of the lines' height, and so many points."""

    em: float
    points: float
    page: float = 0.0
    line: float = 0.0

    def of(self, last: Box, box: Box, width: float) -> float:
        return max(self.em * last.em, self.points, self.page * width, self.line * max(last.height, box.height, 1.0))


@dataclass(frozen=True)
class MergeRule:
    """When a box goes on a group of boxes. What is None isn't asked."""

    opens: Callable[[str], bool]  # the text of the group's first box
    size: Limit  # by how much type may differ
    up: float  # how far the box may reach into the one above, in shares of the lesser height
    gap: Limit  # how far it may be below
    same_weight: bool = False
    same_color: bool = False
    shared: float = 0.0  # of the lesser width
    shift: tuple[Limit, Limit] | None = None  # how far to the left and right of the last box
    indent: tuple[Limit, Limit] | None = None  # least and most to the right of the first box
    goes_on: Callable[[list[Box], Box], bool] = lambda group, box: True  # what else the texts must show


def _is_long_or_lead(text: str) -> bool:
    return _is_lead(text) or len(text) >= 45


def _is_plain(box: Box) -> bool:
    return bool(box.text) and not (_is_lead(box.text) or _is_marker(box.text) or _is_heading(box))


def _keeps_the_margin(group: list[Box], box: Box) -> bool:
    """Neither indented again after wrapped lines, nor back at the margin as the next entry of a bibliography."""
    first, last = group[0], group[-1]
    again = len(group) > 1 and box.x0 - min(b.x0 for b in group[1:]) >= max(1.5 * last.em, 18.0)
    entry = abs(box.x0 - first.x0) <= max(0.5 * last.em, 4.0) and _is_reference_lead(box.text)
    return _is_plain(box) and not again and not entry


def _runs_on(group: list[Box], box: Box) -> bool:
    """Long enough, unfinished, without leaders; a capital or a figure needs a hanging indent."""
    last = group[-1]
    if len(last.text) < 8 or len(box.text) < 12 or _TERMINAL.search(last.text) or re.search("[.․‥…·]{6,}", last.text + box.text) or _is_lead(box.text) or _is_marker(box.text):
        return False
    opener = re.sub(r"^[\s\"'“”‘’(\[]+", "", box.text)[:1]
    return not (opener.isupper() or opener.isdigit()) or box.x0 - last.x0 >= max(0.8 * last.em, 6.0)


def _is_same_heading(group: list[Box], box: Box) -> bool:
    return _is_heading(group[0]) and _is_heading(box) and not _is_lead(box.text)


def _hangs(group: list[Box], box: Box) -> bool:
    """Indented under the entry, or no author at the margin."""
    first, last = group[0], group[-1]
    return bool(box.text) and (box.x0 >= first.x0 + max(0.5 * last.em, 4.0) or not (_is_reference_lead(box.text) or box.text[:1].isupper()))


RULES = {
    # Limits of the merges.
    "wrapped": MergeRule(_is_long_or_lead, Limit(0.08, 0.7), 0.35, Limit(1.45, 8.0, line=1.3), True, True, 0.35, (Limit(5.0, 42.0, page=0.14),) * 2, goes_on=_keeps_the_margin),
    "list": MergeRule(_is_lead, Limit(0.10, 0.8), 0.25, Limit(1.15, 9.0), True, True, 0.30, indent=(Limit(0.45, 3.0), Limit(5.5, 48.0, page=0.16)), goes_on=lambda group, box: _is_plain(box)),
    "strong": MergeRule(lambda text: len(text) >= 35, Limit(0.15, 1.0), 0.40, Limit(0.55, 4.5), False, False, 0.35, (Limit(0.35, 3.0), Limit(4.0, 32.0, page=0.08)), goes_on=_runs_on),
    "heading": MergeRule(bool, Limit(0.0, 0.5), 0.35, Limit(0.8, 0.0), True, goes_on=_is_same_heading),
    "reference": MergeRule(_is_reference_lead, Limit(0.10, 0.8), 0.35, Limit(1.2, 9.0), goes_on=_hangs),
}


def joins(rule: MergeRule, group: list[Box], box: Box, width: float) -> bool:
    """Whether the box goes on the group."""
    first, last = group[0], group[-1]
    limit = lambda of: of.of(last, box, width)
    below, right, indent = box.y0 - last.y1, box.x0 - last.x0, box.x0 - first.x0
    return (
        rule.opens(first.text)
        and (not rule.same_weight or last.bold == box.bold)
        and (not rule.same_color or _like_color(last.color, box.color))
        and abs(last.em - box.em) <= limit(rule.size)
        and -rule.up * min(last.height, box.height) <= below <= limit(rule.gap)
        and _shared_width(last, box) >= rule.shared
        and (rule.shift is None or -limit(rule.shift[0]) <= right <= limit(rule.shift[1]))
        and (rule.indent is None or limit(rule.indent[0]) <= indent <= limit(rule.indent[1]))
        and rule.goes_on(group, box)
    )


def adjacent_groups(boxes: list[Box], goes_on: Callable[[list[Box], Box], bool], starts: Callable[[Box], bool] = lambda _: True) -> Iterator[list[Box]]:
    """Runs in reading order: a box that may start opens a group, which takes the next ones as long as the rule lets them in."""
    group: list[Box] = []
    for b in boxes:
        if group and starts(group[0]) and goes_on(group, b):
            group.append(b)
        else:
            if group:
                yield group
            group = [b]
    if group:
        yield group


def merged(elements: DataFrame, pages: DataFrame, rule: str) -> DataFrame:
    """Elements with the runs of a rule as one: the box around them, texts joined, the style of most of the text, and n_merged."""
    of = RULES[rule]

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y0", "x0", "elem_idx"], kind="stable")
        boxes = [Box(r.elem_idx, " ".join((r.content or "").split()), r.x0, r.y0, r.x1, r.y1, max(r.fontsize, 1.0), bool(r.bold), int(r.color or 0)) for r in rows.itertuples()]
        out = []
        width = float(rows["width"].iloc[0])
        for g in adjacent_groups(boxes, lambda group, box: joins(of, group, box, width), lambda b: of.opens(b.text)):
            weight: dict[tuple, float] = {}
            for b in g:
                style = (b.em, b.bold, b.color)
                weight[style] = weight.get(style, 0.0) + max(len(b.text), 0.1)
            em, bold, color = max(weight, key=lambda s: (weight[s], s))
            out.append((rows["doc_id"].iloc[0], rows["page_no"].iloc[0], g[0].idx, " ".join(b.text for b in g if b.text), min(b.x0 for b in g), min(b.y0 for b in g), max(b.x1 for b in g), max(b.y1 for b in g), em, bold, color, len(g)))
        return pd.DataFrame(out, columns=[*(c.split()[0] for c in ELEMENTS.split(", ")), "n_merged"])

    names = [c.split()[0] for c in ELEMENTS.split(", ")]
    return elements.select(*names).join(pages.select(*PAGE, "width"), PAGE).groupBy(*PAGE).applyInPandas(page, ELEMENTS + ", n_merged int")


def line_bands(boxes: list[Box]) -> list[list[Box]]:
    """Table cells on one line: by top, joined while within max(2.5, .42 em) of the band's mean."""
    bands: list[list[Box]] = []
    for b in sorted(boxes, key=lambda b: (b.y0, b.x0)):
        if bands and abs(b.y0 - statistics.fmean(x.y0 for x in bands[-1])) <= max(2.5, 0.42 * b.em):
            bands[-1].append(b)
        else:
            bands.append([b])
    return bands


def row_starts(bands: list[list[Box]]) -> list[int]:
    """Bands that open a row: after a gap over 1.35 of the compact pitch; if no gap is so wide, every band."""
    tops = [statistics.fmean(b.y0 for b in band) for band in bands]
    gaps = [b - a for a, b in zip(tops, tops[1:], strict=False)]
    if not gaps:
        return list(range(len(bands)))
    em = statistics.fmean(b.em for band in bands for b in band)
    pitch = min(statistics.median(sorted(gaps)[: (len(gaps) + 1) // 2]), 1.4 * em)
    wide = [i + 1 for i, g in enumerate(gaps) if g > max(1.35 * pitch, pitch + 0.3 * em)]
    return [0, *wide] if wide else list(range(len(bands)))


def column_anchors(boxes: list[Box]) -> list[float]:
    """Left edges of columns: a new one past max(12, 1.4 em) of the last."""
    anchors: list[float] = []
    for b in sorted(boxes, key=lambda b: b.x0):
        if not anchors or b.x0 - anchors[-1] > max(12.0, 1.4 * b.em):
            anchors.append(b.x0)
    return anchors


def table_cells(elements: DataFrame) -> DataFrame:
    """Elements of tables (with `region`) with row_no and col_no; col_no is null for one too far from any column."""

    def region(rows: pd.DataFrame) -> pd.DataFrame:
        boxes = [Box(i, "", r.x0, r.y0, r.x1, r.y1, max(r.fontsize, 1.0), False, 0) for i, r in enumerate(rows.itertuples())]
        bands = line_bands(boxes)
        starts, anchors, row = set(row_starts(bands)), column_anchors(boxes), -1
        places: dict[int, tuple[int, int | None]] = {}
        for i, band in enumerate(bands):
            row += i in starts
            for b in band:
                col = min(range(len(anchors)), key=lambda k: abs(anchors[k] - b.x0))
                places[b.idx] = (row, col if abs(anchors[col] - b.x0) <= max(24.0, 2.8 * b.em) else None)
        return rows[["doc_id", "page_no", "region", "elem_idx"]].assign(row_no=[places[i][0] for i in range(len(rows))], col_no=pd.array([places[i][1] for i in range(len(rows))], dtype="Int32"))

    keys = [*PAGE, "region"]
    return elements.select(*keys, "elem_idx", "x0", "y0", "x1", "y1", "fontsize").groupBy(*keys).applyInPandas(region, "doc_id long, page_no long, region int, elem_idx int, row_no int, col_no int")


def last_glyphs(spans: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Spans drawn twice at one place, with the same text, font and size: the last one stays."""
    near = [F.bround(F.col(c) / tolerance) for c in ("x0", "y0", "x1", "y1")]
    w = Window.partitionBy(*PAGE, "text", "font", F.bround(F.col("size") * 2), *near).orderBy(F.desc("ord"))
    return spans.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def promoted_by_formulae(texts: DataFrame, formulae: DataFrame, *, padding: float = 0.5, least_prose: int = 20) -> DataFrame:
    """(doc_id, page_no, elem_idx, promoted): texts that touch a formula's box, and whether they are kept with it.

    A text is but where it is prose and every overlap is a sliver at an edge, no deeper than max(.35 em, 3) and the padding. texts: with
    box, content, fontsize and perhaps line_boxes (array of boxes): then none of its lines may touch.
    """
    from .joins import touching

    met = touching(texts, formulae.select(*PAGE, "box"), padding)
    deep = F.least("box.y1", "other.y1") - F.greatest("box.y0", "other.y0")
    sliver = (deep <= F.greatest(0.35 * F.col("fontsize"), F.lit(3.0))) & (F.length(F.coalesce("content", F.lit(""))) >= least_prose)
    if "line_boxes" in texts.columns:
        line_met = lambda b: (b["x0"] < F.col("other.x1")) & (F.col("other.x0") < b["x1"]) & (b["y0"] < F.col("other.y1")) & (F.col("other.y0") < b["y1"])
        sliver = sliver | ((F.size("line_boxes") > 0) & ~F.exists("line_boxes", line_met))
    return met.groupBy(*PAGE, "elem_idx").agg(F.max(~sliver).alias("promoted"))


def distinct_regions(boxes: list[tuple[float, float, float, float]], share: float = 0.94) -> list[tuple[float, float, float, float]]:
    """Of boxes that share so much of the lesser one's area the larger stays."""
    area = lambda b: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
    kept: list[tuple[float, float, float, float]] = []
    for b in sorted(boxes, key=area, reverse=True):
        cut = [(max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])) for a in kept]
        if not any(c[0] < c[2] and c[1] < c[3] and area(c) >= share * max(area(b), 1e-9) for c in cut):
            kept.append(b)
    return kept


def subtracted(box: tuple[float, float, float, float], holes: list[tuple[float, float, float, float]], padding: float = 0.0) -> list[tuple[float, float, float, float]]:
    """What is left of a box, as boxes, without the holes."""
    left = [box]
    for hx0, hy0, hx1, hy1 in ((a - padding, b - padding, c + padding, d + padding) for a, b, c, d in holes):
        out = []
        for x0, y0, x1, y1 in left:
            cx0, cy0, cx1, cy1 = max(x0, hx0), max(y0, hy0), min(x1, hx1), min(y1, hy1)
            if cx0 >= cx1 or cy0 >= cy1:
                out.append((x0, y0, x1, y1))
                continue
            out += [b for b in ((x0, y0, x1, cy0), (x0, cy1, x1, y1), (x0, cy0, cx0, cy1), (cx1, cy0, x1, cy1)) if b[0] < b[2] and b[1] < b[3]]
        left = out
    return left


def overlap_closure(boxes: dict[int, tuple[float, float, float, float]], start: set[int]) -> set[int]:
    """Boxes that must be drawn anew with those of start: all that overlap one of them, and so on."""
    reached, todo = set(start), list(start)
    while todo:
        a = boxes[todo.pop()]
        for i, b in boxes.items():
            if i not in reached and max(a[0], b[0]) < min(a[2], b[2]) and max(a[1], b[1]) < min(a[3], b[3]):
                reached.add(i)
                todo.append(i)
    return reached


def cross_page(elements: DataFrame, pages: DataFrame, main_font: float | None = None) -> DataFrame:
    """Sentences that run over a page: doc_id, page_no, from_idx, to_idx, dangling, lower_start.

    The last body element of a page and the first of the next, in type of .88 to 1.18 of the main size and away from the top 8 and
    the bottom 12 percent; the first has no final punctuation, or the second starts in lower case.
    """
    from .joins import ends_sentence

    e = elements.join(pages, PAGE).withColumn("cy", (F.col("y0") + F.col("y1")) / 2 / F.greatest("height", F.lit(1.0)))
    if main_font is None:
        sizes = e.groupBy("doc_id", font_bucket("fontsize").alias("b")).agg(F.sum(F.greatest(F.length("content").cast("double"), F.lit(0.1))).alias("w"))
        e = e.join(sizes.groupBy("doc_id").agg(F.max(F.struct("w", "b"))["b"].alias("main")), "doc_id")
    else:
        e = e.withColumn("main", F.lit(float(main_font)))
    body = e.filter((F.col("layout_class") == "body") & (F.col("fontsize") >= 0.88 * F.col("main")) & (F.col("fontsize") < 1.18 * F.col("main")) & (F.col("cy") > 0.08) & (F.col("cy") < 0.88))
    at = F.struct("y0", "x0", "elem_idx", "content")
    ends = body.groupBy(*PAGE).agg(F.max(at).alias("last"), F.min(at).alias("first"))
    after = ends.select("doc_id", (F.col("page_no") - 1).alias("page_no"), F.col("first").alias("next"))
    opener = F.regexp_extract(collapsed(F.col("next.content")), r"\p{L}", 0)
    pairs = ends.join(after, PAGE).select(
        *PAGE, F.col("last.elem_idx").alias("from_idx"), F.col("next.elem_idx").alias("to_idx"),
        (~ends_sentence(collapsed(F.col("last.content")))).alias("dangling"), ((opener != "") & (F.lower(opener) == opener) & (F.upper(opener) != opener)).alias("lower_start"),
    )
    return pairs.filter("dangling or lower_start")
