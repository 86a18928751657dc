import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import layout as L


def els(spark, rows, pages=((1, 1, 600.0, 800.0),)):
    df = spark.createDataFrame([(*r[:3], r[3], *map(float, r[4:8]), float(r[8]), bool(r[9]) if len(r) > 9 else False, 0) for r in rows], L.ELEMENTS)
    return df, spark.createDataFrame(list(pages), "doc_id long, page_no int, width double, height double")


def test_classes(spark):
    rows = [(1, 1, 0, "word " * 50, 50, 200, 550, 300, 10), (1, 1, 1, "Page head", 50, 20, 150, 30, 10), (1, 1, 2, "Disclaimer: none", 50, 400, 150, 410, 10)]
    rows += [(1, 1, 10 + i, f"cell {i}", 50 + 100 * (i % 3), 500 + 12 * (i // 3), 100 + 100 * (i % 3), 510 + 12 * (i // 3), 9) for i in range(9)]
    got = {r.elem_idx: r.layout_class for r in L.classified(*els(spark, rows)).collect()}
    assert got == {0: "body", 1: "scattered", 2: "scattered"} | {10 + i: "table" for i in range(9)}


LONG = "A first line that is long enough to be the start of a paragraph"


@pytest.mark.parametrize(
    ("rule", "rows", "sizes"),
    [
        ("wrapped", [(LONG, 50, 100, 500, 110, 10), ("and its second line", 50, 112, 300, 122, 10), ("2. A new item", 50, 124, 300, 134, 10), ("of two lines", 60, 136, 300, 146, 10)], [2, 2]),
        ("wrapped", [(LONG, 50, 100, 500, 110, 10), ("far below it", 50, 150, 300, 160, 10)], [1, 1]),
        ("wrapped", [(LONG, 50, 100, 500, 110, 10), ("in other type", 50, 112, 300, 122, 12)], [1, 1]),
        ("list", [("1. Item", 50, 100, 200, 110, 10), ("continued", 60, 112, 200, 122, 10), ("Not indented", 50, 124, 200, 134, 10)], [2, 1]),
        ("strong", [(LONG, 50, 100, 500, 110, 10), ("goes on down here", 50, 112, 500, 122, 10), ("Capital at margin", 50, 124, 500, 134, 10)], [2, 1]),
        ("strong", [(LONG + ".", 50, 100, 500, 110, 10), ("goes on down here", 50, 112, 500, 122, 10)], [1, 1]),
        ("heading", [("A HEADING", 50, 100, 200, 112, 14), ("OVER LINES", 50, 114, 200, 126, 14), ("Plain text", 50, 128, 200, 140, 10)], [2, 1]),
        ("reference", [("Smith, J. (2010) A work", 50, 100, 400, 110, 10), ("published somewhere", 70, 112, 400, 122, 10), ("Young, K. (2011) Another", 50, 124, 400, 134, 10)], [2, 1]),
    ],
)
def test_merges(spark, rule, rows, sizes):
    df, pages = els(spark, [(1, 1, i, *r) for i, r in enumerate(rows)])
    got = L.merged(df, pages, rule).orderBy("elem_idx").collect()
    assert [r.n_merged for r in got] == sizes and sum(sizes) == len(rows)
    assert got[0].content == " ".join(r[0] for r in rows[: sizes[0]]) and got[0].y1 == rows[sizes[0] - 1][4]


def test_merging_twice_changes_nothing_that_was_apart(spark):
    rng = random.Random(3)
    rows, y = [], 50.0
    for i in range(60):
        y += rng.choice([11, 12, 30])
        rows.append((1, 1 + i // 20, i, rng.choice([LONG, "short", "2. item text", "word word word"]), rng.choice([50, 62]), y, 400, y + 10, 10))
    df, pages = els(spark, rows, [(1, p, 600.0, 5000.0) for p in (1, 2, 3)])
    got = L.merged(df, pages, "wrapped").collect()
    assert sum(r.n_merged for r in got) == 60 and sorted(" ".join(r.content for r in got).split()) == sorted(" ".join(r[3] for r in rows).split())


def test_paragraphs(spark):
    lines = [(1, 1, 0, i, "x", x, y, 300.0, y + 10, 10.0) for i, (x, y) in enumerate([(50.0, 100.0), (50.0, 112.0), (65.0, 124.0), (50.0, 136.0), (50.0, 160.0)])]
    df = spark.createDataFrame(lines, "doc_id long, page_no int, block int, line_no int, plain string, x0 double, y0 double, x1 double, y1 double, fontsize double")
    assert [r.paragraph for r in L.paragraphs(df).orderBy("line_no").collect()] == [0, 0, 1, 2, 3]


def test_cells(spark):
    df = spark.createDataFrame([(1, 1, 0, 10.0, 40.0, 10.0), (1, 1, 0, 45.0, 80.0, 10.0), (1, 1, 0, 120.0, 140.0, 10.0)], "doc_id long, page_no int, line_no int, x0 double, x1 double, fontsize double")
    assert [r.cell for r in L.cells(df).orderBy("x0").collect()] == [0, 0, 1]


def test_table_cells(spark):
    rows = [(1, 1, 0, k, 50.0 + 100 * c + 1.5 * (r % 2), 100.0 + 40 * r + d, 90.0 + 100 * c, 110.0 + 40 * r + d, 10.0) for k, (r, c, d) in enumerate([(0, 0, 0), (0, 1, 1), (1, 0, 0), (1, 0, 12), (1, 1, 0), (2, 0, 0), (2, 1, 0)])]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, region int, elem_idx int, x0 double, y0 double, x1 double, y1 double, fontsize double")
    got = {r.elem_idx: (r.row_no, r.col_no) for r in L.table_cells(df).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (1, 0), 3: (1, 0), 4: (1, 1), 5: (2, 0), 6: (2, 1)}


def test_last_glyphs(spark):
    df = spark.createDataFrame([(1, 1, i, "a", "f", 10.0, x, 0.0, x + 5, 9.0) for i, x in enumerate([10.0, 10.1, 30.0])], "doc_id long, page_no int, ord int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.ord for r in L.last_glyphs(df).collect()) == [1, 2]


def test_boxes():
    assert L.distinct_regions([(0, 0, 10, 10), (0, 0, 10, 9.8), (20, 0, 30, 10)]) == [(0, 0, 10, 10), (20, 0, 30, 10)]
    left = L.subtracted((0, 0, 10, 10), [(4, 4, 6, 6)])
    assert sum((c - a) * (d - b) for a, b, c, d in left) == 96 and L.subtracted((0, 0, 1, 1), [(0, 0, 1, 1)]) == []
    boxes = {0: (0, 0, 10, 10), 1: (9, 9, 20, 20), 2: (19, 19, 30, 30), 3: (40, 40, 50, 50)}
    assert L.overlap_closure(boxes, {0}) == {0, 1, 2}


def test_cross_page(spark):
    rows = [(1, 1, 0, "A sentence that is", 50, 400, 500, 420, 10), (1, 2, 0, "cut by the page.", 50, 100, 500, 120, 10), (1, 2, 1, "It ends.", 50, 600, 500, 620, 10), (1, 3, 0, "Another one.", 50, 100, 500, 120, 10)]
    df, pages = els(spark, rows, [(1, p, 600.0, 800.0) for p in (1, 2, 3)])
    got = [(r.page_no, r.from_idx, r.to_idx, r.dangling, r.lower_start) for r in L.cross_page(df.withColumn("layout_class", F.lit("body")), pages).collect()]
    assert got == [(1, 0, 0, True, True)]


def test_prose_and_formulae(spark):
    df, _ = els(spark, [(1, 1, 0, "one two three four five six seven eight", 50, 100, 500, 110, 10), (1, 1, 1, "one two three four five six seven eight", 50, 100, 500, 130, 10), (1, 1, 2, "α β γ", 0, 0, 1, 1, 10)])
    got = df.orderBy("elem_idx").select(L.is_body_prose(F.lit(10.0)), L.formula_risk(F.lit(3)), L.formula_risk(F.lit(2))).collect()
    assert [tuple(r) for r in got] == [(False, True, False), (True, True, False), (False, True, True)]
    assert [r.elem_idx for r in L.reading_order(df).orderBy("rank").collect()] == [2, 0, 1]
