import json
import random
import threading

import pandas as pd
from pyspark.sql import functions as F

from folioflow.operators import dedup, events, joins, terms


def test_primaries(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 1), (2, "b", 1), (5, "a", 2), (6, None, 1), (4, None, 1), (7, "", 1)], "k int, t string, s int")
    assert {r.k: r.primary for r in dedup.primaries(df, "t", "k", "s").collect()} == {3: 1, 1: 1, 2: 2, 5: 5, 6: 4, 4: 4, 7: 7}


def test_dominant_value_takes_the_larger_of_equals(spark):
    df = spark.createDataFrame([("s", "a", 0.0), ("s", "b", 0.1), ("t", "a", 3.0), ("t", "b", 1.0), ("t", None, 9.0)], "g string, v string, w double")
    assert {r.g: r.v for r in dedup.dominant_value(df, "v", F.col("w"), "g").collect()} == {"s": "b", "t": "a"}


def elements(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, page_no int, elem_idx int, content string, x0 double, y0 double, x1 double, y1 double, fontsize double, color int, non_horizontal boolean")


def test_stamps(spark):
    pages = spark.createDataFrame([(1, p, 600.0, 800.0) for p in range(1, 6)], "doc_id long, page_no int, width double, height double")
    rows = []
    for p in range(1, 6):
        rows.append((1, p, 0, "Draft copy", 200.0, 380.0, 400.0, 420.0, 30.0, 0xC0C0C0, False))  # across the page
        rows.append((1, p, 1, "For internal use only", 50.0, 780.0, 200.0, 790.0, 8.0, 0, False))  # a plain footer
        rows.append((1, p, 2, f"Body {p} text", 50.0, 100.0, 500.0, 300.0, 10.0, 0, False))
        if p < 3:
            rows.append((1, p, 3, "Draft copy", 50.0, 10.0, 120.0, 20.0, 9.0, 0xC0C0C0, False))  # a second place
    rows.append((1, 5, 4, "Draft copy", 210.0, 580.0, 410.0, 620.0, 30.0, 0xC0C0C0, False))  # one copy of the same look
    got = {(r.page_no, r.elem_idx) for r in dedup.stamps(elements(spark, rows), pages).collect()}
    assert got == {(p, 0) for p in range(1, 6)} | {(1, 3), (2, 3), (5, 4)}


def test_reuse_needs_one_candidate(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, identity string")
    cached = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "identity string, translation string")
    assert {r.k: r.translation for r in joins.reuse(now, cached).collect()} == {1: "x", 2: None, 3: None}
    assert [r.k for r in joins.missing(now, cached, "identity").collect()] == [3]


def test_checkpoint_reuse(spark):
    sha = spark.sql("select sha2('t', 256) as s").first().s
    now = spark.createDataFrame([(1, "s1", "g", "t"), (1, "s2", "g", "u")], "doc_id long, seg_id string, signature string, source string")
    saved = spark.createDataFrame([(1, "s1", "g", sha, "x"), (1, "s2", "g", sha, "y")], "doc_id long, seg_id string, signature string, sha string, translation string")
    assert [tuple(r) for r in joins.checkpoint_reuse(now, saved).collect()] == [(1, "s1", "x")]


def test_identity_is_by_name_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, "")], "b int, a string")
    a = [r[0] for r in df.select(joins.cache_identity("b", "a")).collect()]
    assert a == [r[0] for r in df.select(joins.cache_identity("a", "b")).collect()] and len(set(a)) == 2


def test_glossary(spark):
    docs = spark.createDataFrame([(1, "Article on Art. Art?"), (2, "C++ (a.b)"), (3, "Artful")], "doc_id long, text string")
    glossary = spark.createDataFrame([("Art", "艺术", 0), ("C++", "C++", 1), ("(a.b)", "x", 2)], "source string, target string, ord int")
    assert sorted((r.doc_id, r.source, r.n, r.first_offset) for r in joins.glossary_hits(docs, glossary).collect()) == [(1, "Art", 2, 11), (2, "(a.b)", 1, 4), (2, "C++", 1, 0)]


def boxes(spark, rows, extra="content string"):
    return spark.createDataFrame([(1, 1, i, {"x0": a, "y0": b, "x1": c, "y1": d}, f, t) for i, (a, b, c, d, f, t) in enumerate(rows)], f"doc_id long, page_no int, elem_idx int, box struct<x0:double,y0:double,x1:double,y1:double>, fontsize double, {extra}")


def test_boxes(spark):
    texts = boxes(spark, [(0.0, 0.0, 10.0, 10.0, 10.0, "a"), (20.0, 0.0, 30.0, 10.0, 10.0, "b")])
    tables = boxes(spark, [(5.0, 5.0, 15.0, 15.0, 1.0, "t"), (19.0, 0.0, 31.0, 12.0, 1.0, "t")])
    assert sorted((r.elem_idx, r.shared) for r in joins.touching(texts, tables.select("doc_id", "page_no", "box")).collect()) == [(0, 25.0), (1, 100.0)]
    assert [r.elem_idx for r in joins.outside_tables(texts, tables).collect()] == [0]


def test_nearest(spark):
    markers = boxes(spark, [(10.0, 100.0, 16.0, 110.0, 10.0, "1.")])
    targets = boxes(spark, [(10.0, 100.0, 16.0, 110.0, 10.0, "1.xxxxxxx"), (20.0, 101.0, 90.0, 111.0, 10.0, "the nearest"), (20.0, 106.0, 90.0, 116.0, 10.0, "below it a bit"), (400.0, 100.0, 480.0, 110.0, 10.0, "too far away")])
    assert [(r.marker_idx, r.target_idx, round(r.score, 3)) for r in joins.nearest_right(markers, targets, F.lit(600.0)).collect()] == [(0, 1, 1.4)]
    lines = spark.createDataFrame([(1, 1, 0, 50.0), (1, 1, 1, 5.0)], "doc_id long, page_no int, line_idx int, line_y0 double")
    groups = spark.createDataFrame([(1, 1, 0, 10.0), (1, 1, 1, 40.0), (1, 1, 2, 40.0), (1, 1, 3, 60.0)], "doc_id long, page_no int, group_idx int, group_y1 double")
    assert [(r.line_idx, r.group_idx) for r in joins.nearest_above(lines, groups).collect()] == [(0, 1)]


def test_overlap_ratio(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["a"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(joins.overlap_ratio(F.col("a"), F.col("b"))).collect()] == [0.5, None]


def test_blocks_count_as_one_window(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 2, 3]) * 10 + rng.random() * 300, rng.choice(["error", "success"])) for i in range(300)] + [(1000, 60.0, "error"), (1001, 120.0, "success")]
    df = spark.createDataFrame(rows, "i int, s double, kind string").withColumn("ts", F.timestamp_seconds("s"))
    a = {r.i: r.n_error for r in events.window_counts_by_block(df, 60, "error").collect()}
    assert a == {r.i: r.n_error for r in events.window_counts(df, 60, ("error",)).collect()}
    assert a[1001] >= 1  # an event just as old as the window counts


def test_failover(spark):
    rows = [(1, 0.0, "ok", "ok"), (2, 1.0, "unusable", "ok"), (3, 2.0, "ok", "ok"), (4, 400.0, "error", "ok"), (5, 450.0, "ok", "ok"), (6, 800.0, "ok", "ok"), (7, 801.0, "unusable", "unusable"), (8, 802.0, "error", "error")]
    df = spark.createDataFrame([(1, *r) for r in rows], "stream long, seq long, ts double, primary string, backup string")
    got = [(r.served, r.active, r.switched, r.probe, r.alert) for r in events.failover(df).orderBy("seq").collect()]
    assert got == [
        ("primary", "primary", False, False, None), ("backup", "backup", True, False, "switched"), ("backup", "backup", False, False, None), ("backup", "backup", False, True, None),
        ("backup", "backup", False, False, None), ("primary", "primary", False, True, "restored"), ("none", "backup", True, False, "all_dead"), ("none", "backup", False, False, None),
    ]


def test_throttle(spark):
    df = spark.createDataFrame([(1, "k", i, t) for i, t in enumerate([0.0, 10.0, 599.0, 600.0, 1300.0])], "stream long, kind string, seq long, ts double")
    assert [(r.sent, r.merged) for r in events.throttled(df).orderBy("seq").collect()] == [(True, 0), (False, None), (False, None), (True, 2), (True, 0)]


def test_admission(spark):
    rows = [("reserve", 1, 60), ("reserve", 2, 50), ("reserve", 1, 60), ("release", 1, 0), ("reserve", 2, 50), ("reserve", 3, 10), ("reserve", 4, 1), ("reserve", 5, -1)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "queue long, seq long, action string, task long, size long")
    got = [r.admitted for r in events.admitted(df, max_tasks=2, max_bytes=100).orderBy("seq").collect()]
    assert got == [True, False, True, None, True, True, False, False]


def test_enqueued_and_recovered(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, seq long")
    assert sorted(tuple(r) for r in events.enqueued(df, "k").select("k", "seq").collect()) == [("a", 1), ("b", 3)]
    tasks = spark.createDataFrame([("done", "pdf", True), ("running", "pdf", True), ("running", "pdf", False), ("running", "txt", True), ("queued", "epub", None)], "status string, type string, has_source boolean")
    assert [r.action for r in events.recovered(tasks).collect()] == ["leave", "resume", "fail", "fail", "fail"]


def test_batches(spark):
    rng = random.Random(2)
    rows = [(d, f"s{i:06d}", "".join(rng.choice(["a", "é", '"', "\n", "中", "\\"]) for _ in range(rng.choice([0, 5, 40, 200])))) for d in range(3) for i in range(1, 40)]
    got = events.byte_batches(spark.createDataFrame(rows, "doc_id long, seg_id string, source string"), max_bytes=300).toPandas()
    text = {(d, s): t for d, s, t in rows}
    size = lambda ids: len(json.dumps({s: text[d, s] for d, s in ids}, ensure_ascii=False).encode())
    for d, part in got.sort_values("seg_id").groupby("doc_id"):
        now, want = [], []
        for s in part.seg_id:
            if now and size([*now, (d, s)]) > 300:
                want.append(now)
                now = []
            now.append((d, s))
        want.append(now)
        assert [[(d, s) for s in g.seg_id] for _, g in part.groupby("batch_no")] == want
    assert isinstance(got, pd.DataFrame)


def test_terms(spark):
    docs = spark.createDataFrame([(1, "The Bank of England met. GDP rose; GDP fell. Bank of England"), (2, None)], "doc_id long, text string")
    got = [(r.term, r.n, r.first_offset) for r in terms.candidates(docs).orderBy(F.desc("n"), "first_offset").collect()]
    assert got == [("GDP", 2, 25), ("The Bank of England", 1, 0), ("Bank of England", 1, 45)]


def test_glossary_with_a_term_in_most_documents(spark):
    """Nine documents in ten hold one term; a term without a Latin word is found too, and no part of a word is."""
    docs = spark.createDataFrame([(i, "the hot term, a hot terms 中文" if i % 10 else "cold 中文") for i in range(300)], "doc_id long, text string")
    glossary = spark.createDataFrame([("hot term", "热", 0), ("中文", "zh", 1), ("cold", "冷", 2), ("absent", "无", 3)], "source string, target string, ord int")
    got = joins.glossary_hits(docs, glossary).groupBy("source").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min("first_offset").alias("at")).collect()
    assert {r.source: (r.k, r.n, r.at) for r in got} == {"hot term": (270, 270, 4), "中文": (300, 300, 5), "cold": (30, 30, 0)}


def within(spark, seconds, run):
    """What run returns; its jobs are ended, and fail, after so many seconds."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return run()
    finally:
        timer.cancel()


def test_nearest_above_one_page(spark):
    """All pairs of a page's lines and groups are never made, and heights that many share give the first group."""
    rng = random.Random(5)
    lines = [(1, i % 2, i, float(rng.randrange(40))) for i in range(200)]
    groups = [(1, i % 2, i, float(rng.randrange(40))) for i in range(60)]
    frames = spark.createDataFrame(lines, "doc_id long, page_no long, line_idx long, line_y0 double"), spark.createDataFrame(groups, "doc_id long, page_no long, group_idx long, group_y1 double")
    best = {(d, p, i): max(((y1, -g) for e, q, g, y1 in groups if (e, q) == (d, p) and y1 <= y0), default=None) for d, p, i, y0 in lines}
    assert {(r.doc_id, r.page_no, r.line_idx): r.group_idx for r in joins.nearest_above(*frames).collect()} == {k: -b[1] for k, b in best.items() if b}
    n = 300_000
    ids = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("page_no"), "id")
    many = ids.select("doc_id", "page_no", F.col("id").alias("line_idx"), (F.col("id") + 0.5).alias("line_y0")), ids.select("doc_id", "page_no", F.col("id").alias("group_idx"), F.col("id").cast("double").alias("group_y1"))
    assert within(spark, 60, joins.nearest_above(*many).filter("line_idx = group_idx").count) == n


def test_nearest_right_one_page(spark):
    """Markers and targets meet near each other only, wherever on and off the page they lie; of one box the first target counts."""
    rng = random.Random(6)
    rows = [(x := rng.choice([-9e4, 0.0, 60.0, 120.0, 9e4]) + rng.randrange(70), y := rng.choice([-7e4, 0.0, 60.0, 7e4]) + rng.randrange(70), x + rng.randrange(30), y + rng.choice([0.0, 8.0, 12.0, 200.0]), rng.choice([8.0, 14.0]), "long enough") for _ in range(900)]
    at = boxes(spark, rows + rows[:50])
    want = {}
    for i, (a, b, c, d, em, _) in enumerate(rows[:150]):
        for j, (e, f, g, h, *_) in enumerate(rows + rows[:50]):
            gap, centre = e - c, abs((b + d) / 2 - (f + h) / 2)
            level = max(min(d, h) - max(b, f), 0.0) / max(min(d - b, h - f), 1e-6) >= 0.35 or centre <= max(0.65 * em, 6.0)
            if i != j and 0 <= gap <= max(5 * em, 60.0) and level:
                want[i] = min(want.get(i, (9e9, 0)), (centre + 0.1 * gap, j))
    got = {r.marker_idx: (r.score, r.target_idx) for r in joins.nearest_right(at.filter("elem_idx < 150"), at, F.lit(500.0)).collect()}
    assert len(want) > 50 and got == want
    k = F.col("id")
    one = spark.range(300_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_no"), k.alias("elem_idx"), F.struct(*(x.cast("double").alias(n) for n, x in (("x0", k % 500), ("y0", F.floor(k / 500)), ("x1", k % 500 + 20), ("y1", F.floor(k / 500) + 10)))).alias("box"), F.lit(10.0).alias("fontsize"), F.lit("long enough").alias("content"))
    assert within(spark, 100, joins.nearest_right(one.filter("elem_idx % 9 = 0"), one.filter("elem_idx % 9 > 0"), F.lit(500.0)).count) > 20_000
