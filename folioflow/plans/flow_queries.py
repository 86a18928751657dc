"""Queries over the flow of translation: caches, batches, verdicts, records and archives, and what must come back as it went in."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, markup, numbers, placeholders, validation
from ..functions import service as S
from ..operators import events as E
from ..operators import joins, segments
from ..sources import archive, records
from ..sources.tables import lines, shared_folder, table
from . import sql


def cache_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.nullif("lang", F.lit("en")).alias("lang"), "n_chars")
    return docs.select("doc_id", joins.cache_identity("source", "lang", "n_chars").alias("identity"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as segments."""
    each = lines(table(spark, sf_dir, "documents"))
    return each.select("doc_id", F.format_string("s%06d", F.col("line_no")).alias("seg_id"), F.col("line").alias("source"), F.col("line_no").cast("long").alias("line_no"))


def checkpoint_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier run's checkpoint, in which the signature of some documents and the text of some lines is another; a blank translation
    can't be used again."""
    now = _segments(spark, sf_dir).withColumn("signature", F.lit("v2"))
    saved = now.select(
        "doc_id", "seg_id", F.when(F.col("doc_id") % 5 == 0, "v1").otherwise("v2").alias("signature"), F.sha2(F.when(F.col("line_no") % 4 == 0, F.concat("source", F.lit("!"))).otherwise(F.col("source")), 256).alias("sha"),
        F.when(F.col("line_no") % 3 == 0, " ").otherwise(F.concat(F.lit("t"), "seg_id")).alias("translation"),
    )
    return joins.checkpoint_reuse(now, saved, F.trim("translation") != "")


def line_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of lines whose JSON stays under 2000 bytes."""
    each = E.byte_batches(_segments(spark, sf_dir).select("doc_id", "seg_id", "source"), max_bytes=2000)
    return each.groupBy("doc_id", F.col("batch_no").cast("long").alias("batch_no")).agg(F.min("seg_id").alias("first"), F.count("*").alias("n"))


def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") != "error", "success").when(F.col("value") > 50, "rate_limit").otherwise("error")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), kind.alias("kind"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return E.throttled(e, min_interval=24 * 3600)


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, works = F.col("event_id"), (F.col("event_type") != "error")
    jobs = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("queue"), e.alias("seq"), F.when(works, "reserve").otherwise("release").alias("action"), (e % 17).alias("task"), (F.col("value") * 1000).cast("long").alias("size"))
    return E.admitted(jobs, max_tasks=8, max_bytes=200_000)


def failover_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = lambda c, k: F.when(c % k == 0, "unusable").when(c % 11 == 0, "error").otherwise("ok")
    e = F.col("event_id")
    requests = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream"), e.alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), answer(e, 7).alias("primary"), answer(e, 5).alias("backup")
    )
    return E.failover(requests, retry_primary_seconds=6 * 3600)


def first_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("seq"))
    return E.enqueued(jobs, "user_id", "event_type")


def restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("done", "failed", "deleted", "queued", "running"))), (F.col("event_id") % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "epub", "other"))), (F.col("event_id") % 3 + 1).cast("int"))
    tasks = table(spark, sf_dir, "events").select(status.alias("status"), kind.alias("type"), F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 7 > 1).alias("has_source"))
    return E.recovered(tasks).groupBy("status", "type", "action").agg(F.count("*").alias("n"))


def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    said = F.when(e % 4 == 0, F.concat(F.lit("Retry after "), (e % 200).cast("string"), F.lit("s"))).when(e % 4 == 1, F.concat(F.lit("please try again in "), (e % 90).cast("string"), F.lit(".5s"))).when(e % 4 == 2, F.concat(F.lit("wait, after "), (e % 50).cast("string"), F.lit(" seconds"))).otherwise("no hint")
    return table(spark, sf_dir, "events").select("event_id", S.retry_delay(said, e % 6).alias("delay"))


_FAILURES = ("All LLM key slots unusable", "the service stopped", "Internal Error 7", "every page kept its source", "cannot open file", "EPUB mimetype is wrong", "something else", "worker crashed after a restart")


def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, _FAILURES)), (F.col("event_id") % len(_FAILURES) + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(S.failure_class(said).alias("failure")).agg(F.count("*").alias("n"))


def outcome_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes of segments: what each user's translate, and whether the failures keep to the budget."""
    e = F.col("event_id")
    status = F.when(F.col("event_type") == "error", "failed").when(e % 10 == 0, "preserved").otherwise("translated")
    rows = table(spark, sf_dir, "events").select("user_id", status.alias("status"), F.when(F.col("event_type") == "error", F.concat(F.lit("reason "), (e % 4).cast("string"))).alias("reason"))
    found = segments.coverage(rows, "user_id")
    return found.withColumn("reasons", F.array_join("reasons", "|")).withColumn("ratio", F.round("ratio", 9))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("conv_id") * 3 + F.col("turn") * 5) % 7
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("attempt"), F.when(n > 0, F.concat(F.repeat(F.lit("文"), n.cast("int")), F.lit(" t"), F.col("turn").cast("string"))).alias("candidate"))


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = validation.best_candidate(_candidates(spark, sf_dir), "conv_id")
    return best.select("conv_id", "candidate", F.col("n_cjk").cast("long").alias("n_cjk"))


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with translations that are fine, blank, echoed, refused, too long or too short, or none."""
    kind = F.col("line_no") % 8
    n = F.length("line")
    made = F.when(kind == 0, F.col("line")).when(kind == 1, "").when(kind == 2, F.repeat(F.lit("文"), F.greatest(F.ceil(n / 3), F.lit(1)).cast("int"))).when(kind == 3, "抱歉，我无法翻译").when(kind == 4, F.concat("line", F.lit(" 文字"))).when(
        kind == 5, F.repeat(F.lit("文字"), (n + 70).cast("int"))).when(kind == 6, "文")
    each = lines(table(spark, sf_dir, "documents"))
    return each.select("doc_id", F.col("line_no").cast("long").alias("elem_idx"), F.col("line").alias("content"), made.alias("translation"))


def translation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why lines' translations are asked for again."""
    reason = F.coalesce(validation.retry_reason("content", "translation"), F.lit("fine"))
    return _translated(spark, sf_dir).filter("translation is not null").groupBy("doc_id", reason.alias("reason")).agg(F.count("*").alias("n"))


def page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: how many of their elements have an issue, and the first one."""
    found = validation.page_issues(_translated(spark, sf_dir), "doc_id")
    first = F.get("issues", F.lit(0))
    return found.select("doc_id", "n_elements", F.size("issues").cast("long").alias("n_issues"), first["elem_idx"].alias("first"), first["reason"].alias("reason"))


def updated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of task records, and a save that keeps what it doesn't set."""
    e = table(spark, sf_dir, "events").withColumn("task_id", F.concat(F.lit("t"), F.col("event_id").cast("string")))
    old = e.filter("event_id % 3 < 2").select("task_id", F.col("event_type").alias("status"), F.lit(None).cast("string").alias("error"), F.col("user_id").alias("total"))
    new = e.filter("event_id % 3 > 0").select("task_id", F.when(F.col("event_id") % 2 == 0, "saved").alias("status"), F.when(F.col("event_id") % 5 == 0, "late").alias("error"))
    return records.updated(old, new)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns appended to a ledger by two runs, read back and summed by model."""
    at = _folder(spark, "ledger")
    n = F.length("text").cast("long")
    turns = table(spark, sf_dir, "conversations").select("turn", F.lit(2).alias("schema"), F.col("conv_id").cast("double").alias("ts"), F.concat(F.lit("m"), "role").alias("model"), n.alias("prompt_tokens"), (n * F.lit(7)).alias("total_tokens"), (n / 1000).cast("decimal(20,10)").alias("conservative_cost_usd"))
    for k in (0, 1):
        records.append_ledger(turns.filter(F.col("turn") % 2 == k).drop("turn"), at)
    return records.ledger(spark, at).groupBy("model").agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("total_tokens").alias("total_tokens"), F.sum("conservative_cost_usd").cast("double").alias("cost"))


def saved_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page caches saved and loaded: those of an older schema, of another source or without an identity are passed over."""
    at, k = _folder(spark, "pages"), F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (k % 10).alias("page_no"), F.when(k % 7 == 0, "none").otherwise(F.sha2("text", 256)).alias("identity"), F.md5("text").alias("translation"), F.when(k % 5 == 0, 1).otherwise(2).alias("schema_version"), F.when(k % 3 == 0, "b").otherwise("a").alias("source_sha256")
    )
    records.save(rows, at, "page_no")
    return records.page_cache(spark, at, F.lit("a")).select("doc_id", F.col("page_no").cast("long").alias("page_no"), "translation")


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as rows of recognition tables."""
    k = F.col("p_partkey")
    row = F.array_join(F.array(*(x.cast("string") for x in (F.when(k % 4 == 0, 4).otherwise(5), F.lit(1), k % 3, F.lit(1), k % 7, k, k % 50, k % 60, F.lit(30), F.lit(9), k % 101)), F.when(k % 9 == 0, " ").otherwise(F.col("p_name"))), "\t")
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    tsv = table(spark, sf_dir, "part").select((k % 20).alias("doc_id"), F.lit(1).alias("page_no"), k.alias("k"), row.alias("row")).groupBy("doc_id", "page_no").agg(
        F.concat(F.lit(head + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]), "\n")).alias("tsv")
    )
    words = records.recognised_words(tsv, 2.0, 30.0)
    return words.select("doc_id", F.col("block").cast("long").alias("block"), F.col("word").cast("long").alias("word"), "text", F.col("box.x0").alias("x0"), F.col("box.y1").alias("y1"))


def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages packed as books of twenty and read from them again, and a language written into their package document."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            books = [archive.packed([("mimetype", b"application/epub+zip"), *((m["name"], m["body"]) for m in ms)]) for ms in b.column("members").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("book"), pa.array(books, pa.binary())], ["book", "data"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(book, name, body) for book, data in zip(b.column("book").to_pylist(), b.column("data").to_pylist(), strict=True) for name, body in archive.read(data, archive.Limits())]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary()), strict=True)], ["book", "member", "content"])

    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 20).alias("book"), F.format_string("p%06d.xhtml", F.col("page_id")).alias("name"), F.col("html").cast("binary").alias("body"))
    opf = pages.select("book").distinct().select("book", F.lit("content.opf").alias("name"), F.concat(F.lit("<dc:language id='l'>en</dc:language> "), F.col("book").cast("string")).cast("binary").alias("body"))
    books = pages.union(opf).groupBy("book").agg(F.array_sort(F.collect_list(F.struct("name", "body"))).alias("members")).mapInArrow(pack, "book long, data binary")
    read = books.mapInArrow(unpack, "book long, member string, content binary").filter("member <> 'mimetype'")
    shown = F.when(F.col("member") == "content.opf", archive.with_language(F.col("content").cast("string"))).otherwise(F.col("content").cast("string"))
    return read.select("book", "member", F.md5(shown).alias("content"))


def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut into segments and put together again without a translation."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    parts = segments.segments(pages).withColumn("translation", F.lit(None).cast("string"))
    return segments.rendered(pages, parts).select("doc_id", F.md5("html").alias("html"))


def markup_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and visible text of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [markup.markup_spans(x) for x in b.column("html").to_pylist()]
            shown = ["".join(x[a:z] for a, z in markup.between(s, len(x))) for x, s in zip(b.column("html").to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(list(map(len, spans)), pa.int64()), pa.array(shown, pa.string())], ["page_id", "n_tags", "shown"])

    found = table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(run, "page_id long, n_tags long, shown string")
    return found.select("page_id", "n_tags", F.md5("shown").alias("shown"))


def segment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of parts as headings and paragraphs: which ask for a request, look like names, must show Chinese."""
    k = F.col("p_partkey")
    text = F.when(k % 6 == 0, F.upper(F.substring("p_name", 1, 3))).when(k % 6 == 1, F.initcap("p_name")).when(k % 6 == 2, F.concat(F.lit("the "), "p_name")).when(k % 6 == 3, "XIV").when(k % 6 == 4, "B.").otherwise(F.concat(F.initcap("p_name"), F.lit(" of the "), F.initcap("p_type")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 4 == 0, "h2").otherwise("p").alias("kind"), text.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [markup.Segment("s", 0, 0, kind, t, t) for kind, t in zip(b.column("kind").to_pylist(), b.column("t").to_pylist(), strict=True)]
            flags = ([s.needs_request for s in found], [markup.looks_like_names(s.plain) for s in found], [markup.requires_cjk(s) for s in found])
            yield pa.RecordBatch.from_arrays([b.column("p_partkey"), *(pa.array(f, pa.bool_()) for f in flags)], ["p_partkey", "asks", "is_names", "needs_chinese"])

    return rows.mapInArrow(run, "p_partkey long, asks boolean, is_names boolean, needs_chinese boolean")


def placeholder_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and addresses of lines behind tokens and back; a token that a reader would see is a leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, line in zip(b.column("doc_id").to_pylist(), b.column("line").to_pylist(), strict=True):
                shown, kept = placeholders.protected_parts(line, formulae=[])
                out.append((doc_id, len(kept), placeholders.restored_parts(shown, kept) == line, len(placeholders.leaks(line, shown))))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["doc_id", "n", "same", "leaks"])

    made = F.concat("line", F.when(F.col("line_no") % 3 == 0, F.concat(F.lit(" <sup>"), F.col("line_no").cast("string"), F.lit("</sup> see https://x.example/"), F.col("line_no").cast("string"), F.lit(" now"))).otherwise(""))
    each = lines(table(spark, sf_dir, "documents")).select("doc_id", made.alias("line")).mapInArrow(run, "doc_id long, n long, same boolean, leaks long")
    return each.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("n").alias("n_tokens"), F.count_if("same").alias("n_same"), F.sum("leaks").alias("n_leaks"))


def envelope_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document in one request; an answer that changes their order opens to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [[" ".join(t.split()) for t in ts] for ts in b.column("texts").to_pylist()]
            sent = [placeholders.envelope(ts) for ts in texts]
            turned = [placeholders.SEPARATOR.join(reversed(s.split(placeholders.SEPARATOR))) for s in sent]
            opened = [[placeholders.opened(s, ts) for s, ts in zip(some, texts, strict=True)] for some in (sent, turned)]
            columns = [pa.array([len(o or []) for o in opened[0]], pa.int64()), pa.array([o == ts for o, ts in zip(opened[0], texts, strict=True)], pa.bool_()), pa.array([o is not None for o in opened[1]], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n", "same", "turned"])

    texts = lines(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("texts"))
    return texts.mapInArrow(run, "doc_id long, n long, same boolean, turned boolean")


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a table of figures: thousands, parentheses, signs, a date, a short year, currencies."""
    n, day = (F.col("o_orderkey") % 900 + 100).cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    year = F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")
    row = F.concat(F.lit("Qty "), n, F.lit(",250 ("), n, F.lit(".5%) -"), n, F.lit(".25 "), day, F.lit(" '"), year, F.lit(" EUR"), n, F.lit(" PKR-"), n, F.lit(".0 n.a."))
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), row.alias("row"))


def spelt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = numbers.with_numbers(_figures(spark, sf_dir), "row")
    return found.select("o_orderkey", F.array_join("numbers", "|").alias("numbers"))


def number_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations of rows and labels that keep their figures, drop one, gain some, or are prose."""
    k, n, row = F.col("o_orderkey") % 5, F.col("n"), F.col("row")
    source = F.when(k < 3, row).when(k == 3, "Total demand of the fund").otherwise(F.concat(F.lit("They sold "), n, F.lit(" units in all of that time")))
    said = F.when(k == 0, F.replace(row, F.lit("Qty"), F.lit("数量"))).when(k == 1, F.replace(F.replace(row, F.lit("Qty"), F.lit("数量")), F.lit(" PKR-"), F.lit(" "))).when(k == 2, "这是一行数据，没有可翻译的句子。").when(k == 3, F.concat(F.lit("总需求 "), n, F.lit(" 2.5 3.5"))).otherwise(F.concat(F.lit("共售出"), n, F.lit("件")))
    made = _figures(spark, sf_dir).select("o_orderkey", source.alias("source"), said.alias("said"))
    return numbers.with_guard(made, "source", "said", "failure").select("o_orderkey", "failure")


def kept_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs before amounts that a translation keeps near a figure, parts from it, or drops; and English that it leaves."""
    k, n = F.col("o_orderkey") % 4, F.col("n")
    source = F.concat(F.lit("worth +$"), n, F.lit("bn in all of these years"))
    said = F.when(k == 0, F.concat(F.lit("价值+约"), n, F.lit("亿"))).when(k == 1, F.concat(F.lit("价值+，共"), n, F.lit("亿"))).when(k == 2, F.concat(F.lit("价值约"), n, F.lit("亿"))).otherwise(F.concat(F.lit("价值+"), n, F.lit("亿 which is what they said in all of it 吗")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [numbers.sign_lost(["+"], s, t) for s, t in zip(b.column("source").to_pylist(), b.column("said").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "failure"])

    made = _figures(spark, sf_dir).select("o_orderkey", source.alias("source"), said.alias("said"))
    judged = validation.with_leaks(made.mapInArrow(run, "o_orderkey long, source string, said string, failure string"), "source", "said")
    return judged.select("o_orderkey", "failure", F.array_join("leaks", "|").alias("leaks"))


def repaired_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that lost an empty anchor, kept a dropped initial, flattened a raised mark, or are no answer: what is made of them."""

    def segment(raw: str) -> markup.Segment:
        text, fragments = markup.protected(raw)
        return markup.Segment("s000001", 0, len(raw), "p", text, raw, fragments)

    def judged(k: int) -> tuple:
        anchored, initial = segment(f'<span id="p{k}"/>Some words <b>here {k}</b>'), segment(f'<span class="d">B</span>y {k} they had left')
        (_, b, c), (d, e) = ([t for t, _ in x.fragments] for x in (anchored, initial))
        said = f"一些{b}这里 {k}{c}" if k % 3 else ("" if k % 2 else f"Some words {b}here{c}")
        verdicts = markup.read_response(json.dumps({anchored.id: said}), [anchored])
        kept = verdicts.accepted.get(anchored.id)
        moved = markup.moved_initial(initial, f"{d}B{e}到 {k} 年")
        raised = validation.restored_marks(f"mass<sup>{k}</sup> and {k}", f"质量{k} 和 {k}")
        return k, kept and markup.restored(anchored, kept), verdicts.failures.get(anchored.id), anchored.id in verdicts.repaired, markup.restored(initial, moved), raised

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judged(k) for k in batch.column("p_partkey").to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["p_partkey", "accepted", "failure", "repaired", "initial", "raised"])

    return table(spark, sf_dir, "part").select("p_partkey").mapInArrow(run, "p_partkey long, accepted string, failure string, repaired boolean, initial string, raised string")


QUERIES = {
    f.__name__: f
    for f in (
        cache_identities, checkpoint_reuse, line_batches, throttle, admission, failover_replay, first_jobs, restarts, retry_delays, failure_classes, outcome_coverage, best_candidates, translation_verdicts, page_verdicts, updated_records,
        ledger_totals, saved_caches, recognised, archived_pages, rendered_pages, markup_profile, segment_flags, placeholder_roundtrip, envelope_roundtrip, spelt_numbers, number_guards, kept_signs, repaired_segments,
    )
}

_SEGMENTS = f"{sql.LINES}, seg as (select doc_id, printf('s%06d', line_no) as seg_id, line as source, line_no from lines)"
_KIND = "case when event_type <> 'error' then 'success' when value > 50 then 'rate_limit' else 'error' end"


def _language(p: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({p}, '{sql.IDENTIFIER}', ' ', 'g'), '\s+', ' ', 'g'))"


_VERDICTS = rf"""
    {sql.LINES}, l as (select doc_id, line_no, line as content, length(line) as len, line_no % 8 as kind from lines),
    tr as (select doc_id, line_no, content, case kind when 0 then content when 1 then '' when 2 then repeat('文', greatest(ceil(len / 3), 1)::int) when 3 then '抱歉，我无法翻译' when 4 then content || ' 文字' when 5 then repeat('文字', (len + 70)::int) when 6 then '文' end as translation from l),
    p as (select doc_id, line_no, content, translation, {sql.collapsed('content')} as p, {sql.collapsed("coalesce(translation, '')")} as tp from tr),
    q as (select *, {_language('p')} as s, {_language('tp')} as t from p),
    r1 as ({sql.rule('doc_id, line_no, content, translation, p, tp, s, t', 'q')}),
    r2 as (select doc_id, line_no, content, translation, p as p0, tp, s as p, t, rule as rule0 from r1), r3 as ({sql.rule('doc_id, line_no, content, translation, p0, tp, p, t, rule0', 'r2')}),
    f as (select doc_id, line_no, translation, rule0, tp, p as s, t, rule is not null or {sql.structured_row('p')} as exempt, list_sort(regexp_extract_all(p0, '{sql.IDENTIFIER}')) <> list_sort(regexp_extract_all(tp, '{sql.IDENTIFIER}')) as changed,
        length(p) as n, length(t) as m, len(regexp_extract_all(t, '[一-鿿]')) as cjk, len({sql.english_words('p')}) as words, len(regexp_extract_all(p, '[A-Za-z]')) as letters, list_distinct({sql.english_words('lower(p)')}) as a, list_distinct({sql.english_words('lower(t)')}) as b,
        regexp_extract_all(regexp_replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '[^A-Za-z0-9.]', '  ', 'g'), '(?:^|[^A-Za-z0-9])(\d+(?:\.\d+)+[A-Za-z]?|\d{{2,}}[A-Za-z]?)(?:[^A-Za-z0-9]|$)', 1) as anchors from r3),
    g as (select *, case when len(a) > 0 and len(b) > 0 then len(list_intersect(a, b)) / len(a) else 0 end as shared, len(list_filter(anchors, lambda x: not contains(replace(t, ',', ''), x))) > 0 as lost from f),
    v as (select doc_id, line_no, translation, case when rule0 is not null then null when tp = '' then 'empty' when changed then 'identifiers changed' when exempt then null when cjk > 0 and m > greatest(ceil(n * 1.40::double), n + 64) then 'too long'
        when n < 200 and (n <= 12 or (words <= 2 and n <= 18)) then null when n < 200 and m = 0 then 'empty'
        when n < 200 and cjk > 0 and regexp_matches(tp, '抱歉|对不起|无法翻译|不能翻译|作为(?:一个)?(?:AI|人工智能)|^以下是|译文如下|I cannot|I can''t|I''m sorry') then 'refusal'
        when n < 200 and cjk > 0 and letters >= 80 and cjk < greatest(8, ceil(letters * 0.07::double)) then 'too short' when n < 200 and cjk > 0 and n <= 60 and words <= 8 and m > greatest(24, ceil(n * 1.45::double)) then 'too long'
        when n < 200 and cjk > 0 and lost then 'numbers lost' when n < 200 and cjk > 0 then null when lower(t) = lower(s) then 'not translated' when n < 200 and shared >= 0.6 then 'not translated' when n < 200 then null
        when cjk < greatest(20, floor(n * 0.06::double)) then 'too little Chinese' when shared >= 0.7 and cjk < greatest(24, floor(m * 0.15::double)) then 'not translated' when m / greatest(n, 1) < 0.12 then 'too short' end as reason from g)
"""
_TAG = r"""<!--(?s:.*?)-->|<(?:[^"''>]|"[^"]*"|''[^'']*'')*>"""
_FAILURE_LIST = ", ".join(map(sql.quoted, _FAILURES))

ORACLES = {
    "cache_identities": """select doc_id, sha256('{"lang":' || case when lang = 'en' then 'null' else '"' || lang || '"' end || ',"n_chars":' || n_chars || ',"source":"' || source || '"}') as identity from documents""",
    "checkpoint_reuse": f"with {_SEGMENTS} select doc_id, seg_id, 't' || seg_id as translation from seg where doc_id % 5 <> 0 and line_no % 4 <> 0 and line_no % 3 <> 0",
    "line_batches": f"""
        with recursive {_SEGMENTS}, z as (select doc_id, seg_id, strlen(to_json(seg_id)::varchar) + 2 + strlen(to_json(source)::varchar) as n, row_number() over (partition by doc_id order by seg_id) as r from seg),
        b as (select doc_id, seg_id, r, 0 as batch_no, 2 + n as size from z where r = 1
            union all select z.doc_id, z.seg_id, z.r, case when b.size + 2 + z.n > 2000 then b.batch_no + 1 else b.batch_no end, case when b.size + 2 + z.n > 2000 then 2 + z.n else b.size + 2 + z.n end from b join z on z.doc_id = b.doc_id and z.r = b.r + 1)
        select doc_id, batch_no::bigint as batch_no, min(seg_id) as first, count(*) as n from b group by 1, 2
    """,
    "throttle": f"""
        with recursive e as (select user_id as stream, {_KIND} as kind, event_id as seq, epoch_us(ts) as ts, row_number() over (partition by user_id, {_KIND} order by event_id) as r from events),
        s as (select stream, kind, seq, r, ts as last, true as sent, 0::bigint as held, 0::bigint as merged from e where r = 1
            union all select e.stream, e.kind, e.seq, e.r, case when g.go then e.ts else s.last end, g.go, case when g.go then 0 else s.held + 1 end, case when g.go then s.held end
            from s join e on e.stream = s.stream and e.kind = s.kind and e.r = s.r + 1, lateral (select e.ts - s.last >= 86400000000 as go) g)
        select stream, kind, seq, sent, merged from s
    """,
    "admission": """
        with recursive e as (select user_id % 20 as queue, event_id as seq, event_type <> 'error' as reserve, event_id % 17 as task, (value * 1000)::double as v, row_number() over (partition by user_id % 20 order by event_id) as r from events),
        j as (select queue, seq, reserve, task, trunc(v)::bigint as size, r from e),
        s as (select queue, 0::bigint as seq, 0::bigint as r, 0::bigint as task, null::boolean as admitted, []::struct(task bigint, size bigint)[] as held from (select distinct queue from j)
            union all select j.queue, j.seq, j.r, j.task, case when j.reserve then f.fits end, case when not j.reserve then list_filter(s.held, lambda h: h.task <> j.task) when f.fits and not f.own then list_append(s.held, {'task': j.task, 'size': j.size}) else s.held end
            from s join j on j.queue = s.queue and j.r = s.r + 1, lateral (select len(list_filter(s.held, lambda h: h.task = j.task)) > 0 as own, j.size >= 0 and (len(list_filter(s.held, lambda h: h.task = j.task)) > 0
                or (len(s.held) < 8 and coalesce(list_sum(list_transform(s.held, lambda h: h.size)), 0) + j.size <= 200000)) as fits) f)
        select queue, seq, task, admitted from s where r > 0
    """,
    "failover_replay": """
        with recursive e as (select user_id as stream, event_id as seq, epoch_us(ts) / 1e6 as ts, case when event_id % 7 = 0 then 'unusable' when event_id % 11 = 0 then 'error' else 'ok' end as p, case when event_id % 5 = 0 then 'unusable' when event_id % 11 = 0 then 'error' else 'ok' end as b,
            row_number() over (partition by user_id order by event_id) as r from events),
        s as (select stream, 0::bigint as seq, 0::bigint as r, 0 as active, 0.0::double as since, 'primary' as alerted, null::int as served, false as switched, false as probe, null::varchar as alert from (select distinct stream from e)
            union all select e.stream, e.seq, e.r, z.active, z.since, coalesce(z.state, s.alerted) as alerted, z.served, z.switched, z.probe, case when z.state is not null and z.state <> s.alerted then case z.state when 'primary' then 'restored' when 'backup' then 'switched' else 'all_dead' end end
            from s join e on e.stream = s.stream and e.r = s.r + 1, lateral (
                select *, case when served is not null then case when served = 0 and active = 0 then 'primary' when served = 1 and active <> 0 then 'backup' end when first = 'unusable' and second = 'unusable' then 'all_dead' end as state from (
                select *, case when first = 'ok' then one when (first = 'unusable' or (probe and first = 'error')) and second = 'ok' then 1 - one end as served,
                    case when first = 'unusable' then 1 - one when probe and first = 'ok' then 0 else s.active end as active, first = 'unusable' as switched,
                    case when first = 'unusable' or (probe and first = 'error') then e.ts else s.since end as since from (
                select *, case when one = 0 then e.p else e.b end as first, case when one = 0 then e.b else e.p end as second from (
                select s.active <> 0 and e.ts - s.since >= 21600 as probe, case when s.active = 0 or e.ts - s.since >= 21600 then 0 else 1 end as one)))) z)
        select stream, seq, case served when 0 then 'primary' when 1 then 'backup' else 'none' end as served, case active when 0 then 'primary' else 'backup' end as active, switched, probe, alert from s where r > 0
    """,
    "first_jobs": "select user_id, event_type, min(event_id) as seq from events group by 1, 2",
    "restarts": """
        with t as (select (['done', 'failed', 'deleted', 'queued', 'running'])[event_id % 5 + 1] as status, (['pdf', 'epub', 'other'])[event_id % 3 + 1] as type, case when event_id % 7 > 0 then event_id % 7 > 1 end as has_source from events)
        select status, type, case when status in ('done', 'failed', 'deleted') then 'leave' when not coalesce(has_source, false) then 'fail' when type in ('pdf', 'epub') then 'resume' else 'fail' end as action, count(*) as n from t group by 1, 2, 3
    """,
    "retry_delays": "select event_id, least(case event_id % 4 when 0 then event_id % 200 + 1.0 when 1 then event_id % 90 + 1.5 when 2 then event_id % 50 + 1.0 else 12.0 * 2 ** (event_id % 6) end, 90.0)::double as delay from events",
    "failure_classes": f"""
        with m as (select lower(([{_FAILURE_LIST}])[event_id % {len(_FAILURES)} + 1]) as m from events)
        select case when contains(m, 'all llm key slots unusable') then 'keys_dead' when regexp_matches(m, 'interrupted|service stopped|restart') then 'interrupted' when regexp_matches(m, 'internal error|worker crashed') then 'internal'
            when regexp_matches(m, 'every page kept its source|all pages fell back') then 'all_source' when regexp_matches(m, 'failed to open|cannot open|epub mimetype|archive member') then 'unparsable' end as failure, count(*) as n from m group by 1
    """,
    "outcome_coverage": """
        with o as (select user_id, case when event_type = 'error' then 'failed' when event_id % 10 = 0 then 'preserved' else 'translated' end as status, case when event_type = 'error' then 'reason ' || event_id % 4 end as reason from events),
        c as (select user_id, count(*) as n, count_if(status = 'translated')::bigint as n_translated, count_if(status = 'preserved')::bigint as n_preserved, count_if(status = 'failed')::bigint as n_failed, coalesce(string_agg(distinct reason, '|' order by reason), '') as reasons from o group by 1),
        b as (select *, round(n_translated / greatest(n - n_preserved, 1), 9) as ratio, least(greatest(2, floor(0.05 * n)), floor(0.2 * n))::bigint as budget from c) select *, n_failed <= budget as publish from b
    """,
    "best_candidates": """
        with c as (select conv_id, turn, (conv_id * 3 + turn * 5) % 7 as n from conversations)
        select conv_id, case when n > 0 then repeat('文', n::int) || ' t' || turn end as candidate, n as n_cjk from c qualify row_number() over (partition by conv_id order by n desc, turn) = 1
    """,
    "translation_verdicts": f"with {_VERDICTS} select doc_id, coalesce(reason, 'fine') as reason, count(*) as n from v where translation is not null group by 1, 2",
    "page_verdicts": f"""
        with {_VERDICTS}, i as (select doc_id, line_no, case when translation is null then 'missing' else reason end as reason from v)
        select doc_id, count(*) as n_elements, count(reason) as n_issues, min(line_no) filter (where reason is not null) as first, arg_min(reason, line_no) filter (where reason is not null) as reason from i group by 1
    """,
    "updated_records": """
        select 't' || event_id as task_id, case when event_id % 3 > 0 and event_id % 2 = 0 then 'saved' when event_id % 3 < 2 then event_type end as status, case when event_id % 3 > 0 and event_id % 5 = 0 then 'late' end as error, case when event_id % 3 < 2 then user_id end as total from events
    """,
    "ledger_totals": "select 'm' || role as model, count(*) as n, sum(length(text))::bigint as prompt_tokens, sum(length(text) * 7)::bigint as total_tokens, sum(length(text)) / 1000 as cost from conversations group by 1",
    "saved_caches": "select doc_id, doc_id % 10 as page_no, md5(text) as translation from documents where doc_id % 7 <> 0 and doc_id % 5 <> 0 and doc_id % 3 <> 0",
    "recognised": "select p_partkey % 20 as doc_id, p_partkey % 3 as block, p_partkey as word, p_name as text, p_partkey % 50 / 2.0::double as x0, (p_partkey % 60 + 9) / 2.0::double as y1 from part where p_partkey % 4 <> 0 and p_partkey % 101 >= 30 and p_partkey % 9 <> 0",
    "archived_pages": """
        select page_id // 20 as book, printf('p%06d.xhtml', page_id) as member, md5(html) as content from pages
        union all select distinct page_id // 20, 'content.opf', md5('<dc:language id=''l''>zh</dc:language> ' || (page_id // 20)) from pages
    """,
    "rendered_pages": "select page_id as doc_id, md5(html) as html from pages",
    "markup_profile": f"select page_id, len(regexp_extract_all(html, '{_TAG}')) as n_tags, md5(regexp_replace(html, '{_TAG}', '', 'g')) as shown from pages",
    "segment_flags": rf"""
        with i as (select *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as n, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as y from part),
        t as (select p_partkey, p_partkey % 4 = 0 as heading, case p_partkey % 6 when 0 then upper(p_name[1:3]) when 1 then n when 2 then 'the ' || p_name when 3 then 'XIV' when 4 then 'B.' else n || ' of the ' || y end as t from i),
        w as (select *, regexp_extract_all(t, '[A-Za-z]+(?:[''’\-][A-Za-z]+)*') as ws, regexp_extract_all(regexp_replace(t, '\b[A-Z]\.\s*', '', 'g'), '[A-Za-z]+(?:[''’\-][A-Za-z]+)*') as bw from t),
        f as (select *, regexp_matches(t, '[A-Za-z]') and not regexp_full_match(t, '[A-Za-z]\.?') as asks, len(bw) > 0 and len(list_filter(bw, lambda x: lower(x) in {sql.names([w for w in fixed.PROSE_WORDS if w not in (*fixed.NAME_CONNECTORS, 'new', 'may', 'will')])})) = 0
            and len(list_filter(bw, lambda x: not (lower(x) in {sql.names(fixed.NAME_CONNECTORS)} or regexp_matches(x, '^[A-Z]') or regexp_matches(x, '[a-z][A-Z]')))) = 0 as is_names from w)
        select p_partkey, asks, is_names, asks and case when heading then t not in {sql.names(fixed.HEADING_ACRONYMS)} when regexp_full_match(t, '(?i){fixed.ROMAN}') then false
            when len(ws) = 1 and regexp_full_match(ws[1], '[A-Z]{{1,5}}') then lower(ws[1]) in {sql.names(fixed.PROSE_WORDS)} else not is_names end as needs_chinese from f
    """,
    "placeholder_roundtrip": rf"""
        with {sql.LINES}, m as (select doc_id, line_no, len(regexp_extract_all(line, '{sql.IDENTIFIER}')) + case when line_no % 3 = 0 then 2 else 0 end as n from lines)
        select doc_id, count(*) as n_lines, sum(n)::bigint as n_tokens, count(*) as n_same, sum(n)::bigint as n_leaks from m group by 1
    """,
    "envelope_roundtrip": f"with {sql.LINES} select doc_id, count(*) as n, true as same, count(*) = 1 as turned from lines group by 1",
    "spelt_numbers": """
        with n as (select o_orderkey, o_orderkey % 900 + 100 as n, o_orderdate as d, lpad((o_orderkey % 100)::varchar, 2, '0') as y from orders)
        select o_orderkey, n || '250|-' || n || '.5%|-' || n || '.25|D' || year(d) || '-' || month(d) || '-' || day(d) || '|Y' || y || '|' || n || '|-' || n || '.0' as numbers from n
    """,
    "number_guards": "select o_orderkey, case o_orderkey % 5 when 1 then 'numeric-row-numbers-changed' when 2 then 'numeric-row-numbers-changed' when 3 then 'label-acquired-numbers' end as failure from orders",
    "kept_signs": "select o_orderkey, case when o_orderkey % 4 in (1, 2) then 'prose-number-missing' end as failure, case when o_orderkey % 4 = 3 then 'which is what they said in all of it' else '' end as leaks from orders",
    "repaired_segments": """
        select p_partkey as p_partkey, case when p_partkey % 3 > 0 then '<span id="p' || p_partkey || '"/>一些<b>这里 ' || p_partkey || '</b>' end as accepted,
            case when p_partkey % 3 = 0 then case when p_partkey % 2 = 1 then 'empty or non-string translation' else 'insufficient Chinese coverage (0 < 1)' end end as failure, p_partkey % 3 > 0 or p_partkey % 2 = 0 as repaired,
            '<span class="d">到</span> ' || p_partkey || ' 年' as initial, '质量<sup>' || p_partkey || '</sup> 和 ' || p_partkey as raised from part
    """,
}
