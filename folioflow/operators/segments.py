"""Segments of pages as tables, and rounds of translation over them."""

from __future__ import annotations

import hashlib
import html
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M

_FRAGMENTS = pa.list_(pa.struct([("token", pa.string()), ("original", pa.string())]))
_SEGMENT = pa.schema([("doc_id", pa.int64()), ("seg_id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("source", pa.string()), ("original", pa.string()), ("fragments", _FRAGMENTS)])
SEGMENT_SCHEMA = "doc_id long, seg_id string, start int, end int, kind string, source string, original string, fragments array<struct<token string, original string>>"


def verdicts(pages: DataFrame) -> DataFrame:
    """(doc_id, reason): why the strict reader rejects a page; null where it doesn't. pages: doc_id, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reasons = [M.xhtml_verdict(x or "") for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(reasons, pa.string())], ["doc_id", "reason"])

    return pages.select("doc_id", "html").mapInArrow(run, "doc_id long, reason string")


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _row(doc_id: int, s: M.Segment) -> tuple:
    return (doc_id, s.id, s.start, s.end, s.kind, s.source, s.original, [{"token": t, "original": o} for t, o in s.fragments])


def segments(pages: DataFrame, *, strict: bool = False) -> DataFrame:
    """SEGMENT_SCHEMA of pages (doc_id, html). Strict: pages that aren't well-formed have none (see verdicts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, source in zip(b.column("doc_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                if source and not (strict and M.xhtml_verdict(source)):
                    rows += [_row(doc_id, s) for s in M.segments(source, strict)]
            yield _batch(_SEGMENT, rows)

    return pages.select("doc_id", "html").mapInArrow(run, SEGMENT_SCHEMA)


def _read(b: pa.RecordBatch) -> list[tuple[int, M.Segment]]:
    names = ("doc_id", "seg_id", "start", "end", "kind", "source", "original", "fragments")
    return [(d, M.Segment(i, a, z, k, s, o, tuple((f["token"], f["original"]) for f in fs))) for d, i, a, z, k, s, o, fs in zip(*(b.column(n).to_pylist() for n in names), strict=True)]


def roundtrip(parts: DataFrame) -> DataFrame:
    """(doc_id, seg_id, n_fragments, same): whether text protected and restored, entities spelt anew, reads as the original."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("seg_id", pa.string()), ("n_fragments", pa.int64()), ("same", pa.bool_())])
        for b in batches:
            rows = []
            for doc_id, s in _read(b):
                anew = M.restored(M.Segment(s.id, s.start, s.end, s.kind, s.source + "\0", s.original, s.fragments), s.source)
                same = M.restored(s, s.source) == s.original and html.unescape(anew) == html.unescape(s.original)
                rows.append((doc_id, s.id, len(s.fragments), same))
            yield _batch(schema, rows)

    return parts.mapInArrow(run, "doc_id long, seg_id string, n_fragments long, same boolean")


def stand_in(text: str) -> str:
    """A translator for tests: each Latin word becomes two Chinese characters picked by its hash; tokens stay."""
    out, at = [], 0

    def words(x: str) -> str:
        return M.WORD.sub(lambda m: "".join(chr(0x4E00 + b * 64 % 20_000) for b in hashlib.sha256(m[0].encode()).digest()[:2]), x)

    for m in M.TOKEN.finditer(text):
        out += [words(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, words(text[at:])])


def _attempt(translate: Callable[[str], str]):
    schema = pa.schema([*_SEGMENT, ("translation", pa.string()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, s in _read(b):
                text = M.with_anchors(s, M.moved_initial(s, translate(s.source)))
                why = M.failure(s, text)
                rows.append((*_row(doc_id, s), None if why else text, why))
            yield _batch(schema, rows)

    return run


def translated(spark: SparkSession, parts: DataFrame, translate: Callable[[str], str], folder: str, *, rounds: int = 4) -> DataFrame:
    """parts with translation, reason, round and status (translated, preserved, failed).

    Segments without words keep their text. Each round's outcome is written under `folder` before the next one reads it, so that no
    translator is asked twice for what it gave. Only what failed goes on.
    """
    base = f"{folder}/{uuid.uuid4().hex}"
    shown = F.regexp_replace("source", r"\[\[PH_\d{4,}_[0-9A-F]{8}\]\]", "")
    asks = shown.rlike("[A-Za-z]") & ~shown.rlike(r"(?U)^\s*[A-Za-z]\.?\s*$")
    parts.withColumn("asks", asks).write.parquet(f"{base}/parts")
    pending = spark.read.parquet(f"{base}/parts")
    done = [pending.filter("not asks").select(*parts.columns, F.col("source").alias("translation"), F.lit(None).cast("string").alias("reason"), F.lit(0).alias("round"), F.lit("preserved").alias("status"))]
    pending = pending.filter("asks").drop("asks")
    for k in range(1, rounds + 1):
        pending.select(*[f.name for f in _SEGMENT]).mapInArrow(_attempt(translate), SEGMENT_SCHEMA + ", translation string, reason string").write.parquet(f"{base}/round-{k}")
        got = spark.read.parquet(f"{base}/round-{k}").withColumn("round", F.lit(k))
        done.append(got.filter("reason is null").withColumn("status", F.lit("translated")))
        pending = got.filter("reason is not null")
        if pending.isEmpty():
            break
    else:
        done.append(pending.withColumn("status", F.lit("failed")))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def coverage(outcome: DataFrame, *by: str, floor: int = 2, ratio: float = 0.05, share: float = 0.2) -> DataFrame:
    """Counts by status, the ratio translated, the first reasons, and whether failures keep to the budget
    min(max(floor, ratio * n), share * n)."""
    n = F.count("*")
    counts = outcome.groupBy(*by).agg(
        n.alias("n"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("translated", "preserved", "failed")), F.slice(F.sort_array(F.collect_set("reason")), 1, 100).alias("reasons")
    )
    budget = F.least(F.greatest(F.lit(floor), F.floor(ratio * F.col("n"))), F.floor(share * F.col("n"))).cast("long")
    return counts.withColumns({"ratio": F.col("n_translated") / F.greatest(F.col("n") - F.col("n_preserved"), F.lit(1)), "budget": budget}).withColumn("publish", F.col("n_failed") <= F.col("budget"))


def rendered(pages: DataFrame, outcome: DataFrame) -> DataFrame:
    """(doc_id, html): pages with the translations of their segments; a segment that failed keeps its text."""
    parts = outcome.withColumn("put", F.coalesce("translation", "source")).groupBy("doc_id").agg(
        F.collect_list(F.struct("seg_id", "start", "end", "kind", "source", "original", "fragments", "put")).alias("parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for source, rows in zip(b.column("html").to_pylist(), b.column("parts").to_pylist(), strict=True):
                pairs = [(M.Segment(r["seg_id"], r["start"], r["end"], r["kind"], r["source"], r["original"], tuple((f["token"], f["original"]) for f in r["fragments"])), r["put"]) for r in rows or []]
                out.append(None if source is None else M.render(source, pairs))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "html"])

    return pages.select("doc_id", "html").join(parts, "doc_id", "left").mapInArrow(run, "doc_id long, html string")
