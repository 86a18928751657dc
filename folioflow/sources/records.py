"""Records kept as files: tasks, caches, ledgers, glossaries, and recognised text."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TASK = "task_id string, status string, progress double, total long, type string, filename string, error string, created_at double, updated_at double"
LEDGER = (
    "schema int, ts double, model string, key_slot string, provider string, prompt_tokens long, prompt_cache_hit_tokens long, prompt_cache_miss_tokens long, "
    "cache_creation_input_tokens long, completion_tokens long, total_tokens long, conservative_cost_usd decimal(20,10)"
)
SIDECARS = r"\.(?:audit|cache|checkpoint|layout|tmp)\.json$"


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task records, one JSON file each; files beside them that aren't records are passed over."""
    each = spark.read.schema(TASK).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    name = F.col("_metadata.file_name")
    return each.select("*", name.alias("__file")).filter(~F.col("__file").rlike(SIDECARS)).withColumn("task_id", F.coalesce("task_id", F.regexp_replace("__file", r"\.json$", ""))).drop("__file")


def updated(old: DataFrame, new: DataFrame, key: str = "task_id") -> DataFrame:
    """Records of both; a new one keeps the fields of the old that it doesn't set."""
    n = new.select(key, *(F.col(c).alias(f"__{c}") for c in new.columns if c != key))
    return old.join(n, key, "full").select(key, *(F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in n.columns else F.col(c) for c in old.columns if c != key))


def save(df: DataFrame, path: str, *by: str) -> None:
    """Write a table for the first time or anew; readers see all of it or none, since a job's files appear when it commits."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path)


def page_cache(spark: SparkSession, path: str, source_sha256: Column, schema_version: int = 2) -> DataFrame:
    """Cached translations (doc_id, page_no, identity, translation) of a source that hasn't changed since."""
    rows = spark.read.parquet(path)
    return rows.filter((F.col("schema_version") == schema_version) & (F.col("source_sha256") == source_sha256) & F.col("identity").rlike("^[0-9a-f]{64}$"))


def glossary(spark: SparkSession, path: str | None, most_bytes: int = 1 << 20) -> DataFrame:
    """(source, target, ord) of a JSON object of one-line strings of at most 1 MiB."""
    rows: list[tuple[str, str, int]] = []
    if path is not None:
        file = Path(path)
        if not file.is_file():
            raise ValueError(f"no glossary at {path}")
        if file.stat().st_size > most_bytes:
            raise ValueError("the glossary exceeds its size")
        found = json.loads(file.read_text(encoding="utf-8"))
        if not isinstance(found, dict) or not all(isinstance(x, str) for kv in found.items() for x in kv):
            raise ValueError("a glossary is a JSON object of strings")
        rows = [(k.strip(), v.strip(), i) for i, (k, v) in enumerate(found.items())]
        if any(not x or "\n" in x for k, v, _ in rows for x in (k, v)):
            raise ValueError("glossary entries are one line and not empty")
    return spark.createDataFrame(rows, "source string, target string, ord int")


def glossary_prompt(hits: DataFrame, most: int = 500) -> DataFrame:
    """(doc_id, glossary): lines ``source = target`` by count, then place, then name. hits: of joins.glossary_hits."""
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), "first_offset", F.lower("source").alias("c"), "source", "target"))), 1, most)
    return hits.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["source"], F.lit(" = "), x["target"])), "\n").alias("glossary"))


def with_glossary(prompt: Column, lines: Column) -> Column:
    return F.when(F.coalesce(F.trim(lines), F.lit("")) == "", prompt).otherwise(F.concat(prompt, F.lit("\n\n"), lines))


TSV = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"


def recognised_words(tsv: DataFrame, scale: float = 1.0, least: float = 0.0) -> DataFrame:
    """Words of recognition tables (doc_id, page_no, tsv text with a header) with their boxes in page points."""
    rows = tsv.select("doc_id", "page_no", F.posexplode(F.split("tsv", "\r?\n")).alias("i", "row")).filter((F.col("i") > 0) & (F.col("row") != ""))
    words = rows.select("doc_id", "page_no", "i", F.from_csv("row", TSV, {"sep": "\t", "quote": "\0"}).alias("w"))
    box = F.struct(*((F.col(f"w.{a}") + (F.col(f"w.{b}") if b else 0.0)).alias(n) for n, a, b in (("x0", "left", None), ("y0", "top", None), ("x1", "left", "width"), ("y1", "top", "height"))))
    scaled = F.struct(*((box[n] / scale).alias(n) for n in ("x0", "y0", "x1", "y1")))
    kept = words.filter((F.col("w.level") == 5) & (F.col("w.conf") >= least) & (F.trim("w.text") != ""))
    return kept.select("doc_id", "page_no", F.col("w.block_num").alias("block"), F.col("w.line_num").alias("line"), F.col("w.word_num").alias("word"), F.trim("w.text").alias("text"), F.col("w.conf").alias("conf"), scaled.alias("box"))
