"""Term candidates for a glossary."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# An acronym, and a capitalised phrase with the small words that may stand in it.
ACRONYM = re.compile(r"(?<![\w.-])[A-Z][A-Z0-9&.-]{1,15}(?![\w.-])")
PHRASE = re.compile(r"(?<![\w.-])(?:[A-Z][A-Za-z'’.-]{2,}(?:\s+(?:of|the|and|for|in|on|de|[A-Z][A-Za-z'’.-]{2,})){0,4})(?![\w.-])")


def top_tokens(docs: DataFrame, most: int = 500) -> DataFrame:
    """(term, n, n_docs, first_doc) of single tokens that look like acronyms or names; the commonest."""
    token = F.explode(F.split("text", r"[\x20\x09-\x0D]+"))
    words = docs.select("doc_id", token.alias("w")).select("doc_id", F.regexp_replace("w", "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "").alias("term"))
    words = words.filter(F.col("term").rlike("^(?:[A-Z][A-Z0-9&.-]{1,15}|[A-Z][A-Za-z]{2,})$"))
    each = words.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    counts = each.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return counts.orderBy(F.desc("n"), "term").limit(most)


def term_spans(text: str) -> list[tuple[int, str]]:
    """(offset, term) of distinct matches of either shape, in order."""
    spans = {(m.start(), m.end(), m[0].strip()) for shape in (ACRONYM, PHRASE) for m in shape.finditer(text)}
    return sorted((start, term) for start, _, term in spans)


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, terms, counts, firsts, folded = [], [], [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen: dict[str, list[int]] = {}
            for offset, term in term_spans(text or ""):
                seen.setdefault(term, [0, offset])[0] += 1
            for term, (n, first) in seen.items():
                ids.append(doc_id)
                terms.append(term)
                counts.append(n)
                firsts.append(first)
                folded.append(term.casefold())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64()), pa.array(folded, pa.string())],
            ["doc_id", "term", "n", "first_offset", "folded"],
        )


def candidates(docs: DataFrame, *, min_count: int = 1, most: int = 500) -> DataFrame:
    """(doc_id, term, n, first_offset): for each document its terms by count, then place, then name; at most so many."""
    from pyspark.sql import Window

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_document_terms, "doc_id long, term string, n long, first_offset long, folded string")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first_offset", "folded"))
    return found.filter(F.col("n") >= min_count).withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank", "folded")
