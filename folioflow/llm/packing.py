"""Best-fit packing of token sequences under several capacities at once.

A bin (a training sequence) has three capacities: tokens, documents, and attention cost (the sum of squared lengths). A
piece of length l asks for (l, 1, l * l). Pieces go by falling length; each goes to the bin that suits it best under every
constraint: by `norm`, the bin with the smallest weighted norm of what would be left; by `dot`, the one with the greatest
weighted dot product of the demand and what is left. Only if none takes it a new bin is opened.

The demand is a function of the length, so the plan needs only how many pieces have each length: at most `tokens`
numbers, whatever the number of documents. Bins with the same rest are handled together. The plan is a list of runs (the
pieces of a length from one rank to another fill these bins at this offset); its size doesn't depend on the number of
pieces. Ranks within a length come from counts by (length, bucket) and a sort within each, so no length lands in one
task.

Results: null or empty texts are the end id alone; repeated rows are packed each; a row with a null doc_id is packed like
any other. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_ids, shuffle_partitions, small_batches, written


@dataclass(frozen=True)
class Tokenizer:
    """Byte-level BPE from two files of one vocabulary: `json` rules, `ranks` is the faster reader of the same.

    Texts that hold the string of a special token take the `json` path.
    """

    json: str
    ranks: str
    end_id: int
    specials: tuple[str, ...] = ("<|endoftext|>",)

    def reader(self):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer as Json

        with open(self.ranks, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        fast, slow = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), []

        def read(text: str) -> np.ndarray:
            if any(s in text for s in self.specials):
                if not slow:
                    slow.append(Json.from_file(self.json))
                return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4")
            return fast.encode_to_numpy(text, disallowed_special=())

        return read


def _pieces(tokenizer: Tokenizer, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, ids = tokenizer.reader(), row_ids()
        names = ["rid", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rid = next(ids)
                body = np.append(read(text or ""), np.uint32(tokenizer.end_id)).astype("<u4").tobytes()
                n = len(body) // 4
                cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = body[4 * a : 4 * b]
                    for column, x in zip(out, (rid, doc_id, k, a, b - a, zlib.crc32(part), part), strict=False):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return run


def token_pieces(docs: DataFrame, tokenizer: Tokenizer, *, size: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `size` ids, the first of a document the shorter one; with_ids adds the ids, little-endian."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(_pieces(tokenizer, size, with_ids), schema)


@dataclass(frozen=True)
class Capacity:
    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024


def plan_bins(
    counts: dict[int, int], capacity: Capacity, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm"
) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first bin, pieces a bin, offset) that place all pieces of each length."""
    if rule not in ("norm", "dot"):
        raise ValueError(rule)
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=np.int64)
    scale = np.sqrt(np.array(weights)) / full
    rests = np.empty((0, 3), dtype=np.int64)  # of the groups of like bins
    first, many = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    runs, n_bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], dtype=np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} fits no bin")

        def place(rest, at, bins, offset, length=length, need=need):
            """Fill `bins` bins from `at` on as the rule goes on; what is then left of pieces, and the new groups."""
            nonlocal left, rank
            deep = int((rest // need).min()) if rule == "norm" else 1
            made = []
            whole = min(bins, left // deep)
            for n, each in ((whole, deep), (1, left - whole * deep if whole < bins else 0)):
                if n and each:
                    runs.append((length, rank, n * each, at, each, offset))
                    made.append((rest - each * need, at, n))
                    rank, left, at, bins = rank + n * each, left - n * each, at + n, bins - n
            if bins:
                made.append((rest, at, bins))
            return made

        while left:
            fits = np.flatnonzero((rests >= need).all(axis=1))
            if len(fits):
                if rule == "norm":
                    best = fits[np.argmin((((rests[fits] - need) * scale) ** 2).sum(axis=1))]
                else:
                    best = fits[np.argmax(((rests[fits] * scale) * (need * scale)).sum(axis=1))]
                made = place(rests[best], int(first[best]), int(many[best]), int(full[0] - rests[best][0]))
                rests, first, many = np.delete(rests, best, 0), np.delete(first, best), np.delete(many, best)
            else:
                bins = -(-left // int((full // need).min()))
                made = place(full, n_bins, bins, 0)
                n_bins += bins
            for rest, at, n in made:
                if rest[0] > 0 and rest[1] > 0 and rest[2] > 0:
                    rests, first, many = np.vstack([rests, rest]), np.append(first, at), np.append(many, n)
    return runs


def pack(
    pieces: DataFrame, capacity: Capacity, *, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm"
) -> DataFrame:
    """The pieces with sequence_id and offset. pieces: rid, doc_id, piece and length; read twice, so better written before."""
    spark = pieces.sparkSession
    bucket = F.pmod(F.xxhash64("rid", "piece"), F.lit(max(8, shuffle_partitions(spark)))).cast("int")
    dealt = pieces.withColumn("bucket", bucket)
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `tokens` rows
    runs = plan_bins(counts, capacity, weights, rule)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("rid", "piece")
    ranked = dealt.join(sizes, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1).drop("before", "bucket")
    schema = "run_length long, from_rank long, n long, first_bin long, each long, at long"
    plan = spark.createDataFrame(runs, schema)
    within_run = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("n"))
    k = F.col("rank") - F.col("from_rank")
    return (
        ranked.join(F.broadcast(plan), within_run)  # the size of the plan depends on the capacities alone
        .withColumn("sequence_id", F.col("first_bin") + F.expr("(rank - from_rank) div each"))
        .withColumn("offset", F.col("at") + k % F.col("each") * F.col("length"))
        .drop("rank", *plan.columns)
    )


def packed_documents(
    docs: DataFrame, tokenizer: Tokenizer, capacity: Capacity | None = None, *, with_ids: bool = False, rule: str = "norm"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    With the default capacities only tokens bind: 1024 tokens are never more than 1024 pieces nor cost more than 1024 squared, so the
    plan is best fit by tokens, which is what fewest sequences ask for. Smaller capacities for documents or attention bind too.
    """
    capacity = capacity or Capacity()
    pieces = written(token_pieces(docs, tokenizer, size=capacity.tokens, with_ids=with_ids), "pieces")
    return pack(pieces, capacity, rule=rule).drop("rid")
