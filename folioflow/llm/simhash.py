"""SimHash near-duplicates by an inverted index over the bytes of the fingerprint.

Fingerprints within 3 of 64 bits share at least 5 of their 8 positional bytes (the guaranteed minimum). The postings are
kept by blocks of four byte positions: the 14 blocks {a, b, c, d} with a^b^c^d = 0 are a Steiner system S(3,4,8), so any
five positions contain exactly one block and a pair that shares five bytes meets in a posting. Single bytes as postings
would hold 1/256 of all fingerprints each; blocks hold 1/2**32. In a posting the shared bytes of each pair are
tallied, pairs under the minimum fall away, and the bits of the rest are counted.

Equal fingerprints enter the index once. A posting over `posting_rows` is cut into chunks and every pair of chunks is a
task of its own, which compares no further once all of its rows hang together (a family of near copies does after a few rows); a
task emits only a spanning forest of the links that it found, never all pairs.

Results: null or blank texts have fingerprint zero and link like any other; repeated rows each get a row; rows with a
null doc_id get a component, but don't name one. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, shuffle_partitions, small_batches, without, written

BLOCKS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def shingle_hashes(text: bytes, size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1].tolist()
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64 bits; a bit is 1 if over half of the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(t or b"", size)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return run


def _forest(fps: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, block: int, bits: int, least: int) -> Iterator[tuple[int, int]]:
    """Links (id, id of the smallest of its part) among pairs left x right of one posting."""
    free = [p for p in range(8) if p not in BLOCKS[block]]
    label = np.arange(len(fps))
    order = fps[right]
    for at in left:
        x = order ^ fps[at]
        shared = 4 + sum(((x >> np.uint64(8 * p)) & np.uint64(255)) == 0 for p in free)
        close = right[(shared >= least) & (np.bitwise_count(x) <= bits)]
        met = np.unique(np.append(label[close], label[at]))
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
            if not (label != label[0]).any():
                break
    for part in np.unique(label):
        members = np.flatnonzero(label == part)
        if len(members) > 1:
            least_id = int(ids[members].min())
            yield from ((i, least_id) for i in ids[members].tolist() if i != least_id)


def _verified(bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def links(group: list[tuple]) -> list[tuple[int, int]]:
            if len(group) == 2:
                (_, _, lo, hi, a, fa, ia), (_, _, _, _, b, fb, ib) = group
                x = (fa ^ fb) & (1 << 64) - 1
                if lo != hi and a == b:
                    return []
                if sum(not x >> 8 * p & 255 for p in range(8)) < least or x.bit_count() > bits:
                    return []
                return [(max(ia, ib), min(ia, ib))]
            fps = np.array([g[5] for g in group], dtype=np.int64).view(np.uint64)
            ids, chunk = np.array([g[6] for g in group], dtype=np.int64), np.array([g[4] for g in group])
            left, right = np.flatnonzero(chunk == group[0][2]), np.flatnonzero(chunk == group[0][3])
            return list(_forest(fps, ids, left, right, group[0][0], bits, least))

        out: list[tuple[int, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "bytes", "lo", "hi", "chunk", "fp", "rep")), strict=True):
                if row[:4] != now:
                    if len(held) > 1:
                        out += links(held)
                    held, now = [], row[:4]
                held.append(row)
            if len(out) > 50_000:
                yield _links(out)
                out = []
        if len(held) > 1:
            out += links(held)
        yield _links(out)

    return run


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def fingerprint_links(prints: DataFrame, *, bits: int = 3, posting_rows: int = 4096) -> DataFrame:
    """Links (u, v) that join all fingerprints (fp, rep) within `bits` bits, as forests per posting; bits is at most 3."""
    if not 0 <= bits <= 3:
        raise ValueError("the byte index guarantees pairs up to 3 bits")
    n = shuffle_partitions(prints.sparkSession)
    masks = F.array(*[F.lit(_signed(sum(255 << 8 * p for p in b))) for b in BLOCKS])
    index = prints.select("fp", "rep", F.posexplode(masks).alias("block", "mask")).select("fp", "rep", "block", F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"))
    postings = index.groupBy("block", "bytes").count().filter("count > 1")
    chunks = F.ceil(F.col("count") / posting_rows).cast("int")
    dealt = (
        index.join(postings, ["block", "bytes"])
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("block", "bytes", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "fp", "rep")
    )
    keys = ["block", "bytes", "lo", "hi"]
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_verified(bits, 8 - bits), "u long, v long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash_components(docs: DataFrame, *, shingle: int = 3, bits: int = 3, posting_rows: int = 4096) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    of_docs = written(rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "simhash")
    prints = checkpointed(of_docs.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = fingerprint_links(prints.filter("rep is not null"), bits=bits, posting_rows=posting_rows)
    parts = connected_components(links)
    named = prints.join(parts, prints["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return of_docs.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose id names their component, with all their columns; rows without any id to name them stay."""
    found = simhash_components(docs, **options)
    return without(docs, found.filter("component_id is not null and not doc_id <=> component_id"))
