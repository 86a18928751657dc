"""Exact deduplication by an extendible-hash index on shared files.

1. A scan hashes every normalised text (XXH64) and counts the keys. Keys seen more than once set bits in a filter of
   bounded size (`filter_bits`); a full filter only lets more rows through.
2. A second scan writes the index pages to the shared folder. Texts whose key may repeat are first compared byte by
   byte within the task, so that a huge group of copies leaves one text per task, and its members only their ids.
3. The directory starts with one bucket and doubles while a bucket is over capacity. Owners hold ranges of
   buckets. An owner reads its pages in key order and chains the texts of one key, comparing bytes: a collision gets a
   place of its own on the chain.

Only texts that may repeat are moved, and the shuffle by owner holds at most one copy per scan task.

Results: null texts count as empty; all empty (or blank) texts are one group; rows with equal doc_id are documents of
their own (one of them stays); a null doc_id loses every tie. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, row_ids, shuffle_partitions, small_batches, without, written

PAGE_SCHEMA = "rid long, lid long, key long, doc_id long, n_cp long, n long, sha string, body binary, kind int"
_PAGES = pa.schema(
    [("rid", pa.int64()), ("lid", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n_cp", pa.int64()), ("n", pa.int64()), ("sha", pa.string()), ("body", pa.binary()), ("kind", pa.int32())]
)
SINGLE, MEMBER, TEXT = 0, 1, 2


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACE)


def _key(body: bytes) -> int:
    key = xxhash.xxh64_intdigest(body)
    return key - (1 << 64) if key >> 63 else key


class ExtendibleDirectory:
    """Directory of 2**depth slots over key prefixes; a slot names a bucket.

    Built from the loads of the prefixes of `max_depth` bits: overfull buckets split in two, and the directory doubles
    when a bucket as deep as the directory splits. Keys that share max_depth bits share a bucket, and are chained in it.
    """

    def __init__(self, prefixes: np.ndarray, loads: np.ndarray, capacity: int, max_depth: int):
        self.depth, self.max_depth = 0, max_depth
        full = np.zeros(1 << max_depth, dtype=np.int64)
        full[prefixes] = loads
        self._sum = np.concatenate([[0], np.cumsum(full)])
        self.buckets: list[tuple[int, int]] = []  # (local depth, prefix)
        self.loads: list[int] = []
        todo = [(0, 0)]
        while todo:
            depth, prefix = todo.pop()
            n = self._range(depth, prefix)
            if n > capacity and depth < max_depth:
                if depth == self.depth:
                    self.depth += 1
                todo += [(depth + 1, 2 * prefix + 1), (depth + 1, 2 * prefix)]
            else:
                self.buckets.append((depth, prefix))
                self.loads.append(n)
        self.slots = np.empty(1 << self.depth, dtype=np.int64)
        for b, (depth, prefix) in enumerate(self.buckets):
            wide = self.depth - depth
            self.slots[prefix << wide : (prefix + 1) << wide] = b

    def _range(self, depth: int, prefix: int) -> int:
        wide = self.max_depth - depth
        return int(self._sum[(prefix + 1) << wide] - self._sum[prefix << wide])

    def owners(self, n: int) -> list[int]:
        """Owner of each bucket: n ranges of buckets, in key order, of about equal load."""
        total, before, out = max(1, sum(self.loads)), 0, []
        for load in self.loads:
            out.append(min(n - 1, before * n // total))
            before += load
        return out


def _hash_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_key(normalised(t or b"")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["key"])


def _page_writer(words: np.ndarray, flush_bytes: int):
    mask = len(words) * 64 - 1

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = row_ids()
        chains: dict[int, list[list]] = {}
        held = 0

        def texts():
            rows = []
            for key, chain in chains.items():
                for body, lid, n, best, sha in chain:
                    rows.append((best[3], lid, key, best[2], -best[0], n, sha, body, TEXT))
            for i in range(0, len(rows), 256):
                yield _rows(rows[i : i + 256])

        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or b""
                body, rid = normalised(text), next(ids)
                key, n_cp = _key(body), len(text.decode("utf-8", "replace"))
                h = key & mask
                if not int(words[h >> 6]) >> (h & 63) & 1:
                    out.append((rid, None, None, doc_id, n_cp, None, hashlib.sha256(body).hexdigest(), None, SINGLE))
                    continue
                rank = (-n_cp, doc_id is None, doc_id, rid)
                for link in chains.setdefault(key, []):
                    if link[0] == body:
                        link[2] += 1
                        if _less(rank, link[3]):
                            link[3] = rank
                        break
                else:
                    link = [body, rid, 1, rank, hashlib.sha256(body).hexdigest()]
                    chains[key].append(link)
                    held += len(body) + 200
                out.append((rid, link[1], None, doc_id, None, None, None, None, MEMBER))
            yield _rows(out)
            if held > flush_bytes:
                yield from texts()
                chains, held = {}, 0
        yield from texts()

    return pages


def _less(a: tuple, b: tuple) -> bool:
    null = -1 if a[1] else a[2], -1 if b[1] else b[2]
    return (a[0], a[1], null[0], a[3]) < (b[0], b[1], null[1], b[3])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_PAGES)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _PAGES, strict=True)], schema=_PAGES)


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of the texts of each key, in key order; only the texts of one key are held."""
    now, chain = None, []
    for batch in batches:
        places = []
        for key, body in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist(), strict=True):
            if key != now:
                now, chain = key, []
            for place, other in enumerate(chain):
                if other == body:
                    break
            else:
                place = len(chain)
                chain.append(body)
            places.append(place)
        cols = [batch.column(c) for c in ("lid", "key", "doc_id", "n_cp", "n", "sha", "rid")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(places, pa.int32())], ["lid", "key", "doc_id", "n_cp", "n", "sha", "rid", "place"])


def exact_duplicates(
    docs: DataFrame, *, capacity: int = 20_000, most_buckets: int = 1 << 16, filter_bits: int = 1 << 26, flush_bytes: int = 16 << 20
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    capacity: texts of a bucket before it splits; most_buckets: so that the directory fits the driver, the capacity grows
    once there are about so many buckets (an owner reads its buckets one key at a time, so their size costs no memory);
    filter_bits: most bits of the filter of repeated keys; flush_bytes: texts that a scan task holds for comparison.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    repeated = written(rows.select("text").mapInArrow(_hash_only, "key long").groupBy("key").count().filter("count > 1").select("key"), "dup-keys")
    bits = 1 << 12
    while bits < min(filter_bits, 16 * repeated.count()):
        bits *= 2
    h = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = np.zeros(bits // 64, dtype=np.uint64)
    set_bits = repeated.select(F.shiftright(h, 6).alias("w"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("b"))
    for w, b in set_bits.groupBy("w").agg(F.bit_or("b")).toLocalIterator():  # at most filter_bits / 64 rows
        words[w] = b & ((1 << 64) - 1)

    pages = written(rows.mapInArrow(_page_writer(words, flush_bytes), PAGE_SCHEMA), "dup-pages", "kind")
    texts = pages.filter(F.col("kind") == TEXT)
    n_texts = texts.count()
    n_owners = max(1, min(shuffle_partitions(spark), n_texts // 100))
    capacity = max(min(capacity, n_texts // (2 * n_owners) + 1), n_texts // most_buckets)  # no owner is idle
    max_depth = 4 + math.ceil(math.log2(n_texts // capacity + 2))  # deep enough to part any bucket of even keys
    load = texts.groupBy(F.shiftrightunsigned("key", 64 - max_depth).alias("p")).agg(F.count("*").alias("n")).toArrow()  # at most 64 * most_buckets rows
    directory = ExtendibleDirectory(load.column("p").to_numpy(), load.column("n").to_numpy(), capacity, max_depth)
    owner_of = directory.owners(n_owners)
    slots = spark.createDataFrame(pa.table({"slot": pa.array(range(len(directory.slots)), pa.int64()), "owner": pa.array([owner_of[b] for b in directory.slots.tolist()], pa.int32())}))
    slot = F.shiftrightunsigned("key", 64 - directory.depth) if directory.depth else F.lit(0).cast("long")
    owned = texts.withColumn("slot", slot).join(F.broadcast(slots), "slot")  # at most 64 * most_buckets slots
    chained = written(
        owned.select("owner", "lid", "key", "doc_id", "n_cp", "n", "sha", "rid", "body")
        .repartition(n_owners, "owner")
        .sortWithinPartitions("key")
        .mapInArrow(_owner, "lid long, key long, doc_id long, n_cp long, n long, sha string, rid long, place int"),
        "dup-chains",
    )
    best = F.min(F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id", "rid")).alias("best")
    groups = chained.groupBy("key", "place").agg(F.sum("n").alias("group_size"), best)
    of = chained.select("lid", "key", "place", "sha").join(groups, ["key", "place"]).select("lid", "sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))
    members = (
        pages.filter(F.col("kind") == MEMBER)
        .select("rid", "lid", "doc_id")
        .join(of, "lid")
        .select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))
    )
    singles = pages.filter(F.col("kind") == SINGLE).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return singles.unionByName(members)


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    found = written(exact_duplicates(docs, **options), "duplicates")
    of_id = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    rest = without(docs, of_id.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept"))
    again = of_id.filter("n > 1 or not kept").join(of_id.filter("kept").select("doc_id").distinct(), "doc_id", "left_semi")
    if again.isEmpty() and of_id.filter("doc_id is null").isEmpty():
        return rest
    # rows share an id: they are told apart by their text
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]", "").cast("binary"), 256)
    kept = of_id.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    same = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__sha"))
    longest = F.length(F.coalesce(F.col("text"), F.lit("")))
    marked = rest.withColumns({"__own": F.col("doc_id").cast("long"), "__text": sha, "__size": longest})
    # of the rows of one id and text the longest stays; each task hands on one of them, so that no such group is gathered
    best = marked.join(kept, same, "left_semi").groupBy("__own", "__text").agg(F.max_by(F.struct(*(rest[c] for c in rest.columns)), F.struct("__size", "text")).alias("__row"))
    return best.select("__row.*")
