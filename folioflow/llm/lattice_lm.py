"""Language-model scores: the marginal probability of a document over all segmentations of its words.

The vocabulary is that of an existing subword tokenizer. Its scores are ranks, of which p0 is made (in proportion to 1 / (rank + 1)).
A document is the sequence of its words, each led by a word mark, and one end. No piece crosses a word mark, so the forward recursion over
the document factors into one over each word:

    alpha[j] = logsumexp over pieces x[i:j] of alpha[i] + log p(piece)

Two kinds of arcs lie over a word: subword pieces, and one arc for the whole word where the training rows have it. A piece weighs
keep * p0 + (1 - keep) * its share of the expected counts of the distinct words of the training rows (each once, since pieces serve
words that are rare) over the lattice, in em_rounds rounds; with none it weighs p0. Whole words have their discounted count

    P(word) = max(c - d, 0) / N + d * V / N * sum over segmentations of the product of p(piece),   d = n1 / (n1 + 2 n2)

which sums to one over all words. Characters without a piece use the vocabulary's byte pieces.

Words are counted over all rows. The `head_words` commonest are sent to all tasks (those of over `head_bytes` bytes as a hash, so
the size is bounded); occurrences of all others meet their counts in a shuffle by word.

Results: null or blank texts score as the end alone; repeated rows are scored each; a row with a null doc_id trains.
With no training rows the pieces keep their starting weights and base_score is over N = V = 0. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out_mod, row_ids, shuffle_partitions, small_batches, written

MARK = "▁"
#: Words whose lattices are computed together.
TOGETHER = 8192
#: Longer words are computed alone.
LONG = 40


class StringTable:
    """Ids of strings, looked up for many strings of one length at once by a rolling 64-bit hash of their characters.

    Strings that share a place in the first table are in the second, whose factor is chosen so that none share one.
    """

    BASE, FACTOR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, ids: dict[str, int], none: int, bits: int = 20, more_bits: int = 17):
        self.none, self.shift, self.more_shift = none, np.uint64(64 - bits), np.uint64(64 - more_bits)
        hashes = np.array([self._hash(t) for t in ids], dtype=np.uint64)
        values = np.array(list(ids.values()), dtype=np.int32)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two strings have one hash")
        place = (hashes * self.FACTOR) >> self.shift
        _, at = np.unique(place, return_index=True)
        self.first = self._table(bits, place[at], hashes[at], values[at])
        rest = np.setdiff1d(np.arange(len(hashes)), at)
        self.more_factor = np.uint64(0xA0761D6478BD642F)
        while len(np.unique(place := (hashes[rest] * self.more_factor) >> self.more_shift)) < len(rest):
            self.more_factor += np.uint64(2)
        self.more = self._table(more_bits, place, hashes[rest], values[rest])

    def _table(self, bits: int, place: np.ndarray, hashes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and ids by place; an empty place has the hash of no string."""
        own, ids = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, self.none, dtype=np.int32)
        own[place], ids[place] = hashes, values
        return own, ids

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(self.BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    def ids(self, h: np.ndarray) -> np.ndarray:
        place = (h * self.FACTOR) >> self.shift
        out = np.where(self.first[0][place] == h, self.first[1][place], np.int32(self.none))
        place = (h * self.more_factor) >> self.more_shift
        return np.where(self.more[0][place] == h, self.more[1][place], out)


class Pieces:
    """A subword vocabulary with log weights."""

    def __init__(self, pieces: list[str], byte_ids: list[int], log_p: np.ndarray):
        self.ids = {p: i for i, p in enumerate(pieces) if p}
        self.bytes, self.n, self.longest = byte_ids, len(pieces), max(map(len, pieces))
        self.log_p = np.append(log_p, -np.inf)  # at n: no such piece
        self.table = StringTable(self.ids, self.n)

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        """From a sentencepiece model; its scores rank the pieces, the weight of rank r is in proportion to 1 / (r + 1)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        names, weights, byte_ids = [], [], [0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or MARK in (piece := sp.id_to_piece(i))[1:]:
                continue
            if sp.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = len(names)
                names.append("")
                weights.append(1e-9)
            else:
                names.append(piece)
                weights.append(1 / (1 - sp.get_score(i)))
        p = np.array(weights)
        return cls(names, byte_ids, np.log(p / p.sum()))

    def reweighted(self, p: np.ndarray) -> Pieces:
        out = object.__new__(Pieces)
        out.ids, out.table, out.bytes, out.n, out.longest = self.ids, self.table, self.bytes, self.n, self.longest
        out.log_p = np.append(np.log(p / p.sum()), -np.inf)
        return out

    def _edges(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """words of one length, with their marks: (start, end) to the id of each word's piece there."""
        size = len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, size).T.astype(np.uint64) + np.uint64(1)
        out = {}
        for i in range(size):
            h = np.zeros(len(words), dtype=np.uint64)
            for j in range(i + 1, min(size, i + self.longest) + 1):
                h = h * StringTable.BASE + chars[j - 1]
                found = self.table.ids(h)
                if (found < self.n).any():
                    out[i, j] = found
        return out

    def _forward(self, words: list[str], edges: dict) -> np.ndarray:
        alpha = np.full((len(words[0]) + 1, len(words)), -np.inf)
        alpha[0] = 0
        for (i, j), ids in sorted(edges.items()):
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + self.log_p[ids])
        return alpha

    def _arcs(self, word: str) -> Iterator[tuple[int, int, list[int]]]:
        """Of one word without its mark; bytes where a character has no piece."""
        x = MARK + word
        for i in range(len(x)):
            own = self.ids.get(x[i]) if not i or x[i] != MARK else None
            if own is None:
                yield i, i + 1, [self.bytes[b] for b in x[i].encode("utf-8", "surrogatepass")]
            for j in range(i + 1, min(len(x), i + self.longest) + 1):
                if (k := self.ids.get(x[i:j])) is not None and (not i or x[i] != MARK):
                    yield i, j, [k]

    def _alone(self, word: str) -> float:
        alpha = [0.0] + [-math.inf] * (len(word) + 1)
        for i, j, ids in self._arcs(word):
            if (a := alpha[i] + sum(float(self.log_p[k]) for k in ids)) > -math.inf:
                alpha[j] = float(np.logaddexp(alpha[j], a))
        return alpha[-1]

    def _groups(self, words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w) if len(w) <= LONG and MARK not in w else -1, []).append(k)
        for size, ks in by_size.items():
            if size < 0:
                yield ks, []
            else:
                for i in range(0, len(ks), TOGETHER):
                    yield (part := ks[i : i + TOGETHER]), [MARK + words[k] for k in part]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for ks, marked in self._groups(words):
            got = self._forward(marked, self._edges(marked))[-1] if marked else np.full(len(ks), -np.inf)
            for at in np.flatnonzero(np.isinf(got)):
                got[at] = self._alone(words[ks[at]])
            out[ks] = got
        return out

    def expected_counts(self, words: list[str]) -> np.ndarray:
        """Expected number of each piece over the segmentations of the words, each word once."""
        counts = np.zeros(self.n + 1)
        for ks, marked in self._groups(words):
            if marked:
                edges = self._edges(marked)
                alpha = self._forward(marked, edges)
                beta = np.full_like(alpha, -np.inf)
                beta[-1] = 0
                whole = alpha[-1]
                fine = np.isfinite(whole)
                for (i, j), ids in sorted(edges.items(), key=lambda e: (-e[0][0], -e[0][1])):
                    beta[i] = np.logaddexp(beta[i], beta[j] + self.log_p[ids])
                with np.errstate(invalid="ignore"):
                    shares = [np.where(fine, np.exp(alpha[i] + self.log_p[ids] + beta[j] - whole), 0) for (i, j), ids in edges.items()]
                if shares:
                    counts += np.bincount(np.concatenate(list(edges.values())), np.concatenate(shares), self.n + 1)
                ks = [k for k, ok in zip(ks, fine, strict=True) if not ok]
            for k in ks:
                self._add_alone(words[k], counts)
        return counts[: self.n]

    def _add_alone(self, word: str, counts: np.ndarray) -> None:
        arcs = [(i, j, ids, float(self.log_p[ids].sum())) for i, j, ids in self._arcs(word)]
        size = len(word) + 1
        alpha, beta = [0.0] + [-math.inf] * size, [-math.inf] * size + [0.0]
        for i, j, _, lp in arcs:
            alpha[j] = float(np.logaddexp(alpha[j], alpha[i] + lp))
        for i, j, _, lp in reversed(arcs):
            beta[i] = float(np.logaddexp(beta[i], beta[j] + lp))
        for i, j, ids, lp in arcs:
            for k in ids:
                counts[k] += math.exp(alpha[i] + lp + beta[j] - alpha[-1])


def _text_of(words: list[bytes]) -> list[str]:
    return [w.decode("utf-8", "replace") for w in words]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, count in training rows, count); the empty word is the end."""
    train: Counter = Counter()
    rest: Counter = Counter()

    def flushed() -> Iterator[pa.RecordBatch]:
        for counter, is_train in ((train, True), (rest, False)):
            words = list(counter)
            n = pa.array(counter.values(), pa.int64())
            for i in range(0, len(words), 100_000):
                part = n.slice(i, 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 100_000], pa.binary()), part if is_train else pa.array([0] * len(part), pa.int64()), part], ["word", "c", "c_all"])
            counter.clear()

    for batch in batches:
        for held, text in zip(batch.column("held_out").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counter = rest if held else train
            counter.update((text or b"").lower().split())
            counter[b""] += 1
            if len(train) + len(rest) > 250_000:
                yield from flushed()
    yield from flushed()


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 2 * TOGETHER) -> Iterator[pa.Table]:
    """Small rows in larger batches, so that the lattices of many words are computed together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _em_step(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(pieces.n)
        for rows in _gathered(batches):
            counts += pieces.expected_counts(_text_of(rows.column("word").to_pylist()))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], ["piece", "n"])

    return run


def _with_lattice(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches):
            lp = pieces.log_probabilities(_text_of(rows.column("word").to_pylist()))
            yield from rows.append_column("log_lattice", pa.array(lp)).to_batches()

    return run


class Model:
    """What turns a word's count and its lattice into its probability."""

    def __init__(self, n: int, v: int, n1: int, n2: int, ends: int = 0, whole_words: bool = True):
        self.n, self.v, self.ends, self.whole_words = n, v, ends, whole_words
        self.d = n1 / (n1 + 2 * n2) if n1 else 0.5

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))

    def score(self, c: np.ndarray, log_lattice: np.ndarray, is_end: np.ndarray) -> np.ndarray:
        """log10; the lattice has no arc for the end but that of the training rows."""
        if not self.n:
            return np.where(is_end, 0.0, log_lattice / math.log(10))
        if not self.whole_words:
            return np.where(is_end, math.log10(self.ends / self.n), math.log10(1 - self.ends / self.n) + log_lattice / math.log(10))
        whole = np.maximum(c - np.where(is_end, 0, self.d), 0) / self.n
        parts = np.where(is_end, -np.inf, math.log(self.d * self.v / self.n) + log_lattice)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(whole), parts) / math.log(10)


_OCCURRENCES = pa.schema(
    [("word", pa.binary()), ("rid", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def _head_key(word: bytes, head_bytes: int) -> bytes:
    """The word, or a hash led by a space, which no word has."""
    return word if len(word) <= head_bytes else b" " + xxhash.xxh128_digest(word)


def _head_keys(head_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(0, "word", pa.array([_head_key(w, head_bytes) for w in b.column("word").to_pylist()], pa.binary()))

    return run


def _occurrences(head, head_bytes: int):
    """A row for each document with the sums over its common words and its end, and a row for each of its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known, base, score = head.value
        ids = row_ids()

        def get(word: bytes, none: int) -> int:
            at = index.get(word, none)
            return at if at >= 0 or len(word) <= head_bytes else index.get(_head_key(word, head_bytes), none)

        for batch in batches:
            out: list[tuple] = []
            for doc_id, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                rid, words = next(ids), (text or b"").lower().split()
                words.append(b"")
                at = np.fromiter(map(get, words, repeat(-1)), dtype=np.int32, count=len(words))
                common = at[at >= 0]
                out.append((None, rid, None, doc_id, held, len(words), int(known[common].sum()), float(base[common].sum()), float(score[common].sum())))
                out += [(w, rid, n, None, None, None, None, None, None) for w, n in Counter(words[i] for i in np.flatnonzero(at < 0).tolist()).items()]
                if len(out) > 30_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_OCCURRENCES)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _OCCURRENCES, strict=True)], schema=_OCCURRENCES)


def _scored(model: Model):
    """Rows in order of word; the row with the word's count comes first and serves all that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (0, -math.inf)
        for batch in batches:
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            passed = np.asarray(batch.column("word").is_null())
            counted = rid < 0
            at = np.maximum.accumulate(np.where(counted, np.arange(1, len(rid) + 1), 0))
            c = np.append(last[0], batch.column("c").fill_null(0).to_numpy(zero_copy_only=False))[at]
            lattice = np.append(last[1], batch.column("log_lattice").fill_null(-math.inf).to_numpy(zero_copy_only=False))[at]
            if len(rid):
                last = (c[-1], lattice[-1])
            n = batch.column("n").fill_null(0).to_numpy(zero_copy_only=False)
            some = ~passed & ~counted
            none = np.zeros(int(some.sum()), dtype=bool)
            pick = pa.array(passed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(rid[some]), batch.column("rid").filter(pick)]),
                    *(pa.concat_arrays([pa.nulls(len(none), t), batch.column(x).filter(pick)]) for x, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()))),
                    *(
                        pa.concat_arrays([pa.array(v), batch.column(x).filter(pick)])
                        for x, v in (("n_known", (n * (c > 0))[some].astype(np.int64)), ("base_score", (n[some] * model.base(c[some]))), ("score", n[some] * model.score(c[some], lattice[some], none)))
                    ),
                ],
                ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def _commonest(words: DataFrame, most: int) -> DataFrame:
    """At most so many of the words, the commonest. They are told by their counts alone, so nothing is sorted."""
    level = F.floor(16 * F.log2("c_all")).cast("int")
    least, total = None, 0
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):  # at most 1024 levels
        if (total := total + r["count"]) > most:
            break
        least = r.level
    return words.filter(F.lit(False) if least is None else level >= least)


def lattice_scores(
    docs: DataFrame, model_file: str, *, fold: tuple[int, int] = (7, 2), em_rounds: int = 2, keep: float = 0.1, whole_words: bool = True, head_words: int = 300_000, head_bytes: int = 64
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    fold: rows whose crc32(doc_id as text) mod fold[0] is fold[1] are held out; the model learns from all others. keep: how much of
    the vocabulary's own scores stays in the pieces' weights; whole_words: whether there are arcs for them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_mod(F.col("doc_id"), *fold).alias("held_out"), F.col("text").cast("binary").alias("text"))
    counts = written(rows.select("held_out", "text").mapInArrow(_count, "word binary, c long, c_all long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all")), "words")
    trained = counts.filter("c > 0")
    totals = trained.agg(*(F.coalesce(x.cast("long"), F.lit(0).cast("long")) for x in (F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.sum(F.when(F.length("word") == 0, F.col("c")))))).first()
    model, pieces = Model(*totals, whole_words), Pieces.load(model_file)
    own = np.exp(pieces.log_p[:-1])
    for _ in range(em_rounds if model.n else 0):
        step = trained.filter(F.length("word") > 0).select("word").mapInArrow(_em_step(pieces), "piece int, n double")
        expected = np.zeros(pieces.n)
        for k, n in step.groupBy("piece").agg(F.sum("n")).collect():  # at most the size of the vocabulary
            expected[k] = n
        pieces = pieces.reweighted(keep * own + (1 - keep) * expected / expected.sum()) if expected.any() else pieces
    weighed = written(counts.mapInArrow(_with_lattice(pieces), "word binary, c long, c_all long, log_lattice double"), "weighed-words")
    common = _commonest(weighed, head_words).select("word", "c", "log_lattice").mapInArrow(_head_keys(head_bytes), "word binary, c long, log_lattice double").toArrow()
    names, c, lattice = common.column("word").to_pylist(), common.column("c").to_numpy(), common.column("log_lattice").to_numpy()
    is_end = np.array([not w for w in names], dtype=bool)
    head = spark.sparkContext.broadcast(({w: i for i, w in enumerate(names)}, c > 0, model.base(c), model.score(c, lattice, is_end)))
    seen = rows.mapInArrow(_occurrences(head, head_bytes), "word binary, rid long, n long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    no = {x: F.lit(None).cast(t) for x, t in (("c", "long"), ("log_lattice", "double"))}
    both = seen.withColumns(no).unionByName(weighed.select("word", F.lit(-1).cast("long").alias("rid"), "c", "log_lattice"), allowMissingColumns=True)
    key = F.when(F.col("word").isNull(), F.col("rid")).otherwise(F.xxhash64("word"))
    sums = both.repartition(shuffle_partitions(spark), key).sortWithinPartitions("word", "rid").mapInArrow(
        _scored(model), "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    total = sums.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), *(F.sum(x).alias(x) for x in ("n_known", "base_score", "score")))
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
