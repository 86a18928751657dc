"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon holds words and word beginnings that are far commoner in toxic documents. The labelled rows that may be learned
from are split by their hash into two halves; each half's features come from the lexicon of the other half, so that no row is
judged by words that it gave. Three quarters of them fit the trees, the rest the calibration; documents are scored
with the lexicon of all. At most `sample` labelled rows are used; everything else reads every document whole.

Features: densities of the lexicon (number, weight, distinct, greatest), its hits near second-person pronouns, capitals,
punctuation, obfuscation (letters mixed with digits or signs, hits that appear once it is undone, lengthened words), size.

Results: null or blank texts get the score of the features of an empty text; repeated rows score alike; a row with a null
doc_id is scored but isn't learned from. With no labels of one class, every score is the share of toxic labels (0 without labels).
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, held_out_mod, small_batches, written

SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()
)
UNDONE = str.maketrans("013457@$!|+€", "oieastasiite")
#: Where the words of a text end up: term of the lexicon (low bits), then flags.
TERM_BITS, PERSON, CAPITAL, OBFUSCATED, HIDDEN, LENGTHENED = 12, 1, 2, 4, 8, 16
BEGINNINGS = (4, 5, 6, 7, 8)
NEAR = 5
N_FEATURES = 20
_INSIDE = re.compile(r"[^\W\d_][\d@$!|+*€]+[^\W\d_]|[^\W\d_][*.\-_]{1,2}[^\W\d_][*.\-_]{1,2}[^\W\d_]")
_LONG = re.compile(r"([^\W\d_])\1\1")
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_LETTER = _UPPER + bytes(range(97, 123))
_OTHER = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in b"!?")
_HIGH = bytes(range(128, 256))


def bare(token: str) -> str:
    """A token in lower case without what isn't a letter or digit at its ends."""
    return re.sub(r"^[\W_]+|[\W_]+$", "", token.lower())


def terms_of(word: str) -> Iterator[str]:
    """The word, and its beginnings, which end in a star."""
    if word:
        yield word
        yield from (word[:k] + "*" for k in BEGINNINGS if len(word) >= k)


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.terms = sorted(self.weights, key=lambda t: (-self.weights[t], t))
        self.index = {t: i + 1 for i, t in enumerate(self.terms)}
        self.values = np.array([0.0, *(self.weights[t] for t in self.terms)])

    def _hit(self, word: str) -> int:
        return min((i for t in terms_of(word) if (i := self.index.get(t))), default=0)

    def code(self, token: bytes) -> int:
        text = token.decode("utf-8", "replace")
        word = bare(text)
        hit, flags = self._hit(word), 0
        if word in SECOND_PERSON:
            flags |= PERSON
        if len(text) > 1 and text.isupper():
            flags |= CAPITAL
        if _INSIDE.search(text):
            flags |= OBFUSCATED
            if not hit and (hit := self._hit(re.sub(r"[\W_]", "", text.lower().translate(UNDONE)))):
                flags |= HIDDEN
        if _LONG.search(text):
            flags |= LENGTHENED
            if not hit and (hit := self._hit(re.sub(r"(.)\1+", r"\1", word))):
                flags |= HIDDEN
        return hit | flags << TERM_BITS

    def features(self, text: bytes, codes: dict[bytes, int]) -> list[float]:
        """codes: what is known of tokens so far; it grows."""
        tokens = text.split()
        n, size = len(tokens), max(1, len(text))
        got = np.fromiter((c if (c := codes.get(t)) is not None else codes.setdefault(t, self.code(t)) for t in tokens), dtype=np.int32, count=n)
        terms, flags = got & (1 << TERM_BITS) - 1, got >> TERM_BITS
        hits, persons = np.flatnonzero(terms), np.flatnonzero(flags & PERSON)
        weights = self.values[terms[hits]]
        near = 0
        if len(hits) and len(persons):
            after = np.minimum(np.searchsorted(persons, hits), len(persons) - 1)
            gap = np.minimum(abs(persons[after] - hits), abs(hits - persons[np.maximum(after - 1, 0)]))
            near = int((gap <= NEAR).sum())
        many = max(1, n)

        def share(kept: bytes) -> float:
            return (len(text) - len(text.translate(None, kept))) / size

        letters, flag = share(_LETTER), lambda f: float(((flags & f) > 0).sum())
        return [
            100 * len(hits) / many, 100 * float(weights.sum()) / many, np.log1p(len(hits)), float(weights.max(initial=0)), float(len(np.unique(terms[hits]))), near, 100 * near / many,
            100 * len(persons) / many, share(_UPPER) / max(letters, 1e-9), flag(CAPITAL) / many, text.count(b"!") / size, text.count(b"?") / size, share(_OTHER), flag(OBFUSCATED) / many,
            flag(HIDDEN), flag(LENGTHENED) / many, share(_DIGIT), np.log1p(n), (len(text) - text.count(b" ")) / many, share(_HIGH),
        ]

    def matrix(self, texts: list[bytes | None], codes: dict[bytes, int], most_codes: int = 200_000) -> np.ndarray:
        out = np.empty((len(texts), N_FEATURES))
        for i, text in enumerate(texts):
            out[i] = self.features(text or b"", codes)
            if len(codes) > most_codes:
                codes.clear()
        return out


class BoostedTrees:
    """Binary logistic boosting of small trees over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 1.0, shrink: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.shrink = rounds, depth, rate, bins, least, shrink

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start, self.trees = float(np.log(p / (1 - p))), []
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, edges, p - y, p * (1 - p))
            self.trees.append(tree)
            raw += self._of(tree, x)
        return self

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, threshold, value) of each node in heap order; feature -1 at leaves."""
        size = (1 << self.depth + 1) - 1
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        rows = {0: np.arange(len(g))}
        for node in range(size):
            if (at := rows.pop(node, None)) is None:
                continue
            total_g, total_h = g[at].sum(), h[at].sum()
            value[node] = -self.rate * total_g / (total_h + self.shrink)
            if 2 * node + 2 >= size or not len(at):
                continue
            best = (1e-9, -1, 0)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                left_g = np.cumsum(np.bincount(binned[at, f], g[at], len(e) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[at, f], h[at], len(e) + 1))[:-1]
                gain = left_g**2 / (left_h + self.shrink) + (total_g - left_g) ** 2 / (total_h - left_h + self.shrink) - total_g**2 / (total_h + self.shrink)
                gain[(left_h < self.least) | (total_h - left_h < self.least)] = -np.inf
                if gain[k := int(np.argmax(gain))] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] >= 0:
                feature[node], threshold[node] = best[1], edges[best[1]][best[2]]
                goes_left = binned[at, best[1]] <= best[2]
                rows[2 * node + 1], rows[2 * node + 2] = at[goes_left], at[~goes_left]
        return feature, threshold, value

    @staticmethod
    def _of(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, threshold, value = tree
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while (inner := feature[node] >= 0).any():
            at, of = rows[inner], node[inner]
            node[at] = 2 * of + 1 + (x[at, feature[of]] > threshold[of])
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._of(t, x) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """Pool-adjacent-violators; between the centres of the pools the probability rises evenly."""

    def fit(self, raw: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []  # sum of y, number, sum of raw
        for r, t in zip(raw[order].tolist(), y[order].tolist(), strict=True):
            pools.append([t, 1, r])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.at = np.array([s / n for _, n, s in pools])
        self.value = np.array([(t + 0.01) / (n + 0.02) for t, n, _ in pools])
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        """The thousandth part that is the plain logistic keeps documents of one pool in order."""
        return np.clip(0.999 * np.interp(raw, self.at, self.value) + 0.001 / (1 + np.exp(-np.clip(raw, -50, 50))), 0, 1)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other documents each term is."""
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def flushed() -> Iterator[pa.RecordBatch]:
        terms = list(counts[True].keys() | counts[False].keys())
        for i in range(0, len(terms), 50_000):
            part = terms[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([counts[True][t] for t in part], pa.int64()), pa.array([counts[False][t] for t in part], pa.int64())], ["term", "toxic", "other"])
        for c in counts.values():
            c.clear()

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = {bare(t.decode("utf-8", "replace")) for t in set((text or b"").split())}
            counts[bool(toxic)].update({t for w in words for t in terms_of(w)})
            if len(counts[True]) + len(counts[False]) > 150_000:
                yield from flushed()
    yield from flushed()


def learn_lexicon(rows: DataFrame, *, least_share: float = 0.008, most_terms: int = 2000, odds: float = 8.0) -> Lexicon:
    """Terms in at least that share of toxic rows, and so many times commoner there than in others."""
    sizes = {bool(r.toxic): r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_other = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_other:
        return Lexicon()
    counts = rows.select("text", "toxic").mapInArrow(_term_counts, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("other") + 0.5) / (n_other + 1))
    best = counts.withColumn("weight", F.log(ratio)).filter((F.col("toxic") >= max(4, least_share * n_toxic)) & (ratio >= odds))
    return Lexicon({r.term: float(r.weight) for r in best.orderBy(F.desc("toxic"), "term").limit(most_terms).collect()})


def _features(lexicons: tuple[Lexicon, Lexicon]):
    """Of the rows of each half, by the lexicon of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        for batch in batches:
            texts, halves = batch.column("text").to_pylist(), batch.column("half").to_pylist()
            x = [lexicons[1 - h].features(t or b"", codes[1 - h]) for t, h in zip(texts, halves, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("fits"), batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["fits", "toxic", "x"])

    return run


@dataclass
class Classifier:
    lexicon: Lexicon
    prior: float
    trees: BoostedTrees | None = None
    calibration: Isotonic | None = None

    def scores(self, texts: list[bytes | None], codes: dict[bytes, int]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        return self.calibration(self.trees.raw(self.lexicon.matrix(texts, codes)))


def learn(docs: DataFrame, labels: DataFrame, *, fold: tuple[int, int] = (4, 2), sample: int = 24_000) -> Classifier:
    """From at most `sample` labelled rows outside the fold, picked by the hash of their id."""
    small_batches(docs.sparkSession)
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out_mod(F.col("doc_id"), *fold))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    picked = hashed_sample(known, "doc_id", sample, 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    h = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(8)).cast("int")
    rows = texts.join(F.broadcast(picked), "doc_id").select("text", "toxic", (h % 2).alias("half"), (h < 6).alias("fits"))  # at most `sample` ids
    rows = written(rows, "labelled")
    halves = tuple(learn_lexicon(rows.filter(F.col("half") == k)) for k in (0, 1))
    got = rows.mapInArrow(_features(halves), "fits boolean, toxic int, x array<double>").toArrow()  # at most `sample` rows of features
    y, fit = got.column("toxic").to_numpy().astype(float), got.column("fits").to_numpy().astype(bool)
    model = Classifier(learn_lexicon(rows), float(y.mean()) if len(y) else 0.0)
    x = got.column("x").combine_chunks()
    x = (x.flatten() if len(y) else pa.array([], pa.float64())).to_numpy().reshape(-1, N_FEATURES)
    calibrate = ~fit
    if min(y[fit].sum(), (1 - y[fit]).sum(), y[calibrate].sum(), (1 - y[calibrate]).sum()) < 1:
        fit = calibrate = np.ones(len(y), dtype=bool)  # too few for parts
    if 0 < y[fit].sum() < fit.sum():
        model.trees = BoostedTrees().fit(x[fit], y[fit])
        model.calibration = Isotonic().fit(model.trees.raw(x[calibrate]), y[calibrate])
    return model


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        for batch in batches:
            scores = model.value.scores(batch.column("text").to_pylist(), codes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores)], ["doc_id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, *, fold: tuple[int, int] = (4, 2), sample: int = 24_000, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, fold=fold, sample=sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_mod(F.col("doc_id"), *fold).alias("held_out"), F.col("text").cast("binary").alias("text"))
    scored = rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _kept(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        for batch in batches:
            texts = batch.column("text").cast(pa.string()).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array(model.value.scores(texts, codes) < threshold))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs under the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **options))
    return docs.mapInArrow(_kept(model, threshold), docs.schema)
