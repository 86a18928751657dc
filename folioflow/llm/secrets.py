"""Secrets: patterns of known shapes, and tokens that look random.

A token of 20 characters or more that no pattern took is read as the narrowest encoding that has all its characters (hex, base32,
base36, ...), and three tests ask whether its symbols could be uniform and independent: chi-squared over the alphabet,
the number of runs above and below the middle of the alphabet, and the serial correlation. Fisher's method makes one
number of the three: p, large for random tokens and small for words.

Short words pass such tests by chance, so p is held against ordinary text of the same encoding and length: for each stratum of
lengths the words of every document that are too short to be tokens are run together and cut into pieces of that length, and
each piece, in the encoding that it is in, counts towards the distribution of p for its class (what is left at a document's end
and is shorter than the piece gives none). A class with few pieces of text takes those of all encodings of its length. The
share of text with as large a p is the false-discovery p-value of a token; Benjamini and Hochberg's rule picks the tokens
of each class. Both distributions are kept in bins, so the driver sees some thousand counts whatever the corpus.

Results: null texts hold nothing; repeated rows each get a row and count as texts of the corpus; a row with a null doc_id is
read like any other. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS, _HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{16,}")
_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_LONG = re.compile(rb"[A-Za-z0-9+/_-]{20}")
#: First length of each stratum.
STRATA = (20, 24, 32, 40, 56, 80, 128)
BINS = 200
_LOWER, _UPPER, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: Narrowest first.
ENCODINGS = {
    "decimal": _DIGITS, "hex": _DIGITS + "abcdef", "upper_hex": _DIGITS + "ABCDEF", "lower": _LOWER, "upper": _UPPER, "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER,
    "upper_base36": _DIGITS + _UPPER, "letters": _UPPER + _LOWER, "base62": _DIGITS + _UPPER + _LOWER, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "any": _UPPER + _LOWER + _DIGITS + "+/-_",
}
_PLACES = {k: {c: i for i, c in enumerate(a)} for k, a in ENCODINGS.items()}
#: A class is an encoding and a stratum.
N_CLASSES = len(ENCODINGS) * len(STRATA)


def encoding_of(token: str) -> str:
    have = set(token)
    return next(k for k, places in _PLACES.items() if have <= places.keys())


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Wilson and Hilferty's approximation."""
    z = ((max(x, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str, encoding: str) -> float:
    """Fisher's p of the three tests, under uniform and independent symbols."""
    places = _PLACES[encoding]
    x, n, size = [places[c] for c in token], len(token), len(places)
    counts: dict[int, int] = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    uniform = _chi2_tail(sum(c * c for c in counts.values()) * size / n - n, size - 1)
    high = [2 * v >= size for v in x]
    n_high = sum(high)
    n_low = n - n_high
    if n_high and n_low:
        mean = 2 * n_high * n_low / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs = _normal_two_sided((1 + sum(a != b for a, b in zip(high, high[1:], strict=False)) - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    middle = sum(x) / n
    own = sum((v - middle) ** 2 for v in x)
    serial = _normal_two_sided((sum((a - middle) * (b - middle) for a, b in zip(x, x[1:], strict=False)) / own * n + 1) / math.sqrt(n)) if own else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, runs, serial))
    return math.exp(-half) * (1 + half + half * half / 2)  # the tail of chi-squared with 6 degrees


def stratum(length: int) -> int:
    return sum(length >= s for s in STRATA) - 1


def class_of(token: str, encoding: str) -> int:
    return list(ENCODINGS).index(encoding) * len(STRATA) + stratum(len(token))


def bin_of(p: float) -> int:
    """Finer near 1: by -log10 p, up to 20, the likeliest random last."""
    return BINS - 1 - min(BINS - 1, int(10 * -math.log10(max(p, 1e-300))))


def base_spans(text: str, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order. low: the text's bytes in lower case."""
    out = []
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    if any(len(t) >= 16 and _HEX.search(t) for t in text.split()):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, raw: bytes, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, class, bin) of tokens, without the spans that are taken: each part between them is a token of its own."""
    if not _LONG.search(raw):
        return []
    gone: list[list[int]] = []  # taken spans, joined where they overlap
    for start, _, end in taken:
        if gone and start <= gone[-1][1]:
            gone[-1][1] = max(gone[-1][1], end)
        else:
            gone.append([start, end])
    out, i = [], 0
    for m in _TOKEN.finditer(text):
        while i < len(gone) and gone[i][1] <= m.start():
            i += 1
        cuts, j = [], i
        while j < len(gone) and gone[j][0] < m.end():
            cuts.append(gone[j])
            j += 1
        for at, to in zip([m.start(), *(c[1] for c in cuts)], [*(c[0] for c in cuts), m.end()], strict=True):
            body = text[at:to].strip("-_/+") if at < to else ""
            if len(body) < STRATA[0]:
                continue
            start = at + text[at:to].index(body)
            encoding = encoding_of(body)
            out.append((start, start + len(body), class_of(body, encoding), bin_of(randomness(body, encoding))))
    return out


_SYMBOLS = (_UPPER + _LOWER + _DIGITS + "+/-_").encode()
_NO_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOLS)
_RUN = re.compile(rb"[A-Za-z0-9+/_-]{20,}")
_CHUNK = 1 << 18
#: For each byte the encodings that have it, as bits, and its place in each.
_HAVE = np.array([sum((chr(b) in a) << k for k, a in enumerate(ENCODINGS.values())) for b in range(256)], np.uint16)
_PLACE = np.array([[p.get(chr(b), 0) for b in range(256)] for p in _PLACES.values()], np.int64)


@cache
def _uniform_table(n: int, size: int) -> np.ndarray:
    """p of the chi-squared test by the sum of the squares of the counts."""
    return np.array([_chi2_tail(c * size / n - n, size - 1) for c in range(n * n + 1)])


@cache
def _runs_table(n: int) -> np.ndarray:
    """p of the runs test by the number of high symbols and of changes."""
    out = np.full((n + 1, n), 2.0 ** (1 - n))
    for high in range(1, n):
        mean = 2 * high * (n - high) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        out[high] = [_normal_two_sided((1 + c - mean) / math.sqrt(spread)) if spread > 0 else 1.0 for c in range(n)]
    return out


def _bins(x: np.ndarray, size: int) -> np.ndarray:
    """bin_of(randomness()) of each row of places in an alphabet of that size."""
    m, n = x.shape
    counts = np.bincount((np.arange(m)[:, None] * size + x).ravel(), minlength=size * m).reshape(m, size)
    uniform = _uniform_table(n, size)[np.einsum("ij,ij->i", counts, counts)]
    high = 2 * x >= size
    runs = _runs_table(n)[high.sum(1), (high[:, 1:] != high[:, :-1]).sum(1)]
    d = x - x.mean(1, keepdims=True)
    own = np.einsum("ij,ij->i", d, d)
    z = np.einsum("ij,ij->i", d[:, 1:], d[:, :-1]) / np.where(own > 0, own, 1)
    serial = np.array([math.erfc(v) for v in (np.abs(z * n + 1) / math.sqrt(2 * n)).tolist()])
    serial[own == 0] = 0.0
    half = -sum(np.log(np.maximum(p, 1e-300)) for p in (uniform, runs, serial))
    p = np.exp(-half) * (1 + half + half * half / 2)
    return BINS - 1 - np.minimum(BINS - 1, (10 * -np.log10(np.maximum(p, 1e-300))).astype(int))


def ordinary(texts: list[bytes]) -> np.ndarray:
    """Counts by (class, bin) of the symbols of each text's words of under 20 characters, run together and cut into pieces of each
    stratum's length, each piece in its own encoding."""
    out = np.zeros((N_CLASSES, BINS), np.int64)
    symbols = [(_RUN.sub(b"", t) if _LONG.search(t) else t).translate(None, _NO_SYMBOLS) for t in texts]
    for k, n in enumerate(STRATA):
        pending, size = [], 0
        for own in symbols:
            whole = len(own) // n * n
            for at in range(0, whole, _CHUNK // n * n):
                pending.append(own[at : min(whole, at + _CHUNK // n * n)])
                size += len(pending[-1])
                if size >= _CHUNK:
                    _add_pieces(pending, n, k, out)
                    pending, size = [], 0
        if size:
            _add_pieces(pending, n, k, out)
    return out


def _add_pieces(pieces: list[bytes], n: int, k: int, out: np.ndarray) -> None:
    x = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, n)
    have = np.bitwise_and.reduce(_HAVE[x], axis=1)
    narrowest = np.bitwise_and(have, -have.astype(np.int32))
    for e, alphabet in enumerate(ENCODINGS.values()):
        rows = x[narrowest == 1 << e]
        if len(rows):
            out[e * len(STRATA) + k] += np.bincount(_bins(_PLACE[e][rows], len(alphabet)), minlength=BINS)


_SCANNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
        ("tokens", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("bin", pa.int32())]))),
        ("text", pa.list_(pa.struct([("class", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]))),
    ]
)
_SCHEMA = (
    "doc_id long, base array<struct<start bigint, kind int, end bigint>>, "
    "tokens array<struct<start bigint, end bigint, class int, bin int>>, text array<struct<class int, bin int, n bigint>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of text of a batch are with its first row."""
    names = [[f.name for f in t.type.value_type] for t in list(_SCANNED)[1:]]
    for batch in batches:
        columns: list[list] = [[], [], []]
        raws = [raw or b"" for raw in batch.column("text").to_pylist()]
        null = ordinary(raws)
        for i, raw in enumerate(raws):
            text = raw.decode("utf-8", "replace")
            spans = base_spans(text, raw.lower())
            counts = [(int(k), int(b), int(null[k, b])) for k, b in np.argwhere(null)] if i == 0 else []
            for column, rows, keys in zip(columns, (spans, candidates(text, raw, spans), counts), names, strict=True):
                column.append([dict(zip(keys, r, strict=True)) for r in rows])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t.type) for c, t in zip(columns, list(_SCANNED)[1:], strict=True))], schema=_SCANNED)


def least_bins(tokens: dict[tuple[int, int], int], text: dict[tuple[int, int], int], rate: float, least_null: int = 2000) -> list[int]:
    """For each class the least bin whose tokens are discoveries at that false-discovery rate; BINS if none are."""
    nulls = np.zeros((N_CLASSES, BINS), np.int64)
    for (k, b), n in text.items():
        nulls[k, b] = n
    of_length = nulls.reshape(len(ENCODINGS), len(STRATA), BINS).sum(0)
    out = []
    for k in range(N_CLASSES):
        own = np.array([tokens.get((k, b), 0) for b in range(BINS)])
        null = nulls[k] if nulls[k].sum() >= least_null else of_length[k % len(STRATA)]
        p = (np.cumsum(null[::-1])[::-1] + 1) / (null.sum() + 1)
        found = np.cumsum(own[::-1])[::-1]
        fine = np.flatnonzero((found > 0) & (p * own.sum() <= rate * found))
        out.append(int(fine[0]) if len(fine) else BINS)
    return out


def secrets(docs: DataFrame, *, rate: float = 0.01) -> DataFrame:
    """One row per document: doc_id, and spans array<struct<start, kind, end>> by start, then kind (a place in KINDS)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    scanned = written(rows.mapInArrow(_scan, _SCHEMA), "secrets")

    def counts(column: str, n: Column) -> dict[tuple[int, int], int]:
        grouped = scanned.select(F.explode(column).alias("x")).groupBy(F.col("x.class").alias("k"), "x.bin").agg(F.sum(n).alias("n"))
        return {(r.k, r.bin): r["n"] for r in grouped.collect()}  # at most N_CLASSES * BINS rows

    least = least_bins(counts("tokens", F.lit(1)), counts("text", F.col("x.n")), rate)
    picked = F.filter("tokens", lambda t: t["bin"] >= F.element_at(F.array(*map(F.lit, least)), t["class"] + 1))
    more = F.transform(picked, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))
    return scanned.select("doc_id", F.sort_array(F.concat("base", more)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
