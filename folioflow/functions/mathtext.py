"""Mathematics in text: whether a short text is a formula and why, formulae within markup, and lines that are addresses instead.

Plain functions on one text, and column expressions where the rule is a pattern.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .text import is_list_marker, squeezed

FUNCTIONS, PROSE = frozenset(fixed.MATH_FUNCTIONS), frozenset(fixed.SHORT_PROSE_WORDS)
LONGEST = 300
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9']*")
_INDEXED = re.compile(r"[A-Za-z]{1,3}\d+")


def is_symbol(c: str) -> bool:
    return c in fixed.MATH_SYMBOLS or unicodedata.category(c) == "Sm"


def is_variable(name: str) -> bool:
    """A function, a letter, two letters that are no word, or a few with an index."""
    if name.lower() in FUNCTIONS or len(name) == 1 or _INDEXED.fullmatch(name):
        return True
    return len(name) == 2 and name.lower() not in PROSE


#: Classes of characters: what tells them, what each counts for, and the most that count.
_CLASSES: dict[str, tuple[Callable[[str], bool], int, int]] = {
    "symbol": (is_symbol, 2, LONGEST),
    "broken": ("�".__contains__, 3, LONGEST),
    "relation": (fixed.MATH_RELATIONS.__contains__, 2, LONGEST),
    "operator": (fixed.MATH_OPERATORS.__contains__, 1, LONGEST),
    "bracket": (fixed.MATH_BRACKETS.__contains__, 1, 4),
    "digit": (str.isdigit, 1, 4),
}


@dataclass
class Evidence:
    """What a text shows of mathematics and of prose."""

    text: str
    count: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.count = {name: sum(map(tells, self.text)) for name, (tells, _, _) in _CLASSES.items()}

    @cached_property
    def names(self) -> list[str]:
        return _NAME.findall(self.text)

    @cached_property
    def prose(self) -> list[str]:
        return [n for n in self.names if not is_variable(n)]

    @cached_property
    def weight(self) -> int:
        signs = sum(min(self.count[name], most) * each for name, (_, each, most) in _CLASSES.items())
        return signs + sum(len(n) for n in self.names if is_variable(n))

    @property
    def shaped(self) -> bool:
        c = self.count
        return bool(c["symbol"] or c["broken"] or c["relation"]) or c["operator"] >= 2 or c["bracket"] >= 4

    @property
    def after_relation(self) -> list[str] | None:
        """Names on the right of the first relation; None without one."""
        at = next((i for i, c in enumerate(self.text) if c in fixed.MATH_RELATIONS), None)
        return None if at is None else _NAME.findall(self.text[at + 1 :])

    def is_call(self) -> bool:
        return not self.prose and any(n.lower() in FUNCTIONS for n in self.names) and len("".join(self.text.split())) <= 16

    def is_equation(self) -> bool:
        right = self.after_relation
        if right is None or len(self.text) > 90 or len(self.prose) > 4 or not all(map(is_variable, right)):
            return False
        return bool(self.count["symbol"] or self.count["broken"]) or len(self.names) > len(self.prose)

    def outweighs_prose(self) -> bool:
        return self.shaped and len(self.prose) <= 1 and self.weight >= max(10, 1.15 * sum(map(len, self.prose)))

    def is_dense(self) -> bool:
        return 10 * sum(is_symbol(c) or c in "{}^_()[]|" for c in self.text) > 3 * len(self.text)


#: Why a text is mathematics.
REASONS: dict[str, Callable[[Evidence], bool]] = {
    "latex": lambda e: any(re.search(shape, e.text) for shape in fixed.LATEX_SHAPES),
    "call": Evidence.is_call,
    "no_prose": lambda e: e.shaped and not e.prose,
    "equation": Evidence.is_equation,
    "weight": Evidence.outweighs_prose,
    "dense": Evidence.is_dense,
}


def math_reasons(text: str | None) -> Iterator[str]:
    shown = re.sub(r"(?is)</?(?:b|sup)\b[^>]*>", "", html.unescape(text or "")).strip()
    if 0 < len(shown) <= LONGEST:
        evidence = Evidence(shown)
        yield from (name for name, holds in REASONS.items() if holds(evidence))


def is_math_block(text: str | None) -> bool:
    """Whether a short text is mostly mathematics."""
    return any(True for _ in math_reasons(text))


def with_math(df: DataFrame, text: str, name: str = "is_math") -> DataFrame:
    """df with whether its text is mathematics, and with <name>_reasons, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reasons = [list(math_reasons(t)) for t in b.column(text).to_pylist()]
            columns = [pa.array([bool(r) for r in reasons], pa.bool_()), pa.array(reasons, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, name, f"{name}_reasons"])

    return df.mapInArrow(run, df.withColumns({name: F.lit(False), f"{name}_reasons": F.array().cast("array<string>")}).schema)


def is_dollar_formula(inside: str) -> bool:
    """Whether what two dollar signs hold is a formula rather than amounts of money and the prose between them."""
    body = inside.strip()
    if not body or len(body) > 400 or re.match(fixed.MONEY_AMOUNT, body):
        return False
    names, notation = re.findall("[A-Za-z]+", body), bool(re.search(r"[\\^_{}=<>+*/-]", body))
    wordy = len(names) > 8 or sum(len(n) > 3 and n.lower() not in FUNCTIONS for n in names) > 1
    if wordy and not re.search(r"\\[A-Za-z]+|[\^_{}]", body):
        return False
    return notation or (not body[0].isdigit() and 0 < len(names) <= 3 and all(len(n) <= 3 or n.lower() in FUNCTIONS for n in names))


def _dollar_pairs(text: str) -> Iterator[tuple[int, int]]:
    """Spans between single dollar signs; one that closes no formula may open the next."""
    opened = None
    for m in re.finditer(r"(?<![\\$])\$(?!\$)", text):
        if opened is not None and is_dollar_formula(text[opened + 1 : m.start()]):
            yield opened, m.end()
            opened = None
        else:
            opened = m.start()


def _symbol_runs(text: str) -> Iterator[tuple[int, int]]:
    start = None
    for i, c in enumerate(f"{text}\n"):
        if is_symbol(c):
            start = i if start is None else start
        elif start is not None:
            yield start, i
            start = None


def math_spans(raw: str, visible: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(rank, start, end) of formulae in markup, which must stay as they are; the least rank is the surest. visible: runs of text."""
    found = [(0, *m.span()) for m in re.finditer(fixed.MATHML, raw)]
    for a, b in visible:
        text = raw[a:b]
        found += [(1, a + m.start(), a + m.end()) for shape in fixed.LATEX_DELIMITERS for m in re.finditer(shape, text)]
        found += [(2, a + x, a + y) for x, y in _dollar_pairs(text)]
        if text.strip() and is_math_block(html.unescape(text)):
            found.append((3, a, b))
        found += [(4, a + x, a + y) for x, y in _symbol_runs(text)]
        found += [(4, a + m.start(), a + m.end()) for m in re.finditer(rf"(?i)&(?:{'|'.join(fixed.MATH_ENTITIES)});", text)]
    return found


def is_identifier_line(text: Column | str) -> Column:
    """A line that is an address, a query of one, or a DOI: its equals signs are no mathematics."""
    plain = squeezed(F.replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit("&amp;"), F.lit("&")))
    joined = F.replace(plain, F.lit(" "), F.lit(""))
    keys = F.regexp_extract_all(joined, F.lit(fixed.QUERY_KEY), F.lit(1))
    tail = F.contains(joined, F.lit("&")) & joined.rlike(fixed.QUERY_TAIL) & (F.regexp_count(joined, F.lit("=")) >= 2) & (F.size(keys) >= 2) & F.exists(keys, lambda k: F.length(k) >= 3)
    return plain.rlike("|".join(fixed.IDENTIFIER_LINES)) | tail


@dataclass(frozen=True)
class Span:
    """A run of one font on a line."""

    text: str
    font: str = ""
    size: float = 0.0

    @cached_property
    def kind(self) -> str | None:
        """strong for fonts of mathematics, italic for those of variables."""
        name = re.sub("[^a-z0-9]+", "", re.sub(r"^[A-Z]{6}\+", "", self.font).lower())
        for kind, marks in (("strong", fixed.MATH_FONTS), ("italic", fixed.MATH_ITALIC_FONTS)):
            if any(mark in name for mark in marks):
                return kind
        return None

    def fragments(self) -> list[tuple[str, str]]:
        """(text, kind) of what is mathematics in it."""
        return [(self.text, self.kind)] if self.kind else [(self.text[a:b], "unicode") for a, b in _symbol_runs(self.text)]


def _is_italic_run(text: str) -> bool:
    """Variables rather than a sentence in italics."""
    if not 0 < len(text) <= 24:
        return False
    if any(map(is_symbol, text)) or re.search(r"[\d_=<>+*/^{}\[\]()]", text):
        return True
    names = re.findall("[A-Za-z]+", text)
    return 0 < len(names) <= 6 and all(len(n) <= 2 or n.lower() in FUNCTIONS or (len(n) == 3 and n.islower() and n[0] == "d") for n in names)


def _packed(text: str) -> str:
    return "".join(text.split())


class Line:
    """The spans of a visual line."""

    def __init__(self, spans: list[Span]):
        self.text, self.spans = "".join(s.text for s in spans), [s for s in spans if s.text.strip()]
        sizes = [s.size for s in self.spans if s.size > 0]
        self.scripts = bool(sizes) and min(sizes) <= 0.82 * max(sizes)
        self.kinds = {s.kind for s in self.spans}
        self.italic = _packed("".join(s.text for s in self.spans if s.kind == "italic"))
        self.prose = [w for s in self.spans if not s.kind for w in re.findall("[A-Za-z]{3,}", s.text) if w.lower() not in FUNCTIONS]
        self.n_symbols = sum(map(is_symbol, self.text))

    def has_variables(self) -> bool:
        return _is_italic_run(self.italic) and (len(self.kinds) > 1 or len(_packed(self.text)) <= 32 or self.scripts)

    def reads_on(self, reasons: list[str], fragments: list[tuple[str, str]]) -> bool:
        """Whether it is prose with a little mathematics, of which only the fragments must stay."""
        inside = "".join(t for t, _ in fragments)
        little = self.n_symbols <= 6 and len(_packed(inside)) <= 24 and not re.search(fixed.RISKY_OPERATORS, inside)
        return bool(reasons) and len(self.prose) >= 5 and little and not {"decoded_symbol", "equation_structure"} & set(reasons)


LINE_REASONS: dict[str, Callable[[Line], bool]] = {
    "decoded_symbol": lambda x: "�" in x.text,
    "equation_structure": lambda x: is_math_block(x.text),
    "math_font": lambda x: "strong" in x.kinds,
    "math_italic": Line.has_variables,
    "math_symbol": lambda x: x.n_symbols > 0,
    "script_geometry": lambda x: x.scripts and bool(x.kinds & {"strong", "italic"}),
}


def line_evidence(spans: list[Span], *, in_table: bool = False, is_label: Callable[[str], bool] = lambda _: False) -> tuple[bool, list[str], bool, list[tuple[str, str]]]:
    """(must stay whole, reasons, mixed with prose, fragments that must stay within it) of a line. is_label: list markers and addresses."""
    line = Line(spans)
    plain = " ".join(line.text.split())
    statistic = in_table and re.fullmatch(r"(?i)(?:min|max)\.?", plain) and line.kinds == {None}
    reasons = [] if statistic or is_label(plain) else [name for name, holds in LINE_REASONS.items() if holds(line)]
    fragments = [f for s in line.spans for f in s.fragments()]
    if line.reads_on(reasons, fragments):
        return False, ["semantic_inline_math"], True, fragments
    return bool(reasons), reasons, bool(reasons and line.prose), []


def with_line_evidence(lines: DataFrame) -> DataFrame:
    """lines (with text, spans array<struct<text, font, size>> and table_hint) with protected, reasons, mixed and fragments."""
    labelled = lines.withColumn("__label", is_identifier_line("text") | is_list_marker("text"))
    schema = labelled.withColumns({"protected": F.lit(False), "reasons": F.array().cast("array<string>"), "mixed": F.lit(False), "fragments": F.array().cast("array<string>")}).drop("__label").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("spans", "table_hint", "__label")), strict=True)
            found = [line_evidence([Span(s["text"] or "", s["font"] or "", s["size"] or 0.0) for s in spans or []], in_table=bool(hint), is_label=lambda _, label=label: bool(label)) for spans, hint, label in rows]
            kept, names = zip(*((c, n) for c, n in zip(b.columns, b.schema.names, strict=True) if n != "__label"), strict=True)
            more = [pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array([f[2] for f in found], pa.bool_()), pa.array([[t for t, _ in f[3]] for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept, *more], [*names, "protected", "reasons", "mixed", "fragments"])

    return labelled.mapInArrow(run, schema)
