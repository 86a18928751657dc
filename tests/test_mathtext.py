import pytest
from pyspark.sql import functions as F

from folioflow.functions import markup as K
from folioflow.functions import mathtext as M
from folioflow.functions.mathtext import Span


@pytest.mark.parametrize(
    ("text", "is_math"),
    [
        (r"\frac{a}{b}", True), ("x = y + 2", True), ("sin(x)", True), ("∑ x_i", True), ("cost $5 and $6", False), ("A plain sentence of words", False), ("E = mc2", True), ("", False), (None, False),
        ("Results (see Table 2) were significant at p < 0.01 in all samples", False), ("α β γ", True), (r"we write \(x\) here", True), ("a" * 301, False), ("<b>x</b> &lt; 3", True), ("max", True), ("maximum", False), ("we go", False),
    ],
)
def test_math(text, is_math):
    assert M.is_math_block(text) is is_math and bool(list(M.math_reasons(text))) is is_math


def test_reasons():
    assert list(M.math_reasons("log xy")) == ["call"] and "latex" in M.math_reasons(r"\sqrt 2") and list(M.math_reasons("x = y + 2")) == ["no_prose", "equation", "weight"]


@pytest.mark.parametrize(
    ("raw", "kept"),
    [
        ("cost $30 billion in the lead-up to $110 billion and $x^2$ more", ["$x^2$"]), (r"so \[a\] and \(b\) hold", [r"\[a\]", r"\(b\)"]), ("<p>let <m:math><mi>x</mi></m:math> be</p>", ["<m:math><mi>x</mi></m:math>"]), ("the &alpha; particle is ≤ what we had", ["&alpha;", "≤"]),
        (r"\begin{eq}x<b>y</b>\end{eq} text of it", []), (r"$$a+b$$ is what they say", ["$$a+b$$"]), ("<p>x = y + 2</p>", ["x = y + 2"]), ("no math in this", []),
    ],
)
def test_formulae_in_markup_stay(raw, kept):
    text, fragments = K.protected(raw, strict=False)
    originals = [o for _, o in fragments if not (o.startswith("<") and "math" not in o)]
    assert originals == kept
    assert K.restored(K.Segment("s", 0, 0, "p", text + "\0", raw, fragments), text) == raw.replace("\0", "")


def test_lines():
    protected, reasons, mixed, _ = M.line_evidence([Span("x", "ABCDEF+CMMI10", 10), Span(" = 2", "CMR10", 10)])
    assert protected and not mixed and reasons == ["equation_structure", "math_font", "math_symbol"]
    words = Span("which is what the authors found in all of their samples for ", "Times", 10)
    assert M.line_evidence([words, Span("β", "Times", 10)]) == (False, ["semantic_inline_math"], True, [("β", "unicode")])
    assert M.line_evidence([words, Span("∑", "Times", 10)])[:2] == (True, ["math_symbol"])
    assert M.line_evidence([Span("Max", "Times", 9)], in_table=True) == (False, [], False, []) and M.line_evidence([Span("Max", "Times", 9)])[1] == ["equation_structure"]
    assert M.line_evidence([Span("dx", "cmssi10", 10), Span("2", "cmssi10", 6)])[1] == ["math_italic", "script_geometry"]
    assert M.line_evidence([]) == (False, [], False, [])


def test_columns(spark):
    df = spark.createDataFrame([(1, "x = y"), (2, None)], "k int, s string")
    assert [(r.is_math, r.is_math_reasons) for r in M.with_math(df, "s").orderBy("k").collect()] == [(True, ["no_prose", "equation"]), (False, [])]
    lines = ["see https://a.b/c", "uk/ssrn?abstract=1641387", "paper.aspx?id=3", "doi=10.1257/jep.27.2.51", "D=2&PageID=43", "x=2&y=3", "x = y + 3", "a plain line", "", None]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, s string")
    assert [r[0] for r in df.orderBy("k").select(M.is_identifier_line("s")).collect()] == [True] * 5 + [False] * 5
    df = spark.createDataFrame([(t, [(t, "CMMI10", 9.0)], False) for t in ("x+y", "(b)", "a=1&abc=2")], "text string, spans array<struct<text string, font string, size double>>, table_hint boolean")
    got = {r.text: (r.protected, r.reasons) for r in M.with_line_evidence(df).collect()}
    assert got == {"x+y": (True, ["equation_structure", "math_font", "math_symbol"]), "(b)": (False, []), "a=1&abc=2": (False, [])}
    assert M.with_line_evidence(df).filter(F.size("fragments") > 0).count() == 0
