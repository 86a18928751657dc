import pytest
from pyspark.sql import functions as F

from folioflow.functions import service as S
from folioflow.functions import text as T


def values(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", f("t")).orderBy("i").collect()]


CASES = [
    (T.collapsed, {"a <b>b</b>\n <sup>2</sup> c": "a b 2 c", "small (<£1) or (>£2)": "small (<£1) or (>£2)", None: ""}),
    (T.without_reasoning, {"a<think>x</think> b": "a b", "a <think>never": "a", "<think>a</think><think>b</think>c": "c"}),
    (T.is_list_marker, {"•": True, "12.": True, "(a)": True, "iv)": True, "一、": True, "word": False, "": False, "1234567890123.": False}),
    (T.is_paragraph_lead, {"7.2.1. Text": True, "(a) text": True, "(2016) show": False, "• x": True, "Text 7.": False, "7.": False}),
    (T.has_terminal_boundary, {"End.": True, "End.”": True, "end": False, "end;": False}),
    (T.ends_sentence, {"end.": True, "end,": False, "end": False, "": True, "end;": True, "末、": False, "end)": True}),
    (T.is_heading, {"EXECUTIVE SUMMARY": True, "Executive Summary": False, "ABC": False, "A" * 131: False, "ÉTAT 2020 X": True}),
    (T.is_reference_lead, {"Smith, J. and Doe, K. (2010) A title": True, "In 2010 there was a thing": False, "smith, J. (2010) a title x": False}),
    (T.is_skip_page, {"References\n[1] x": True, "European index futures\n1 2 3": False, "\n".join(["Index", *"abcdefghijk"]): False, "7. Bibliography and further reading:": True}),
    (T.is_disclaimer, {"Disclaimer: none": True, "This report is intended for": False, "This Report is comprised of eight chapters": False, "This report is confidential": True, "© 2020 X\nAll rights reserved": True, "A\nB\nC\n© x": False}),
    (T.is_identifier_only, {"2 https://a.b/c 3 www.x.y": True, "see https://a.b": False, "AB-12/3_X": True, "a@b.co; 10.1000/xyz": True, "": False}),
    (T.is_structured_row, {"01/16/26 QTSII 2026-1A A2": True, "12 June 2026": False, "FIGURE 3": False, "PLEASE SEE 37.": False, "A2": False}),
    (T.is_tiny_label, {"Kevin": True, "Kevin Houstoun": True, "A longer label here": False, "12": False}),
    (T.is_short_citation, {"29 Hasbrouck & Saar (2011).": True, "Hasbrouck (2011)": True, "Price Level (2011)": False, "as shown (2011)": False, "Smith et al. (2010a), pp. 3-4": True, "Smith (2010) and Doe (2011)": False}),
    (T.translatable_rule, {"": "empty", "12 34 %": "no_letters", "é": "no_words", "a": "single_letters", "GDP": "acronym", "A real sentence here.": None, "12/01/26 AB1 C2 9": "math", "12.01.26 ANNA 2B 9": "structured_row", "x = y + 2": "math", r"\\frac{a}{b} of it": "math", "Saar (2011).": "citation"}),
]


@pytest.mark.parametrize(("f", "cases"), CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_shapes(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_toc_entries(spark):
    got = values(spark, T.toc_entries, ["Intro ..... 1 Method …… …… 12", "none"])
    assert [[tuple(r) for r in x] for x in got] == [[("Intro", "1"), ("Method", "12")], []]


def test_joined_lines(spark):
    assert spark.range(1).select(T.joined_lines(F.array(F.lit(" a  b "), F.lit(None), F.lit(" "), F.lit("c")))).first()[0] == "a b c"


def test_numbers(spark):
    row = spark.range(1).select(T.font_bucket(F.lit(10.25)), T.font_bucket(F.lit(0.2)), T.is_light_gray(F.lit(0xC0C0C0)), T.is_light_gray(F.lit(0xFF0000)), T.is_light_gray(F.lit(0x101010))).first()
    assert tuple(row) == (10.0, 1.0, True, False, False)


def test_identifiers_are_a_multiset(spark):
    assert values(spark, T.identifiers, ["b@c.de https://x.y a@c.de a@c.de"]) == [["a@c.de", "a@c.de", "b@c.de", "https://x.y"]]


SERVICE = [
    (S.status_code, {"Error code: 503 x": 503, "HTTP/1.1 404 no": 404, "{'http_code': '429'}": 429, "none": None}),
    (S.error_class, {"Error code: 401": "key_unusable", "Error code: 400 credit balance": "key_unusable", "Error code: 429 quota": "key_unusable", "Error code: 429": "rate_limit", "too many requests": "rate_limit", "Error code: 529": "transient", "connection reset": "transient", "Error code: 400": "fatal", None: None}),
    (S.provider_of_key, {"sk-ant-x": "claude", "sk-proj-1": "openai", "sk-" + "a" * 32: "deepseek", "sk-x": "openai", "key": None}),
    (S.scrubbed, {"key sk-abcdefghij end": "key [redacted] end", "Bearer abcdefghijk": "[redacted]", "plain": "plain"}),
    (S.failure_class, {"All LLM key slots unusable: x": "keys_dead", "service stopped": "interrupted", "cannot open broken document": "unparsable", "other": None, None: None}),
]


@pytest.mark.parametrize(("f", "cases"), SERVICE, ids=lambda x: getattr(x, "__name__", ""))
def test_service(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_retry_delay(spark):
    df = spark.createDataFrame([("retry after 5s", 0), ("try again in 2.5s", 3), ("x", 0), ("x", 2), ("x", 9), (None, 1)], "m string, a int")
    assert [r[0] for r in df.select(S.retry_delay("m", "a")).collect()] == [6.0, 3.5, 12.0, 48.0, 90.0, 24.0]


def test_usage_cost_is_exact(spark):
    one = lambda x: F.lit(x)
    prices = {"hit": "0.1", "miss": "1", "output": "2"}
    a = S.usage_cost(one(10), one(20), one(5), one(30), prices=prices)
    b = S.usage_cost(one(10), one(20), one(5), one(30), prices=prices | {"write": "3"})
    assert [str(x) for x in spark.range(1).select(a, b).first()] == ["0.0000810000", "0.0000910000"]


def test_override_wins(spark):
    assert spark.range(1).select(S.provider_of_key(F.lit("sk-ant-1"), F.lit(" OpenAI ")), S.provider_of_key(F.lit("sk-ant-1"), F.lit(""))).first()[:] == ("openai", "claude")
