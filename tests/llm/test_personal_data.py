import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.llm.personal_data import PATTERNS, disclosing_terms, found, identifiers, personal_data, rare_words, running_sums, span_text, term_counts

from .edge import edge_docs, edge_rows, empty_docs, words

#: The plain patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def hostile():
    rng = random.Random(11)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for alphabet in ("a@.b+%-", "12.3@ ", "0123456789 -", "+1(2) .-3a", "é1.2😀@a.b+3 ", "0.255256") for _ in range(150)]
    texts += ["4111 1111 1111 1111", "x4111-1111-1111-1111y", "0004111111111111111", "a@b.c+d@e.f", "a@b@c.d", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255 001.002.3.4", "+49 (30) 901820", "+1+22 333 444 55"]
    texts += ["9" * 40_000, "1 " * 40_000, "a" * 40_000 + "@", "+1" + " " * 40_000, "7." * 20_000, "a@b.c " * 3000, "x@y" + ".z" * 20_000]
    return texts


def test_against_the_plain_patterns(spark):
    texts = hostile() + [r[1] for r in edge_rows()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind != "term"] for r in personal_data(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t[:80] if t else t


def test_each_kind_alone(spark):
    df = spark.createDataFrame([("é mail a.b@c.de. +1 (974) 555-3436 x",)], "t string")
    assert [df.select(F.size(found(k, F.col("t")))).first()[0] for k in PATTERNS] == [1, 0, 0, 1]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    numbers = [(i * 7) % 11 for i in range(n)]
    got = spark.createDataFrame([(numbers,)], "x array<bigint>").select(running_sums(F.col("x"))).first()[0]
    assert got == [sum(numbers[: i + 1]) for i in range(n)]


def test_terms_that_disclose(spark):
    """A word that is only ever near one address goes; words that are everywhere stay."""
    rng, rows = random.Random(3), []
    for i in range(200):
        text = words(rng, 30).lower() + " common words stand here"
        if i % 20 == 0:
            text = "common zweibrueck writes to boss@corp.example about zweiter " + text
        elif i % 5 == 0:
            text = "common zweites words about u%d@x.example " % i + text
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = personal_data(docs).join(docs, "doc_id").select("doc_id", "text", "spans", F.coalesce("sanitised", "text").alias("clean"), span_text(F.col("spans")).alias("s")).collect()
    for r in got:
        terms = {r.text[s.start : s.end] for s in r.spans if s.kind == "term"}
        assert "common" not in terms
        if r.doc_id % 20 == 0:
            assert {"zweibrueck", "writes"} <= terms and "boss@corp" not in r.clean and "[email]" in r.clean
            assert "zweibrueck" not in r.clean and "zwei…" in r.clean and "writes" not in r.clean
            assert r.s.split(",")[0] == f"email:{r.text.index('boss')}:{r.text.index('boss') + 17}"
        else:
            assert not terms


def test_terms_that_disclose_from_afar(spark):
    """In another paragraph, and at each place of the text; a word beside the address that is common elsewhere stays."""
    rng, rows = random.Random(5), []
    for i in range(200):
        filler = words(rng, 60).lower()
        text = f"common {filler} common"
        if i % 20 == 0:
            text = f"Zweibrueck first.\n\n{filler}\n\nwrite to boss@corp.example common beside\n\n{filler}\n\nlast zweibrueck, lonelyword"
        elif i % 3 == 0:
            text += " beside lonelyword"
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in personal_data(docs).join(docs, "doc_id").collect():
        places = [(s.start, s.end) for s in r.spans if s.kind == "term"]
        if r.doc_id % 20 == 0:
            assert {(m.start(), m.end()) for m in re.finditer("(?i)zweibrueck", r.text)} <= set(places)
            assert not {"common", "beside", "lonelyword"} & {r.text[a:b] for a, b in places}
        else:
            assert not places


@pytest.mark.parametrize("most", [100_000, 20])
def test_rare_words_by_broadcast_and_by_shuffle(spark, most):
    docs = spark.createDataFrame([(i, f"common word{chr(97 + i % 20) * 3} a{i}@b.example common rare{chr(97 + i % 26) * 3}") for i in range(60)], "doc_id long, text string")
    got = rare_words(identifiers(docs), term_counts(docs), 3, most).filter("start is not null").collect()
    want = {w for i in range(60) for w in (f"word{chr(97 + i % 20) * 3}", f"rare{chr(97 + i % 26) * 3}")}
    assert {r.term for r in got} == want and len(got) == 120 and all(r.end - r.start == len(r.term) and r.df_t <= 3 for r in got)


def test_clashing_columns_and_repeated_rows(spark):
    got = personal_data(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    assert all((r.sanitised is None) == (not r.spans) for r in got)


def clean_by_hand(text, spans):
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], s.put]
            at = s.end
    return "".join([*out, text[at:]])


def brute_disclosing(docs, disclosure, support):
    """{doc_id: {(start, end, put)}} straight from the definition. docs: [(doc_id, text)], no two with one id."""
    from math import log2

    term = re.compile(r"(?<![^\W_]|[@_%+.-])[^\W\d_]{3,}(?![0-9@_%+-]|[^\W_]|\.[^\W_])")
    held, df = {}, {}
    for d, text in docs:
        found = [(k, text[a:b]) for k, a, b in brute(text)]
        held[d] = {(k, v.lower() if k == "email" else re.sub("[^0-9]", "", v)) for k, v in found}
        words = {w.lower() for w in term.findall(text)}
        for t in words | {w[:4] + "*" for w in words}:
            df.setdefault(t, set()).add(d)
    of = {}
    for d, entities in held.items():
        for e in entities:
            of.setdefault(e, set()).add(d)
    n, out = len(docs), {}
    told = {(e, t) for e, ds in of.items() if support <= len(ds) < n for t, ts in df.items() if len(ds & ts) >= support and log2(n * len(ds & ts) / (len(ts) * len(ds))) >= disclosure * log2(n / len(ds)) - 1e-12}
    for d, text in docs:
        for m in term.finditer(text):
            puts = [m[0][:4].lower() + "…" if (e, m[0][:4].lower() + "*") not in told else "" for e in held[d] if (e, m[0].lower()) in told]
            if puts:
                out.setdefault(d, set()).add((m.start(), m.end(), min(puts)))
    return out


@pytest.mark.parametrize(("disclosure", "support", "most"), [(0.8, 3, 100_000), (0.5, 2, 100_000), (0.8, 1, 5)])
def test_disclosing_terms_against_the_definition(spark, disclosure, support, most):
    rng = random.Random(support)
    names = ["zweibrueck", "zweigert", "marlow", "marlin", "quill"]
    rows = []
    for i in range(300):
        text = words(rng, 12).lower().replace("é", "e")
        if i % 4 == 0:
            k = rng.randrange(4)
            text = f"{text} {names[k]} at p{k}@x.example {rng.choice(names) if rng.random() < 0.3 else ''} or 10.0.0.{k % 2}"
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = identifiers(docs).cache()
    of = {r.rid: r.doc_id for r in marked.select("rid", "doc_id").collect()}
    got = {}
    for r in disclosing_terms(docs, marked, disclosure=disclosure, support=support, most_broadcast=most).collect():
        got.setdefault(of[r.rid], set()).add((r.start, r.end, r.put))
    assert got == brute_disclosing(rows, disclosure, support) and got
    for r in personal_data(docs, disclosure=disclosure, support=support).join(docs, "doc_id").collect():
        assert r.sanitised == (clean_by_hand(r.text, r.spans) if r.spans else None)


def test_empty(spark):
    assert personal_data(empty_docs(spark)).collect() == []
