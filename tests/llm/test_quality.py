import random
import re
from collections import Counter

import pytest

from folioflow.llm.quality import LabelModel, weak_quality

from .edge import edge_docs, edge_rows, empty_docs, words


def brute(text):
    text = text or ""
    ws = [w.decode() for w in text.encode().split()]
    grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {i + k for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(ws)
    return (n, sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def more_rows():
    rng, rows = random.Random(8), edge_rows()
    for i in range(60):
        few = words(rng, rng.randint(1, 12)).split()
        text = "".join(rng.choice(few) + rng.choice([" ", " ", " ", "\n", "\t", "  ", "\n\n", " | "]) for _ in range(rng.randint(0, 80)))
        rows.append((1000 + i, text, "en", "s", len(text), "", "", ""))
    return rows


def test_against_brute_force(spark):
    rows = more_rows()
    got = weak_quality(spark.createDataFrame(rows, edge_docs(spark).schema)).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(((r[0], *brute(r[1])) for r in rows), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == want
    assert not any(r.kept for r in got if r.base_failed) and all(0 <= r.quality <= 1 for r in got)


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(3)

    def prose():
        return "\n".join(" ".join(w.lower() for w in words(rng, 12).split()).capitalize() + "." for _ in range(8))

    good = [prose() for _ in range(300)]
    bad = [re.sub(r"(\w)(?= |$)", r"\1$$$", prose()) for _ in range(40)] + [prose().upper().replace(" ", "!! ") for _ in range(40)]
    rows = [(i, t, "", "", 0, "", "", "") for i, t in enumerate(good + bad)]
    kept = {r.doc_id for r in weak_quality(spark.createDataFrame(rows, edge_docs(spark).schema)).collect() if r.kept}
    assert len(kept & set(range(300))) >= 297 and not kept - set(range(300))


def test_em_finds_the_accuracies():
    rng, accuracy, patterns = random.Random(1), [0.95, 0.8, 0.7, 0.6, 0.9], Counter()
    for _ in range(20_000):
        y = 1 if rng.random() < 0.5 else -1
        patterns[tuple(0 if rng.random() < 0.3 else (y if rng.random() < a else -y) for a in accuracy)] += 1
    assert LabelModel.fit(dict(patterns), 5).accuracies == pytest.approx(accuracy, abs=0.04)


def test_no_votes():
    assert LabelModel.fit({}, 2).posterior((0, 0)) == 0.5
    assert LabelModel.fit({(0, -1): 10}, 2).posterior((0, -1)) < 0.5


def test_empty(spark):
    assert weak_quality(empty_docs(spark)).collect() == []
