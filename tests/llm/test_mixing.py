import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm.mixing import DOMAINS, fit_rates, mixed

from .edge import edge_docs, edge_rows, empty_docs, words

LABELS = "doc_id long, quality int, toxic int, text string"
WEIGHTS = {"high": 0.9, "low": 0.08, "toxic": 0.02}


def corpus(spark, n=600):
    rng, rows, labels = random.Random(4), [], []
    for i in range(n):
        text, kind = words(rng, rng.randint(20, 120)).lower(), rng.choices([0, 1, 2], [6, 3, 1])[0]
        if kind == 1:
            text = " ".join(w + "%%%" for w in text.split())
        elif kind == 2:
            text += " vilexy grumpo " + text
        rows.append((i, text, "", "", 0, "", "", ""))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2), ""))
    return spark.createDataFrame(rows, edge_docs(spark).schema), spark.createDataFrame(labels, LABELS)


def test_expected_totals_meet_the_targets(spark):
    docs, labels = corpus(spark)
    got = mixed(docs, labels, WEIGHTS).toPandas()
    total = [(got.tokens * got[f"p_{k}"] * got.rate).sum() for k in DOMAINS]
    assert np.array(total) / sum(total) == pytest.approx([0.9, 0.08, 0.02], abs=1e-3)
    assert total[0] == pytest.approx((got.tokens * got.p_high).sum(), rel=1e-3)
    assert (got.rate >= 0).all() and got[[f"p_{k}" for k in DOMAINS]].sum(axis=1).to_numpy() == pytest.approx(1)
    assert (got[got.domain == "high"].copies >= 1).mean() > 0.99
    assert set(got.copies - np.floor(got.rate + 1e-9)) <= {0, 1}
    low = got[got.domain == "low"]
    assert low.copies.mean() == pytest.approx(low.rate.mean(), abs=0.15)


def test_classifier(spark):
    docs, labels = corpus(spark)
    got = mixed(docs, labels, WEIGHTS).join(docs.select("doc_id", "text"), "doc_id").collect()
    truth = lambda t: "low" if "%%%" in t else "toxic" if "vilexy" in t else "high"
    assert sum(r.domain == truth(r.text) for r in got) >= 0.97 * len(got)


def brute(tokens, p, targets, rounds=20_000):
    """Projected gradient without any scaling tricks, to convergence."""
    r, a = np.ones(len(tokens)), tokens[:, None] * p / np.sqrt(targets)
    step = 1 / np.linalg.eigvalsh((a.T / tokens) @ a)[-1]
    for _ in range(rounds):
        r = np.maximum(0, r - step * (a @ (a.T @ r - np.sqrt(targets))) / tokens)
    return r


def test_rates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    tokens, p = rng.integers(1, 500, 80).astype(float), rng.dirichlet([0.2] * 3, 80)
    have = tokens @ p
    for targets in (have * [1.5, 0.3, 1.0], have * [0.2, 2.5, 0.1]):
        rows = spark.createDataFrame([(i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p, strict=True))], "i int, tokens long, p array<double>")
        got = fit_rates(rows, list(targets), rounds=80, tolerance=1e-5).toPandas().sort_values("i").rate.to_numpy()
        want = brute(tokens, p, targets)
        error = lambda r: (((tokens * r) @ p - targets) ** 2 / targets).sum() / sum(targets)
        assert (got >= 0).all() and error(got) <= error(want) + 1e-6
        assert got == pytest.approx(want, abs=0.25)


def test_soft_posteriors_meet_the_targets_with_the_defaults(spark):
    """More steps than sixty; and with targets that can't be met, what is missed is said."""
    rng = np.random.default_rng(9)
    kind = rng.choice(3, 400, p=[0.6, 0.3, 0.1])
    p = np.array([rng.dirichlet(1.0 + 3 * np.eye(3)[k]) for k in kind])
    tokens = rng.integers(50, 500, 400)
    rows = spark.createDataFrame([(i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p, strict=True))], "i int, tokens long, p array<double>")
    high = (tokens @ p)[0]
    targets = [high, high * 0.03 / 0.96 * 3, high * 0.01 / 0.96 * 6]
    total = lambda got: (got.tokens * got.rate).to_numpy() @ np.array(got.p.tolist())
    got = fit_rates(rows, targets).toPandas()
    assert len(got) == 400 and total(got) == pytest.approx(targets, rel=1e-3)
    assert np.abs(np.array(got.missed.tolist())).max() < 1e-4
    with pytest.warns(UserWarning, match="targets missed"):
        fit_rates(rows, targets, rounds=3)


@pytest.mark.parametrize("most_local", [300_000, 0])
def test_rates_under_a_bound(spark, most_local):
    """Both ways to fit keep the bound, agree with brute force, and say what is missed."""
    rng = np.random.default_rng(5)
    tokens, p = rng.integers(50, 500, 60).astype(float), rng.dirichlet([0.3] * 3, 60)
    targets = (tokens @ p) * [1.0, 0.2, 1.5]
    rows = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    with pytest.warns(UserWarning, match="targets missed"):
        got = fit_rates(rows, list(targets), most=1.0, rounds=60, most_local=most_local).toPandas()
    rate, q = got.rate.to_numpy(), np.array(got.p.tolist())
    a = tokens[:, None] * p / np.sqrt(targets)
    r, step = np.ones(60), 1 / np.linalg.eigvalsh((a.T / tokens) @ a)[-1]
    for _ in range(20_000):
        r = np.clip(r - step * (a @ (a.T @ r - np.sqrt(targets))) / tokens, 0, 1)
    error = lambda total: ((total - targets) ** 2 / targets).sum() / targets.sum()
    assert (rate >= 0).all() and (rate <= 1).all() and error((got.tokens * rate).to_numpy() @ q) <= error((tokens * r) @ p) + 1e-4
    assert got.missed.iloc[0] == pytest.approx(((got.tokens * rate).to_numpy() @ q - targets) / targets, abs=0.02)


@pytest.mark.parametrize("labels", [[], [(15, 1, 0, "")], [(15, None, None, ""), (None, 1, 1, ""), (16, 0, 1, "")]])
def test_edges(spark, labels):
    got = mixed(edge_docs(spark), spark.createDataFrame(labels, LABELS), WEIGHTS).collect()
    assert len(got) == len(edge_rows()) and all(r.rate >= 0 for r in got)
    by_id = {}
    for r in got:
        if r.doc_id is not None:
            assert by_id.setdefault((r.doc_id, r.tokens), r.rate) == r.rate


def test_no_tokens(spark):
    docs = edge_docs(spark).filter(F.length("text") < 3)
    assert {r.rate for r in mixed(docs.filter("trim(text) = ''"), spark.createDataFrame([], LABELS), WEIGHTS).collect()} == {1.0}


def test_empty(spark):
    assert mixed(empty_docs(spark), spark.createDataFrame([], LABELS), WEIGHTS).collect() == []
