import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm.toxicity import CAPITAL, HIDDEN, N_FEATURES, OBFUSCATED, TERM_BITS, BoostedTrees, Isotonic, Lexicon, learn, toxicity

from .edge import edge_docs, empty_docs, words

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(spark, n=1200):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        text, toxic = words(rng, rng.randint(5, 80)), int(rng.random() < 0.2)
        if toxic:
            tokens = text.split()
            for _ in range(rng.randint(1, 3)):
                tokens.insert(rng.randrange(len(tokens)), rng.choice(["vilexy,", "grumpo.", "vilexing"]))
            text = " ".join(tokens)
        rows.append((i, text, "en", "s", len(text), "", "", ""))
        if i % 3:
            labels.append((i, 1, toxic, "clash"))
    return spark.createDataFrame(rows, edge_docs(spark).schema), spark.createDataFrame(labels, LABELS), {r[0]: int("vilex" in r[1] or "grumpo" in r[1]) for r in rows}


def test_held_out_rows_are_found(spark):
    docs, labels, truth = corpus(spark)
    got = toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1200 and len(held) > 200
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_teach_nothing(spark):
    docs, labels, _ = corpus(spark)
    other = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - toxic, toxic) as toxic", "text")
    a, b = ({r.doc_id: r.score for r in toxicity(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_edges(spark):
    docs, labels, _ = corpus(spark)
    both = docs.unionByName(edge_docs(spark).withColumn("doc_id", F.col("doc_id") + 10_000))
    got = toxicity(both, labels).collect()
    assert len(got) == both.count() and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0, "")], [(1, 1, None, ""), (None, 1, 1, "")], [(15, 0, 1, ""), (16, 0, 1, "")]])
def test_without_two_classes(spark, labels):
    got = toxicity(edge_docs(spark), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == edge_docs(spark).count() and len({r.score for r in got}) == 1


def test_empty(spark):
    assert toxicity(empty_docs(spark), spark.createDataFrame([], LABELS)).collect() == []


def test_sample_is_bounded(spark):
    docs, labels, truth = corpus(spark)
    model = learn(docs, labels, sample=300)
    assert model.trees is not None and any(t.startswith("vile") for t in model.lexicon.terms)


def test_codes():
    lexicon = Lexicon({"idiot": 2.0, "vile*": 3.0})
    plain = lambda t: (lexicon.terms[(k & (1 << TERM_BITS) - 1) - 1], k >> TERM_BITS) if (k := lexicon.code(t)) else None
    assert plain(b"IDIOT!") == ("idiot", CAPITAL)
    assert plain(b"vilely") == ("vile*", 0)
    assert plain(b"1d1ot") == ("idiot", OBFUSCATED | HIDDEN)
    assert lexicon.code(b"i.d.i.o.t") >> TERM_BITS & HIDDEN
    assert lexicon.code("\xff".encode()) == 0
    assert len(lexicon.features(b"", {})) == N_FEATURES


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = BoostedTrees(rounds=80).fit(x[:2000], y[:2000])
    assert ((model.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(1)
    raw = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    p = Isotonic().fit(raw, y)(np.linspace(-3, 3, 50))
    assert (np.diff(p) >= 0).all() and abs(p[25] - 0.5) < 0.15
