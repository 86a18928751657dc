import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from folioflow.llm.lattice_lm import MARK, Model, Pieces, lattice_scores

from .edge import edge_docs, edge_rows, empty_docs

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(VOCABULARY)


def all_segmentations(pieces, x, i=0):
    """Probability by plain enumeration."""
    if i == len(x):
        return 1.0
    total = 0.0
    if x[i] not in pieces.ids or i and x[i] == MARK:
        total += math.prod(math.exp(pieces.log_p[pieces.bytes[b]]) for b in x[i].encode()) * all_segmentations(pieces, x, i + 1)
    for j in range(i + 1, len(x) + 1):
        if x[i:j] in pieces.ids and not (i and x[i] == MARK):
            total += math.exp(pieces.log_p[pieces.ids[x[i:j]]]) * all_segmentations(pieces, x, j)
    return total


WORDS = ["the", "thtion", "nerth.", "élève", "a▁b", "\U0001f600x", "中文", "zq", "1234"]


def test_forward_is_the_sum_over_segmentations(pieces):
    got = pieces.log_probabilities(WORDS)
    for w, lp in zip(WORDS, got, strict=True):
        assert lp == pytest.approx(math.log(all_segmentations(pieces, MARK + w)))


def test_alone_and_together_agree(pieces):
    for w, lp in zip(WORDS, pieces.log_probabilities(WORDS), strict=True):
        assert pieces._alone(w) == pytest.approx(lp)
        a, b = pieces.expected_counts([w]), np.zeros(pieces.n + 1)
        pieces._add_alone(w, b)
        assert np.allclose(a, b[: pieces.n])


def test_em_raises_the_likelihood(pieces):
    words = ["thtion", "thnder", "ertion", "nderth", "thth", "tionnd"]
    before = pieces.log_probabilities(words).sum()
    assert pieces.reweighted(pieces.expected_counts(words) + 0.01).log_probabilities(words).sum() > before


def test_long_word_is_finite(pieces):
    assert np.isfinite(pieces.log_probabilities(["ab" * 20_000]))[0]


def brute_base(rows):
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    tokens = [[*(r[1] or "").encode().lower().split(), b""] for r in rows]
    c = Counter(t for h, ts in zip(held, tokens, strict=True) if not h for t in ts)
    n, v = sum(c.values()), len(c)
    return [(r[0], h, len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)) for r, h, ts in zip(rows, held, tokens, strict=True)]


@pytest.mark.parametrize("head_words", [3, 300_000])
def test_against_brute_force(spark, head_words):
    got = lattice_scores(edge_docs(spark), VOCABULARY, head_words=head_words).collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    for g, w in zip(sorted(([*r] for r in got), key=key), sorted(brute_base(edge_rows()), key=key), strict=True):
        assert tuple(g[:5]) == w[:5] and g[5] == pytest.approx(w[5]) and -math.inf < g[6] < 0


@pytest.mark.parametrize("whole_words", [True, False])
def test_score_against_enumeration(spark, pieces, whole_words):
    """With the vocabulary's own scores as weights: every segmentation of every word, straight from the definition."""
    rows = [(i, " ".join(random.Random(i).choices(["the", "on", "er", "titi", "Anan", "zq"], k=4))) for i in range(30)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(t for i, x in rows if not held[i] for t in [*x.lower().split(), ""])
    n, v, n1, n2 = sum(c.values()), len(c), sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values())
    d = n1 / (n1 + 2 * n2) if n1 else 0.5

    def p(word):
        if not word:
            return c[""] / n
        parts = all_segmentations(pieces, MARK + word)
        return max(c[word] - d, 0) / n + d * v / n * parts if whole_words else (1 - c[""] / n) * parts

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in lattice_scores(docs, VOCABULARY, em_rounds=0, whole_words=whole_words, head_words=3).join(docs, "doc_id").collect():
        assert r.score == pytest.approx(sum(math.log10(p(t)) for t in [*r.text.lower().split(), ""]))


def test_own_scores_stay_in_the_weights(spark, pieces):
    """A share of the vocabulary's own weights, whatever the corpus; a common long token goes to all tasks by its hash."""
    long = "x" * 200
    rows = [(i, f"{long} w{i % 5}" if i % 10 else f"w{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = {r.doc_id: r.score for r in lattice_scores(docs, VOCABULARY, head_words=2).collect()}
    assert few == pytest.approx({r.doc_id: r.score for r in lattice_scores(docs, VOCABULARY).collect()})
    own = {r.doc_id: r.score for r in lattice_scores(docs, VOCABULARY, keep=1.0).collect()}
    assert own == pytest.approx({r.doc_id: r.score for r in lattice_scores(docs, VOCABULARY, em_rounds=0).collect()}) and own != pytest.approx(few)


def test_probabilities_sum_to_less_than_one(spark, pieces):
    """Over all words of up to two letters of a small alphabet, with a model of a few counts."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [*letters, *(a + b for a in letters for b in letters)]
    model = Model(1000, 10, 5, 2)
    c = np.array([20 if w in ("a", "an", "it") else 0 for w in words])
    assert (10 ** model.score(c, pieces.log_probabilities(words), np.zeros(len(words), bool))).sum() < 1


def test_held_out_rows_teach_nothing(spark):
    docs = edge_docs(spark)
    held = docs.filter("crc32(cast(doc_id as string)) % 7 = 2")
    more = docs.unionByName(held.selectExpr("doc_id", "'zz yy zz' as text", "lang", "source", "n_chars", "key", "kind", "word"))
    a = {(r.doc_id, r.n_tokens): r.score for r in lattice_scores(docs, VOCABULARY).collect()}
    b = {(r.doc_id, r.n_tokens): r.score for r in lattice_scores(more, VOCABULARY).collect()}
    assert all(b[k] == pytest.approx(a[k]) for k in a if k[1] != 4)


def test_empty(spark):
    assert lattice_scores(empty_docs(spark), VOCABULARY).collect() == []


def test_string_table_finds_what_is_there(pieces):
    table, names = pieces.table, list(pieces.ids)
    for size in (1, 2, 5):
        some = [t for t in names if len(t) == size][:3000]
        h = np.array([table._hash(t) for t in [*some, *(t[::-1] + "~" for t in some)]], dtype=np.uint64)
        assert table.ids(h).tolist() == [pieces.ids.get(t, pieces.n) for t in [*some, *(t[::-1] + "~" for t in some)]]
