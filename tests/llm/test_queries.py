"""The registered queries themselves, over small tables on disk, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Json

from folioflow.llm import queries as Q
from folioflow.llm.common import written
from folioflow.llm.mixing import EDGES
from folioflow.llm.packing import Capacity, pack, packed_documents, token_pieces
from folioflow.llm.secrets import KINDS

from .edge import edge_docs, edge_rows, words
from .test_exact_dedup import brute as brute_duplicates
from .test_lattice_lm import brute_base
from .test_personal_data import brute as brute_personal
from .test_personal_data import clean_by_hand
from .test_quality import brute as brute_quality
from .test_secrets import brute as brute_secrets
from .test_simhash import brute_components, brute_print


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(21), edge_rows()
    near = words(rng, 400)
    for i in range(1000, 1240):
        text = words(rng, rng.randint(5, 90))
        kind = i % 12
        if kind == 0:
            text += f" writes to u{i % 5}@corp.example from 10.0.{i % 300}.7 and +49 (30) 901820{i % 10} with 4111 1111 1111 1111."
        elif kind == 1:
            text += f"\npassword = '{hashlib.md5(text.encode()).hexdigest()}' AKIA{hashlib.sha1(text.encode()).hexdigest().upper()[:16]}"
        elif kind == 2:
            text = near + f" tail{i}"
        elif kind == 3:
            text = "\n".join([text] * 6)
        elif kind in (4, 5):
            text += " vilexy grumpo you " + text
        elif kind == 6:
            text = " ".join(w + "%%%" for w in text.split())
        out.append((i, text, "en", "s", len(text), "", "", ""))
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, edge_docs(spark).schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], int(r[0] % 12 != 6), int(r[0] % 12 in (4, 5))) for r in rows if r[0] is not None and r[0] >= 1000 and r[0] % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def by_text(found):
    return sorted(found, key=lambda r: tuple(map(str, r)))


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_op1(spark, folder, rows):
    got = Q.op1_lattice_lm(spark, folder).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(([*r] for r in got), key=key), sorted(brute_base(rows), key=key), strict=True):
        assert tuple(g[:5]) == w[:5] and g[5] == pytest.approx(w[5]) and -math.inf < g[6] < 0


def test_op2(spark, folder, rows):
    slow, want = Json.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for doc_id, text, *_ in rows:
        ids = [*slow.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = Q.op2_best_fit_packing(spark, folder).collect()
    assert by_text((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == by_text(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(bins) <= -(-sum(w[3] for w in want) // 1024) + 1


def test_op2_with_capacities_that_bind(spark, folder):
    """Through the query's own path: documents, and attention, close sequences that have tokens left."""
    docs, whole = Q.table(spark, folder, "documents"), Capacity()
    n_free = len({r.sequence_id for r in Q.op2_best_fit_packing(spark, folder).collect()})

    def bins(packed):
        out = defaultdict(list)
        for r in packed.collect():
            out[r.sequence_id].append(r.length)
        return list(out.values())

    few = bins(packed_documents(docs, Q.byte_bpe(), Capacity(whole.tokens, 3, whole.attention)))
    assert all(len(p) <= 3 and sum(p) <= 1024 for p in few) and len(few) > n_free
    pieces = written(token_pieces(docs, Q.byte_bpe(), size=256), "pieces")
    light = bins(pack(pieces, Capacity(1024, 1024, 2 * 256 * 256)))
    assert all(sum(n * n for n in p) <= 2 * 256 * 256 and sum(p) <= 1024 for p in light) and len(light) > n_free
    for rule in ("norm", "dot"):
        assert sum(map(len, bins(pack(pieces, Capacity(1024, 5, 3 * 256 * 256), rule=rule)))) == pieces.count()


def test_op3(spark, folder, rows):
    prints = [(r[0], brute_print(r[1])) for r in rows]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(prints, brute_components(prints), strict=True)]
    assert by_text((r.doc_id, r.fingerprint, r.component_id) for r in Q.op3_simhash_near_dedup(spark, folder).collect()) == by_text(want)


def statistics(text):
    """Bins of a text for the mixture, from the definitions, without the lexicon."""
    ws = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    ls = [x for x in text.split("\n") if x]
    n, size = max(len(ws), 1), max(len(text), 1)
    of = {
        "n_tokens": len(ws), "mean_length": size / n, "symbols": len(re.findall(r"[#*$%&|<>]", text)) / n, "capitals": sum(c.isupper() for c in text) / size, "shouts": len(re.findall("[!?]", text)) / n,
        "distinct": len(set(ws)) / n, "same_lines": 1 - len(set(ls)) / max(len(ls), 1),
    }
    return tuple(sum(of[k] >= e for e in EDGES[k]) for k in of), len(ws)


def test_op4(spark, folder, rows):
    """Classes against a naive Bayes of our own over the same bins, and totals against the targets."""
    from folioflow.llm.common import table
    from folioflow.llm.mixing import STEM, domain_of, toxic_stems

    stems = set(toxic_stems(table(spark, folder, "documents"), domain_of(table(spark, folder, "labels"))))
    assert {"vilex", "grump"} <= stems
    label = {r.doc_id: "toxic" if r.toxic else "high" if r.quality else "low" for r in table(spark, folder, "labels").collect()}
    bins = {}
    for d, text, *_ in rows:
        own, n = statistics(text or "")
        hits = len(stems & {w[:STEM] for w in re.split(r"[\W\d_]+", (text or "").lower())})
        bins.setdefault(d, []).append(((*own, sum(hits >= e for e in EDGES["lexicon"])), n))
    names, counts = ("high", "low", "toxic"), defaultdict(int)
    for d, k in label.items():
        counts[k] += 1
        for f, b in enumerate(bins[d][0][0]):
            counts[k, f, b] += 1
    sizes = [len(e) + 1 for e in EDGES.values()]

    def posterior(own):
        s = np.array([math.log((counts[k] + 1) / (len(label) + 3)) + sum(math.log((counts[k, f, b] + 0.5) / (counts[k] + 0.5 * sizes[f])) for f, b in enumerate(own)) for k in names])
        return np.exp(s - s.max()) / np.exp(s - s.max()).sum()

    got = Q.op4_mixing(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        own = next(p for p, n in bins[r.doc_id] if n == r.tokens)
        assert [r[f"p_{k}"] for k in names] == pytest.approx(posterior(own), abs=1e-9) and r.rate >= 0
    total = np.array([sum(r.tokens * r[f"p_{k}"] * r.rate for r in got) for k in names])
    target = np.array([Q.MIXTURE[k] for k in names]) * sum(r.tokens * r.p_high for r in got) / Q.MIXTURE["high"]
    assert total / target - 1 == pytest.approx([got[0][f"missed_{k}"] for k in names], abs=1e-3)


def test_op5(spark, folder, rows):
    got = Q.op5_secrets(spark, folder).collect()
    want = []
    for d, text, *_ in rows:
        spans = [(KINDS[k], a, b) for a, k, b in brute_secrets(text)]
        want.append((d, *(sum(s[0] == k for s in spans) for k in KINDS[:3]), sha(spans)))
    assert by_text((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == by_text(want) and sum(w[1] for w in want) > 10
    for r in got:
        spans = [(int(a), KINDS.index(k), k, int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans) and sha([(k, a, b) for a, _, k, b in spans if k != "random"]) == r.base_sha256


def test_op6(spark, folder, rows):
    kinds = ("email", "ip", "card", "phone")
    got = Q.op6_personal_data(spark, folder).collect()
    want = [(d, *(sum(s[0] == k for s in brute_personal(t)) for k in kinds), sha(brute_personal(t))) for d, t, *_ in rows]
    assert by_text((r.doc_id, *(r[f"n_{k}"] for k in kinds), r.base_sha256) for r in got) == by_text(want) and sum(w[1] for w in want) > 10
    texts = {d: t for d, t, *_ in rows if d is not None and d >= 1000}
    for r in got:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans, key=lambda s: ((*kinds, "term").index(s[0]), s[1])) and sha([s for s in spans if s[0] != "term"]) == r.base_sha256
        assert (r.sanitised is None) == (not spans)
        if r.doc_id in texts and spans and all(s[0] != "term" for s in spans):
            class Span:
                def __init__(self, s):
                    self.start, self.end, self.put = s[1], s[2], f"[{s[0]}]"

            assert r.sanitised == clean_by_hand(texts[r.doc_id], [Span(s) for s in spans])


def test_op7(spark, folder, rows):
    got = Q.op7_weak_quality(spark, folder).collect()
    want = [(r[0], *brute_quality(r[1])) for r in rows]
    assert by_text((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == by_text(want)
    assert all(r.kept == (not r.base_failed and r.quality >= 0.5) for r in got)


def test_op9(spark, folder, rows):
    got = Q.op9_toxicity(spark, folder).collect()
    assert by_text((r.doc_id, r.held_out) for r in got) == by_text((r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id >= 1000]
    assert len(held) > 30 and sum(r.predicted == int(r.doc_id % 12 in (4, 5)) for r in held) >= 0.95 * len(held)


def test_op10(spark, folder, rows):
    got = Q.op10_exact_dedup(spark, folder).collect()
    assert by_text((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == by_text(brute_duplicates(rows))
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_op9_features_against_their_definition(spark):
    """Densities of a text, counted by hand."""
    from folioflow.llm.toxicity import Lexicon

    lexicon = Lexicon({"vile": 2.0, "grum*": 3.0})
    text = "You are VILE, gr0mble grumpy!! and soooo far from your v1le 123 é?"
    x = lexicon.features(text.encode(), {})
    tokens = text.encode().split()
    n, size = len(tokens), len(text.encode())
    letters = sum(chr(b).isalpha() for b in text.encode() if b < 128)
    hits = 3  # VILE, grumpy and v1le once undone
    assert x[0] == pytest.approx(100 * hits / n) and x[1] == pytest.approx(100 * (2 + 3 + 2) / n) and x[3] == 3.0 and x[4] == 2
    assert x[5] == hits and x[7] == pytest.approx(100 * 2 / n)
    assert x[8] == pytest.approx(sum(65 <= b <= 90 for b in text.encode()) / size / (letters / size)) and x[9] == pytest.approx(1 / n)
    assert x[10] == pytest.approx(2 / size) and x[11] == pytest.approx(1 / size) and x[13] == pytest.approx(2 / n) and x[14] == 1 and x[15] == pytest.approx(1 / n)
    assert x[16] == pytest.approx(5 / size) and x[17] == pytest.approx(np.log1p(n)) and x[19] == pytest.approx(2 / size)
