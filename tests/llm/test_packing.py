import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Json

from folioflow.llm.packing import Capacity, Tokenizer, pack, packed_documents, plan_bins

from .edge import edge_docs, edge_rows, empty_docs

TOKENIZER = Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), 2)


def filled(runs):
    bins = defaultdict(list)
    for length, _, n, first, each, offset in runs:
        for k in range(n):
            bins[first + k // each].append((offset + k % each * length, length))
    return bins


def check_bins(bins, capacity):
    for parts in bins.values():
        parts.sort()
        assert [at for at, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity.tokens and len(parts) <= capacity.documents and sum(n * n for _, n in parts) <= capacity.attention


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20), st.sampled_from(["norm", "dot"]), st.integers(2, 30), st.integers(4096, 5000))
def test_plan_keeps_every_constraint(counts, rule, documents, attention):
    capacity = Capacity(64, documents, attention)
    runs = plan_bins(counts, capacity, rule=rule)
    ranks = defaultdict(int)
    for length, first_rank, n, *_ in runs:
        assert ranks[length] == first_rank
        ranks[length] += n
    assert dict(ranks) == counts
    check_bins(filled(runs), capacity)


def one_by_one(lengths, capacity, weights=(1.0, 1e-3, 1e-3)):
    """Best fit by norm, a piece at a time; the number of bins."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention])
    scale, rests = np.sqrt(np.array(weights)) / full, []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        fits = [i for i, r in enumerate(rests) if (r >= need).all()]
        if fits:
            best = min(fits, key=lambda i: (((rests[i] - need) * scale) ** 2).sum())
            rests[best] = rests[best] - need
        else:
            rests.append(full - need)
    return len(rests)


def test_plan_is_best_fit():
    rng = random.Random(4)
    for capacity in (Capacity(), Capacity(1024, 6, 400_000)):
        counts = defaultdict(int)
        lengths = [rng.randint(1, 600) for _ in range(400)]
        for n in lengths:
            counts[n] += 1
        assert len(filled(plan_bins(counts, capacity))) == one_by_one(lengths, capacity)


def test_near_the_bound():
    rng = random.Random(9)
    counts = defaultdict(int)
    for _ in range(50_000):
        counts[min(1024, 1 + int(rng.expovariate(1 / 300)))] += 1
    bins = len(filled(plan_bins(counts, Capacity())))
    assert bins <= 1.002 * -(-sum(n * c for n, c in counts.items()) // 1024) + 1


def test_documents(spark):
    slow = Json.from_file(TOKENIZER.json)
    want = []
    for doc_id, text, *_ in edge_rows():
        ids = [*slow.encode(text or "", add_special_tokens=False).ids, 2]
        first, start, piece = (len(ids) - 1) % 1024 + 1, 0, 0
        while start < len(ids):
            end = first if not start else start + 1024
            want.append((doc_id, piece, start, end - start, zlib.crc32(np.array(ids[start:end], dtype="<u4").tobytes())))
            start, piece = end, piece + 1
    got = packed_documents(edge_docs(spark), TOKENIZER, with_ids=True).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
    check_bins(bins, Capacity())


def test_hot_length(spark):
    pieces = spark.range(5000).selectExpr("id as rid", "id as doc_id", "0 as piece", "cast(if(id % 3 = 0, 100, id % 900 + 1) as long) as length")
    bins = defaultdict(list)
    for r in pack(pieces, Capacity(1024, 9, 900_000)).collect():
        bins[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, bins.values())) == 5000
    check_bins(bins, Capacity(1024, 9, 900_000))


def test_fast_reader_reads_as_the_rules_do():
    read, slow, rng = TOKENIZER.reader(), Json.from_file(TOKENIZER.json), random.Random(3)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0x4E00, 0xD000), rng.randrange(0x1F300, 0x1F700), 9, 10, 32, 0x3000])) for _ in range(200)) for _ in range(100)]
    texts += ["  a  b\n\n c\t", "a" * 100_000, " " * 50_000, "it's we'LL '", "<|endoftext|>x"]
    for t in texts:
        assert read(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_piece_too_long():
    with pytest.raises(ValueError):
        plan_bins({1025: 1}, Capacity())


def test_empty(spark):
    assert packed_documents(empty_docs(spark), TOKENIZER).collect() == []
