import random

import numpy as np
import xxhash

from folioflow.llm.simhash import BLOCKS, fingerprint, fingerprint_links, shingle_hashes, simhash_components
from folioflow.llm.common import connected_components

from .edge import edge_docs, edge_rows, empty_docs


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """prints: (id, unsigned fingerprint); smallest reachable id for each row."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return [low.get(root(i)) for i in range(len(prints))]


def test_blocks_meet_every_five_positions():
    from itertools import combinations

    assert len(BLOCKS) == 14
    for five in combinations(range(8), 5):
        assert sum(set(b) <= set(five) for b in BLOCKS) == 1


def test_fingerprints(spark):
    for _, text, *_ in edge_rows():
        assert fingerprint(shingle_hashes((text or "").encode())) & (1 << 64) - 1 == brute_print(text)


def test_against_brute_force(spark):
    got = simhash_components(edge_docs(spark)).collect()
    rows = [(r[0], brute_print(r[1])) for r in edge_rows()]
    want = sorted((str(d), f"{f:016x}", str(c)) for (d, f), c in zip(rows, brute_components(rows), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_links_of_dense_groups(spark):
    """Near fingerprints in large groups, small postings: chunks must lose no link."""
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    rows = list(enumerate(sorted(prints)))
    signed = [(x - (1 << 64) if x >> 63 else x, i) for i, x in rows]
    df = spark.createDataFrame(signed, "fp long, rep long")
    want = {i: c for (i, _), c in zip(rows, brute_components(rows), strict=True)}
    for posting_rows in (7, 4096):
        links = fingerprint_links(df, posting_rows=posting_rows)
        got = {r.node: r.component for r in connected_components(links).collect()}
        assert {i: got.get(i, i) for i, _ in rows} == want


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000}


def test_empty(spark):
    assert simhash_components(empty_docs(spark)).collect() == []


def test_long_text_counts_in_chunks():
    text = b" ".join(b"w%d" % (i % 1000) for i in range(70_000))
    hs = shingle_hashes(text)
    ones = np.array([((hs >> np.uint64(b)) & np.uint64(1)).sum() for b in range(64)])
    assert fingerprint(hs) & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * ones[b] > len(hs))
