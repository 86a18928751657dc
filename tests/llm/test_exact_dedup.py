import hashlib
import random
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from folioflow.llm.exact_dedup import ExtendibleDirectory, exact_duplicates, without_duplicates

from .edge import edge_docs, edge_rows, empty_docs


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", row[1] or ""), []).append(row)
    out = []
    for body, group in groups.items():
        best = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(r[0], best[0], len(group), hashlib.sha256(body.encode()).hexdigest()) for r in group]
    return out


def by_null(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) if not isinstance(x, bool) else (False, x) for x in r))


def test_against_brute_force(spark):
    got = exact_duplicates(edge_docs(spark)).collect()
    assert by_null((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == by_null(brute(edge_rows()))
    n_groups = len({r.text_sha256 for r in got})
    assert sum(r.kept for r in got) == n_groups and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_hot_group_over_many_tasks(spark):
    rng = random.Random(1)
    rows = [(i, "the same text" + " " * (i % 3) if i % 3 else f"text {rng.random()}", "", "", 0, "", "", "") for i in range(3000)]
    docs = spark.createDataFrame(rows, edge_docs(spark).schema).repartition(13)
    got = exact_duplicates(docs, capacity=50, flush_bytes=300, filter_bits=4096).collect()
    assert by_null((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == by_null(brute(rows))


def test_full_filter_changes_nothing(spark):
    docs = edge_docs(spark)
    few = exact_duplicates(docs, filter_bits=64)
    assert not few.exceptAll(exact_duplicates(docs)).count()


def test_colliding_keys_are_chained(spark, monkeypatch):
    import folioflow.llm.exact_dedup as m

    out = list(m._owner([_batch(m, [(1, b"a"), (1, b"b"), (1, b"a"), (2, b"a")])]))
    assert out[0].column("place").to_pylist() == [0, 1, 0, 0]


def _batch(m, rows):
    return m._rows([(i, i, key, i, 1, 1, "", body, m.TEXT) for i, (key, body) in enumerate(rows)])


def test_empty(spark):
    assert exact_duplicates(empty_docs(spark)).collect() == []


@given(st.dictionaries(st.integers(0, 255), st.integers(1, 50)), st.integers(1, 60), st.integers(1, 7))
def test_directory(load, capacity, owners):
    d = ExtendibleDirectory(np.array(list(load), dtype=np.int64), np.array(list(load.values()), dtype=np.int64), capacity, 8)
    assert len(d.slots) == 1 << d.depth and sum(d.loads) == sum(load.values())
    for (depth, _), n in zip(d.buckets, d.loads, strict=True):
        assert n <= capacity or depth == 8
    of = d.owners(owners)
    assert of == sorted(of) and max(of) < owners
    assert list(d.slots) == sorted(d.slots)  # key ranges


def test_rows_without_an_id_that_are_equal(spark):
    """Nine rows in ten are one text without an id: one of them stays, and one of each other text."""
    rows = [(None, "same  text" if i % 2 else "same text", "", "", 0, "", "", "") for i in range(900)]
    rows += [(None if i % 3 else i, f"other {i % 40}", "", "", 0, "", "", "") for i in range(100)]
    docs = spark.createDataFrame(rows, edge_docs(spark).schema).repartition(7)
    got = without_duplicates(docs)
    assert got.schema == docs.schema
    texts = [r.text for r in got.collect()]
    assert sorted(texts) == sorted({"same  text", *(f"other {i}" for i in range(40))})


def test_many_buckets(spark):
    rows = [(i, f"text {i % 700}", "", "", 0, "", "", "") for i in range(2000)]
    docs = spark.createDataFrame(rows, edge_docs(spark).schema)
    few, many = exact_duplicates(docs, most_buckets=2), exact_duplicates(docs, capacity=1)
    assert by_null((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in few.collect()) == by_null(brute(rows))
    assert not few.exceptAll(many).count()
