import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline as pipeline
from folioflow.llm.common import table
from folioflow.llm.mixing import mixed
from folioflow.llm.queries import MIXTURE
from folioflow.llm.toxicity import toxicity

from .edge import edge_docs, edge_rows, words
from .test_simhash import brute_components, brute_print


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder, rng = str(tmp_path_factory.mktemp("corpus")), random.Random(12)
    rows, labels = [r for r in edge_rows() if r[0] is None or r[0] >= 0], []
    for i in range(1000, 1800):
        text, toxic = words(rng, rng.randint(40, 120)), rng.random() < 0.2
        if toxic:
            text += " vilexy grumpo"
        rows.append((i, text, "en", "s", len(text), "", "", ""))
        labels.append((i, 1, int(toxic)))
    for i, j in enumerate(rng.sample(range(40, len(rows)), 60)):  # copies, some with other white space
        text = rows[j][1]
        rows.append((3000 + i, text.replace(" ", "\n") if i % 2 else text, *rows[j][2:]))
        labels.append((3000 + i, 1, int("vilexy" in text)))
    long = words(rng, 3000)
    rows += [(4000 + i, long + f" tail{i}", "en", "s", 0, "", "", "") for i in range(5)]
    spark.createDataFrame(rows, edge_docs(spark).schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def steps(spark, corpus):
    out = [table(spark, corpus, "documents")]
    for name, stage in pipeline.STAGES:
        out.append(pipeline.written(stage(spark, out[-1], corpus), name))
    return out


def ids(df):
    return sorted((r.doc_id is None, r.doc_id) for r in df.select("doc_id").collect())


def test_columns(steps):
    assert all(df.schema == steps[0].schema for df in steps[1:-1])


def test_toxic_documents_go(spark, corpus, steps):
    scores = toxicity(steps[0], table(spark, corpus, "labels"))
    assert ids(steps[1]) == ids(scores.filter("score < 0.3"))
    texts = [r.text or "" for r in steps[1].collect()]
    assert sum("vilexy" in t for t in texts) <= 2 and len(texts) > 0.75 * steps[0].count()


def test_one_of_equal_texts_stays(steps):
    groups = defaultdict(list)
    for r in steps[1].collect():
        groups[re.sub("[\x20\x09-\x0d]", "", r.text or "")].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    assert ids(steps[2]) == sorted(min(g)[1:] for g in groups.values())


def test_one_of_near_copies_stays(steps):
    rows = [(r.doc_id, brute_print(r.text)) for r in steps[2].collect()]
    want = [d for (d, _), c in zip(rows, brute_components(rows), strict=True) if c is None or d == c]
    assert ids(steps[3]) == sorted((d is None, d) for d in want)


def test_mixture(spark, corpus, steps):
    rates = mixed(steps[3], table(spark, corpus, "labels"), MIXTURE, most_rate=1.0)
    assert ids(steps[4]) == ids(rates.filter("copies > 0 or doc_id is null"))
    assert steps[4].count() > 0.85 * steps[3].count()


def test_all_that_is_left_is_packed(steps):
    got, want = steps[5].collect(), {r.doc_id for r in steps[4].collect()}
    assert {r.doc_id for r in got} == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(bins) <= 1.02 * -(-sum(r.length for r in got) // 1024) + 1


def test_run_is_the_stages(spark, corpus, steps):
    key = lambda df: sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(pipeline.run(spark, corpus)) == key(steps[5])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], edge_docs(spark).schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
