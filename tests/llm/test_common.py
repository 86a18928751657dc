from pathlib import Path

from folioflow.llm.common import checkpointed, connected_components, forget_written, hashed_sample, shared_dir, without, written


def test_written_tables_go_when_forgotten(spark):
    df = written(spark.range(5), "x")
    folder = Path(df.inputFiles()[0].removeprefix("file:").lstrip("/").join(["/", ""])).parent
    assert df.count() == 5 and folder.is_dir() and str(folder).startswith(shared_dir(spark).removeprefix("file:"))
    forget_written(spark)
    assert not folder.exists()


def test_sample(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    few = {r.k for r in hashed_sample(df, "k", 100, 1).collect()}
    assert len(few) == 100 and few == {r.k for r in hashed_sample(df.repartition(7), "k", 100, 1).collect()}
    assert hashed_sample(df, "k", 9000, 1).count() == 5000


def test_without(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d")], "doc_id long, text string")
    for most in (0, 10):
        gone = spark.createDataFrame([(1,), (None,), (7,)], "doc_id long")
        assert [r.doc_id for r in without(docs, gone, most).collect()] == [2]
        assert without(docs, gone.limit(0), most).count() == 4


def test_checkpoint_is_in_the_shared_folder(spark):
    assert checkpointed(spark.range(3)).count() == 3


def test_components_with_a_hub(spark):
    """Nine links in ten are those of one node."""
    edges = [(1000 + i, 7) for i in range(900)] + [(i, i + 1) for i in range(100, 160)] + [(300, 301), (301, 1000), (5, 5)]
    want = {n: 7 for n in [7, 300, 301, *range(1000, 1900)]} | {n: 100 for n in range(100, 161)}
    del want[7], want[100]
    for least_hub in (10, 100_000):
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), least_hub=least_hub, most_hubs=300).collect()}
        assert {n: c for n, c in got.items() if n != c} == want
