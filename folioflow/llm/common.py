"""Helpers shared by the corpus operators: inputs, shared files and graph components."""

from __future__ import annotations

import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, one in the warehouse, which they share too."""
    found = spark.conf.get("spark.checkpoint.dir", "") or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_WRITTEN: list[str] = []


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def n_written() -> int:
    """How many tables written() has left so far."""
    return len(_WRITTEN)


def forget_written(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete what written() has left (from one number of tables to another), once no result that reads it is needed any more."""
    jvm = spark.sparkContext._jvm
    until = len(_WRITTEN) if until is None else until
    for name in _WRITTEN[since:until]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _WRITTEN[since:until]


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder; Spark deletes the files once nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts are long: Arrow batches of the session hold at most so many rows, which bounds the memory of both sides. The setting
    is read when a plan runs, not when it is made, so it stays with the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def row_ids():
    """Ids of the rows of this task, the same in every attempt."""
    base = TaskContext.get().partitionId() << 36
    while True:
        yield base
        base += 1


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row: a lambda binds it."""
    return F.transform(F.array(value), body)[0]


def held_out_mod(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32(doc_id as text) mod `mod` is `rest`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def hashed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows with the least hash of the key. Most others fall away where they are, before the sort."""
    total = df.count()
    h = F.xxhash64(key, F.lit(seed))
    if total > 4 * n:
        df = df.filter(F.pmod(h, F.lit(1 << 30)) < int(2 * n / total * (1 << 30)))
    return df.orderBy(F.pmod(h, F.lit(1 << 30)), key).limit(n)


def without(docs: DataFrame, dropped: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """docs but for those whose doc_id is in dropped (null is an id like others). Few ids are broadcast, more are shuffled."""
    ids = checkpointed(dropped.select(F.col("doc_id").cast("long").alias("__dropped")).distinct())
    if ids.count() <= most_broadcast:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("__dropped")), "left_anti")


def _with_minimum(links: DataFrame, at_most: int, many: int) -> tuple[DataFrame, DataFrame]:
    """(links (u, v) with m, the least v of each u; the minima (u, m)). There are `at_most` links.

    Minima are aggregated before the shuffle. Those of nodes with more than `many` links go to all tasks, so that the links of such
    a node stay where they are; only links of other nodes are shuffled to meet their minimum.
    """
    low = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if at_most <= many:
        return links.join(low.select("u", "m"), "u"), low.select("u", "m")
    hubs = F.broadcast(low.filter(F.col("n") > many).select("u", F.col("m").alias("__hub")))
    told = links.join(hubs, "u", "left")
    rest = told.filter("__hub is null").select("u", "v").join(low.filter(F.col("n") <= many).select("u", "m"), "u").select("u", "v", "m")
    return told.filter("__hub is not null").select("u", "v", F.col("__hub").alias("m")).union(rest), low.select("u", "m")


def connected_components(edges: DataFrame, *, least_hub: int = 100_000, most_hubs: int = 100_000) -> DataFrame:
    """Smallest reachable id for each node of the edges (u, v): (node, component).

    Alternating large-star and small-star contraction until nothing changes, which takes about log2 of the longest path. Each round is
    checkpointed in the shared folder. A hub has over `least_hub` links, and so many that there are at most `most_hubs` of them; their
    minima are broadcast.
    """
    now = checkpointed(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark, before = (now.count(),), None
    while mark != before:
        many = max(least_hub, 2 * mark[0] // most_hubs)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, _ = _with_minimum(both, 2 * mark[0], many)
        large = joined.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        joined, low = _with_minimum(large, 2 * mark[0], many)
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = checkpointed(small.distinct())
        before, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
