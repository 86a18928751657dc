from datetime import datetime, timedelta

import pytest

from folioflow.streaming import monitor as M

START = datetime(2024, 1, 1)


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, START + timedelta(seconds=s), 1, k) for i, (s, k) in enumerate([(0, "success"), (10, "rate_limit"), (59, "error"), (60, "success"), (700, "rate_limit"), (710, "rate_limit"), (4000, "success")])]
    spark.createDataFrame(rows, M.EVENT).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame(rows[:2], M.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # repeats
    return f"file://{tmp_path}/in"


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_windows(spark, folder, tmp_path):
    got = run(M.window_totals(M.deduplicated(M.events(spark, folder)), 60, late=None), "totals", "append", tmp_path)
    assert {(r.start - START).seconds: (r.n_success, r.n_error, r.n_rate_limit) for r in got} == {0: (1, 1, 1), 60: (1, 0, 0), 660: (0, 0, 2)}


def test_sessions(spark, folder, tmp_path):
    got = run(M.sessions(M.deduplicated(M.events(spark, folder)), "5 minutes", late=None), "sessions", "append", tmp_path)
    assert {(r.start - START).seconds: r.n for r in got} == {0: 4, 700: 2}


def test_state(spark, folder, tmp_path):
    got = run(M.cooldowns(M.events(spark, folder)), "cooldowns", "update", tmp_path)
    assert max(r.resume_after for r in got) == pytest.approx((START - datetime(1970, 1, 1)).total_seconds() + 722)
    sent = run(M.throttled(M.deduplicated(M.events(spark, folder))), "sent", "append", tmp_path)
    assert sorted((r.kind, (r.ts - START).seconds, r.merged) for r in sent) == [("error", 59, 0), ("rate_limit", 10, 0), ("rate_limit", 700, 0), ("success", 0, 0), ("success", 4000, 1)]
