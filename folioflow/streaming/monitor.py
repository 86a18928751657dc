"""Service events as streams: windows with late data, and state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp, stream long, kind string"


def events(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(EVENT).parquet(path)


def _bounded(stream: DataFrame, late: str | None) -> DataFrame:
    return stream if late is None else stream.withWatermark("ts", late)


def window_totals(stream: DataFrame, seconds: int = 60, slide: int | None = None, late: str | None = "10 minutes") -> DataFrame:
    """(start, end, stream, n_<kind>) of windows of event time; an event later than `late` is dropped (None: the stream has its bound)."""
    span = F.window("ts", f"{seconds} seconds", f"{slide or seconds} seconds")
    kinds = ("success", "error", "rate_limit")
    totals = _bounded(stream, late).groupBy(span.alias("w"), "stream").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))
    return totals.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "stream", *(f"n_{k}" for k in kinds))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """(start, end, stream, n) of runs of events without a gap."""
    totals = _bounded(stream, late).groupBy(F.session_window("ts", gap).alias("w"), "stream").agg(F.count("*").alias("n"))
    return totals.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "stream", "n")


def deduplicated(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events once each, as long as the repeat isn't later than `late`."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _until(state: GroupState, rows: pd.DataFrame, seconds: float) -> int:
    """Milliseconds of event time so long after the rows."""
    return max(state.getCurrentWatermarkMs(), int(1000 * rows["ts"].max().timestamp())) + int(1000 * seconds) + 1


def cooldowns(stream: DataFrame, delay: float = 12.0, late: str | None = "10 minutes") -> DataFrame:
    """For each batch and stream the end of the latest pause that rate limits asked for: (stream, resume_after). State goes once the
    pause is over in event time; an event later than `late` is dropped (None: the stream has its bound)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        end = state.get[0] if state.exists else 0.0
        seen = []
        for rows in frames:
            seen.append(rows)
            limited = rows.loc[rows["kind"] == "rate_limit", "ts"]
            if len(limited):
                end = max(end, limited.max().timestamp() + delay)
        state.update((end,))
        state.setTimeoutTimestamp(_until(state, pd.concat(seen), delay))
        yield pd.DataFrame({"stream": [key[0]], "resume_after": [end]})

    return _bounded(stream, late).groupBy("stream").applyInPandasWithState(run, "stream long, resume_after double", "resume_after double", "update", GroupStateTimeout.EventTimeTimeout)


def throttled(stream: DataFrame, min_interval: float = 600.0, late: str | None = None) -> DataFrame:
    """Messages that go out: at most one of a stream's kind in an interval, with how many it stands for: (stream, kind, event_id, ts,
    merged). The state of a silent key goes after the interval unless messages are held back in it. `late` as in cooldowns."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            if not state.get[1]:
                state.remove()
            return
        last, held = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples():
            at = r.ts.timestamp()
            if last is None or at - last >= min_interval:
                out.append((*key, r.event_id, r.ts, held))
                last, held = at, 0
            else:
                held += 1
        state.update((last, held))
        state.setTimeoutTimestamp(_until(state, rows, min_interval))
        yield pd.DataFrame(out, columns=["stream", "kind", "event_id", "ts", "merged"]).astype({"stream": "int64", "event_id": "int64", "merged": "int64", "ts": "datetime64[ns]"})

    schema = "stream long, kind string, event_id long, ts timestamp, merged long"
    return _bounded(stream, late).groupBy("stream", "kind").applyInPandasWithState(run, schema, "last double, held long", "append", GroupStateTimeout.EventTimeTimeout)
