"""Records of service events: windows, pauses, costs, and what depends on the order of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def window_counts(events: DataFrame, seconds: int = 60, kinds: tuple[str, ...] = ("rate_limit", "error", "success"), *by: str) -> DataFrame:
    """events (ts, kind) with n_<kind> over the last so many seconds, both ends and equal times included.

    Without `by` all events are one stream, which is counted by blocks of time.
    """
    if not by:
        return window_counts_by_block(events, seconds, *kinds)
    w = Window.partitionBy(*by).orderBy(_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumns({f"n_{k}": F.count_if(F.col("kind") == k).over(w) for k in kinds})


def window_counts_by_block(events: DataFrame, seconds: int, *kinds: str) -> DataFrame:
    """events with n_<kind> over the last so many seconds, without a window over the whole table.

    Time is cut into blocks as long as the window. An event needs its own block and the one before, so each event of the kinds is sent
    to two blocks and blocks are computed apart: one stream of events isn't one task.
    """
    rows = events.withColumn("__at", _micros("ts")).withColumn("__block", F.expr(f"__at div {seconds * 1_000_000}"))
    own = rows.withColumn("__own", F.lit(True))
    before = rows.filter(F.col("kind").isin(*kinds)).withColumn("__block", F.col("__block") + 1).withColumn("__own", F.lit(False))
    w = Window.partitionBy("__block").orderBy("__at").rangeBetween(-seconds * 1_000_000, 0)
    counted = own.unionByName(before).withColumns({f"n_{k}": F.count_if(F.col("kind") == k).over(w) for k in kinds})
    return counted.filter("__own").drop("__at", "__block", "__own")


def replayed(rows: DataFrame, keys: tuple[str, ...], start: Callable[[], dict], step: Callable[[dict, dict], dict], schema: pa.Schema) -> DataFrame:
    """Rows of each key in order of seq, each turned into one by step(state, row), which changes the key's state.

    Rows pass through in batches and only the state of the key at hand is held, so a key's history may be of any length; it is
    one task's work, since each step needs the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (key := tuple(row[k] for k in keys)) != now:
                    now, state = key, start()
                out.append(step(state, row))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "seq")
    return ordered.mapInArrow(run, ", ".join(f"{f.name} {names[f.type]}" for f in schema))


def bursts(counted: DataFrame, kind: str = "rate_limit", least: int = 5) -> DataFrame:
    return counted.filter((F.col("kind") == kind) & (F.col(f"n_{kind}") >= least))


def cooldown(events: DataFrame, delay: Column, order: tuple[str, ...], *by: str) -> DataFrame:
    """events with resume_after: the latest end of a pause that any rate limit so far asked for (epoch seconds)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("resume_after", F.max(F.when(F.col("kind") == "rate_limit", _micros("ts") / 1e6 + delay)).over(w))


def state_changes(events: DataFrame, state: str, order: tuple[str, ...], *by: str) -> DataFrame:
    """Rows whose state differs from the one before, the first of each group included."""
    w = Window.partitionBy(*by).orderBy(*order)
    return events.withColumn("__was", F.lag(state).over(w)).filter(F.col("__was").isNull() | (F.col("__was") != F.col(state))).drop("__was")


def failover(requests: DataFrame, *, retry_primary_seconds: float = 300.0) -> DataFrame:
    """Replay of two key slots. requests: stream, seq, ts (seconds), primary, backup; these two say how a slot would answer: ok,
    unusable (the key cannot serve) or error (anything else).

    A request goes to the active slot, and to the other one if the key is unusable; then the service stays there. Once so many seconds
    have passed since the switch, one request tries primary first: ok restores it, anything else sends the request on and starts the time
    anew. Returns served (primary, backup, none), active, switched, probe, and alert: the kind of message when the state of the
    service changes (switched, restored, all_dead).
    """

    slots = ("primary", "backup")

    def step(now: dict, r: dict) -> dict:
        probe = now["active"] != 0 and r["ts"] - now["since"] >= retry_primary_seconds
        order = (0, 1) if probe or now["active"] == 0 else (1, 0)
        served, dead, switched = None, 0, False
        for slot in order:
            answer = r[slots[slot]]
            if answer == "ok":
                served = slot
                now["active"] = 0 if probe and slot == 0 else now["active"]
            elif answer == "unusable":
                dead += 1
                if slot == order[0]:
                    now["active"], now["since"], switched = order[1], r["ts"], True
                continue
            elif probe and slot == 0:
                now["since"] = r["ts"]
                continue
            break
        settled = served is not None and served == (now["active"] != 0)
        state = slots[served] if settled else "all_dead" if dead == 2 else None
        alert = {"primary": "restored", "backup": "switched", "all_dead": "all_dead"}[state] if state and state != now["alerted"] else None
        now["alerted"] = state or now["alerted"]
        return {"stream": r["stream"], "seq": r["seq"], "served": "none" if served is None else slots[served], "active": slots[now["active"] != 0], "switched": switched, "probe": probe, "alert": alert}

    out = pa.schema([("stream", pa.int64()), ("seq", pa.int64()), ("served", pa.string()), ("active", pa.string()), ("switched", pa.bool_()), ("probe", pa.bool_()), ("alert", pa.string())])
    return replayed(requests, ("stream",), lambda: {"active": 0, "since": 0.0, "alerted": "primary"}, step, out)


def throttled(messages: DataFrame, *, min_interval: float = 600.0) -> DataFrame:
    """messages (stream, kind, seq, ts) with sent, and merged: how many were held back since the last one sent of the kind."""

    def step(now: dict, r: dict) -> dict:
        sent = now["last"] is None or r["ts"] - now["last"] >= min_interval
        merged = now["held"] if sent else None
        now.update(last=r["ts"], held=0) if sent else now.update(held=now["held"] + 1)
        return {"stream": r["stream"], "kind": r["kind"], "seq": r["seq"], "sent": sent, "merged": merged}

    out = pa.schema([("stream", pa.int64()), ("kind", pa.string()), ("seq", pa.int64()), ("sent", pa.bool_()), ("merged", pa.int64())])
    return replayed(messages, ("stream", "kind"), lambda: {"last": None, "held": 0}, step, out)


def admitted(jobs: DataFrame, *, max_tasks: int = 8, max_bytes: int = 500 << 20) -> DataFrame:
    """jobs (queue, seq, action reserve or release, task, size) with the verdict of each reservation.

    A task that already holds a place keeps it; otherwise both limits must allow it.
    """

    def step(held: dict, r: dict) -> dict:
        fits = None
        if r["action"] == "release":
            held.pop(r["task"], None)
        else:
            fits = r["size"] >= 0 and (r["task"] in held or (len(held) < max_tasks and sum(held.values()) + r["size"] <= max_bytes))
            if fits:
                held.setdefault(r["task"], r["size"])
        return {"queue": r["queue"], "seq": r["seq"], "task": r["task"], "admitted": fits}

    out = pa.schema([("queue", pa.int64()), ("seq", pa.int64()), ("task", pa.int64()), ("admitted", pa.bool_())])
    return replayed(jobs, ("queue",), dict, step, out)


def enqueued(jobs: DataFrame, *keys: str) -> DataFrame:
    """The first job of each key; later ones are taken for repeats."""
    first = jobs.groupBy(*keys).agg(F.min("seq").alias("seq"))
    return jobs.join(first, [*keys, "seq"], "left_semi")


def byte_batches(segments: DataFrame, *, max_bytes: int = 12_000) -> DataFrame:
    """segments (doc_id, seg_id, source) with batch_no: in order, a new batch when the JSON object would exceed max_bytes.

    A segment that is too long by itself is a batch of its own. Sizes of a batch add up: braces, and for each member its key, its
    value and the separators.
    """

    def step(now: dict, r: dict) -> dict:
        grown = now["size"] + 2 + r["n_bytes"]
        if now["size"] and grown > max_bytes:
            now.update(batch=now["batch"] + 1, size=0)
            grown = 2 + r["n_bytes"]
        now["size"] = grown
        return {"doc_id": r["doc_id"], "seg_id": r["seq"], "batch_no": now["batch"]}

    def as_json(x: Column) -> Column:
        return F.octet_length(F.to_json(F.array(x))) - 2  # without the brackets

    sized = segments.select("doc_id", F.col("seg_id").alias("seq"), (as_json(F.col("seg_id")) + 2 + as_json(F.col("source"))).cast("long").alias("n_bytes"))
    out = pa.schema([("doc_id", pa.int64()), ("seg_id", pa.string()), ("batch_no", pa.int64())])
    return replayed(sized, ("doc_id",), lambda: {"batch": 0, "size": 0}, step, out)


def recovered(tasks: DataFrame) -> DataFrame:
    """Tasks found at a restart, and what to do with each: resume, fail or leave."""
    action = (
        F.when(F.col("status").isin("done", "failed", "deleted"), "leave")
        .when(~F.coalesce(F.col("has_source"), F.lit(False)), "fail")
        .when(F.col("type").isin("pdf", "epub"), "resume")
        .otherwise("fail")
    )
    return tasks.withColumn("action", action)

