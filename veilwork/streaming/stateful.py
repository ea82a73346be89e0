"""Structured Streaming forms of the stateful operators.

Event time and watermarks are our choice: the service they stand for uses its
own clock. Sinks are written at least once and are idempotent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "2 minutes"


def rate_counts(events: DataFrame, key: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """Requests of each key and window, and how many of them the limit rejects."""
    window = F.window(ts, f"{seconds} seconds")
    counted = events.withWatermark(ts, LATE).groupBy(window, key).agg(F.count("*").alias("requests"))
    return counted.select(
        key, F.col("window.start").alias("window_start"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected")
    )


def idempotent(requests: DataFrame, ts: str) -> DataFrame:
    """The first request of each key within the watermark."""
    return requests.withWatermark(ts, LATE).dropDuplicatesWithinWatermark(["key"])


MOVES = {
    "submit": (("none",), "queued"),
    "claim": (("queued",), "running"),
    "cancel": (("queued",), "cancelled"),
    "done": (("queued", "running"), "done"),
    "failed": (("queued", "running"), "failed"),
}


def job_lives(events: DataFrame, lease_ms: int = 300_000) -> DataFrame:
    """States of jobs from a stream (job_id, seq, event, ts); one that is live when its lease runs out has failed.

    Leases run by event time: with a clock as timeout the stream would never come to rest.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, last = state.get if state.exists else ("none", -1)
        if state.hasTimedOut:
            state.remove()
            if status in ("queued", "running"):
                yield pd.DataFrame({"job_id": [key[0]], "status": ["failed"], "seq": [last]})
            return
        rows = pd.concat(list(frames)).sort_values("seq")
        for seq, event in zip(rows["seq"], rows["event"]):
            allowed, to = MOVES.get(event, ((), ""))
            if seq > last and status in allowed:
                status, last = to, int(seq)
        state.update((status, last))
        if status in ("queued", "running"):
            last_ms = int(rows["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs()) + lease_ms)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "seq": [last]})

    shape = "job_id string, status string, seq long"
    return events.withWatermark("ts", LATE).groupBy("job_id").applyInPandasWithState(
        run, shape, "status string, seq long", "update", GroupStateTimeout.EventTimeTimeout
    )


def live_workers(beats: DataFrame, ts: str, seconds: int = 15) -> DataFrame:
    """Stretches in which each worker was alive: beats at most so many seconds apart."""
    session = F.session_window(ts, f"{seconds} seconds")
    alive = beats.withWatermark(ts, LATE).groupBy(session, "worker").agg(F.count("*").alias("beats"))
    return alive.select("worker", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "beats")


def redact_and_audit(stream: DataFrame, out: str, audit: str, checkpoint: str):
    """Redact a stream of documents (doc_id, text): of each batch the audit rows are written before its results.

    Both go to a folder named by the batch and replace what a failed try has left, so a repeated batch writes the same.
    """
    from veilwork.operators.detection import exploded
    from veilwork.operators.evaluation import span_summary
    from veilwork.operators.redaction import plain

    def batch(df: DataFrame, number: int) -> None:
        done = plain(df.select("doc_id", "text"))
        spans = exploded(done, "doc_id", "text", F.col("spans"))
        span_summary(spans).write.mode("overwrite").parquet(f"{audit}/batch={number}")
        done.select("doc_id", "redacted").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
