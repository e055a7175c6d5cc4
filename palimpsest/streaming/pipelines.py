"""Streams: capture by micro-batch, windowed event counts, session state.

Structured Streaming takes the place of queues and workers: a micro-batch is the
single writer, its checkpoint the log position, ``processAllAvailable`` the barrier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators import events as event_log
from palimpsest.operators.lifecycle import marked
from palimpsest.plans import capture
from palimpsest.sources import store
from palimpsest.storage import materialize


def capture_stream(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, least: float = 0.30) -> StreamingQuery:
    """Incoming memories (columns of MEMORIES) into the table at ``path``.

    Noise is dropped; requests to forget tombstone the living rows of their agent that are
    alike enough to the request, as the table stood before the batch; of rows with one id in a
    batch the newest by time wins, so an older one that arrives late does not replace it.  A
    batch that runs again after a failure writes the same rows under the same number, and the
    latest write wins.
    """

    def write(batch: DataFrame, number: int) -> None:
        routed = materialize(capture.intake(batch), "routed")
        kept = routed.where("route = 'store'").drop("route")
        newest = kept.groupBy("memory_id").agg(F.max_by(F.struct(*kept.columns), F.struct("created_at", "content")).alias("r")).select("r.*")
        requests = routed.where("route = 'forget' and embedding is not null").select(F.col("memory_id").alias("query_id"), "agent_id", "embedding")
        if number and not requests.isEmpty():
            before = current(batch.sparkSession, path, before=number).where("embedding is not null")
            gone = capture.forgotten(requests, before, least)
            struck = marked(before.join(gone, "memory_id", "left_semi"), gone, "Tombstone")
            newest = newest.join(gone, "memory_id", "left_anti").unionByName(struck.select(*newest.columns))
        store.append(materialize(newest, "batch"), path, number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The table with event-time order first: a late older write never wins.

    ``before``: as it stood before that batch.
    """
    rows = store.log(spark, path)
    rows = rows if before is None else rows.where(F.col("seq") < before)
    return store.latest(rows.withColumn("_order", F.struct("created_at", "seq")), order="_order").drop("_order", "seq")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, kind, n: tumbling counts with a watermark (an extension, not part of the model)."""
    timed = events.withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def session_gaps(turns: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """session windows of a user's events (an extension)."""
    timed = turns.withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


_STATE = "turns long, last_at long, active boolean"
_OUT = "session_id long, turns long, last_at long, active boolean"


def session_states(log: DataFrame, ttl_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Running state of sessions from (session_id, op, at in seconds).

    Counts turns and closes; a session is forgotten once the watermark has passed its
    last line by ``ttl_seconds``.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns, last, active = state.get if state.exists else (0, 0, True)
        for pdf in parts:
            turns += int((pdf["op"] == "turn").sum())
            last = max(last, int(pdf["at"].max()))
            active = active and not bool((pdf["op"] == "close").any())
        state.update((turns, last, active))
        state.setTimeoutTimestamp(max((last + ttl_seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": [key[0]], "turns": [turns], "last_at": [last], "active": [active]})

    timed = log.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    return timed.groupBy("session_id").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def every_batch(rows: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Runs ``act`` on each micro-batch: the timer of periodic cycles."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return rows.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ring_of(events: DataFrame, capacity: int = 2000) -> DataFrame:
    return event_log.ring(events, capacity)
