"""The event log: filters, counts and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Event kinds and statuses; unknown names read as Error and Ok.
KINDS = (
    "Store", "Embed", "Gate", "Derive", "Reconcile", "LineagePropagate", "GraphEdge", "VersionUpdate",
    "Recall", "RecallSemantic", "RecallFilter", "RecallStale",
    "GcDecay", "GcArchive", "GcTombstone", "GcVacuum", "Consolidate", "Resurrect",
    "ProviderCall", "Error",
)
STATUSES = ("Ok", "Rejected", "Deferred", "Failed", "NoOp")



def query(events: DataFrame, memory_id: int = 0, trace_id: int = 0, kind: str = "", status: str = "", agent: str = "", since: int = 0, until: int = 0, limit: int | None = None) -> DataFrame:
    """Events that pass every given filter, newest first; bounds are inclusive, agents by prefix."""
    rows = events
    for name, value in (("memory_id", memory_id), ("trace_id", trace_id), ("kind", kind), ("status", status)):
        if value:
            rows = rows.where(F.col(name) == value)
    if agent:
        rows = rows.where(F.col("agent_id").startswith(agent))
    if since:
        rows = rows.where(F.col("timestamp_ms") >= since)
    if until:
        rows = rows.where(F.col("timestamp_ms") <= until)
    rows = rows.orderBy(F.desc("timestamp_ms"), F.desc("event_id"))
    return rows if limit is None else rows.limit(limit)


def stats(events: DataFrame) -> DataFrame:
    """facet (kind, status or total), value, n in one pass."""
    grouped = events.groupingSets([[F.col("kind")], [F.col("status")], []], "kind", "status")
    counted = grouped.agg(F.count("*").alias("n"), F.grouping("kind").alias("gk"), F.grouping("status").alias("gs"))
    facet = F.when((F.col("gk") == 0), "kind").when(F.col("gs") == 0, "status").otherwise("total")
    value = F.when(F.col("gk") == 0, F.col("kind")).when(F.col("gs") == 0, F.col("status")).otherwise("")
    return counted.select(facet.alias("facet"), value.alias("value"), "n")


def traces(events: DataFrame, memory_id: int | None = None) -> DataFrame:
    """trace_id, n, first_ms, last_ms, event_ids in order of time."""
    rows = events if memory_id is None else events.where(F.col("memory_id") == memory_id)
    ordered = F.array_sort(F.collect_list(F.struct("timestamp_ms", "event_id")))
    return rows.groupBy("trace_id").agg(
        F.count("*").alias("n"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"),
        F.array_join(F.transform(ordered, lambda e: e.event_id.cast("string")), ",").alias("event_ids"),
    )


def trace(events: DataFrame, trace_id: int) -> DataFrame:
    return events.where(F.col("trace_id") == trace_id).orderBy("timestamp_ms", "event_id")


def history(events: DataFrame, memory_id: int, limit: int = 100) -> DataFrame:
    return query(events, memory_id=memory_id, limit=limit)


def ring(events: DataFrame, capacity: int = 2000) -> DataFrame:
    """The newest ``capacity`` events, which is what a bounded log keeps."""
    return events.orderBy(F.desc("timestamp_ms"), F.desc("event_id")).limit(capacity)


def resurrectable(events: DataFrame) -> DataFrame:
    """Gate events whose memory was turned away or put off."""
    return events.where((F.col("kind") == "Gate") & F.col("status").isin("Rejected", "Deferred"))
