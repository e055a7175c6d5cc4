"""The typed memory graph as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import preview
from palimpsest.operators.filters import is_alive
from palimpsest.schema import UNDIRECTED
from palimpsest.storage import materialize


def upserted(stream: DataFrame) -> DataFrame:
    """Edges after all upserts: undirected types are mirrored, the last write of a key wins.

    ``stream``: from_id, to_id, type, weight, created_at and seq, the write order.
    """
    back = stream.where(F.col("type").isin(*UNDIRECTED)).select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "type", "weight", "created_at", "seq")
    both = stream.select(*back.columns).union(back)
    last = F.max_by(F.struct("weight", "created_at"), F.struct("seq", "weight", "created_at"))
    return both.groupBy("from_id", "to_id", "type").agg(last.alias("v")).select("from_id", "to_id", "type", "v.weight", "v.created_at")


def outgoing(edges: DataFrame, memory_id: int, type_: str | None = None) -> DataFrame:
    rows = edges.where(F.col("from_id") == memory_id)
    return rows.where(F.col("type") == type_) if type_ else rows


def incoming(edges: DataFrame, memory_id: int) -> DataFrame:
    """In-edges; a source with n edges to the node is met n times, each time with all n."""
    rows = edges.where(F.col("to_id") == memory_id)
    times = rows.groupBy("from_id").agg(F.count("*").cast("int").alias("times"))
    return rows.join(times, "from_id").withColumn("_", F.explode(F.sequence(F.lit(1), "times"))).select(*edges.columns)


def of_types(edges: DataFrame, *types: str) -> DataFrame:
    return edges.where(F.col("type").isin(*types))


def conflicts(edges: DataFrame) -> DataFrame:
    return of_types(edges, "Contradicts", "ConflictsWith")


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of ``nodes`` (memory_id)."""
    ids = nodes.select("memory_id")
    return edges.join(ids.withColumnRenamed("memory_id", "from_id"), "from_id", "left_anti").join(ids.withColumnRenamed("memory_id", "to_id"), "to_id", "left_anti").select(*edges.columns)


def counts(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"), F.countDistinct("from_id").alias("nodes"))


def traverse(edges: DataFrame, start: DataFrame, depth: int, *types: str) -> DataFrame:
    """start_id, node_id, depth: nodes within ``depth`` steps of each start, itself at 0.

    A frontier join for each step; nodes already reached are left out by an
    anti-join, so the work follows the edges met, not the paths.
    """
    steps = (of_types(edges, *types) if types else edges).select("from_id", "to_id").distinct()
    reached = start.select(F.col("memory_id").alias("start_id"), F.col("memory_id").alias("node_id"), F.lit(0).alias("depth")).distinct()
    frontier = reached
    for k in range(1, depth + 1):
        found = frontier.join(steps, F.col("node_id") == F.col("from_id")).select("start_id", F.col("to_id").alias("node_id")).distinct()
        frontier = materialize(found.join(reached, ["start_id", "node_id"], "left_anti").withColumn("depth", F.lit(k)), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def live_edges(edges: DataFrame, memories: DataFrame, user_id: str = "") -> DataFrame:
    """Edges with both ends alive; with a user, those that touch one of the user's rows."""
    alive = memories.where(is_alive()).select("memory_id", (F.col("user_id") == user_id).alias("mine"))
    a = alive.withColumnsRenamed({"memory_id": "from_id", "mine": "a"})
    b = alive.withColumnsRenamed({"memory_id": "to_id", "mine": "b"})
    rows = edges.join(a, "from_id").join(b, "to_id")
    return (rows.where("a or b") if user_id else rows).select(*edges.columns)


def neighbours(edges: DataFrame, memories: DataFrame, memory_id: int, both_ways: bool = False, preview_bytes: int = 90) -> DataFrame:
    """Edges of a node with the other end's phase, confidence and preview; ``Missing`` if gone."""
    rows = outgoing(edges, memory_id)
    if both_ways:
        rows = rows.unionByName(incoming(edges, memory_id))
    other = F.when(F.col("from_id") == memory_id, F.col("to_id")).otherwise(F.col("from_id"))
    peers = memories.select(F.col("memory_id").alias("other_id"), F.col("phase").alias("other_phase"), F.col("confidence_level").alias("other_confidence"), preview(F.col("content"), preview_bytes).alias("other_preview"))
    joined = rows.withColumn("other_id", other).join(peers, "other_id", "left")
    return joined.select(
        "from_id", "to_id", "type", "weight",
        F.coalesce("other_phase", F.lit("Missing")).alias("other_phase"),
        F.coalesce("other_confidence", F.lit("")).alias("other_confidence"),
        F.coalesce("other_preview", F.lit("")).alias("other_preview"),
    )


def similarity_edges(ranked: DataFrame, most: int = 10, conflict: float = 0.85, related: float = 0.5) -> DataFrame:
    """Edges from ranked same-agent neighbours; the node itself counts among the ``most``.

    ``ranked``: query_id, memory_id, similarity, rank.
    """
    kind = F.when(F.col("similarity") >= conflict, "ConflictsWith").when(F.col("similarity") >= related, "Related")
    rows = ranked.where((F.col("rank") <= most) & (F.col("query_id") != F.col("memory_id"))).withColumn("type", kind)
    return rows.where("type is not null").select(F.col("query_id").alias("from_id"), F.col("memory_id").alias("to_id"), "type", F.col("similarity").alias("weight"))


def supersession(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """memory_id, superseded_at: rows replaced by a later fact, with the time of the last one alive.

    Up from each superseder to the farthest one alive, then down over everything it
    replaced in turn, however long the chains; a cycle ends where it meets itself.
    Where several chains reach a row, the latest time counts.
    """
    over = of_types(edges, "Supersedes").select("from_id", "to_id").distinct()
    alive = memories.where(is_alive()).select(F.col("memory_id").alias("node"), "created_at")
    # each superseder and what stands above it, with the distance
    up = over.select(F.col("from_id").alias("origin"), F.col("from_id").alias("node"), F.lit(0).alias("depth")).distinct()
    level, k = up, 0
    while True:
        k += 1
        level = materialize(
            level.join(over, F.col("node") == F.col("to_id")).select("origin", F.col("from_id").alias("node"), F.lit(k).alias("depth")).distinct().join(up, ["origin", "node"], "left_anti"),
            "level",
        )
        if level.isEmpty():
            break
        up = materialize(up.unionByName(level), "up")
    top = up.join(alive, "node").groupBy("origin").agg(F.max_by("created_at", F.struct("depth", "node")).alias("superseded_at"))
    down = over.join(top, F.col("from_id") == F.col("origin")).select(F.col("to_id").alias("memory_id"), "superseded_at")
    reached = down.groupBy("memory_id").agg(F.max("superseded_at").alias("superseded_at"))
    while True:
        grown = reached.unionByName(
            reached.join(over, F.col("memory_id") == F.col("from_id")).select(F.col("to_id").alias("memory_id"), "superseded_at")
        ).groupBy("memory_id").agg(F.max("superseded_at").alias("superseded_at"))
        grown = materialize(grown, "reached")
        changed = not grown.exceptAll(reached).isEmpty()
        reached = grown
        if not changed:
            break
    return reached
