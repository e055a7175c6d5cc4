"""Lineage: which rows were derived from which, and what a removal takes along.

Tables: ``links`` (child_id, parent_id), one row for each parent of a child.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.storage import materialize


def exploded(lineage: DataFrame) -> DataFrame:
    """(child_id, parent_ids, ...) to one row for each parent."""
    return lineage.select("child_id", F.explode("parent_ids").alias("parent_id")).distinct()


def parents(links: DataFrame, child_id: int) -> DataFrame:
    return links.where(F.col("child_id") == child_id).select("parent_id").distinct()


def children(links: DataFrame, parent_id: int) -> DataFrame:
    return links.where(F.col("parent_id") == parent_id).select("child_id").distinct()


def stats(links: DataFrame) -> DataFrame:
    return links.agg(F.countDistinct("child_id").alias("children"), F.countDistinct("parent_id").alias("parents"))


def descendants(links: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """root_id, memory_id, depth: what derives from each root within ``depth`` steps."""
    reached = None
    frontier = roots.select(F.col("memory_id").alias("root_id"), "memory_id").distinct()
    for k in range(1, depth + 1):
        found = frontier.join(links, F.col("memory_id") == F.col("parent_id")).select("root_id", F.col("child_id").alias("memory_id")).distinct()
        if reached is not None:
            found = found.join(reached, ["root_id", "memory_id"], "left_anti")
        found = found.where("root_id <> memory_id")
        frontier = materialize(found, "descendants")
        step = frontier.withColumn("depth", F.lit(k))
        reached = step if reached is None else reached.unionByName(step)
        if frontier.isEmpty():
            break
        frontier = frontier.select("root_id", "memory_id")
    return reached


def live_parents(links: DataFrame, removed: DataFrame) -> DataFrame:
    """child_id and whether any of its parents is not in ``removed`` (memory_id)."""
    gone = removed.select(F.col("memory_id").alias("parent_id")).distinct().withColumn("gone", F.lit(True))
    return links.join(gone, "parent_id", "left").groupBy("child_id").agg(F.bool_or(F.col("gone").isNull()).alias("has_live_parent"))


def cascade(links: DataFrame, removed: DataFrame, depth: int = 5) -> DataFrame:
    """memory_id, depth, invalidated: rows that removals reach, level by level.

    A child is invalidated if all its parents are gone by its level; only then are
    its own children looked at, and each row is looked at once: a child with a
    parent that falls later than the level at which it was met stays.
    """
    gone = removed.select("memory_id").distinct()
    frontier, checked = gone, None
    for k in range(1, depth + 1):
        met = frontier.join(links, F.col("memory_id") == F.col("parent_id")).select(F.col("child_id").alias("memory_id")).distinct().join(gone, "memory_id", "left_anti")
        if checked is not None:
            met = met.join(checked, "memory_id", "left_anti")
        theirs = links.join(met.withColumnRenamed("memory_id", "child_id"), "child_id", "left_semi")
        judged = live_parents(theirs, gone).select(F.col("child_id").alias("memory_id"), F.lit(k).alias("depth"), (~F.col("has_live_parent")).alias("invalidated"))
        judged = materialize(judged, "cascade")
        if judged.isEmpty():
            break
        checked = judged if checked is None else checked.unionByName(judged)
        frontier = judged.where("invalidated").select("memory_id")
        gone = gone.unionByName(frontier)
    if checked is None:
        return links.limit(0).select(F.col("child_id").alias("memory_id"), F.lit(0).alias("depth"), F.lit(False).alias("invalidated"))
    return checked


def remove(memories: DataFrame, links: DataFrame, removed: DataFrame, depth: int = 5) -> DataFrame:
    """Memories after a coordinated removal, with what became of each row.

    ``outcome``: removed, invalidated, recomputed (met, but with a live parent) or kept.
    """
    hit = cascade(links, removed, depth).select("memory_id", F.when(F.col("invalidated"), "invalidated").otherwise("recomputed").alias("outcome"))
    marked = removed.select("memory_id").distinct().withColumn("outcome", F.lit("removed")).unionByName(hit)
    rows = memories.join(marked, "memory_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("kept")))
    phase = F.when(F.col("outcome") == "removed", "Tombstone").when(F.col("outcome") == "invalidated", "Invalidated").otherwise(F.col("phase"))
    return rows.withColumn("phase", phase)


def history(memories: DataFrame, starts: DataFrame, most: int = 10) -> DataFrame:
    """start_id, memory_id, step: each row's chain of earlier versions, ``most`` steps back."""
    up = memories.select("memory_id", "parent_id")
    chain = starts.select(F.col("memory_id").alias("start_id"), "memory_id").join(up, "memory_id").select("start_id", "memory_id", "parent_id", F.lit(0).alias("step"))
    level = chain
    for k in range(1, most):
        ahead = up.select(F.col("memory_id").alias("next_id"), F.col("parent_id").alias("next_parent"))
        level = level.where("parent_id <> 0").join(ahead, F.col("parent_id") == F.col("next_id")).select("start_id", F.col("next_id").alias("memory_id"), F.col("next_parent").alias("parent_id"), F.lit(k).alias("step"))
        level = materialize(level, "history")
        if level.isEmpty():
            break
        chain = chain.unionByName(level)
    return chain.select("start_id", "memory_id", "step")
