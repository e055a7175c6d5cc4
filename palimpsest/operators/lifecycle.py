"""What happens to memories over time, as rewrites of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import scores
from palimpsest.operators.filters import is_alive, sampled
from palimpsest.schema import ALIVE, ARCHIVED, HAS_EMBEDDING, TOMBSTONE, VERSIONED


def marked(rows: DataFrame, ids: DataFrame, phase: str) -> DataFrame:
    """Rows with the ids given (memory_id) moved to ``phase``, with its flag."""
    flag = {"Tombstone": TOMBSTONE, "Versioned": VERSIONED, "Archived": ARCHIVED}.get(phase, 0)
    hit = ids.select("memory_id").distinct().withColumn("_hit", F.lit(True))
    out = rows.join(hit, "memory_id", "left")
    if "flags" in rows.columns:
        cleared = F.col("flags").bitwiseOR(flag) if phase != "Tombstone" else F.col("flags").bitwiseAND(~ALIVE & 0xFFFF).bitwiseOR(flag)
        out = out.withColumn("flags", F.when(F.col("_hit"), cleared).otherwise(F.col("flags")).cast("int"))
    return out.withColumn("phase", F.when(F.col("_hit"), phase).otherwise(F.col("phase"))).select(*rows.columns)


def new_versions(memories: DataFrame, updates: DataFrame, now: int) -> DataFrame:
    """All rows after updates (memory_id, new_id, content): the old one versioned, a new one active."""
    old = marked(memories, updates, "Versioned")
    made = memories.join(updates.select("memory_id", "new_id", F.col("content").alias("_content")), "memory_id")
    changes = {
        "parent_id": F.col("memory_id"), "memory_id": F.col("new_id"), "content": F.col("_content"), "phase": F.lit("Active"),
        "mem_version": F.col("mem_version") + 1, "flags": F.lit(ALIVE), "access_count": F.lit(0).cast("long"),
        "created_at": F.lit(now).cast("long"), "last_accessed": F.lit(now).cast("long"),
    }
    made = made.select(*(changes[c].alias(c) if c in changes else F.col(c) for c in memories.columns))
    return old.unionByName(made)


def boosted(memories: DataFrame, boosts: DataFrame) -> DataFrame:
    """Importance of living rows moved by (memory_id, delta), within 0..1."""
    total = boosts.groupBy("memory_id").agg(F.sum("delta").alias("_delta"))
    rows = memories.join(total, "memory_id", "left")
    moved = scores.clamp(F.col("importance") + F.col("_delta"))
    return rows.withColumn("importance", F.when(F.col("_delta").isNotNull() & is_alive(), moved).otherwise(F.col("importance"))).select(*memories.columns)


def with_embeddings(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    rows = memories.join(vectors.select("memory_id", F.col("embedding").alias("_v")), "memory_id", "left")
    flags = F.when(F.col("_v").isNotNull(), F.col("flags").bitwiseOR(HAS_EMBEDDING)).otherwise(F.col("flags")).cast("int")
    return rows.withColumn("flags", flags).withColumn("embedding", F.coalesce("_v", "embedding")).select(*memories.columns)


def touched(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """Memories after a log of reads (memory_id, at): counted, dated and promoted.

    Reads are added up before the join.  A read can promote by one step, so two
    reads or more can promote twice; the second step uses the final count.
    """
    seen = accesses.groupBy("memory_id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    rows = memories.join(seen, "memory_id", "left")
    n = F.coalesce("_n", F.lit(0))
    count = F.col("access_count") + n
    importance, tier = F.col("importance"), F.col("tier")
    once = scores.promoted(tier, count, importance)
    twice = scores.promoted(once, count, importance)
    climbed = F.when(n == 0, tier).when(n == 1, once).otherwise(twice)
    changes = {"access_count": count, "last_accessed": F.greatest("last_accessed", F.coalesce("_at", "last_accessed")), "tier": climbed}
    return rows.select(*(changes[c].alias(c) if c in changes else F.col(c) for c in memories.columns))


def decayed(memories: DataFrame, now: int, rate: float = 0.01, exponential: bool = False, stale_after: bool = True, demote: bool = True) -> DataFrame:
    """Active rows lose importance with disuse, grow stale and sink a tier."""
    active = F.col("phase") == "Active"
    importance = scores.decayed(now, rate, exponential)
    old = scores.hours_since(F.col("last_accessed"), now) > scores.by_tier(F.col("tier"), scores.STALE_HOURS)
    stale = active & old & (F.col("confidence_level") != "Verified") & F.lit(stale_after)
    tier = scores.demoted(F.col("tier"), importance) if demote else F.col("tier")
    changes: dict[str, Column] = {
        "importance": F.when(active, importance).otherwise(F.col("importance")),
        "confidence_level": F.when(stale, "Stale").otherwise(F.col("confidence_level")),
        "tier": F.when(active, tier).otherwise(F.col("tier")),
    }
    return memories.select(*(changes[c].alias(c) if c in changes else F.col(c) for c in memories.columns))


def forget_scores(memories: DataFrame, now: int, thresholds: scores.ForgetThresholds = scores.ForgetThresholds(), sample: bool = True, extra: dict[str, Column] | None = None) -> DataFrame:
    """memory_id, forget_score, action of living rows, the sampled tenth by default.

    ``extra`` may add redundancy and centrality, which the cycle itself leaves out.
    """
    rows = memories.where(is_alive())
    rows = sampled(rows, thresholds.sample_ratio) if sample else rows
    score = scores.forget_score(scores.forget_signals(now, thresholds) | (extra or {}))
    scored = rows.withColumn("forget_score", F.round(score, 6))
    return scored.select("memory_id", "agent_id", "forget_score", scores.forget_action(F.col("forget_score"), thresholds).alias("action"))


def forget(memories: DataFrame, now: int, thresholds: scores.ForgetThresholds = scores.ForgetThresholds(), shadow: bool = False, sample: bool = True) -> tuple[DataFrame, DataFrame]:
    """Memories after a cycle, and its log: only tombstones are applied, none in shadow mode."""
    scored = forget_scores(memories, now, thresholds, sample)
    log = scored.where(F.col("forget_score") >= thresholds.decay)
    after = memories if shadow else marked(memories, scored.where("action = 'Tombstone'"), "Tombstone")
    return after, log


def delete_agent(memories: DataFrame, edges: DataFrame, agent_id: str) -> tuple[DataFrame, DataFrame]:
    """Living rows of an agent tombstoned and their edges dropped."""
    from palimpsest.operators.graph import without_nodes

    ids = memories.where((F.col("agent_id") == agent_id) & is_alive()).select("memory_id")
    return marked(memories, ids, "Tombstone"), without_nodes(edges, ids)
