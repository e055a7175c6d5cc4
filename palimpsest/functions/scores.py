"""Scores, rates and ranks as Column arithmetic; times in epoch seconds, `now` given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Per tier, working / short_term / long_term.
DECAY_FACTOR = (2.0, 1.0, 0.5)
STALE_HOURS = (72.0, 360.0, 720.0)
FORGET_TOLERANCE = (1.0, 2.0, 4.0)


@dataclass(frozen=True)
class Weights:
    semantic: float = 0.4
    keyword: float = 0.25
    graph: float = 0.15
    recency: float = 0.1
    importance: float = 0.1


@dataclass(frozen=True)
class ForgetWeights:
    staleness: float = 0.25
    low_access: float = 0.20
    low_importance: float = 0.20
    conflict: float = 0.10
    redundancy: float = 0.10
    verified: float = 0.10
    centrality: float = 0.05


@dataclass(frozen=True)
class ForgetThresholds:
    decay: float = 0.3
    archive: float = 0.6
    tombstone: float = 0.85
    stale_hours: float = 168.0
    sample_ratio: float = 0.1


@dataclass(frozen=True)
class GateConfig:
    duplicate: float = 0.95
    low_value: float = 0.15
    deferred: float = 0.30
    neighbours: int = 5
    shadow: bool = True  # judge without turning away, until told otherwise


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def by_tier(tier: Column, values: tuple[float, float, float]) -> Column:
    return F.when(tier == "short_term", values[1]).when(tier == "long_term", values[2]).otherwise(values[0])


def hours_since(then: Column, now: int) -> Column:
    return (F.lit(now) - then) / 3600.0


def recency(last_accessed: Column, now: int) -> Column:
    """e-folds every 30 days since the last access."""
    return F.exp(-hours_since(last_accessed, now) / 720.0)


def graph_score(connected: Column, degree: Column) -> Column:
    return F.least(F.lit(1.0), connected * 0.2 + degree * 0.05)


def fused(semantic: Column, keyword: Column, recent: Column, graph: Column, importance: Column, w: Weights = Weights(), gated: bool = False) -> Column:
    base = w.semantic * semantic + w.keyword * keyword + w.graph * graph + w.importance * importance
    return base * recent if gated else base + w.recency * recent


def four_signals(distance: Column, importance: Column, access_count: Column, age_hours: Column, gated: bool = False) -> Column:
    """Semantic, recency, importance and frequency, 0.6 / 0.2 / 0.1 / 0.1, or gated by recency."""
    semantic = clamp(1.0 - distance)
    recent = F.when(age_hours <= 0, 1.0).otherwise(F.exp(-0.01 * age_hours))
    frequency = clamp(F.log2(access_count + 1.0) / 9.97)
    base = 0.6 * semantic + 0.1 * clamp(importance) + 0.1 * frequency
    return base * recent if gated else base + 0.2 * recent


def marginal_value(max_similarity: Column, tier: Column, importance: Column) -> Column:
    """Novelty plus a bonus for first-hand sources and importance; 1 without neighbours."""
    bonus = F.when(tier == "Behavioral", 0.1).when(tier == "Assertion", 0.05).otherwise(0.0)
    value = clamp(1.0 - F.greatest(max_similarity, F.lit(0.0)) + bonus + 0.1 * importance)
    return F.when(max_similarity.isNull(), 1.0).otherwise(value)


def forget_signals(now: int, thresholds: ForgetThresholds = ForgetThresholds()) -> dict[str, Column]:
    level = F.col("confidence_level")
    idle = hours_since(F.col("last_accessed"), now) / (thresholds.stale_hours * by_tier(F.col("tier"), FORGET_TOLERANCE))
    return {
        "staleness": F.least(F.lit(1.0), idle),
        "low_access": F.greatest(F.lit(0.0), 1.0 - F.log(1.0 + F.col("access_count")) / 5.0),
        "low_importance": 1.0 - F.col("importance"),
        "conflict": F.when(level == "Conflicted", 1.0).otherwise(0.0),
        "verified": F.when(level == "Verified", 1.0).otherwise(0.0),
    }


def forget_score(signals: dict[str, Column], w: ForgetWeights = ForgetWeights()) -> Column:
    total = F.lit(0.0)
    for name, sign in (("staleness", 1), ("low_access", 1), ("low_importance", 1), ("conflict", 1), ("redundancy", 1), ("verified", -1), ("centrality", -1)):
        if name in signals:
            total = total + sign * getattr(w, name) * signals[name]
    return clamp(total)


def forget_action(score: Column, t: ForgetThresholds = ForgetThresholds()) -> Column:
    return F.when(score >= t.tombstone, "Tombstone").when(score >= t.archive, "Archive").when(score >= t.decay, "Decay").otherwise("Keep")


def decayed(now: int, rate: float, exponential: bool = False) -> Column:
    load = rate * by_tier(F.col("tier"), DECAY_FACTOR) * hours_since(F.col("last_accessed"), now) / 24.0
    importance = F.col("importance")
    return importance * F.exp(-load) if exponential else F.greatest(F.lit(0.0), importance * (1.0 - load))


def promoted(tier: Column, access_count: Column, importance: Column, short: tuple[int, float] = (3, 0.6), long: tuple[int, float] = (10, 0.7)) -> Column:
    """One step up at most."""
    return (
        F.when((tier == "working") & ((access_count >= short[0]) | (importance >= short[1])), "short_term")
        .when((tier == "short_term") & (access_count >= long[0]) & (importance >= long[1]), "long_term")
        .otherwise(tier)
    )


def demoted(tier: Column, importance: Column) -> Column:
    return F.when(importance >= 0.1, tier).when(tier == "long_term", "short_term").otherwise("working")


def confidence_rank(level: Column) -> Column:
    return F.when(level == "Verified", 4).when(level == "Inferred", 3).when(level == "Stale", 2).otherwise(1)


def source_rank(tier: Column) -> Column:
    return F.when(tier == "Behavioral", 3).when(tier == "Assertion", 2).otherwise(1)


# Id layout, milliseconds of 2025-01-01 UTC.
ID_EPOCH_MS = 1735689600000


def snowflake_ms(memory_id: Column) -> Column:
    return F.shiftrightunsigned(memory_id, 22) + ID_EPOCH_MS


def snowflake_worker(memory_id: Column) -> Column:
    return F.shiftrightunsigned(memory_id, 12).bitwiseAND(1023)


def snowflake_sequence(memory_id: Column) -> Column:
    return memory_id.bitwiseAND(4095)


def snowflake(ms: Column, worker: Column, sequence: Column) -> Column:
    return F.shiftleft(ms - ID_EPOCH_MS, 22).bitwiseOR(F.shiftleft(worker, 12)).bitwiseOR(sequence)
