"""Tables and enumerations of the memory model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enumeration names in ordinal order; unknown names fall back to `default`.
SCOPES = ("private", "agent_shared")
MEMORY_TYPES = ("user_profile", "feedback", "domain_knowledge", "reference", "skill", "ephemeral")
TIERS = ("working", "short_term", "long_term")
PHASES = ("Active", "Versioned", "Archived", "Tombstone", "Invalidated")
CONFIDENCES = ("Verified", "Inferred", "Stale", "Conflicted")
LAYERS = ("Raw", "Derived")
SOURCE_TIERS = ("Assertion", "Behavioral", "Inference")
GATE_DECISIONS = ("Accepted", "Rejected", "Deferred")
LINEAGE_OPS = ("None", "Summarize", "Aggregate", "Infer", "Distill")
EDGE_TYPES = (
    "Related", "Caused", "Contradicts", "Supersedes", "DerivedFrom", "SameSession",
    "Corrects", "Prerequisite", "Temporal", "Entity", "ConflictsWith",
)
UNDIRECTED = ("Related", "SameSession", "Temporal", "Entity")
RECONCILE_OPS = ("ADD", "REPLACE", "RETRACT", "REINFORCE", "NOOP")

# Bits of `flags`.
ALIVE, VERSIONED, ARCHIVED, TOMBSTONE, HAS_EMBEDDING = 1, 2, 4, 8, 16

_S, _L, _D, _I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


MEMORIES = _table(
    ("memory_id", _L), ("user_id", _S), ("agent_id", _S), ("scope", _S), ("memory_type", _S), ("tier", _S),
    ("phase", _S), ("confidence_level", _S), ("confidence_score", _D), ("flags", _I), ("importance", _D),
    ("access_count", _L), ("mem_version", _L), ("parent_id", _L), ("created_at", _L), ("last_accessed", _L),
    ("source_turn", _I), ("embedding", T.ArrayType(T.FloatType())), ("content", _S),
    ("user_metadata", T.MapType(_S, _S)), ("layer", _S), ("lineage_parents", T.ArrayType(_L)), ("lineage_op", _S),
    ("source_tier", _S), ("gate_decision", _S), ("marginal_value", _D), ("forget_score", _D),
    ("last_gc_visit", _L), ("resurrection_count", _I),
)
EDGES = _table(("from_id", _L), ("to_id", _L), ("type", _S), ("weight", _D), ("created_at", _L))
LINEAGE = _table(("child_id", _L), ("parent_ids", T.ArrayType(_L)), ("op", _S), ("created_at", _L))
EVENTS = _table(
    ("event_id", _L), ("parent_event_id", _L), ("trace_id", _L), ("memory_id", _L), ("timestamp_ms", _L),
    ("duration_ms", _L), ("agent_id", _S), ("kind", _S), ("status", _S), ("summary", _S), ("attrs", T.MapType(_S, _S)),
)
TURNS = _table(
    ("turn_number", _L), ("user_input", _S), ("agent_response", _S), ("detected_intent", _S),
    ("extracted_memory_ids", T.ArrayType(_L)), ("timestamp", _L),
)

# What a field holds when a row does not say.
DEFAULTS = {
    "user_id": "", "agent_id": "", "scope": "private", "memory_type": "ephemeral", "tier": "working",
    "phase": "Active", "confidence_level": "Inferred", "confidence_score": 0.5, "flags": ALIVE, "importance": 0.5,
    "access_count": 0, "mem_version": 1, "parent_id": 0, "source_turn": 0, "content": "", "layer": "Raw",
    "lineage_op": "None", "source_tier": "Inference", "gate_decision": "Accepted", "marginal_value": 0.0,
    "forget_score": 0.0, "last_gc_visit": 0, "resurrection_count": 0,
}


def named(value: Column, names: tuple[str, ...], default: str) -> Column:
    """``value`` if it is one of ``names``, else ``default``."""
    return F.when(value.isin(*names), value).otherwise(F.lit(default))


def tier_name(value: Column) -> Column:
    return F.when(value == "consolidated", F.lit("short_term")).otherwise(named(value, TIERS, "working"))


def default_scope(memory_type: Column) -> Column:
    return F.when(memory_type.isin("user_profile", "feedback", "ephemeral"), "private").otherwise("agent_shared")


def complete(df):
    """All columns of MEMORIES, absent or null fields filled with their defaults."""
    out = []
    for field in MEMORIES.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[field.name]).cast(field.dataType))
        out.append(value.alias(field.name))
    return df.select(*out)
