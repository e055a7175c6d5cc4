"""JSON lines: memories, edges, sessions and events, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest import schema
from palimpsest.operators import sessions


def export(rows: DataFrame, path: str) -> None:
    rows.write.json(path, ignoreNullFields=False)


def import_memories(spark: SparkSession, path: str) -> DataFrame:
    """Bad lines are skipped, unknown names read as defaults, invalidated rows come back active."""
    rows = spark.read.schema(schema.MEMORIES).option("mode", "DROPMALFORMED").json(path)
    rows = schema.complete(rows.where("memory_id is not null"))
    names = {
        "scope": schema.named(F.col("scope"), schema.SCOPES, "private"),
        "memory_type": schema.named(F.col("memory_type"), schema.MEMORY_TYPES, "ephemeral"),
        "tier": schema.tier_name(F.col("tier")),
        "phase": schema.named(F.when(F.col("phase") != "Invalidated", F.col("phase")), schema.PHASES, "Active"),
        "confidence_level": schema.named(F.col("confidence_level"), schema.CONFIDENCES, "Inferred"),
        "layer": schema.named(F.col("layer"), schema.LAYERS, "Raw"),
        "source_tier": schema.named(F.col("source_tier"), schema.SOURCE_TIERS, "Inference"),
    }
    return rows.withColumns(names)


def import_edges(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schema.EDGES).option("mode", "DROPMALFORMED").json(path)
    return rows.where("from_id is not null and to_id is not null")


def import_events(spark: SparkSession, path: str) -> DataFrame:
    from palimpsest.operators.events import KINDS, STATUSES

    rows = spark.read.schema(schema.EVENTS).option("mode", "DROPMALFORMED").json(path).where("event_id is not null")
    return rows.withColumns({"kind": schema.named(F.col("kind"), KINDS, "Error"), "status": schema.named(F.col("status"), STATUSES, "Ok")})


SESSION_OP = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("session_id", T.LongType()),
        T.StructField("agent_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("memory_ids", T.ArrayType(T.LongType())),
        T.StructField("intent", T.StringType()),
    ]
)


def session_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``json`` or ``json<TAB>crc32 in hex``; a line whose checksum is wrong is skipped."""
    lines = spark.read.text(path)
    body, given = F.substring_index("value", "\t", 1), F.regexp_extract("value", r"\t([0-9a-fA-F]+)\s*$", 1)
    right = (given == "") | (F.lower(given) == F.lower(F.lpad(F.hex(F.crc32(body.cast("binary"))), 8, "0")))
    rows = lines.where(right).select(F.from_json(body, SESSION_OP).alias("r")).select("r.*")
    return rows.where("session_id is not null and op is not null")


def sessions_from_log(spark: SparkSession, path: str) -> DataFrame:
    return sessions.folded(session_log(spark, path))
