"""Sessions and their turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS, MOST_ACTIVE = 3600, 1000


def summaries(turns: DataFrame) -> DataFrame:
    """session_id, turn_count, user_turns, first_turn, last_turn of (session_id, turn, role)."""
    return turns.groupBy("session_id").agg(
        F.count("*").alias("turn_count"),
        F.count_if(F.col("role") == "user").alias("user_turns"),
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
    )


def captured(turns: DataFrame) -> DataFrame:
    """Turns that become memories: a user's or an assistant's, not empty; assistants are tagged."""
    kept = turns.where(F.col("role").isin("user", "assistant") & (F.coalesce(F.col("text"), F.lit("")) != ""))
    return kept.withColumn("user_metadata", F.when(F.col("role") == "assistant", F.create_map(F.lit("role"), F.lit("assistant"))).otherwise(F.create_map().cast("map<string,string>")))


def intents(turns: DataFrame, frame: int = 3) -> DataFrame:
    """Intent of a user's turn with two earlier ones: its first word; context: the last turns.

    The default for a model's verdict: the lower-cased first word.
    """
    ordered = Window.partitionBy("session_id").orderBy("turn")
    context = F.array_join(F.collect_list("text").over(ordered.rowsBetween(-(frame - 1), 0)), "\n")
    word = F.lower(F.regexp_extract("text", r"^\s*(\S+)", 1))
    earlier = F.row_number().over(ordered) - 1
    return turns.select(
        "session_id", "turn", F.when(earlier >= 2, word).otherwise("").alias("intent"), F.length(context).alias("context_length"), earlier.alias("earlier")
    )


def folded(log: DataFrame) -> DataFrame:
    """Sessions from their log: op (start, turn, close), session_id, agent_id, user_id, at, memory_ids, intent."""
    ids = F.flatten(F.collect_list("memory_ids"))
    return log.groupBy("session_id").agg(
        F.max(F.when(F.col("op") == "start", F.col("agent_id"))).alias("agent_id"),
        F.max(F.when(F.col("op") == "start", F.col("user_id"))).alias("user_id"),
        F.min(F.when(F.col("op") == "start", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("op") != "close", F.col("at"))).alias("last_turn_at"),
        F.count_if(F.col("op") == "turn").alias("turn_count"),
        (F.count_if(F.col("op") == "close") == 0).alias("active"),
        F.array_sort(F.array_distinct(ids)).alias("memory_ids"),
        F.coalesce(F.max_by("intent", F.when(F.col("op") == "turn", F.col("at"))), F.lit("")).alias("current_intent"),
    ).where("started_at is not null")


def listed(sessions: DataFrame) -> DataFrame:
    """Active ones first, then by their last turn."""
    return sessions.orderBy(F.desc("active"), F.desc("last_turn_at"), "session_id")


def resolved(sessions: DataFrame, memories: DataFrame) -> DataFrame:
    """session_id and how many of its memory ids still exist."""
    ids = sessions.select("session_id", F.explode_outer("memory_ids").alias("memory_id"))
    found = ids.join(memories.select("memory_id", F.lit(1).alias("_there")), "memory_id", "left")
    return found.groupBy("session_id").agg(F.countDistinct(F.when(F.col("_there") == 1, F.col("memory_id"))).alias("memories"))


def expired(sessions: DataFrame, now: int, ttl: int = TTL_SECONDS, most: int = MOST_ACTIVE) -> DataFrame:
    """Sessions to keep: no closed one older than ``ttl``, and the ``most`` newest active ones."""
    closed = sessions.where(~F.col("active") & (F.lit(now) - F.col("last_turn_at") <= ttl))
    active = sessions.where("active").orderBy(F.desc("last_turn_at"), "session_id").limit(most)
    return closed.unionByName(active)
