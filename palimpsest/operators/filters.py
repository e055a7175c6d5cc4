"""Predicates and projections over memories, edges and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.schema import ALIVE, TOMBSTONE

KEY_PREFIX = "__apikey__:"


def is_alive(phase: str = "phase", flags: str | None = None) -> Column:
    """Versioned and archived rows are alive; tombstones and invalidated rows are not."""
    alive = ~F.col(phase).isin("Tombstone", "Invalidated")
    return alive if flags is None else alive & (F.col(flags).bitwiseAND(TOMBSTONE) == 0)


def is_active(phase: str = "phase", flags: str | None = None) -> Column:
    active = F.col(phase) == "Active"
    return active if flags is None else active & (F.col(flags).bitwiseAND(ALIVE) != 0)


def visible_to(user_id: Column | str, agent_id: Column | str | None = None) -> Column:
    """Private rows need the same user, unless none is given; the agent must be equal if given."""
    user = F.lit(user_id) if isinstance(user_id, str) else user_id
    seen = (F.col("scope") != "private") | (user == "") | (F.col("user_id") == user)
    if agent_id is None:
        return seen
    agent = F.lit(agent_id) if isinstance(agent_id, str) else agent_id
    return seen & ((agent == "") | (F.col("agent_id") == agent))


def indexable(user_id: Column) -> Column:
    """The filter below a search; anonymous users are filtered only after it."""
    return user_id.isin("", "anonymous") | (is_alive() & ((F.col("scope") != "private") | (F.col("user_id") == user_id)))


def listed(memories: DataFrame, query: str = "", include_tombstone: bool = False, **facets: str) -> DataFrame:
    """Rows with equal facets (scope, memory_type, phase, layer, tier, user_id) and a substring."""
    rows = memories if include_tombstone else memories.where(is_alive())
    for name, value in facets.items():
        if value:
            rows = rows.where(F.col(name) == value)
    return rows.where(F.col("content").contains(query)) if query else rows


def with_metadata(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """All keys must have the given values; a missing key does not match."""
    for key, value in wanted.items():
        rows = rows.where(F.col("user_metadata")[key] == value)
    return rows


def presented(rows: DataFrame) -> DataFrame:
    """Marks confidential content for clients, as a column and in the text."""
    secret = F.coalesce(text.confidential(F.col("content"), F.col("user_metadata")), F.lit(False))
    return rows.withColumn("confidential", secret).withColumn("content", F.when(secret, F.concat(F.lit(text.CONFIDENTIAL_PREFIX), "content")).otherwise(F.col("content")))


def sampled(rows: DataFrame, ratio: float) -> DataFrame:
    """The same rows at every run: ids by their last two digits."""
    return rows.where(F.col("memory_id") % 100 < int(ratio * 100))


def every_nth(rows: DataFrame, ratio: float) -> DataFrame:
    return rows.where(F.col("memory_id") % int(max(1.0, 1.0 / ratio)) == 0)


def since(rows: DataFrame, watermark: int) -> DataFrame:
    """Rows of an incremental cycle: with a vector, created at or after the last one."""
    return rows.where((F.col("created_at") >= watermark) & F.col("embedding").isNotNull() & (F.size("embedding") > 0))


def stale(memories: DataFrame) -> DataFrame:
    return memories.where((F.col("confidence_level") == "Stale") & (F.col("phase") == "Active")).select("memory_id")


def without_keys(memories: DataFrame) -> DataFrame:
    """Rows that hold access keys are never recalled."""
    return memories.where(~F.col("content").startswith(KEY_PREFIX))
