"""Lists, pages, counts and eviction orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.filters import is_alive
from palimpsest.storage import materialize

DISTRIBUTIONS = ("scope", "memory_type", "phase", "confidence_level", "tier")


def _newest(*first: str):
    return [F.desc("created_at"), *(F.desc(c) for c in first)]


def page(rows: DataFrame, number: int, per_page: int, order: list | None = None) -> DataFrame:
    """One page, newest first, with the total before paging.

    The total is its own count; only the rows up to the page are sorted out.
    """
    total = rows.agg(F.count("*").alias("total"))
    order = order or _newest("memory_id")
    return rows.orderBy(*order).offset((number - 1) * per_page).limit(per_page).crossJoin(F.broadcast(total))  # one row


def page_across_agents(rows: DataFrame, number: int, per_page: int, per_agent: int = 5000, cap: int = 5000) -> DataFrame:
    """Newest first over all agents, each giving at most ``per_agent`` rows, all at most ``cap``.

    A total order over what each agent gave: a row that is not among an agent's
    first ``per_agent`` cannot be among the first ``cap`` when the caps agree.
    """
    mine = Window.partitionBy("agent_id").orderBy(*_newest("memory_id"))
    kept = rows.withColumn("_n", F.row_number().over(mine)).where(F.col("_n") <= per_agent).drop("_n")
    return page(kept.orderBy(*_newest("memory_id")).limit(cap), number, per_page)


def coverage(memories: DataFrame, agent_id: str = "") -> DataFrame:
    rows = memories.where(F.col("agent_id") == agent_id) if agent_id else memories
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("phase") == "Active").alias("active"),
        F.count_if(F.col("confidence_level") == "Stale").alias("stale"),
        F.count_if(F.col("confidence_level") == "Conflicted").alias("conflicted"),
    )


def distributions(memories: DataFrame, columns: tuple[str, ...] = DISTRIBUTIONS) -> DataFrame:
    """facet, value, n: counts of each column's values in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return memories.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def totals_by_agent(memories: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    counts = memories.groupBy("agent_id").agg(F.count("*").alias("memories"), F.count_if(is_alive()).alias("alive"))
    if edges is None:
        return counts
    owners = memories.select(F.col("memory_id").alias("from_id"), "agent_id")
    drawn = edges.join(owners, "from_id").groupBy("agent_id").agg(F.count("*").alias("edges"))
    return counts.join(drawn, "agent_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("long")))


def lowest(memories: DataFrame, share: float, order: list[str]) -> DataFrame:
    """The first floor(n x share) rows by the columns ``order``, wherever they lie.

    Rows are dealt out by ranges of the order; whole ranges are kept up to the one in which
    the share ends, and only that one is numbered.
    """
    dealt = materialize(memories.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect())  # one row a range
    left = int(sum(n for _, n in sizes) * share)
    for number, n in sizes:
        if n > left:
            last = dealt.where(F.col("_range") == number).withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
            whole = dealt.where(F.col("_range") < number)
            return whole.unionByName(last.where(F.col("_n") <= left).drop("_n")).drop("_range")
        left -= n
    return dealt.drop("_range")


def evict_cached(memories: DataFrame, share: float = 0.2) -> DataFrame:
    """A fifth of the rows, least used first; tombstones as if never used."""
    uses = F.when(F.col("phase") == "Tombstone", 0).otherwise(F.col("access_count"))
    return lowest(memories.withColumn("uses", uses.cast("long")), share, ["uses", "memory_id"])


def evict_to_cold(memories: DataFrame, capacity: int, ratio: float = 0.1) -> DataFrame:
    """The longest unused share, if there are more rows than ``capacity``."""
    if memories.count() <= capacity:
        return memories.limit(0)
    return lowest(memories, ratio, ["last_accessed", "memory_id"])


def index_counts(memories: DataFrame) -> DataFrame:
    """Vectors that are active, deleted, hot and cold."""
    has = F.size("embedding") > 0
    return memories.agg(
        F.count_if(has & is_alive()).alias("active"),
        F.count_if(has & ~is_alive()).alias("deleted"),
        F.count_if(has & is_alive() & (F.col("tier") != "long_term")).alias("hot"),
        F.count_if(has & is_alive() & (F.col("tier") == "long_term")).alias("cold"),
    )


def owners_of(ids: DataFrame, memories: DataFrame) -> DataFrame:
    """The first agent, by name, whose store has each id."""
    return ids.join(memories.groupBy("memory_id").agg(F.min("agent_id").alias("agent_id")), "memory_id")


def decision_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))
