"""The memory table on disk: upserts as an append log, latest write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.schema import MEMORIES, complete
from palimpsest.storage import materialize


def append(rows: DataFrame, path: str, seq: int) -> None:
    """One batch of upserts, partitioned by agent; ``seq`` orders batches."""
    complete(rows).withColumn("seq", F.lit(seq).cast("long")).write.mode("append").partitionBy("agent_id").parquet(path)


def log(spark: SparkSession, path: str, after_seq: int | None = None) -> DataFrame:
    """All writes, or those after a checkpoint."""
    schema = T.StructType([*MEMORIES.fields, T.StructField("seq", T.LongType())])
    rows = spark.read.schema(schema).parquet(path)
    return rows if after_seq is None else rows.where(F.col("seq") > after_seq)


def latest(rows: DataFrame, key: str = "memory_id", order: str = "seq") -> DataFrame:
    """The newest write of each key; added up before the shuffle, so no key is hot."""
    fields = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(key).agg(F.max_by(fields, order).alias("row")).select("row.*")


def live(rows: DataFrame) -> DataFrame:
    return latest(rows).where("phase <> 'Tombstone'")


def compact(spark: SparkSession, path: str, out: str, partitions: int | None = None) -> None:
    """The log rewritten as one sorted run an agent, tombstones dropped."""
    rows = live(log(spark, path))
    rows = rows.repartitionByRange(partitions, "agent_id", "memory_id") if partitions else rows.repartitionByRange("agent_id", "memory_id")
    rows.sortWithinPartitions("agent_id", "memory_id").write.partitionBy("agent_id").parquet(out)


def get(rows: DataFrame, memory_id: int) -> DataFrame:
    return rows.where(F.col("memory_id") == memory_id)


def between(rows: DataFrame, low: int, high: int) -> DataFrame:
    return rows.where(F.col("memory_id").between(low, high))


def with_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.where(F.col("content").startswith(prefix))


def contained(ids: DataFrame, rows: DataFrame) -> DataFrame:
    return ids.join(rows, "memory_id", "left_semi")


def missing_from_index(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Living rows with a vector that an index (memory_id) lacks."""
    return rows.where(~F.col("phase").isin("Tombstone", "Invalidated") & (F.size("embedding") > 0)).join(index.select("memory_id"), "memory_id", "left_anti")


def snapshot_and_delta(snapshot: DataFrame, delta: DataFrame, key: list[str], removed: Column | None = None) -> DataFrame:
    """A checkpoint and the log after it; ``removed`` marks log rows that delete their key."""
    rows = snapshot.withColumn("_seq", F.lit(-1).cast("long")).withColumn("_gone", F.lit(False))
    gone = removed if removed is not None else F.lit(False)
    tail = delta.withColumn("_seq", F.col("seq").cast("long")).withColumn("_gone", gone).select(*rows.columns)
    fields = F.struct(*(F.col(c) for c in rows.columns))
    last = rows.unionByName(tail).groupBy(*key).agg(F.max_by(fields, "_seq").alias("row")).select("row.*")
    return last.where(~F.col("_gone")).drop("_seq", "_gone")


def cut(rows: DataFrame, name: str = "store") -> DataFrame:
    return materialize(rows, name)
