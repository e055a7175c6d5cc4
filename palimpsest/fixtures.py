"""Memory-model tables projected from the test tables, as SQL that any engine reads.

The texts name their inputs in braces, so that one text serves Spark and a checker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1706745600

# One memory for each id that either table has; the ids of both run from 0 without gaps, and the
# smaller table is gone round, so that every text and every vector is in the store.
IDS = """(select i, i % (select count(*) from {documents}) as doc, i % (select count(*) from {embeddings}) as vec,
 (select count(*) from (select doc_id from {documents} union select vec_id from {embeddings}) a) as n
 from (select doc_id as i from {documents} union select vec_id as i from {embeddings}) b)"""

MEMORIES = """
select x.i + 1 as memory_id,
 concat('user-', cast(x.i % 7 as string)) as user_id,
 concat('agent-', cast(e.label % 4 as string)) as agent_id,
 case when x.i % 5 = 0 then 'agent_shared' else 'private' end as scope,
 case x.i % 6 when 0 then 'user_profile' when 1 then 'feedback' when 2 then 'domain_knowledge'
                   when 3 then 'reference' when 4 then 'skill' else 'ephemeral' end as memory_type,
 case when x.i % 10 < 5 then 'working' when x.i % 10 < 8 then 'short_term' else 'long_term' end as tier,
 case when x.i % 23 = 0 then 'Tombstone' when x.i % 19 = 0 then 'Archived'
      when x.i % 17 = 0 then 'Versioned' when x.i % 29 = 0 then 'Invalidated' else 'Active' end as phase,
 case when x.i % 11 = 0 then 'Verified' when x.i % 13 = 0 then 'Conflicted'
      when x.i % 7 = 0 then 'Stale' else 'Inferred' end as confidence_level,
 case x.i % 3 when 0 then 'Assertion' when 1 then 'Behavioral' else 'Inference' end as source_tier,
 case when x.i % 3 = 2 then 'Derived' else 'Raw' end as layer,
 cast((x.i * 37) % 101 as double) / cast(100 as double) as importance,
 cast((x.i * 13) % 17 as bigint) as access_count,
 cast(case when x.i % 3 = 2 then x.i else 0 end as bigint) as parent_id,
 1704067200 + x.i * 3600 as created_at,
 1704067200 + x.i * 3600 + ((x.i * 7919) % 500) * 60 as last_accessed,
 d.text as content, e.embedding as embedding
from {ids} x join {documents} d on d.doc_id = x.doc join {embeddings} e on e.vec_id = x.vec
"""

EDGE_STREAM = """
select i + 1 as from_id, (i * 7 + 3) % n + 1 as to_id,
 case i % 7 when 0 then 'Related' when 1 then 'SameSession' when 2 then 'ConflictsWith' when 3 then 'DerivedFrom'
            when 4 then 'Entity' when 5 then 'Contradicts' else 'Temporal' end as type,
 cast(i % 10 as double) / cast(10 as double) as weight, 1704067200 + i * 3600 as created_at, i as seq
from {ids} x where (i * 7 + 3) % n <> i
union all
select i + 1, i - 3, 'Supersedes', cast(1 as double), 1704067200 + i * 3600, i + n
from {ids} x where i >= 4 and i % 4 = 0 and i % 24 <> 0
"""

LINKS = """
select i + 1 as child_id, i as parent_id from {ids} x where i % 3 = 2
union all select i + 1, i - 1 from {ids} x where i % 6 = 5
union all select i + 1, i - 8 from {ids} x where i % 9 = 8 and i >= 17
"""

EVENTS = """
select event_id, cast(floor(event_id / 5) as bigint) as trace_id, user_id + 1 as memory_id,
 concat('agent-', cast(user_id % 4 as string)) as agent_id,
 case event_type when 'view' then 'Recall' when 'click' then 'Store' when 'purchase' then 'Gate' when 'signup' then 'Reconcile' else 'Error' end as kind,
 case event_type when 'error' then 'Failed' when 'purchase' then 'Rejected' else 'Ok' end as status,
 {ms} as timestamp_ms, props from {events}
"""
SPARK_MS = "unix_timestamp(ts) * 1000"
DUCK_MS = "cast(floor(epoch(ts)) as bigint) * 1000"

# Lines for the text predicates, beside the tables' texts: those the tables do not have.
STATEMENTS = (
    "hi", "ok", "Thanks!", "goodbye", "sure", "yes", "no way, really", "你好", "谢谢啊", "今日广州天气", "出错了: 超时",
    "ERROR in line 7", "the proxy said HTTP 429 again", "status code: 503", "they imposed a rate limit", "房租三千",
    "please forget about my old address", "delete that data now", "请忘掉我的地址", "remove the stain", "erase about half",
    "don't tell the neighbours", "the plan is confidential", "千万别说是我", "a private garden", "privateers at sea",
    "I want a window seat", "my favorite colour is teal", "she usually walks to work", "it rang 7 times",
    "单号QX417已签收", "QX417, QX418 and B-2044", "parcel 87654321 left the depot", "B2044 plain", "旧车牌 K7731",
    "a former colleague", "earlier than planned but now fixed", "清单: QX417", "x", "", "é", "No", "hello again", "haha!!!", "um...",
)

SAID = """
select concat('d', cast(doc_id as string)) as id, text as content from {documents} where text is not null
union all select concat('c', cast(conv_id as string), ':', cast(turn as string)), text from {conversations} where text is not null
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = text.replace("{ids}", IDS)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in ("documents", "embeddings", "conversations") if f"{{{t}}}" in text})


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, MEMORIES)
    topic = F.concat(F.lit("t"), (F.col("memory_id") % 3).cast("string"))
    secret = F.when(F.col("memory_id") % 13 == 0, "true").otherwise("false")
    return rows.withColumn("user_metadata", F.create_map(F.lit("topic"), topic, F.lit("confidential"), secret))


def edge_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, EDGE_STREAM)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, LINKS).distinct()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENTS.replace("{ms}", SPARK_MS), events=table(spark, sf_dir, "events"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")


def queries(rows: DataFrame) -> DataFrame:
    """The stated query set: memories whose id is divisible by 20 ask with their whole content."""
    asked = rows.where("memory_id % 20 = 0")
    return asked.select(F.col("memory_id").alias("query_id"), "agent_id", "user_id", F.col("content").alias("text"), "embedding")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content: the lines above and all texts of documents and conversations."""
    lines = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(STATEMENTS)], "id string, content string")
    return lines.unionByName(_sql(spark, sf_dir, SAID))


def duck(name: str) -> str:
    texts = {"m": MEMORIES, "stream": EDGE_STREAM, "links": LINKS, "ev": EVENTS, "texts": SAID}
    names = {"embeddings": "embeddings", "documents": "documents", "conversations": "conversations", "events": "events", "ms": DUCK_MS}
    return texts[name].replace("{ids}", IDS).format(**names)


def duck_statements() -> str:
    rows = ", ".join("('s{}', '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(STATEMENTS))
    return f"select * from (values {rows}) t(id, content) union all select * from ({duck('texts')})"
