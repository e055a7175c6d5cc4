"""One query for each operator over the test tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import fixtures as fx
from palimpsest.functions import scores, text, vectors
from palimpsest.operators import browse, consolidate, events, filters, graph, lifecycle, lineage, sessions, similarity
from palimpsest.plans import capture, recall
from palimpsest.sources import jsonl, store
from palimpsest.storage import materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLE[function.__name__] = oracle
        return function

    return add


# ---- shared SQL

NOW = fx.NOW
ALIVE = "phase not in ('Tombstone', 'Invalidated')"
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# distinct pairs of neighbouring characters, in time linear in the text
PAIRS = "list_distinct([p[1] || p[2] for p in list_zip(regexp_extract_all({0}, '(?s).'), regexp_extract_all({0}, '(?s).')[2:], true)])"


# the predicates of noise, as SQL over a column {c}
TRANSIENT = r"""(strlen({c}) < 3 or starts_with({c}, '出错了') or starts_with({c}, '抱歉') or starts_with({c}, '⏳') or starts_with({c}, 'ERROR')
      or starts_with({c}, 'Error:') or starts_with({c}, '[Error')
      or regexp_matches({c}, '(?i)(?:HTTP|status|code|error)\s*[:= ]?\s*\b(429|500|502|503|504)\b|rate.?limit|empty.?response|timed?\s*out|connection.?refused')
      or (strlen({c}) <= 200 and (regexp_full_match({c}, '(你好|你是谁|谢谢|好的|嗯|哦|再见|拜拜|是的|不是|对|没有|你叫什么|你能做什么|你会什么|你叫什么名字|今日.*天气)[啊呀呢吗也呗\s，？?!.]*')
       or regexp_full_match({c}, '(?i)(hi|hello|hey|ok|okay|thanks|thank\s+you|sure|got\s+it|yes|no|bye|goodbye|see\s+you|alright|fine|cool|great|nice|wow|lol|haha|hmm|um|uh)[\s!.?]*'))))"""


def _ctes(*names: str) -> str:
    """with-clause of the shared tables named."""
    known = {
        "m": fx.duck("m"),
        "stream": fx.duck("stream"),
        "links": f"select distinct * from ({fx.duck('links')})",
        "ev": fx.duck("ev"),
        "said": fx.duck_statements(),
        "q": "select memory_id as query_id, agent_id, user_id, content as text, embedding from m where memory_id % 20 = 0",
        "mirrored": """select * from stream union all select to_id, from_id, type, weight, created_at, seq from stream
          where type in ('Related', 'SameSession', 'Temporal', 'Entity')""",
        "edges": """select from_id, to_id, type, weight, created_at from (select *, row_number() over
          (partition by from_id, to_id, type order by seq desc, weight desc, created_at desc) as n from mirrored) where n = 1""",
        "near": f"""select q.query_id, m.memory_id, round(list_cosine_similarity(q.embedding::double[], m.embedding::double[]), 6) as similarity
          from q join m on m.agent_id = q.agent_id and m.{ALIVE} and (m.scope <> 'private' or m.user_id = q.user_id)""",
        "hits": """select * from (select *, row_number() over (partition by query_id order by similarity desc, memory_id) as rank from near) where rank <= 100""",
        "top": "select * from hits where rank <= 10",
        "scored": f"""select h.query_id, h.memory_id, h.similarity, h.rank, m.layer, m.parent_id, m.created_at, m.content, m.importance,
          round(greatest(case when len(toks) > 0 then len([w for w in toks if contains(lowc, w)]) / len(toks) else 0 end,
            case when length(q.text) >= 2 then len(list_intersect(qb, cb)) / len(qb) else 0 end), 6) as keyword_score,
          round(exp(-(({NOW} - m.last_accessed) / 3600.0) / 720.0), 6) as recency_score,
          round(least(1.0, 0.2 * coalesce(c.connected, 0) + 0.05 * coalesce(d.degree, 0)), 6) as graph_score
          from hits h join m using (memory_id) join q using (query_id)
          join (select query_id, {LOW.format("text")} as lowq,
             [x for x in regexp_split_to_array({LOW.format("text")}, '[ \\t\\n\\x0b\\f\\r]+') if strlen(x) >= 2] as toks,
             {PAIRS.format(LOW.format("text"))} as qb from q) t using (query_id)
          join (select memory_id, {LOW.format("content")} as lowc,
             case when length(content) >= 2 then {PAIRS.format(LOW.format("content"))} else [] end as cb from m) l using (memory_id)
          left join (select from_id, count(*) as degree from edges group by 1) d on d.from_id = h.memory_id
          left join (select a.query_id, a.memory_id, count(*) as connected from hits a join edges e on e.from_id = a.memory_id
             join hits b on b.query_id = a.query_id and b.memory_id = e.to_id and b.rank < a.rank group by 1, 2) c
             on c.query_id = h.query_id and c.memory_id = h.memory_id""",
    }
    order = ("m", "stream", "links", "ev", "said", "q", "mirrored", "edges", "near", "hits", "top", "scored")
    needs = {"q": ("m",), "mirrored": ("stream",), "edges": ("mirrored", "stream"), "near": ("q", "m"), "hits": ("near", "q", "m"), "top": ("hits", "near", "q", "m"), "scored": ("hits", "near", "q", "m", "edges", "mirrored", "stream")}
    wanted = set(names) | {n for name in names for n in needs.get(name, ())}
    return "with recursive " + ",\n".join(f"{n} as ({known[n]})" for n in order if n in wanted)


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = fx.memories(spark, sf)
    return rows, fx.queries(rows), graph.upserted(fx.edge_stream(spark, sf))


# ---- recall


@query(_ctes("top") + " select query_id, memory_id, similarity, rank from top")
def recall_semantic_topk(spark, sf):
    rows, asked, _ = _tables(spark, sf)
    return recall.candidates(asked, rows, recall.Options(k=10, over_fetch=1)).select("query_id", "memory_id", "similarity", "rank")


TOTAL = "round(0.4 * similarity + 0.25 * keyword_score + 0.15 * graph_score + 0.1 * importance + 0.1 * recency_score, 8)"
GATED = "round((0.4 * similarity + 0.25 * keyword_score + 0.15 * graph_score + 0.1 * importance) * recency_score, 8)"


@query(_ctes("scored") + f" select query_id, memory_id, similarity as semantic_score, keyword_score, recency_score, graph_score, {TOTAL} as total_score from scored")
def recall_hybrid_score(spark, sf):
    rows, asked, edges = _tables(spark, sf)
    return recall.scored(asked, rows, edges, NOW).select("query_id", "memory_id", "semantic_score", "keyword_score", "recency_score", "graph_score", "total_score")


@query(_ctes("scored") + f" select query_id, memory_id, {GATED} as total_score from scored")
def recall_recency_gated(spark, sf):
    rows, asked, edges = _tables(spark, sf)
    return recall.scored(asked, rows, edges, NOW, recall.Options(gated=True)).select("query_id", "memory_id", "total_score")


@query(
    _ctes("hits")
    + f""", s as (select h.query_id, h.memory_id, round(0.6 * least(greatest(similarity, 0.0), 1.0) + 0.1 * importance
        + 0.1 * least(greatest(log2(access_count + 1.0) / 9.97, 0.0), 1.0)
        + 0.2 * case when {NOW} - created_at <= 0 then 1.0 else exp(-0.01 * (({NOW} - created_at) / 3600.0)) end, 6) as score from hits h join m using (memory_id))
      select * from (select *, row_number() over (partition by query_id order by score desc, memory_id) as position from s) where position <= 10"""
)
def recall_scorer_4signal(spark, sf):
    rows, asked, _ = _tables(spark, sf)
    return recall.four_signal(asked, rows, NOW)


@query(
    _ctes("hits")
    + """ select h.query_id, h.memory_id from hits h join m using (memory_id) where not (m.layer = 'Raw' and exists
      (select 1 from hits o join m d on d.memory_id = o.memory_id where o.query_id = h.query_id and d.layer = 'Derived' and d.parent_id = h.memory_id))"""
)
def recall_suppress_derived_parent(spark, sf):
    rows, asked, _ = _tables(spark, sf)
    hits = recall.candidates(asked, rows).join(rows.select("memory_id", "layer", "parent_id"), "memory_id")
    return recall.drop_covered(hits).select("query_id", "memory_id")


@query(
    _ctes("hits", "edges")
    + """ select h.query_id, h.memory_id from hits h join m using (memory_id) where not (m.layer = 'Raw' and h.memory_id in
      (select d.parent_id from m d join edges e on e.to_id = d.memory_id and e.type = 'Supersedes' where d.layer = 'Derived' and d.parent_id <> 0))"""
)
def recall_suppress_superseded(spark, sf):
    rows, asked, edges = _tables(spark, sf)
    hits = recall.candidates(asked, rows).join(rows.select("memory_id", "layer"), "memory_id")
    return recall.drop_superseded(hits, rows, edges).select("query_id", "memory_id")


SUPERSEDED = f""", newer as (select distinct from_id, to_id from edges where type = 'Supersedes'),
  up(origin, node, depth) as (select distinct from_id, from_id, 0 from newer union select u.origin, o.from_id, u.depth + 1 from up u join newer o on o.to_id = u.node),
  tops as (select origin, arg_max(created_at, depth * 100000 + node) as top_at from up join m on m.memory_id = up.node and m.{ALIVE} group by 1),
  down(node, top_at) as (select o.to_id, t.top_at from newer o join tops t on t.origin = o.from_id union select o.to_id, d.top_at from down d join newer o on o.from_id = d.node),
  replaced as (select node as memory_id, max(top_at) as superseded_at from down group by 1)"""


@query(_ctes("m", "edges", "stream") + SUPERSEDED + " select memory_id, superseded_at from replaced")
def supersession_closure(spark, sf):
    rows, _, edges = _tables(spark, sf)
    return graph.supersession(edges, rows)


@query(
    _ctes("hits", "edges")
    + SUPERSEDED
    + f""", olds as (select m.agent_id, r.superseded_at, m.content, m.parent_id from replaced r join m using (memory_id) where m.layer = 'Derived'),
      texts as (select agent_id, content, max(superseded_at) as top_at from (select agent_id, superseded_at, content from olds
        union all select o.agent_id, o.superseded_at, p.content from olds o join m p on p.memory_id = o.parent_id) group by 1, 2),
      b as (select agent_id, top_at, {PAIRS.format("content")} as g from texts where length(content) >= 2),
      c as (select memory_id, agent_id, created_at, case when length(content) >= 2 then {PAIRS.format("content")} else [] end as g
        from m where memory_id in (select memory_id from hits))
      select query_id, memory_id from hits where memory_id not in
       (select c.memory_id from c join b on c.agent_id = b.agent_id and c.created_at < b.top_at and len(list_intersect(c.g, b.g)) / len(b.g) >= 0.9)"""
)
def recall_content_superseded(spark, sf):
    rows, asked, edges = _tables(spark, sf)
    hits = recall.candidates(asked, rows).join(rows.select("memory_id", "agent_id", "created_at", "content"), "memory_id")
    return recall.drop_outdated(hits, rows, edges, 0.9).select("query_id", "memory_id")


@query(
    _ctes("top", "edges")
    + """, r as (select t.query_id, t.memory_id, m.created_at, m.parent_id from top t join m using (memory_id))
      select distinct query_id, memory_id from (
       select a.query_id, case when e.type = 'Supersedes' or a.created_at >= b.created_at then e.to_id else e.from_id end as memory_id
        from r a join edges e on e.from_id = a.memory_id and e.type in ('Supersedes', 'ConflictsWith') join r b on b.query_id = a.query_id and b.memory_id = e.to_id
       union all select a.query_id, a.parent_id from r a join r b on b.query_id = a.query_id and b.memory_id = a.parent_id where a.parent_id <> 0)"""
)
def recall_conflict_loser(spark, sf):
    rows, asked, edges = _tables(spark, sf)
    hits = recall.candidates(asked, rows, recall.Options(k=10, over_fetch=1)).join(rows.select("memory_id", "created_at", "parent_id"), "memory_id")
    return recall.losers(hits, edges)


@query()
def recall_mmr(spark, sf):
    rows, asked, edges = _tables(spark, sf)
    return recall.ranked(recall.scored(asked, rows, edges, NOW))


@query()
def recall_full(spark, sf):
    rows, asked, edges = _tables(spark, sf)
    return recall.recall(asked, rows, edges, NOW).select("query_id", "memory_id", "position", "total_score")


LISTS = """select doc_id % 20 as query_id, doc_id as memory_id, doc_id * 10 as created_at, case doc_id % 4
  when 0 then concat('done: QX', lpad(cast(doc_id % 50 as string), 3, '0'), ' and QX', lpad(cast(doc_id % 37 as string), 3, '0'), ' closed')
  when 1 then concat('单号QX', lpad(cast(doc_id % 41 as string), 3, '0'), '已签收') when 2 then concat('列表 A-', cast(1000 + doc_id % 7 as string))
  else 'no ids here' end as line, text from {documents} where text is not null"""


@query(
    "with r as (select query_id, memory_id, created_at, concat(line, chr(10), text) as content from ("
    + LISTS.format(documents="documents")
    + r""")), f as (select *, list_distinct(regexp_extract_all(content, '\b(?:[A-Z]{2,5}\d{3,6}|[A-Z]{1,5}-\d{3,6})\b')) as p, list_distinct(regexp_extract_all(content, '\b\d{8,}\b')) as n,
       (contains(content, '|---') or contains(content, chr(10) || '- ') or contains(content, chr(10) || '* ') or contains(content, chr(10) || '1.')
        or contains(content, '以下') or contains(content, '列表') or contains(content, '清单') or contains(content, '汇总') or contains(content, '包括') or contains(content, '包含')) as l from r),
     a as (select * from f where greatest(len(p), len(n)) >= 2 or (l and greatest(len(p), len(n)) >= 1))
     select distinct a.query_id, a.memory_id from a join f o on o.query_id = a.query_id and o.created_at > a.created_at
      where (len(a.p) > 0 and len([x for x in o.p if not list_contains(a.p, x)]) > 0) or (len(a.n) > 0 and len([x for x in o.n if not list_contains(a.n, x)]) > 0)"""
)
def staleness_filter(spark, sf):
    rows = spark.sql(LISTS, documents=fx.table(spark, sf, "documents"))
    return recall.stale_aggregates(rows.select("query_id", "memory_id", "created_at", F.concat("line", F.lit("\n"), "text").alias("content")))


@query(_ctes("m") + " select memory_id from m where memory_id % 3 = 1 and memory_id % 13 = 0")
def recall_metadata_filter(spark, sf):
    return filters.with_metadata(fx.memories(spark, sf), {"topic": "t1", "confidential": "true"}).select("memory_id")


@query(_ctes("m") + f" select memory_id, memory_id % 13 = 0 as confidential, case when memory_id % 13 = 0 then '{text.CONFIDENTIAL_PREFIX}' else '' end || content as content from m")
def recall_confidential(spark, sf):
    return filters.presented(fx.memories(spark, sf)).select("memory_id", "confidential", "content")


# ---- text


@query(
    f"""with d as (select doc_id, text as content, substring(text, 5, 30) as q from documents)
     select doc_id, round(greatest(case when len(toks) > 0 then len([w for w in toks if contains(lowc, w)]) / len(toks) else 0 end,
       case when length(q) >= 2 then len(list_intersect(qb, cb)) / len(qb) else 0 end), 6) as score from (
       select doc_id, q, {LOW.format("content")} as lowc, [x for x in regexp_split_to_array({LOW.format("q")}, '[ \\t\\n\\x0b\\f\\r]+') if strlen(x) >= 2] as toks,
        {PAIRS.format(LOW.format("q"))} as qb,
        case when length(content) >= 2 then {PAIRS.format(LOW.format("content"))} else [] end as cb from d)"""
)
def keyword_score(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", F.round(text.keyword_score(F.col("text"), F.substring("text", 5, 30)), 6).alias("score"))


@query(
    f"""select doc_id, case when length(a) >= 2 then round(len(list_intersect(ab, bb)) / len(ab), 6) else 0 end as recall from (
      select doc_id, a, {PAIRS.format("a")} as ab,
       case when length(text) >= 2 then {PAIRS.format("text")} else [] end as bb
      from (select doc_id, text, substring(text, 3, 50) as a from documents))"""
)
def bigram_overlap(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", F.round(text.bigram_recall(F.substring("text", 3, 50), F.col("text")), 6).alias("recall"))


@query(
    _ctes("said")
    + f" select id, {TRANSIENT.replace('{c}', 'content')} as transient from said"
)
def transient_filter(spark, sf):
    return fx.statements(spark, sf).select("id", text.is_transient(F.col("content")).alias("transient"))


@query(
    _ctes("said")
    + r""" select id, strlen(content) between 6 and 500 and (regexp_matches(content, '请忘掉|请忘记|请删除|帮我忘|帮我删|忘掉|忘了吧|删掉|别记了|不要记|清除')
      or regexp_matches(content, '(?i)\b(forget|delete|remove|erase)\b.*(memory|info|data|about|what\s+i)')) as forget,
      regexp_matches(content, '千万不要告诉|别告诉别人|不要告诉任何|千万别说|千万别告诉|保密|不要透露')
      or regexp_matches(content, '(?i)\b(don''?t\s+tell|keep\s+(it\s+)?secret|confidential|private|do\s+not\s+share)\b') as secret from said"""
)
def forget_request(spark, sf):
    content = F.col("content")
    return fx.statements(spark, sf).select("id", text.is_forget_request(content).alias("forget"), text.has_secrecy_marker(content).alias("secret"))


@query(
    _ctes("said")
    + r""" select id, case when regexp_matches(content, '(?i)\b(I\s+(like|prefer|want|need|am|have|use)|my\s+(name|preference|favorite))\b') then 'Assertion'
      when regexp_matches(content, '(?i)\b(always|usually|every\s+time|repeatedly|often|habit|pattern|\d+\s*times)\b') then 'Behavioral' else 'Inference' end as tier from said"""
)
def source_tier(spark, sf):
    return fx.statements(spark, sf).select("id", text.source_tier(F.col("content"), F.lit("Inference")).alias("tier"))


@query(
    _ctes("said")
    + r""" select id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '\b(?:[A-Z]{2,5}\d{3,6}|[A-Z]{1,5}-\d{3,6})\b'))), ',') as ids,
      array_to_string(list_sort(list_distinct(regexp_extract_all(content, '\b\d{8,}\b'))), ',') as numbers,
      regexp_matches(content, '旧|之前|以前|原来|过去|历史|曾经|earlier|previous|old|former|past') and not regexp_matches(content, '但|不过|现在|如今|已经|now|but|however|currently') as old from said"""
)
def entity_markers(spark, sf):
    content = F.col("content")
    line = lambda ids: F.array_join(F.array_sort(ids), ",")
    return fx.statements(spark, sf).select("id", line(text.prefixed_ids(content)).alias("ids"), line(text.long_numbers(content)).alias("numbers"), text.has_old_marker(content).alias("old"))


@query("select doc_id, case when strlen(text) <= 80 then text else list_max([substring(text, 1, i::int) for i in range(1, 82) if strlen(substring(text, 1, i::int)) <= 80]) || '…' end as preview from documents")
def content_preview(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.preview(F.col("text"), 80).alias("preview"))


# ---- capture

GATE = scores.GateConfig(duplicate=0.30, low_value=0.75, deferred=0.85, shadow=False)
_MAXSIM = f"""select c.memory_id as query_id, max(round(list_cosine_similarity(c.embedding::double[], s.embedding::double[]), 6)) as sim
  from m c join m s on s.agent_id = c.agent_id and s.{ALIVE} and s.memory_id % 20 <> 0 where c.memory_id % 20 = 0 group by 1"""
_VALUE = "round(least(greatest(1 - greatest(sim, 0) + {bonus} + 0.1 * importance, 0), 1), 6)"


def _facts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is divisible by 20 as new facts, all others as the store."""
    fresh = rows.where("memory_id % 20 = 0").withColumnRenamed("memory_id", "query_id")
    return fresh, rows.where("memory_id % 20 <> 0")


@query(
    _ctes("m")
    + f""", b as ({_MAXSIM}), v as (select query_id, sim, {TRANSIENT.replace("{c}", "content")} as noise, sim >= 0.30 as dup,
       case when sim >= 0.30 or {TRANSIENT.replace("{c}", "content")} then 0 else {_VALUE.format(bonus="case source_tier when 'Behavioral' then 0.1 when 'Assertion' then 0.05 else 0 end")} end as marginal_value
       from b join m on m.memory_id = b.query_id)
      select query_id, marginal_value, case when noise or dup or marginal_value < 0.75 then 'Rejected' when marginal_value < 0.85 then 'Deferred' else 'Accepted' end as decision from v"""
)
def write_gate(spark, sf):
    fresh, stored = _facts(fx.memories(spark, sf))
    return capture.gate(fresh, stored, GATE).select("query_id", "marginal_value", "decision")


@query(
    _ctes("m")
    + f""", b as ({_MAXSIM}), v as (select query_id, sim, case when sim >= 0.30 then 0 else {_VALUE.format(bonus="0")} end as marginal_value from b join m on m.memory_id = b.query_id
       where not {TRANSIENT.replace("{c}", "content")})
      select query_id as memory_id, query_id - 1 as parent_id, case when sim >= 0.30 or marginal_value < 0.85 then 'Deferred' else 'Accepted' end as gate_decision,
       case when sim >= 0.30 or marginal_value < 0.85 then 'Stale' else 'Inferred' end as confidence_level, marginal_value, 'Derived' as layer from v"""
)
def derive_facts(spark, sf):
    fresh, stored = _facts(fx.memories(spark, sf))
    return capture.derive(fresh.withColumn("raw_id", F.col("query_id") - 1), stored, NOW, GATE)[0].select("memory_id", "parent_id", "gate_decision", "confidence_level", "marginal_value", "layer")


RECONCILE = capture.ReconcileConfig(floor=0.25, reinforce=0.40)


@query()
def reconcile_neighbourhood(spark, sf):
    fresh, stored = _facts(fx.memories(spark, sf))
    return capture.neighbourhood(fresh, stored, RECONCILE)


@query()
def reconcile_decide(spark, sf):
    fresh, stored = _facts(fx.memories(spark, sf))
    return capture.decide(fresh, stored, RECONCILE).withColumn("target_ids", F.array_join(F.col("target_ids").cast("array<string>"), ","))


@query()
def reconcile_apply(spark, sf):
    rows = fx.memories(spark, sf)
    fresh, stored = _facts(rows)
    edges = graph.upserted(fx.edge_stream(spark, sf))
    after, _ = capture.apply(rows, edges, capture.decide(fresh, stored, RECONCILE))
    return after.select("memory_id", "phase", F.round("importance", 6).alias("importance"))


@query(
    _ctes("m")
    + f""", s as (select a.memory_id as from_id, b.memory_id as to_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as weight
       from m a join m b on a.agent_id = b.agent_id and b.{ALIVE} where a.{ALIVE}),
      r as (select *, row_number() over (partition by from_id order by weight desc, to_id) as n from s)
      select from_id, to_id, case when weight >= 0.3 then 'ConflictsWith' else 'Related' end as type, weight from r where n <= 10 and from_id <> to_id and weight >= 0.2"""
)
def similarity_edges(spark, sf):
    alive = fx.memories(spark, sf).where(filters.is_alive())
    ranked = similarity.topk_join(alive.withColumnRenamed("memory_id", "query_id"), alive, 50)
    return graph.similarity_edges(ranked, conflict=0.3, related=0.2)


@query(
    _ctes("m")
    + f""" select a.memory_id as a, b.memory_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity
      from m a join m b on a.agent_id = b.agent_id and a.memory_id < b.memory_id and b.{ALIVE} where a.{ALIVE}
      and round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) >= 0.3"""
)
def similar_pairs(spark, sf):
    alive = fx.memories(spark, sf).where(filters.is_alive())
    return similarity.pairs_above(alive, 0.3)


# ---- graph


@query(_ctes("edges") + " select * from edges")
def graph_upsert(spark, sf):
    return graph.upserted(fx.edge_stream(spark, sf))


@query(
    _ctes("m", "edges", "stream")
    + """ select e.from_id, e.to_id, e.type, e.weight, coalesce(o.phase, 'Missing') as other_phase, coalesce(o.confidence_level, '') as other_confidence from edges e
      left join m o on o.memory_id = e.to_id where e.from_id = 42"""
)
def graph_neighbors(spark, sf):
    rows, _, edges = _tables(spark, sf)
    return graph.neighbours(edges, rows, 42).drop("other_preview")


@query(
    _ctes("edges")
    + """, i as (select * from edges where to_id = 45), t as (select from_id, count(*) as n from i group by 1)
      select i.* from i join t using (from_id), unnest(range(t.n)) as u(k)"""
)
def graph_incoming(spark, sf):
    return graph.incoming(graph.upserted(fx.edge_stream(spark, sf)), 45)


@query(
    _ctes("edges")
    + """, r(start_id, node_id, depth) as (select k, k, 0 from unnest([1, 42, 101]) as u(k)
       union select r.start_id, e.to_id, r.depth + 1 from r join edges e on e.from_id = r.node_id where r.depth < 3)
      select cast(start_id as bigint) as start_id, cast(node_id as bigint) as node_id, min(depth) as depth from r group by 1, 2"""
)
def graph_bfs(spark, sf):
    start = spark.createDataFrame([(1,), (42,), (101,)], "memory_id long")
    return graph.traverse(graph.upserted(fx.edge_stream(spark, sf)), start, 3)


@query(
    _ctes("m", "edges", "stream")
    + f""" select e.* from edges e join m a on a.memory_id = e.from_id and a.{ALIVE} join m b on b.memory_id = e.to_id and b.{ALIVE}
      where a.user_id = 'user-3' or b.user_id = 'user-3'"""
)
def graph_live_edges(spark, sf):
    rows, _, edges = _tables(spark, sf)
    return graph.live_edges(edges, rows, "user-3")


@query(_ctes("edges") + " select count(*) as edges, count(distinct from_id) as nodes from edges")
def graph_counts(spark, sf):
    return graph.counts(graph.upserted(fx.edge_stream(spark, sf)))


@query(_ctes("edges") + " select * from edges where from_id % 23 <> 1 and to_id % 23 <> 1")
def graph_remove_nodes(spark, sf):
    gone = fx.memories(spark, sf).where("phase = 'Tombstone'")
    return graph.without_nodes(graph.upserted(fx.edge_stream(spark, sf)), gone)


@query(_ctes("edges") + " select * from edges where type in ('Contradicts', 'ConflictsWith')")
def graph_conflicts(spark, sf):
    return graph.conflicts(graph.upserted(fx.edge_stream(spark, sf)))


# ---- lineage


@query(
    _ctes("m")
    + """, c(start_id, memory_id, parent_id, step) as (select memory_id, memory_id, parent_id, 0 from m union all
       select c.start_id, m.memory_id, m.parent_id, c.step + 1 from c join m on m.memory_id = c.parent_id where c.parent_id <> 0 and c.step < 9)
      select start_id, memory_id, step from c"""
)
def version_history(spark, sf):
    rows = fx.memories(spark, sf)
    return lineage.history(rows, rows)


ROOTS = [(9,), (45,), (90,), (2,), (5,)]


@query(
    _ctes("links")
    + """, r(root_id, memory_id, depth) as (select k, l.child_id, 1 from unnest([9, 45, 90, 2, 5]) as u(k) join links l on l.parent_id = k
       union select r.root_id, l.child_id, r.depth + 1 from r join links l on l.parent_id = r.memory_id where r.depth < 5)
      select cast(root_id as bigint) as root_id, memory_id, min(depth) as depth from r where root_id <> memory_id group by 1, 2"""
)
def lineage_descendants(spark, sf):
    return lineage.descendants(fx.links(spark, sf), spark.createDataFrame(ROOTS, "memory_id long"))


def _cascade_sql(rounds: int = 5) -> str:
    steps = ["g0 as (select cast(k as bigint) as id from unnest([9, 45, 90, 2, 5, 8, 17]) as u(k)), f0 as (select id from g0), c0 as (select id from g0 where false)"]
    for k in range(1, rounds + 1):
        p = k - 1
        steps.append(
            f"""t{k} as (select distinct child_id as id from links where parent_id in (select id from f{p}) and child_id not in (select id from g{p}) and child_id not in (select id from c{p})),
            j{k} as (select t.id, bool_and(l.parent_id in (select id from g{p})) as invalidated from t{k} t join links l on l.child_id = t.id group by 1),
            f{k} as (select id from j{k} where invalidated), c{k} as (select id from c{p} union all select id from t{k}), g{k} as (select id from g{p} union all select id from f{k})"""
        )
    out = " union all ".join(f"select id as memory_id, {k} as depth, invalidated from j{k}" for k in range(1, rounds + 1))
    return _ctes("links") + ", " + ", ".join(steps) + " " + out


REMOVED = [(9,), (45,), (90,), (2,), (5,), (8,), (17,)]


@query(_cascade_sql())
def cascade_invalidate(spark, sf):
    return lineage.cascade(fx.links(spark, sf), spark.createDataFrame(REMOVED, "memory_id long"))


@query(_ctes("links") + " select count(distinct child_id) as children, count(distinct parent_id) as parents from links")
def lineage_stats(spark, sf):
    return lineage.stats(fx.links(spark, sf))


@query(_ctes("links") + " select child_id, bool_or(parent_id % 23 <> 1) as has_live_parent from links group by 1")
def lineage_live_parents(spark, sf):
    gone = fx.links(spark, sf).where("parent_id % 23 = 1").select(F.col("parent_id").alias("memory_id"))
    return lineage.live_parents(fx.links(spark, sf), gone)


@query(
    _ctes("m", "links")
    + f""", j as (select memory_id, invalidated from ({_cascade_sql().replace("with recursive", "with", 1)}))
      select m.memory_id, case when m.memory_id in (9, 45, 90, 2, 5, 8, 17) then 'removed' when j.invalidated then 'invalidated' when not j.invalidated then 'recomputed' else 'kept' end as outcome,
       case when m.memory_id in (9, 45, 90, 2, 5, 8, 17) then 'Tombstone' when j.invalidated then 'Invalidated' else m.phase end as phase from m left join j using (memory_id)"""
)
def coordinated_remove(spark, sf):
    gone = spark.createDataFrame(REMOVED, "memory_id long")
    return lineage.remove(fx.memories(spark, sf), fx.links(spark, sf), gone).select("memory_id", "outcome", "phase")


# ---- lifecycle

RANK = "case {}.confidence_level when 'Verified' then 4 when 'Inferred' then 3 when 'Stale' then 2 else 1 end"
SOURCE = "case {}.source_tier when 'Behavioral' then 3 when 'Assertion' then 2 else 1 end"


@query(
    _ctes("m")
    + f""", p as (select a.memory_id as a, b.memory_id as b, {RANK.format("a")} as ca, {RANK.format("b")} as cb, {SOURCE.format("a")} as sa, {SOURCE.format("b")} as sb,
        a.created_at as ta, b.created_at as tb, a.parent_id as pa, b.parent_id as pb from m a join m b on b.memory_id > a.memory_id and b.memory_id <= a.memory_id + 3),
      l as (select *, case when pb = a or pa = b then 1 when ca <> cb then 2 when ta <> tb then 3 when sa <> sb then 4 else 6 end as level from p)
      select a, b, case when level = 1 then case when pb = a then b else a end when level = 2 then case when ca > cb then a else b end when level = 3 then case when ta > tb then a else b end
        when level = 4 then case when sa > sb then a else b end else a end as winner_id,
       case when level = 1 then case when pb = a then a else b end when level = 2 then case when ca > cb then b else a end when level = 3 then case when ta > tb then b else a end
        when level = 4 then case when sa > sb then b else a end else b end as loser_id, level, level = 6 as coexist from l"""
)
def conflict_resolve(spark, sf):
    rows = fx.memories(spark, sf)
    pairs = rows.select(F.col("memory_id").alias("a"), F.explode(F.array(*(F.col("memory_id") + k for k in (1, 2, 3)))).alias("b"))
    return consolidate.resolve(pairs, rows)


IDLE = f"(({NOW} - last_accessed) / 3600.0)"
FORGET = f"""round(least(greatest(0.25 * least(1.0, {IDLE} / (168.0 * case tier when 'short_term' then 2 when 'long_term' then 4 else 1 end))
  + 0.20 * greatest(0.0, 1.0 - ln(1.0 + access_count) / 5.0) + 0.20 * (1.0 - importance) + case when confidence_level = 'Conflicted' then 0.10 else 0.0 end
  - case when confidence_level = 'Verified' then 0.10 else 0.0 end, 0.0), 1.0), 6)"""


@query(
    _ctes("m")
    + f""", s as (select memory_id, agent_id, {FORGET} as forget_score from m where {ALIVE} and memory_id % 100 < 10)
      select *, case when forget_score >= 0.85 then 'Tombstone' when forget_score >= 0.6 then 'Archive' when forget_score >= 0.3 then 'Decay' else 'Keep' end as action from s"""
)
def forget_gc(spark, sf):
    return lifecycle.forget_scores(fx.memories(spark, sf), NOW)


def _decay_sql(value: str) -> str:
    return (
        _ctes("m")
        + f""", d as (select *, {value} as left_ from m)
      select memory_id, round(case when phase = 'Active' then left_ else importance end, 9) as importance,
       case when phase = 'Active' and confidence_level <> 'Verified' and {IDLE} > case tier when 'short_term' then 360 when 'long_term' then 720 else 72 end then 'Stale' else confidence_level end as confidence_level,
       case when phase <> 'Active' or left_ >= 0.1 then tier when tier = 'long_term' then 'short_term' else 'working' end as tier from d"""
    )


LOAD = f"(0.01 * case tier when 'short_term' then 1.0 when 'long_term' then 0.5 else 2.0 end * {IDLE} / 24.0)"


@query(_decay_sql(f"greatest(0.0, importance * (1.0 - {LOAD}))"))
def decay_linear(spark, sf):
    return lifecycle.decayed(fx.memories(spark, sf), NOW).select("memory_id", F.round("importance", 9).alias("importance"), "confidence_level", "tier")


@query(_decay_sql(f"importance * exp(-{LOAD})"))
def decay_exponential(spark, sf):
    return lifecycle.decayed(fx.memories(spark, sf), NOW, exponential=True).select("memory_id", F.round("importance", 9).alias("importance"), "confidence_level", "tier")


@query(
    _ctes("m")
    + """ select memory_id, case when tier = 'working' and (access_count >= 3 or importance >= 0.6) then 'short_term'
      when tier = 'short_term' and access_count >= 10 and importance >= 0.7 then 'long_term' else tier end as tier from m"""
)
def tier_promotion(spark, sf):
    return fx.memories(spark, sf).select("memory_id", scores.promoted(F.col("tier"), F.col("access_count"), F.col("importance")).alias("tier"))


@query(
    _ctes("m")
    + """, a as (select user_id + 1 as memory_id, count(*) as n, max(cast(floor(epoch(ts)) as bigint)) as read_at from events group by 1)
      select memory_id, m.access_count + coalesce(n, 0) as access_count, greatest(last_accessed, coalesce(read_at, last_accessed)) as last_accessed from m left join a using (memory_id)"""
)
def access_log(spark, sf):
    reads = fx.table(spark, sf, "events").select((F.col("user_id") + 1).alias("memory_id"), F.unix_timestamp("ts").alias("at"))
    return lifecycle.touched(fx.memories(spark, sf), reads).select("memory_id", "access_count", "last_accessed")


@query(
    _ctes("m")
    + """, s as (select *, round(importance * (1.0 + ln(1.0 + access_count)), 6) as promotion_score, memory_id % 40 as session_id from m),
      r as (select *, row_number() over (partition by session_id order by promotion_score desc, memory_id) as rank from s)
      select session_id, memory_id, promotion_score, 'Verified' as confidence_level, 'short_term' as tier from r where rank <= 5 and confidence_level = 'Inferred'"""
)
def consolidate_promote(spark, sf):
    rows = fx.memories(spark, sf).withColumn("session_id", F.col("memory_id") % 40)
    return consolidate.promote_sessions(rows).select("session_id", "memory_id", "promotion_score", "confidence_level", "tier")


@query(
    _ctes("m")
    + """, d as (select a.memory_id, round(1.0 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as drift_score from m a join m b on b.memory_id = a.parent_id
       where a.layer = 'Derived' and a.parent_id <> 0) select *, drift_score > 0.95 as invalidated from d"""
)
def consolidate_drift(spark, sf):
    return consolidate.drift(fx.memories(spark, sf), 0.95)


@query(
    _ctes("m")
    + f""", s as (select a.memory_id as q, b.memory_id as n, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity, a.importance as ia, b.importance as ib
       from m a join m b on a.agent_id = b.agent_id and b.{ALIVE} where a.{ALIVE} and a.created_at >= 1705500000),
      r as (select *, row_number() over (partition by q order by similarity desc, n) as rank from s),
      f as (select *, row_number() over (partition by q order by rank) as k from r where rank <= 5 and q <> n and similarity >= 0.25)
      select q as memory_id, n as neighbour_id, similarity, case when ia >= ib then n else q end as removed_id from f where k = 1"""
)
def dedup_incremental(spark, sf):
    rows = fx.memories(spark, sf)
    return consolidate.dedup_incremental(rows, filters.since(rows, 1705500000), 0.25)


@query()
def dedup_full(spark, sf):
    return consolidate.dedup_full(fx.memories(spark, sf), 0.25)


@query(_ctes("m") + " select memory_id, case when phase = 'Active' and memory_id % 10 = 3 then 'Archived' else phase end as phase from m")
def archive_rows(spark, sf):
    rows = fx.memories(spark, sf)
    return lifecycle.marked(rows, rows.where("phase = 'Active' and memory_id % 10 = 3"), "Archived").select("memory_id", "phase")


@query(_ctes("m") + f" select memory_id, round(case when {ALIVE} and memory_id % 4 = 0 then least(greatest(importance + 0.2, 0), 1) else importance end, 6) as importance from m")
def boost_importance(spark, sf):
    rows = fx.memories(spark, sf)
    boosts = rows.where("memory_id % 4 = 0").select("memory_id", F.explode(F.array(F.lit(0.1), F.lit(0.1))).alias("delta"))
    return lifecycle.boosted(rows, boosts).select("memory_id", F.round("importance", 6).alias("importance"))


# ---- browsing


@query(
    _ctes("m")
    + f""", f as (select * from m where {ALIVE} and scope = 'private' and tier = 'working')
      select memory_id, created_at, (select count(*) from f) as total from f order by created_at desc, memory_id desc limit 20 offset 20"""
)
def memory_list_page(spark, sf):
    rows = filters.listed(fx.memories(spark, sf), scope="private", tier="working")
    return browse.page(rows, 2, 20).select("memory_id", "created_at", "total")


@query(
    _ctes("m")
    + f""", f as (select *, row_number() over (partition by agent_id order by created_at desc, memory_id desc) as n from m where {ALIVE}),
      c as (select * from f where n <= 50 order by created_at desc, memory_id desc limit 120)
      select memory_id, agent_id, (select count(*) from c) as total from c order by created_at desc, memory_id desc limit 30"""
)
def memory_list_all_agents(spark, sf):
    rows = filters.listed(fx.memories(spark, sf))
    return browse.page_across_agents(rows, 1, 30, 50, 120).select("memory_id", "agent_id", "total")


@query(_ctes("m") + f" select memory_id from m where {ALIVE} and contains(content, 'the') and memory_type = 'skill'")
def memory_search_text(spark, sf):
    return filters.listed(fx.memories(spark, sf), query="the", memory_type="skill").select("memory_id")


@query(_ctes("m") + " select memory_id from m where starts_with(content, 'Th') and memory_id between 10 and 300")
def store_scans(spark, sf):
    return store.with_prefix(store.between(fx.memories(spark, sf), 10, 300), "Th").select("memory_id")


@query(
    """with w as (select event_id % 500 as memory_id, event_id as seq, value from events),
     r as (select *, row_number() over (partition by memory_id order by seq desc) as n from w) select memory_id, seq, round(value, 6) as value from r where n = 1"""
)
def latest_wins(spark, sf):
    writes = fx.table(spark, sf, "events").select((F.col("event_id") % 500).alias("memory_id"), F.col("event_id").alias("seq"), F.round("value", 6).alias("value"))
    return store.latest(writes)


@query(_ctes("m") + f" select memory_id from m where {ALIVE} and memory_id % 9 <> 0")
def index_repair(spark, sf):
    rows = fx.memories(spark, sf)
    return store.missing_from_index(rows, rows.where("memory_id % 9 = 0")).select("memory_id")


@query(_ctes("m") + " select count(*) as total, count(*) filter (phase = 'Active') as active, count(*) filter (confidence_level = 'Stale') as stale, count(*) filter (confidence_level = 'Conflicted') as conflicted from m")
def coverage_counts(spark, sf):
    return browse.coverage(fx.memories(spark, sf))


@query(
    _ctes("m")
    + " ".join(
        (" union all" if k else "") + f" select '{c}' as facet, {c} as value, count(*) as n from m group by {c}" for k, c in enumerate(browse.DISTRIBUTIONS)
    )
)
def coverage_distributions(spark, sf):
    return browse.distributions(fx.memories(spark, sf))


@query(_ctes("m") + " select memory_id from m where confidence_level = 'Stale' and phase = 'Active'")
def stale_list(spark, sf):
    return filters.stale(fx.memories(spark, sf))


@query(
    _ctes("m", "edges", "stream")
    + f""" select agent_id, count(*) as memories, count(*) filter ({ALIVE}) as alive, coalesce(max(n), 0) as edges from m left join
      (select o.agent_id, count(*) as n from edges e join m o on o.memory_id = e.from_id group by 1) using (agent_id) group by 1"""
)
def agent_totals(spark, sf):
    rows, _, edges = _tables(spark, sf)
    return browse.totals_by_agent(rows, edges)


@query(_ctes("m") + " select memory_id from (select memory_id, row_number() over (order by case when phase = 'Tombstone' then 0 else access_count end, memory_id) as n, count(*) over () as c from m) where n <= floor(c * 0.2)")
def evict_cached(spark, sf):
    return browse.evict_cached(fx.memories(spark, sf)).select("memory_id")


@query(_ctes("m") + " select memory_id from (select memory_id, row_number() over (order by last_accessed, memory_id) as n, count(*) over () as c from m) where n <= floor(c * 0.1)")
def evict_to_cold(spark, sf):
    return browse.evict_to_cold(fx.memories(spark, sf), 100).select("memory_id")


@query(
    _ctes("hits")
    + """, u as (select query_id, memory_id, similarity from hits where rank <= 20 union all select query_id, memory_id, similarity - 0.05 from hits where rank between 5 and 40),
      b as (select query_id, memory_id, max(similarity) as s from u group by 1, 2)
      select query_id, memory_id, round(s, 6) as similarity, row_number() over (partition by query_id order by s desc, memory_id) as rank from b qualify rank <= 10"""
)
def merge_topk(spark, sf):
    rows, asked, _ = _tables(spark, sf)
    hits = recall.candidates(asked, rows)
    cold = hits.where("rank between 5 and 40").withColumn("similarity", F.col("similarity") - 0.05)
    return similarity.merge_topk([hits.where("rank <= 20"), cold], 10).withColumn("similarity", F.round("similarity", 6))


# ---- events and sessions


@query(
    _ctes("ev")
    + """ select event_id, timestamp_ms from ev where kind = 'Recall' and status = 'Ok' and starts_with(agent_id, 'agent-1') and timestamp_ms >= (select min(timestamp_ms) + 86400000 from ev)
      order by timestamp_ms desc, event_id desc limit 50"""
)
def event_query(spark, sf):
    rows = fx.events(spark, sf)
    since = rows.agg(F.min("timestamp_ms")).first()[0] + 86_400_000
    return events.query(rows, kind="Recall", status="Ok", agent="agent-1", since=since, limit=50).select("event_id", "timestamp_ms")


@query(
    _ctes("ev")
    + """ select 'kind' as facet, kind as value, count(*) as n from ev group by kind union all select 'status', status, count(*) from ev group by status
      union all select 'total', '', count(*) from ev"""
)
def event_stats(spark, sf):
    return events.stats(fx.events(spark, sf))


@query(
    _ctes("ev")
    + """ select trace_id, count(*) as n, min(timestamp_ms) as first_ms, max(timestamp_ms) as last_ms, string_agg(cast(event_id as varchar), ',' order by timestamp_ms, event_id) as event_ids
      from ev group by trace_id"""
)
def event_traces(spark, sf):
    return events.traces(fx.events(spark, sf))


@query(_ctes("ev") + " select event_id, timestamp_ms from ev where memory_id = 7 order by timestamp_ms desc, event_id desc limit 100")
def event_history(spark, sf):
    return events.history(fx.events(spark, sf), 7).select("event_id", "timestamp_ms")


@query(_ctes("ev") + " select event_id from ev order by timestamp_ms desc, event_id desc limit 2000")
def event_ring(spark, sf):
    return events.ring(fx.events(spark, sf)).select("event_id")


@query(_ctes("ev") + " select event_id, memory_id from ev where kind = 'Gate' and status in ('Rejected', 'Deferred')")
def resurrect_events(spark, sf):
    return events.resurrectable(fx.events(spark, sf)).select("event_id", "memory_id")


@query("select conv_id as session_id, count(*) as turn_count, count(*) filter (role = 'user') as user_turns, min(turn) as first_turn, max(turn) as last_turn from conversations group by 1")
def session_summary(spark, sf):
    return sessions.summaries(fx.turns(spark, sf))


@query("select conv_id as session_id, turn, role, role = 'assistant' as tagged from conversations where role in ('user', 'assistant') and coalesce(text, '') <> ''")
def intercept_capture(spark, sf):
    return sessions.captured(fx.turns(spark, sf)).select("session_id", "turn", "role", (F.size("user_metadata") > 0).alias("tagged"))


@query(
    r"""with t as (select conv_id as session_id, turn, text, row_number() over (partition by conv_id order by turn) - 1 as earlier,
      length(string_agg(text, chr(10)) over (partition by conv_id order by turn rows between 2 preceding and current row)) as context_length from conversations)
     select session_id, turn, case when earlier >= 2 then lower(regexp_extract(text, '^\s*(\S+)', 1)) else '' end as intent, context_length, earlier from t"""
)
def session_intents(spark, sf):
    return sessions.intents(fx.turns(spark, sf))


# ---- values


@query(
    """select event_id, (i >> 22) + 1735689600000 as ms, (i >> 12) & 1023 as worker, i & 4095 as sequence
     from (select event_id, ((event_id * 1000) << 22) | ((event_id % 1024) << 12) | (event_id % 4096) as i from events)"""
)
def snowflake_decode(spark, sf):
    made = fx.table(spark, sf, "events").select("event_id", scores.snowflake(F.col("event_id") * 1000 + scores.ID_EPOCH_MS, F.col("event_id") % 1024, F.col("event_id") % 4096).alias("i"))
    return made.select("event_id", scores.snowflake_ms(F.col("i")).alias("ms"), scores.snowflake_worker(F.col("i")).alias("worker"), scores.snowflake_sequence(F.col("i")).alias("sequence"))


@query("select event_id, cast(json_extract_string(props, '$.k') as varchar) as k from events")
def metadata_flatten(spark, sf):
    rows = fx.table(spark, sf, "events").withColumn("attrs", text.flat_metadata(F.from_json("props", "map<string,string>")))
    return rows.select("event_id", F.col("attrs")["k"].alias("k"))


# ---- capture end to end

FRESH = "select * from m where memory_id % 20 = 0"
STORED = "select * from m where memory_id % 20 <> 0"
FORGET = r"""(strlen({c}) between 6 and 500 and (regexp_matches({c}, '请忘掉|请忘记|请删除|帮我忘|帮我删|忘掉|忘了吧|删掉|别记了|不要记|清除')
      or regexp_matches({c}, '(?i)\b(forget|delete|remove|erase)\b.*(memory|info|data|about|what\s+i)')))"""


def _incoming(spark: SparkSession, sf: str, stored: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch with some assistants' rows and requests to forget, the store (``stored``: written once), and its edges."""
    rows, _, edges = _tables(spark, sf)
    rows = materialize(rows, "store") if stored else rows
    fresh = rows.where("memory_id % 20 = 0")
    said = F.when(F.col("memory_id") % 100 == 0, F.lit("please forget about that")).otherwise(F.col("content"))
    role = F.when(F.col("memory_id") % 60 == 0, F.create_map(F.lit("role"), F.lit("assistant"))).otherwise(F.col("user_metadata"))
    return fresh.withColumns({"content": said, "user_metadata": role}), rows.where("memory_id % 20 <> 0"), edges


def _run(spark: SparkSession, sf: str) -> capture.Captured:
    fresh, stored, edges = _incoming(spark, sf, stored=True)
    config = capture.CaptureConfig(gate=GATE, reconcile=RECONCILE, conflict=0.3, related=0.2)
    return capture.run(fresh, stored, edges, NOW, lambda raw, n: raw * 1_000_000 + n, config)


INCOMING = f""", f as (select memory_id, agent_id, embedding, importance, memory_id % 60 = 0 as echo, case when memory_id % 100 = 0 then 'please forget about that' else content end as content from ({FRESH})),
  r as (select *, case when {TRANSIENT.replace("{c}", "content")} then 'drop' when {FORGET.replace("{c}", "content")} then 'forget' else 'store' end as route from f),
  near0 as (select f.memory_id as q, s.memory_id, round(list_cosine_similarity(f.embedding::double[], s.embedding::double[]), 6) as sim, f.route
    from r f join ({STORED}) s on s.agent_id = f.agent_id and s.{ALIVE}),
  gone as (select distinct memory_id from (select *, row_number() over (partition by q order by sim desc, memory_id) as n from near0 where route = 'forget' and sim >= 0.30) where n <= 20),
  best as (select q, max(sim) as sim from near0 where memory_id not in (select memory_id from gone) group by 1)"""


@query(
    _ctes("m")
    + INCOMING
    + f""", v as (select r.memory_id, r.route, r.echo, b.sim, case when b.sim is null then 1.0 else {_VALUE.format(bonus="0").replace("importance", "0.5").replace("sim", "b.sim")} end as value from r left join best b on b.q = r.memory_id)
      select memory_id, case when route <> 'store' then route when echo then 'echo' when coalesce(sim >= 0.30, false) or value < 0.85 then 'Deferred' else 'Accepted' end as outcome from v"""
)
def capture_batch(spark, sf):
    return _run(spark, sf).outcomes


@query(_ctes("m") + INCOMING + " select memory_id from gone")
def capture_forgotten(spark, sf):
    fresh, stored, _ = _incoming(spark, sf)
    requests = capture.intake(fresh).where("route = 'forget'").withColumnRenamed("memory_id", "query_id")
    return capture.forgotten(requests, stored)


@query(
    _ctes("m")
    + INCOMING
    + """ select memory_id * 1000000 as from_id, memory_id as to_id from r where route = 'store' and not echo"""
)
def capture_lineage(spark, sf):
    return graph.of_types(_run(spark, sf).edges, "DerivedFrom").where("from_id >= 1000000").select("from_id", "to_id")


# ---- ranking, in SQL unrolled step by step


def _mmr_sql(k: int = 10) -> str:
    ids = r"list_distinct(list_concat(regexp_extract_all(content, '\b(?:[A-Z]{2,5}\d{3,6}|[A-Z]{1,5}-\d{3,6})\b'), regexp_extract_all(content, '\b\d{8,}\b')))"
    steps = [
        f"""totals as (select query_id, memory_id, {TOTAL} as s from scored),
        sc as materialized (select t.query_id, t.memory_id, t.s, m.embedding::double[] as e, {ids.replace("content", "m.content")} as ids from totals t join m using (memory_id)),
        best as (select query_id, case when max(s) > 0 then max(s) else 1.0 end as top from sc group by 1),
        c1 as materialized (select query_id, memory_id, 1 as position from (select *, row_number() over (partition by query_id order by s desc, memory_id) as n from sc) where n = 1)"""
    ]
    for n in range(2, k + 1):
        steps.append(
            f"""c{n} as materialized (select * from c{n - 1} union all select query_id, memory_id, {n} from (select r.query_id, r.memory_id, row_number() over (partition by r.query_id order by
              round(0.7::double * r.s / b.top - (1::double - 0.7::double) * greatest(0::double, max(case when len(list_intersect(r.ids, h.ids)) > 0 then greatest(list_cosine_similarity(r.e, h.e), 1::double) else list_cosine_similarity(r.e, h.e) end)), 9) desc, r.memory_id) as n
             from sc r join best b using (query_id) join c{n - 1} x on x.query_id = r.query_id join sc h on h.query_id = x.query_id and h.memory_id = x.memory_id
             where not exists (select 1 from c{n - 1} y where y.query_id = r.query_id and y.memory_id = r.memory_id) group by r.query_id, r.memory_id, r.s, b.top) where n = 1)"""
        )
    return _ctes("scored") + ", " + ", ".join(steps) + f" select query_id, memory_id, position from c{k}"


ORACLE["recall_mmr"] = _mmr_sql()

NEAR_SQL = f""", f as ({FRESH}), s as ({STORED} and {ALIVE}),
  n0 as (select f.memory_id as query_id, s.memory_id, s.layer, round(list_cosine_similarity(f.embedding::double[], s.embedding::double[]), 6) as similarity from f join s on s.agent_id = f.agent_id),
  n1 as (select *, row_number() over (partition by query_id order by similarity desc, memory_id) as rank from n0),
  n2 as (select *, row_number() over (partition by query_id order by rank) as n from n1 where rank <= 30 and layer = 'Derived'),
  near as (select query_id, memory_id, similarity, 1 as source, n::double as key from n2 where n <= 20),
  few as (select memory_id as query_id, agent_id, {PAIRS.format("content")} as g from f where memory_id not in (select query_id from near group by 1 having count(*) >= 5) and length(content) >= 2),
  held as (select memory_id, agent_id, {PAIRS.format("content")} as g from s where layer = 'Derived' and length(content) >= 2),
  words as (select query_id, memory_id, round(len(list_intersect(few.g, held.g)) / len(few.g), 6) as similarity, 2 as source from few join held using (agent_id)),
  times as (select f.memory_id as query_id, s.memory_id, 0.5::double as similarity, 3 as source, -s.created_at::double as key from f join s on s.agent_id = f.agent_id and s.layer = 'Derived'
    where regexp_matches(f.content, '已执行|已完成|已上线|执行成功|已发布|已部署') and regexp_matches(s.content, '最近|当前|目前|最新|现在|刚才')),
  every as (select * from near union all select query_id, memory_id, similarity, source, -similarity from words where similarity >= 0.30 union all select * from times),
  once as (select * from every qualify row_number() over (partition by query_id, memory_id order by source) = 1),
  hood as (select query_id, memory_id, similarity, source, row_number() over (partition by query_id order by source, key, memory_id) as place from once qualify place <= 20)"""
ORACLE["reconcile_neighbourhood"] = _ctes("m") + NEAR_SQL + " select query_id, memory_id, similarity, source, place from hood"

_RECALL = "case when length({a}) >= 2 then len(list_intersect({pa}, case when length({b}) >= 2 then {pb} else [] end)) / len({pa}) else 0 end"
_NEGATED = "regexp_matches({c}, '不再|不是|没有|no longer|not anymore|stopped|cancelled')"


def _alike_sql() -> str:
    one = _RECALL.format(a="f.content", b="o.content", pa=PAIRS.format("f.content"), pb=PAIRS.format("o.content"))
    two = _RECALL.format(a="o.content", b="f.content", pa=PAIRS.format("o.content"), pb=PAIRS.format("f.content"))
    return f"greatest({one}, {two})"


DECIDE_SQL = (
    NEAR_SQL
    + f""", k0 as (select *, row_number() over (partition by query_id order by similarity desc, place) as n from hood where similarity >= 0.25 qualify n <= 15),
  j0 as (select k.query_id, k.memory_id, k.similarity, k.n, f.content = o.content as same, {_NEGATED.format(c="f.content")} and not {_NEGATED.format(c="o.content")} as denied,
    f.created_at >= o.created_at as newer, {_alike_sql()} as alike from k0 k join m f on f.memory_id = k.query_id join m o on o.memory_id = k.memory_id),
  j as (select *, case when same then 'REINFORCE' when denied and newer then 'RETRACT' when similarity >= 0.40 then 'REINFORCE' when alike >= 0.60 and newer then 'REPLACE' when alike >= 0.60 then 'NOOP' else 'ADD' end as op from j0),
  j1 as (select * from j where op <> 'ADD'), first as (select query_id, arg_min(op, n) as op from j1 group by 1),
  chosen as (select query_id, op, list_sort(list(memory_id)) as ids, max(similarity) as similarity from j1 join first using (query_id, op) group by 1, 2),
  decided as (select f.memory_id as query_id, coalesce(op, 'ADD') as op, case when coalesce(op, 'ADD') in ('ADD', 'NOOP') then []::bigint[] else ids end as ids, c.similarity from f left join chosen c on c.query_id = f.memory_id)"""
)
ORACLE["reconcile_decide"] = _ctes("m") + DECIDE_SQL + " select query_id, op, array_to_string(ids, ',') as target_ids, similarity from decided"
ORACLE["reconcile_apply"] = (
    _ctes("m")
    + DECIDE_SQL
    + f""", hit as (select d.query_id, d.op, t.memory_id as target, q.parent_id as raw, q.created_at as fact_at, t.parent_id as old_raw, t.created_at as old_at, rq.created_at as raw_at, rt.created_at as old_raw_at
    from (select query_id, op, unnest(ids) as target from decided) d join m q on q.memory_id = d.query_id join m t on t.memory_id = d.target and t.{ALIVE}
    left join m rq on rq.memory_id = q.parent_id left join m rt on rt.memory_id = t.parent_id),
  turned as (select *, op = 'REPLACE' and raw <> 0 and old_raw <> 0 and coalesce(old_raw_at > raw_at, false) as late from hit),
  struck as (select target as id from turned where op = 'REPLACE' and not late union select old_raw from turned where op = 'REPLACE' and not late union select query_id from turned where late union select raw from turned where late
    union select target from turned where op = 'RETRACT' and old_at <= fact_at union select query_id from turned where op = 'RETRACT' and old_at <= fact_at union select query_id from decided where op in ('REINFORCE', 'NOOP')),
  up as (select target, 0.1 * count(*) as delta from turned where op = 'REINFORCE' group by 1)
  select m.memory_id, case when m.memory_id in (select id from struck where id <> 0) then 'Tombstone' else m.phase end as phase,
   round(case when u.delta is not null and m.{ALIVE} then least(greatest(m.importance + u.delta, 0), 1) else m.importance end, 6) as importance from m left join up u on u.target = m.memory_id"""
)


# ---- further operators


@query(_ctes("m") + " , v as (select * from m where memory_id % 50 = 0) select memory_id, parent_id, case when memory_id % 50 = 0 then 'Versioned' else phase end as phase from m union all select memory_id + 1000000, memory_id, 'Active' from v")
def version_update(spark, sf):
    rows = fx.memories(spark, sf)
    updates = rows.where("memory_id % 50 = 0").select("memory_id", (F.col("memory_id") + 1_000_000).alias("new_id"), F.lit("another text").alias("content"))
    return lifecycle.new_versions(rows, updates, NOW).select("memory_id", "parent_id", "phase")


@query(
    _ctes("m", "q")
    + """, s as (select q.query_id, m.memory_id, round(list_cosine_similarity(q.embedding::double[], m.embedding::double[]), 6) as similarity from q join m using (agent_id))
      select *, row_number() over (partition by query_id order by similarity desc, memory_id) as rank from s qualify rank <= 10"""
)
def search_simple(spark, sf):
    rows, asked, _ = _tables(spark, sf)
    return recall.simple_search(asked, rows)


@query(_ctes("m") + f" select memory_id, case when agent_id = 'agent-2' and {ALIVE} then 'Tombstone' else phase end as phase from m")
def agent_delete(spark, sf):
    rows, _, edges = _tables(spark, sf)
    return lifecycle.delete_agent(rows, edges, "agent-2")[0].select("memory_id", "phase")


@query(_ctes("m", "edges", "stream") + f", a as (select memory_id from m where agent_id = 'agent-2' and {ALIVE}) select from_id, to_id, type from edges where from_id not in (select memory_id from a) and to_id not in (select memory_id from a)")
def agent_delete_edges(spark, sf):
    rows, _, edges = _tables(spark, sf)
    return lifecycle.delete_agent(rows, edges, "agent-2")[1].select("from_id", "to_id", "type")


@query(
    _ctes("m")
    + f""" select count(*) filter ({ALIVE}) as active, count(*) filter (not {ALIVE}) as deleted, count(*) filter ({ALIVE} and tier <> 'long_term') as hot, count(*) filter ({ALIVE} and tier = 'long_term') as cold from m"""
)
def index_totals(spark, sf):
    return browse.index_counts(fx.memories(spark, sf))


@query(_ctes("ev") + " select status, count(*) as n from ev group by 1")
def decision_totals(spark, sf):
    return browse.decision_counts(fx.events(spark, sf), "status")


@query(_ctes("m") + " select memory_id, min(agent_id) as agent_id from m where memory_id in (select user_id + 1 from events) group by 1")
def owner_lookup(spark, sf):
    ids = fx.table(spark, sf, "events").select((F.col("user_id") + 1).alias("memory_id")).distinct()
    return browse.owners_of(ids, fx.memories(spark, sf))


@query(
    _ctes("m")
    + f""", b as (select f.memory_id as query_id, max(round(list_cosine_similarity(f.embedding::double[], s.embedding::double[]), 6)) as sim from ({FRESH}) f join ({STORED}) s on s.agent_id = f.agent_id and s.{ALIVE} group by 1)
      select f.memory_id as query_id, coalesce(b.sim >= 0.30, false) as is_duplicate from ({FRESH}) f left join b on b.query_id = f.memory_id"""
)
def duplicate_test(spark, sf):
    fresh, stored = _facts(fx.memories(spark, sf))
    return similarity.duplicates(fresh, stored.where(filters.is_alive()), 0.30)


@query(_ctes("edges") + " select from_id, to_id, type, (select count(*) from edges) as total from edges order by weight desc, from_id, to_id, type limit 25 offset 25")
def graph_page(spark, sf):
    edges = graph.upserted(fx.edge_stream(spark, sf))
    return browse.page(edges, 2, 25, [F.desc("weight"), F.col("from_id"), F.col("to_id"), F.col("type")]).select("from_id", "to_id", "type", "total")


@query(
    _ctes("m")
    + """ select a.memory_id, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 4) as inner_product, round(list_distance(a.embedding::double[], b.embedding::double[]), 4) as l2,
       round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) as cosine from m a join m b on b.memory_id = a.memory_id + 1"""
)
def vector_distances(spark, sf):
    rows = fx.memories(spark, sf).select("memory_id", "embedding")
    after = rows.select((F.col("memory_id") - 1).alias("memory_id"), F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    both = rows.join(after, "memory_id")
    return both.select("memory_id", F.round(vectors.inner(a, b), 4).alias("inner_product"), F.round(F.sqrt(vectors.squared_l2(a, b)), 4).alias("l2"), F.round(vectors.cosine(a, b), 4).alias("cosine"))


SESSION_LOG = """
select 'start' as op, conv_id as session_id, 'agent-1' as agent_id, concat('user-', cast(conv_id % 5 as string)) as user_id, cast(0 as bigint) as at, cast(null as string) as intent, cast(null as bigint) as touched
 from {conversations} where turn = 0
union all select 'turn', conv_id, null, null, cast(turn + 1 as bigint), role, cast(conv_id + turn as bigint) from {conversations}
union all select 'close', conv_id, null, null, cast(100 as bigint), null, null from {conversations} where turn = 0 and conv_id % 3 = 0
"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(SESSION_LOG, conversations=fx.table(spark, sf, "conversations"))
    return rows.withColumn("memory_ids", F.when(F.col("touched").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("touched"))).drop("touched")


SESSIONS = f""" l as ({SESSION_LOG.format(conversations="conversations")}),
  sess as (select session_id, max(user_id) as user_id, max(case when op <> 'close' then l."at" end) as last_turn_at, count(*) filter (op = 'turn') as turn_count, count(*) filter (op = 'close') = 0 as active,
    coalesce(arg_max(intent, case when op = 'turn' then l."at" end), '') as current_intent, list_sort(list_distinct(list(touched) filter (touched is not null))) as ids from l group by 1 having count(*) filter (op = 'start') > 0)"""


@query("with" + SESSIONS + " select session_id, user_id, last_turn_at, turn_count, active, current_intent, array_to_string(ids, ',') as memory_ids from sess")
def session_fold(spark, sf):
    rows = sessions.folded(_log(spark, sf))
    return rows.select("session_id", "user_id", "last_turn_at", "turn_count", "active", "current_intent", F.array_join(F.col("memory_ids").cast("array<string>"), ",").alias("memory_ids"))


@query(_ctes("m") + "," + SESSIONS + ", u as (select session_id, unnest(ids) as memory_id from sess) select s.session_id, count(m.memory_id) as memories from sess s left join u using (session_id) left join m on m.memory_id = u.memory_id group by 1")
def session_memories(spark, sf):
    return sessions.resolved(sessions.folded(_log(spark, sf)), fx.memories(spark, sf))


@query(
    "with"
    + SESSIONS
    + """ select session_id from sess where not active and 3605 - last_turn_at <= 3600 union all
      select session_id from (select session_id from sess where active order by last_turn_at desc, session_id limit 100)"""
)
def session_expiry(spark, sf):
    return sessions.expired(sessions.folded(_log(spark, sf)), 3605, most=100).select("session_id")


@query(_ctes("m") + " select memory_id, content, round(importance, 6) as importance, case when phase = 'Invalidated' then 'Active' else phase end as phase, tier from m")
def json_round_trip(spark, sf):
    path = f"{shared_dir(spark)}/palimpsest-json-{uuid.uuid4().hex}"
    jsonl.export(fx.memories(spark, sf), path)
    return jsonl.import_memories(spark, path).select("memory_id", "content", F.round("importance", 6).alias("importance"), "phase", "tier")


@query(_ctes("m") + " select memory_id, case when memory_id % 4 = 0 then 'rewritten' else content end as content from m where memory_id % 7 <> 0 and phase <> 'Tombstone'")
def store_log(spark, sf):
    """Three batches in an append log: all rows, a rewrite of some, a removal of others."""
    rows, path = fx.memories(spark, sf), f"{shared_dir(spark)}/palimpsest-log-{uuid.uuid4().hex}"
    store.append(rows, path, 1)
    store.append(rows.where("memory_id % 4 = 0").withColumn("content", F.lit("rewritten")), path, 2)
    store.append(lifecycle.marked(rows.where("memory_id % 7 = 0"), rows, "Tombstone"), path, 3)
    # a Tombstone of the fixture that was rewritten alone stays one
    return store.live(store.log(spark, path)).select("memory_id", "content")
