"""Capture: noise, requests to forget, novelty gate, derived facts and reconciliation.

A batch is judged against the store as it was; ordering inside a batch is by
(created_at, memory_id), and a streaming caller keeps one writer per micro-batch.
Verdicts a language model would give come from pluggable functions; the defaults
are rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scores, text
from palimpsest.operators import similarity
from palimpsest.operators.filters import is_alive
from palimpsest.operators.graph import similarity_edges
from palimpsest.operators.lifecycle import boosted, marked
from palimpsest.operators.wording import alike_pairs, most_shared, with_alike
from palimpsest.schema import complete
from palimpsest.storage import materialize


@dataclass(frozen=True)
class ReconcileConfig:
    floor: float = 0.70
    most: int = 15
    nearest: int = 30
    pool: int = 20
    few: int = 5
    bigram: float = 0.30
    temporal_similarity: float = 0.50
    reinforce: float = 0.95
    replace_overlap: float = 0.60
    sibling: float = 0.35
    raw_sibling: float = 0.85
    siblings: int = 4


# Cues of the default rule judge.
NEGATIONS = ("不再", "不是", "没有", "no longer", "not anymore", "stopped", "cancelled")

MARKS_SENT = 1_000_000  # so many ids are sent to every task, and the rows that they mark stay where they are


# Reasons of the gate, which clients read.
REASONS = {
    "noise": "Transient/noise content (greeting, acknowledgment, etc.)",
    "duplicate": "Near-duplicate of memory #%d (similarity=%.6f)",
    "low": "Low marginal value (%.6f)",
    "unsure": "Uncertain marginal value (%.6f)",
    "enough": "Sufficient marginal value (%.6f)",
}


def intake(rows: DataFrame) -> DataFrame:
    """Adds ``route``: transient rows are dropped, forget requests act, the rest is stored."""
    route = F.when(text.is_transient(F.col("content")), "drop").when(text.is_forget_request(F.col("content")), "forget").otherwise("store")
    return rows.withColumn("route", route)


def forgotten(requests: DataFrame, memories: DataFrame, least: float = 0.30, most: int = 20) -> DataFrame:
    """memory_id of living same-agent rows that requests (query_id, agent_id, embedding) ask to forget."""
    alive = memories.where(is_alive())
    return similarity.topk_join(requests, alive, most, least).select("memory_id").distinct()


def gate(candidates: DataFrame, memories: DataFrame, config: scores.GateConfig = scores.GateConfig()) -> DataFrame:
    """decision, marginal_value, source_tier and reason of each candidate.

    ``candidates``: query_id, content, embedding, agent_id, source_tier, importance.
    """
    alive = memories.where(is_alive())
    ranked = similarity.topk_join(candidates, alive, config.neighbours)
    best = ranked.where("rank = 1").select("query_id", F.col("memory_id").alias("nearest_id"), F.col("similarity").alias("max_similarity"))
    rows = candidates.join(best, "query_id", "left")
    similar = F.col("max_similarity")
    noise, duplicate = text.is_transient(F.col("content")), F.coalesce(similar >= config.duplicate, F.lit(False))
    value = F.when(noise | duplicate, 0.0).otherwise(F.round(scores.marginal_value(similar, F.col("source_tier"), F.col("importance")), 6))
    rows = rows.withColumns({"noise": noise, "duplicate": duplicate, "marginal_value": value})
    value = F.col("marginal_value")
    decision = F.when(F.col("noise") | F.col("duplicate") | (value < config.low_value), "Rejected").when(value < config.deferred, "Deferred").otherwise("Accepted")
    reason = (
        F.when(F.col("noise"), REASONS["noise"])
        .when(F.col("duplicate"), F.format_string(REASONS["duplicate"], "nearest_id", similar))
        .when(value < config.low_value, F.format_string(REASONS["low"], value))
        .when(value < config.deferred, F.format_string(REASONS["unsure"], value))
        .otherwise(F.format_string(REASONS["enough"], value))
    )
    if config.shadow:
        would = F.when(decision == "Deferred", "defer").otherwise("reject")
        reason = F.when(decision == "Accepted", reason).otherwise(F.concat(reason, F.lit(" [shadow: would "), would, F.lit("]")))
        decision = F.lit("Accepted")
    tier = text.source_tier(F.col("content"), F.col("source_tier"))
    return rows.select("query_id", decision.alias("decision"), "marginal_value", tier.alias("classified_tier"), reason.alias("reason"), "nearest_id", "max_similarity", "duplicate", "noise")


def derive(facts: DataFrame, memories: DataFrame, now: int, config: scores.GateConfig = scores.GateConfig()) -> tuple[DataFrame, DataFrame]:
    """Derived rows of facts, and their lineage (child_id, parent_ids, op, created_at).

    ``facts``: query_id (the new row's id), raw_id, content, embedding, agent_id,
    user_id, scope, memory_type, source_tier, importance.  Near-duplicates and facts
    of low value are put off, not rejected, so that reconciliation sees them; the gate
    is not told a fact's source.
    """
    judged = gate(facts.withColumn("source_tier", F.lit("Inference")), memories, config).select("query_id", "decision", "reason", "marginal_value", "noise")
    rows = facts.join(judged, "query_id")
    put_off = (F.col("decision") == "Rejected") & ~F.col("noise")
    decision = F.when(put_off, "Deferred").otherwise(F.col("decision"))
    rows = rows.withColumn("gate_decision", decision).where("gate_decision <> 'Rejected'")
    derived = rows.select(
        F.col("query_id").alias("memory_id"), "content", "agent_id", "user_id", "scope", "memory_type", F.lit("short_term").alias("tier"),
        F.lit("Active").alias("phase"), F.lit("Derived").alias("layer"), "source_tier", "importance",
        F.when(F.col("gate_decision") == "Deferred", "Stale").otherwise("Inferred").alias("confidence_level"),
        "gate_decision", "marginal_value", "reason", F.col("raw_id").alias("parent_id"), "embedding",
        F.lit(now).cast("long").alias("created_at"),
    )
    lineage = derived.select(F.col("memory_id").alias("child_id"), F.array("parent_id").alias("parent_ids"), F.lit("Infer").alias("op"), "created_at")
    return derived, lineage


def neighbourhood(facts: DataFrame, memories: DataFrame, config: ReconcileConfig = ReconcileConfig()) -> DataFrame:
    """query_id, memory_id, similarity, source, place: what a fact is weighed against.

    First derived living rows among the nearest; if they are few, rows that share
    bigrams, of which a running best is kept; for completions also rows that
    speak of the present, newest first.  A row counts by its first source.
    """
    derived = memories.where(is_alive() & (F.col("layer") == "Derived"))
    near = similarity.topk_join(facts, memories.where(is_alive()), config.nearest, skip_self=True)
    near = near.join(derived.select("memory_id"), "memory_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= config.pool)
    near = materialize(near.select("query_id", "memory_id", "similarity", F.lit(1).alias("source"), F.col("n").cast("double").alias("key")), "near")
    few = facts.select("query_id", "agent_id", "content").join(near.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").where(F.coalesce("have", F.lit(0)) < config.few)
    wanted = few.select(F.col("query_id").alias("text_id"), "agent_id", "content")
    # of a fact's rows fewer than `few` are taken already, so that its best `pool` and as many more are enough
    shared = most_shared(derived.select("memory_id", "agent_id", "content"), wanted, config.bigram, config.pool + config.few)
    words = shared.withColumnRenamed("text_id", "query_id").where(F.col("similarity") >= config.bigram)
    words = words.select("query_id", "memory_id", "similarity", F.lit(2).alias("source"), (-F.col("similarity")).alias("key"))
    done = facts.where(text.any_of(F.col("content"), text.COMPLETION_MARKERS)).select("query_id", "agent_id")
    current = derived.where(text.any_of(F.col("content"), text.RECENT_MARKERS)).select("memory_id", "agent_id", "created_at")
    # a fact takes `pool` rows at most, of which fewer are taken already: the agent's newest few are enough
    newest = Window.partitionBy("agent_id").orderBy(F.desc("created_at"), "memory_id")
    current = current.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= 2 * config.pool + 1).drop("k")
    times = done.join(current, "agent_id").where("query_id <> memory_id")
    times = times.select("query_id", "memory_id", F.lit(config.temporal_similarity).alias("similarity"), F.lit(3).alias("source"), (-F.col("created_at")).cast("double").alias("key"))
    every = near.unionByName(words).unionByName(times)
    first = Window.partitionBy("query_id", "memory_id").orderBy("source")
    place = Window.partitionBy("query_id").orderBy("source", "key", "memory_id")
    once = every.withColumn("_first", F.row_number().over(first)).where("_first = 1")
    return once.withColumn("place", F.row_number().over(place)).where(F.col("place") <= config.pool).select("query_id", "memory_id", "similarity", "source", "place")


def rule_judge(rows: DataFrame, config: ReconcileConfig = ReconcileConfig()) -> DataFrame:
    """Adds ``op`` for a fact and one neighbour: an approximation of a model's verdict, by rules.

    ``rows``: similarity, fact, fact_at, old, old_at.
    """
    same = F.col("fact") == F.col("old")
    denied = text.any_of(F.col("fact"), NEGATIONS) & ~text.any_of(F.col("old"), NEGATIONS)
    rows = with_alike(rows, _open(same, denied, config))
    return rows.withColumn("op", _verdict(same, denied, config)).drop("alike")


def _newer() -> Column:
    return F.col("fact_at") >= F.col("old_at")


def _open(same: Column, denied: Column, config: ReconcileConfig) -> Column:
    """Pairs that only a comparison of their texts decides."""
    near, false = F.col("similarity") >= config.reinforce, F.lit(False)
    return ~(F.coalesce(same, false) | F.coalesce(near, false) | F.coalesce(denied & _newer(), false))


def _verdict(same: Column, denied: Column, config: ReconcileConfig) -> Column:
    alike = F.col("alike")
    return (
        F.when(same, "REINFORCE")
        .when(denied & _newer(), "RETRACT")
        .when(F.col("similarity") >= config.reinforce, "REINFORCE")
        .when((alike >= config.replace_overlap) & _newer(), "REPLACE")
        .when(alike >= config.replace_overlap, "NOOP")
        .otherwise("ADD")
    )


def judged_pairs(pairs: DataFrame, facts: DataFrame, memories: DataFrame, config: ReconcileConfig = ReconcileConfig(), judge: Callable[[DataFrame, ReconcileConfig], DataFrame] = rule_judge) -> DataFrame:
    """``pairs`` (query_id, memory_id, similarity, ...) with ``op`` as ``judge`` has it.

    ``facts``: query_id, content, created_at; ``memories``: memory_id, content, created_at.  The
    rules see what they ask of a single text as a hash and a flag, made where the text lies; only
    pairs that these leave open have their texts brought together.
    """
    names = [c for c in pairs.columns if c not in ("query_id", "memory_id")]
    if judge is not rule_judge:
        old = memories.select("memory_id", F.col("content").alias("old"), F.col("created_at").alias("old_at"))
        fact = facts.select("query_id", F.col("content").alias("fact"), F.col("created_at").alias("fact_at"))
        return judge(pairs.join(old, "memory_id").join(fact, "query_id"), config).select("query_id", "memory_id", *names, "op")
    said, denies = F.unhex(F.sha2("content", 256)), text.any_of(F.col("content"), NEGATIONS)
    old = memories.select("memory_id", said.alias("old"), denies.alias("old_denies"), F.col("created_at").alias("old_at"))
    fact = facts.select("query_id", said.alias("fact"), denies.alias("fact_denies"), F.col("created_at").alias("fact_at"))
    same, denied = F.col("fact") == F.col("old"), F.col("fact_denies") & ~F.col("old_denies")
    rows = pairs.join(old, "memory_id").join(fact, "query_id").withColumns({"same": same, "denied": denied})
    rows = materialize(rows.drop("old", "fact", "old_denies", "fact_denies"), "pairs")
    same, denied = F.col("same"), F.col("denied")
    alike = alike_pairs(rows.where(_open(same, denied, config)), facts.select("query_id", "content"), memories)
    rows = rows.join(alike, ["query_id", "memory_id"], "left").fillna(0.0, "alike")
    return rows.withColumn("op", _verdict(same, denied, config)).select("query_id", "memory_id", *names, "op")


def decide(facts: DataFrame, memories: DataFrame, config: ReconcileConfig = ReconcileConfig(), judge: Callable[[DataFrame, ReconcileConfig], DataFrame] = rule_judge, raw: DataFrame | None = None) -> DataFrame:
    """query_id, op, target_ids, similarity: what becomes of each fact.

    ``facts``: query_id, content, embedding, agent_id, created_at.  Neighbours below
    the floor do not count; without any the fact is added.  The strongest neighbour
    with a verdict other than ADD decides, and all with the same verdict are targets.
    ``raw`` (query_id, raw_content) lets a replacement be refused where the source
    speaks of the past and the fact does not.
    """
    near = neighbourhood(facts, memories, config).where(F.col("similarity") >= config.floor)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "place")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= config.most)
    derived = memories.where(is_alive() & (F.col("layer") == "Derived"))  # a neighbourhood has no other rows
    judged = materialize(judged_pairs(near, facts, derived, config, judge).where("op <> 'ADD'").select("query_id", "memory_id", "similarity", "n", "op"), "judged")
    first = judged.groupBy("query_id").agg(F.min_by("op", "n").alias("first_op"))
    same = judged.join(first, "query_id").where("op = first_op").groupBy("query_id").agg(
        F.first("op").alias("op"), F.array_sort(F.collect_list("memory_id")).alias("target_ids"), F.max("similarity").alias("similarity")
    )
    out = facts.select("query_id").join(same, "query_id", "left")
    op = F.coalesce("op", F.lit("ADD"))
    if raw is not None:
        stripped = text.any_of(F.col("raw_content"), text.PAST_QUALIFIERS) & ~text.any_of(F.col("content"), text.PAST_QUALIFIERS)
        out = out.join(raw.join(facts.select("query_id", "content"), "query_id").select("query_id", stripped.alias("stripped")), "query_id", "left")
        op = F.when((op == "REPLACE") & F.coalesce("stripped", F.lit(False)), "NOOP").otherwise(op)
    return out.withColumn("op", op).select("query_id", "op", F.when(F.col("op").isin("ADD", "NOOP"), F.array().cast("array<bigint>")).otherwise(F.coalesce("target_ids", F.array().cast("array<bigint>"))).alias("target_ids"), "similarity")


def apply(memories: DataFrame, edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories and edges after decisions; ``memories`` already holds the facts.

    A replaced fact and its source are tombstoned and linked by Supersedes; if the
    target's source is newer than the fact's, the fact and its source go instead and the
    link is reversed.  Retractions spare targets newer than the fact and take the fact
    along once anything went.  Reinforced targets gain 0.1 importance.
    """
    decisions = materialize(decisions, "decisions")  # read for every kind of outcome
    facts = memories.select(F.col("memory_id").alias("query_id"), F.col("parent_id").alias("raw_id"), F.col("created_at").alias("fact_at"))
    targets = memories.select(F.col("memory_id").alias("target_id"), F.col("parent_id").alias("old_raw_id"), F.col("created_at").alias("old_at"), is_alive().alias("alive"))
    times = memories.select("memory_id", "created_at")
    rows = decisions.select("query_id", "op", F.explode("target_ids").alias("target_id")).join(facts, "query_id").join(targets, "target_id").where("alive")
    rows = rows.join(times.withColumnsRenamed({"memory_id": "raw_id", "created_at": "raw_at"}), "raw_id", "left")
    rows = rows.join(times.withColumnsRenamed({"memory_id": "old_raw_id", "created_at": "old_raw_at"}), "old_raw_id", "left")
    late = (F.col("raw_id") != 0) & (F.col("old_raw_id") != 0) & F.coalesce(F.col("old_raw_at") > F.col("raw_at"), F.lit(False))
    replaced = rows.where("op = 'REPLACE'").withColumn("late", late)
    retracted = rows.where((F.col("op") == "RETRACT") & (F.col("old_at") <= F.col("fact_at")))
    ids = lambda df, c: df.where(F.col(c) != 0).select(F.col(c).alias("memory_id"))
    kept, turned = replaced.where("not late"), replaced.where("late")
    dropped = decisions.where(F.col("op").isin("REINFORCE", "NOOP"))
    gone = ids(kept, "target_id")
    for df, c in ((kept, "old_raw_id"), (turned, "query_id"), (turned, "raw_id"), (retracted, "target_id"), (retracted, "query_id"), (dropped, "query_id")):
        gone = gone.unionByName(ids(df, c))
    after = boosted(memories, rows.where("op = 'REINFORCE'").select(F.col("target_id").alias("memory_id"), F.lit(0.1).alias("delta")))
    link = lambda df, a, b: df.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"), F.lit("Supersedes").alias("type"), F.lit(1.0).alias("weight"), F.col("fact_at").alias("created_at"))
    drawn = link(kept, "query_id", "target_id").unionByName(link(turned, "target_id", "query_id"))
    return marked(after, gone, "Tombstone"), edges.select("from_id", "to_id", "type", "weight", "created_at").unionByName(drawn)


def siblings(decisions: DataFrame, facts: DataFrame, memories: DataFrame, config: ReconcileConfig = ReconcileConfig(), judge=rule_judge) -> DataFrame:
    """memory_id of rows close to a replaced or retracted one that fall with it.

    Older living rows of the same agent: a raw one very close to a replaced fact, and
    of derived ones the closest few that the judge would replace or retract too.
    """
    struck = decisions.where(F.col("op").isin("REPLACE", "RETRACT")).select("query_id", "op", F.explode("target_ids").alias("target_id"))
    olds = struck.join(memories.select(F.col("memory_id").alias("target_id"), "embedding", "agent_id"), "target_id")
    probes = olds.select(F.col("target_id").alias("query_id"), "embedding", "agent_id").dropDuplicates(["query_id"])
    near = similarity.topk_join(probes, memories, 20, config.sibling).withColumnRenamed("query_id", "target_id")
    rows = struck.join(near, "target_id").join(struck.select("query_id", F.col("target_id").alias("memory_id")), ["query_id", "memory_id"], "left_anti")
    rows = rows.where("memory_id < query_id").groupBy("query_id", "op", "memory_id").agg(F.max("similarity").alias("similarity"))
    rows = rows.join(memories.where(is_alive()).select("memory_id", "layer", F.col("content").alias("old"), F.col("created_at").alias("old_at")), "memory_id")
    raw = rows.where((F.col("layer") == "Raw") & (F.col("op") == "REPLACE") & (F.col("similarity") >= config.raw_sibling)).select("memory_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "memory_id")
    derived = rows.where("layer = 'Derived'").withColumn("n", F.row_number().over(order)).where(F.col("n") <= config.siblings).drop("op")
    fact = facts.select("query_id", F.col("content").alias("fact"), F.col("created_at").alias("fact_at"))
    judged = judge(derived.join(fact, "query_id"), config).where(F.col("op").isin("REPLACE", "RETRACT")).select("memory_id")
    return raw.unionByName(judged).distinct()


# A fact's text and weight; by default each row's own text is its one fact, as for input that was taken apart before.
Extract = Callable[[Column], Column]


def whole_text(content: Column) -> Column:
    return F.array(F.struct(content.alias("content"), F.lit(0.5).alias("importance")))


def is_echo() -> Column:
    """An assistant's own words: stored and searchable, but nothing is derived from them."""
    return F.coalesce(F.col("user_metadata")["role"] == "assistant", F.lit(False))


def extracted(raws: DataFrame, fact_id: Callable[[Column, Column], Column], extract: Extract = whole_text, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Facts of captured rows, none of an assistant's: query_id, raw_id, content, embedding and the row's fields.

    ``fact_id``: the new row's id from the row's id and the fact's number; ``embed``: the fact's
    vector from its text, by default the row's own.
    """
    each = raws.where(~is_echo()).select("*", F.posexplode(extract(F.col("content"))).alias("_n", "_fact"))
    each = each.where(F.coalesce(F.col("_fact.content"), F.lit("")) != "")
    vector = F.col("embedding") if embed is None else embed(F.col("_fact.content"))
    changes = {"content": F.col("_fact.content"), "importance": F.col("_fact.importance"), "embedding": vector}
    kept = [changes[c].alias(c) if c in changes else F.col(c) for c in ("content", "embedding", "agent_id", "user_id", "scope", "memory_type", "source_tier", "importance")]
    return each.select(fact_id(F.col("memory_id"), F.col("_n")).cast("long").alias("query_id"), F.col("memory_id").alias("raw_id"), *kept)


@dataclass(frozen=True)
class CaptureConfig:
    gate: scores.GateConfig = scores.GateConfig()
    reconcile: ReconcileConfig = ReconcileConfig()
    conflict: float = 0.85
    related: float = 0.5
    forget: float = 0.30


@dataclass(frozen=True)
class Captured:
    """Tables after a batch, and what became of each incoming row."""

    memories: DataFrame
    edges: DataFrame
    lineage: DataFrame
    outcomes: DataFrame  # memory_id, outcome: drop, forget, echo, or the gate's decision on its (first) fact
    decisions: DataFrame  # query_id, op, target_ids, similarity of each fact kept


def run(
    incoming: DataFrame, memories: DataFrame, edges: DataFrame, now: int, fact_id: Callable[[Column, Column], Column],
    config: CaptureConfig = CaptureConfig(), extract: Extract = whole_text, embed: Callable[[Column], Column] | None = None, judge=rule_judge,
) -> Captured:
    """A batch end to end: noise goes, requests to forget act, the rest is stored, derived and reconciled.

    ``incoming``: columns of the memories, with vectors; ``memories`` is read several times and is
    best a stored table.  The batch is judged against the store as it was after its requests to forget.
    """
    columns = memories.columns
    routed = materialize(intake(incoming), "routed")
    requests = routed.where("route = 'forget'").select(F.col("memory_id").alias("query_id"), "agent_id", "embedding")
    gone = materialize(forgotten(requests, memories, config.forget), "gone")
    few = gone.count() <= MARKS_SENT
    kept = marked(memories, F.broadcast(gone) if few else gone, "Tombstone")
    kept = kept if few else materialize(kept, "kept")  # the few are told while the store is read, and it is not written anew
    raws = complete(routed.where("route = 'store'").drop("route")).withColumns({"tier": F.lit("working"), "phase": F.lit("Active"), "layer": F.lit("Raw"), "confidence_level": F.lit("Inferred")})
    raws = materialize(raws.select(*columns), "raws")
    facts = materialize(extracted(raws, fact_id, extract, embed), "facts")
    derived, lineage = derive(facts, kept, now, config.gate)
    derived = materialize(derived, "derived")
    new = complete(derived).withColumn("last_accessed", F.col("created_at")).select(*columns)
    asked = derived.select(F.col("memory_id").alias("query_id"), "agent_id", "content", "embedding", "created_at")
    sources = asked.select("query_id").join(derived.select(F.col("memory_id").alias("query_id"), "parent_id"), "query_id")
    sources = sources.join(raws.select(F.col("memory_id").alias("parent_id"), F.col("content").alias("raw_content")), "parent_id").select("query_id", "raw_content")
    decisions = materialize(decide(asked, kept, config.reconcile, judge, sources), "decisions")
    drawn = derived.select(F.col("memory_id").alias("from_id"), F.col("parent_id").alias("to_id"), F.lit("DerivedFrom").alias("type"), F.lit(1.0).alias("weight"), "created_at")
    speakers = raws.where(~is_echo() & F.col("embedding").isNotNull())
    living = kept.where(is_alive()).select("memory_id", "agent_id", "embedding").unionByName(raws.select("memory_id", "agent_id", "embedding"))
    near = similarity.topk_join(speakers.withColumnRenamed("memory_id", "query_id"), living, 50)
    alike = similarity_edges(near, conflict=config.conflict, related=config.related).withColumn("created_at", F.lit(now).cast("long"))
    after, linked = apply(kept.unionByName(raws).unionByName(new), edges.unionByName(drawn).unionByName(alike), decisions)
    after = marked(after, siblings(decisions, asked, kept, config.reconcile, judge), "Tombstone")
    first = facts.groupBy("raw_id").agg(F.min("query_id").alias("query_id"))
    verdicts = first.join(derived.select(F.col("memory_id").alias("query_id"), "gate_decision"), "query_id", "left").select(F.col("raw_id").alias("memory_id"), F.coalesce("gate_decision", F.lit("Rejected")).alias("verdict"))
    echo = raws.where(is_echo()).select("memory_id", F.lit("echo").alias("echo"))
    said = routed.select("memory_id", "route").join(verdicts, "memory_id", "left").join(echo, "memory_id", "left")
    outcome = F.when(F.col("route") != "store", F.col("route")).otherwise(F.coalesce("echo", "verdict", F.lit("none")))
    return Captured(after, linked, lineage, said.select("memory_id", outcome.alias("outcome")), decisions)


def prompt_lines(near: DataFrame, memories: DataFrame, most_bytes: int = 200) -> DataFrame:
    """query_id and the lines that show a judge its neighbours."""
    line = F.format_string("id=%d created_at=%d sim=%.4f content=%s", "memory_id", "created_at", "similarity", text.preview(F.col("content"), most_bytes))
    rows = near.join(memories.select("memory_id", "created_at", "content"), "memory_id").select("query_id", "place", line.alias("line"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda r: r.line), "\n").alias("lines"))


def parsed_verdict(reply: Column) -> Column:
    """op, target_ids and rationale out of a reply's outermost braces; null if there are none."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.from_json(F.when(body != "", body), "op string, target_ids array<string>, target_id string, rationale string")
