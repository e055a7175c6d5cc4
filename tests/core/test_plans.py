"""Recall, capture and streams."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import NOW, memories

from palimpsest import fixtures as fx
from palimpsest.functions.scores import GateConfig
from palimpsest.operators import graph
from palimpsest.plans import capture, providers, recall
from palimpsest.sources import store
from palimpsest.streaming import pipelines


def test_mmr_prefers_the_different():
    score = np.array([0.95, 0.90, 0.85])
    vectors = np.array([[1, 0, 0, 0], [0.99, 0.01, 0, 0], [0, 0, 1, 0]], float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert recall.diverse(score, unit, [frozenset()] * 3, np.arange(3), 2, 0.7, None) == [0, 2]


def test_mmr_counts_a_shared_entity_as_equal():
    score, unit = np.array([0.9, 0.8, 0.7]), np.eye(3)
    entities = [frozenset({"QX401"}), frozenset({"QX401"}), frozenset()]
    assert recall.diverse(score, unit, entities, np.arange(3), 2, 0.7, None) == [0, 2]


def plain_mmr(score, unit, ids, k, lam):
    left, chosen = set(range(len(ids))), []
    first = min(left, key=lambda i: (-score[i], ids[i]))
    chosen.append(first)
    left.remove(first)
    while left and len(chosen) < k:
        value = {i: round(lam * score[i] / max(score) - (1 - lam) * max(0, *(float(unit[i] @ unit[j]) for j in chosen)), 9) for i in left}
        best = min(left, key=lambda i: (-value[i], ids[i]))
        chosen.append(best)
        left.remove(best)
    return chosen


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 14), st.integers(1, 8), st.integers(0, 10_000))
def test_mmr_matches_its_definition(n, k, seed):
    rng = np.random.default_rng(seed)
    unit = rng.normal(size=(n, 3))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    score = np.round(rng.uniform(0.1, 1, n), 1)
    got = recall.diverse(score, unit, [frozenset()] * n, np.arange(n), k, 0.7, None)
    assert got == plain_mmr(score, unit, np.arange(n), k, 0.7) and len(set(got)) == len(got)


def test_runs_are_broken_up():
    assert recall.spread_runs([0, 1, 2, 3], ["x", "x", "x", "y"]) == [0, 1, 3, 2]
    assert recall.spread_runs([0, 1, 2], ["x", "x", "x"]) == [0, 1, 2]
    assert recall.spread_runs([0, 1, 2], ["", "", ""]) == [0, 1, 2]


def results(spark, rows):
    return spark.createDataFrame(rows, "query_id long, memory_id long, content string, created_at long")


def test_stale_aggregates(spark):
    rows = results(spark, [(1, 1, "QX401 QX402 QX403", 1000), (1, 2, "单号QX499已签收", 2000), (1, 3, "QX401", 500)])
    assert [r.memory_id for r in recall.stale_aggregates(rows).collect()] == [1]
    assert recall.drop_stale(rows).count() == 2
    known = results(spark, [(1, 1, "QX401 QX402 QX403", 1000), (1, 2, "QX402", 2000)])
    assert recall.drop_stale(known).count() == 2
    single = results(spark, [(1, 1, "QX401", 1000), (1, 2, "QX499", 2000)])
    assert recall.drop_stale(single).count() == 2


def old_versions(spark, rows):
    schema = "query_id long, memory_id long, position long, total_score double, created_at long, content string, embedding array<double>, lost boolean"
    return sorted(r.memory_id for r in recall.drop_old_versions(spark.createDataFrame(rows, schema)).collect())


def test_old_versions(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    assert old_versions(spark, [(1, 1, 1, 0.9, 20, "passport E8", v, False), (1, 2, 2, 0.8, 10, "旧 passport E7", v, False)]) == [1]
    assert old_versions(spark, [(1, 1, 1, 0.8, 10, "passport E8", v, False), (1, 2, 2, 0.8, 20, "former passport", v, False)]) == [2]
    assert old_versions(spark, [(1, 1, 1, 0.95, 10, "passport E8", v, False), (1, 2, 2, 0.8, 20, "former passport", v, False)]) == [1, 2]
    assert old_versions(spark, [(1, 1, 1, 0.9, 20, "passport", v, False), (1, 2, 2, 0.8, 10, "old dog", w, False)]) == [1, 2]
    assert old_versions(spark, [(1, 1, 1, 0.9, 20, "passport", v, True), (1, 2, 2, 0.8, 10, "old one", v, False)]) == [2]


def test_recall_end_to_end(spark, sf):
    rows = fx.memories(spark, sf)
    asked = fx.queries(rows).where("query_id <= 240")
    edges = graph.upserted(fx.edge_stream(spark, sf))
    out = recall.recall(asked, rows, edges, fx.NOW).toPandas()
    assert len(out) and not out.duplicated(["query_id", "memory_id"]).any()
    assert out.groupby("query_id").size().max() <= 10
    owners = asked.toPandas().set_index("query_id")
    for r in out.itertuples():
        assert r.agent_id == owners.agent_id[r.query_id] and r.phase not in ("Tombstone", "Invalidated")
        assert r.scope != "private" or r.user_id == owners.user_id[r.query_id]
    touched = recall.scored(asked, rows, edges, fx.NOW, recall.Options(touch_first=True))
    assert touched.where("recency_score <> 1").count() == 0


def test_recall_leaves_out_keys_and_strangers(spark):
    v = [1.0, 0.0]
    rows = memories(spark, [
        {"memory_id": 1, "agent_id": "a", "user_id": "u", "embedding": v, "content": "mine"},
        {"memory_id": 2, "agent_id": "a", "user_id": "w", "embedding": v, "content": "another's"},
        {"memory_id": 3, "agent_id": "a", "scope": "agent_shared", "embedding": v, "content": "shared"},
        {"memory_id": 4, "agent_id": "a", "user_id": "u", "embedding": v, "content": "__apikey__:x"},
        {"memory_id": 5, "agent_id": "b", "user_id": "u", "embedding": v, "content": "elsewhere"},
    ])
    asked = spark.createDataFrame([(7, "a", "u", "mine", v), (8, "a", "", "mine", v)], "query_id long, agent_id string, user_id string, text string, embedding array<double>")
    got = recall.candidates(asked, rows).collect()
    assert sorted(r.memory_id for r in got if r.query_id == 7) == [1, 3]
    assert sorted(r.memory_id for r in got if r.query_id == 8) == [1, 2, 3]


def candidate(spark, content, sim, importance=0.0, tier="Behavioral"):
    rows = memories(spark, [{"memory_id": 1, "agent_id": "a", "embedding": [1.0, 0.0]}])
    vector = [sim, (1 - sim * sim) ** 0.5]
    asked = spark.createDataFrame([(9, "a", content, vector, tier, importance)], "query_id long, agent_id string, content string, embedding array<double>, source_tier string, importance double")
    return asked, rows


@pytest.mark.parametrize(
    ("content", "sim", "config", "decision", "reason"),
    [
        ("the user likes tea in the morning", 0.98, GateConfig(shadow=False), "Rejected", "Near-duplicate of memory #1 (similarity=0.98"),
        ("the user likes tea in the morning", 0.60, GateConfig(shadow=False), "Accepted", "Sufficient"),
        ("the user likes tea in the morning", 0.99, GateConfig(), "Accepted", "[shadow: would reject]"),
        ("the user likes tea in the morning", 0.92, GateConfig(duplicate=0.99, shadow=False), "Deferred", "Uncertain"),
        ("thanks!", 0.10, GateConfig(shadow=False), "Rejected", "Transient"),
    ],
)
def test_gate(spark, content, sim, config, decision, reason):
    asked, rows = candidate(spark, content, sim)
    got = capture.gate(asked, rows, config).first()
    assert got.decision == decision and reason in got.reason


def test_gate_accepts_what_has_no_neighbour(spark):
    asked, rows = candidate(spark, "the user likes tea", 0.5)
    assert capture.gate(asked, rows.limit(0)).first().marginal_value == 1.0


def test_near_duplicates_are_put_off_when_derived(spark):
    asked, rows = candidate(spark, "the user likes tea in the morning", 0.99)
    facts = asked.withColumns({"raw_id": F.lit(5).cast("long"), "user_id": F.lit("u"), "scope": F.lit("private"), "memory_type": F.lit("feedback")})
    derived, lineage = capture.derive(facts, rows, NOW, GateConfig(shadow=False))
    row = derived.first()
    assert (row.gate_decision, row.confidence_level, row.parent_id, row.layer) == ("Deferred", "Stale", 5, "Derived")
    assert lineage.first().parent_ids == [5]


def test_intake(spark):
    rows = spark.createDataFrame([("hi",), ("please forget what I said",), ("my car is red",)], "content string")
    assert [r.route for r in capture.intake(rows).collect()] == ["drop", "forget", "store"]


def test_reconcile(spark):
    v, w = [1.0, 0.0], [0.9, (1 - 0.81) ** 0.5]
    base = {"agent_id": "a", "layer": "Derived", "scope": "private"}
    rows = memories(spark, [
        {"memory_id": 1, "agent_id": "a", "content": "raw red", "created_at": 10, "embedding": [0.0, 1.0]},
        {"memory_id": 2, **base, "parent_id": 1, "content": "the user's car is red now", "created_at": 11, "embedding": v, "importance": 0.5},
        {"memory_id": 3, "agent_id": "a", "content": "raw blue", "created_at": 20, "embedding": [0.0, 1.0]},
        {"memory_id": 4, **base, "parent_id": 3, "content": "the user's car is blue now", "created_at": 21, "embedding": w},
    ])
    facts = rows.where("memory_id = 4").withColumnRenamed("memory_id", "query_id").select("query_id", "agent_id", "content", "embedding", "created_at")
    decided = capture.decide(facts, rows)
    assert [(r.op, r.target_ids) for r in decided.collect()] == [("REPLACE", [2])]
    edges = graph.upserted(spark.createDataFrame([], "from_id long, to_id long, type string, weight double, created_at long, seq long"))
    after, drawn = capture.apply(rows, edges, decided)
    assert {r.memory_id: r.phase for r in after.collect()} == {1: "Tombstone", 2: "Tombstone", 3: "Active", 4: "Active"}
    assert [(r.from_id, r.to_id, r.type) for r in drawn.collect()] == [(4, 2, "Supersedes")]
    # the replaced fact came from a newer source: the fact goes instead
    late = rows.withColumn("created_at", F.when(F.col("memory_id") == 1, 99).otherwise(F.col("created_at")))
    after, drawn = capture.apply(late, edges, decided)
    assert {r.memory_id for r in after.where("phase = 'Tombstone'").collect()} == {3, 4}
    assert [(r.from_id, r.to_id) for r in drawn.collect()] == [(2, 4)]
    # the source speaks of the past, the fact does not
    raw = spark.createDataFrame([(4, "my previous car was blue")], "query_id long, raw_content string")
    assert capture.decide(facts, rows, raw=raw).first().op == "NOOP"
    same = facts.withColumn("content", F.lit("the user's car is red now"))
    reinforced = capture.decide(same, rows)
    assert reinforced.first().op == "REINFORCE"
    after, _ = capture.apply(rows, edges, reinforced)
    got = {r.memory_id: (r.phase, round(r.importance, 3)) for r in after.collect()}
    assert got[2] == ("Active", 0.6) and got[4][0] == "Tombstone"
    assert capture.decide(facts.withColumn("embedding", F.array(F.lit(0.0), F.lit(-1.0))).withColumn("content", F.lit("zzz")), rows).first().op == "ADD"


def test_verdicts_are_parsed_out_of_replies(spark):
    reply = 'Sure: {"op": "REPLACE", "target_ids": ["3"], "rationale": "x"} done'
    row = spark.createDataFrame([(reply,), ("none",)], "r string").select(capture.parsed_verdict(F.col("r")).alias("v")).collect()
    assert row[0].v.op == "REPLACE" and row[0].v.target_ids == ["3"] and row[1].v is None


def test_providers(spark):
    providers.register("embed", "sizes", lambda s: s.map(lambda x: [float(len(x))]))

    def broken(s):
        raise OSError("down")

    providers.register("generate", "safe", providers.fallback(broken, lambda s: s.str.upper()))
    row = spark.createDataFrame([("ab",)], "t string").select(providers.embed(F.col("t"), "sizes").alias("e"), providers.generate(F.col("t"), "safe").alias("g")).first()
    assert (row.e, row.g) == ([2.0], "AB")
    with pytest.raises(KeyError):
        providers.provider("rerank", "absent")


def test_capture_stream(spark, tmp_path):
    incoming = str(tmp_path / "in")
    rows = memories(spark, [{"memory_id": 1, "agent_id": "a", "content": "the first text", "created_at": 10}, {"memory_id": 2, "agent_id": "a", "content": "hi", "created_at": 10}])
    rows.write.parquet(incoming)
    path, mark = str(tmp_path / "store"), str(tmp_path / "mark")

    def drain():
        pipelines.capture_stream(spark.readStream.schema(rows.schema).parquet(incoming), path, mark).awaitTermination()

    drain()
    assert pipelines.current(spark, path).select("memory_id", "content").collect() == [(1, "the first text")]
    memories(spark, [{"memory_id": 1, "agent_id": "a", "content": "an older text", "created_at": 5}]).write.mode("append").parquet(incoming)
    drain()
    assert pipelines.current(spark, path).first().content == "the first text"
    assert store.log(spark, path).count() == 2


def test_stream_forgets(spark, tmp_path):
    """A request tombstones alike rows of its agent that were there before its batch."""
    incoming, path, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    rows = memories(spark, [
        {"memory_id": 1, "agent_id": "a", "content": "the first text", "created_at": 10, "embedding": [1.0, 0.0]},
        {"memory_id": 2, "agent_id": "a", "content": "another text", "created_at": 10, "embedding": [0.0, 1.0]},
        {"memory_id": 3, "agent_id": "b", "content": "the first text", "created_at": 10, "embedding": [1.0, 0.0]},
    ])
    rows.write.parquet(incoming)

    def drain():
        pipelines.capture_stream(spark.readStream.schema(rows.schema).parquet(incoming), path, mark).awaitTermination()

    drain()
    request = {"memory_id": 9, "agent_id": "a", "content": "please forget about that text", "created_at": 20, "embedding": [0.9, 0.1]}
    memories(spark, [request]).write.mode("append").parquet(incoming)
    drain()
    assert {r.memory_id: r.phase for r in pipelines.current(spark, path).collect()} == {1: "Tombstone", 2: "Active", 3: "Active"}


def test_capture_run(spark):
    store_rows = memories(spark, [
        {"memory_id": 1, "agent_id": "a", "layer": "Derived", "content": "the garage code is 1234 at present", "created_at": 5, "embedding": [1.0, 0.0, 0.0]},
        {"memory_id": 2, "agent_id": "a", "content": "we had soup on monday", "created_at": 5, "embedding": [0.0, 1.0, 0.0]},
    ])
    batch = memories(spark, [
        {"memory_id": 11, "agent_id": "a", "content": "hi", "created_at": 20},
        {"memory_id": 12, "agent_id": "a", "content": "please forget about the soup", "created_at": 20, "embedding": [0.0, 1.0, 0.0]},
        {"memory_id": 13, "agent_id": "a", "content": "the garage code is 9876 at present", "created_at": 20, "embedding": [0.8, 0.0, 0.6]},
        {"memory_id": 14, "agent_id": "a", "content": "noted, the garage code is 9876", "created_at": 20, "embedding": [0.8, 0.0, 0.6], "user_metadata": {"role": "assistant"}},
    ])
    edges = spark.createDataFrame([], "from_id long, to_id long, type string, weight double, created_at long")
    config = capture.CaptureConfig(gate=GateConfig(shadow=False))
    done = capture.run(batch, store_rows, edges, 30, lambda raw, n: raw * 100 + n, config)
    assert {r.memory_id: r.outcome for r in done.outcomes.collect()} == {11: "drop", 12: "forget", 13: "Deferred", 14: "echo"}
    assert [(r.query_id, r.op, r.target_ids) for r in done.decisions.collect()] == [(1300, "REPLACE", [1])]
    assert {r.memory_id: r.phase for r in done.memories.collect()} == {1: "Tombstone", 2: "Tombstone", 13: "Active", 14: "Active", 1300: "Active"}
    drawn = {(r.from_id, r.to_id, r.type) for r in done.edges.collect()}
    assert drawn == {(1300, 13, "DerivedFrom"), (1300, 1, "Supersedes"), (13, 14, "ConflictsWith"), (13, 1, "Related")}
    assert [(r.child_id, r.parent_ids) for r in done.lineage.collect()] == [(1300, [13])]


def test_event_windows_and_session_states(spark, tmp_path):
    pd.DataFrame({"event_id": [1, 2], "kind": ["Gate", "Gate"], "timestamp_ms": [0, 1000]}).to_parquet(tmp_path / "e.parquet")
    events = spark.readStream.schema("event_id long, kind string, timestamp_ms long").parquet(str(tmp_path))
    run = pipelines.event_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("counts").first().n == 2
    folder = tmp_path / "log"
    folder.mkdir()
    pd.DataFrame({"session_id": [4, 4, 4], "op": ["start", "turn", "close"], "at": [1, 2, 3]}).to_parquet(folder / "l.parquet")
    log = spark.readStream.schema("session_id long, op string, at long").parquet(str(folder))
    run = pipelines.session_states(log).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [tuple(r) for r in spark.table("states").collect()] == [(4, 1, 3, False)]
