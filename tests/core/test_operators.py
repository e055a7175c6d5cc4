"""Golden cases of graph, lineage, consolidation, sessions and stores."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import schema, storage
from palimpsest.functions import scores
from palimpsest.operators import browse, consolidate, events, filters, graph, lifecycle, lineage, sessions, similarity
from palimpsest.sources import jsonl, settings, store

NOW = 1_700_000_000


def memories(spark, rows):
    """Rows as dicts; absent fields take their defaults."""
    names = sorted({k for r in rows for k in r})
    fields = {f.name: f for f in schema.MEMORIES.fields}
    kinds = schema.T.StructType([fields[n] for n in names])
    return schema.complete(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kinds))


def ids(df, column="memory_id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_edge_upsert(spark):
    stream = spark.createDataFrame(
        [(1, 2, "Related", 0.5, 10, 1), (1, 2, "Related", 0.9, 20, 2), (3, 1, "Contradicts", 1.0, 5, 3)],
        "from_id long, to_id long, type string, weight double, created_at long, seq long",
    )
    edges = graph.upserted(stream)
    got = {(r.from_id, r.to_id, r.type): r.weight for r in edges.collect()}
    assert got == {(1, 2, "Related"): 0.9, (2, 1, "Related"): 0.9, (3, 1, "Contradicts"): 1.0}
    gone = spark.createDataFrame([(1,)], "memory_id long")
    assert graph.without_nodes(edges, gone).count() == 0
    assert tuple(graph.counts(edges).first()) == (3, 3)


def test_incoming_repeats_parallel_edges(spark):
    edges = spark.createDataFrame([(1, 2, "Caused", 1.0, 0), (1, 2, "Corrects", 1.0, 0), (3, 2, "Caused", 1.0, 0)], schema.EDGES)
    assert graph.incoming(edges, 2).count() == 5


def test_traverse_survives_cycles(spark):
    edges = spark.createDataFrame([(1, 2, "Caused", 1.0, 0), (2, 3, "Caused", 1.0, 0), (3, 1, "Caused", 1.0, 0)], schema.EDGES)
    start = spark.createDataFrame([(1,)], "memory_id long")
    assert {(r.node_id, r.depth) for r in graph.traverse(edges, start, 5).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_neighbours_mark_missing_rows(spark):
    edges = spark.createDataFrame([(1, 2, "Caused", 1.0, 0), (1, 9, "Caused", 1.0, 0)], schema.EDGES)
    rows = memories(spark, [{"memory_id": 1}, {"memory_id": 2, "content": "x", "phase": "Archived"}])
    assert {(r.to_id, r.other_phase) for r in graph.neighbours(edges, rows, 1).collect()} == {(2, "Archived"), (9, "Missing")}


def links(spark, pairs):
    return spark.createDataFrame(pairs, "child_id long, parent_id long")


def these(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "memory_id long")


def test_descendants(spark):
    tree = links(spark, [(10, 1), (11, 1), (100, 10), (101, 10)])
    assert lineage.descendants(tree, these(spark, 1)).count() == 4


def test_live_parents(spark):
    two = links(spark, [(100, 1), (100, 2)])
    assert lineage.live_parents(two, these(spark, 1)).first().has_live_parent
    assert not lineage.live_parents(two, these(spark, 1, 2)).first().has_live_parent


def test_cascade(spark):
    chain = links(spark, [(2, 1), (3, 2), (4, 3)])
    assert ids(lineage.cascade(chain, these(spark, 1)).where("invalidated")) == [2, 3, 4]
    two = links(spark, [(5, 1), (5, 2), (6, 5)])
    got = lineage.cascade(two, these(spark, 1)).collect()
    assert [(r.memory_id, r.invalidated) for r in got] == [(5, False)]
    assert ids(lineage.cascade(two, these(spark, 1, 2)).where("invalidated")) == [5, 6]
    assert lineage.cascade(chain, these(spark, 99)).count() == 0


def test_coordinated_removal(spark):
    rows = memories(spark, [{"memory_id": i} for i in (1, 2, 3, 4)])
    out = lineage.remove(rows, links(spark, [(2, 1), (3, 1), (3, 4)]), these(spark, 1))
    assert {(r.memory_id, r.phase, r.outcome) for r in out.collect()} == {
        (1, "Tombstone", "removed"), (2, "Invalidated", "invalidated"), (3, "Active", "recomputed"), (4, "Active", "kept")
    }


def test_versions(spark):
    rows = memories(spark, [{"memory_id": 1, "content": "a", "access_count": 7}])
    once = lifecycle.new_versions(rows, spark.createDataFrame([(1, 2, "b")], "memory_id long, new_id long, content string"), NOW)
    twice = lifecycle.new_versions(once, spark.createDataFrame([(2, 3, "c")], "memory_id long, new_id long, content string"), NOW)
    got = {r.memory_id: (r.phase, r.parent_id, r.mem_version, r.access_count) for r in twice.collect()}
    assert got == {1: ("Versioned", 0, 1, 7), 2: ("Versioned", 1, 2, 0), 3: ("Active", 2, 3, 0)}
    chain = lineage.history(twice, these(spark, 3))
    assert [(r.memory_id, r.step) for r in chain.orderBy("step").collect()] == [(3, 0), (2, 1), (1, 2)]


def test_decay_by_tier(spark):
    day = [{"memory_id": k, "tier": t, "importance": 0.8, "last_accessed": NOW - 86400} for k, t in enumerate(schema.TIERS)]
    got = {r.memory_id: r.importance for r in lifecycle.decayed(memories(spark, day), NOW, 0.1).collect()}
    assert got[0] < got[1] < got[2] < 0.8
    four = [{"memory_id": 1, "tier": "working", "importance": 0.8, "last_accessed": NOW - 4 * 86400}]
    assert lifecycle.decayed(memories(spark, four), NOW, 0.01).first().confidence_level == "Stale"


def test_touches(spark):
    rows = memories(spark, [{"memory_id": 1, "importance": 0.1}, {"memory_id": 2, "importance": 0.1}])
    reads = spark.createDataFrame([(1, NOW), (1, NOW + 5), (1, NOW + 2)], "memory_id long, at long")
    got = {r.memory_id: (r.access_count, r.tier) for r in lifecycle.touched(rows.withColumn("last_accessed", F.lit(0).cast("long")), reads).collect()}
    assert got == {1: (3, "short_term"), 2: (0, "working")}


def test_forget_cycle_applies_tombstones_only(spark):
    rows = memories(spark, [{"memory_id": k, "importance": 0.0, "last_accessed": 0, "confidence_level": "Conflicted"} for k in (1, 2, 50)])
    after, log = lifecycle.forget(rows, NOW)
    assert log.count() == 2 and {r.action for r in log.collect()} == {"Archive"}  # 0.75, and id 50 is not sampled
    assert after.where("phase <> 'Active'").count() == 0


def test_conflicts_resolve_in_order(spark):
    rows = memories(
        spark,
        [
            {"memory_id": 1, "created_at": 100}, {"memory_id": 2, "created_at": 100, "parent_id": 1}, {"memory_id": 3, "created_at": 100, "confidence_level": "Verified"},
            {"memory_id": 4, "created_at": 200}, {"memory_id": 5, "created_at": 100, "source_tier": "Behavioral"}, {"memory_id": 6, "created_at": 100},
        ],
    )
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (1, 6)], "a long, b long")
    got = {r.b: (r.level, r.winner_id, r.coexist) for r in consolidate.resolve(pairs, rows).collect()}
    assert got == {2: (1, 2, False), 3: (2, 3, False), 4: (3, 4, False), 5: (4, 5, False), 6: (6, 1, True)}
    judged = consolidate.resolve(pairs.where("b = 6"), rows, lambda df: F.lit("b")).first()
    assert (judged.level, judged.winner_id) == (5, 6)


def test_promotion_of_sessions(spark):
    rows = memories(spark, [{"memory_id": k, "importance": i, "access_count": n} for k, (i, n) in enumerate([(0.9, 5), (0.1, 1), (0.8, 10), (0.5, 2)])])
    rows = rows.withColumn("session_id", F.lit(1))
    got = consolidate.promote_sessions(rows, most=2).collect()
    assert {r.memory_id for r in got} == {0, 2}
    assert {(r.confidence_level, r.scope, r.memory_type, r.tier) for r in got} == {("Verified", "private", "user_profile", "short_term")}
    sure = rows.withColumn("confidence_level", F.lit("Verified"))
    assert consolidate.promote_sessions(sure).count() == 0


def test_dedup(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = memories(spark, [{"memory_id": 1, "embedding": v, "importance": 0.5}, {"memory_id": 2, "embedding": v, "importance": 0.7}, {"memory_id": 3, "embedding": w}, {"memory_id": 4, "embedding": []}])
    assert [tuple(r) for r in consolidate.dedup_full(rows).collect()] == [(1, 2)]
    assert consolidate.dedup_full(rows.where("memory_id > 1")).count() == 0
    got = consolidate.dedup_incremental(rows, rows.where("memory_id = 1")).collect()
    assert [(r.memory_id, r.neighbour_id, r.removed_id) for r in got] == [(1, 2, 1)]


def plain_greedy(rows, threshold):
    """The full greedy grouping as first stated, over all rows of a key at once."""
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    order = [i for i, _, v in sorted(rows, key=lambda r: (round(float(np.linalg.norm(r[2])), 6), r[0]))]
    importance, archived, out = {i: m for i, m, _ in rows}, set(), []
    for x, i in enumerate(order):
        if i in archived:
            continue
        kept = i
        for j in order[x + 1 :]:
            if j in archived or round(float(unit[i] @ unit[j]), 6) < threshold:
                continue
            if importance[j] > importance[i]:
                out.append((kept, j))
                kept = j
                archived.add(i)
            else:
                out.append((j, kept))
                archived.add(j)
    return sorted(out)


def test_dedup_full_is_the_greedy_fold(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 4))
    rows = [(k + 1, float(rng.integers(0, 5)) / 5, (base[k % 6] * rng.uniform(0.5, 2) + rng.normal(scale=0.25, size=4)).astype(np.float32).astype(float).tolist()) for k in range(48)]
    table = memories(spark, [{"memory_id": i, "importance": m, "embedding": v} for i, m, v in rows])
    assert sorted(tuple(r) for r in consolidate.dedup_full(table, 0.9).collect()) == plain_greedy(rows, 0.9)


def test_drift(spark):
    rows = memories(
        spark,
        [{"memory_id": 1, "embedding": [1.0, 0.0]}, {"memory_id": 2, "layer": "Derived", "parent_id": 1, "embedding": [0.5, 0.8660254]}, {"memory_id": 3, "layer": "Derived", "parent_id": 1, "embedding": [1.0, 0.1]}, {"memory_id": 4, "layer": "Derived", "parent_id": 1, "embedding": []}],
    )
    got = {r.memory_id: (round(r.drift_score, 3), r.invalidated) for r in consolidate.drift(rows).collect()}
    assert got[2] == (0.5, True) and got[3][1] is False and got[4] == (0.0, False)


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "part_rows": 7}])
def test_topk_join_is_exact(spark, sizes):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 5)).astype(np.float32)
    rows = [(i, f"a{i % 2}", vectors[i].tolist()) for i in range(60)]
    table = spark.createDataFrame(rows, "memory_id long, agent_id string, embedding array<float>").repartition(3)
    got = similarity.topk_join(table.withColumnRenamed("memory_id", "query_id"), table, 4, skip_self=True, **sizes)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    for q in range(60):
        others = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(60) if i % 2 == q % 2 and i != q)[:4]
        mine = sorted((r.rank, r.memory_id) for r in got.where(f"query_id = {q}").collect()) if q % 20 == 0 else None
        assert mine is None or [i for _, i in mine] == [i for _, i in others]
    assert got.count() == 240


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append(memories(spark, [{"memory_id": 1, "agent_id": "a", "content": "x"}, {"memory_id": 2, "agent_id": "b"}]), path, 1)
    store.append(memories(spark, [{"memory_id": 1, "agent_id": "a", "content": "y"}, {"memory_id": 2, "agent_id": "b", "phase": "Tombstone"}]), path, 2)
    assert store.live(store.log(spark, path)).select("memory_id", "content").collect() == [(1, "y")]
    assert store.log(spark, path, 1).count() == 2
    out = str(tmp_path / "compacted")
    store.compact(spark, path, out)
    assert spark.read.parquet(out).count() == 1


def test_snapshot_and_delta(spark):
    snapshot = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    delta = spark.createDataFrame([(1, "c", 1, False), (2, None, 2, True), (3, "d", 3, False)], "k long, v string, seq long, gone boolean")
    got = store.snapshot_and_delta(snapshot, delta, ["k"], F.col("gone"))
    assert sorted(tuple(r) for r in got.select("k", "v").collect()) == [(1, "c"), (3, "d")]


def test_json_round_trip(spark, tmp_path):
    path = tmp_path / "memories"
    jsonl.export(memories(spark, [{"memory_id": 1, "content": "é", "embedding": [0.5], "user_metadata": {"a": "b"}}]), str(path))
    (path / "extra.json").write_text('{"memory_id": 2, "scope": "nowhere", "phase": "Invalidated", "tier": "consolidated"}\nnot json\n')
    got = {r.memory_id: r for r in jsonl.import_memories(spark, str(path)).collect()}
    assert got[1].content == "é" and got[1].embedding == [0.5] and got[1].user_metadata == {"a": "b"}
    assert (got[2].scope, got[2].phase, got[2].tier) == ("private", "Active", "short_term")
    assert len(got) == 2


def test_session_log(spark, tmp_path):
    lines = [
        {"op": "start", "session_id": 42, "agent_id": "a", "user_id": "u", "at": 1000},
        {"op": "turn", "session_id": 42, "at": 1001, "memory_ids": [7, 8], "intent": "ask"},
        {"op": "close", "session_id": 42, "at": 1002},
        {"op": "turn", "session_id": 42, "at": 1009, "memory_ids": [99]},
    ]
    text = []
    for k, line in enumerate(lines):
        body = json.dumps(line)
        crc = zlib.crc32(body.encode()) ^ (1 if k == 3 else 0)
        text.append(body if k == 0 else f"{body}\t{crc:08x}")
    (tmp_path / "log").write_text("\n".join(text))
    row = jsonl.sessions_from_log(spark, str(tmp_path / "log")).first()
    assert (row.session_id, row.agent_id, row.started_at, row.turn_count, row.active, row.memory_ids, row.current_intent) == (42, "a", 1000, 1, False, [7, 8], "ask")
    found = sessions.resolved(jsonl.sessions_from_log(spark, str(tmp_path / "log")), memories(spark, [{"memory_id": 7}]))
    assert found.first().memories == 1


def test_events(spark):
    rows = spark.createDataFrame([(k, 1, 5, 100 * k, "agent-1", "Gate", "Ok") for k in (1, 2, 3)], "event_id long, trace_id long, memory_id long, timestamp_ms long, agent_id string, kind string, status string")
    assert events.query(rows, since=200).count() == 2
    assert [r.timestamp_ms for r in events.trace(rows, 1).collect()] == [100, 200, 300]
    assert ids(events.ring(rows, 2), "event_id") == [2, 3]
    assert events.query(rows, agent="agent-").count() == 3


def test_coverage(spark):
    rows = memories(spark, [{"memory_id": k, "agent_id": a} for k, a in enumerate(["x", "x", "y"])])
    assert tuple(browse.coverage(rows).first())[:2] == (3, 3)
    assert browse.coverage(rows, "x").first().total == 2


def test_visibility(spark):
    rows = memories(spark, [{"memory_id": 1, "user_id": "u"}, {"memory_id": 2, "user_id": "v"}, {"memory_id": 3, "scope": "agent_shared"}, {"memory_id": 4, "user_id": "anonymous"}])
    assert ids(rows.where(filters.visible_to("u"))) == [1, 3]
    assert ids(rows.where(filters.visible_to(""))) == [1, 2, 3, 4]
    assert ids(rows.where(filters.visible_to("anonymous"))) == [3, 4]


def test_settings():
    loaded = settings.load("a = 1 # one\n# b = 2\ndecay_rate = 0.5\n", environment={"PALIMPSEST_A": "9"})
    assert loaded == {"a": "9", "decay_rate": "0.5"}
    known = settings.default_variables()
    seen = []
    known.watch("decay_rate", seen.append)
    known.set("decay_rate", "0.2")
    assert seen == [0.2]
    with pytest.raises(PermissionError):
        known.set("embedding_dimension", 3)
    known.update(loaded)
    assert known.get("decay_rate") == 0.5
    assert [v.name for v in known.listed("%_weight")] == sorted(v for v in known.known if v.endswith("_weight"))
    assert settings.Gates.every().enabled() == 14 and settings.Gates().enabled() == 2


def test_default_variables_and_agents():
    known = settings.default_variables()
    assert len(known.known) == 72 and known.get("v2_deferred_threshold") == 0.3 and known.get("rerank_model") == "" and known.get("sst_use_mmap") is True
    known.set("decay_rate", "0.02")
    assert known.get("decay_rate") == 0.02
    with pytest.raises(PermissionError):
        known.set("port", "1")
    agents = settings.Agents(most=3)
    agents.register("a", "Ann")
    assert agents.get("a") == "Ann" and agents.get("b") == "b" and agents.listed() == ["a", "b", "default"]
    for wrong in (lambda: agents.register("a"), lambda: agents.get("c"), lambda: agents.remove("default")):
        with pytest.raises(ValueError):
            wrong()
    agents.remove("a")
    assert agents.listed() == ["b", "default"]
    with pytest.raises(KeyError):
        settings.Agents(create=False).get("x")


def test_shadow_is_the_default():
    assert settings.Gates().shadow and scores.GateConfig().shadow


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = {"spark.master": "spark://host:7077"}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_long_supersession_chains(spark):
    """Longer than any fixed number of steps, and a cycle ends."""
    n = 90
    edges = spark.createDataFrame([(k + 1, k, "Supersedes", 1.0, k) for k in range(1, n)] + [(201, 200, "Supersedes", 1.0, 1), (200, 201, "Supersedes", 1.0, 2)], "from_id long, to_id long, type string, weight double, created_at long")
    rows = spark.createDataFrame([(k, "Active" if k in (n, 200, 201) else "Tombstone", 1000 + k) for k in [*range(1, n + 1), 200, 201]], "memory_id long, phase string, created_at long")
    got = {r.memory_id: r.superseded_at for r in graph.supersession(edges, rows).collect()}
    assert {k: got[k] for k in range(1, n)} == dict.fromkeys(range(1, n), 1000 + n) and set(got) == {*range(1, n), 200, 201}


def test_half_a_grid_has_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(k, "a", [float(x) for x in rng.normal(size=3)]) for k in range(60)], "memory_id long, agent_id string, embedding array<double>")
    whole = similarity.pairs_above(rows, 0.6).collect()
    grid = similarity.pairs_above(rows, 0.6, broadcast_bytes=0, part_rows=7).collect()
    assert sorted(whole) == sorted(grid) and len(whole) > 20
