"""Chat collapse, classifiers, mixing and the pipeline."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import chat, compression, langid, mixing, nbsvm, simhash, toxicity
from palimpsest.llm.common import read

SF = "/root/testdata/sf0.01"


def turns(spark, conversations):
    rows = [(c, t, role, text) for c, said in conversations for t, (role, text) in enumerate(said)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def plain_collapse(conversations):
    said = {c: tuple((r or "unknown", t or "") for r, t in s) for c, s in conversations}
    kept = {}
    for c, s in said.items():
        if not any(len(o) > len(s) and o[: len(s)] == s for o in said.values()):
            kept[s] = min(c, kept.get(s, c))
    return {(c, len(s), sum(o == s for o in said.values())) for s, c in kept.items()}


@pytest.mark.parametrize("ranges", [None, 1, 40])
def test_snapshots_collapse(spark, ranges):
    rng = random.Random(2)
    conversations, c = [], 0
    for _ in range(25):
        said = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "c d"])) for _ in range(rng.randrange(1, 9))]
        for cut in rng.sample(range(1, len(said) + 1), rng.randrange(1, len(said) + 1)) + [len(said)]:
            conversations.append((c, said[:cut]))
            c += 1
    table = turns(spark, conversations).withColumns({"range": F.lit(1), "at": F.lit(2), "n": F.lit(3)}).repartition(3)
    got = {tuple(r) for r in chat.collapse(table, ranges=ranges).collect()}
    assert got == plain_collapse(conversations)


def test_rendering(spark):
    said = [("user", "hi"), ("assistant", "yo"), (None, None)]
    table = turns(spark, [(1, said), (2, said[:2])])
    kept = chat.collapse(table)
    one = chat.render(table, kept).collect()
    assert [(r.conv_id, r.part, r.chat) for r in one] == [(1, 0, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>unknown\n<|im_end|>\n")]
    parts = chat.render(table, kept, part_turns=2, ranges=3).orderBy("part").collect()
    assert "".join(r.chat for r in parts) == one[0].chat and len(parts) == 2


def test_ties_and_nulls_in_turns(spark):
    rows = [(None, 0, "user", "x"), (None, 1, "user", "y"), (5, None, "user", "x"), (5, 1, "user", "y"), (5, 1, "user", "a"), (5, 1, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.n_turns) for r in chat.collapse(table).collect()}
    assert (5, 4) in got and len(got) in (1, 2)
    assert chat.format_chats(table.limit(0)).count() == 0


@pytest.mark.parametrize("conv_id", [7, None])
def test_one_long_conversation_of_tied_turns(spark, conv_id):
    """It is dealt over many ranges, whose turns are numbered and hashed as if they were one."""
    rows = [(conv_id, k // 90 or None, "user", f"said {k % 40}") for k in range(300)]
    rows += [(8, t, r, x) for _, t, r, x in rows[:100]]
    said = sorted(rows[:300], key=lambda r: (r[1] or 0, hashlib.md5(f"user\n{r[3]}".encode()).hexdigest()))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    line = "".join(f"<|im_start|>user\n{r[3]}<|im_end|>\n" for r in said)
    for ranges in (None, 25):
        parts = chat.format_chats(table, part_turns=64, ranges=ranges).where(F.col("conv_id").eqNullSafe(F.lit(conv_id))).orderBy("part").collect()
        assert "".join(r.chat for r in parts) == line and [r.n_turns for r in parts] == [300] * 5


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_toxicity(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (fold(d, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    out = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in out]) > 0.93
    learned = {r.doc_id for r in labels.collect() if fold(r.doc_id, 4) != 2}
    assert all(set(r.neighbours) <= learned for r in got.values())


def test_neighbours_are_exact():
    rng = np.random.default_rng(4)
    n, terms = 400, 30
    vectors = []
    for k in range(n):
        found = np.sort(rng.choice(terms, size=rng.integers(1, 6), replace=False))
        w = rng.uniform(0.2, 2, len(found)) if k % 4 else np.ones(len(found))  # a quarter has many ties
        vectors.append((found, w / np.linalg.norm(w)))
    index = toxicity.Index(list(range(n)), np.zeros(n), vectors, np.ones(n), terms, toxicity.Limits(neighbours=7, block=16, dense=6, batch=50))
    for t, w in vectors[:120]:
        sims = np.array([sum(x * v[1][v[0] == k].sum() for k, x in zip(t, w, strict=True)) for v in vectors])
        least = np.sort(sims)[-7]
        expected = {i for i in range(n) if sims[i] > 1e-12 and sims[i] >= least - 1e-9}
        assert {index.ids[r] for r in index.nearest(t, w)[0]} == expected


def test_quality(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    got = {r.doc_id: r for r in nbsvm.quality(docs, labels).collect()}
    assert all(r.held_out == (fold(d, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    out = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in out]) > 0.93


def test_dual_descent_meets_the_optimum():
    """The duality gap of the hinge loss closes."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, 6, replace=False)) for _ in range(80)]
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    ratio, cost = rng.normal(size=20), np.ones(80)
    w, b = nbsvm.descend(rows, y, ratio, cost, 2000)
    values = [nbsvm.unit(r, ratio) for r in rows]
    loss = sum(max(0, 1 - yy * (float(w[r] @ v) + b)) for r, v, yy in zip(rows, values, y, strict=True))
    primal = 0.5 * (float(w @ w) + b * b) + loss
    for _ in range(200):  # no small step improves it
        dw, db = rng.normal(size=20) * 1e-3, rng.normal() * 1e-3
        other = sum(max(0, 1 - yy * (float((w + dw)[r] @ v) + b + db)) for r, v, yy in zip(rows, values, y, strict=True))
        assert 0.5 * (float((w + dw) @ (w + dw)) + (b + db) ** 2) + other >= primal - 1e-3


def test_language(spark):
    docs = read(spark, SF, "documents")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in got if got[d].held_out]
    assert held and all(got[d].held_out == (fold(d, 4) == 2) for d in got)
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.97


def test_language_of_odd_texts(spark):
    known = [(k, "en", "the cat and the dog") for k in range(30)] + [(k, "fr", "le chat et la souris") for k in range(30, 60)]
    odd = [(100, None, None), (101, None, ""), (102, None, "123 !?"), (103, None, "the mouse"), (104, None, "les souris"), (105, None, "日本語"), (None, "en", "the")]
    docs = spark.createDataFrame(known + odd, "doc_id long, lang string, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == "en" and got[104][0] == "fr" and got[105][0] in ("en", "fr")
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(bare).collect()} == {"und"}


def test_models_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, labels).collect()} == {(0.0, 0)}
    assert {(r.score, r.predicted) for r in nbsvm.quality(docs, labels).collect()} == {(0.0, 0)}
    out = mixing.mix(docs, mixing.quality_domains(labels), {"unlabelled": 1.0}, ["doc_id"]).collect()
    assert {(r.n_tokens, r.rate, r.copies) for r in out} == {(2, 1.0, 1), (0, 1.0, 1)}
    assert mixing.mix(docs.limit(0), mixing.quality_domains(labels), {"x": 1.0}, ["doc_id"]).count() == 0


def test_mix_meets_targets(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    targets = {"civil": 0.85, "toxic": 0.15}
    rows = mixing.mix(docs.withColumn("row", F.lit(0)), mixing.civility_domains(labels), targets, ["doc_id"]).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows} == {r.doc_id: brute.quality(r.text)[0] for r in docs.collect()}
    whole = sum(r.n_tokens for r in rows)
    for domain, share in targets.items():
        assert sum(r.rate * r.n_tokens * r.posterior[domain] for r in rows) / whole == pytest.approx(share, abs=1e-4)


def test_projection_stops_at_zero(spark):
    members = spark.createDataFrame([(10, [0.9, 0.1]), (10, [0.1, 0.9]), (10, [0.5, 0.5])], "n_tokens long, p array<double>")
    rates = mixing.fit_rates(members, ["x", "y"], {"x": 0.88, "y": 0.12})
    rows = members.withColumn("rate", rates.rate).collect()
    assert min(r.rate for r in rows) == 0
    assert sum(r.rate * 10 * r.p[0] for r in rows) / 30 == pytest.approx(0.88, abs=1e-5)


@pytest.mark.parametrize("target", [0.7, 0.9, 0.95, 0.97])
def test_hard_targets_are_met(spark, target):
    rng = np.random.default_rng(3)
    rows = [(int(t), [float(x), float(1 - x)]) for t, x in zip(rng.integers(20, 2000, 3000), rng.beta(8, 2, 3000), strict=True)]
    members = spark.createDataFrame(rows, "n_tokens long, p array<double>").coalesce(2)
    rates = mixing.fit_rates(members, ["x", "y"], {"x": target, "y": 1 - target})
    got = members.select((rates.rate * F.col("n_tokens") * F.get("p", F.lit(0))).alias("t")).agg(F.sum("t")).first()[0]
    assert got / sum(t for t, _ in rows) == pytest.approx(target, abs=1e-5) and rates.gap < 1e-5


def test_unreachable_targets_are_reported(spark):
    members = spark.createDataFrame([(10, [0.6, 0.4]), (10, [0.4, 0.6])], "n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="cannot meet"):
        rates = mixing.fit_rates(members, ["x", "y"], {"x": 0.9, "y": 0.1})
    assert rates.gap > 0.1


def test_pipeline(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = read(spark, source, "documents")
    items = [(r.item_id, r.text) for r in read(spark, source, "benchmark").collect()]
    leak = f"{items[0][1]} {items[1][1]} and some more words to be long enough for the rules that count twenty words at least here"
    added = [(900001, leak), (900002, leak + " tail"), (900003, "password: hunter2secret in a text that is long enough to be kept by the rules " * 1 + "one two three four five six seven")]
    extra = spark.createDataFrame(added, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'src0' as source", "cast(length(text) as bigint) as n_chars")
    docs = docs.unionByName(extra)
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "secret_scan", "mix"]
    at = docs
    kept = set(rows)
    import zstandard

    press, bands = zstandard.ZstdCompressor(level=3).compress, compression.Bands()
    for name, stage in corpus_pipeline.STAGES:
        columns = at.columns
        out = stage(spark, at, source)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        have = {r.doc_id: r for r in out.collect()}
        if name != "mix":
            assert out.columns == columns
        if name == "quality_rules":
            kept = {d for d in kept if not brute.quality(rows[d])[5] and compression.in_band(len(rows[d].encode()), compression.ratios(rows[d].encode(), press, bands), bands)}
        elif name == "near_dedup":
            order = sorted(kept)
            alike = simhash.Alike()
            kept = set(brute.alike_components([(d, rows[d]) for d in order], alike.width, alike.radius, alike.check_width, alike.check_radius))
        elif name == "decontaminate":
            kept = {d for d in kept if not brute.leaked(rows[d], items)}
            assert not {900001, 900002} & kept
        elif name == "secret_scan":
            assert have[900003].text.startswith("[SECRET] in a text") and have[900003].n_chars == len(have[900003].text)
            assert all(brute.secrets(r.text)[2] == "" for r in have.values())
        assert set(have) == kept, name
        at = out
    assert all(r.rate > 0 for r in have.values())
