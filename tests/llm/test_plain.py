"""Models, linking and scores against plain versions, over given tables and awkward rows."""

import math
import random
import re

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import langid, mixing, nbsvm, secrets, toxicity
from palimpsest.llm.common import held_out, read

ODD = [(None, "the idiot"), (7001, None), (7002, ""), (7003, "idiot idiot scum " * 4000), (7004, "word—word “hello”，好。 x9y"), (7004, "another text"), (7005, "12 34 !!"), (7006, "the of and"), (7006, "the of and")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit("en"))
    return rows.unionByName(odd).repartition(4).cache()


@pytest.fixture(scope="module")
def labels(spark, sf):
    rows = read(spark, sf, "labels").select("doc_id", "quality", "toxic")
    more = spark.createDataFrame([(7003, 0, 1), (7004, 1, 0), (7006, 1, 0), (7006, 1, 0), (None, 1, 1), (7005, None, None)], "doc_id long, quality long, toxic long")
    return rows.unionByName(more)


def examples(docs, labels, column, modulus, remainder):
    """(id, label, copies, text) of the distinct labelled texts that may be learned from, and the labels of each class."""
    told = labels.where(f"doc_id is not null and {column} is not null and not crc32(cast(cast(doc_id as string) as binary)) % {modulus} = {remainder}")
    by_id = {}
    for r in told.collect():
        by_id[r.doc_id] = max(by_id.get(r.doc_id, 0), r[column])
    texts = {}
    for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect():
        if r.doc_id in by_id:
            texts[r.doc_id] = min(texts.get(r.doc_id, (math.inf, "")), (r.h, r.text), key=lambda x: x[0])
    rows = {}
    for d, (_, text) in texts.items():
        rows.setdefault((text or "", by_id[d]), []).append(d)
    out = sorted(((min(ids), y, len(ids), t) for (t, y), ids in rows.items()), key=lambda r: (str(r[0]), r[1]))
    return out, [sum(y == k for y in by_id.values()) for k in (0, 1)]


def test_toxicity(docs, labels):
    rows, have = examples(docs, labels, "toxic", 4, 2)
    sampled = [sum(r[2] for r in rows if r[1] == k) for k in (0, 1)]
    weighed = [(d, y, n * have[y] / sampled[y], t) for d, y, n, t in rows]
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    plain = brute.Toxicity(weighed, [t for _, t in texts])
    got = sorted(((r.doc_id, r.score, r.predicted, set(r.neighbours), len(r.neighbours) == len(r.votes)) for r in toxicity.toxicity(docs, labels).collect()), key=repr)
    expected = [(d, *plain.score(t)) for d, t in texts]
    assert len(got) == len(expected)
    for d, score, predicted, voters, whole in got:
        same = [e for e in expected if e[0] == d]
        assert any(score == pytest.approx(e[1], abs=1e-6) and voters == e[2] for e in same), d
        assert predicted == int(score >= 0.3) and whole


def test_quality(docs, labels):
    rows, _ = examples(docs, labels, "quality", 5, 0)
    found = [brute.ngrams(t) for *_, t in rows]
    y = [r[1] for r in rows]
    ratio = brute.nb_ratios(found, y)
    told = labels.where(~held_out("doc_id", 5, 0)).select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"))
    model = nbsvm.fit(docs, told)
    name = {xxhash.xxh3_64_intdigest(f): f for f in ratio}
    known = [name[h] for h in model.known.tolist()]
    assert set(known) == {f for f, x in ratio.items() if x}
    assert model.square == pytest.approx(np.array([ratio[f] ** 2 for f in known]))
    w = {f: push / ratio[f] for f, push in zip(known, model.push.tolist(), strict=True)}

    def vector(features):
        v = {f: ratio[f] for f in features if ratio.get(f)}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / size for f, x in v.items()}

    for r in docs.where("doc_id >= 7000 or doc_id < 40").collect():
        margin = sum(w[f] * x for f, x in vector(brute.ngrams(r.text)).items()) + model.bias
        assert model.score(r.text) == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.offset))), abs=1e-9)
    # the weights are an optimum of the hinge loss: no small step improves it
    vectors, signs = [vector(f) for f in found], [1 if k else -1 for k in y]
    costs = [len(y) / (2 * y.count(k)) for k in y]
    least, rng = brute.hinge_loss(w, model.bias, vectors, signs, costs), random.Random(3)
    for _ in range(30):
        other = {f: x + rng.gauss(0, 1e-3) for f, x in w.items()}
        assert brute.hinge_loss(other, model.bias + rng.gauss(0, 1e-3), vectors, signs, costs) >= least - 1e-3


def test_language(docs):
    train = {(r.lang, r.text) for r in docs.where(~held_out("doc_id", 4, 2) & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).collect()}
    plain = brute.Language(sorted(train))
    got = langid.identify(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(got) == len(texts)
    for r in got:
        expected = [plain.predict(t) for d, t in texts if d == r.doc_id]
        assert any(r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6) for lang, score in expected), r.doc_id


def test_words_end_at_punctuation_of_any_script():
    assert langid.letters("word—word “hello”，好。 été नमस्ते x9y") == [w.encode() for w in ("word", "word", "hello", "好", "été", "नमस्ते", "x", "y")]
    assert langid.letters("—“”，。 ́ 12") == []


def test_mixing_posteriors(spark, docs, labels):
    told = mixing.quality_domains(labels)
    model = mixing.classifier(docs, told, buckets=512)
    weights = model.table.first()
    w = [list(weights[f"w{k}"]) for k in range(len(model.names))]
    got = mixing.soft(docs, model, "text", [F.col("doc_id"), F.col("text")]).collect()
    for r in got:
        words = (r.carried.text or "").lower().split()
        picked = {xxhash.xxh64_intdigest(x, 42) % 512 for x in words}  # 512 divides 2^64, so the sign does not matter
        logs = [b + sum(w[k][h] for h in picked) for k, b in enumerate(model.base)]
        each = [math.exp(x - max(logs)) for x in logs]
        assert r.n_tokens == len(words) and r.p == pytest.approx([x / sum(each) for x in each], abs=1e-9)
    # the weights are an optimum of the penalised likelihood
    rows = {}
    for r in told.where("doc_id is not null").collect():
        rows[r.doc_id] = max(rows.get(r.doc_id, ""), r.domain)
    first = {}
    for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect():
        if r.doc_id in rows:
            first[r.doc_id] = min(first.get(r.doc_id, (math.inf, "")), (r.h, r.text), key=lambda x: x[0])
    x, y = np.zeros((len(first), 513)), []
    for i, (d, (_, text)) in enumerate(sorted(first.items())):
        x[i, [xxhash.xxh64_intdigest(t, 42) % 512 for t in set((text or "").lower().split())]] = 1.0
        x[i, -1] = 1.0
        y.append(model.names.index(rows[d]))
    full = np.array([[*w[k], model.base[k]] for k in range(len(w))]).T
    full = full - full.mean(axis=1, keepdims=True)  # the penalty picks this one of equal models
    score = np.exp(x @ full)
    p = score / score.sum(axis=1, keepdims=True)
    slope = x.T @ (np.eye(len(w))[y] - p) - np.r_[np.full(512, mixing.PENALTY), 0][:, None] * full
    assert np.abs(slope).max() < 0.02 * len(y)


def test_mix_rounds_rates(docs, labels):
    rows = mixing.mix(docs, mixing.civility_domains(labels), {"civil": 0.9, "toxic": 0.1}, ["doc_id"]).collect()
    assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) and r.gap < 1e-4 for r in rows)
    assert sum(r.copies for r in rows) == pytest.approx(sum(r.rate for r in rows), rel=0.15)


def weak_parts(text):
    out = []
    for kind, pattern, least in secrets.KINDS:
        for m in re.finditer(pattern, text, re.ASCII):
            if not least or len(m[2]) >= least:
                out.append((kind, m.start(), m.end()))
    return out


def test_credentials_are_linked(spark):
    """Places and links against every pair, with parts of all lengths and distances."""
    rng = random.Random(9)
    make = [
        lambda: "user: " + "".join(rng.choices("abcde", k=rng.randrange(3, 60))),
        lambda: "bob" + str(rng.randrange(99)) + "@example.org",
        lambda: "pwd=" + "".join(rng.choices("xyz123", k=rng.choice([4, 8, 300]))),
        lambda: "password: hunter" + str(rng.randrange(10**6)),
        lambda: "https://example.org/" + "p/" * rng.choice([1, 5, 200]),
        lambda: "AKIA" + "".join(rng.choices("ABC123", k=16)),
        lambda: "".join(rng.choices("0123456789abcdef", k=32)),
        lambda: "aB3" + "".join(rng.choices("qrstuvWXYZ012", k=rng.choice([20, 400]))),
    ]
    rows = []
    for k in range(120):
        pieces = []
        for _ in range(rng.randrange(1, 9)):
            pieces += [rng.choice(make)(), "é" * rng.choice([1, 40, 150, 190, 230]) + " filler"]
        rows.append((k, " ".join(pieces)))
    # the near end of a long part counts, not its start
    rows.append((500, "https://example.org/" + "p/" * 150 + " pwd: hunter22"))
    got = {r.doc_id: (r.spans, r.credentials) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for k, text in rows:
        assert got[k] == brute.linked(weak_parts(text), secrets.SCOPE), text
    assert got[500][0].count("sec:") == 1


def test_redaction_replaces_spans(spark):
    rows = [(1, "é user: bob password: hunter22hunter22 — https://example.org/x é"), (2, None), (3, "nothing here"), (4, "password: password=abcdefgh12 tail"), (5, "mail me: bob@example.org")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for r in secrets.scan(table).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact(table).collect()}
    for k, text in rows:
        out, at = "", 0
        merged = []
        for a, b in sorted(spans[k]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            out, at = out + text[at:a] + "[SECRET]", b
        assert clean[k] == (text if text is None else out + text[at:])
