"""Mixing to target weights by soft membership, in DataFrame functions only.

A classifier fitted on a labelled table gives every document a posterior over
domains.  Nonnegative document rates are then fitted so that the expected tokens
of each domain, the sum of rate x tokens x posterior, match the targets.

The classifier is multinomial logistic regression over the presence of words.  Every
word counts: a word is known by its 64-bit hash modulo ``buckets``, so that the model
has a fixed size and a text is scored inside its own row, without a join or a shuffle.
It is fitted on a bounded sample of labelled documents, of which only bucket numbers come
to the driver; the penalty keeps posteriors soft where words leave doubt, and their mean
over the sample is each domain's share of it.

The fit is projected-gradient least squares from rate 1, with lazy projection: gradient
steps add up unprojected and the rate is the projection of their sum onto rates >= 0.
Every gradient is a combination of the posteriors, so the sum is one number for each
domain and the rate stays a short expression.  A step is scaled by the inverse of
sum(tokens x p x p') over the documents whose rate is above zero and halved until the
objective falls; each is one sum over all documents, of which a few numbers come to the
driver.  Steps go on until the targets are met or no step brings them nearer; targets that
no rates can meet are approached and the remaining gap is returned and warned of.

Defined results: null text counts as empty and has no tokens, the prior as its
posterior and a rate like any other; null ids are carried; of documents that repeat a
labelled id one text is learned from, and of repeated labels the largest domain by name
counts; equal texts have equal posteriors and rates; repeated documents are rated one by
one; texts are read whole, however long; without labelled documents there is one domain,
``unlabelled``; an empty table gives an empty result; a column of the documents that has
the name of an added one is kept as ``<name>_in``, others are never read and may have any names.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_sample, labelled_texts, materialize, renamed

BREAK = r"[\x20\x09-\x0D]+"
SAMPLE, BUCKETS, PENALTY = 3000, 1 << 16, 3.0
ADDED = ("n_tokens", "posterior", "rate", "copies", "gap")


def tokens(text: Column) -> Column:
    """Lower-cased words between blanks; an empty array for an empty text."""
    inner = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BREAK))


def hashed(words: Column, buckets: int) -> Column:
    """The distinct buckets of words."""
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))


@dataclass(frozen=True)
class Model:
    """Domains, their scores for a text without words, and a one-row table of bucket weights."""

    names: list[str]
    base: list[float]
    buckets: int
    table: DataFrame  # w0..wK: arrays of ``buckets`` numbers, less those of the last domain


def _fit(rows: list[list[int]], labels: list[int], n_words: int, n_domains: int, penalty: float, steps: int = 100, tolerance: float = 1e-3) -> np.ndarray:
    """Weights (words + 1, domains) of the penalised likelihood, by accelerated gradient ascent; the last row is the base."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.concatenate([np.asarray(r, np.int64) for r in rows] or [np.zeros(0, np.int64)])
    used, cols = np.unique(cols, return_inverse=True)
    n, m = len(rows), len(used)

    def forward(w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(at, w[cols, k], minlength=n) + w[-1, k] for k in range(w.shape[1])], axis=1)

    def back(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.stack([np.bincount(cols, x[at, k], minlength=m) for k in range(x.shape[1])], axis=1), x.sum(axis=0, keepdims=True)])

    y = np.eye(n_domains)[labels]
    ridge = np.full((m + 1, 1), penalty)
    ridge[-1] = 1e-6
    # a bound on the curvature along each weight: rare words may step far
    step = 1.0 / (0.5 * back(forward(np.ones((m + 1, 1)))) + ridge)
    w = np.zeros((m + 1, n_domains))
    ahead, pace = w, 1.0
    for _ in range(steps):
        score = forward(ahead)
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        new = ahead + step * (back(y - p) - ridge * ahead)
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        moved = new - w
        ahead = new + (pace - 1) / faster * moved
        w, pace = new, faster
        if np.abs(moved).max() < tolerance * max(1e-9, np.abs(w).max()):
            break
    w -= w[:, -1:]  # only differences matter
    out = np.zeros((n_words + 1, n_domains))
    out[used], out[-1] = w[:-1], w[-1]
    return out


def classifier(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", sample: int = SAMPLE, buckets: int = BUCKETS, penalty: float = PENALTY) -> Model:
    """Fits the classifier on at most ``sample`` labelled documents."""
    spark = docs.sparkSession
    once = labelled.where(F.col(domain_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(domain_col).alias("y"))
    picked = materialize(bounded_sample(once, "id", sample), "sample")  # at most `sample` rows
    train = labelled_texts(docs, picked, id_col, text_col).select("y", F.sort_array(hashed(tokens(F.col("text")), buckets)).alias("words"))
    found = sorted((r["y"], r["words"]) for r in train.collect())  # at most `sample` rows of distinct buckets
    names = sorted({d for d, _ in found})
    if not names:
        return Model(["unlabelled"], [0.0], buckets, _weights(spark, np.zeros((buckets, 1))))
    place = {d: k for k, d in enumerate(names)}
    w = _fit([r for _, r in found], [place[d] for d, _ in found], buckets, len(names), penalty)
    return Model(names, w[-1].tolist(), buckets, _weights(spark, w[:-1]))


def _weights(spark: SparkSession, w: np.ndarray) -> DataFrame:
    """One row with an array of bucket weights for each domain, in the shared folder."""
    row = json.dumps([[round(float(x), 6) for x in w[:, k]] for k in range(w.shape[1])])
    whole = spark.range(1).select(F.from_json(F.lit(row), "array<array<double>>").alias("w"))
    return materialize(whole.select(*(F.get("w", F.lit(k)).alias(f"w{k}") for k in range(w.shape[1]))), "weights")


def _posterior(words: Column, model: Model) -> Column:
    """Posteriors of an array of distinct buckets, from the columns w0..wK; the last domain's score is its base."""

    def total(k: int) -> Column:
        add = lambda ws: F.aggregate(words, F.lit(float(model.base[k])), lambda a, h: a + F.get(ws, h))
        return F.get(F.transform(F.array(f"w{k}"), add), F.lit(0))

    def share(logs: Column) -> Column:
        top = F.array_max(logs)
        each = F.transform(logs, lambda x: F.exp(x - top))
        whole = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
        return F.transform(each, lambda x: x / whole)

    last = len(model.names) - 1
    logs = F.array(*(total(k) for k in range(last)), F.lit(float(model.base[last])))
    return F.get(F.transform(F.array(logs), share), F.lit(0))


def soft(docs: DataFrame, model: Model, text_col: str, carry: list[Column]) -> DataFrame:
    """The ``carry`` columns as a struct ``carried``, n_tokens and ``p``, the posteriors in order of domains.

    All inside a text's own row: nothing is shuffled.
    """
    words = docs.select(F.struct(*carry).alias("carried"), tokens(F.col(text_col)).alias("words"))
    slim = words.select("carried", F.size("words").cast("long").alias("n_tokens"), hashed(F.col("words"), model.buckets).alias("words"), F.monotonically_increasing_id().alias("row"))
    # The weights are scalar subqueries, read once.  The row number keeps this projection apart from the one
    # below it, so that it merges with the next: the weights then stay beside the expression, out of the rows.
    weights = [model.table.select(f"w{k}").scalar().alias(f"w{k}") for k in range(len(model.names) - 1)]
    whole = slim.select("carried", "n_tokens", "words", "row", *weights)
    return whole.select("carried", "n_tokens", F.when(F.col("row") >= 0, _posterior(F.col("words"), model)).alias("p"))


@dataclass(frozen=True)
class Rates:
    """The rate as a column over ``p``; the largest gap to a target as a share of all tokens; steps taken."""

    rate: Column
    gap: float
    steps: int


def _at(scores: list[float]) -> Column:
    """1 + sum(score x posterior), projected onto values from zero up."""
    total = F.lit(1.0)
    for k, x in enumerate(scores):
        total = total + F.lit(float(x)) * F.get("p", F.lit(k))
    return F.greatest(F.lit(0.0), total)


def fit_rates(members: DataFrame, names: list[str], targets: dict[str, float], budget: float | None = None, steps: int = 200, tolerance: float = 1e-6) -> Rates:
    """Rates of the rows of ``members`` (n_tokens, p).

    ``targets``: domain to weight, scaled to sum 1 over the known domains;
    ``budget``: the mix's tokens, by default as many as the documents have.
    """
    n = len(names)
    first = members.agg(F.sum("n_tokens").alias("all")).first()
    total = float(first["all"] or 0)
    weight = sum(targets.get(d, 0.0) for d in names)
    if not total or not weight:
        return Rates(F.lit(1.0), 0.0, 0)
    wanted = np.array([targets.get(d, 0.0) / weight * (total if budget is None else budget) for d in names])

    def look(scores: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The objective, what is missing of each target, and the curvature over rates above zero."""
        rate, p, t = _at(scores.tolist()), [F.get("p", F.lit(k)) for k in range(n)], F.col("n_tokens")
        rows = members.select(t, "p", rate.alias("rate"))
        rate = F.col("rate")
        sums = [F.sum(rate * t * p[k]).alias(f"t{k}") for k in range(n)]
        sums += [F.sum(F.when(rate > 0, t * p[a] * p[b]).otherwise(F.lit(0.0))).alias(f"m{a}_{b}") for a in range(n) for b in range(a, n)]
        got = rows.agg(F.sum(rate * rate * t).alias("f"), *sums).first()
        curve = np.array([[float(got[f"m{min(a, b)}_{max(a, b)}"] or 0) for b in range(n)] for a in range(n)])
        return 0.5 * float(got["f"]) - float(scores @ wanted), wanted - np.array([float(got[f"t{k}"] or 0) for k in range(n)]), curve

    scores = np.zeros(n)
    value, left, curve = look(scores)
    taken, best, stale = 0, np.abs(left).max(), 0
    while taken < steps and np.abs(left).max() > tolerance * total and stale < 12:
        move = np.linalg.lstsq(curve + 1e-9 * total * np.eye(n), left, rcond=None)[0]
        size = 1.0
        while True:
            taken += 1
            new = look(scores + size * move)
            if new[0] <= value - 1e-4 * size * float(left @ move) + 1e-12 * abs(value) or size < 1e-4:
                break
            size /= 2
        scores = scores + size * move
        value, left, curve = new
        gap = np.abs(left).max()
        best, stale = (gap, 0) if gap < 0.99 * best else (best, stale + 1)
    gap = float(np.abs(left).max() / total)
    if gap > max(tolerance, 1e-4):
        warnings.warn(f"the documents cannot meet the targets: {gap:.2%} of all tokens remain", stacklevel=2)
    return Rates(_at(scores.tolist()), gap, taken)


def _copies(seed: Column) -> Column:
    """``rate`` rounded up or down by a hash, so that the mean over equal rates is the rate."""
    chance = F.pmod(seed, F.lit(1 << 30)) / float(1 << 30)
    return (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("long").alias("copies")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], carry: list[str], budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The ``carry`` columns of every document with n_tokens, posterior, rate, copies and gap.

    ``gap``: the largest distance of a domain from its target, as a share of all tokens.
    """
    model = classifier(docs, labelled, id_col, text_col, **options)
    members = materialize(soft(docs, model, text_col, [F.col(f"`{c}`") for c in carry]), "members")
    rates = fit_rates(members, model.names, targets, budget)
    posterior = F.create_map(*(x for k, d in enumerate(model.names) for x in (F.lit(d), F.get("p", F.lit(k)))))
    rated = members.select("carried", "n_tokens", posterior.alias("posterior"), rates.rate.alias("rate"))
    out = rated.select("carried", "n_tokens", "posterior", "rate", _copies(F.xxhash64("carried")), F.lit(rates.gap).alias("gap"))
    kept = renamed(docs.select(*(f"`{c}`" for c in carry)), *ADDED).columns
    return out.select(*(F.col("carried").getField(c).alias(k) for c, k in zip(carry, kept, strict=True)), *ADDED)


def mix_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of ``docs`` with n_tokens, rate and copies.

    Documents are written once with their posteriors and never shuffled; the rates are
    fitted over the numbers alone.
    """
    rows = mix(docs, labelled, targets, docs.columns, None, id_col, text_col, **options)
    added = ("n_tokens", "rate", "copies")
    shown = renamed(docs, *ADDED).columns
    kept = renamed(docs, *added).columns
    return rows.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(shown, kept, strict=True)), *added)


def quality_domains(labels: DataFrame) -> DataFrame:
    """The labelled table of this repository's mixes: quality and toxicity together."""
    return labels.where("quality is not null and toxic is not null").select(
        "doc_id", F.concat(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "_toxic").otherwise("_civil")).alias("domain")
    )


def civility_domains(labels: DataFrame) -> DataFrame:
    """Toxicity alone, for documents that have passed quality rules."""
    return labels.where("toxic is not null").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("civil").alias("domain"))


# Share of tokens that each domain should have.
TARGETS = {"good_civil": 0.82, "good_toxic": 0.08, "poor_civil": 0.08, "poor_toxic": 0.02}
CIVILITY_TARGETS = {"civil": 0.92, "toxic": 0.08}
