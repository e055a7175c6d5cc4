"""Toxicity by the nearest labelled examples, exact over TF-IDF cosine.

Terms are all words of the bounded labelled sample.  A text's weight of a term is
(1 + log tf) x idf x association: inverse document frequencies come from all
documents, and the association is the chi-squared statistic of the term's presence
with the label over the sample.  No term is left out; the association only turns the
axes, so that a few words which matter are not drowned by the many which do not.
``Limits(association=False)`` gives plain TF-IDF.

The examples lie in blocks of an inverted index that keeps each term's largest weight
in each block.  A query's bound on a block is the sum of those; blocks are scored in
falling order of bound, a batch of postings at a time, until no bound reaches the k-th
similarity found, so the neighbours are exact.  All examples tied with the k-th vote, and all that vote are
listed as evidence.  Votes weigh similarity / (1 - similarity + eps), corrected for the
sample's share of each class, beside a prior vote; they are mapped to probabilities by a
logistic curve fitted to the votes on held-back parts of the sample, whose labels neither the
associations nor the neighbours of those votes have seen.

Defined results: null text counts as empty; a text without a known word has the prior
vote only; repeated documents are scanned one by one and get equal scores; of documents
that repeat a labelled id one text is learned from, and labelled texts that are equal are
one example of their common weight; of repeated labels the largest counts; ties vote
together and are listed by id; without an example of either class the score is 1 or 0, the
share of the class there is (0 without any); texts are read whole, however long; an empty
table gives an empty result; columns other than id and text are never read, so that their
names may be anything.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_sample, document_frequency, fold, held_out, labelled_texts, map_batches, materialize, plain_words, share, table_batch

THRESHOLD = 0.3


@dataclass(frozen=True)
class Limits:
    """How many labelled rows of each class are learned from, and the vote's parameters."""

    positives: int = 1500
    negatives: int = 3000
    neighbours: int = 15
    block: int = 64
    eps: float = 0.05
    prior: float = 5.0
    folds: int = 3
    dense: int = 8  # a term of this part of the examples, one in so many, is frequent
    batch: int = 16384
    association: bool = True


def spread(starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges [start, end), and each one's value."""
    sizes = ends - starts
    whole = int(sizes.sum())
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(whole), np.repeat(values, sizes)


class Index:
    """Unit vectors of examples, by blocks, with each term's block maxima.

    ``vectors``: (terms, weights) arrays of each example.  Alike examples share blocks:
    they are ordered by their heaviest terms.
    """

    def __init__(self, ids: list, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_terms: int, limits: Limits):
        heavy = [t[np.lexsort((t, -w))[:3]].tolist() for t, w in vectors]
        order = sorted(range(len(ids)), key=lambda i: (heavy[i], ids[i]))
        self.ids = [ids[i] for i in order]
        self.labels, self.weights, self.limits, self.n_terms = labels[order], weights[order], limits, n_terms
        vectors = [vectors[i] for i in order]
        self.prior = float((self.weights * self.labels).sum() / self.weights.sum()) if len(order) else 0.0
        sizes = np.array([len(t) for t, _ in vectors], np.int64)
        terms = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)]).astype(np.int64)
        values = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        rows = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
        # terms that many examples have are kept as whole rows of a matrix, the others as postings
        often = np.bincount(terms, minlength=n_terms) * limits.dense >= max(1, len(self.ids))
        self.dense_terms = np.flatnonzero(often)
        self.place = np.full(n_terms, -1, np.int32)
        self.place[self.dense_terms] = np.arange(len(self.dense_terms))
        mine = often[terms]
        self.dense = np.zeros((len(self.dense_terms), len(self.ids)))
        self.dense[self.place[terms[mine]], rows[mine]] = values[mine]
        self.edges = np.arange(0, len(self.ids), limits.block)
        terms, rows, values = terms[~mine], rows[~mine], values[~mine]
        # postings by term and row; a run of one term and block is an entry, with its largest weight
        by = np.argsort(terms, kind="stable")
        terms, self.rows, self.values = terms[by], rows[by], values[by]
        self.blocks = -(-len(order) // limits.block)
        block = self.rows // limits.block
        first = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])]) if len(terms) else np.zeros(0, np.int64)
        self.entry_block, self.entry_at = block[first].astype(np.int32), np.r_[first, len(terms)].astype(np.int32)
        self.peak = np.maximum.reduceat(self.values, first) if len(first) else np.zeros(0)
        self.term_at = np.searchsorted(terms[first], np.arange(n_terms + 1)).astype(np.int32)
        self.block_of = np.arange(len(order)) // limits.block

    def nearest(self, terms: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and similarities of the k nearest and of all tied with the k-th, nearest first.

        A block's bound is the largest sum of its examples over frequent terms, plus the peaks of
        the others.
        """
        k = self.limits.neighbours
        place = self.place[terms]
        wide = np.zeros(len(self.dense_terms))
        wide[place[place >= 0]] = values[place >= 0]
        base = wide @ self.dense
        some = place < 0
        entries, weight = spread(self.term_at[terms[some]], self.term_at[terms[some] + 1], values[some])
        blocks = self.entry_block[entries]
        bounds = np.maximum.reduceat(base, self.edges) + np.bincount(blocks, self.peak[entries] * weight, minlength=self.blocks)
        order, at = np.argsort(-bounds, kind="stable"), 0
        # batches of blocks in falling order of bound, each of some thousands of postings
        sizes = self.entry_at[entries + 1] - self.entry_at[entries]
        work = np.cumsum(np.bincount(blocks, sizes, minlength=self.blocks)[order])
        rows, sims, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        while at < len(order):
            done = work[at - 1] if at else 0.0
            end = max(at + 4, int(np.searchsorted(work, done + self.limits.batch, side="right")))
            batch, at = order[at:end], end
            batch = batch[(bounds[batch] > 1e-12) & (bounds[batch] >= least - 1e-9)]
            if not len(batch):  # bounds only fall from here on
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[batch] = True
            if len(batch) < len(order):
                mine = chosen[blocks]
                postings, w = spread(self.entry_at[entries[mine]], self.entry_at[entries[mine] + 1], weight[mine])
            else:
                postings, w = spread(self.entry_at[entries], self.entry_at[entries + 1], weight)
            scores = np.where(chosen[self.block_of], base, 0.0) + np.bincount(self.rows[postings], self.values[postings] * w, minlength=len(self.ids))
            here = np.flatnonzero(scores > max(1e-12, least - 1e-9))
            rows, sims = np.concatenate([rows, here]), np.concatenate([sims, scores[here]])
            if len(sims) >= k:
                least = float(np.partition(sims, len(sims) - k)[len(sims) - k])
                best = sims >= least - 1e-9
                rows, sims = rows[best], sims[best]
        order = np.lexsort((rows, -np.round(sims, 9)))
        return rows[order], np.minimum(sims[order], 1.0)

    def vote(self, rows: np.ndarray, sims: np.ndarray) -> float:
        """Log-odds of the weighted share of positive neighbours, the prior vote among them."""
        weight = self.weights[rows] * sims / (1 - sims + self.limits.eps)
        yes, every, prior = float((weight * self.labels[rows]).sum()), float(weight.sum()), self.limits.prior
        part = (yes + prior * self.prior + 0.01 * (every + prior)) / (1.02 * (every + prior))
        return math.log(part / (1 - part))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a little shrinkage."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + 1e-2 * (a - 1), (w * (p - y)).sum() + 1e-3 * b])
        h = w * p * (1 - p)
        m = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def squashed(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


class Model:
    """``words``: term numbers; ``scale``: idf x association of each term."""

    def __init__(self, words: dict[bytes, int], scale: np.ndarray, constant: float | None = None):
        self.words, self.scale, self.constant = words, scale, constant
        self.index: Index | None = None
        self.slope, self.offset = 1.0, 0.0

    def terms(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's known terms and how often each occurs."""
        known, counts = self.words, Counter(plain_words(text or b""))
        found = counts.keys() & known.keys()
        terms = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        by = np.argsort(terms)
        return terms[by], np.fromiter(map(counts.__getitem__, found), float, len(found))[by]

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms and their weights, of length 1."""
        values = (1 + np.log(counts)) * self.scale[terms]
        norm = math.sqrt(float(values @ values))
        return (terms, values / norm) if norm > 1e-12 else (terms[:0], values[:0])

    def score(self, text: bytes | None) -> tuple[float, list, list]:
        """Probability, and the ids and labels of the examples that voted, nearest first."""
        if self.index is None:
            return self.constant or 0.0, [], []
        rows, sims = self.index.nearest(*self.vector(*self.terms(text)))
        odds = self.slope * self.index.vote(rows, sims) + self.offset
        return squashed(odds), [self.index.ids[r] for r in rows], [int(self.index.labels[r]) for r in rows]


def associations(df: np.ndarray, yes: np.ndarray, rows: int, positives: int) -> np.ndarray:
    """Chi-squared of each term's presence with the label, over ``rows`` examples; 0 for a term of none."""
    p = positives / rows
    return (yes - df * p) ** 2 / np.maximum(df * p * (1 - p) * (1 - df / (rows + 1.0)), 1e-12)


def _examples(docs: DataFrame, labelled: DataFrame, limits: Limits, text_col: str, id_col: str) -> tuple[list[tuple], dict[bytes, int], dict]:
    """(id, label, copies, terms, counts) of the sample's distinct texts, the words of the terms, and how many labels each class has."""
    once = labelled.where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    have = {r.y: r.n for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [bounded_sample(once.where(F.col("y") == y), "id", most) for y, most in ((1, limits.positives), (0, limits.negatives))]
    picked = materialize(picked[0].unionByName(picked[1]), "sample")  # bounded by the two limits
    train = labelled_texts(docs, picked, id_col, text_col)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    train = train.groupBy(text.alias("text"), "y").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    out = pa.schema([("id", pa.string()), ("y", pa.int32()), ("copies", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32()))])

    def make():
        def step(batch):
            found = [Counter(plain_words(t)) for t in batch.column(3).to_pylist()]
            return table_batch(out, batch.column(0), batch.column(1), batch.column(2), [list(c) for c in found], [list(c.values()) for c in found])

        return step

    slim = train.select(F.col("id").cast("string"), F.col("y").cast("int"), "copies", "text")
    table = map_batches(slim, make, "id string, y int, copies long, words array<binary>, counts array<int>").toArrow()
    table = table.sort_by([("id", "ascending"), ("y", "ascending")]).combine_chunks()
    listed = table.column("words").combine_chunks()
    coded = listed.flatten().dictionary_encode()
    terms, counts = coded.indices.to_numpy().astype(np.int64), table.column("counts").combine_chunks().flatten().to_numpy().astype(float)
    cuts = np.cumsum(listed.value_lengths().to_numpy())[:-1]
    head = zip(*(table.column(c).to_pylist() for c in ("id", "y", "copies")), strict=True)
    rows = [(*h, t, c) for h, t, c in zip(head, np.split(terms, cuts), np.split(counts, cuts), strict=True)] if table.num_rows else []
    return rows, {w: t for t, w in enumerate(coded.dictionary.to_pylist())}, have


def fit(docs: DataFrame, labelled: DataFrame, limits: Limits = Limits(), text_col: str = "text", id_col: str = "doc_id") -> Model:
    """``labelled``: (id, y) rows that may be learned from; y is 0 or 1."""
    rows, words, have = _examples(docs, labelled, limits, text_col, id_col)
    labels = np.array([r[1] for r in rows], float)
    yes = int(labels.sum())
    if not 0 < yes < len(rows):
        return Model({}, np.zeros(0), 1.0 if yes else 0.0)
    everywhere = document_frequency(docs, text_col, words)
    total = docs.count()
    idf = np.log((total + 1) / (np.array([everywhere.get(w, 0) for w in words], float) + 1)) + 1
    terms = [r[3] for r in rows]
    copies = np.array([r[2] for r in rows], float)
    sampled = {y: copies[labels == y].sum() for y in (0, 1)}
    weights = copies * np.array([have[int(y)] / sampled[int(y)] for y in labels])  # what an example stands for
    kind = docs.schema[id_col].dataType.typeName()
    ids = [int(r[0]) if kind in ("long", "integer", "short", "byte") else r[0] for r in rows]

    def learn(some: np.ndarray) -> Model:
        """A model of these examples, its votes not yet mapped to probabilities."""
        scale = idf
        if limits.association:
            df = np.bincount(np.concatenate([terms[i] for i in some]), minlength=len(words)).astype(float)
            yes = np.bincount(np.concatenate([terms[i] for i in some if labels[i]]), minlength=len(words)).astype(float)
            scale = idf * associations(df, yes, len(some), int(labels[some].sum()))
        model = Model(words, scale)
        model.index = Index([ids[i] for i in some], labels[some], [model.vector(terms[i], rows[i][4]) for i in some], weights[some] / weights[some].mean(), len(words), limits)
        return model

    everyone, votes, voted = np.arange(len(rows)), np.zeros(len(rows)), np.zeros(len(rows), bool)
    for k in range(limits.folds):
        back, rest = everyone[everyone % limits.folds == k], everyone[everyone % limits.folds != k]
        if len(set(labels[rest])) == 2:
            part = learn(rest)
            votes[back] = [part.index.vote(*part.index.nearest(*part.vector(terms[i], rows[i][4]))) for i in back]
            voted[back] = True
    model = learn(everyone)
    if len(set(labels[voted])) == 2:
        model.slope, model.offset = logistic(votes[voted], labels[voted], weights[voted] / weights.mean())
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score, predicted, and the nearest examples as evidence."""
    shared = share(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        model, cache = shared(), {}

        def step(batch):
            out = []
            for text in batch.column(1).to_pylist():
                key = xxhash.xxh3_128_digest(text or b"")
                if key not in cache:
                    if len(cache) >= 20_000:
                        cache.clear()
                    cache[key] = model.score(text)
                out.append(cache[key])
            schema = pa.schema([batch.schema.field(0), ("score", pa.float64()), ("neighbours", pa.list_(batch.schema.types[0])), ("votes", pa.list_(pa.int32()))])
            return table_batch(schema, batch.column(0), *zip(*out, strict=True))

        return step

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = map_batches(slim, make, f"doc_id {kind}, score double, neighbours array<{kind}>, votes array<int>")
    return rows.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours", "votes")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, limits: Limits = Limits()) -> DataFrame:
    """Learn outside the held-out fold, score every document."""
    labelled = labels.where(fold("doc_id", modulus) != remainder).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"))
    rows = score(docs, fit(docs, labelled, limits))
    return rows.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", "predicted", "neighbours", "votes")
