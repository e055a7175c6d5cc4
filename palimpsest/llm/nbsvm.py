"""Quality classifier: naive Bayes scaled n-grams under a linear hinge loss.

Features are indicators of n-grams, known by their 64-bit hashes: one and two words or
runs of punctuation; and, over the marks that tell whether a token equals the one before it
or a line an earlier one, runs of one to four repeats.  Each indicator is scaled by its class log-count ratio, vectors are
brought to unit length, and dual coordinate descent fits the hinge loss.  Scores
are probabilities from a logistic curve fitted to margins of held-back parts of the
training rows.

The model is fitted on a bounded sample of labelled rows and knows all their n-grams;
scoring reads every whole text.

Defined results: null text counts as empty; an empty text, and one with no known
n-gram, get the score of a zero margin; repeated documents are scored one by one;
of documents that repeat a labelled id one text is learned from, and labelled texts that
are equal count once each label; of repeated labels the largest counts; with one class only
the score is its share, 0 without labels; an empty table gives an empty result; columns other
than id and text are never read and may have any names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_sample, fold, held_out, labelled_texts, map_batches, materialize, share, table_batch
from palimpsest.llm.toxicity import THRESHOLD, logistic, squashed

_TOKEN = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class Limits:
    """How many labelled rows are learned from, and the solver's parameters."""

    rows: int = 4000
    least_df: int = 1
    cost: float = 1.0
    epochs: int = 15
    folds: int = 3


def features(text: str | None) -> set[str]:
    """Distinct n-grams of a text."""
    if not text:
        return set()
    tokens = _TOKEN.findall(text.lower())
    found = set(tokens)
    found.update(map(" ".join, set(zip(tokens, tokens[1:], strict=False))))
    again = "".join("=" if a == b else "." for a, b in zip(tokens, tokens[1:], strict=False))
    found.update(f"token {g}" for g in repeats(again))
    seen: set[str] = set()
    lines = [x for x in text.split("\n") if x.strip()]
    known = "".join("=" if x in seen or seen.add(x) else "." for x in lines)
    found.update(f"line {g}" for g in repeats(known))
    return found


def repeats(marks: str, most: int = 4) -> list[str]:
    """The runs of up to ``most`` repeats among the marks."""
    return [g for g in ("=" * n for n in range(1, most + 1)) if g in marks]


def numbers(text: str | None) -> np.ndarray:
    """The n-grams' hashes in rising order."""
    found = features(text)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter(map(digest, found), np.uint64, len(found)))


def ratios(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Log ratio of each feature's smoothed share in the two classes."""
    yes, no = np.ones(size), np.ones(size)
    for row, label in zip(rows, y, strict=True):
        (yes if label > 0 else no)[row] += 1
    return np.log((yes / yes.sum()) / (no / no.sum()))


def unit(row: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    values = ratio[row]
    norm = math.sqrt(float(values @ values))
    return values / norm if norm else values


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss, by dual coordinate descent."""
    values = [unit(r, ratio) for r in rows]
    w, b = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for v in values])  # the bias is a feature of value 1
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = y[i] * (float(w[r] @ v) + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if (d := new - alpha[i]) != 0.0:
                alpha[i] = new
                w[r] += d * y[i] * v  # a row's features are distinct
                b += d * y[i]
                largest = max(largest, abs(d))
        if largest < 1e-4:
            break
    return w, b


class Model:
    """``known``: hashes in rising order; margin = sum(ratio x weight) / length of the scaled vector + bias."""

    def __init__(self, known: np.ndarray, ratio: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float):
        told = ratio != 0
        self.known, self.push, self.square = known[told], (ratio * weights)[told], (ratio * ratio)[told]
        self.bias, self.slope, self.offset = bias, slope, offset

    def score(self, text: str | None) -> float:
        at = places(self.known, numbers(text))
        square = float(self.square[at].sum())
        margin = self.bias + (float(self.push[at].sum()) / math.sqrt(square) if square else 0.0)
        return squashed(self.slope * margin + self.offset)


def places(known: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where those of ``found`` that are known stand among ``known``; both in rising order."""
    if not len(known):
        return np.zeros(0, np.int64)
    at = np.searchsorted(known, found)
    at[at == len(known)] = 0
    return at[known[at] == found]


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, text: str | None) -> float:
        return self.value


def fit(docs: DataFrame, labelled: DataFrame, limits: Limits = Limits(), text_col: str = "text", id_col: str = "doc_id") -> Model | Constant:
    """``labelled``: (id, y) rows that may be learned from; y is 0 or 1."""
    once = labelled.where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    picked = materialize(bounded_sample(once, "id", limits.rows), "sample")  # at most `rows` rows
    train = labelled_texts(docs, picked, id_col, text_col)
    train = train.groupBy(F.coalesce("text", F.lit("")).alias("text"), "y").agg(F.min("id").alias("id"))
    out = pa.schema([("id", pa.string()), ("y", pa.int32()), ("f", pa.binary())])

    def make():
        def step(batch):
            rows = [numbers(t).tobytes() for t in batch.column(2).to_pylist()]
            return table_batch(out, batch.column(0), batch.column(1), rows)

        return step

    slim = train.select(F.col("id").cast("string"), F.col("y").cast("int"), "text")
    # hashes of `rows` texts come to the driver, as Arrow
    table = map_batches(slim, make, "id string, y int, f binary").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    y = np.where(table.column("y").to_numpy() > 0, 1.0, -1.0)
    total, yes = len(y), int((y > 0).sum())
    if not 0 < yes < total:
        return Constant(yes / total if total else 0.0)
    rows = [np.frombuffer(x, np.uint64) for x in table.column("f").to_pylist()]
    known, df = np.unique(np.concatenate(rows), return_counts=True)
    known = known[df >= limits.least_df]
    rows = [places(known, r) for r in rows]
    cost = np.where(y > 0, limits.cost * total / (2 * yes), limits.cost * total / (2 * (total - yes)))

    def train_on(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        part = [rows[i] for i in some]
        ratio = ratios(part, y[some], len(known))
        return ratio, *descend(part, y[some], ratio, cost[some], limits.epochs)

    everyone, margins = np.arange(len(rows)), np.zeros(len(rows))
    for k in range(limits.folds):
        rest = everyone[everyone % limits.folds != k]
        if len(set(y[rest])) < 2:
            continue
        ratio, w, b = train_on(rest)
        for i in everyone[everyone % limits.folds == k]:
            margins[i] = float(w[rows[i]] @ unit(rows[i], ratio)) + b
    slope, offset = logistic(margins, (y > 0).astype(float), np.ones(len(rows)))
    ratio, w, b = train_on(everyone)
    return Model(known, ratio, w, b, slope, offset)


def score(docs: DataFrame, model: Model | Constant, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score, predicted."""
    shared = share(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        model = shared()

        def step(batch):
            schema = pa.schema([batch.schema.field(0), ("score", pa.float64())])
            return table_batch(schema, batch.column(0), [model.score(t) for t in batch.column(1).to_pylist()])

        return step

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = map_batches(slim, make, f"doc_id {kind}, score double")
    return rows.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, limits: Limits = Limits()) -> DataFrame:
    """Learn outside the held-out fold, score every document."""
    labelled = labels.where(fold("doc_id", modulus) != remainder).select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"))
    rows = score(docs, fit(docs, labelled, limits))
    return rows.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", "predicted")
