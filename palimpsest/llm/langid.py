"""Language identification, words first, with backoff to character n-grams.

A known word adds its log frequency in each language.  An unseen word is
scored by its character n-grams: the longest size at which any of its n-grams
is known, then progressively shorter ones down to single letters.  Words are runs of
letters and of the marks that combine with them, by Unicode category; punctuation and
digits of any script end a word.

Only text and the language label of training rows are learned from.  The model
is fitted on a bounded sample of each language and knows all its words; prediction
reads every whole text.

Defined results: null text, or text without a letter, is ``und`` with score 0;
letters of which no n-gram is known give the most frequent language; ties go to
the first language by name; equal texts of a language are learned from once and repeated
documents are predicted one by one; if no labelled row is left to learn from, all texts
are ``und``; an empty table gives an empty result; columns other than id, text and
language are never read and may have any names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import fold, held_out, map_batches, materialize, share, table_batch

_ASCII = bytes(b if chr(b).isalpha() and b < 128 else 32 for b in range(256))
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Limits:
    """How many distinct documents of each language are learned from, and the sizes of n-grams."""

    documents: int = 1000
    sizes: tuple[int, ...] = (4, 3, 2, 1)


def letters(text: str) -> list[bytes]:
    """Lower-cased words in UTF-8; marks without a letter are none."""
    low = text.lower()
    if low.isascii():
        return low.encode().translate(_ASCII).split()
    return [w.encode("utf-8", "replace") for w in _WORD.findall(low) if w.isalpha() or _LETTER.search(w)]


def grams(word: str, size: int) -> list[str]:
    padded = f" {word} " if size > 1 else word
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


class Model:
    def __init__(self, counts: dict[str, dict[bytes, int]], sizes: tuple[int, ...]):
        self.names = sorted(counts)
        self.sizes = sizes
        n = len(self.names)
        words = sorted({w for c in counts.values() for w in c})
        self.ids = {w: i for i, w in enumerate(words)}
        table = np.zeros((len(words), n))
        char: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(n)) for _ in sizes]
        for k, name in enumerate(self.names):
            for word, count in counts[name].items():
                table[self.ids[word], k] = count
                text = word.decode("utf-8", "replace")
                for level, size in zip(char, sizes, strict=True):
                    for g in grams(text, size):
                        level[g][k] += count
        self.known = self._logs(table)
        self.char = []
        for level in char:
            keys = list(level)
            rows = self._logs(np.array([level[g] for g in keys])) if keys else np.zeros((0, n))
            self.char.append(dict(zip(keys, rows, strict=True)))
        self.prior = table.sum(axis=0)

    @staticmethod
    def _logs(table: np.ndarray) -> np.ndarray:
        """Log frequencies, smoothed, less each row's mean: only differences matter."""
        logs = np.log((table + 0.1) / (table.sum(axis=0) + 0.1 * len(table) + 1))
        return logs - logs.mean(axis=1, keepdims=True) if len(table) else logs

    def unseen(self, word: bytes) -> np.ndarray:
        text = word.decode("utf-8", "replace")
        for level, size in zip(self.char, self.sizes, strict=True):
            rows = [level[g] for g in grams(text, size) if g in level]
            if rows:
                return sum(rows) / len(rows)
        return np.zeros(len(self.names))

    def predict(self, text: str | None, cache: dict[bytes, np.ndarray]) -> tuple[str, float]:
        if not text or not self.names:
            return "und", 0.0
        words = letters(text)
        if not words:
            return "und", 0.0
        total = np.zeros(len(self.names))
        counts = Counter(words)
        get = self.ids.get
        ids, times = [], []
        for word, n in counts.items():
            i = get(word)
            if i is not None:
                ids.append(i)
                times.append(n)
            else:
                row = cache.get(word)
                if row is None:
                    if len(cache) >= 100_000:
                        cache.clear()
                    row = cache[word] = self.unseen(word)
                total += n * row
        if ids:
            total += np.array(times) @ self.known[ids]
        if not total.any():
            total = np.log(self.prior + 1)
        best = int(total.argmax())
        return self.names[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def fit(docs: DataFrame, train: DataFrame, limits: Limits = Limits(), lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """``train``: the rows of ``docs`` to learn from, with non-null text and label.

    Each language gives at most ``limits.documents`` distinct texts, picked by a hash of
    id and text; all their words are kept.
    """
    have = {r[0]: r[1] for r in train.groupBy(lang_col).count().collect()}
    if not have:
        return Model({}, limits.sizes)
    # about twice as many rows as wanted by a hash, equal texts taken once, then exactly as many as wanted
    share = F.create_map(*(F.lit(x) for name, n in have.items() for x in (name, min(1.0, 2.0 * limits.documents / n))))
    slim = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    drawn = slim.where((F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")])
    once = drawn.groupBy("lang", "text").agg(F.min("h").alias("h"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    picked = materialize(once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limits.documents).select("lang", "text"), "sample")
    out = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[lang].update(letters(text))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        for i in range(0, len(rows), 50_000):
            yield table_batch(out, *zip(*rows[i : i + 50_000], strict=True))

    table = picked.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[bytes, int]] = {name: {} for name in have}
    for lang, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[lang][word] = n
    return Model(counts, limits.sizes)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    shared = share(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        model, cache = shared(), {}

        def step(batch):
            out = [model.predict(t, cache) for t in batch.column(1).to_pylist()]
            schema = pa.schema([batch.schema.field(0), ("lang_pred", pa.string()), ("score", pa.float64())])
            return table_batch(schema, batch.column(0), *zip(*out, strict=True))

        return step

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(slim, make, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2, limits: Limits = Limits()) -> DataFrame:
    """Learn from the rows outside the held-out fold and predict every row."""
    train = docs.where((fold("doc_id", modulus) != remainder) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = fit(docs, train, limits)
    return predict(docs, model).select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "lang_pred", "score")
