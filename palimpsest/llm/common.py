"""Tokenizers, label folds and shared storage used by the corpus operators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.storage import materialize

__all__ = ["bounded_sample", "document_frequency", "fold", "held_out", "labelled_texts", "map_batches", "materialize", "plain_words", "read", "renamed", "share", "space_words", "table_batch"]

_PLAIN = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    """Lower-case A-Z, then runs of ASCII letters, digits and non-ASCII bytes."""
    return text.translate(_PLAIN).split()


def space_words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D (bytes.split uses just these)."""
    return text.split()


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    return F.coalesce(fold(doc_id, modulus) == remainder, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def renamed(docs: DataFrame, *taken: str) -> DataFrame:
    """``docs`` with columns that have one of the names ``taken`` moved to ``<name>_in``."""
    names = {c.lower() for c in docs.columns} | {t.lower() for t in taken}
    for name in docs.columns:
        if name.lower() in {t.lower() for t in taken}:
            new = f"{name}_in"
            while new.lower() in names:
                new += "_in"
            names.add(new.lower())
            docs = docs.withColumnRenamed(name, new)
    return docs


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcasts ``value``; the function returned gives it back on an executor.

    The value travels with the code of its class, which a plain broadcast would
    look up on the worker.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get() -> object:
        return cloudpickle.loads(sent.value)

    return get


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Arrow batches through ``make()``'s function; ``make`` runs once a partition."""

    def run(batches: Iterable[pa.RecordBatch]):
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def table_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def document_frequency(docs: DataFrame, text_col: str, vocabulary: Iterable[bytes]) -> dict[bytes, int]:
    """In how many documents each vocabulary word occurs; words of none are absent.

    One pass over all documents; each partition adds up its own counts first.
    The result is bounded by the vocabulary.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frozenset(vocabulary))
    out = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        words, counts = known.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(words.intersection(plain_words(text)))
        rows = list(counts.items())
        for i in range(0, len(rows), 50_000):
            yield table_batch(out, *zip(*rows[i : i + 50_000], strict=True))

    part = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "word binary, n long")
    table = part.groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))


def bounded_sample(ids: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, the first by a hash of ``key``: the same at every run."""
    return ids.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(limit)


def labelled_texts(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, y, text) of the ``picked`` rows (id, y), a bounded sample.

    One row for each id, so that documents that repeat an id add no rows: of their
    texts the first by a hash.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    met = texts.join(F.broadcast(picked.select("id", "y")), "id")  # as many rows as the sample's limit
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("one")
    return met.groupBy("id", "y").agg(one).select("id", "y", "one.text")
