"""Quality rules by compression bands.

Zstandard ratios of the whole text and of fixed chunks reject repetitive or
incompressible text.  The limits depend on the text's length, as a short text
has no room to compress.

Defined results: null text counts as empty; an empty text has zero counts and
fails the base rule; repeated rows are judged one by one; a ratio equal to a limit
passes; texts are read whole, however long; an empty table gives an empty result; columns
beside the text are carried or left out but never read, and may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches, space_words, table_batch

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits by the text's UTF-8 bytes: (from bytes, least ratio, most ratio).

    The upper ones lie above the prose of sf0.1 that passes the base rule (most
    of each band: 0.909, 0.745, 0.698, 0.521, 0.453; of chunks 0.488) and below
    base64 and random letters and digits of that length.
    """

    whole: tuple[tuple[int, float, float], ...] = field(
        default=((128, 0.35, 0.93), (256, 0.35, 0.80), (512, 0.25, 0.72), (2048, 0.20, 0.65), (8192, 0.15, 0.60))
    )
    chunk_bytes: int = 4096
    chunk_low: float = 0.15
    chunk_high: float = 0.65
    chunk_share: float = 0.3
    level: int = 3


_ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1 for k in range(64)], dtype=np.uint64)


def repeated_window_words(words: list[bytes], width: int = 8) -> int:
    """How many words lie in a ``width``-word window that occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    rough = np.zeros(n, np.uint64)
    for k in range(width):
        rough += (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * _ODD[k]
    rough.sort()
    if not (rough[1:] == rough[:-1]).any():  # equal windows have equal sums
        return 0
    rank, span = ids, 1
    while span < width:  # exact classes of 2, 4, 8, ... words
        step = min(span, width - span)
        size = int(rank.max()) + 1
        rank = np.unique(rank[: len(rank) - step] * size + rank[step:], return_inverse=True)[1]
        span += step
    twice = np.flatnonzero(np.bincount(rank)[rank] >= 2)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = space_words(text)
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    blanks = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        points - blanks,
        sum(text.count(bytes([c])) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def ratios(text: bytes, press, bands: Bands) -> tuple[float, float, float]:
    """Whole ratio; shares of chunks below chunk_low and above chunk_high.

    The last chunk reaches back to be of full size, so every byte is measured.
    """
    size = bands.chunk_bytes
    whole = len(press(text)) / len(text) if text else 0.0
    if len(text) <= size:
        return whole, 0.0, 0.0
    starts = (min(i, len(text) - size) for i in range(0, len(text), size))
    chunks = [text[i : i + size] for i in starts]
    each = [len(press(x)) / len(x) for x in chunks]
    low = sum(r < bands.chunk_low for r in each) / len(each)
    high = sum(r > bands.chunk_high for r in each) / len(each)
    return whole, low, high


def in_band(n_bytes: int, measured: tuple[float, float, float], bands: Bands) -> bool:
    whole, low, high = measured
    if low > bands.chunk_share or high > bands.chunk_share:
        return False
    for least_bytes, least, most in reversed(bands.whole):
        if n_bytes >= least_bytes:
            return least <= whole <= most
    return True


OUT = pa.schema(
    [
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
        ("whole_ratio", pa.float64()),
        ("low_chunks", pa.float64()),
        ("high_chunks", pa.float64()),
    ]
)


def judge(text: bytes | None, press, bands: Bands) -> tuple:
    text = text or b""
    base = counts(text)
    failed = base_failed(base[0], base[4])
    measured = ratios(text, press, bands)
    return (*base, failed, not failed and in_band(len(text), measured, bands), *measured)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per document: its id, word and line counts, ratios and verdict."""

    def make():
        press = zstandard.ZstdCompressor(level=bands.level).compress

        def step(batch):
            found = [judge(t, press, bands) for t in batch.column(1).to_pylist()]
            schema = pa.schema([batch.schema.field(0), *OUT])
            return table_batch(schema, batch.column(0), *zip(*found, strict=True))

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, whole_ratio double, low_chunks double, high_chunks double"
    )
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(slim, make, schema)


def keep(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with all their columns; no shuffle."""
    at = docs.columns.index(text_col)

    def make():
        press = zstandard.ZstdCompressor(level=bands.level).compress

        def step(batch):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            return batch.filter(pa.array([judge(t, press, bands)[6] for t in texts], pa.bool_()))

        return step

    return map_batches(docs, make, docs.schema)
