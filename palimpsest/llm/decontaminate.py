"""Benchmark decontamination by a prefix-filtered set join.

An item's windows of ``width`` consecutive words are the sets to be contained.
Words are ordered by rarity over the whole corpus; as containment must be
complete, a window's necessary prefix is its single rarest word.  A document
word that is some window's prefix word proposes that window at one position
only; the length bound drops proposals that overhang the document, and the
words are then compared.

The benchmark is the stated query set.  Its index is built in blocks of at most
``block_words`` words, one block at a time: a block is sent out, all documents are read
against it, what was hit is written, and the block is dropped before the next is built.  So
what is broadcast and held is bounded however long the benchmark or one item of it.  With
several blocks a document's hits meet on its text's digest; texts do not move.

Defined results: null or wordless text has no words, hits or items; a null item
id is written as the empty string and counts as an item; repeated items count once per id;
repeated documents are judged one by one; an empty benchmark hits nothing; texts are read
whole, however long; an empty table gives an empty result; other columns are carried or left
out, never read, and may have any names.

A scan calls a document contaminated if ``least_items`` items have windows in it.
Cleaning also drops a document in which one window of at least ``lone_words`` words
occurs, as a whole passage of a single item is a leak too; a shorter item, which
may stand there by chance, needs a second one.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import document_frequency, map_batches, materialize, plain_words, share, table_batch

WIDTH, BLOCK_WORDS = 8, 1_000_000


def windows(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


class Index:
    """Windows by their rarest word and its offset."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], rarity: dict, width: int):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, words in items:
            for window in windows(words, width):
                owners[window].add(item)
        self.by_word: dict[bytes, list[tuple[int, tuple[bytes, ...], tuple[str, ...]]]] = defaultdict(list)
        for window, ids in owners.items():
            offset = min(range(len(window)), key=lambda k: (rarity.get(window[k], 0), window[k], k))
            self.by_word[window[offset]].append((offset, window, tuple(sorted(ids))))
        self.by_word = dict(self.by_word)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Merged intervals of hit words, the items whose windows occur, and the longest window's words."""
        spans, found, longest, index, n = [], set(), 0, self.by_word, len(words)
        for at, word in enumerate(words):
            if word in index:
                for offset, window, ids in index[word]:
                    start = at - offset
                    if start >= 0 and start + len(window) <= n and tuple(words[start : start + len(window)]) == window:
                        spans.append((start, start + len(window)))
                        found.update(ids)
                        longest = max(longest, len(window))
        return merge(spans), found, longest


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def blocks(benchmark: DataFrame, item_col: str, item_text: str, width: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Blocks of (item, words) of at most ``block_words`` words, or of one piece.

    An item longer than a block is cut into pieces that overlap by ``width`` - 1 words, so
    that every window is whole in one of them.  One partition is on the driver at a time.
    """
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(item_text).cast("binary")).toLocalIterator()
    block, size, most, out = [], 0, max(block_words, width), False
    for item, text in rows:
        words = plain_words(bytes(text or b""))
        for at in range(0, max(1, len(words) - width + 1), most):
            piece = words[at : at + most + width - 1]
            if block and size + len(piece) > block_words:
                yield block
                block, size, out = [], 0, True
            block.append((item or "", piece))
            size += len(piece)
    if block or not out:
        yield block


def _index(docs: DataFrame, block: list, text_col: str, width: int) -> Index:
    """The index of a block; rarity comes from all documents."""
    return Index(block, document_frequency(docs, text_col, {w for _, words in block for w in words}), width)


def leaked(items: Iterable[str], longest: int, least: int, lone: int | None) -> bool:
    return len(items) >= least or (lone is not None and longest >= lone)


def digest(n_words: int, spans: list[tuple[int, int]], items: Iterable[str], longest: int, least: int, lone: int | None) -> tuple:
    items = sorted(items)
    return (
        n_words,
        sum(b - a for a, b in spans),
        len(items),
        hashlib.sha256(",".join(items).encode()).hexdigest(),
        leaked(items, longest, least, lone),
        items,
    )


SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
OUT = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()),
        ("items", pa.list_(pa.string())),
    ]
)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    least_items: int = 2,
    block_words: int = BLOCK_WORDS,
    lone_words: int | None = None,
) -> DataFrame:
    """One row per document: hit words, occurring items and the verdict."""
    kind = docs.schema[id_col].dataType.simpleString()
    whole = blocks(benchmark, item_col, item_text, width, block_words)
    first, second = next(whole), next(whole, None)
    if second is None:
        index = share(docs.sparkSession, _index(docs, first, text_col, width))

        def make():
            found = index()

            def step(batch):
                out = []
                for text in batch.column(1).to_pylist():
                    words = plain_words(text or b"")
                    out.append(digest(len(words), *found.hits(words), least_items, lone_words))
                return table_batch(pa.schema([batch.schema.field(0), *OUT]), batch.column(0), *zip(*out, strict=True))

            return step

        slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
        return map_batches(slim, make, f"doc_id {kind}, {SCHEMA}")
    found = _together(docs, chain([first, second], whole), text_col, width)

    def make_last():
        def step(batch):
            rows = zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)
            out = [digest(n, merge(zip((s or [])[::2], (s or [])[1::2], strict=True)), ids or [], longest or 0, least_items, lone_words) for n, s, ids, longest in rows]
            return table_batch(pa.schema([batch.schema.field(0), *OUT]), batch.column(0), *zip(*out, strict=True))

        return step

    # the same words as plain_words, with A-Z beside a-z
    n = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), n.alias("n"), _key(text_col).alias("digest")).join(found, F.col("digest") == F.col("key"), "left")
    return map_batches(rows.select("doc_id", "n", "spans", "items", "longest"), make_last, f"doc_id {kind}, {SCHEMA}")


def _key(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


_PART = pa.schema([("key", pa.string()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64())])


def _together(docs: DataFrame, whole: Iterable[list], text_col: str, width: int) -> DataFrame:
    """key, spans, items, longest of the texts that any block hits; blocks are run in turn."""
    slim = docs.select(_key(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    parts = []
    for block in whole:
        sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(_index(docs, block, text_col, width)))

        def make(sent=sent):
            found = cloudpickle.loads(sent.value)

            def step(batch):
                out = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    spans, ids, longest = found.hits(plain_words(text or b""))
                    if spans:
                        out.append((key, [x for s in spans for x in s], sorted(ids), longest))
                return table_batch(_PART, *(zip(*out, strict=True) if out else ([], [], [], [])))

            return step

        hit = map_batches(slim, make, "key string, spans array<long>, items array<string>, longest long")
        # copies of a text give equal rows: one for each text and block
        once = hit.groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items"), F.first("longest").alias("longest"))
        parts.append(materialize(once, "hits"))
        sent.unpersist()
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("longest").alias("longest")
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    width: int = WIDTH, least_items: int = 2, block_words: int = BLOCK_WORDS, lone_words: int | None = WIDTH,
) -> DataFrame:
    """The documents without a leak, with all their columns."""
    whole = blocks(benchmark, item_col, item_text, width, block_words)
    first, second = next(whole), next(whole, None)
    if second is None:
        index, at = share(docs.sparkSession, _index(docs, first, text_col, width)), docs.columns.index(text_col)

        def make():
            found = index()

            def step(batch):
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                hits = (found.hits(plain_words(t or b"")) for t in texts)
                return batch.filter(pa.array([not leaked(items, longest, least_items, lone_words) for _, items, longest in hits], pa.bool_()))

            return step

        return map_batches(docs, make, docs.schema)
    found = _together(docs, chain([first, second], whole), text_col, width)
    enough = F.size("items") >= least_items
    bad = found.where(enough if lone_words is None else enough | (F.col("longest") >= lone_words)).select("key")
    # the documents ride in a struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), _key(text_col).alias("digest"))
    kept = rows.join(bad, F.col("digest") == F.col("key"), "left_anti")
    return kept.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select coalesce(cast(item_id as varchar), '') as item, w, least({WIDTH}, len(w)) as size from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
g as (select distinct item, size, array_to_string(w[k:k + size - 1], ' ') as words from (select *, unnest(range(1, len(w) - size + 2)) as k from i)),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as k from d),
z as (select distinct size from g),
s as (select doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') as words from p cross join z where k + size - 1 <= len(w)),
o as (select doc_id, k, s.size, item from s join g on s.size = g.size and s.words = g.words),
h as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(k, k + size)) as x from o) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from o) group by 1)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""
