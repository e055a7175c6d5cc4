"""SimHash near-duplicates found through vantage-point trees.

Fingerprints are 64 bits.  All pairs within ``radius`` bits are found exactly,
in two layers of vantage-point trees:

* Shards.  Over all 64 bits distances to any vantage point crowd around 32, and
  with radius 4 most points lie near every boundary, so a plain tree copies
  more than it prunes.  The bits are cut into ``m`` blocks instead; a pair
  within ``radius`` agrees on some ``m - radius`` blocks.  For each choice of
  blocks the Hamming distance over those bits is a metric in which the search
  radius is zero, the triangle bound then prunes every ring but one, and the
  rings around the zero word and the unit words spell the bits themselves.  So a
  shard's name is its choice and those bits, and no boundary overlaps.
* Trees.  Within a shard a vantage-point tree over the full distance splits at
  the median; a query descends on both sides when it lies within ``radius`` of
  the boundary and otherwise on one.

``m`` grows with the number of fingerprints so that shards stay small.  A shard
larger than ``shard_rows`` is dealt into parts; each pair of parts is a task of
its own, so no task holds more than two parts.  Each task returns a spanning
forest of its links, not the pairs.

``near_duplicates`` links 4-word fingerprints within 4 bits.  ``keep_one`` looks for
texts that share 0.8 or more of their five-word shingles, which differ by some 10 of 64
bits: too many to search by.  It searches fingerprints of word pairs within 8 bits, and
a pair of texts counts if their five-word fingerprints differ by at most 14 bits too.

Defined results: null or wordless text has fingerprint zero, linked like any
other; repeated rows share a component; a null id is left out of a component's
smallest id, and a component of null ids only has a null id; ties of an id go to the
text of the smaller digest; texts are read whole, however long; an empty table gives an
empty result; other columns are carried or left out, never read, and may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches, materialize, table_batch
from palimpsest.operators.components import components

RADIUS, SHINGLE, SEED = 4, 4, 42


@dataclass(frozen=True)
class Alike:
    """When texts are near duplicates: words of the searched and of the checked shingles, and most bits apart."""

    width: int = 2
    radius: int = 8
    check_width: int = 5
    check_radius: int = 14


def fingerprint(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Bit k is 1 if set in over half the shingles' hashes; signed 64 bits."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", widths: tuple[int, ...] = (SHINGLE,)) -> DataFrame:
    """doc_id, a digest of the text and fp, fp1, ... (signed 64 bits) for the shingle widths, of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"fp{k or ''}" for k in range(len(widths))]

    def make():
        def step(batch):
            schema = pa.schema([batch.schema.field(0), batch.schema.field(1), *((n, pa.int64()) for n in names)])
            texts = batch.column(2).to_pylist()
            return table_batch(schema, batch.column(0), batch.column(1), *([fingerprint(t, w) for t in texts] for w in widths))

        return step

    slim = docs.select(
        F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("digest"), F.col(text_col).cast("binary").alias("text")
    )
    return map_batches(slim, make, f"doc_id {kind}, digest long, " + ", ".join(f"{n} long" for n in names))


def text_key(text):
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(text))


def blocks(m: int) -> list[tuple[int, int]]:
    """(first bit, bits) of m blocks over 64 bits."""
    edges = [64 * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def plan(count: int, radius: int = RADIUS, target: int = 4096) -> int:
    """The fewest blocks whose shards are expected to hold at most ``target``."""
    m = radius + 1
    while m < 2 * radius + 1 and count / 2 ** (64 * (m - radius) // m) > target:
        m += 1
    return m


def shard_keys(m: int, radius: int = RADIUS):
    """An array column of (choice, bits): the shards of a fingerprint."""
    out = []
    for choice, picked in enumerate(combinations(blocks(m), m - radius)):
        value = F.lit(0).cast("long")
        for first, bits in picked:
            part = F.shiftrightunsigned(F.col("fp"), first).bitwiseAND(F.lit((1 << bits) - 1))
            value = F.shiftleft(value, bits).bitwiseOR(part)
        out.append(F.struct(F.lit(choice).alias("choice"), value.alias("key")))
    return F.array(*out)


def search(values: np.ndarray, queries: np.ndarray, stored: np.ndarray, radius: int, leaf: int = 512):
    """Yield (query rows, stored rows) within ``radius`` bits, through a vantage-point tree."""
    todo = [(queries, stored)]
    while todo:
        q, s = todo.pop()
        if not len(q) or not len(s):
            continue
        if len(s) > leaf:
            vantage = values[s[len(s) // 2]]
            ds = np.bitwise_count(values[s] ^ vantage).astype(np.int64)
            middle = int(np.median(ds))
            inside = ds <= middle
            if not inside.all():
                dq = np.bitwise_count(values[q] ^ vantage).astype(np.int64)
                todo.append((q[dq <= middle + radius], s[inside]))
                todo.append((q[dq > middle - radius], s[~inside]))
                continue
        rows = max(1, 500_000 // len(s))
        for at in range(0, len(q), rows):
            some = q[at : at + rows]
            i, j = np.nonzero(np.bitwise_count(values[some][:, None] ^ values[s][None, :]) <= radius)
            if len(i):
                yield some[i], s[j]


def merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after linking i with j: the larger root is hung on the smaller until none differ."""
    while True:
        a, b = root[i], root[j]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return root
        a, b, i, j = a[apart], b[apart], i[apart], j[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def forest(nodes: np.ndarray, values: np.ndarray, checks: np.ndarray, side: np.ndarray, radius: int, check_radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest: within side 0 if there is no side 1, else across."""
    everyone = np.arange(len(values))
    left, right = everyone[side == 0], everyone[side == 1]
    root = everyone.copy()
    for i, j in search(values, left, right if len(right) else left, radius):
        if check_radius < 64:
            near = np.bitwise_count(checks[i] ^ checks[j]) <= check_radius
            i, j = i[near], j[near]
        root = merged(root, i, j)
    linked = np.flatnonzero(root != everyone)
    return nodes[linked], nodes[root[linked]]


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _shard_links(radius: int, check_radius: int):
    """Links within each run of equal (choice, key, part) of a sorted partition."""

    def run(batches):
        kept: list[np.ndarray] = []

        def links(rows: np.ndarray):
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(rows)]
            found = [
                forest(rows[a:b, 3], rows[a:b, 4].view(np.uint64), rows[a:b, 5].view(np.uint64), rows[a:b, 6], radius, check_radius)
                for a, b in zip(starts, ends, strict=True)
                if b - a > 1
            ]
            a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [])
            if len(a):
                yield table_batch(_EDGE, pa.array(a, pa.int64()), pa.array(b, pa.int64()))

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7)], axis=1)
            if not len(rows):
                continue
            rows = np.concatenate([*kept, rows])
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from links(rows[:cut])
            kept = [rows[cut:]]
        if kept:
            yield from links(kept[0])

    return run


def links(distinct: DataFrame, count: int, radius: int = RADIUS, shard_rows: int = 20_000, check_radius: int = 64) -> DataFrame:
    """Edges (a, b) that connect all nodes alike enough, a forest a shard.

    ``distinct``: node, fp and check; nodes are alike if their fp are within ``radius`` bits
    and their check within ``check_radius`` (64: any).
    """
    m = plan(count, radius)
    rows = distinct.select("node", "fp", "check", F.explode(shard_keys(m, radius)).alias("s")).select("s.choice", "s.key", "node", "fp", "check")
    sizes = rows.groupBy("choice", "key").count().where(F.col("count") > shard_rows)
    hot = materialize(sizes.select("choice", "key", F.ceil(F.col("count") / shard_rows).cast("long").alias("parts")), "shards")
    if hot.isEmpty():
        dealt = rows.select("choice", "key", F.lit(0).cast("long").alias("part"), "node", "fp", "check", F.lit(0).alias("side"))
    else:
        with_parts = rows.join(hot, ["choice", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
        mine = F.pmod(F.xxhash64("node"), F.col("parts"))
        # a part meets itself and each other part once; `part` names the pair of parts
        dealt = (
            with_parts.withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .select(
                "choice",
                "key",
                (F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")).alias("part"),
                "node",
                "fp",
                "check",
                (F.col("mine") > F.col("other")).cast("int").alias("side"),
            )
        )
    sorted_rows = dealt.repartition("choice", "key", "part").sortWithinPartitions("choice", "key", "part")
    return sorted_rows.mapInArrow(_shard_links(radius, check_radius), "a long, b long")


def groups(nodes: DataFrame, radius: int = RADIUS, check_radius: int = 64, shard_rows: int = 20_000) -> DataFrame:
    """(node, component_id) for every distinct node of (doc_id, node, fp, check)."""
    distinct = materialize(nodes.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("fp").alias("fp"), F.any_value("check").alias("check")), "fingerprints")
    found = components(links(distinct, distinct.count(), radius, shard_rows, check_radius)).select(F.col("node").alias("n"), "root")
    linked = materialize(distinct.join(found, F.col("node") == F.col("n")).select("node", "root", "first"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(least, "root").select("node", "least")
    alone = distinct.join(named, "node", "left_anti").select("node", F.col("first").alias("component_id"))
    return materialize(named.select("node", F.col("least").alias("component_id")).unionByName(alone), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex) and component_id."""
    prints = materialize(fingerprints(docs, id_col, text_col), "prints").withColumn("node", F.col("fp"))
    found = groups(prints.withColumn("check", F.lit(0).cast("long")), radius)
    return prints.join(found, "node").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: Alike = Alike(), shard_rows: int = 4096) -> DataFrame:
    """The documents with one of each component: that of the smallest id.

    Nodes are distinct texts.  Rows that repeat the same id and text are one document.
    """
    prints = fingerprints(docs, id_col, text_col, (alike.width, alike.check_width))
    prints = materialize(prints.withColumnsRenamed({"digest": "node", "fp1": "check"}), "prints")
    named = prints.join(groups(prints, alike.radius, alike.check_radius, shard_rows), "node")
    # (id, node) orders the rows of a component; a null id comes last
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("node"))
    component = F.when(F.col("component_id").isNull(), F.col("node"))  # null ids only: one for each text
    chosen = named.groupBy("component_id", component.alias("c")).agg(F.min(order).alias("best"), F.count("*").alias("n"))
    chosen = materialize(chosen.select("best.id", "best.node"), "chosen")
    # the documents ride in a struct, so that no name of theirs can clash
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_col).alias("key"), text_key(F.col(text_col)).alias("digest"))
    kept = whole.join(chosen, F.col("key").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("node")), "left_semi")
    again = prints.select("doc_id", F.col("node").alias("digest")).join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("node")))
    again = again.groupBy("doc_id", "digest").count().where("count > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["key", "digest"])
    return kept.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
