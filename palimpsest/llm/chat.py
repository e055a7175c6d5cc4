"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A logging client often stores a conversation again after every turn.  Each
turn's role and text give two 64-bit hashes salted by the turn's position; the
rolling xor over the turns so far is the hash of that prefix.  A conversation
whose whole hash equals a proper prefix of another's is a snapshot and goes: an
anti-join of whole hashes with those prefixes that more conversations have than
end there.  Of equal conversations the smallest id stays.  What is left is rendered.

Turns are dealt out by ranges of (conversation, turn, text), so that a conversation of
any length, and turns of one number or without one, spread over tasks: a turn's
position is its row number inside its range plus the conversation's turns in the ranges
before it.  A range begins inside one conversation at most, so there are no more such
offsets than ranges.  Hashes are 128 bits together; texts are rendered in parts of at
most ``part_turns`` turns.

Defined results: null role renders as ``unknown`` and null text as empty; a null
turn comes first; turns with equal numbers are ordered by a digest of role and text;
repeated rows stay repeated; rows without a conversation id form one
conversation with a null id, which loses to an equal one with an id; texts are read
whole, however long; an empty table gives an empty result; other columns are never
read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize

PART_TURNS = 512


def _dealt(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, ranges: int | None) -> DataFrame:
    """conv_id, turn, role, text, m and ``range``, the number of the range a turn is in."""
    turns = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    said = turns.withColumn("m", F.md5(F.concat("role", F.lit("\n"), "text")))
    order = ["conv_id", "turn", "m", "row"]  # the row splits equal turns
    spread = said.repartitionByRange(ranges, *order) if ranges else said.repartitionByRange(*order)
    return materialize(spread.select("conv_id", "turn", "role", "text", "m", F.spark_partition_id().alias("range")), "turns")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _positions(dealt: DataFrame) -> DataFrame:
    """Adds ``at``: a turn's place in its conversation, from 0."""
    inside = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "m")
    numbered = dealt.withColumn("n", F.row_number().over(inside) - 1)
    sizes = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.sum("size").over(before).alias("offset")).where("offset is not null")
    # one offset a range at most: a table bounded by the number of ranges
    joined = numbered.join(F.broadcast(offsets), _same("conv_id", "c") & _same("range", "r"), "left")
    return joined.withColumn("at", F.col("n") + F.coalesce("offset", F.lit(0))).drop("c", "r", "offset", "n")


def _prefixes(dealt: DataFrame) -> DataFrame:
    """conv_id, n, x, y: the hashes of every conversation's first n turns."""
    hashed = dealt.select("conv_id", "range", "turn", "m", F.xxhash64("role", "text").alias("h"))  # texts stay where they are
    placed = _positions(hashed)
    salted = placed.select("conv_id", "range", "at", F.xxhash64("at", "h", "m").alias("x"), F.xxhash64("m", "at").alias("y"))
    inside = Window.partitionBy("conv_id", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolling = salted.select("conv_id", "range", "at", F.expr("bit_xor(x)").over(inside).alias("x"), F.expr("bit_xor(y)").over(inside).alias("y"))
    rolling = materialize(rolling, "rolling")
    ends = rolling.groupBy("conv_id", "range").agg(F.max_by(F.struct("x", "y"), "at").alias("e")).select("conv_id", "range", "e.*")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.expr("bit_xor(x)").over(before).alias("bx"), F.expr("bit_xor(y)").over(before).alias("by"))
    carried = carried.where("bx is not null")
    none = F.lit(0).cast("long")
    return rolling.join(F.broadcast(carried), _same("conv_id", "c") & _same("range", "r"), "left").select(
        "conv_id",
        (F.col("at") + 1).alias("n"),
        F.col("x").bitwiseXOR(F.coalesce("bx", none)).alias("x"),
        F.col("y").bitwiseXOR(F.coalesce("by", none)).alias("y"),
    )


def _kept(dealt: DataFrame) -> DataFrame:
    prefixes = materialize(_prefixes(dealt), "prefixes")
    whole = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("n", "x", "y"), "n").alias("w")).select("conv_id", "w.*")
    kept = whole.groupBy("n", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    # a prefix is proper if more conversations have it than end with it
    have = prefixes.groupBy("n", "x", "y").agg(F.count("*").alias("have"))
    proper = have.join(kept.select("n", "x", "y", "n_copies"), ["n", "x", "y"]).where("have > n_copies").select("n", "x", "y")
    return kept.join(proper, ["n", "x", "y"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def collapse(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", ranges: int | None = None) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that no longer one contains."""
    return _kept(_dealt(conversations, conv_id, turn, role, text, ranges))


def _render(dealt: DataFrame, kept: DataFrame, part_turns: int) -> DataFrame:
    chosen = kept.select(F.col("conv_id").alias("id"), "n_turns", "n_copies")
    alive = _positions(dealt).join(chosen, _same("conv_id", "id"))
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    grouped = alive.groupBy("conv_id", F.floor(F.col("at") / part_turns).alias("part")).agg(
        F.first("n_turns").alias("n_turns"),
        F.first("n_copies").alias("n_copies"),
        F.sort_array(F.collect_list(F.struct("at", line.alias("line")))).alias("lines"),
    )
    return grouped.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda r: r.line), "").alias("chat"))


def render(conversations: DataFrame, kept: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS, ranges: int | None = None) -> DataFrame:
    """One row for each kept conversation and part: ChatML text of its turns in order."""
    return _render(_dealt(conversations, conv_id, turn, role, text, ranges), kept, part_turns)


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS, ranges: int | None = None) -> DataFrame:
    """Collapse snapshots, then render what is left; turns are dealt out once."""
    dealt = _dealt(conversations, conv_id, turn, role, text, ranges)
    return _render(dealt, materialize(_kept(dealt), "conversations"), part_turns)


ORACLE = """
with said as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
lines as (
  select *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as line, md5(role || chr(10) || text) as m from said),
whole as (
  select conv_id, count(*) as n_turns, string_agg(line, '' order by turn nulls first, m) as chat from lines group by conv_id),
kept as (
  select min(conv_id) as conv_id, n_turns, count(*) as n_copies, chat from whole group by n_turns, chat)
select conv_id, cast(0 as bigint) as part, n_turns, n_copies, chat from kept k
where not exists (select 1 from kept o where o.n_turns > k.n_turns and starts_with(o.chat, k.chat))
"""
