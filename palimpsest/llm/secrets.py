"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong finds (``assign``, ``access``, ``hex``) are always reported.  Weak parts
(``id``: account names and mail addresses; ``sec``: mixed tokens and short
passwords; ``url``: endpoints) are joined with other parts of the same text by
interval: the scope of a part reaches ``scope`` code points before its start and
after its end, and a weak part is reported only if a complementary part meets its
scope.  An id and an endpoint need a secret; a secret needs an id or an endpoint.
Access finds count as ids; assign and hex finds as secrets.  ``credentials`` names
for each linked secret the nearest id and the nearest endpoint in its scope.

The join takes two windows over each text's parts in order of their starts: among
the parts before one the largest end decides, among those after it the smallest
start, so that the work is linear in the parts whatever their lengths.  Each document
has a row key of its own: a hot source or a text with many copies is dealt out like
any other.  Texts without a part, nearly all, are never shuffled.

Defined results: null text counts as empty, and stays null when redacted; a text
without finds has zero counts and the digest of an empty string; repeated documents
are scanned one by one; of parts as near as each other the earlier is linked; texts are
read whole, however long; an empty table gives an empty result; spans are in code points,
end exclusive; other columns are never read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# The weak patterns, of this module's own choice.  Values, tokens and URLs are matched to
# their ends, however long; the parts of a mail address are bounded as its standards have it.
WEAK_ID = (
    r"""(?i:\b(?:user(?:name)?|login|account|client_?id|access_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
    r"""|[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,126}"""
)
WEAK_SECRET = (
    r"""(?i:\b(?:pwd|pass|passphrase|credential|auth))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}"""
    r"""|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}"""
)
WEAK_URL = (
    r"""\b(?:https?|ftp|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}"""
    r"""|(?i:\b(?:host|endpoint|server))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}"""
)

# kind, pattern, least characters of group 2 (0: no such group); in report order
KINDS = (
    ("assign", ASSIGN, 6),
    ("access", ACCESS, 0),
    ("hex", HEX, 0),
    ("id", WEAK_ID, 0),
    ("sec", WEAK_SECRET, 0),
    ("url", WEAK_URL, 0),
)
STRONG = 3
IDS, SECRETS, URLS = (1, 3), (0, 2, 4), (5,)
SCOPE = 200

_PART = "kind:int,gap:int,len:int,gap_bytes:int,len_bytes:int,good:boolean"


def _parts(text: Column) -> Column:
    """Per kind, for every match in order: code points and bytes before it since the last one, and of it.

    split() and regexp_extract_all() find the same leftmost non-overlapping
    matches, so the pieces between and the matches add up to the positions.
    Texts without a match skip the second pass.
    """
    return F.concat(*(F.coalesce(_matches(text, k, *rule), F.array().cast(f"array<struct<{_PART}>>")) for k, (_, *rule) in enumerate(KINDS)))


def _matches(text: Column, order: int, pattern: str, least: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def row(match: Column, gap: Column) -> Column:
        good = F.length(F.regexp_extract(match, pattern, 2)) >= least if least else F.lit(True)
        return F.struct(
            F.lit(order).alias("kind"), F.length(gap).alias("gap"), F.length(match).alias("len"),
            F.octet_length(gap).alias("gap_bytes"), F.octet_length(match).alias("len_bytes"), good.alias("good"),
        )

    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    return F.when(F.size(found) > 0, F.zip_with(found, between, row))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, parts of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), _parts(text).alias("parts"))


def located(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The parts of (row, parts) with their places, whether they are reported, and links of secrets.

    ``id_at`` and ``url_at``: (distance, start, end) of a secret's nearest id and endpoint.
    """
    each = rows.select("row", F.posexplode("parts").alias("at", "part")).select("row", "at", "part.*")
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumns(
        {
            "end": F.sum(F.col("gap") + F.col("len")).over(before).cast("int"),
            "end_byte": F.sum(F.col("gap_bytes") + F.col("len_bytes")).over(before).cast("int"),
        }
    ).withColumns({"start": F.col("end") - F.col("len"), "start_byte": F.col("end_byte") - F.col("len_bytes")})
    order = Window.partitionBy("row").orderBy("start", "kind")
    past, coming = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    start, end, kind = F.col("start"), F.col("end"), F.col("kind")

    def nearest(kinds: tuple[int, ...]) -> Column:
        here = F.when(F.col("good") & kind.isin(*kinds), F.struct(end.alias("end"), (-start).alias("less")))
        left = F.max(here).over(past)
        right = F.min(F.when(F.col("good") & kind.isin(*kinds), F.struct(start.alias("start"), end.alias("end")))).over(coming)
        a = F.when(left.end >= start - scope, F.struct(F.greatest(start - left.end, F.lit(0)).alias("far"), (-left.less).alias("start"), left.end.alias("end")))
        b = F.when(right.start <= end + scope, F.struct(F.greatest(right.start - end, F.lit(0)).alias("far"), right.start.alias("start"), right.end.alias("end")))
        return F.least(a, b)

    linked = placed.withColumns({"id_at": nearest(IDS), "secret_at": nearest(SECRETS), "url_at": nearest(URLS)})
    has = lambda c: F.col(c).isNotNull()
    told = F.when(kind.isin(3, 5), has("secret_at")).when(kind == 4, has("id_at") | has("url_at")).otherwise(F.lit(True))
    secret = F.col("good") & kind.isin(*SECRETS) & (has("id_at") | has("url_at"))
    return linked.select(
        "row", "kind", "start", "end", "start_byte", "end_byte", F.coalesce(F.col("good") & told, F.lit(False)).alias("told"),
        F.when(secret, F.col("id_at")).alias("id_at"), F.when(secret, F.col("url_at")).alias("url_at"), F.coalesce(secret, F.lit(False)).alias("credential"),
    )


def _line(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k, _, _ in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def _place(at: Column) -> Column:
    return F.coalesce(F.concat_ws(":", at.start, at.end), F.lit("-"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: counts of strong finds, their digest, all spans, and the credentials.

    ``credentials``: secret>id>endpoint of each linked secret by start, as start:end, or - where there is none.
    """
    rows = materialize(_numbered(docs, id_col, text_col), "parts")  # ids and places only
    told = located(rows.where(F.size("parts") > 0), scope)
    span = F.struct("start", "kind", "end")
    line = F.struct("start", "end", F.concat_ws(">", F.concat_ws(":", "start", "end"), F.when(F.col("id_at").isNull(), "-").otherwise(_place(F.col("id_at"))), F.when(F.col("url_at").isNull(), "-").otherwise(_place(F.col("url_at")))).alias("line"))
    together = told.groupBy("row").agg(
        *(F.count_if(F.col("told") & (F.col("kind") == k)).alias(f"n_{name}") for k, (name, _, _) in enumerate(KINDS[:STRONG])),
        F.sort_array(F.collect_list(F.when(F.col("told"), span))).alias("all"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("credential"), line))), lambda r: r.line), ",").alias("credentials"),
    )
    found = rows.where(F.size("parts") > 0).select("doc_id", "row").join(together, "row")
    base = F.filter("all", lambda s: s.kind < STRONG)
    some = found.select(
        "doc_id",
        *(f"n_{name}" for name, _, _ in KINDS[:STRONG]),
        F.sha2(_line(base).cast("binary"), 256).alias("base_sha256"),
        _line(F.col("all")).alias("spans"),
        "credentials",
    )
    none = rows.where(F.size("parts") == 0).select(
        "doc_id",
        *(F.lit(0).cast("long").alias(f"n_{name}") for name, _, _ in KINDS[:STRONG]),
        F.sha2(F.lit("").cast("binary"), 256).alias("base_sha256"),
        F.lit("").alias("spans"),
        F.lit("").alias("credentials"),
    )
    return some.unionByName(none)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """The documents with every reported span replaced; columns and rows stay.

    Spans that overlap or touch are replaced together.  Only the texts that hold a part
    are shuffled, and a text takes time in proportion to its length and its spans.
    """
    columns = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"), F.monotonically_increasing_id().alias("row"), _parts(text).alias("parts"))
    whole = materialize(whole, "scanned")
    some = whole.where(F.size("parts") > 0)
    told = located(some.select("row", "parts"), scope).where("told")
    # runs of spans that overlap or touch: a new one begins past the largest end so far
    order = Window.partitionBy("row").orderBy("start_byte", "end_byte")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = told.withColumn("new", F.coalesce(F.col("start_byte") > F.max("end_byte").over(past), F.lit(True)).cast("int"))
    runs = fresh.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = runs.groupBy("row", "run").agg(F.min("start_byte").alias("start"), F.max("end_byte").alias("end"))
    spans = merged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    met = some.select("doc", "row").join(spans, "row", "left")
    raw = F.col("doc").getField(text_col).cast("binary")
    cuts = F.concat(F.col("spans"), F.array(F.struct(F.octet_length(raw).alias("start"), F.octet_length(raw).alias("end"))))

    def piece(cut: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("spans"), i - 1).end)
        return F.substring(raw, begin + 1, cut.start - begin).cast("string")

    clean = F.when(F.col("spans").isNull(), F.col("doc").getField(text_col)).otherwise(F.array_join(F.transform(cuts, piece), mark))
    struck = met.select(*(clean.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in columns))
    kept = whole.where(F.size("parts") == 0).select(*(F.col("doc").getField(c).alias(c) for c in columns))
    return kept.unionByName(struck)
