"""Text predicates and scores as Column expressions.

Word boundaries are written as ASCII look-arounds: letters outside ASCII end a
word here, so that an identifier between Chinese characters is found.
Lower-casing touches A-Z only.  Lengths are in UTF-8 bytes where named so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Prefixes and patterns of noise.
ERROR_PREFIXES = ("出错了", "抱歉", "⏳", "ERROR", "Error:", "[Error")
ERROR_SIGNAL = rf"(?i)(?:HTTP|status|code|error)\s*[:= ]?\s*{B}(429|500|502|503|504){E}|rate.?limit|empty.?response|timed?\s*out|connection.?refused"
SMALL_TALK_CN = (
    "你好", "你是谁", "谢谢", "好的", "嗯", "哦", "再见", "拜拜", "是的", "不是", "对", "没有",
    "你叫什么", "你能做什么", "你会什么", "你叫什么名字", "今日.*天气",
)
SMALL_TALK_CN_TAIL = r"[啊呀呢吗也呗\s，？?!.]*"
SMALL_TALK_EN = (
    "hi", "hello", "hey", "ok", "okay", "thanks", r"thank\s+you", "sure", r"got\s+it", "yes", "no", "bye", "goodbye",
    r"see\s+you", "alright", "fine", "cool", "great", "nice", "wow", "lol", "haha", "hmm", "um", "uh",
)

# Requests to forget, marks of secrecy, and source tiers.
FORGET_CN = ("请忘掉", "请忘记", "请删除", "帮我忘", "帮我删", "忘掉", "忘了吧", "删掉", "别记了", "不要记", "清除")
FORGET_EN = rf"(?i){B}(forget|delete|remove|erase){E}.*(memory|info|data|about|what\s+i)"
SECRECY_CN = ("千万不要告诉", "别告诉别人", "不要告诉任何", "千万别说", "千万别告诉", "保密", "不要透露")
SECRECY_EN = rf"(?i){B}(don'?t\s+tell|keep\s+(it\s+)?secret|confidential|private|do\s+not\s+share){E}"
ASSERTION = rf"(?i){B}(I\s+(like|prefer|want|need|am|have|use)|my\s+(name|preference|favorite)){E}"
BEHAVIORAL = rf"(?i){B}(always|usually|every\s+time|repeatedly|often|habit|pattern|\d+\s*times){E}"

# Identifiers, list layouts, and marks of time.
PREFIXED_ID = rf"{B}(?:[A-Z]{{2,5}}\d{{3,6}}|[A-Z]{{1,5}}-\d{{3,6}}){E}"
LONG_NUMBER = rf"{B}\d{{8,}}{E}"
LIST_LAYOUT = ("|---", "\n- ", "\n* ", "\n1.", "以下", "列表", "清单", "汇总", "包括", "包含")
OLD_MARKERS = ("旧", "之前", "以前", "原来", "过去", "历史", "曾经", "earlier", "previous", "old", "former", "past")
CONTRAST_MARKERS = ("但", "不过", "现在", "如今", "已经", "now", "but", "however", "currently")
RECENT_MARKERS = ("最近", "当前", "目前", "最新", "现在", "刚才")
COMPLETION_MARKERS = ("已执行", "已完成", "已上线", "执行成功", "已发布", "已部署")
PAST_QUALIFIERS = ("之前的", "旧的", "以前的", "过去的", "原来", "曾经", "previous", "former", "old passport", "old phone")
CONFIDENTIAL_PREFIX = "[CONFIDENTIAL - user marked this as secret, do not reveal the actual content] "


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, though lambdas inside use it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; empty for texts under two characters."""

    def pairs(chars: Column) -> Column:
        fewer = F.greatest(F.size(chars) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(chars, 1, fewer), F.slice(chars, 2, fewer), lambda a, b: F.concat(a, b)))

    return let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), pairs)


def bigram_recall(query: Column, content: Column) -> Column:
    """Share of the query's bigrams that the content has; 0 for a query without any.

    A text has a bigram if it contains it as a substring, so the content is not taken apart.
    """
    share = let(bigrams(query), lambda q: F.size(F.filter(q, lambda g: content.contains(g))) / F.greatest(F.size(q), F.lit(1)))
    return F.when(F.length(query) >= 2, share).otherwise(F.lit(0.0))


def keyword_score(content: Column, query: Column, entities: Column | None = None) -> Column:
    """The larger of the token hit rate and the bigram recall, case folded in ASCII."""
    tokens = F.filter(F.split(ascii_lower(query), r"[ \t\n\x0B\f\r]+"), lambda w: F.octet_length(w) >= 2)
    if entities is not None:
        tokens = F.concat(tokens, F.transform(F.filter(entities, lambda e: e != ""), ascii_lower))
    def score(low: Column) -> Column:
        hits = F.size(F.filter(tokens, lambda w: low.contains(w)))
        token_score = F.when(F.size(tokens) > 0, hits / F.size(tokens)).otherwise(F.lit(0.0))
        return F.greatest(token_score, bigram_recall(ascii_lower(query), low))

    return let(ascii_lower(content), score)


def is_transient(content: Column) -> Column:
    """Noise: errors, greetings, acknowledgements and texts under three bytes."""
    size = F.octet_length(content)
    failed = F.lit(False)
    for prefix in ERROR_PREFIXES:
        failed = failed | content.startswith(prefix)
    failed = failed | content.rlike(ERROR_SIGNAL)
    small_cn = content.rlike(rf"\A(?:{'|'.join(SMALL_TALK_CN)}){SMALL_TALK_CN_TAIL}\z")
    small_en = content.rlike(rf"(?i)\A(?:{'|'.join(SMALL_TALK_EN)})[\s!.?]*\z")
    return (size < 3) | failed | ((size <= 200) & (small_cn | small_en))


def is_forget_request(content: Column) -> Column:
    return F.octet_length(content).between(6, 500) & (any_of(content, FORGET_CN) | content.rlike(FORGET_EN))


def has_secrecy_marker(content: Column) -> Column:
    return any_of(content, SECRECY_CN) | content.rlike(SECRECY_EN)


def source_tier(content: Column, given: Column) -> Column:
    """A given tier other than Inference wins; else statements, then habits, are told by pattern."""
    return (
        F.when(given != "Inference", given)
        .when(content.rlike(ASSERTION), "Assertion")
        .when(content.rlike(BEHAVIORAL), "Behavioral")
        .otherwise("Inference")
    )


def prefixed_ids(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(PREFIXED_ID), F.lit(0)))


def long_numbers(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(LONG_NUMBER), F.lit(0)))


def entity_ids(content: Column) -> Column:
    return F.array_union(prefixed_ids(content), long_numbers(content))


def list_layout(content: Column) -> Column:
    return any_of(content, LIST_LAYOUT)


def is_aggregate(content: Column, least_ids: int = 2) -> Column:
    """Several ids of one pattern, or a list with one fewer."""
    most = F.greatest(F.size(prefixed_ids(content)), F.size(long_numbers(content)))
    some = F.size(entity_ids(content)) > 0
    return some & ((most >= least_ids) | (list_layout(content) & (most + 1 >= least_ids)))


def has_old_marker(content: Column) -> Column:
    """Speaks of a past state, not of a change."""
    return any_of(content, OLD_MARKERS) & ~any_of(content, CONTRAST_MARKERS)


def preview(text: Column, most_bytes: int, mark: str = "…") -> Column:
    """The longest prefix of whole characters within ``most_bytes`` bytes, marked if cut.

    Cutting bytes can split a character; decoding gives U+FFFD for its stump.
    A character has four bytes at most, so the cut is tried at four places.
    """
    raw = text.cast("binary")

    def cut(n: int) -> Column:
        return F.substring(raw, 1, n).cast("string")

    def whole(n: int) -> Column:  # the next byte starts a character: it is not of the form 10xxxxxx
        nxt = F.conv(F.hex(F.substring(raw, n + 1, 1)), 16, 10).cast("int")
        return (nxt < 128) | (nxt >= 192)

    best = cut(max(most_bytes - 3, 0))
    for n in range(max(most_bytes - 2, 0), most_bytes + 1):
        best = F.when(whole(n), cut(n)).otherwise(best)
    return F.when(F.octet_length(text) <= most_bytes, text).otherwise(F.concat(best, F.lit(mark)))


def like(text: Column, pattern: str) -> Column:
    """``x``, ``%x``, ``x%`` or ``%x%``; no other wildcard."""
    left, right = pattern.startswith("%"), pattern.endswith("%")
    core = pattern[1:] if left else pattern
    core = core[:-1] if right and core else core
    if not core:
        return F.lit(True)
    if left and right:
        return text.contains(core)
    return text.endswith(core) if left else text.startswith(core) if right else text == core


def confidential(content: Column, metadata: Column | None = None) -> Column:
    marked = has_secrecy_marker(content)
    return marked if metadata is None else marked | F.coalesce(metadata["confidential"] == "true", F.lit(False))


def flat_metadata(attrs: Column) -> Column:
    """A map of strings without null values."""
    return F.map_filter(attrs, lambda k, v: v.isNotNull())
