"""Golden cases of scores and text predicates."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import scores, text, vectors


def one(spark, column, **values):
    rows = spark.range(1)
    for name, value in values.items():
        rows = rows.withColumn(name, F.lit(value))
    return rows.select(column).first()[0]


@pytest.mark.parametrize(
    ("content", "query", "expected"),
    [
        ("The bakery opens at dawn on market days", "bakery dawn market", 1.0),
        ("We saw a red kite", "a I red", 1.0),
    ],
)
def test_keyword_score(spark, content, query, expected):
    assert one(spark, text.keyword_score(F.lit(content), F.lit(query))) == pytest.approx(expected)


def test_keyword_score_takes_the_larger_branch(spark):
    got = one(spark, text.keyword_score(F.lit("The ferry sails at noon"), F.lit("ferry noon harbour ticket")))
    assert got >= 0.5


def test_keyword_entities(spark):
    got = one(spark, text.keyword_score(F.lit("Lunch near the canal with Tove"), F.lit("lunch canal"), F.array(F.lit("Tove"))))
    assert got == pytest.approx(1.0)


def test_keyword_score_is_ascii_only(spark):
    assert one(spark, text.ascii_lower(F.lit("ÀB"))) == "Àb"


@pytest.mark.parametrize(("edges", "connected", "expected"), [(3, 2, 0.55), (10, 5, 1.0), (0, 0, 0.0)])
def test_graph_score(spark, edges, connected, expected):
    assert one(spark, scores.graph_score(F.lit(connected), F.lit(edges))) == pytest.approx(expected)


@pytest.mark.parametrize(("hours", "expected", "slack"), [(0, 1.0, 1e-9), (720, 0.368, 1e-3), (2160, 0.05, 5e-3)])
def test_recency(spark, hours, expected, slack):
    now = 1_700_000_000
    assert one(spark, scores.recency(F.lit(now - hours * 3600), now)) == pytest.approx(expected, abs=slack)


def test_fused(spark):
    got = one(spark, scores.fused(F.lit(0.9), F.lit(0.6), F.lit(0.5), F.lit(0.3), F.lit(0.8)))
    assert got == pytest.approx(0.685, abs=1e-3)


def test_four_signals_prefer_the_recent(spark):
    recent = one(spark, scores.four_signals(F.lit(0.2), F.lit(0.8), F.lit(5), F.lit(1.0), True))
    old = one(spark, scores.four_signals(F.lit(0.1), F.lit(0.9), F.lit(10), F.lit(720.0), True))
    assert recent > old


@pytest.mark.parametrize("content", ["hi", "ok", "thanks!", "goodbye", "sure", "yes", "你好", "谢谢啊", "ERROR x", "x", "HTTP 503"])
def test_transient(spark, content):
    assert one(spark, text.is_transient(F.lit(content)))


@pytest.mark.parametrize("content", ["房租三千", "hello from the harbour", "I prefer tea", "nobody"])
def test_not_transient(spark, content):
    assert not one(spark, text.is_transient(F.lit(content)))


@pytest.mark.parametrize(
    ("content", "expected"),
    [("she usually takes the early tram", "Behavioral"), ("I want a window seat", "Assertion"), ("the sky", "Inference")],
)
def test_source_tier(spark, content, expected):
    assert one(spark, text.source_tier(F.lit(content), F.lit("Inference"))) == expected
    assert one(spark, text.source_tier(F.lit(content), F.lit("Behavioral"))) == "Behavioral"


def test_ids_between_chinese_characters(spark):
    assert one(spark, text.prefixed_ids(F.lit("单号QX417已签收"))) == ["QX417"]
    got = one(spark, text.prefixed_ids(F.lit("QX417 存于 b.rooms … CHAR(8) … B-2044 柜号…")))
    assert set(got) >= {"QX417", "B-2044"}


def test_preview_cuts_whole_characters(spark):
    for n in range(0, 12):
        for sample in ("abc", "aé日𝒳b", "日本語", "𝒳𝒳"):
            raw = sample.encode()
            expected = sample if len(raw) <= n else raw[:n].decode("utf-8", "ignore") + "…"
            assert one(spark, text.preview(F.lit(sample), n)) == expected


def test_bigrams(spark):
    assert sorted(one(spark, text.bigrams(F.lit("a𝒳bb")))) == sorted(["a𝒳", "𝒳b", "bb"])
    assert one(spark, text.bigrams(F.lit("a"))) == [] and one(spark, text.bigrams(F.lit(""))) == []


@pytest.mark.parametrize(("pattern", "expected"), [("", True), ("%", True), ("ab%", True), ("%bc", True), ("%b%", True), ("abc", True), ("b%", False), ("a_c", False)])
def test_like(spark, pattern, expected):
    assert one(spark, text.like(F.lit("abc"), pattern)) is expected


def test_forget_scores(spark):
    w = lambda **s: one(spark, scores.forget_score({k: F.lit(float(v)) for k, v in s.items()}))
    assert w(staleness=1) == pytest.approx(0.25)
    assert w(staleness=1, low_access=1, low_importance=1) == pytest.approx(0.65)
    assert w(staleness=1, low_access=1, low_importance=1, conflict=1, redundancy=1) >= 0.85 - 1e-9
    assert w(verified=1, centrality=1) == 0
    assert one(spark, scores.forget_action(F.lit(0.65))) == "Archive"
    assert one(spark, scores.forget_action(F.lit(0.35))) == "Decay"
    assert one(spark, scores.forget_action(F.lit(0.1))) == "Keep"


@pytest.mark.parametrize(
    ("tier", "uses", "importance", "expected"),
    [("working", 3, 0.1, "short_term"), ("working", 0, 0.8, "short_term"), ("short_term", 50, 0.3, "short_term"), ("short_term", 10, 0.7, "long_term"), ("working", 2, 0.5, "working")],
)
def test_promotion(spark, tier, uses, importance, expected):
    assert one(spark, scores.promoted(F.lit(tier), F.lit(uses), F.lit(importance))) == expected


def test_snowflake_round_trip(spark):
    made = scores.snowflake(F.lit(scores.ID_EPOCH_MS + 123456789), F.lit(1023).cast("long"), F.lit(4095).cast("long"))
    row = spark.range(1).select(made.alias("i")).select(scores.snowflake_ms(F.col("i")), scores.snowflake_worker(F.col("i")), scores.snowflake_sequence(F.col("i"))).first()
    assert tuple(row) == (scores.ID_EPOCH_MS + 123456789, 1023, 4095)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, vectors.cosine(a, b)) == pytest.approx(24 / 25)
    assert one(spark, vectors.squared_l2(a, b)) == pytest.approx(2)
    assert one(spark, vectors.inner(a, b)) == pytest.approx(24)
    assert one(spark, vectors.normalized(a)) == pytest.approx([0.6, 0.8])
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, zero)) == 0


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=30), st.text(max_size=30))
def test_keyword_score_stays_in_range(spark, content, query):
    rows = spark.createDataFrame([(content, query)], "c string, q string")
    got = rows.select(text.keyword_score(F.col("c"), F.col("q"))).first()[0]
    assert 0 <= got <= 1 and not math.isnan(got)
