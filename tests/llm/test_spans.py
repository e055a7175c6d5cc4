"""Weak parts of any length are reported and replaced whole."""

import random
import string

import pytest

from palimpsest.llm import secrets

ENDPOINT = "host = db.example.org"
DRAW = random.Random(6)
SIGNATURE = "aB3" + "".join(DRAW.choices(string.ascii_letters + string.digits + "_-", k=339))
LATE = {
    "digit": "".join(DRAW.choices(string.ascii_letters, k=60)) + "7x",
    "capital": "".join(DRAW.choices(string.ascii_lowercase + string.digits, k=60)) + "1Xy",
    "small": "".join(DRAW.choices(string.ascii_uppercase + string.digits, k=60)) + "1xY",
}
LONG = {
    "signature": SIGNATURE,
    "value": "pwd=" + "k.Z9/" * 200,
    "huge": "aB3" + "".join(DRAW.choices(string.ascii_letters + string.digits, k=200_000)),
    **LATE,
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, f"{ENDPOINT} {secret} tail") for name, secret in LONG.items()]
    rows += [("url", f"pwd=hunter22 https://example.org/{'a/b?c=' * 300} tail"), ("id", f"pwd=hunter22 user={'bob.' * 100} tail")]
    rows += [("mail", f"pwd=hunter22 bob@{'a.' * 8}example.org tail")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    spans = {r.doc_id: r.spans.split(",") for r in secrets.scan(docs).collect()}
    return dict(rows), spans, {r.doc_id: r.text for r in secrets.redact(docs).collect()}


@pytest.mark.parametrize("name", LONG)
def test_long_secrets(found, name):
    texts, spans, clean = found
    start = len(ENDPOINT) + 1
    assert spans[name] == [f"url:0:{len(ENDPOINT)}", f"sec:{start}:{start + len(LONG[name])}"]
    assert clean[name] == "[SECRET] [SECRET] tail"


@pytest.mark.parametrize("name", ["url", "id", "mail"])
def test_long_partners(found, name):
    texts, spans, clean = found
    assert len(spans[name]) == 2 and clean[name] == "[SECRET] [SECRET] tail"
