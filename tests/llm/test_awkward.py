"""Every operator and stage over nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import chat, compression, decontaminate, langid, licenses, mixing, nbsvm, secrets, simhash, toxicity
from palimpsest.llm.common import read

# names that the operators use inside, and those they return
CLASH = (
    "id", "y", "h", "one", "domain", "row", "words", "word", "key", "digest", "_digest", "_id", "_bad", "_key", "node", "fp", "fp1", "check", "part", "parts",
    "start", "end", "kind", "carried", "doc", "n", "n_tokens", "rate", "copies", "copies_in", "gap", "posterior", "p", "w0", "at", "spans", "items", "longest",
    "score", "labels", "held_out", "predicted", "n_words", "kept", "lang_pred", "range", "component_id", "root", "c", "m", "x", "told", "n_hit", "t", "item_id", "toxic", "quality",
)
PROSE = "a quiet morning by the harbour, where boats of every colour wait for the tide and gulls argue about yesterday's catch near stall {}"
ROWS = [
    (None, None, None, None), (None, PROSE.format(1), "en", None), (1, None, "en", "s"), (2, "", "en", "s"), (3, " \n\t ", None, "s"), (4, PROSE.format(2), "en", "s"), (4, PROSE.format(2), "en", "s"),
    (4, PROSE.format(3) + " idiot", "en", "s"), (5, PROSE.format(2), "fr", "s"), (6, "wörd " * 60_000, "de", None), (7, "idiot " + PROSE.format(9), "en", "s"),
    (8, "user: bob password: hunter22hunter22 " + PROSE.format(4), "en", "s"), (9, "日本語。テキスト", "ja", "s"), (10, PROSE.format(5), None, "s"), (11, "Under the MIT License", "en", "s"),
] + [(20 + k, " ".join(random.Random(k).choices(PROSE.split(), k=15)) + f" and number {k} " + " ".join(f"{chr(97 + j)}{k * 37 + j}" for j in range(12)), "en", "s") for k in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({c: F.lit(k) for k, c in enumerate(CLASH)}).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(d, int(d % 3 > 0), int(d % 4 == 0)) for d in range(4, 80)] + [(4, 0, 1), (4, 0, 1), (None, 1, 1), (5, None, None), (6, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality long, toxic long").withColumns({"id": F.lit(1), "y": F.lit(2), "domain": F.lit("x"), "text": F.lit("t")})


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, PROSE.format(2)), (None, "wait for the tide"), (2, None), (2, ""), (3, "under the mit license")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({"key": F.lit(1), "doc_id": F.lit(2)})


def operators(docs, labels, items):
    return {
        "toxicity": lambda: toxicity.toxicity(docs, labels),
        "secrets": lambda: secrets.scan(docs),
        "mixing": lambda: mixing.mix(docs, mixing.quality_domains(labels), mixing.TARGETS, ["doc_id", "source", "rate"]),
        "compression": lambda: compression.measure(docs),
        "simhash": lambda: simhash.near_duplicates(docs),
        "licenses": lambda: licenses.scan(docs),
        "nbsvm": lambda: nbsvm.quality(docs, labels),
        "langid": lambda: langid.identify(docs),
        "decontaminate": lambda: decontaminate.scan(docs, items),
        "decontaminate in blocks": lambda: decontaminate.scan(docs, items, block_words=5),
    }


NAMES = tuple(operators(None, None, None))


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.filterwarnings("ignore:the documents cannot meet")
def test_every_row_has_a_result(docs, labels, items, name):
    out = operators(docs, labels, items)[name]()
    ids = sorted(map(repr, (r.doc_id for r in out.collect())))
    assert ids == sorted(repr(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(docs, labels, items, name):
    assert operators(docs.limit(0), labels, items)[name]().count() == 0
    assert operators(docs.limit(0), labels.limit(0), items.limit(0))[name]().count() == 0


@pytest.mark.parametrize("name", ["toxicity", "nbsvm", "mixing", "decontaminate"])
def test_nothing_to_learn_from(docs, labels, items, name):
    assert operators(docs, labels.limit(0), items.limit(0))[name]().count() == len(ROWS)


def test_mixing_keeps_clashing_columns(docs, labels):
    out = mixing.mix_documents(docs, mixing.civility_domains(labels), mixing.CIVILITY_TARGETS)
    assert set(out.columns) == set(docs.columns) - {"n_tokens", "rate", "copies"} | {"n_tokens", "rate", "copies", "n_tokens_in", "rate_in", "copies_in_in"}
    assert {r.rate_in for r in out.collect()} == {CLASH.index("rate")}


def test_chats(spark):
    rows = [(None, 0, "user", "x"), (None, None, None, None), (1, 0, "user", "y" * 200_000), (1, 0, "user", "a"), (1, 1, None, ""), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, None, "user", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.withColumns({c: F.lit(1) for c in ("n", "at", "m", "h", "x", "c", "r", "range", "part", "id", "row", "size", "offset", "have", "n_copies", "lines")})
    out = {r.conv_id: r for r in chat.format_chats(table).collect()}
    assert set(out) == {None, 1, 2, 3} and out[2].n_turns == 3 and len(out[1].chat) > 200_000
    assert chat.format_chats(table.limit(0)).count() == 0


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.filterwarnings("ignore:the documents cannot meet")
def test_stages(spark, docs, labels, items, tmp_path, empty):
    """Five stages in turn over the awkward rows; columns stay until the last."""
    folder = tmp_path / "tables"
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    at = read(spark, str(folder), "documents")
    at = at.limit(0) if empty else at
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(folder))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "mix":
            assert out.columns == docs.columns
        seen.append(out.count())
        at = out
    assert seen == sorted(seen, reverse=True) and (seen[-1] > 0) != empty
