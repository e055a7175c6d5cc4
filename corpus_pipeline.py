"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame, which run() writes as Parquet and reads again.  All but the last
return the columns of documents.  The first three drop rows, the fourth rewrites
texts, the last adds each document's rate in the mix and drops what has rate zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import compression, decontaminate, mixing, secrets, simhash
from palimpsest.llm.common import materialize, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the compression bands."""
    return compression.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that of the smallest id."""
    return simhash.keep_one(docs)


def clean_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole eight-word window of a benchmark item, and without two shorter items."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every reported secret replaced; n_chars follows the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens, rate and copies; the rate meets the target weights in expectation."""
    labelled = mixing.civility_domains(read(spark, sf_dir, "labels"))
    return mixing.mix_documents(docs, labelled, mixing.CIVILITY_TARGETS).where("rate > 0")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", clean_benchmarks),
    ("secret_scan", redact_secrets),
    ("mix", mix_sources),
]

# SimHash fingerprints need 64-bit XXH64, which the checking engine lacks; the stages'
# composition is tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
