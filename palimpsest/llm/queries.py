"""Registered queries of the corpus operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from palimpsest.llm import chat, compression, decontaminate, langid, licenses, mixing, nbsvm, secrets, simhash, toxicity
from palimpsest.llm.common import read


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.quality_domains(read(spark, sf_dir, "labels"))
    return mixing.mix(read(spark, sf_dir, "documents"), labelled, mixing.TARGETS, ["doc_id", "source"])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.measure(read(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_toxicity,
        op3_secret_scan,
        op4_mixing,
        op5_compression_bands,
        op6_simhash,
        op7_license_scan,
        op8_quality_nbsvm,
        op9_language_id,
        op10_decontaminate,
        pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_chat_format": chat.ORACLE, "op10_decontaminate": decontaminate.ORACLE}
