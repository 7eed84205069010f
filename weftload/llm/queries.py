"""The operators as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from weftload.llm import chat, collocation, decontaminate, fingerprint, interpolation, jaccard_tree, merkle, mixture, packing, repeats, secrets, toxicity, wordpiece
from weftload.plans.registry import query


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op10_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_token_counts")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, folder, "documents"))


@query("op4_lm_scores")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return interpolation.lm_scores(table(spark, folder, "documents"))


@query("op1_decontamination")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark").select("item_id", *decontaminate.question_answer())
    return decontaminate.leaks(table(spark, folder, "documents"), items)


@query("op6_secret_scan")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


@query("op5_chat_collapse", chat.RENDER_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(table(spark, folder, "conversations"))


@query("op2_jaccard_join")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_tree.jaccard_components(table(spark, folder, "documents"), n=4, percent=85)


@query("op7_fingerprints")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, folder, "documents"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


@query("op8_repeats")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"))


@query("op11_manifest", merkle.CHECK_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.tampered_manifest(table(spark, folder, "documents"))


@query("op12_collocations", collocation.CHECK_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocation.collocations(table(spark, folder, "documents"))


@query("op13_mixture", mixture.CHECK_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix_documents(table(spark, folder, "documents"))
