"""From documents to training windows: each stage works on all that the one before kept.

Decisions are carried by a key that each stage gives its input rows: so rows without doc_id, and rows that
share one, are judged one by one. The key is a row's place in its file; only rows that don't come as
whole Parquet files are written for it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftload.llm import decontaminate, jaccard_tree, packing, secrets, toxicity
from weftload.session import written_table

ROW, FILE, PLACE, NUMBER = "_row_key", "_row_file", "_row_place", "_row_file_number"


def whole_files(docs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Rows with file and place, and the numbered files, if the rows are those of whole Parquet files, each once."""
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE))
    except AnalysisException:
        return None
    if {"_metadata", FILE, PLACE, NUMBER} & set(docs.columns):
        return None
    files = rows.groupBy(FILE).agg(F.count(PLACE).alias("n"), F.max(PLACE).alias("last"), F.sum(PLACE).alias("places"))
    files = written_table(files.coalesce(1).sortWithinPartitions(FILE).withColumn(NUMBER, F.monotonically_increasing_id()), "files")
    # a filter or a join leaves out rows or repeats some
    if not files.where("n <> last + 1 OR 2 * places <> n * (n - 1)").isEmpty():
        return None
    return rows, files.select(FILE, NUMBER)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, which stays as it is, whatever is computed again."""
    if found := whole_files(docs):
        rows, files = found  # a row per file: as many as Spark's own list of the input holds
        return rows.join(F.broadcast(files), FILE).withColumn(ROW, F.shiftleft(NUMBER, 40) + F.col(PLACE)).drop(FILE, PLACE, NUMBER)
    return written_table(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def by_row(rows: DataFrame) -> DataFrame:
    """What an operator reads of keyed rows: the key for a doc_id, and the text."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def without(rows: DataFrame, rejected: DataFrame, label: str) -> DataFrame:
    """Keyed rows whose key is not among the rejected ones (doc_id), as they came in."""
    gone = written_table(rejected.select(F.col("doc_id").alias(ROW)).distinct(), label)
    return rows.join(gone, ROW, "left_anti").drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go (score of 0.5 or more)."""
    rows = keyed(docs)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(rows, toxicity.score(by_row(rows), model).where("score >= 0.5"), "toxic").select(docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at a similarity of 0.8, the one of the smallest doc_id stays.

    A row without doc_id stays only if no row of its group has one; of equal ids one row stays.
    """
    rows = keyed(docs)
    groups = written_table(jaccard_tree.jaccard_components(by_row(rows), n=5, percent=80), "groups")
    groups = groups.select(F.col("doc_id").alias(ROW), "component_id").join(rows.select(ROW, F.col("doc_id").alias("_id")), ROW)
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col(ROW))
    first = groups.groupBy("component_id").agg(F.min_by(ROW, order).alias("_first"))
    copies = groups.join(first, "component_id").where(F.col(ROW) != F.col("_first"))
    return without(rows, copies.select(F.col(ROW).alias("doc_id")), "copies").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, question and answer, go."""
    rows = keyed(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", *decontaminate.question_answer())
    return without(rows, decontaminate.leaks(by_row(rows), items), "leaked").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each secret in a text becomes a mask, and n_chars follows."""
    return secrets.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in training windows of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_group),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack_windows),
]

#: Scores, searches and token ids aren't SQL; tests/llm/test_pipeline.py holds each stage against loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written_table(stage(spark, docs, sf_dir), name)
    return docs
