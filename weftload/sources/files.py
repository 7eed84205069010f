"""Reading and writing statements, progress records, rows and reports."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftload.functions.text import whole_div
from weftload.plans.workload import Loader, statements
from weftload.sources.vocabulary import content_digest
from weftload.spec import WorkloadSpec

PROGRESS_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
PROGRESS_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("process_index", T.IntegerType()),
        T.StructField("pid", T.LongType()),
        T.StructField("elapsed", T.DoubleType()),
        T.StructField("processed", T.LongType()),
        T.StructField("progress", T.StringType()),
        T.StructField("qps", T.StringType()),
        T.StructField("dps", T.StringType()),
    ]
)


def write_statements(
    stmts: DataFrame, path: str, files: int | None = None, total: int | None = None,
    in_order: bool = False,
) -> None:
    """One statement per line, each ended by ``;``, files and lines in emission order.

    With the ``total`` of rows, a statement's file follows from its position (leftovers
    have positions from ``total`` on and go to the last file). Otherwise the files are
    ranges found by sampling, which computes the statements twice. Neither sorts in one
    task. Batches of one template (``dense_batches``) come out ``in_order`` as they are.
    """
    if in_order:
        stmts.select("stmt").write.text(path)
        return
    if total is not None:
        count = files or int(stmts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        file = F.least(whole_div(F.col("pos") * count, total), F.lit(count - 1)).cast("int")
        placed = stmts.repartitionById(count, file)
    elif files:
        placed = stmts.repartitionByRange(files, "pos")
    else:
        placed = stmts.repartitionByRange("pos")
    placed.sortWithinPartitions("pos").select("stmt").write.text(path)


def normal_statement(line: Column) -> Column:
    """Without line ends and the closing ``;``."""
    return F.regexp_replace(F.regexp_replace(line, r"[\r\n]+$", ""), r";+$", "")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Statements of a text folder; empty lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(normal_statement(F.col("value")).alias("stmt"))


def preview(stmts: DataFrame, limit: int = 3) -> DataFrame:
    """The first statements; a top-k, not a full sort."""
    return stmts.orderBy("pos").limit(limit)


def more_than_preview(stmts: DataFrame, limit: int = 3) -> int:
    """How many statements a preview leaves out."""
    return max(0, stmts.count() - limit)


def content_of(spec: WorkloadSpec, load_words: Loader = None) -> dict[str, str]:
    """What the templates of a spec stand for, beyond their text.

    A digest of each word file's words, and class and fields of each custom pattern.
    """
    content: dict[str, str] = {}

    def remember(path: str):
        words = load_words(path)
        content[path] = content_digest(words)
        return words

    for template in spec.templates(remember if load_words else None):
        for placeholder in template.placeholders:
            pattern, make = placeholder.pattern, type(placeholder.pattern)
            if not make.__module__.startswith("weftload."):
                made_of = sorted((k, repr(v)) for k, v in vars(pattern).items())
                content[f"<{placeholder.text}>"] = f"{make.__module__}.{make.__qualname__}{made_of}"
    return content


def cached_statements(
    spark: SparkSession, spec: WorkloadSpec, folder: str, load_words: Loader = None
) -> DataFrame:
    """Generate once per fingerprint, then read the stored table.

    The fingerprint covers the words of word files: a changed word builds another table. A run
    that died leaves no success marker; its remains are replaced.
    """
    loader = cache(load_words) if load_words else None
    path = f"{folder.rstrip('/')}/{spec.fingerprint(content_of(spec, loader))}"
    if not _complete(spark, path):
        statements(spark, spec, load_words=loader).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _complete(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def bulk_write(rows: DataFrame, path: str, threads: int) -> None:
    """Append rows with ``threads`` parallel writers."""
    rows.repartition(threads).write.mode("append").parquet(path)


def bulk_write_jdbc(
    rows: DataFrame, url: str, table: str, threads: int, batch_size: int, **options: str
) -> None:
    """Append rows over ``threads`` connections, ``batch_size`` rows per statement."""
    writer = rows.repartition(threads).write.mode("append").format("jdbc")
    writer.options(url=url, dbtable=table, batchsize=str(batch_size), **options).save()


def write_progress(records: DataFrame, path: str) -> None:
    """Progress records as JSON lines, a folder per process."""
    records.write.mode("append").partitionBy("process_index").option(
        "timestampFormat", PROGRESS_TIME
    ).json(path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS_SCHEMA).option("timestampFormat", PROGRESS_TIME).json(path)


def stream_progress(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New progress files as a stream."""
    return (
        spark.readStream.schema(PROGRESS_SCHEMA)
        .option("timestampFormat", PROGRESS_TIME)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )


def write_report_table(table: DataFrame, path: str) -> None:
    """The compact report with ``;`` between columns."""
    table.write.option("sep", ";").option("header", True).csv(path)


def write_report_json(report: DataFrame, path: str) -> None:
    """One JSON object per run."""
    report.select("report.*").write.json(path)
