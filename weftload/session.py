"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "weftload", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs here expect.

    AQE stays on (coalescing, skew join); the time zone is pinned because tumbling
    windows over zoned timestamps depend on it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder that every executor can read and write.

    Uses the folder named by ``spark.checkpoint.dir``. A machine-local folder is
    only acceptable when there is a single machine, i.e. on a local master.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="weftload-")
    return f"{root.rstrip('/')}/weftload-{label}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, label: str) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage (a lost executor re-reads a file instead of recomputing
    the upstream) and gives the optimizer the exact size of the table, so the
    choice between a broadcast and a shuffle join rests on a measured size.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
