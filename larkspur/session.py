"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "larkspur", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, taken from ``spark.checkpoint.dir``.

    A local master may fall back to a temporary folder; on a cluster a missing setting is an error,
    because files in one machine's temporary folder are lost with that machine.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)  # remembered for the next call
    return path


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/larkspur/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a table in the shared folder and go on from that table."""
    path = new_folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Write ``df`` once as a table in the shared folder, bucketed and sorted by ``keys``.

    Joins and groupings by these keys read it without an exchange.  ``forget`` drops the name; the files stay.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"larkspur_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.option("path", new_folder(spark, "buckets")).bucketBy(n, keys[0], *keys[1:]).sortBy(keys[0], *keys[1:]).saveAsTable(name)
    table = spark.table(name)
    table.table_name = name
    return table


def forget(*tables: DataFrame) -> None:
    """Drop the names of bucketed tables that nothing will read again."""
    for table in tables:
        table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.table_name}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder; later steps do not depend on any executor that computed it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
