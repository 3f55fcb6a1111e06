"""Tables that are merged into bucket by bucket (SNK2, SNK6): a change rewrites only the buckets it touches."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.operators import runs
from larkspur.session import written

C = F.col
BUCKET, LIVE = "_bucket", "_live"


class Merge(NamedTuple):
    """What a merge did: the buckets it rewrote, and their rows before and after."""

    buckets: list[int]
    rows_before: int
    rows_after: int


def bucket_of(by: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def create_table(rows: DataFrame, path: str, by: list[str], buckets: int = 64) -> None:
    """Write a table in one folder for each bucket of the columns ``by``."""
    _write(rows.withColumn(LIVE, F.lit(True)).withColumn(BUCKET, bucket_of(by, buckets)), path)


def _schema(schema: StructType, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields] + [f"{LIVE} boolean", *more])


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of such a table, without the marks of emptied buckets."""
    return spark.read.schema(_schema(schema)).parquet(path).filter(C(LIVE)).drop(LIVE, BUCKET)


def _signature(rows: DataFrame) -> DataFrame:
    """Row count and an order-free sum of row hashes of each bucket."""
    columns = [c for c in rows.columns if c != BUCKET]
    return rows.groupBy(BUCKET).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sum"))


def merge(spark: SparkSession, path: str, schema: StructType, touched: DataFrame, by: list[str], change: Callable[[DataFrame], DataFrame], buckets: int = 64) -> Merge:
    """Apply ``change`` to the rows of the buckets that ``touched`` (columns ``by``) falls into.

    Only those folders are read.  The outcome is compared with them bucket by bucket, and only buckets that differ are
    rewritten, so a repeated merge changes nothing.  A bucket that loses all its rows keeps a mark, since an overwrite by
    partitions cannot empty one.
    """
    wanted = [r[0] for r in touched.select(bucket_of(by, buckets)).distinct().collect()]  # at most ``buckets``
    columns = schema.names
    stored = spark.read.schema(_schema(schema, f"{BUCKET} int")).parquet(path).filter(C(BUCKET).isin(wanted))
    live = stored.filter(C(LIVE)).drop(LIVE)
    after = written(change(live.select(columns)).select(columns).withColumn(BUCKET, bucket_of(by, buckets)))
    if not after.filter(~C(BUCKET).isin(wanted)).isEmpty():
        raise ValueError("the change makes rows outside the buckets it names")
    old, new = (_signature(x).select(C(BUCKET), F.struct("n", "sum").alias(name)) for x, name in ((live, "_o"), (after, "_n")))
    found = old.join(new, BUCKET, "full").filter(~C("_o").eqNullSafe(C("_n"))).select(BUCKET, F.coalesce("_o.n", F.lit(0)).alias("o"), F.coalesce("_n.n", F.lit(0)).alias("n")).collect()
    differ = sorted(r[0] for r in found)
    if differ:
        emptied = [r[0] for r in found if r.n == 0]
        marks = spark.createDataFrame([(b,) for b in emptied], f"{BUCKET} int").withColumn(LIVE, F.lit(False))
        _write(after.filter(C(BUCKET).isin(differ)).withColumn(LIVE, F.lit(True)).unionByName(marks, allowMissingColumns=True), path)
    return Merge(differ, sum(r.o for r in found), sum(r.n for r in found))


def upsert_into(spark: SparkSession, path: str, schema: StructType, delta: DataFrame, key: list[str], order: list[str], *, mode: str = "update", by: list[str] | None = None, buckets: int = 64) -> Merge:
    """``runs.upsert`` on a stored table; ``by`` (the key, or a part of it) is what the table is bucketed by."""
    by = by or key
    return merge(spark, path, schema, delta, by, lambda base: runs.upsert(base, delta, key, order, mode=mode), buckets)


def replace_into(spark: SparkSession, path: str, schema: StructType, evaluation: DataFrame, starts: DataFrame, projects: DataFrame, *, buckets: int = 64) -> Merge:
    """``runs.replace_if_newer`` on a table bucketed by project; also projects whose evaluation found nothing are replaced."""
    return merge(spark, path, schema, starts, ["project_id"], lambda base: runs.replace_if_newer(base, evaluation.join(starts.select("project_id"), "project_id", "left_semi"), starts, projects), buckets)
