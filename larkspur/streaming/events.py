"""Structured Streaming forms of the continuous jobs (STR1, STR2, STR4-STR7, STR12-STR15)."""

from __future__ import annotations

import time as time_
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from larkspur.operators import notify as rules_
from larkspur.operators import runs
from larkspur.schemas import TABLES
from larkspur.session import new_folder, written

C = F.col


def stream_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """File stream over one table, be it a single Parquet file or a folder of them."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    reader = spark.readStream.schema(TABLES[name])
    return reader.parquet(path) if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_append(stream: DataFrame, folder: str) -> StreamingQuery:
    """Process what is there now and append to Parquet; exactly once, from the checkpoint."""
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def read_append(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/data")


def run_batches(stream: DataFrame, folder: str, on_batch: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what is there now, batch by batch, with a writer that is safe to repeat for one batch id."""
    query = (
        stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def run_updates(stream: DataFrame, folder: str) -> StreamingQuery:
    """Write every changed aggregate row under its batch; a repeated batch overwrites its own folder."""
    def on_batch(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}")

    return run_batches(stream, folder, on_batch, mode="update")


def latest_updates(spark: SparkSession, folder: str, key: list[str]) -> DataFrame:
    """Final value of every key over all batches written so far."""
    rows = spark.read.parquet(f"{folder}/data")
    return runs.dedup(rows, key, ["batch"]).drop("batch")


def watermarked(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermark on a time column of either timestamp type (zone-less times are read as UTC)."""
    return rows.withColumn(time, C(time).cast("timestamp")).withWatermark(time, delay)


def run_to_end(build: Callable[[DataFrame], DataFrame], source: DataFrame, folder: str, *, time: str, end: str) -> DataFrame:
    """Append-mode run over all that is there, then one closing row in the far future that moves the watermark past
    every open window.  Returns what was written; the caller drops the closing row's own window if it has one.
    """
    spark = source.sparkSession
    kind = dict(source.dtypes)[time]
    closing = spark.range(1).select(*[(F.lit(end).cast(kind) if f.name == time else F.lit(None).cast(f.dataType)).alias(f.name) for f in source.schema.fields])
    closing.limit(0).write.mode("append").parquet(f"{folder}/closing")
    for last in (False, True):
        if last:
            closing.write.mode("append").parquet(f"{folder}/closing")
        out = build(source.unionByName(spark.readStream.schema(source.schema).parquet(f"{folder}/closing")))
        run_append(out, folder)
    return read_append(spark, folder, out.schema)


def dedup_events(events: DataFrame, *, time: str = "created_at", delay: str = "1 hour") -> DataFrame:
    """One event per (organization, deduplication key) inside the delay; events without a key all pass."""
    keyed = watermarked(events.filter(C("dedup_key").isNotNull()), time, delay)
    free = watermarked(events.filter(C("dedup_key").isNull()), time, delay)
    return keyed.dropDuplicatesWithinWatermark(["organization_id", "dedup_key"]).unionByName(free)


def dedup_webhooks(webhooks: DataFrame, *, time: str = "created_at", delay: str = "1 hour") -> DataFrame:
    return watermarked(webhooks, time, delay).dropDuplicatesWithinWatermark(["delivery_id", "provider"])


def failure_window(runs_stream: DataFrame, *, time: str, failed: Column, key: list[str], length: str = "60 minutes", slide: str = "5 minutes", min_runs: int = 5, threshold: float = 5.0) -> DataFrame:
    """Sliding failure share; below ``min_runs`` runs the window never stops work."""
    out = watermarked(runs_stream, time, "10 minutes").groupBy(*key, F.window(time, length, slide)).agg(F.count("*").alias("runs"), F.count_if(failed).alias("failures"))
    pct = C("failures") * 100.0 / C("runs")
    return out.select(*key, C("window.start").alias("window_start"), "runs", "failures", F.round(pct, 4).alias("failure_pct"), ((C("runs") < min_runs) | (pct < threshold)).alias("should_run"))


def usage_meter(ledger: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """Charged cents per organization, feature and day."""
    used = watermarked(ledger.filter(C("kind") == "usage_deduction"), "created_at", delay)
    out = used.groupBy("organization_id", F.coalesce("feature", F.lit("other")).alias("feature"), F.window("created_at", "1 day")).agg(F.sum(F.abs("amount_cents")).alias("cents"))
    return out.select("organization_id", "feature", C("window.start").alias("day"), "cents")


def notify(events: DataFrame, rules: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Stream-static rule match; one delivery per (event, destination)."""
    return rules_.notify(watermarked(events, "created_at", delay), rules).dropDuplicatesWithinWatermark(["event_id", "destination"])


def batch_digest(events: DataFrame, *, window: str = "1 hour", delay: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """(critical events as they are, groups of the others per window, organization, project and type)."""
    critical = rules_.is_critical(C("event_type"), C("priority"))
    calm = watermarked(events.filter(~critical), "created_at", delay)
    groups = calm.groupBy(F.window("created_at", window), "organization_id", "project_id", "event_type").agg(F.count("*").alias("total"), F.min("event_id").alias("representative_id"))
    return events.filter(critical), groups.select(C("window.start").alias("window_start"), "organization_id", "project_id", "event_type", "total", "representative_id")


def session_activity(events: DataFrame, *, user: str, time: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Activity sessions: events of one user closer than the gap."""
    out = watermarked(events, time, delay).groupBy(user, F.session_window(time, gap)).agg(F.count("*").alias("events"))
    return out.select(user, C("session_window.start").alias("session_start"), C("session_window.end").alias("session_end"), "events")


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks dropped, per run of a query, over all its micro-batches.

    A query itself remembers its last 100 micro-batches only, and keeps its id when it starts again from its checkpoint.
    Add the listener to ``spark.streams`` before the query starts.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.runId)
        self.dropped[key] = self.dropped.get(key, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def of(self, query: StreamingQuery, wait_seconds: float = 30) -> int:
        """Rows dropped by an ended run, once its last event has come."""
        deadline = time_.monotonic() + wait_seconds
        while str(query.runId) not in self.ended and time_.monotonic() < deadline:
            time_.sleep(0.05)
        return self.dropped.get(str(query.runId), 0)


def stored_buckets(spark: SparkSession, folder: str, schema: StructType, touched: DataFrame, batch_id: int) -> DataFrame:
    """Rows of the touched buckets as they were before this batch; only the newest version of each is read.

    ``manifest`` tells in which batch a bucket was last written, and how many rows it got then.
    """
    empty = spark.createDataFrame([], schema)
    if batch_id == 0:
        return empty
    log = spark.read.schema("bucket int, rows long, batch long").parquet(f"{folder}/manifest").filter(C("batch") < batch_id)
    newest = log.groupBy("bucket").agg(F.max_by("rows", "batch").alias("rows"), F.max("batch").alias("batch"))
    found = newest.filter(C("rows") > 0).join(touched.select("bucket").distinct(), "bucket").collect()  # a row a bucket at most
    paths = [f"{folder}/snapshot/batch={r.batch}/bucket={r.bucket}" for r in found]
    return spark.read.schema(schema).parquet(*paths) if paths else empty


def finding_lifecycle(spark: SparkSession, finished: DataFrame, facts: Callable[[], DataFrame], folder: str, key: list[str], buckets: int = 256) -> StreamingQuery:
    """Detected and resolved events out of a stream of finished runs (project_id, extraction_run_id, finished_at).

    A finished run says that its project is complete, so a run that found nothing resolves all that was stored.  ``facts``
    gives the fact table at the time of a batch; ``key`` starts with project_id.  Of several runs of a project in one
    batch the last counts.  The stored findings lie in ``buckets`` folders by project: a batch reads the newest version of
    the buckets it touches and writes those anew.  All it writes is named by the batch and it reads earlier batches
    only, so a repeated batch writes the same again.
    """
    schema = StructType([f for f in facts().schema.fields if f.name in key])
    where = F.pmod(F.xxhash64("project_id"), F.lit(buckets)).cast("int")

    def on_batch(rows: DataFrame, batch_id: int) -> None:
        last = runs.dedup(rows.filter(C("project_id").isNotNull()), ["project_id"], ["finished_at", "extraction_run_id"])
        touched = written(last.select("project_id", "extraction_run_id", where.alias("bucket")))
        now = written(facts().join(touched.select("project_id", "extraction_run_id"), ["project_id", "extraction_run_id"], "left_semi").select(key).distinct())
        stored = stored_buckets(spark, folder, schema, touched, batch_id)
        before = stored.join(touched.select("project_id"), "project_id", "left_semi")
        runs.advisory_delta(now, before, key).write.mode("overwrite").parquet(f"{folder}/events/batch={batch_id}")
        after = now.unionByName(stored.join(touched.select("project_id"), "project_id", "left_anti")).withColumn("bucket", where)
        path = f"{folder}/snapshot/batch={batch_id}"
        after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        kept = spark.read.schema("project_id long, bucket int").parquet(path).groupBy("bucket").agg(F.count("*").alias("rows"))
        marks = touched.select("bucket").distinct().join(kept, "bucket", "left").select("bucket", F.coalesce("rows", F.lit(0)).alias("rows"))
        marks.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch_id}")  # last: the batch is whole

    return run_batches(finished, folder, on_batch)


def summary_refresh(changes: DataFrame, folder: str, compute: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Recompute summaries only for the projects that a micro-batch touches.

    ``compute`` maps a (project_id) table to summary rows.  A daily full pass is one more call with all projects.
    """
    def on_batch(rows: DataFrame, batch_id: int) -> None:
        compute(rows.select("project_id").distinct()).write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}")

    return run_batches(changes, folder, on_batch)
