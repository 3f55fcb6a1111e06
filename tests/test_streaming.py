"""Streams against their batch answers, over several micro-batches."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from larkspur.operators import incremental, notify
from larkspur.session import new_folder
from larkspur.streaming import events as st
from larkspur.streaming import stateful

C = F.col


def feed(spark, parts, run):
    """Write each part to the input folder and run the stream on what is new."""
    folder = new_folder(spark, "test")
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/input")
        stream = run(spark.readStream.schema(part.schema).parquet(f"{folder}/input"))
        st.run_append(stream, folder)
    return st.read_append(spark, folder, stream.schema)


def halves(df, key):
    return [df.filter(C(key) < 100), df.filter(C(key) >= 100)]


def make_events(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 2]), 60 * i + rng.randrange(30), f"k{rng.randrange(90)}" if i % 5 else None) for i in range(200)]
    return spark.createDataFrame(rows, "event_id long, organization_id long, sec long, dedup_key string").withColumn("created_at", F.timestamp_seconds("sec")).drop("sec")


def test_dedup_over_batches(spark):
    df = make_events(spark)
    out = feed(spark, halves(df, "event_id"), lambda s: st.dedup_events(s, delay="10 days"))
    want = df.filter("dedup_key IS NOT NULL").select("organization_id", "dedup_key").distinct().count() + df.filter("dedup_key IS NULL").count()
    assert out.count() == want


def test_rate_limit_stream_equals_batch(spark):
    df = make_events(spark).select("event_id", "organization_id", "created_at")
    out = feed(spark, halves(df, "event_id"), lambda s: stateful.rate_limit(s, scope="organization_id", limit=4, window_seconds=900))
    batch = notify.rate_limit(df, scope="organization_id", time="created_at", tie="event_id", limit=4, window_seconds=900)
    as_map = lambda rows: {r["event_id"]: r["allowed"] for r in rows.collect()}
    assert as_map(out) == as_map(batch)


def test_balance_alerts_once_per_crossing(spark):
    rows = [(1, "topup", 1000), (2, "usage_deduction", -600), (3, "usage_deduction", -100), (4, "usage_deduction", -400), (5, "usage_deduction", -300), (6, "topup", 900), (200, "usage_deduction", -500)]
    df = spark.createDataFrame([(7, i, k, a) for i, k, a in rows], "organization_id long, transaction_id long, kind string, amount_cents long").withColumn("created_at", F.timestamp_seconds("transaction_id"))
    out = feed(spark, halves(df, "transaction_id"), lambda s: stateful.balance_alerts(s, low_cents=500))
    got = [(r["transaction_id"], r["alert"], r["balance"]) for r in out.orderBy("transaction_id").collect()]
    assert got == [(2, "low", 400), (4, "rejected", 300), (5, "zero", 0), (200, "low", 400)]


def test_balance_alerts_at_the_mark_and_after_each_credit(spark):
    rows = [(1, "topup", 1000), (2, "usage_deduction", -500), (3, "usage_deduction", -100), (4, "topup", 50), (5, "usage_deduction", -20)]
    df = spark.createDataFrame([(7, i, k, a) for i, k, a in rows], "organization_id long, transaction_id long, kind string, amount_cents long").withColumn("created_at", F.timestamp_seconds("transaction_id"))
    out = feed(spark, [df], lambda s: stateful.balance_alerts(s, low_cents=500))
    assert [(r["transaction_id"], r["alert"], r["balance"]) for r in out.orderBy("transaction_id").collect()] == [(2, "low", 500), (5, "low", 430)]


def lifecycle(spark, rounds, facts, buckets=8):
    folder, key = new_folder(spark, "cycle"), ["project_id", "finding"]
    table = spark.createDataFrame(facts, "project_id long, extraction_run_id string, finding string")
    schema = "project_id long, extraction_run_id string, finished_at timestamp"
    for i, part in enumerate(rounds):
        rows = spark.createDataFrame(part, "project_id long, extraction_run_id string").withColumn("finished_at", F.timestamp_seconds(F.lit(1000 * i)))
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/input")
        st.finding_lifecycle(spark, spark.readStream.schema(schema).parquet(f"{folder}/input"), lambda: table, folder, key, buckets)
    return folder


FACTS = [(1, "a", "x"), (2, "a", "b"), (2, "a", "c"), (3, "a", "d"), (3, "b", "d"), (3, "b", "e"), (1, "other", "z"), (9, "a", None), (9, "a", "q")]


def test_an_emptied_project_is_resolved(spark):
    folder = lifecycle(spark, [[(1, "a"), (2, "a"), (3, "a"), (9, "a")], [(2, "b"), (3, "b")], [(2, "a"), (None, "a")]], FACTS)
    got = {i: sorted((r["project_id"], r["finding"] or "", r["event_type"]) for r in spark.read.parquet(f"{folder}/events/batch={i}").collect()) for i in range(3)}
    assert got[0] == [(1, "x", "detected"), (2, "b", "detected"), (2, "c", "detected"), (3, "d", "detected"), (9, "", "detected"), (9, "q", "detected")]
    assert got[1] == [(2, "b", "resolved"), (2, "c", "resolved"), (3, "e", "detected")]
    assert got[2] == [(2, "b", "detected"), (2, "c", "detected")]


def test_a_batch_writes_only_the_buckets_it_touches(spark):
    facts = [(p, r, f"f{i}") for p in range(200) for r in ("a", "b") for i in range(3)]
    folder = lifecycle(spark, [[(p, "a") for p in range(200)], [(7, "b")]], facts, buckets=64)
    rows = lambda i: spark.read.parquet(f"{folder}/snapshot/batch={i}").count()
    own = spark.range(200).filter(F.pmod(F.xxhash64("id"), F.lit(64)) == F.pmod(F.xxhash64(F.lit(7).cast("long")), F.lit(64))).count()
    assert rows(0) == 600 and rows(1) == 3 * own < 60
    assert [r["bucket"] for r in spark.read.parquet(f"{folder}/manifest/batch=1").collect()] == [r["bucket"] for r in spark.read.parquet(f"{folder}/snapshot/batch=1").select("bucket").distinct().collect()]


def test_a_repeated_batch_writes_the_same(spark):
    rounds = [[(1, "a"), (2, "a"), (3, "a")], [(3, "b"), (2, "none")]]
    folder = lifecycle(spark, rounds, FACTS)
    read = lambda: sorted(map(str, spark.read.parquet(f"{folder}/events").collect())) + sorted(map(str, spark.read.parquet(f"{folder}/snapshot").collect()))
    before, found = read(), []
    stream = spark.readStream.schema("project_id long, extraction_run_id string, finished_at timestamp").parquet(f"{folder}/input")
    table = spark.createDataFrame(FACTS, "project_id long, extraction_run_id string, finding string")
    original = st.run_batches
    st.run_batches = lambda s, f, on_batch, mode="append": found.append(on_batch)
    try:
        st.finding_lifecycle(spark, stream, lambda: table, folder, ["project_id", "finding"], 8)
    finally:
        st.run_batches = original
    again = spark.createDataFrame(rounds[1], "project_id long, extraction_run_id string").withColumn("finished_at", F.timestamp_seconds(F.lit(1000)))
    found[0](again, 1)
    assert read() == before


def test_signed_changes_and_the_stale_pass(spark):
    schema = "finding_id long, project_id long, suppressed boolean, severity string, depscore long"
    old = spark.createDataFrame([(1, 1, False, "high", 90), (2, 1, False, "low", 50), (3, 2, False, "high", 70), (4, 3, None, None, None), (5, 4, False, "high", 10)], schema)
    new = spark.createDataFrame([(1, 1, True, "high", 90), (2, 1, False, "high", 50), (3, 2, False, "high", 70), (6, 2, False, "low", 80), (4, 3, None, None, None), (5, 4, False, "high", 10)], schema)
    projects = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "project_id long")
    at = lambda s: F.timestamp_seconds(F.lit(s))
    stored = incremental.summarize(old, projects.filter("project_id < 4"), at(100))
    changed = incremental.changes(old, new, ["finding_id", "project_id"], ["suppressed", "severity", "depscore"])
    assert changed.count() == 5
    merged = incremental.apply_changes(stored, changed, at(200))
    rows = {r.project_id: (r.vuln_total, r.vuln_high, r.score_total, r.worst_depscore, r.computed_at is None) for r in merged.collect()}
    assert rows == {1: (1, 1, 50, None, True), 2: (2, 1, 150, 80, False), 3: (1, 0, 0, None, False)}
    assert sorted(r.project_id for r in incremental.stale_projects(merged, projects, at(50)).collect()) == [1, 4, 5]
    done = incremental.stale_pass(merged, new, projects, cut=at(50), at=at(300))
    whole = incremental.summarize(new, projects, at(300))
    assert sorted(map(tuple, done.drop("computed_at").collect()), key=str) == sorted(map(tuple, whole.drop("computed_at").collect()), key=str)
    assert incremental.stale_pass(merged, new, projects, cut=None, at=at(300)).filter(F.col("computed_at") == at(300)).count() == 5


def test_events_without_a_scope_share_one_limit(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 5, 10 * i) for i in range(20)], "event_id long, scope long, sec long").withColumn("created_at", F.timestamp_seconds("sec"))
    out = notify.rate_limit(df, scope="scope", time="created_at", tie="event_id", limit=3, window_seconds=1000).collect()
    assert len(out) == 20 and sorted(r["event_id"] for r in out if r["allowed"]) == [0, 1, 2, 3, 4, 5]


def test_sla_monitor_announces_once_and_honours_pauses(spark):
    schema = "finding_id string, kind string, sec long, warn_ms long, due_ms long, shift_ms long"
    start, hour = 1_700_000_000, 3600

    def row(finding, kind, after, warn=0, due=0, shift=0):
        return finding, kind, start + after, (start + warn) * 1000, (start + due) * 1000, shift * 1000

    first = [row(f, "clock", 1, hour, 2 * hour) for f in "abc"] + [row("b", "resume", 60, shift=100 * hour), row("c", "close", 90)]
    later = [row("tick", "clock", 5400, 900 * hour, 999 * hour)]
    last = [row("tick2", "clock", 9000, 900 * hour, 999 * hour)]
    frames = [spark.createDataFrame(p, schema).withColumn("event_time", F.timestamp_seconds("sec")).drop("sec") for p in (first, later, last)]
    out = feed(spark, frames, stateful.sla_monitor)
    assert sorted((r["finding_id"], r["alert"]) for r in out.collect()) == [("a", "breach"), ("a", "warning")]


def test_sla_monitor_keeps_one_state_for_many_findings(spark):
    """Three rounds of 3000 clocks over 8 buckets; the state store is asked by bucket, not by finding."""
    start = 1_700_000_000
    rows = [(f"f{i}", "clock", start + i // 1000 * 30, (start + i % 50) * 1000, (start + i % 50 + 20) * 1000, 0) for i in range(3000)]
    rows += [(f"f{i}", "close", start + 30, None, None, 0) for i in range(0, 1000, 10)] + [(f"f{i}", "resume", start + 30, None, None, 7000) for i in range(5, 1000, 10)]
    df = spark.createDataFrame(rows, "finding_id string, kind string, sec long, warn_ms long, due_ms long, shift_ms long").withColumn("event_time", F.timestamp_seconds("sec"))
    frames = [df.filter(C("sec") == start + 30 * n).drop("sec") for n in range(3)]
    out = feed(spark, frames, lambda s: stateful.sla_monitor(s, buckets=8))
    want = []
    for i in range(3000):
        shift = 7 if i < 1000 and i % 10 == 5 else 0
        for alert, instant in (("warning", start + i % 50), ("breach", start + i % 50 + 20)):
            seen = instant <= start  # by the watermark of the first round
            if (instant + (0 if seen else shift)) <= start + 60 and not (i < 1000 and i % 10 == 0 and not seen):
                want.append((f"f{i}", alert))
    assert sorted((r["finding_id"], r["alert"]) for r in out.collect()) == sorted(want)


def test_retry_until_given_up(spark):
    pending = spark.createDataFrame([(1, "pending"), (2, "pending")], "event_id long, status string")
    folder = new_folder(spark, "retry")
    pending.write.parquet(f"{folder}/input")
    stream = stateful.retry_stuck(spark.readStream.schema(pending.schema).parquet(f"{folder}/input"), wait_minutes=0.01, max_attempts=2)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline:
            time.sleep(1)
            rows = sorted(((r["event_id"], r["action"]) for r in spark.read.schema(stream.schema).parquet(f"{folder}/data").collect()))
            if len(rows) >= 6:
                break
    finally:
        query.stop()
    assert rows == [(1, "failed"), (1, "retry"), (1, "retry"), (2, "failed"), (2, "retry"), (2, "retry")]


def test_late_rows_are_dropped_and_counted(spark):
    at = lambda seconds: F.timestamp_seconds(F.lit(seconds))
    new = spark.createDataFrame([(1,), (2,)], "event_id long").withColumn("ts", at(1_000_000))
    old = spark.createDataFrame([(3,)], "event_id long").withColumn("ts", at(10))
    folder = new_folder(spark, "late")
    dropped = []
    for part in (new, old):
        part.write.mode("append").parquet(f"{folder}/input")
        stream = st.watermarked(spark.readStream.schema(part.schema).parquet(f"{folder}/input"), "ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
        counter = st.LateRows()
        spark.streams.addListener(counter)
        dropped.append(counter.of(st.run_append(stream, folder)))
        spark.streams.removeListener(counter)
    assert dropped == [0, 1] and st.read_append(spark, folder, stream.schema).count() == 2
