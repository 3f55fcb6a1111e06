"""Registered queries that run streams to the end of the given data and return what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import incremental, notify, summaries
from larkspur.operators.filters import active_run
from larkspur.plans import domain
from larkspur.plans.common import events_now, stamp
from larkspur.plans.domain import EVENTS_NOW
from larkspur.plans.registry import query
from larkspur.session import new_folder, written
from larkspur.streaming import events as st
from larkspur.streaming import stateful

C = F.col
TS = "'%Y-%m-%d %H:%M:%S'"
LONG = "400 days"


def stream_view(v, view: str, base: str) -> DataFrame:
    """A domain view over a file stream instead of a table."""
    name = f"stream_{base}_{uuid.uuid4().hex}"
    st.stream_table(v.spark, base, v.sf_dir).createOrReplaceTempView(name)
    return v.spark.sql(domain.SPARK_VIEWS[view].replace("{" + base + "}", name))


def appended(v, stream: DataFrame, label: str) -> DataFrame:
    folder = new_folder(v.spark, label)
    st.run_append(stream, folder)
    return st.read_append(v.spark, folder, stream.schema)


def updated(v, stream: DataFrame, label: str, key: list[str]) -> DataFrame:
    folder = new_folder(v.spark, label)
    st.run_updates(stream, folder)
    return st.latest_updates(v.spark, folder, key)


@query("str1_dedup_events", "SELECT DISTINCT organization_id, dedup_key, 1 AS copies FROM notification_events WHERE dedup_key IS NOT NULL UNION ALL SELECT organization_id, NULL, count(*) FROM notification_events WHERE dedup_key IS NULL GROUP BY 1")
def _(v):
    out = appended(v, st.dedup_events(stream_view(v, "notification_events", "events"), delay=LONG), "dedup-events")
    return out.groupBy("organization_id", "dedup_key").agg(F.count("*").alias("copies"))


@query("str2_dedup_webhooks", "SELECT DISTINCT delivery_id, provider FROM webhook_deliveries")
def _(v):
    return appended(v, st.dedup_webhooks(stream_view(v, "webhook_deliveries", "events"), delay=LONG), "dedup-webhooks").select("delivery_id", "provider")


def _limit_sql(columns: str) -> str:
    """Decisions one event after the other: the times allowed so far are the state of a scope."""
    return f"""
    WITH RECURSIVE o AS MATERIALIZED (SELECT event_id, organization_id, epoch_us(created_at) AS t, row_number() OVER (PARTITION BY organization_id ORDER BY created_at, event_id) AS n FROM notification_events),
    s AS (SELECT organization_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS recent, CAST(NULL AS BIGINT) AS event_id, false AS allowed FROM (SELECT DISTINCT organization_id FROM o)
      UNION ALL SELECT organization_id, n, CASE WHEN len(r) < 8 THEN list_append(r, t) ELSE r END, event_id, len(r) < 8
      FROM (SELECT o.*, list_filter(s.recent, lambda x: x > o.t - 21600000000) AS r FROM s JOIN o ON o.organization_id IS NOT DISTINCT FROM s.organization_id AND o.n = s.n + 1))
    SELECT {columns} FROM s WHERE n > 0"""


@query("str3_rate_limit", _limit_sql("event_id, organization_id, allowed"))
def _(v):
    return notify.rate_limit(v.notification_events, scope="organization_id", time="created_at", tie="event_id", limit=8, window_seconds=6 * 3600).select("event_id", "organization_id", "allowed")


@query("str3_rate_limit_stream", _limit_sql("CAST(organization_id AS VARCHAR) AS scope, event_id, allowed"))
def _(v):
    return appended(v, stateful.rate_limit(stream_view(v, "notification_events", "events"), scope="organization_id", limit=8, window_seconds=6 * 3600), "rate-limit")


@query("str4_failure_window", f"""
    SELECT user_id, strftime(w, {TS}) AS window_start, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failures, round(count(*) FILTER (WHERE event_type = 'error') * 100e0 / count(*), 4) AS failure_pct, count(*) < 5 OR count(*) FILTER (WHERE event_type = 'error') * 100e0 / count(*) < 5 AS should_run
    FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(5 * k) AS w FROM events CROSS JOIN (SELECT unnest(range(0, 12)) AS k)) GROUP BY user_id, w""")
def _(v):
    out = st.failure_window(st.stream_table(v.spark, "events", v.sf_dir), time="ts", failed=C("event_type") == "error", key=["user_id"])
    return updated(v, out, "failure-window", ["user_id", "window_start"]).withColumn("window_start", stamp("window_start"))


@query("str5_usage_meter", f"SELECT organization_id, coalesce(feature, 'other') AS feature, strftime(CAST(created_at AS DATE), {TS}) AS day, CAST(sum(abs(amount_cents)) AS BIGINT) AS cents FROM ledger WHERE kind = 'usage_deduction' GROUP BY 1, 2, 3")
def _(v):
    out = st.usage_meter(stream_view(v, "ledger", "orders"))
    return updated(v, out, "usage-meter", ["organization_id", "feature", "day"]).withColumn("day", stamp("day"))


RULES = f"""ok AS (SELECT r.*, unnest(destinations) AS destination FROM notification_rules r WHERE active AND trigger_type <> 'weekly_digest' AND (snoozed_until IS NULL OR snoozed_until <= TIMESTAMP '{EVENTS_NOW}') AND NOT (scope = 'team' AND scope_id IN (SELECT team_id FROM teams WHERE notifications_paused_until > TIMESTAMP '{EVENTS_NOW}'))
    AND NOT (scope = 'project' AND scope_id IN (SELECT project_id FROM projects WHERE notifications_paused_until > TIMESTAMP '{EVENTS_NOW}'))),
    m AS (SELECT e.event_id, k.rule_id, k.destination FROM notification_events e JOIN ok k ON (k.scope = 'organization' AND k.scope_id = e.organization_id) OR (k.scope = 'team' AND k.scope_id = e.team_id) OR (k.scope = 'project' AND k.scope_id = e.project_id)
      WHERE NOT coalesce(e.event_type = 'vulnerability_discovered' AND e.depscore < k.min_depscore_threshold, false))"""


def usable(v):
    return notify.usable_rules(v.notification_rules, v.teams, v.projects, now=events_now())


@query("jn26_matching_rules", f"WITH {RULES} SELECT DISTINCT event_id, rule_id FROM m")
def _(v):
    return notify.matching_rules(v.notification_events, usable(v)).select("event_id", "rule_id")


@query("str6_notify", f"WITH {RULES} SELECT DISTINCT event_id, destination FROM m")
def _(v):
    return appended(v, st.notify(stream_view(v, "notification_events", "events"), usable(v), delay=LONG), "notify").select("event_id", "destination")


@query("str7_batch_digest", f"""
    SELECT strftime(date_trunc('hour', created_at), {TS}) AS window_start, organization_id, project_id, event_type, count(*) AS total, min(event_id) AS representative_id FROM notification_events WHERE priority <> 'critical' GROUP BY 1, 2, 3, 4
    UNION ALL SELECT 'now', organization_id, project_id, event_type, 1, event_id FROM notification_events WHERE priority = 'critical'""")
def _(v):
    critical, groups = st.batch_digest(stream_view(v, "notification_events", "events"))
    loud = appended(v, critical, "critical").select(F.lit("now").alias("window_start"), "organization_id", "project_id", "event_type", F.lit(1).cast("long").alias("total"), C("event_id").alias("representative_id"))
    calm = updated(v, groups, "digest", ["window_start", "organization_id", "project_id", "event_type"]).withColumn("window_start", stamp("window_start"))
    return calm.select(loud.columns).unionByName(loud)


@query("str8_retry_stuck", f"SELECT event_id, CASE WHEN dispatch_attempts < 3 THEN 'retry' ELSE 'failed' END AS action, dispatch_attempts + CASE WHEN dispatch_attempts < 3 THEN 1 ELSE 0 END AS dispatch_attempts FROM notification_events WHERE status = 'pending' AND created_at < TIMESTAMP '{EVENTS_NOW}' - INTERVAL 10 MINUTE")
def _(v):
    return notify.retry_stuck(v.notification_events, now=events_now()).select("event_id", "action", "dispatch_attempts")


@query("str11_balance_alerts", """
    WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY created_at, transaction_id) AS n FROM ledger),
    s AS (SELECT organization_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS transaction_id, CAST(0 AS BIGINT) AS balance, false AS low_sent, false AS zero_sent, CAST(NULL AS VARCHAR) AS alert FROM (SELECT DISTINCT organization_id FROM o)
      UNION ALL SELECT organization_id, n, transaction_id, b, CASE WHEN credit THEN false ELSE low_sent OR coalesce(a = 'low', false) END, CASE WHEN credit THEN false ELSE zero_sent OR coalesce(a = 'zero', false) END, a
      FROM (SELECT *, CASE WHEN rejected THEN 'rejected' WHEN credit THEN NULL WHEN b <= 0 AND NOT zero_sent THEN 'zero' WHEN b > 0 AND b <= 500000 AND NOT low_sent THEN 'low' END AS a
        FROM (SELECT o.organization_id, o.n, o.transaction_id, s.low_sent, s.zero_sent, o.kind = 'usage_deduction' AND s.balance + o.amount_cents < 0 AS rejected, CASE WHEN o.kind = 'usage_deduction' AND s.balance + o.amount_cents < 0 THEN s.balance ELSE s.balance + o.amount_cents END AS b,
          NOT (o.kind = 'usage_deduction' AND s.balance + o.amount_cents < 0) AND o.amount_cents > 0 AS credit FROM s JOIN o ON o.organization_id = s.organization_id AND o.n = s.n + 1)))
    SELECT organization_id, transaction_id, alert, balance FROM s WHERE alert IS NOT NULL""")
def _(v):
    return appended(v, stateful.balance_alerts(stream_view(v, "ledger", "orders"), low_cents=500000), "balance")


@query("str10_sla_monitor")
def _(v):
    name = f"stream_lineitem_{uuid.uuid4().hex}"
    st.stream_table(v.spark, "lineitem", v.sf_dir).createOrReplaceTempView(name)
    rows = v.spark.sql(domain.SPARK_VIEWS["findings"].replace("{lineitem}", name)).filter(C("sla_status") == "on_track")
    ms = lambda c: F.unix_millis(C(c).cast("timestamp"))
    changes = rows.select("finding_id", F.lit("clock").alias("kind"), C("detected_at").alias("event_time"), ms("sla_warning_at").alias("warn_ms"), ms("sla_deadline_at").alias("due_ms"), F.lit(0).cast("long").alias("shift_ms"))
    return appended(v, stateful.sla_monitor(changes), "sla-monitor")


#: Three rounds of finished runs: all projects, then all again (the runs of some found nothing), then a few.
FINISHED = [
    "SELECT project_id, '2000' AS extraction_run_id, TIMESTAMP '2000-12-31 00:00:00' AS finished_at FROM projects",
    "SELECT project_id, CASE WHEN project_id % 5 = 3 THEN 'empty' ELSE '2001' END AS extraction_run_id, TIMESTAMP '2001-12-31 00:00:00' AS finished_at FROM projects",
    "SELECT project_id, '1999' AS extraction_run_id, TIMESTAMP '2002-01-01 00:00:00' AS finished_at FROM projects WHERE project_id % 10 = 3",
]


@query("str12_finding_lifecycle", f"""
    WITH k AS (SELECT DISTINCT project_id, extraction_run_id, dependency_id, osv_id FROM findings),
    run AS (SELECT 0 AS batch, * FROM ({FINISHED[0]}) UNION ALL SELECT 1, * FROM ({FINISHED[1]}) UNION ALL SELECT 2, * FROM ({FINISHED[2]})),
    held AS (SELECT batch, project_id, dependency_id, osv_id FROM run JOIN k USING (project_id, extraction_run_id)),
    old AS (SELECT n.batch, o.project_id, o.dependency_id, o.osv_id FROM run n JOIN held o ON o.project_id = n.project_id AND o.batch = n.batch - 1)
    SELECT CAST(batch AS BIGINT) AS batch, project_id, dependency_id, osv_id, 'detected' AS event_type FROM (SELECT * FROM held EXCEPT SELECT * FROM old)
    UNION ALL SELECT batch, project_id, dependency_id, osv_id, 'resolved' FROM (SELECT * FROM old EXCEPT SELECT * FROM held)""")
def _(v):
    folder, key = new_folder(v.spark, "lifecycle"), ["project_id", "dependency_id", "osv_id"]
    v.projects.createOrReplaceTempView(name := f"projects_{uuid.uuid4().hex}")
    for text in FINISHED:
        v.spark.sql(text.replace("projects", name)).write.mode("append").parquet(f"{folder}/input")
        stream = v.spark.readStream.schema("project_id bigint, extraction_run_id string, finished_at timestamp").parquet(f"{folder}/input")
        st.finding_lifecycle(v.spark, stream, lambda: v.findings, folder, key)
    v.spark.catalog.dropTempView(name)
    return v.spark.read.parquet(f"{folder}/events").withColumn("batch", C("batch").cast("long"))


@query("str13_session_activity", f"""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(min(ts), {TS}) AS session_start, count(*) AS events FROM i GROUP BY user_id, k""")
def _(v):
    def build(rows: DataFrame) -> DataFrame:
        return st.session_activity(rows, user="user_id", time="ts")

    source = st.stream_table(v.spark, "events", v.sf_dir)
    out = st.run_to_end(build, source, new_folder(v.spark, "sessions"), time="ts", end="2999-01-01 00:00:00")
    return out.filter(C("user_id").isNotNull()).select("user_id", stamp("session_start"), "events")


@query("str14_late_events", """
    WITH m AS (SELECT max(ts) - INTERVAL 3 DAY AS behind FROM events), e AS (SELECT *, ts < TIMESTAMP '2024-01-16' AND ts <= behind AS late FROM events, m)
    SELECT event_type, count(DISTINCT event_id) FILTER (WHERE NOT late) AS kept, CAST((SELECT count(*) FROM e WHERE late) AS BIGINT) AS dropped_in_total FROM e GROUP BY 1 HAVING count(*) FILTER (WHERE NOT late) > 0""")
def _(v):
    folder = new_folder(v.spark, "late")
    middle = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    # early rows that come after the others: those behind the watermark are dropped and counted
    parts = [v.events.filter(C("ts") >= middle), v.events.filter(C("ts") < middle)]
    dropped, counter = 0, st.LateRows()
    v.spark.streams.addListener(counter)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/input")
        rows = v.spark.readStream.schema(v.events.schema).parquet(f"{folder}/input")
        stream = st.watermarked(rows, "ts", "3 days").dropDuplicatesWithinWatermark(["event_id"])
        dropped += counter.of(st.run_append(stream, folder))
    v.spark.streams.removeListener(counter)
    kept = st.read_append(v.spark, folder, stream.schema)
    return kept.groupBy("event_type").agg(F.count("*").alias("kept")).withColumn("dropped_in_total", F.lit(dropped))


@query("str15_summary_refresh", """
    SELECT p.project_id, count(*) FILTER (WHERE NOT suppressed) AS vuln_total FROM projects p JOIN findings f ON f.project_id = p.project_id AND f.extraction_run_id = p.active_extraction_run_id WHERE p.project_id IN (SELECT project_id FROM dast_findings) GROUP BY 1
    UNION ALL SELECT p.project_id, 0 FROM projects p WHERE active_extraction_run_id IS NULL AND p.project_id IN (SELECT project_id FROM dast_findings)""")
def _(v):
    def compute(touched: DataFrame) -> DataFrame:
        mine = lambda df: df.join(touched, "project_id", "left_semi")
        return summaries.project_stats(mine(v.findings), mine(v.project_dependencies), mine(v.projects))

    folder = new_folder(v.spark, "summary")
    st.summary_refresh(stream_view(v, "dast_findings", "events"), folder, compute)
    return st.latest_updates(v.spark, folder, ["project_id"]).select("project_id", "vuln_total")


@query("str15_stale_pass", """
    SELECT p.project_id, coalesce(vuln_total, 0) AS vuln_total, coalesce(vuln_high, 0) AS vuln_high, coalesce(score_total, 0) AS score_total, worst_depscore
    FROM projects p LEFT JOIN (SELECT f.project_id, count(*) FILTER (WHERE NOT suppressed) AS vuln_total, count(*) FILTER (WHERE NOT suppressed AND severity = 'high') AS vuln_high, CAST(coalesce(sum(depscore) FILTER (WHERE NOT suppressed), 0) AS BIGINT) AS score_total,
      max(depscore) FILTER (WHERE NOT suppressed) AS worst_depscore FROM findings f JOIN projects q ON q.project_id = f.project_id AND q.active_extraction_run_id = f.extraction_run_id GROUP BY 1) USING (project_id)""")
def _(v):
    now = active_run(v.findings, v.projects)
    before = now.withColumns({"suppressed": F.lit(False), "severity": F.when(C("severity") == "low", "high").otherwise(C("severity"))})
    first = events_now() - F.make_dt_interval(F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    # a third of the projects have no summary yet, the others one of the rows before triage; some of those are old
    known = v.projects.filter(C("project_id") % 3 != 0).select("project_id")
    age = F.when(C("project_id") % 7 == 0, first - F.make_dt_interval(F.lit(9), F.lit(0), F.lit(0), F.lit(0))).otherwise(first)
    stored = incremental.summarize(before, known, first).withColumn("computed_at", age)
    changed = written(incremental.changes(before, now, ["finding_id", "project_id"], ["suppressed", "severity", "depscore"]))
    merged = incremental.apply_changes(stored, changed.join(known, "project_id", "left_semi"), events_now())
    out = incremental.stale_pass(merged, now, v.projects, cut=first - F.make_dt_interval(F.lit(2), F.lit(0), F.lit(0), F.lit(0)), at=events_now())
    return out.select("project_id", "vuln_total", "vuln_high", "score_total", "worst_depscore")
