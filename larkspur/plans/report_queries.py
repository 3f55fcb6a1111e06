"""Registered queries for billing, activity, learning and ranked reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import labels
from larkspur.operators import learning, matching, ranking, usage, vectors
from larkspur.operators.filters import active_run
from larkspur.plans.common import events_now, instant, ledger_now, stamp
from larkspur.plans.domain import EVENTS_NOW, FINDINGS_NOW, LEDGER_NOW
from larkspur.plans.matching_queries import COUNTS, advisories
from larkspur.plans.registry import query
from larkspur.plans.summary_queries import act
from larkspur.session import written

C = F.col
TS = "'%Y-%m-%d %H:%M:%S'"
BREAKDOWN = "b AS (SELECT organization_id, CAST(date_trunc('{g}', created_at) AS DATE) AS bucket, feature, event_type, CAST(sum(abs(amount_cents)) AS BIGINT) AS cents, CAST(sum(coalesce(quantity, 0)) AS BIGINT) AS quantity FROM ledger WHERE kind = 'usage_deduction' GROUP BY 1, 2, 3, 4)"


@query("agg14_usage_breakdown", f"WITH {BREAKDOWN.format(g='day')} SELECT organization_id, CAST(bucket AS VARCHAR) AS bucket, feature, event_type, cents, quantity FROM b")
def _(v):
    return usage.usage_breakdown(v.ledger).withColumn("bucket", C("bucket").cast("string"))


@query("agg14_usage_breakdown_weekly", f"WITH {BREAKDOWN.format(g='week')} SELECT organization_id, CAST(bucket AS VARCHAR) AS bucket, feature, event_type, cents, quantity FROM b")
def _(v):
    return usage.usage_breakdown(v.ledger, granularity="week").withColumn("bucket", C("bucket").cast("string"))


SERIES = f"""{BREAKDOWN.format(g='month')}, n AS (SELECT organization_id, coalesce(feature, 'other') AS feature, bucket, sum(cents) AS cents FROM b GROUP BY 1, 2, 3),
    spine AS (SELECT organization_id, feature, CAST(d AS DATE) AS bucket FROM (SELECT DISTINCT organization_id, feature FROM n) CROSS JOIN (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-02', INTERVAL 1 MONTH)) AS d)),
    series AS (SELECT organization_id, feature, bucket, CAST(coalesce(cents, 0) AS BIGINT) AS cents FROM spine LEFT JOIN n USING (organization_id, feature, bucket))"""


def _series(v):
    return usage.usage_series(usage.usage_breakdown(v.ledger, granularity="month"), start="1995-01-01", end="2001-08-02", granularity="month")


@query("agg15_usage_series", f"WITH {SERIES} SELECT organization_id, feature, CAST(bucket AS VARCHAR) AS bucket, cents FROM series")
def _(v):
    return _series(v).withColumn("bucket", C("bucket").cast("string"))


@query("agg15_product_rows", f"WITH {BREAKDOWN.format(g='month')} SELECT organization_id, coalesce(feature, 'other') AS feature, CAST(sum(cents) AS BIGINT) AS total_cents, CAST(sum(quantity) AS BIGINT) AS total_quantity FROM b GROUP BY 1, 2")
def _(v):
    return usage.product_rows(usage.usage_breakdown(v.ledger, granularity="month"))


@query("win4_running_usage", f"WITH {SERIES} SELECT organization_id, feature, CAST(bucket AS VARCHAR) AS bucket, cents, CAST(sum(cents) OVER (PARTITION BY organization_id, feature ORDER BY bucket) AS BIGINT) AS running_cents FROM series")
def _(v):
    return usage.running_usage(_series(v)).withColumn("bucket", C("bucket").cast("string"))


@query("win5_rolling_sum_30d", """
    WITH d AS (SELECT organization_id, CAST(created_at AS DATE) AS day, sum(amount_cents) AS s FROM ledger WHERE kind = 'topup' GROUP BY 1, 2)
    SELECT organization_id, CAST(day AS VARCHAR) AS day, CAST(s AS BIGINT) AS day_sum, CAST(sum(s) OVER (PARTITION BY organization_id ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_sum FROM d""")
def _(v):
    return usage.rolling_sum_days(v.ledger.filter(C("kind") == "topup"), ["organization_id"], "created_at", "amount_cents").withColumn("day", C("day").cast("string"))


@query("agg16_ledger_drift", "SELECT b.organization_id, CAST(balance_cents AS BIGINT) AS balance_cents, CAST(s AS BIGINT) AS ledger_sum, CAST(balance_cents - s AS BIGINT) AS drift_cents FROM billing_balances b JOIN (SELECT organization_id, sum(amount_cents) AS s FROM ledger GROUP BY 1) l USING (organization_id) WHERE balance_cents <> s")
def _(v):
    return usage.ledger_drift(v.billing_balances, v.ledger)


FINANCE = f"""g AS (SELECT organization_id, sum(CASE WHEN kind = 'topup' THEN amount_cents ELSE 0 END) - sum(CASE WHEN kind = 'refund' THEN abs(amount_cents) ELSE 0 END) AS dep, sum(CASE WHEN kind = 'topup' AND created_at >= TIMESTAMP '{LEDGER_NOW}' - INTERVAL 30 DAY THEN amount_cents ELSE 0 END) AS dep30,
    sum(CASE WHEN kind = 'grant' THEN amount_cents ELSE 0 END) AS granted, sum(CASE WHEN kind = 'usage_deduction' THEN -amount_cents ELSE 0 END) AS charged, sum(CASE WHEN kind = 'usage_deduction' THEN cost_cents ELSE 0 END) AS cogs FROM ledger GROUP BY 1),
    fin AS (SELECT organization_id, dep AS deposits_cents, dep30 AS deposits_30d, charged - cogs AS gross_margin_cents, CASE WHEN charged > 0 THEN cogs * (least(granted, charged) / CAST(charged AS DOUBLE)) ELSE 0 END AS free_credit_burned, greatest(0, least(balance_cents, granted - charged)) AS free_credit_outstanding,
      balance_cents - greatest(0, least(balance_cents, granted - charged)) AS real_balance_held FROM g FULL JOIN billing_balances b USING (organization_id))"""


@query("agg17_billing_financials", f"WITH {FINANCE} SELECT organization_id, CAST(deposits_cents AS BIGINT) AS deposits_cents, CAST(deposits_30d AS BIGINT) AS deposits_30d, CAST(gross_margin_cents AS BIGINT) AS gross_margin_cents, CAST(round(free_credit_burned, 0) AS BIGINT) AS free_credit_burned, CAST(free_credit_outstanding AS BIGINT) AS free_credit_outstanding, CAST(real_balance_held AS BIGINT) AS real_balance_held FROM fin")
def _(v):
    out = usage.billing_financials(v.ledger, v.billing_balances, now=ledger_now())
    return out.withColumn("free_credit_burned", F.round("free_credit_burned", 0).cast("long"))


@query("agg17_financial_totals", f"WITH {FINANCE} SELECT {', '.join(f'CAST(round(sum({c}), 0) AS BIGINT) AS {c}' for c in ['deposits_cents', 'deposits_30d', 'gross_margin_cents', 'free_credit_burned', 'free_credit_outstanding', 'real_balance_held'])} FROM fin")
def _(v):
    return usage.financial_totals(usage.billing_financials(v.ledger, v.billing_balances, now=ledger_now()))


@query("agg17_daily_revenue", """
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, CAST(coalesce(s, 0) AS BIGINT) AS cents FROM (SELECT unnest(generate_series(DATE '2000-08-03', DATE '2001-08-02', INTERVAL 1 DAY)) AS d) LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, sum(amount_cents) AS s FROM ledger WHERE kind = 'topup' GROUP BY 1) ON day = CAST(d AS DATE)""")
def _(v):
    return usage.daily_revenue(v.ledger, start="2000-08-03", end="2001-08-02").withColumn("day", C("day").cast("string"))


@query("agg18_cumulative_growth", """
    WITH e AS (SELECT 'orgs' AS kind, organization_id AS id, created_at AS t FROM organizations UNION ALL SELECT 'projects', project_id, created_at FROM projects UNION ALL SELECT 'users', user_id, min(created_at) FROM org_members GROUP BY 1, 2),
    days AS (SELECT CAST(unnest(generate_series(DATE '2000-01-01', DATE '2000-12-31', INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT k.kind, CAST(day AS VARCHAR) AS day, (SELECT count(*) FROM e WHERE e.kind = k.kind AND CAST(t AS DATE) <= day) AS total FROM days CROSS JOIN (SELECT DISTINCT kind FROM e) k""")
def _(v):
    entities = {"orgs": (v.organizations, "organization_id", "created_at"), "projects": (v.projects, "project_id", "created_at"), "users": (v.org_members, "user_id", "created_at")}
    return usage.cumulative_growth(entities, start="2000-01-01", end="2000-12-31").withColumn("day", C("day").cast("string"))


@query("agg19_daily_counts", """
    SELECT CAST(d.day AS VARCHAR) AS day, coalesce(errors, 0) AS errors, coalesce(warns, 0) AS warns FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) d
    LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type <> 'error') AS warns FROM events GROUP BY 1) x ON x.day = d.day""")
def _(v):
    return usage.daily_counts(v.events, time="ts", error=C("event_type") == "error", start="2023-12-25", end="2024-01-31").withColumn("day", C("day").cast("string"))


@query("agg19_daily_tokens", """
    WITH s AS (SELECT organization_id, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT organization_id FROM ai_usage)),
    u AS (SELECT organization_id, CAST(created_at AS DATE) AS day, sum(input_tokens + output_tokens) AS tokens, sum(floor(estimated_cost * 100 + 0.5)) AS cost FROM ai_usage WHERE success GROUP BY 1, 2)
    SELECT organization_id, CAST(day AS VARCHAR) AS day, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, CAST(coalesce(cost, 0) AS BIGINT) AS cost_cents FROM s LEFT JOIN u USING (organization_id, day)""")
def _(v):
    return usage.daily_tokens(v.ai_usage, start="2024-01-01", end="2024-01-31").withColumn("day", C("day").cast("string"))


@query("agg34_tool_breakdown", """
    SELECT organization_id, coalesce(tool_name, 'unknown') AS tool_name, count(*) AS executions, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, CAST(sum(floor(estimated_cost * 100 + 0.5)) AS BIGINT) AS total_cost_cents FROM ai_usage GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY organization_id ORDER BY count(*) DESC, coalesce(tool_name, 'unknown')) <= 2""")
def _(v):
    return usage.tool_breakdown(v.ai_usage, k=2)


@query("agg31_monthly_spend", """
    SELECT organization_id, round(sum(estimated_cost), 4) AS spend FROM ai_usage WHERE success AND feature IN ('spec_inference', 'fp_filter', 'model_fallback') AND created_at >= TIMESTAMP '2024-01-01' GROUP BY 1""")
def _(v):
    return usage.monthly_spend(v.ai_usage, now=events_now(), features=["spec_inference", "fp_filter", "model_fallback"])


@query("agg35_delivery_stats", f"""
    SELECT *, CASE WHEN total_24h > 0 THEN CAST(floor(delivered_24h * 100.0 / total_24h + 0.5) AS BIGINT) ELSE 100 END AS success_rate_24h FROM (SELECT organization_id, count(*) FILTER (WHERE date_diff('second', created_at, TIMESTAMP '{EVENTS_NOW}') <= 86400) AS total_24h,
      count(*) FILTER (WHERE date_diff('second', created_at, TIMESTAMP '{EVENTS_NOW}') <= 86400 AND status = 'dispatched') AS delivered_24h, count(*) FILTER (WHERE date_diff('second', created_at, TIMESTAMP '{EVENTS_NOW}') <= 604800) AS total_7d FROM notification_events GROUP BY 1)""")
def _(v):
    return usage.delivery_stats(v.notification_events, now=events_now())


@query("agg35_webhook_stats", f"""
    SELECT organization_id, count(*) AS total, count(*) FILTER (WHERE processing_status = 'processed') AS processed, count(*) FILTER (WHERE processing_status = 'error') AS errors, count(*) FILTER (WHERE processing_status = 'skipped') AS skipped FROM webhook_deliveries
    WHERE date_diff('second', created_at, TIMESTAMP '{EVENTS_NOW}') <= 604800 AND event_type NOT IN ('check_suite', 'check_run') GROUP BY 1""")
def _(v):
    return usage.webhook_stats(v.webhook_deliveries, now=events_now(), hours=168)


DIGEST = f"c AS (SELECT * FROM notification_events WHERE created_at >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAY AND created_at <= TIMESTAMP '{EVENTS_NOW}' QUALIFY row_number() OVER (PARTITION BY organization_id ORDER BY created_at DESC, event_id DESC) <= 500)"


@query("agg37_digest", f"""
    WITH {DIGEST} SELECT organization_id, 'type' AS section, event_type AS item, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT organization_id, 'project', coalesce(CAST(project_id AS VARCHAR), 'org-wide'), count(*) FROM c GROUP BY ALL
    UNION ALL SELECT organization_id, 'top', CAST(event_id AS VARCHAR), 1 FROM (SELECT * FROM c WHERE priority IN ('critical', 'high') QUALIFY row_number() OVER (PARTITION BY organization_id ORDER BY created_at DESC, event_id DESC) <= 3)""")
def _(v):
    return usage.digest(v.notification_events, now=events_now())


@query("agg38_batch_groups", "SELECT organization_id, project_id, event_type, count(*) AS total, arg_min(event_id, (created_at, event_id)) AS representative_id FROM notification_events GROUP BY 1, 2, 3")
def _(v):
    return usage.batch_groups(v.notification_events)


@query("win3_debt_velocity", f"""
    WITH r AS (SELECT *, lag(score) OVER w AS p, date_diff('day', lag(snapshot_date) OVER w, snapshot_date) AS d FROM debt_snapshots WHERE snapshot_date >= CAST(TIMESTAMP '{LEDGER_NOW}' - INTERVAL 30 DAY AS DATE) WINDOW w AS (PARTITION BY organization_id ORDER BY snapshot_date)),
    a AS (SELECT organization_id, coalesce(round(avg((score - p) / d), 6), 0e0) AS v, arg_max(score, snapshot_date) AS latest FROM r GROUP BY 1)
    SELECT organization_id, v AS average_daily_change, CASE WHEN v < 0 AND latest > 0 THEN CAST(ceil(abs(latest / v)) AS BIGINT) END AS projected_days_to_zero, CASE WHEN v < -0.5 THEN 'improving' WHEN v > 0.5 THEN 'worsening' ELSE 'stable' END AS trend FROM a""")
def _(v):
    return usage.debt_velocity(v.debt_snapshots, now=ledger_now())


@query("str11_balance_crossings", """
    WITH r AS (SELECT *, sum(amount_cents) OVER (PARTITION BY organization_id ORDER BY created_at, transaction_id) AS balance FROM ledger), b AS (SELECT *, balance - amount_cents AS prev FROM r)
    SELECT organization_id, transaction_id, CAST(balance AS BIGINT) AS balance, CASE WHEN balance <= 0 AND prev > 0 THEN 'zero' ELSE 'low' END AS alert FROM b WHERE (balance <= 0 AND prev > 0) OR (balance <= 500000 AND prev > 500000)""")
def _(v):
    return usage.balance_crossings(v.ledger, low_cents=500000)


@query("str9_stale_source", f"""
    WITH l AS (SELECT source, arg_max(state, (started_at, run_id)) AS state, arg_max(updated_at, (started_at, run_id)) AS u, max(run_id) FILTER (WHERE completed_at IS NULL) AS x, arg_max(coalesce(completed_at, TIMESTAMP '1900-01-01'), (started_at, run_id)) AS c FROM feed_runs GROUP BY 1)
    SELECT s.source, CASE WHEN l.source IS NULL THEN 'no_runs_recorded' WHEN state = 'running' THEN CASE WHEN date_diff('second', u, TIMESTAMP '{EVENTS_NOW}') > 300 THEN 'heartbeat_stale' END WHEN state IN ('failed', 'dlq') THEN 'last_run_' || state
      WHEN state = 'completed' THEN CASE WHEN c = TIMESTAMP '1900-01-01' THEN 'completed_at_missing' WHEN date_diff('second', c, TIMESTAMP '{EVENTS_NOW}') > 129600 THEN 'last_completion_stale' END END AS reason FROM (VALUES ('osv'), ('ghsa'), ('kev'), ('epss'), ('nvd')) s(source) LEFT JOIN l ON l.source = s.source""")
def _(v):
    return usage.feed_staleness(v.feed_runs, ["osv", "ghsa", "kev", "epss", "nvd"], now=events_now())


MEASURES = """count(*) AS total_attempts, count(*) FILTER (WHERE success) AS successes, round(count(*) FILTER (WHERE success) / count(*), 4) AS success_rate, CAST(floor(avg(duration_seconds) + 0.5) AS BIGINT) AS avg_duration_seconds, round(avg(cost_cents), 4) AS avg_cost_cents, round(avg(human_quality_rating), 4) AS avg_quality_rating,
    round(count(*) FILTER (WHERE pr_merged) / nullif(count(*) FILTER (WHERE success), 0), 4) AS pr_merge_rate, round(count(*) FILTER (WHERE fix_reverted) / nullif(count(*) FILTER (WHERE pr_merged), 0), 4) AS revert_rate, CASE WHEN count(*) >= 20 THEN 'high' WHEN count(*) >= 5 THEN 'medium' ELSE 'low' END AS confidence"""
PATTERNS = f"""pat AS (SELECT organization_id, ecosystem, vulnerability_type, strategy, is_direct_dep, CAST(1 AS BIGINT) AS level, {MEASURES} FROM fix_outcomes WHERE ecosystem IS NOT NULL GROUP BY 1, 2, 3, 4, 5
    UNION ALL SELECT organization_id, ecosystem, NULL, strategy, NULL, CAST(2 AS BIGINT), {MEASURES} FROM fix_outcomes WHERE ecosystem IS NOT NULL GROUP BY organization_id, ecosystem, strategy
    UNION ALL SELECT organization_id, NULL, NULL, strategy, NULL, CAST(3 AS BIGINT), {MEASURES} FROM fix_outcomes GROUP BY organization_id, strategy)"""


@query("agg21_strategy_patterns", f"WITH {PATTERNS} SELECT * FROM pat")
def _(v):
    return learning.strategy_patterns(v.fix_outcomes)


@query("agg21_failure_reasons", """
    SELECT organization_id, ecosystem, vulnerability_type, strategy, is_direct_dep, string_agg(failure_reason || '=' || CAST(n AS VARCHAR), ',' ORDER BY failure_reason) AS reasons FROM (SELECT organization_id, ecosystem, vulnerability_type, strategy, is_direct_dep, failure_reason, count(*) AS n FROM fix_outcomes WHERE ecosystem IS NOT NULL AND failure_reason IS NOT NULL GROUP BY ALL) GROUP BY 1, 2, 3, 4, 5""")
def _(v):
    shown = F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return learning.failure_reasons(v.fix_outcomes).withColumn("reasons", shown)


@query("jn27_retry_chains", """
    WITH r AS (SELECT f.organization_id, f.ecosystem, f.vulnerability_type, f.strategy, f.is_direct_dep, t.strategy AS nxt, round(count(*) FILTER (WHERE t.success) / count(*), 4) AS rate, count(*) AS n FROM fix_outcomes f JOIN fix_outcomes t ON t.previous_attempt_id = f.outcome_id WHERE NOT f.success GROUP BY 1, 2, 3, 4, 5, 6)
    SELECT organization_id, ecosystem, vulnerability_type, strategy, is_direct_dep, nxt AS best_followup_strategy, rate AS followup_success_rate, n AS samples FROM r QUALIFY row_number() OVER (PARTITION BY organization_id, ecosystem, vulnerability_type, strategy, is_direct_dep ORDER BY rate DESC, n DESC, nxt) = 1""")
def _(v):
    return learning.retry_chains(v.fix_outcomes)


@query("jn28_best_pattern", f"""
    WITH {PATTERNS}, q AS (SELECT DISTINCT organization_id, coalesce(ecosystem, 'swift') AS ecosystem, vulnerability_type, strategy, coalesce(is_direct_dep, true) AS is_direct_dep FROM fix_outcomes)
    SELECT q.*, CAST(CASE WHEN a.level IS NOT NULL THEN 1 WHEN b.level IS NOT NULL THEN 2 WHEN c.level IS NOT NULL THEN 3 ELSE 4 END AS BIGINT) AS step, coalesce(a.total_attempts, b.total_attempts, c.total_attempts, d.total_attempts) AS total_attempts FROM q
    LEFT JOIN pat a ON a.level = 1 AND a.organization_id = q.organization_id AND a.ecosystem = q.ecosystem AND a.vulnerability_type = q.vulnerability_type AND a.strategy = q.strategy AND a.is_direct_dep = q.is_direct_dep
    LEFT JOIN pat b ON b.level = 1 AND b.organization_id = q.organization_id AND b.ecosystem = q.ecosystem AND b.vulnerability_type = q.vulnerability_type AND b.strategy = q.strategy AND b.is_direct_dep IS NULL
    LEFT JOIN pat c ON c.level = 2 AND c.organization_id = q.organization_id AND c.ecosystem = q.ecosystem AND c.strategy = q.strategy LEFT JOIN pat d ON d.level = 3 AND d.organization_id = q.organization_id AND d.strategy = q.strategy""")
def _(v):
    asked = v.fix_outcomes.select("organization_id", F.coalesce("ecosystem", F.lit("swift")).alias("ecosystem"), "vulnerability_type", "strategy", F.coalesce("is_direct_dep", F.lit(True)).alias("is_direct_dep")).distinct()
    out = learning.best_pattern(asked, learning.strategy_patterns(v.fix_outcomes))
    return out.select(*asked.columns, C("step").cast("long").alias("step"), "total_attempts")


@query("top8_rank_strategies", f"""
    WITH {PATTERNS}, s AS (SELECT *, round(greatest(0e0, success_rate - coalesce(revert_rate, 0) * 0.5e0) * CASE confidence WHEN 'high' THEN 1e0 WHEN 'medium' THEN 0.8e0 ELSE 0.5e0 END, 6) AS score FROM pat WHERE level = 2)
    SELECT organization_id, ecosystem, strategy, score, row_number() OVER (PARTITION BY organization_id, ecosystem ORDER BY floor(score / 0.05e0 + 1e-9) DESC, avg_cost_cents, strategy) AS rank FROM s""")
def _(v):
    patterns = learning.strategy_patterns(v.fix_outcomes).filter(C("level") == 2)
    return learning.rank_strategies(patterns, ["organization_id", "ecosystem"]).select("organization_id", "ecosystem", "strategy", "score", "rank")


@query("agg43_learning_curve", "SELECT organization_id, strftime(created_at, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (WHERE success) AS successes, round(count(*) FILTER (WHERE success) / count(*), 4) AS success_rate FROM fix_outcomes GROUP BY 1, 2")
def _(v):
    return learning.learning_curve(v.fix_outcomes)


@query("agg43_failure_analysis", """
    SELECT f.organization_id, failure_reason, count(*) AS n, round(count(*) / any_value(t), 4) AS share FROM fix_outcomes f JOIN (SELECT organization_id, count(*) AS t FROM fix_outcomes WHERE NOT success GROUP BY 1) USING (organization_id) WHERE NOT success AND failure_reason IS NOT NULL GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY f.organization_id ORDER BY count(*) DESC, failure_reason) <= 8""")
def _(v):
    return learning.failure_analysis(v.fix_outcomes)


@query("agg43_rating_histogram", f"SELECT organization_id, strategy, round(avg(human_quality_rating), 4) AS avg_rating, count(*) AS ratings, {', '.join(f'count(*) FILTER (WHERE human_quality_rating = {i}) AS rated_{i}' for i in range(1, 6))} FROM fix_outcomes WHERE human_quality_rating IS NOT NULL GROUP BY 1, 2")
def _(v):
    return learning.rating_histogram(v.fix_outcomes)


ORDER = "coalesce(contextual_depscore, depscore, -1) DESC, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, published_at DESC NULLS LAST, finding_id"


@query("top1_rank_findings", f"SELECT project_id, finding_id, row_number() OVER (PARTITION BY project_id ORDER BY {ORDER}) AS rank FROM {act('findings')}")
def _(v):
    return ranking.rank_findings(active_run(v.findings, v.projects), ["project_id"]).select("project_id", "finding_id", "rank")


@query("top2_cap_per_project", f"SELECT project_id, finding_id FROM findings QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY {ORDER}) <= 100")
def _(v):
    return ranking.cap_per_project(v.findings, 100).select("project_id", "finding_id")


def every_family(v):
    return ranking.all_findings(
        vulnerability=v.findings, container=v.container_findings, iac=v.iac_findings, semgrep=v.semgrep_findings, secret=v.secret_findings,
        malicious=v.malicious_findings, dast=v.dast_findings)


ALL = " UNION ALL ".join(
    f"SELECT '{name}' AS family, CAST(finding_id AS VARCHAR) AS finding_id, project_id, {run} AS extraction_run_id, {sev} AS severity, status, {dep} AS depscore FROM {table}"
    for name, table, run, sev, dep in [
        ("vulnerability", "findings", "extraction_run_id", "severity", "depscore"), ("container", "container_findings", "extraction_run_id", "lower(severity)", "depscore"),
        ("iac", "iac_findings", "extraction_run_id", "lower(severity)", "depscore"), ("semgrep", "semgrep_findings", "extraction_run_id", "lower(severity)", "depscore"),
        ("secret", "secret_findings", "extraction_run_id", "NULL", "depscore"), ("malicious", "malicious_findings", "extraction_run_id", "severity", "depscore"), ("dast", "dast_findings", "NULL", "severity", "NULL")])


@query("set1_all_findings", f"SELECT family, severity, status, count(*) AS n, CAST(sum(depscore) AS BIGINT) AS total_score, count(DISTINCT project_id) AS projects FROM ({ALL}) GROUP BY 1, 2, 3")
def _(v):
    return every_family(v).groupBy("family", "severity", "status").agg(F.count("*").alias("n"), F.sum("depscore").alias("total_score"), F.countDistinct("project_id").alias("projects"))


@query("top3_org_top", f"SELECT organization_id, family, finding_id FROM ({ALL}) a JOIN projects p USING (project_id) QUALIFY row_number() OVER (PARTITION BY organization_id ORDER BY depscore DESC NULLS LAST, family, finding_id) <= 50")
def _(v):
    return ranking.org_top(every_family(v), v.projects).select("organization_id", "family", "finding_id")


@query("top4_page", "SELECT project_id, finding_id, (SELECT count(*) FROM secret_findings t WHERE t.project_id = s.project_id) AS total FROM secret_findings s QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY is_verified DESC, finding_id DESC) BETWEEN 3 AND 4")
def _(v):
    return ranking.page(v.secret_findings, ["project_id"], [C("is_verified").desc(), C("finding_id").desc()], number=2, size=2).select("project_id", "finding_id", "total")


@query("top5_keyset_page", f"SELECT transaction_id, strftime(created_at, {TS}) AS created_at FROM ledger WHERE (created_at, transaction_id) < (TIMESTAMP '1999-06-01', 7000) ORDER BY ledger.created_at DESC, transaction_id DESC LIMIT 51")
def _(v):
    return ranking.keyset_page(v.ledger, time="created_at", key="transaction_id", cursor=("1999-06-01 00:00:00", 7000), limit=50).select("transaction_id", stamp("created_at"))


@query("top6_recent_activity", """
    SELECT project_id, source, item_id FROM (SELECT project_id, 'job' AS source, CAST(job_id AS VARCHAR) AS item_id, created_at AS t FROM scan_jobs UNION ALL SELECT project_id, 'pull', CAST(pr_id AS VARCHAR), merged_at FROM pull_requests WHERE merged_at IS NOT NULL UNION ALL SELECT project_id, 'finding', finding_id, detected_at FROM findings)
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY t DESC, source, item_id) <= 20""")
def _(v):
    job = v.scan_jobs.select("project_id", C("job_id").cast("string").alias("item_id"), C("created_at").alias("happened_at"))
    pull = v.pull_requests.filter(C("merged_at").isNotNull()).select("project_id", C("pr_id").cast("string").alias("item_id"), C("merged_at").alias("happened_at"))
    finding = v.findings.select("project_id", C("finding_id").alias("item_id"), C("detected_at").alias("happened_at"))
    return ranking.recent_activity(job=job, pull=pull, finding=finding).select("project_id", "source", "item_id")


@query("top7_rank_base_images", """
    WITH c AS (SELECT project_id, image_reference AS base_image, count(*) AS finding_count, project_id % 3 = 0 AS shell_required FROM container_findings GROUP BY 1, 2),
    s AS (SELECT c.*, image, round(greatest(0e0, least(1e0, (finding_count - cve_count) / CAST(finding_count AS DOUBLE))) * 0.5e0 + drop_in_score / 100e0 * 0.3e0 + CASE provider WHEN 'chainguard' THEN 1e0 WHEN 'distroless' THEN 0.7e0 ELSE 0.5e0 END * 0.2e0, 6) AS score FROM c JOIN image_catalog i USING (base_image) WHERE NOT shell_required OR has_shell)
    SELECT project_id, base_image, image, score, row_number() OVER (PARTITION BY project_id, base_image ORDER BY score DESC, image) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY project_id, base_image ORDER BY score DESC, image) <= 3""")
def _(v):
    current = v.container_findings.groupBy("project_id", "image_reference").agg(F.count("*").alias("finding_count")).withColumn("shell_required", C("project_id") % 3 == 0)
    return ranking.rank_base_images(current, v.image_catalog).select("project_id", "base_image", "image", "score", "rank")


@query("top9_truncate_by_bytes", """
    WITH s AS (SELECT finding_id, project_id, extraction_run_id, sha256(finding_id) AS o, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS r, length('{"id":"' || finding_id || '","cve":"' || cve_id || '"}') + 1 AS b FROM container_findings)
    SELECT finding_id FROM s QUALIFY sum(b) OVER (PARTITION BY project_id, extraction_run_id ORDER BY r DESC, o) <= 1999""")
def _(v):
    json = F.to_json(F.struct(C("finding_id").alias("id"), C("cve_id").alias("cve")))
    return ranking.truncate_by_bytes(v.container_findings, ["project_id", "extraction_run_id"], max_bytes=2000, json=json).select("finding_id")


@query("top10_vector_topk", f"""
    WITH q AS (SELECT list_transform(range(1, 65), lambda i: CASE WHEN i % 3 = 0 THEN 1.0 ELSE -0.5 END) AS e), s AS (SELECT memory_id, list_sum(list_transform(list_zip(embedding, e), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS sim
      FROM memories CROSS JOIN q WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{EVENTS_NOW}')
    SELECT memory_id, round(sim, 6) AS similarity FROM s WHERE sim > 0.05 ORDER BY sim DESC, memory_id LIMIT 15""")
def _(v):
    vector = F.array(*[F.lit(1.0 if i % 3 == 0 else -0.5) for i in range(1, 65)])
    out = ranking.vector_topk(v.memories, vector, organization_id=None, now=events_now(), threshold=0.05, k=15)
    return out.select("memory_id", F.round("similarity", 6).alias("similarity"))


def _batch_sql(scoped: bool) -> str:
    """Every query against every memory."""
    dot = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
    return f"""
    WITH q AS (SELECT vec_id AS query_id, CAST(label % 5 AS BIGINT) AS organization_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, memory_id, round({dot.format(a='embedding', b='e')} / (sqrt({dot.format(a='embedding', b='embedding')}) * sqrt({dot.format(a='e', b='e')})), 9) AS sim
      FROM memories m JOIN q ON {'q.organization_id = m.organization_id' if scoped else 'true'} WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{EVENTS_NOW}')
    SELECT query_id, memory_id, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, memory_id) AS rank
    FROM s WHERE sim > 0.05 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, memory_id) <= 10"""


def _batch(v, scope):
    asked = v.embeddings.filter(C("vec_id") % 100 == 0).select(C("vec_id").alias("query_id"), (C("label") % 5).cast("long").alias("organization_id"), "embedding")
    out = vectors.vector_topk_batch(v.memories, asked, now=events_now(), threshold=0.05, k=10, dimensions=64, scope=scope)
    return out.select("query_id", "memory_id", F.round("similarity", 6).alias("similarity"), C("rank").cast("long").alias("rank"))


@query("top10_vector_topk_batch", _batch_sql(False))
def _(v):
    return _batch(v, None)


@query("top10_vector_topk_batch_scoped", _batch_sql(True))
def _(v):
    return _batch(v, "organization_id")


@query("top11_fix_priority", f"""
    WITH w AS (SELECT * FROM {act('findings')} WHERE NOT suppressed AND NOT risk_accepted QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY depscore DESC NULLS LAST, finding_id) <= 20)
    SELECT project_id, finding_id, row_number() OVER (PARTITION BY project_id ORDER BY CASE sla_status WHEN 'breached' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, depscore DESC NULLS LAST, finding_id) AS rank FROM w
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY CASE sla_status WHEN 'breached' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, depscore DESC NULLS LAST, finding_id) <= 10""")
def _(v):
    return ranking.fix_priority(active_run(v.findings, v.projects)).select("project_id", "finding_id", "rank")


@query("top12_version_list", f"""
    WITH {COUNTS}, m AS (SELECT DISTINCT project_id, dependency_id, version AS current_version FROM project_dependencies),
    l AS (SELECT m.*, c.version_id, c.version, c.critical_vulns, c.version_id % 10 AS i, c.version = 'latest' AS odd FROM m JOIN counts c USING (dependency_id) WHERE (c.version <> 'latest' AND c.version NOT LIKE '%-beta%') OR c.version = m.current_version)
    SELECT project_id, dependency_id, version, critical_vulns, EXISTS (SELECT 1 FROM projects p JOIN banned_versions b ON b.organization_id = p.organization_id WHERE p.project_id = l.project_id AND b.dependency_id = l.dependency_id AND b.banned_version = l.version)
       OR EXISTS (SELECT 1 FROM project_teams t JOIN banned_versions b ON b.team_id = t.team_id WHERE t.project_id = l.project_id AND b.dependency_id = l.dependency_id AND b.banned_version = l.version) AS is_banned, count(*) OVER (PARTITION BY project_id, dependency_id) AS total FROM l
    QUALIFY row_number() OVER (PARTITION BY project_id, dependency_id ORDER BY odd, i DESC) <= 2""")
def _(v):
    uses = written(v.project_dependencies.select("project_id", "dependency_id", "version"))
    banned = matching.banned_versions(uses, v.banned_versions, v.projects, v.project_teams)
    counts = matching.vuln_counts_by_version(v.dependency_versions, advisories(v))
    return ranking.version_list(uses, counts, banned, number=1, size=2).select("project_id", "dependency_id", "version", "critical_vulns", "is_banned", "total")


@query("win6_versions_behind", """
    WITH k AS (SELECT dependency_id, version_id % 10 AS i FROM dependency_versions WHERE version <> 'latest' AND version NOT LIKE '%-beta%'), u AS (SELECT d.project_dependency_id, d.dependency_id, (d.project_id + d.dependency_id) % 5 AS i FROM project_dependencies d JOIN dependencies x USING (dependency_id) WHERE removed_at IS NULL AND d.version <> 'latest' AND x.latest_version IS NOT NULL)
    SELECT project_dependency_id, i < 3 AS is_outdated, CASE WHEN i < 3 THEN (SELECT count(*) FROM k WHERE k.dependency_id = u.dependency_id AND k.i > u.i AND k.i <= 3) ELSE 0 END AS versions_behind FROM u""")
def _(v):
    return ranking.versions_behind(v.project_dependencies, v.dependencies, v.dependency_versions).select("project_dependency_id", "is_outdated", "versions_behind")


@query("win8_flow_rank", "SELECT project_id, dependency_id, flow_id FROM flows QUALIFY row_number() OVER (PARTITION BY project_id, dependency_id ORDER BY flow_length NULLS LAST, flow_id) <= 2")
def _(v):
    return ranking.flow_rank(v.flows, ["project_id", "dependency_id"], 2).select("project_id", "dependency_id", "flow_id")


@query("win2_distinct_on", "SELECT project_id, osv_id, finding_id FROM findings QUALIFY row_number() OVER (PARTITION BY project_id, osv_id ORDER BY detected_at, finding_id) = 1")
def _(v):
    return ranking.distinct_on(v.findings, ["project_id", "osv_id"], [C("detected_at").asc(), C("finding_id").asc()]).select("project_id", "osv_id", "finding_id")


@query("set3_kev_union", """
    SELECT project_id, 'kev' AS kind, count(*) AS n FROM container_findings WHERE is_kev GROUP BY 1 UNION ALL SELECT project_id, 'image', count(DISTINCT image_reference) FROM container_findings WHERE NOT is_kev GROUP BY 1""")
def _(v):
    c = v.container_findings
    kev = c.filter("is_kev").select("project_id", F.lit("kev").alias("kind"))
    image = c.filter("NOT is_kev").select("project_id", "image_reference").distinct().select("project_id", F.lit("image").alias("kind"))
    return kev.unionAll(image).groupBy("project_id", "kind").agg(F.count("*").alias("n"))
