"""Billing, usage and activity reports (AGG14-AGG19, AGG31, AGG34, AGG35, AGG37, AGG38, WIN3-WIN5, TOP5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.ranking import running_total

C = F.col


def usage_breakdown(ledger: DataFrame, *, granularity: str = "day", start: Column | None = None, end: Column | None = None,
                    features: list[str] | None = None) -> DataFrame:
    """Charged cents and quantity per organization, time bucket, feature and event type."""
    unit = granularity.lower() if granularity.lower() in ("day", "week", "month") else "day"
    rows = ledger.filter(C("kind") == "usage_deduction")
    if start is not None:
        rows = rows.filter(C("created_at") >= start)
    if end is not None:
        rows = rows.filter(C("created_at") <= end)
    if features:
        rows = rows.filter(C("feature").isin(features))
    bucket = F.date_trunc(unit, C("created_at")).cast("date").alias("bucket")
    return rows.groupBy("organization_id", bucket, "feature", "event_type").agg(
        F.sum(F.abs("amount_cents")).alias("cents"), F.sum(F.coalesce("quantity", F.lit(0))).alias("quantity"))


def bucket_spine(keys: DataFrame, *, start: str, end: str, granularity: str) -> DataFrame:
    """Every bucket of the range for every key row."""
    unit = {"day": "1 day", "week": "1 week", "month": "1 month"}[granularity]
    first = F.date_trunc(granularity, F.lit(start).cast("timestamp_ntz")).cast("date")
    series = F.sequence(first, F.lit(end).cast("date"), F.expr(f"INTERVAL {unit}"))
    return keys.withColumn("bucket", F.explode(series))


def usage_series(breakdown: DataFrame, *, start: str, end: str, granularity: str) -> DataFrame:
    """Gap-filled cents per (organization, feature, bucket); missing features are ``other``."""
    named = breakdown.withColumn("feature", F.coalesce("feature", F.lit("other")))
    summed = named.groupBy("organization_id", "feature", "bucket").agg(F.sum("cents").alias("cents"))
    keys = named.select("organization_id", "feature").distinct()
    spine = bucket_spine(keys, start=start, end=end, granularity=granularity)
    return spine.join(summed, ["organization_id", "feature", "bucket"], "left").fillna(0, ["cents"])


def product_rows(breakdown: DataFrame) -> DataFrame:
    """Totals per organization and feature."""
    named = breakdown.withColumn("feature", F.coalesce("feature", F.lit("other")))
    return named.groupBy("organization_id", "feature").agg(F.sum("cents").alias("total_cents"), F.sum("quantity").alias("total_quantity"))


def running_usage(series: DataFrame) -> DataFrame:
    """Cumulative cents per feature over the buckets; buckets are already one row per key, so windows stay small."""
    w = Window.partitionBy("organization_id", "feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("running_cents", F.sum("cents").over(w))


def rolling_sum_days(rows: DataFrame, key: list[str], time: str, value: str, *, days: int = 30) -> DataFrame:
    """Per key and day: the sum of the trailing ``days`` days, the day itself included.

    Rows are first added up per day, so the window holds one row per day however busy a key is.
    """
    daily = rows.groupBy(*key, C(time).cast("date").alias("day")).agg(F.sum(value).alias("day_sum"))
    w = Window.partitionBy(*key).orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-days, 0)
    return daily.withColumn("rolling_sum", F.sum("day_sum").over(w))


def ledger_drift(balances: DataFrame, ledger: DataFrame) -> DataFrame:
    """Organizations whose stored balance differs from the sum of their ledger."""
    sums = ledger.groupBy("organization_id").agg(F.sum("amount_cents").alias("ledger_sum"))
    out = balances.join(sums, "organization_id", "left").fillna(0, ["ledger_sum"])
    return out.filter(C("balance_cents") != C("ledger_sum")).withColumn("drift_cents", C("balance_cents") - C("ledger_sum"))


def billing_financials(ledger: DataFrame, balances: DataFrame, *, now: Column) -> DataFrame:
    """Per organization: net deposits, margin, free credit burned (free first, prorated), outstanding and real balance."""
    kind, cents = C("kind"), C("amount_cents")
    recent = F.timestamp_diff("SECOND", C("created_at"), now) <= 30 * 86400
    sums = ledger.groupBy("organization_id").agg(
        F.sum(F.when(kind == "topup", cents).otherwise(0)).alias("gross"), F.sum(F.when(kind == "refund", F.abs(cents)).otherwise(0)).alias("refunds"),
        F.sum(F.when((kind == "topup") & recent, cents).otherwise(0)).alias("deposits_30d"), F.sum(F.when(kind == "grant", cents).otherwise(0)).alias("granted"),
        F.sum(F.when(kind == "usage_deduction", -cents).otherwise(0)).alias("charged"), F.sum(F.when(kind == "usage_deduction", C("cost_cents")).otherwise(0)).alias("cogs"),
    )
    rows = sums.join(balances, "organization_id", "full").fillna(0)
    free_used = F.least("granted", "charged")
    left = F.greatest(F.lit(0), F.least(C("balance_cents"), C("granted") - C("charged")))
    return rows.select(
        "organization_id", (C("gross") - C("refunds")).alias("deposits_cents"), "deposits_30d", (C("charged") - C("cogs")).alias("gross_margin_cents"),
        F.when(C("charged") > 0, C("cogs") * (free_used / C("charged"))).otherwise(0.0).alias("free_credit_burned"),
        left.alias("free_credit_outstanding"), (C("balance_cents") - left).alias("real_balance_held"),
    )


def financial_totals(per_org: DataFrame) -> DataFrame:
    names = [c for c in per_org.columns if c != "organization_id"]
    return per_org.agg(*[F.round(F.sum(c), 0).cast("long").alias(c) for c in names])


def daily_revenue(ledger: DataFrame, *, start: str, end: str) -> DataFrame:
    """Top-ups per day, zero-filled."""
    spine = bucket_spine(ledger.sparkSession.range(1).select(F.lit(1).alias("_k")), start=start, end=end, granularity="day").select(C("bucket").alias("day"))
    sums = ledger.filter(C("kind") == "topup").groupBy(C("created_at").cast("date").alias("day")).agg(F.sum("amount_cents").alias("cents"))
    return spine.join(sums, "day", "left").fillna(0, ["cents"])


def cumulative_growth(entities: dict[str, tuple[DataFrame, str, str]], *, start: str, end: str) -> DataFrame:
    """Entities that exist on or before each day; an entity counts from its first row.

    ``entities`` maps a kind to (rows, id column, time column).  Rows are reduced to one first day per entity, then
    to one count per day, before the running sum over days.
    """
    counts = None
    for kind, (rows, key, time) in entities.items():
        first = rows.groupBy(key).agg(F.min(time).cast("date").alias("day"))
        daily = first.withColumn("day", F.greatest("day", F.lit(start).cast("date"))).groupBy("day").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        counts = daily if counts is None else counts.unionByName(daily)
    kinds = counts.select("kind").distinct()
    spine = bucket_spine(kinds, start=start, end=end, granularity="day").withColumnRenamed("bucket", "day")
    w = Window.partitionBy("kind").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(counts, ["kind", "day"], "left").fillna(0, ["n"]).withColumn("total", F.sum("n").over(w)).drop("n")


def daily_counts(rows: DataFrame, *, time: str, error: Column, start: str, end: str) -> DataFrame:
    """Errors and warnings per day, zero-filled; everything that is not an error is a warning."""
    spine = bucket_spine(rows.sparkSession.range(1).select(F.lit(1).alias("_k")), start=start, end=end, granularity="day").select(C("bucket").alias("day"))
    agg = rows.groupBy(C(time).cast("date").alias("day")).agg(F.count_if(error).alias("errors"), F.count_if(~error).alias("warns"))
    return spine.join(agg, "day", "left").fillna(0, ["errors", "warns"])


def cents(column: str) -> Column:
    """Cost in cents, rounded per row before any sum."""
    return F.floor(F.coalesce(C(column), F.lit(0.0)) * 100 + 0.5).cast("long")


def daily_tokens(usage: DataFrame, *, start: str, end: str) -> DataFrame:
    """Successful tokens and cents per organization and day, zero-filled."""
    good = usage.filter(C("success"))
    agg = good.groupBy("organization_id", C("created_at").cast("date").alias("day")).agg(
        F.sum(C("input_tokens") + C("output_tokens")).alias("tokens"), F.sum(cents("estimated_cost")).alias("cost_cents"))
    spine = bucket_spine(usage.select("organization_id").distinct(), start=start, end=end, granularity="day").withColumnRenamed("bucket", "day")
    return spine.join(agg, ["organization_id", "day"], "left").fillna(0, ["tokens", "cost_cents"])


def tool_breakdown(usage: DataFrame, k: int = 10) -> DataFrame:
    """Executions, tokens and cents per tool, most used ``k`` per organization."""
    from larkspur.operators.filters import row_number_at_most

    out = usage.groupBy("organization_id", F.coalesce("tool_name", F.lit("unknown")).alias("tool_name")).agg(
        F.count("*").alias("executions"), F.sum(C("input_tokens") + C("output_tokens")).alias("total_tokens"), F.sum(cents("estimated_cost")).alias("total_cost_cents"))
    return row_number_at_most(out, ["organization_id"], [C("executions").desc(), C("tool_name").asc()], k)


def monthly_spend(usage: DataFrame, *, now: Column, features: list[str]) -> DataFrame:
    """Cost of the current calendar month per organization, for the given features."""
    rows = usage.filter(C("success") & C("feature").isin(features) & (C("created_at") >= F.date_trunc("month", now)))
    return rows.groupBy("organization_id").agg(F.round(F.sum("estimated_cost"), 4).alias("spend"))


def _age(then: Column, now: Column) -> Column:
    """Seconds between two instants, each cut to its whole second, as SQL's ``date_diff`` counts them."""
    return F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(then.cast("timestamp"))


def delivery_stats(deliveries: DataFrame, *, now: Column) -> DataFrame:
    """Delivery success of the last day and totals of the last week per organization."""
    age = _age(C("created_at"), now)
    day, week = age <= 86400, age <= 7 * 86400
    out = deliveries.groupBy("organization_id").agg(
        F.count_if(day).alias("total_24h"), F.count_if(day & (C("status") == "dispatched")).alias("delivered_24h"), F.count_if(week).alias("total_7d"))
    rate = F.when(C("total_24h") > 0, F.floor(C("delivered_24h") * 100 / C("total_24h") + 0.5)).otherwise(100).cast("long")
    return out.withColumn("success_rate_24h", rate)


def webhook_stats(webhooks: DataFrame, *, now: Column, hours: int) -> DataFrame:
    """Processed, failed and skipped deliveries inside the timeframe; check events do not count."""
    rows = webhooks.filter((_age(C("created_at"), now) <= hours * 3600) & ~C("event_type").isin("check_suite", "check_run"))
    state = C("processing_status")
    return rows.groupBy("organization_id").agg(
        F.count("*").alias("total"), F.count_if(state == "processed").alias("processed"), F.count_if(state == "error").alias("errors"), F.count_if(state == "skipped").alias("skipped"))


def digest_events(events: DataFrame, *, now: Column, days: int = 7, k: int = 500) -> DataFrame:
    """Newest ``k`` events of the last week per organization: the population of the digest."""
    from larkspur.operators.filters import row_number_at_most

    recent = events.filter((C("created_at") >= now - F.make_dt_interval(F.lit(days))) & (C("created_at") <= now))
    return row_number_at_most(recent, ["organization_id"], [C("created_at").desc(), C("event_id").desc()], k)


def digest(events: DataFrame, *, now: Column) -> DataFrame:
    """Digest in long form: counts by type, counts by project, and the three newest critical or high events."""
    from larkspur.operators.filters import row_number_at_most

    chosen = digest_events(events, now=now)
    by_type = chosen.groupBy("organization_id", C("event_type").alias("item")).agg(F.count("*").alias("n")).withColumn("section", F.lit("type"))
    project = F.coalesce(C("project_id").cast("string"), F.lit("org-wide"))
    by_project = chosen.groupBy("organization_id", project.alias("item")).agg(F.count("*").alias("n")).withColumn("section", F.lit("project"))
    loud = row_number_at_most(chosen.filter(C("priority").isin("critical", "high")), ["organization_id"], [C("created_at").desc(), C("event_id").desc()], 3)
    top = loud.select("organization_id", C("event_id").cast("string").alias("item"), F.lit(1).cast("long").alias("n"), F.lit("top").alias("section"))
    return by_type.unionByName(by_project).unionByName(top)


def batch_groups(events: DataFrame) -> DataFrame:
    """Events per (organization, project, type) with their number and first event as representative."""
    return events.groupBy("organization_id", "project_id", "event_type").agg(
        F.count("*").alias("total"), F.min_by("event_id", F.struct("created_at", "event_id")).alias("representative_id"))


def debt_velocity(snapshots: DataFrame, *, now: Column, days: int = 30) -> DataFrame:
    """Mean daily change of the debt score over the window, days to zero, and trend (half a point either way).

    Snapshots are one row per organization and day, so the window partitions are small.
    """
    recent = snapshots.filter(C("snapshot_date") >= (now - F.make_dt_interval(F.lit(days))).cast("date"))
    w = Window.partitionBy("organization_id").orderBy("snapshot_date")
    steps = recent.withColumn("_p", F.lag("score").over(w)).withColumn("_d", F.datediff("snapshot_date", F.lag("snapshot_date").over(w)))
    change = (C("score") - C("_p")) / C("_d")
    out = steps.groupBy("organization_id").agg(F.round(F.avg(change), 6).alias("v"), F.max_by("score", "snapshot_date").alias("latest"))
    v = F.coalesce(C("v"), F.lit(0.0))
    return out.select(
        "organization_id", v.alias("average_daily_change"),
        F.when((v < 0) & (C("latest") > 0), F.ceil(F.abs(C("latest") / v))).alias("projected_days_to_zero"),
        F.when(v < -0.5, "improving").when(v > 0.5, "worsening").otherwise("stable").alias("trend"),
    )


def balance_crossings(ledger: DataFrame, *, low_cents: int) -> DataFrame:
    """Transactions that take an organization's balance to the low mark or to zero, or below (batch form of the alerts).

    Balances are running sums inside a day on top of what lies before it, so no organization is one task.
    """
    order = [C("created_at"), C("transaction_id")]
    run = running_total(ledger.select("organization_id", "transaction_id", "created_at", "amount_cents"), ["organization_id"], {"_day": C("created_at").cast("date")}, order, C("amount_cents"), "balance")
    before = C("balance") - C("amount_cents")
    alert = F.when((C("balance") <= 0) & (before > 0), "zero").when((C("balance") <= low_cents) & (before > low_cents), "low")
    return run.withColumn("alert", alert).filter(C("alert").isNotNull()).select("organization_id", "transaction_id", "balance", "alert")


def feed_staleness(runs_df: DataFrame, sources: list[str], *, now: Column) -> DataFrame:
    """State of each feed source from its latest run; null when healthy.

    A running sync is stale after five minutes without a heartbeat, a finished one after 36 hours.
    """
    last = runs_df.groupBy("source").agg(F.max_by(F.struct("state", "updated_at", "completed_at"), F.struct("started_at", "run_id")).alias("r"))
    known = runs_df.sparkSession.createDataFrame([(s,) for s in sources], "source string").join(last, "source", "left")
    state = C("r.state")
    beat, done = F.timestamp_diff("SECOND", C("r.updated_at"), now), F.timestamp_diff("SECOND", C("r.completed_at"), now)
    reason = (
        F.when(C("r").isNull(), "no_runs_recorded")
        .when(state == "running", F.when(beat > 300, "heartbeat_stale"))
        .when(state.isin("failed", "dlq"), F.concat(F.lit("last_run_"), state))
        .when(state == "completed", F.when(C("r.completed_at").isNull(), "completed_at_missing").when(done > 36 * 3600, "last_completion_stale"))
    )
    return known.select("source", reason.alias("reason"))
