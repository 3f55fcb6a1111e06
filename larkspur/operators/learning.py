"""Fix-strategy statistics and recommendations (AGG21, AGG43, JN27, JN28, TOP8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scores import lookup

C = F.col
# Confidence weights of the ranking.
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.8, "low": 0.5}


def strategy_patterns(outcomes: DataFrame) -> DataFrame:
    """The same measures at three levels: (ecosystem, type, strategy, direct), (ecosystem, strategy), (strategy).

    ``level`` tells rows apart whose key values are null by grouping or by data.  The two finer levels leave out
    outcomes without ecosystem.
    """
    org, eco, kind, strategy, direct = (C(c) for c in ("organization_id", "ecosystem", "vulnerability_type", "strategy", "is_direct_dep"))
    sets = [[org, eco, kind, strategy, direct], [org, eco, strategy], [org, strategy]]
    wins, merged = F.count_if("success"), F.count_if("pr_merged")
    level = F.when(F.grouping("ecosystem") == 1, 3).when(F.grouping("vulnerability_type") == 1, 2).otherwise(1)
    out = outcomes.groupingSets(sets, org, eco, kind, strategy, direct).agg(
        level.cast("long").alias("level"), F.count("*").alias("total_attempts"), wins.alias("successes"),
        F.round(wins / F.count("*"), 4).alias("success_rate"), F.floor(F.avg("duration_seconds") + 0.5).cast("long").alias("avg_duration_seconds"),
        F.round(F.avg("cost_cents"), 4).alias("avg_cost_cents"), F.round(F.avg("human_quality_rating"), 4).alias("avg_quality_rating"),
        F.round(F.try_divide(merged, wins), 4).alias("pr_merge_rate"), F.round(F.try_divide(F.count_if("fix_reverted"), merged), 4).alias("revert_rate"),
    )
    n = C("total_attempts")
    return (
        out.filter((C("level") == 3) | C("ecosystem").isNotNull())
        .withColumn("confidence", F.when(n >= 20, "high").when(n >= 5, "medium").otherwise("low"))
    )


def failure_reasons(outcomes: DataFrame) -> DataFrame:
    """Failure reasons per finest-level group as a map of counts (a short fixed vocabulary)."""
    key = ["organization_id", "ecosystem", "vulnerability_type", "strategy", "is_direct_dep"]
    counts = outcomes.filter(C("ecosystem").isNotNull() & C("failure_reason").isNotNull()).groupBy(*key, "failure_reason").agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("failure_reason", "n")))).alias("reasons"))


def retry_chains(outcomes: DataFrame) -> DataFrame:
    """Best follow-up after a failed strategy: highest success rate, then most samples, then name."""
    key = ["organization_id", "ecosystem", "vulnerability_type", "strategy", "is_direct_dep"]
    failed = outcomes.filter(~C("success")).select(C("outcome_id").alias("previous_attempt_id"), *key)
    retry = outcomes.filter(C("previous_attempt_id").isNotNull()).select("previous_attempt_id", C("strategy").alias("next_strategy"), C("success").alias("won"))
    rates = failed.join(retry, "previous_attempt_id").groupBy(*key, "next_strategy").agg(
        F.round(F.count_if("won") / F.count("*"), 4).alias("rate"), F.count("*").alias("n"))
    best = rates.groupBy(*key).agg(F.min(F.struct((-C("rate")).alias("r"), (-C("n")).alias("k"), C("next_strategy").alias("s"))).alias("b"))
    return best.select(*key, C("b.s").alias("best_followup_strategy"), (-C("b.r") + 0.0).alias("followup_success_rate"), (-C("b.k")).alias("samples"))


def best_pattern(requests: DataFrame, patterns: DataFrame) -> DataFrame:
    """Most specific statistics row for each (organization, ecosystem, type, direct, strategy) request.

    Steps: exact; same without the direct flag; ecosystem and strategy; strategy alone.  The typed steps need a type.
    """
    measures = ["total_attempts", "success_rate", "revert_rate", "avg_cost_cents", "avg_duration_seconds", "confidence"]
    value = F.struct("level", *measures)
    fine = patterns.filter(C("level") == 1)

    def side(rows: DataFrame, key: list[str], name: str) -> DataFrame:
        return rows.select(*key, value.alias(name))

    typed = fine.filter(C("vulnerability_type").isNotNull())
    base = ["organization_id", "ecosystem", "strategy"]
    out = (
        requests.join(side(typed.filter(C("is_direct_dep").isNotNull()), [*base, "vulnerability_type", "is_direct_dep"], "_1"), [*base, "vulnerability_type", "is_direct_dep"], "left")
        .join(side(typed.filter(C("is_direct_dep").isNull()), [*base, "vulnerability_type"], "_2"), [*base, "vulnerability_type"], "left")
        .join(side(patterns.filter(C("level") == 2), base, "_3"), base, "left")
        .join(side(patterns.filter(C("level") == 3), ["organization_id", "strategy"], "_4"), ["organization_id", "strategy"], "left")
    )
    step = F.when(C("_1").isNotNull(), 1).when(C("_2").isNotNull(), 2).when(C("_3").isNotNull(), 3).when(C("_4").isNotNull(), 4)
    return out.withColumn("_b", F.coalesce("_1", "_2", "_3", "_4")).withColumn("step", step).select(*requests.columns, "step", "_b.*")


def rank_strategies(patterns: DataFrame, key: list[str]) -> DataFrame:
    """Rank by (success less half the revert rate) times confidence; scores are bucketed by 0.05, then cheaper first."""
    from pyspark.sql import Window

    rate = F.greatest(F.lit(0.0), F.coalesce("success_rate", F.lit(0.0)) - F.coalesce("revert_rate", F.lit(0.0)) * 0.5)
    score = F.round(rate * lookup(CONFIDENCE_WEIGHT, C("confidence")), 6)
    w = Window.partitionBy(*key).orderBy(C("bucket").desc(), C("avg_cost_cents").asc(), C("strategy").asc())
    out = patterns.withColumn("score", score).withColumn("bucket", F.floor(C("score") / 0.05 + 1e-9))
    return out.withColumn("rank", F.row_number().over(w).cast("long"))


def learning_curve(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("organization_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("total"), F.count_if("success").alias("successes"), F.round(F.count_if("success") / F.count("*"), 4).alias("success_rate"))


def failure_analysis(outcomes: DataFrame, k: int = 8) -> DataFrame:
    """Most frequent failure reasons per organization with their share of all failures."""
    from larkspur.operators.filters import row_number_at_most

    failed = outcomes.filter(~C("success"))
    total = failed.groupBy("organization_id").agg(F.count("*").alias("_t"))
    counts = failed.filter(C("failure_reason").isNotNull()).groupBy("organization_id", "failure_reason").agg(F.count("*").alias("n"))
    top = row_number_at_most(counts, ["organization_id"], [C("n").desc(), C("failure_reason").asc()], k)
    return top.join(total, "organization_id").withColumn("share", F.round(C("n") / C("_t"), 4)).drop("_t")


def rating_histogram(outcomes: DataFrame) -> DataFrame:
    rated = outcomes.filter(C("human_quality_rating").isNotNull())
    r: Column = C("human_quality_rating")
    return rated.groupBy("organization_id", "strategy").agg(
        F.round(F.avg(r), 4).alias("avg_rating"), F.count("*").alias("ratings"), *[F.count_if(r == i).alias(f"rated_{i}") for i in range(1, 6)])
