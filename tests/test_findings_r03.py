"""Findings of round 3: work that a query does not ask for is not done, and rows that cannot count leave early."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import matching, runs

PROJECTS = "project_id long, organization_id long, active_extraction_run_id string, previous_extraction_run_id string"


def test_families_do_not_read_the_findings(spark):
    projects = spark.createDataFrame([(1, 7, "b", "a")], PROJECTS)
    columns = [*runs.WORKED, *runs.STATE]
    broken = spark.range(3).select(*[F.raise_error(F.lit(f"{c} of findings was read")).cast("string").alias(c) for c in columns])
    rows = spark.createDataFrame(
        [(1, 1, "a", "f", "ignored"), (2, 1, "b", "f", "open"), (3, 1, "b", "g", "open")], "finding_id long, project_id long, extraction_run_id string, fingerprint string, status string")
    nothing = projects.limit(0)
    commit = runs.finalize_runs(broken, nothing, nothing, projects, nothing, nothing, now=F.current_timestamp(), families={"container": rows})
    got = commit.families["container"].select("finding_id", "status").collect()
    assert sorted(map(tuple, got)) == [(2, "ignored"), (3, "open")]


def test_few_package_rows_are_dealt_over_all_tasks(spark, sf_dir):
    import __spark_entry__ as entry

    for name in ("scl3_registry_keys", "scl7_purl"):
        assert entry.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_bans_count_for_the_organization_or_team_that_set_them(spark):
    uses = spark.createDataFrame([(1, 5, "1.0"), (1, 5, "1.0"), (2, 5, "1.0"), (3, 5, "1.0"), (3, 6, "2.0"), (1, 6, "9.9"), (4, 5, None)], "project_id long, dependency_id long, version string")
    bans = spark.createDataFrame([(10, None, 5, "1.0"), (None, 7, 6, "2.0"), (None, 7, 6, "2.0"), (10, None, 6, "2.0")], "organization_id long, team_id long, dependency_id long, banned_version string")
    projects = spark.createDataFrame([(1, 10), (2, 11), (3, 11), (4, 10)], "project_id long, organization_id long")
    teams = spark.createDataFrame([(3, 7), (3, 8), (2, 7)], "project_id long, team_id long")
    found = matching.banned_in_use(uses, bans, projects, teams)
    assert sorted(map(tuple, found.collect())) == [(1, 5, "1.0"), (3, 6, "2.0")]
    assert "parquet" in plan_of(found)  # only versions that somebody bans go on, written once


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
