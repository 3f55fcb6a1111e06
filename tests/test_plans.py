"""Physical plans: what must reach the scan, and what must never appear."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from larkspur.operators import matching
from larkspur.plans.registry import QUERIES, Views
from larkspur.sources import readers

# streams, files and range tables run Spark's own sources; vector search multiplies blocks in Arrow tasks
LAZY = [n for n in sorted(QUERIES) if not n.startswith(("str", "src", "snk", "udf5", "top10_vector_topk_batch"))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_and_no_python(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name != "udf1_package_policy_python":
        assert "PythonUDF" not in text and "MapInPandas" not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    rows = readers.read_table(spark, "orders", sf_dir).filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey")
    text = plan(rows)
    assert "GreaterThanOrEqual(o_orderdate" in text and "o_totalprice" not in text


def test_top_k_is_limited_before_the_shuffle(spark, sf_dir):
    text = plan(entry.queries()["top2_cap_per_project"](spark, sf_dir))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", ["jn2_prefer_prod_scope", "jn18_latest_snapshot", "agg22_dedup_last", "flt14_drop_single_node_flows"])
def test_first_rows_need_no_sorted_aggregate(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "SortAggregate" not in text and "WindowGroupLimit" in text


def test_summaries_reduce_before_they_shuffle(spark, sf_dir):
    text = plan(entry.queries()["agg4_project_stats"](spark, sf_dir))
    assert "partial_count" in text or "partial_sum" in text


def test_views_read_only_needed_columns(spark, sf_dir):
    text = plan(Views(spark, sf_dir).findings.select("finding_id", "severity"))
    assert "l_discount" not in text and "l_returnflag" not in text


def test_references_are_reduced_without_sorting(spark):
    hits = spark.createDataFrame([(1, 1, "a/b", "npm", "1.0.0")], "hit_id long, project_id long, ref_name string, ecosystem string, version string")
    deps = spark.createDataFrame([(1, "1:1", "b", "1.0.0", None, "npm")], "project_id long, project_dependency_id string, name string, version string, environment string, ecosystem string")
    out = matching.attach_advisories(hits, deps)
    assert "SortAggregate" not in plan(out) and [(r.hit_id, r.rung, r.project_dependency_id) for r in out.collect()] == [(1, 3, "1:1")]


def test_batch_search_limits_before_the_shuffle(spark, sf_dir):
    text = plan(entry.queries()["top10_vector_topk_batch"](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "WindowGroupLimit" in text


def test_versions_and_advisories_are_not_broadcast(spark, sf_dir):
    from larkspur.plans.matching_queries import advisories

    v = Views(spark, sf_dir)
    assert "BroadcastExchange" not in plan(matching.affected_versions(v.dependency_versions, advisories(v)))


def test_closure_inputs_are_not_broadcast(spark, monkeypatch):
    from larkspur.operators import graph

    seen = []
    monkeypatch.setattr(graph, "closure", lambda edges, seeds, **_: seen.append(edges) or seeds)
    pairs = spark.range(10, 30, 10).select((F.col("id") % 10 + 1).alias("project_id"), F.col("id").alias("version_id"))
    graph.transitive_of_reachable(pairs, spark.range(10, 20, 10).select(F.col("id").alias("parent_version_id"), (F.col("id") + 10).alias("child_version_id")), pairs)
    assert "BroadcastExchange" not in plan(seen[0]) and [tuple(r) for r in seen[0].collect()] == [(1, 10, 20)]
