"""Operators on skewed inputs: same answers as plain Python, no hot task, no growth with the square of a group."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import evidence, graph, matching, ranking, vectors
from tests.test_plans import plan

C = F.col
ADVISORY = "advisory_id long, dependency_id long, osv_id string, severity string, ranges array<struct<introduced:string,fixed:string>>, ranges_missing boolean, versions array<string>"


def key(version):
    return tuple(map(int, version.split(".")))


@pytest.mark.parametrize("seed", [1, 2])
def test_version_candidates_against_sets(spark, seed):
    rng = random.Random(seed)
    rows = [(d * 100 + i, d, f"{i // 10}.{i % 10}.0") for d in range(3) for i in range(30)] + [(900, 0, "1.5.0-beta.1"), (901, 1, "latest"), (902, 2, "0.4.0")]
    facts = []
    for a in range(25):
        d, low = rng.randrange(3), rng.randrange(25)
        listed = [f"{i // 10}.{i % 10}.0" for i in rng.sample(range(30), 3)] if a % 3 == 0 else None
        facts.append((a, d, f"CVE-2024-{a}", "high", [(f"{low // 10}.{low % 10}.0", None if a % 5 == 0 else f"{(low + 6) // 10}.{(low + 6) % 10}.0")], a % 11 == 0, listed))
    versions, advisories = spark.createDataFrame(rows, "version_id long, dependency_id long, version string"), spark.createDataFrame(facts, ADVISORY)
    hits = {}
    for r in matching.affected_versions(versions, advisories).select("version_id", "advisory_id").collect():
        hits.setdefault(r.version_id, set()).add(r.advisory_id)
    stable = [r for r in rows if r[2].replace(".", "").isdigit()]
    use = [(p, d, f"{i // 10}.{i % 10}.0") for p in range(2) for d in range(3) for i in rng.sample(range(30), 4)] + [(0, 2, "0.4.0"), (1, 1, "latest")]
    want = set()
    for p, d, v in use:
        for cur in stable:
            if cur[1] == d and cur[2] == v:
                for cand in stable:
                    if cand[1] == d and key(cand[2]) > key(v):
                        a, b = hits.get(cur[0], set()), hits.get(cand[0], set())
                        want.add((p, d, v, cand[2], len(a - b), len(b - a), key(cand[2])[0] > key(v)[0], (p, d, cand[2]) == (0, 0, "2.9.0")))
    current, banned = spark.createDataFrame(use, "project_id long, dependency_id long, version string"), spark.createDataFrame([(0, 0, "2.9.0")], "project_id long, dependency_id long, version string")
    got = matching.version_candidates(current, versions, advisories, banned)
    assert "Join [advisory_id" not in plan(got)
    assert {tuple(r) for r in got.select("project_id", "dependency_id", "cur_version", "candidate", "cves_fixed", "cves_new", "is_major_bump", "is_banned").collect()} == want


def test_an_advisory_costs_its_runs_not_its_versions(spark):
    ordered = spark.range(10_000).select(F.lit(7).alias("dependency_id"), C("id").alias("version_id"), C("id").cast("int").alias("place"))
    hits = spark.range(10_000).filter("id <> 500").select(C("id").alias("version_id"), F.lit(1).alias("advisory_id"))
    assert [[(r.low, r.high) for r in row.runs] for row in matching.advisory_runs(ordered, hits).collect()] in ([[(0, 499), (501, 9999)]], [[(501, 9999), (0, 499)]])


def test_equal_scores_are_ranked_in_slices(spark):
    rows = spark.range(40_000).select(
        F.when(C("id") < 38_000, 1).otherwise(C("id") % 7).cast("long").alias("project_id"), F.format_string("f%06d", C("id")).alias("finding_id"), F.lit("high").alias("severity"),
        F.lit(None).cast("double").alias("contextual_depscore"), F.lit(50).cast("long").alias("depscore"), F.lit("2024-01-01").cast("timestamp_ntz").alias("published_at")).repartition(4)
    got = ranking.rank_findings(rows, ["project_id"], slices=16)
    assert got.columns == [*rows.columns, "rank"]
    sizes = [len(p) for p in rows.repartitionByRange(16, "project_id", *ranking.ranking_order()).select("project_id").rdd.glom().collect()]
    assert max(sizes) <= 2 * sum(sizes) / 16
    found = {}
    for r in got.select("project_id", "finding_id", "rank").collect():
        found.setdefault(r.project_id, []).append((r["rank"], r.finding_id))
    for own in found.values():
        own.sort()
        assert [r for r, _ in own] == list(range(1, len(own) + 1)) and [i for _, i in own] == sorted(i for _, i in own)


def test_safe_version_goals_take_the_lowest_version_above(spark):
    counts = spark.createDataFrame([(i, 1, f"1.{i}.0", int(i == 4), 0, 0, 0) for i in range(8)], "version_id long, dependency_id long, version string, critical_vulns long, high_vulns long, medium_vulns long, low_vulns long")
    uses = spark.createDataFrame([(1, "1:1", 1, "1.0.0"), (2, "2:1", 1, "1.2.0"), (3, "3:1", 1, "1.7.0")], "project_id long, project_dependency_id string, dependency_id long, version string")
    fixes = spark.createDataFrame([("1:1", ["1.2.5"]), ("1:1", ["1.1.0", "1.5.0"]), ("2:1", ["1.3.5"]), ("3:1", ["9.0.0"])], "project_dependency_id string, fixed_versions array<string>")
    edges = spark.createDataFrame([(7, 4)], "parent_version_id long, child_version_id long")
    banned = spark.createDataFrame([(3, 1, "1.6.0")], "project_id long, dependency_id long, version string")
    got = {r.project_id: (r.safe_version, r.covers_fixes) for r in graph.latest_safe_version(uses, counts, edges, banned, fixes).collect()}
    assert got == {1: ("1.3.0", True), 2: ("1.6.0", False), 3: ("1.5.0", False)}  # 1.4.0 is over, 1.7.0 has a bad child, 1.6.0 is banned


@pytest.mark.parametrize(("scope", "block"), [(None, 4096), ("organization_id", 4096), (None, 7)])
def test_batch_vectors_against_all_pairs(spark, monkeypatch, scope, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 600)] + 0.05 * rng.normal(size=(600, 16))
    x[50], x[51] = x[40], x[40]
    rows = [(i, [float(v) for v in x[i]], i % 3, None) for i in range(600)] + [(900, None, 0, None), (901, [0.0] * 16, 0, None), (902, [1.0] * 15, 0, None), (903, [float("nan")] * 16, 0, None), (904, [float(v) for v in x[40]], None, None)]
    memories = spark.createDataFrame([(*r, "note") for r in rows], "memory_id long, embedding array<double>, organization_id long, expires_at timestamp_ntz, category string").repartition(3)
    asked = [(i, rows[i][1], rows[i][2]) for i in range(0, 600, 40)] + [(5000, [0.0] * 16, 0), (5001, [-v for v in rows[3][1]], 0)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>, organization_id long")
    got = vectors.vector_topk_batch(memories, queries, now=F.lit("2024-01-01").cast("timestamp_ntz"), threshold=0.2, k=5, dimensions=16, scope=scope)
    assert "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)
    usable = [r for r in rows if r[1] and len(r[1]) == 16 and np.isfinite(r[1]).all() and any(r[1])]
    want = set()
    for q, e, org in asked:
        if any(e):
            sims = [(-round(float(np.dot(e, r[1]) / np.linalg.norm(e) / np.linalg.norm(r[1])), 9), r[0]) for r in usable if not scope or r[2] == org and org is not None]
            want |= {(q, i, rank) for rank, (s, i) in enumerate(sorted(s for s in sims if -s[0] > 0.2)[:5], 1)}
    assert {(r.query_id, r.memory_id, r["rank"]) for r in got.collect()} == want


def test_far_lists_are_ruled_out(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    queries = spark.createDataFrame([(i, None, [float(v) for v in centres[i]], 0.99) for i in range(20)], "query_id long, scope string, embedding array<double>, floor double")
    near = vectors.probes(queries, centres, np.full(20, 50), np.full(20, 0.1), 5, True).collect()
    far = vectors.probes(queries, centres, np.full(20, 50), np.full(20, 0.1), 5, False).collect()
    assert sorted((r.query_id, r.list) for r in near) == [(i, i) for i in range(20)] and far == []
    assert len(vectors.probes(queries, centres, np.full(20, 50), np.full(20, 3.0), 5, False).collect()) == 20 * 19


def test_batch_vectors_without_rows(spark):
    memories = spark.createDataFrame([], "memory_id long, embedding array<double>, organization_id long, expires_at timestamp_ntz, category string")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert vectors.vector_topk_batch(memories, queries, now=F.current_timestamp(), threshold=0.0, k=3, dimensions=2).collect() == []


def test_ages_are_counted_in_whole_seconds(spark):
    from larkspur.operators import usage

    rows = spark.sql("SELECT 1L AS organization_id, 'dispatched' AS status, TIMESTAMP_NTZ '2024-01-29 23:59:59.4' AS created_at")
    got = usage.delivery_stats(rows, now=F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).first()
    assert (got.total_24h, got.delivered_24h, got.total_7d, got.success_rate_24h) == (0, 0, 1, 100)


def test_shared_teams_make_no_pairs_across_organizations(spark):
    from larkspur.operators import filters

    grants = spark.sql("SELECT id AS user_id, 'team' AS scope, 7L AS scope_id FROM range(200) UNION ALL SELECT 3L, 'project', 3L UNION ALL SELECT 5L, 'organization', 5L UNION ALL SELECT 6L, 'project', 8L")
    projects = spark.sql("SELECT id AS project_id, id % 100 AS organization_id FROM range(200)")
    teams = spark.sql("SELECT id AS project_id, 7L AS team_id FROM range(200)")
    members = spark.sql("SELECT id AS user_id, id % 100 AS organization_id FROM range(200)")
    out = filters.accessible_projects(grants, projects, teams, members)
    assert sorted(map(tuple, out.collect())) == [(u, p, u % 100) for u in range(200) for p in sorted({u % 100, u % 100 + 100})]


def test_team_grants_meet_projects_by_organization(spark, sf_dir):
    from larkspur.plans.registry import QUERIES

    joins = [line for line in plan(QUERIES["flt11_accessible_projects"](spark, sf_dir)).split("\n") if "Join" in line]
    assert not any("[scope_id#" in line and "[team_id#" in line and "organization_id" not in line for line in joins)
    assert any("team_id#" in line and line.count("organization_id") == 2 for line in joins)


def test_routes_meet_requests_by_literal_segments(spark):
    from larkspur.operators import evidence

    routes = spark.sql("SELECT id AS route_id, 'GET' AS http_method, concat('/:lang/', id % 50) AS route_pattern, 1 AS p FROM range(100) UNION ALL SELECT 500L, NULL, '/x/*', 1 UNION ALL SELECT 501L, 'GET', '/a{n}/:id', 1 UNION ALL SELECT 502L, 'GET', '/*/b', 1")
    requests = spark.sql("SELECT id AS finding_id, 'get' AS http_method, concat('https://h/en/', id) AS endpoint_url, 1 AS p FROM range(60) UNION ALL SELECT 70L, 'post', '/x/y/z', 1 UNION ALL SELECT 71L, 'get', '/ab/c?q', 1 UNION ALL SELECT 72L, 'get', '//b', 1")
    out = evidence.route_match(requests, routes, ["p"])
    assert {r.finding_id: r.route_id for r in out.collect()} == {**{i: i if i < 50 else None for i in range(60)}, 70: 500, 71: 501, 72: None}
    assert any("_literal" in line and "Join" in line for line in plan(out).split("\n"))


def test_cross_link_follows_the_chain_once_for_each_route(spark):
    requests = spark.createDataFrame([(i, f"/a/{i}", "get", i % 2) for i in range(40)], "finding_id long, endpoint_url string, http_method string, p long")
    routes = spark.createDataFrame([(7, "/a/:id", "GET", 0, "f.js", "h"), (8, "/a/:id", "GET", 1, "g.js", None)], "route_id long, route_pattern string, http_method string, p long, file_path string, handler_name string")
    flows = spark.createDataFrame([("y", 0, "f.js", "h", 5), ("z", 0, "f.js", "h", 6), ("w", 1, "g.js", "k", 9), ("v", 3, "f.js", "h", 4)], "flow_id string, project_id long, entry_point_file string, entry_point_method string, dependency_id long")
    findings = spark.createDataFrame([(0, 5, "low", "A"), (0, 5, "high", "B"), (3, 4, "low", "C")], "project_id long, dependency_id long, severity string, osv_id string")
    out = evidence.cross_link(requests, routes, flows, findings, key="p")
    want = {0: (7, 5, "B", 2, "route_flow_vuln"), 1: (8, 9, None, None, "route_and_flow_no_vuln")}
    assert {(r.finding_id, *r[2:]) for r in out.collect()} == {(i, *want[i % 2]) for i in range(40)}
    assert "LeftSemi" in plan(out)  # flows of other handlers leave before they are grouped


def test_long_needles_do_not_meet_texts_by_four_digits(spark):
    """Names that end with a number share every gram of four letters with many others, but none of twelve."""
    names = [f"almond-{100000 + i}" for i in range(400)]
    frame = spark.createDataFrame([(n,) for n in names], "text string")
    filed, _ = evidence.filed_needles(frame, frame.withColumnRenamed("text", "needle"))
    assert filed.agg(F.sum("_df")).first()[0] == len(names)
