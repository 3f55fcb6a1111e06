"""Distributed algorithms against plain Python on random inputs."""

from __future__ import annotations

import hashlib
import json
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from larkspur.operators import evidence, graph, notify, ranking
from larkspur.session import bucketed, forget

C = F.col


@pytest.mark.parametrize("seed", [1, 2])
def test_closure(spark, seed):
    rng = random.Random(seed)
    edges = {(p, rng.randrange(30), rng.randrange(30)) for p in range(3) for _ in range(45)}
    seeds = {(p, rng.randrange(30)) for p in range(3) for _ in range(2)}
    want = set()
    for p in range(3):
        nexts = defaultdict(set)
        for q, a, b in edges:
            if q == p:
                nexts[a].add(b)
        seen = {n for q, n in seeds if q == p}
        queue = list(seen)
        while queue:
            for child in nexts[queue.pop()]:
                if child not in seen:
                    seen.add(child)
                    queue.append(child)
        want |= {(p, n) for n in seen}
    got = graph.closure(spark.createDataFrame(list(edges), "project_id int, parent int, child int"), spark.createDataFrame(list(seeds), "project_id int, node int"), group=["project_id"])
    assert {(r["project_id"], r["node"]) for r in got.collect()} == want


def test_closure_that_does_not_settle_is_an_error(spark):
    chain = spark.range(20).select(C("id").alias("parent"), (C("id") + 1).alias("child"))
    with pytest.raises(RuntimeError):
        graph.closure(chain, spark.createDataFrame([(0,)], "node long"), max_rounds=3)


def test_contains_match(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab-.") for _ in range(n))
    texts = {(k, word(rng.randrange(1, 12))) for k in range(3) for _ in range(60)}
    needles = {(k, word(rng.randrange(1, 7))) for k in range(3) for _ in range(25)}
    want = {(k, t, n) for k, t in texts for j, n in needles if j == k and n in t}
    got = evidence.contains_match(spark.createDataFrame(list(texts), "project_id int, text string"), spark.createDataFrame(list(needles), "project_id int, needle string"), ["project_id"])
    rows = [tuple(r) for r in got.select("project_id", "text", "needle").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_contains_match_without_short_needles(spark):
    got = evidence.contains_match(spark.createDataFrame([(1, "my-package.call"), (1, "ab")], "project_id int, text string"), spark.createDataFrame([(1, "package")], "project_id int, needle string"), ["project_id"])
    assert [r["text"] for r in got.collect()] == ["my-package.call"]


def _sliding_log(events, limit, window):
    out, recent = {}, defaultdict(deque)
    for scope, t, i in sorted(events, key=lambda e: (e[1], e[2])):
        log = recent[scope]
        while log and log[0] <= t - window:
            log.popleft()
        out[i] = len(log) < limit
        if out[i]:
            log.append(t)
    return out


def test_rate_limit(spark):
    rng = random.Random(5)
    # one scope holds most events; the times leave idle gaps
    events = [(rng.choice([1, 1, 1, 2]), rng.choice([0, 50_000]) + rng.randrange(9000), i) for i in range(400)]
    rows = spark.createDataFrame(events, "scope int, sec long, event_id int").withColumn("created_at", F.timestamp_seconds("sec"))
    got = {r["event_id"]: r["allowed"] for r in notify.rate_limit(rows, scope="scope", time="created_at", tie="event_id", limit=7, window_seconds=600).collect()}
    assert got == _sliding_log(events, 7, 600)


def test_truncate_by_bytes(spark):
    rng = random.Random(7)
    rows = [(p, f"f{p}-{i}", rng.choice(["CRITICAL", "HIGH", "LOW", None])) for p in range(2) for i in range(300)]
    df = spark.createDataFrame(rows, "project_id int, finding_id string, severity string")
    got = ranking.truncate_by_bytes(df, ["project_id"], max_bytes=3000, json=F.to_json(F.struct("finding_id")))
    rank = {"CRITICAL": 4, "HIGH": 3, "LOW": 1, None: 0}
    want = set()
    for p in range(2):
        mine = sorted((r for r in rows if r[0] == p), key=lambda r: (-rank[r[2]], hashlib.sha256(r[1].encode()).hexdigest()))
        kept = []
        for r in mine:
            if len(json.dumps([{"finding_id": x[1]} for x in kept + [r]], separators=(",", ":")).encode()) > 3000:
                break
            kept.append(r)
        want |= {r[1] for r in kept}
    assert {r["finding_id"] for r in got.collect()} == want


def test_running_total(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(3), rng.randrange(50), i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, a int, i int, n int")
    out = ranking.running_total(df, ["k"], {"_b": F.floor(C("a") / 7)}, [C("a").asc(), C("i").asc()], C("n"), "total")
    sums, want = defaultdict(int), {}
    for k, _a, i, n in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        sums[k] += n
        want[i] = sums[k]
    assert {r["i"]: r["total"] for r in out.collect()} == want


def test_usage_match_spellings(spark):
    deps = spark.createDataFrame([(1, "a", "jackson-databind"), (1, "b", "PyYAML"), (1, "c", "log4j-core"), (1, "d", "qs"), (1, "e", "unused-thing")], "project_id int, project_dependency_id string, name string")
    usages = spark.createDataFrame([
        (1, "f1", "com.fasterxml.jackson.databind.ObjectMapper", "readValue"), (1, "f2", None, "yaml.load"), (1, "f3", "org.apache.log4j.Logger", None), (1, "f4", "qs", "parse"), (2, "f5", "unused-thing", "x")],
        "project_id int, file_path string, target_type string, resolved_method string")
    got = {(r["project_dependency_id"], r["file_path"]) for r in evidence.usage_match(usages, deps).collect()}
    assert got == {("a", "f1"), ("b", "f2"), ("c", "f3"), ("d", "f4")}


def test_veto_ignores_owners(spark):
    imports = spark.createDataFrame([(1, "p1", "a.b.c"), (1, "p2", "x.y"), (1, "p1", "x.y.z")], "project_id int, package string, module string")
    asked = spark.createDataFrame([(1, 1, "a.b", "p1"), (1, 2, "a.b", "p9"), (1, 3, "x.y", "p1"), (1, 4, "a.b.c.d", "p9"), (1, 5, "a", "p2")], "project_id int, question_id int, module string, owner string")
    assert {r["question_id"]: r["veto"] for r in evidence.transitive_veto(asked, imports).collect()} == {1: False, 2: True, 3: True, 4: False, 5: True}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_closure_with_chains_hubs_and_cycles(spark, seed):
    rng = random.Random(seed)
    edges = {(i, i + 1) for i in range(200)} | {(1000, 2000 + i) for i in range(40)} | {(2000 + i, 1000) for i in range(40)} | {(60, 1000), (2007, 3000), (3000, 3001), (3001, 3000)}
    edges |= {(rng.randrange(4000, 4060), rng.randrange(4000, 4060)) for _ in range(100)} | {(3001, 4000 + seed), (5, 5)}
    start = [0, 150, 4001][seed - 3]
    nexts = defaultdict(set)
    for a, b in edges:
        nexts[a].add(b)
    seen, queue = {start}, [start]
    while queue:
        for child in nexts[queue.pop()] - seen:
            seen.add(child)
            queue.append(child)
    got = graph.closure(spark.createDataFrame(list(edges), "parent int, child int"), spark.createDataFrame([(start,)], "node int"))
    assert sorted(r["node"] for r in got.collect()) == sorted(seen)


def test_a_long_chain_settles_in_few_rounds(spark):
    chain = spark.range(4096).select(C("id").alias("parent"), (C("id") + 1).alias("child"))
    assert graph.closure(chain, spark.createDataFrame([(0,)], "node long"), max_rounds=15).count() == 4097


def test_a_round_exchanges_the_frontier_only(spark):
    edges = bucketed(spark.range(100).select((C("id") % 3).alias("project_id"), C("id").alias("node"), (C("id") + 1).alias("_next")), ["project_id", "node"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph.step(edges.select("project_id", "node"), edges, ["project_id"], ["project_id"])._jdf.queryExecution().executedPlan().toString()
        one = graph.step(spark.range(9).select((C("id") % 3).alias("project_id"), C("id").alias("node")), edges, ["project_id"], ["project_id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and one.count("Exchange") == 1 and "Bucketed: true" in plan
    forget(edges)


def test_taint_paths_of_fifty_hops_and_one_more(spark):
    calls = spark.createDataFrame([(p, f"f{i:02}", f"f{i + 1:02}") for p, n in ((1, 50), (2, 51)) for i in range(n)], "project_id long, caller string, callee string")
    roles = spark.createDataFrame([(1, "f00", "source"), (2, "f00", "source"), (1, "f50", "sink"), (2, "f50", "sink"), (2, "f51", "sink"), (1, "f13", "sink")], "project_id long, fn string, role string")
    got = {(r["project_id"], r["sink"]): r for r in graph.taint_flows(calls, roles).collect()}
    assert set(got) == {(1, "f13"), (1, "f50"), (2, "f50")}
    assert all(r["path"] == ">".join(f"f{i:02}" for i in range(r["hops"] + 1)) and r["truncated"] == (r["project_id"] == 2) for r in got.values())


def test_needles_with_one_ending_are_filed_apart(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    needles = sorted({word(8) + ".create" for _ in range(10_000)})
    texts = [f"use {n} here" for n in needles[::10]] + [f"{word(9)}.create" for _ in range(2000)]
    frame = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string").distinct()
    filed, _ = evidence.filed_needles(frame(texts, "text"), frame(needles, "needle"))
    sizes = [r["count"] for r in filed.groupBy("_gram").count().collect()]
    work = [r["n"] for r in filed.groupBy((F.xxhash64("_gram") % 16).alias("task")).agg(F.sum("_df").alias("n")).collect()]
    assert sum(sizes) >= 1000 and max(work) <= 3 * sorted(work)[len(work) // 2]
    assert filed.filter(C("_gram").isin("crea", "reat", "eate", ".cre")).isEmpty()


def test_grams_with_many_pairs_are_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(evidence, "HOT_PAIRS", 5)
    texts = [(1, f"aaaa{i}") for i in range(30)] + [(2, "aaaa1")]
    needles = [(1, "aaaa"), (1, "aaa"), (1, "a"), (1, "aaaa1"), (2, "aaaa2"), (2, "")]
    got = evidence.contains_match(spark.createDataFrame(texts, "project_id int, text string"), spark.createDataFrame(needles, "project_id int, needle string"), ["project_id"])
    rows = [tuple(r) for r in got.collect()]
    want = [(p, t, n) for p, t in texts for q, n in needles if p == q and n and n in t]
    assert sorted(rows) == sorted(want)
