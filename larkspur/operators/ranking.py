"""Sorted, limited and paged reads (TOP*, SET1, WIN6, WIN8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import labels, versions
from larkspur.functions.scores import lookup
from larkspur.operators.filters import row_number_at_most
from larkspur.session import written

C = F.col
# Preference of base-image providers.
PROVIDER_WEIGHT = {"chainguard": 1.0, "wolfi": 0.95, "dhi": 0.85, "distroless": 0.7, "official_slim": 0.5}


def ranking_order() -> list[Column]:
    """Score, severity rank, publication date, then id: a total order."""
    return [
        labels.ranking_score(C("contextual_depscore"), C("depscore"), -1).desc(), labels.severity_rank(C("severity")).desc(),
        C("published_at").desc_nulls_last(), C("finding_id").asc(),
    ]


def running_total(rows: DataFrame, partition: list[str], bucket: dict[str, Column], order: list[Column], value: Column, name: str) -> DataFrame:
    """Running sum of ``value`` per partition, in two levels so that a hot partition is not one task.

    ``bucket`` holds columns that never decrease in the wanted order.  Bucket totals are added up first; the rows
    are then summed inside their bucket only, on top of what lies before it.
    """
    marked = rows.withColumns({**bucket, "_value": value})
    keys = list(bucket)
    sums = marked.groupBy(*partition, *keys).agg(F.sum("_value").alias("_sum"))
    w = Window.partitionBy(*partition).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(w), F.lit(0))).select(*[C(c).alias(f"_r_{c}") for c in [*partition, *keys]], "_before")
    condition = F.lit(True)
    for c in [*partition, *keys]:
        condition = condition & C(c).eqNullSafe(C(f"_r_{c}"))
    joined = marked.join(before, condition).drop(*[f"_r_{c}" for c in [*partition, *keys]])
    v = Window.partitionBy(*partition, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, C("_before") + F.sum("_value").over(v)).drop("_before", "_value", *keys)


def rank_findings(findings: DataFrame, partition: list[str], slices: int | None = None) -> DataFrame:
    """Every finding with its rank inside its partition.

    The rows are cut into slices of about equal size by splitters that Spark samples from the whole order, ids
    included, so neither a hot partition nor a crowd of equal scores is one task.  A row's rank is the number of its
    partition's rows in earlier slices and its place in its own slice, which the sorted slice gives without a window.
    """
    n = slices or int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*[C(p).asc() for p in partition], *ranking_order()]
    cut = findings.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(cut.withColumn("_at", F.monotonically_increasing_id()).withColumn("_slice", F.spark_partition_id()))
    own = placed.groupBy(*partition, "_slice").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # partitions and slices, not rows
    w = Window.partitionBy(*partition).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = own.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(*[C(p).alias(f"_r_{p}") for p in partition], C("_slice").alias("_r__slice"), "_first", "_before")
    same = F.lit(True)
    for p in [*partition, "_slice"]:
        same = same & C(p).eqNullSafe(C(f"_r_{p}"))
    return placed.join(before, same).withColumn("rank", C("_before") + C("_at") - C("_first") + 1).select(*findings.columns, "rank")


def cap_per_project(findings: DataFrame, n: int = 100) -> DataFrame:
    return row_number_at_most(findings, ["project_id"], ranking_order(), n)


def all_findings(**families: DataFrame) -> DataFrame:
    """One long table over all families: family, finding, project, run, severity, status, score."""
    out = None
    for family, rows in families.items():
        def have(c: str, kind: str, rows=rows) -> Column:
            return C(c).cast(kind).alias(c) if c in rows.columns else F.lit(None).cast(kind).alias(c)

        part = rows.select(
            F.lit(family).alias("family"), C("finding_id").cast("string").alias("finding_id"), "project_id", have("extraction_run_id", "string"),
            F.lower(have("severity", "string")).alias("severity"), have("status", "string"), have("depscore", "long"))
        out = part if out is None else out.unionByName(part)
    return out


def org_top(all_rows: DataFrame, projects: DataFrame, limit: int = 50) -> DataFrame:
    """Worst findings of each organization over all its projects and families."""
    rows = all_rows.join(projects.select("project_id", "organization_id"), "project_id")
    return row_number_at_most(rows, ["organization_id"], [C("depscore").desc_nulls_last(), C("family").asc(), C("finding_id").asc()], limit)


def page(rows: DataFrame, partition: list[str], order: list, *, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) per partition, with the exact row count of the partition."""
    first = row_number_at_most(rows, partition, order, number * size)
    w = Window.partitionBy(*partition).orderBy(*order)
    kept = first.withColumn("_rn", F.row_number().over(w)).filter(C("_rn") > (number - 1) * size).drop("_rn")
    total = rows.groupBy(*partition).agg(F.count("*").alias("total"))
    return kept.join(total, partition)


def keyset_page(rows: DataFrame, *, time: str, key: str, cursor: tuple | None, limit: int) -> DataFrame:
    """Rows after the cursor in (time, key) descending order, one more than the limit to show whether more follow."""
    out = rows
    if cursor is not None:
        at = F.lit(cursor[0]).cast("timestamp_ntz")
        out = out.filter((C(time) < at) | ((C(time) == at) & (C(key) < cursor[1])))
    return out.orderBy(C(time).desc(), C(key).desc()).limit(limit + 1)


def recent_activity(k: int = 20, **sources: DataFrame) -> DataFrame:
    """Newest ``k`` rows per project over several (project_id, item_id, happened_at) sources.

    Each source is cut to ``k`` per project before the merge.
    """
    order = [C("happened_at").desc(), C("source").asc(), C("item_id").asc()]
    merged = None
    for name, rows in sources.items():
        part = row_number_at_most(rows.select("project_id", "item_id", "happened_at", F.lit(name).alias("source")), ["project_id"], order, k)
        merged = part if merged is None else merged.unionByName(part)
    return row_number_at_most(merged, ["project_id"], order, k)


def rank_base_images(current: DataFrame, catalog: DataFrame, k: int = 3) -> DataFrame:
    """Best replacement images per (project, image): half CVE gain, 0.3 drop-in fit, 0.2 provider.

    Images without a shell are left out where one is required.  The score depends on the catalog row and the
    current finding count only, so it is computed per (image, count), not per project.
    """
    fit = C("drop_in_score") / 100.0 * 0.3 + lookup(PROVIDER_WEIGHT, C("provider"), 0.5) * 0.2
    fitted = catalog.withColumn("_fit", fit)
    # the gain depends on the alternative's CVE count alone, so only the k best fitting per count can win
    short = row_number_at_most(fitted, ["base_image", "has_shell", "cve_count"], [C("_fit").desc(), C("image").asc()], k)
    cases = current.select(C("image_reference").alias("base_image"), "finding_count", "shell_required").distinct()
    gain = F.when(C("finding_count") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (C("finding_count") - C("cve_count")) / C("finding_count"))))
    scored = (
        cases.join(short, "base_image").filter(~C("shell_required") | C("has_shell"))
        .withColumn("score", F.round(gain * 0.5 + C("drop_in_score") / 100.0 * 0.3 + lookup(PROVIDER_WEIGHT, C("provider"), 0.5) * 0.2, 6))
    )
    key = ["base_image", "finding_count", "shell_required"]
    order = [C("score").desc(), C("image").asc()]
    w = Window.partitionBy(*key).orderBy(*order)
    best = row_number_at_most(scored, key, order, k).withColumn("rank", F.row_number().over(w).cast("long"))
    mine = current.withColumnRenamed("image_reference", "base_image")
    return mine.join(best.select(*key, "image", "score", "rank"), key)


def truncate_by_bytes(rows: DataFrame, partition: list[str], *, max_bytes: int, json: Column, severity: str = "severity", tie: str = "finding_id") -> DataFrame:
    """Longest highest-severity prefix per partition whose JSON array fits ``max_bytes``.

    The size is the rows' JSON plus one comma each plus the brackets.  Two passes keep hot partitions splittable:
    bytes are first added up per (severity, hash slice of the tie-break) bucket, which is monotone in the final
    order; whole buckets before the cut are kept as they are and only the bucket that crosses it is ordered row by
    row.
    """
    limit = max_bytes - 1
    sized = (
        rows.withColumn("_bytes", F.octet_length(json) + 1).withColumn("_rank", -labels.severity_rank(C(severity)))
        .withColumn("_order", F.sha2(C(tie).cast("string"), 256)).withColumn("_slice", F.substring("_order", 1, 3))
    )
    bucket = [*partition, "_rank", "_slice"]
    sums = sized.groupBy(*bucket).agg(F.sum("_bytes").alias("_sum"))
    w = Window.partitionBy(*partition).orderBy("_rank", "_slice").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_end", F.sum("_sum").over(w)).withColumn("_before", C("_end") - C("_sum")).filter(C("_before") < limit)
    placed = sized.join(sums.select(*bucket, "_before", "_end"), bucket)
    whole = placed.filter(C("_end") <= limit)
    v = Window.partitionBy(*partition).orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter(C("_end") > limit).withColumn("_upto", C("_before") + F.sum("_bytes").over(v)).filter(C("_upto") <= limit).drop("_upto")
    return whole.unionByName(edge).select(rows.columns)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays, in doubles."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, z: acc + z)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_topk(memories: DataFrame, query_vector: Column, *, organization_id: int | None, now: Column, threshold: float, k: int, category: str | None = None) -> DataFrame:
    """Most similar unexpired memories above the threshold."""
    rows = memories.filter(C("expires_at").isNull() | (C("expires_at") > now))
    if organization_id is not None:
        rows = rows.filter(C("organization_id") == organization_id)
    if category is not None:
        rows = rows.filter(C("category") == category)
    scored = rows.withColumn("similarity", cosine(C("embedding"), query_vector)).filter(C("similarity") > threshold)
    return scored.orderBy(C("similarity").desc(), C("memory_id").asc()).limit(k)


def fix_priority(findings: DataFrame, first: int = 20, keep: int = 10) -> DataFrame:
    """Worst ``first`` open findings per project by score, re-sorted breached, warning, rest; first ``keep``."""
    rows = findings.filter(~C("suppressed") & ~C("risk_accepted"))
    score = [C("depscore").desc_nulls_last(), C("finding_id").asc()]
    worst = row_number_at_most(rows, ["project_id"], score, first)
    sla = F.when(C("sla_status") == "breached", 0).when(C("sla_status") == "warning", 1).otherwise(2)
    w = Window.partitionBy("project_id").orderBy(sla, *score)
    return worst.withColumn("rank", F.row_number().over(w).cast("long")).filter(C("rank") <= keep)


def version_list(current: DataFrame, counts: DataFrame, banned: DataFrame, *, number: int, size: int) -> DataFrame:
    """Page of a package's versions, newest first: stable ones plus the one in use, with counts and ban flag.

    What a page shows depends on the package and the version in use alone, so pages are made once for each of those and
    then handed to the projects; bans come as the list of a project's banned versions of the package.
    """
    key = versions.version_key(C("version"))
    rows = counts.withColumn("_key", key).withColumn("_stable", C("_key").isNotNull() & ~versions.is_prerelease(C("version")))
    of = ["project_id", "dependency_id"]
    mine = current.select(*of, C("version").alias("current_version")).repartition(*of).distinct()
    in_use = current.select("dependency_id", C("version").alias("current_version")).distinct()
    listed = in_use.join(rows.hint("merge"), "dependency_id").filter(C("_stable") | (C("version") == C("current_version"))).drop("_stable")
    order = [C("_key").desc_nulls_last(), C("version_id").desc()]
    shown = page(listed, ["dependency_id", "current_version"], order, number=number, size=size).drop("_key")
    bans = banned.groupBy(*of).agg(F.collect_set("version").alias("_banned"))
    out = mine.join(bans.hint("merge"), of, "left").join(shown.hint("merge"), ["dependency_id", "current_version"])
    return out.withColumn("is_banned", F.coalesce(F.array_contains("_banned", C("version")), F.lit(False))).drop("_banned")


def versions_behind(deps: DataFrame, catalog: DataFrame, version_rows: DataFrame) -> DataFrame:
    """How many stable versions lie above the installed one, up to the latest; and the outdated flag.

    Each version in question gets its rank among the package's stable versions, counted inside (major, minor)
    buckets; the answer is a difference of two ranks, so versions are never paired with each other.
    """
    latest = catalog.filter(C("latest_version").isNotNull()).select("dependency_id", versions.version_key(C("latest_version")).alias("_l"))
    stable = version_rows.filter(~versions.is_prerelease(C("version"))).select("dependency_id", versions.version_key(C("version")).alias("_v")).filter(C("_v").isNotNull())
    uses = deps.filter(C("removed_at").isNull()).withColumn("_c", versions.version_key(C("version"))).filter(C("_c").isNotNull())
    counted = stable.groupBy("dependency_id", "_v").agg(F.count("*").alias("_n"))
    asked = uses.select("dependency_id", C("_c").alias("_v")).unionByName(latest.select("dependency_id", C("_l").alias("_v"))).filter(C("_v").isNotNull()).distinct()
    points = counted.unionByName(asked.withColumn("_n", F.lit(0).cast("long"))).groupBy("dependency_id", "_v").agg(F.sum("_n").alias("_n"))
    ranked = running_total(points, ["dependency_id"], {"_b1": C("_v.major"), "_b2": C("_v.minor")}, [C("_v").asc()], C("_n"), "_rank").select("dependency_id", "_v", "_rank")
    out = (
        uses.join(latest.filter(C("_l").isNotNull()), "dependency_id")
        .join(ranked.select("dependency_id", C("_v").alias("_c"), C("_rank").alias("_rc")), ["dependency_id", "_c"])
        .join(ranked.select("dependency_id", C("_v").alias("_l"), C("_rank").alias("_rl")), ["dependency_id", "_l"])
    )
    old = C("_c") < C("_l")
    return out.withColumn("is_outdated", old).withColumn("versions_behind", F.when(old, C("_rl") - C("_rc")).otherwise(0).cast("long")).drop("_c", "_l", "_rc", "_rl")


def flow_rank(flows: DataFrame, key: list[str], limit: int = 20) -> DataFrame:
    """Shortest flows per key."""
    return row_number_at_most(flows, key, [C("flow_length").asc_nulls_last(), C("flow_id").asc()], limit)


def distinct_on(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row per key under an order."""
    return row_number_at_most(rows, key, order, 1)
