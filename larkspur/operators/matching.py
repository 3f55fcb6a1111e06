"""Package-to-advisory matching and threat enrichment (JN1-JN8, JN17-JN22, JN30, JN31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import labels, packages, versions
from larkspur.operators.filters import row_number_at_most
from larkspur.session import written

C = F.col


def prefer_prod_scope(deps: DataFrame, key: list[str], row_id: str) -> DataFrame:
    """One row per key: a non-dev row wins, then the lowest id."""
    return row_number_at_most(deps, key, [F.coalesce(C("environment") == "dev", F.lit(False)), C(row_id)], 1)


#: Names of a project and version are dealt over so many places.
NAME_PLACES = 64


def _name_place(name: Column) -> Column:
    """Where a name is looked up: the same for all spellings that some rung of the name ladder takes for one name."""
    last = F.substring_index(F.translate(packages.join_name(name, F.lit("pypi")), ":", "/"), "/", -1)
    return F.pmod(F.xxhash64(F.trim(last)), F.lit(NAME_PLACES)).cast("int")


def attach_advisories(hits: DataFrame, deps: DataFrame) -> DataFrame:
    """Attach report hits to packages by the first rung of the name ladder that matches.

    Rungs: the reference as written, with ``/`` as ``:``, its last path part, and the registry-normalized name.
    The first three compare with the package's own name, the last with its normalized name.

    Hits and packages are exchanged once, to the place that all rungs share; there a hit meets the packages of a name in
    sorted order, so neither the keys of the ladder nor what they find is exchanged.
    """
    name = C("ref_name")
    deep = name.contains("/")

    def rung(number: int, kind: str, key: Column) -> Column:
        return F.struct(F.lit(number).alias("rung"), F.lit(kind).alias("kind"), key.alias("key"))

    asked = F.array(
        rung(1, "exact", name),
        rung(2, "exact", F.when(deep, F.regexp_replace(name, "/", ":"))),
        rung(3, "exact", F.when(deep, F.element_at(F.split(name, "/"), -1))),
        rung(4, "norm", packages.join_name(name, C("ecosystem"))),
    )
    own = F.array(rung(0, "exact", name), rung(0, "norm", packages.join_name(name, C("ecosystem"))))
    dev = F.coalesce(C("environment") == "dev", F.lit(False))
    base = deps.select("project_id", "version", C("name").alias("ref_name"), "ecosystem", C("project_dependency_id").alias("_id"), dev.alias("_dev"))
    rows = hits.unionByName(base, allowMissingColumns=True).filter(C("project_id").isNotNull() & C("version").isNotNull() & name.isNotNull())
    place = ["project_id", "version", "_place"]
    # rows are numbered behind the exchange, where all that follows is done within one task
    rows = rows.withColumn("_place", _name_place(name)).repartition(*place).withColumn("_row", F.monotonically_increasing_id())
    keys = F.filter(F.when(C("_dev").isNull(), asked).otherwise(own), lambda c: c["key"].isNotNull())
    probes = rows.select("*", F.explode(keys).alias("_c")).select(*rows.columns, C("_c.rung").alias("rung"), C("_c.kind").alias("_kind"), C("_c.key").alias("_key"))
    # packages come before hits: a non-dev row first, then the lowest id
    seen = Window.partitionBy(*place, "_kind", "_key").orderBy("rung", "_dev", "_id").rowsBetween(Window.unboundedPreceding, 0)
    found = probes.withColumn("project_dependency_id", F.first("_id").over(seen)).filter((C("rung") > 0) & C("project_dependency_id").isNotNull())
    return row_number_at_most(found, [*place, "_row"], [C("rung")], 1).select(*hits.columns, "rung", "project_dependency_id")


def affected_versions(version_rows: DataFrame, advisories: DataFrame) -> DataFrame:
    """Pairs of package version and advisory that applies to it.

    ``advisories`` carries ``ranges`` (array of introduced/fixed), ``versions`` (array of text) and
    ``ranges_missing``; an advisory without any range data applies to every version, a version that does not
    coerce is otherwise never affected, and each introduced/fixed pair is its own interval.
    """
    left = version_rows.withColumn("_key", versions.version_key(C("version")))
    intervals = F.transform(
        F.filter(F.coalesce(C("ranges"), F.array().cast("array<struct<introduced:string,fixed:string>>")), lambda r: r["introduced"].isNotNull()),
        lambda r: F.struct(versions.version_key(r["introduced"]).alias("low"), versions.version_key(r["fixed"]).alias("high")),
    )
    listed = F.transform(F.coalesce(C("versions"), F.array().cast("array<string>")), lambda x: versions.version_key(x))
    right = advisories.withColumn("_ranges", intervals).withColumn("_listed", listed)
    in_interval = F.exists(
        C("_ranges"), lambda r: F.coalesce((C("_key") >= r["low"]) & (r["high"].isNull() | (C("_key") < r["high"])), F.lit(False))
    )
    in_list = F.exists(C("_listed"), lambda k: F.coalesce(k == C("_key"), F.lit(False)))
    hit = C("ranges_missing") | (C("_key").isNotNull() & (in_interval | in_list))
    # both sides may be much larger than the files they are made from, which is all the planner knows of them
    out = left.join(right.withColumnRenamed("dependency_id", "_dep").hint("merge"), (C("dependency_id") == C("_dep")) & hit)
    return out.drop("_key", "_ranges", "_listed", "_dep")


def is_fixed(version: Column, fixed_versions: Column) -> Column:
    """Is the version at or above any fixed version?"""
    key = versions.version_key(version)
    hit = F.exists(fixed_versions, lambda f: F.coalesce(key >= versions.version_key(f), F.lit(False)))
    return F.coalesce(key.isNotNull() & hit, F.lit(False))


def feed_keys(feed: DataFrame) -> DataFrame:
    """Live feed rows with canonical ecosystem and name."""
    eco = packages.canonical_ecosystem(C("ecosystem"))
    return (
        feed.filter(C("withdrawn_at").isNull())
        .withColumn("eco", eco).filter(C("eco").isNotNull())
        .withColumn("package_key", packages.canonical_name(C("package_name"), C("eco")))
    )


def _feed_version_hit() -> Column:
    """Range test for npm rows with a range, normalized equality for the others."""
    clauses = versions.parse_range(C("vulnerable_range"))
    installed = versions.version_key(C("version"))
    ranged = (C("eco") == "npm") & C("vulnerable_range").isNotNull()
    in_range = clauses.isNotNull() & installed.isNotNull() & versions.in_range(installed, clauses)

    def norm(column: str) -> Column:
        return F.coalesce(versions.version_norm(C(column), C("eco")), F.trim(C(column)))

    same = C("feed_version").isNotNull() & (norm("feed_version") == norm("version"))
    return C("version").isNotNull() & F.when(ranged, in_range).otherwise(F.coalesce(same, F.lit(False)))


FEED_COLUMNS = ["feed_id", "source", "source_id", "severity", "feed_version", "vulnerable_range"]


def _feed_side(feed: DataFrame) -> DataFrame:
    return feed_keys(feed).withColumnRenamed("version", "feed_version").withColumn(
        "severity", F.coalesce(C("severity"), F.lit("critical"))
    )


def match_malware_feed(deps: DataFrame, feed: DataFrame) -> DataFrame:
    """Packages whose installed version is known malware; rows without a version or range never match."""
    left = (
        deps.withColumn("eco", packages.canonical_ecosystem(C("ecosystem"))).filter(C("eco").isNotNull())
        .withColumn("package_key", packages.canonical_name(C("name"), C("eco")))
    )
    right = _feed_side(feed).select("eco", "package_key", *FEED_COLUMNS)
    return left.join(right, ["eco", "package_key"]).filter(_feed_version_hit())


def match_unique_artifact(deps: DataFrame, feed: DataFrame) -> DataFrame:
    """Bare Maven artifacts against ``group:artifact`` feed rows, only when one coordinate owns the artifact.

    Uniqueness counts all feed rows, withdrawn ones included.
    """
    maven = feed.filter((packages.canonical_ecosystem(C("ecosystem")) == "maven") & C("package_name").contains(":"))
    artifact = F.element_at(F.split(C("package_name"), ":"), -1)
    unique = maven.groupBy(artifact.alias("artifact")).agg(
        F.min("package_name").alias("_lo"), F.max("package_name").alias("_hi")
    ).filter(C("_lo") == C("_hi")).select("artifact", C("_lo").alias("package_key"))
    right = _feed_side(feed).filter(C("eco") == "maven").select("eco", "package_key", *FEED_COLUMNS)
    bare = deps.filter((packages.canonical_ecosystem(C("ecosystem")) == "maven") & ~C("name").contains(":"))
    owned = bare.withColumn("artifact", F.trim(C("name"))).join(unique, "artifact")
    return owned.join(right, "package_key").filter(_feed_version_hit())


def enrich_threat(findings: DataFrame, kev: DataFrame, epss: DataFrame) -> DataFrame:
    """``cisa_kev`` when the id or an alias is a listed CVE; ``epss_score`` filled from the table when absent."""
    listed = kev.select(C("cve_id").alias("_id")).distinct()
    ids = F.filter(packages.full_alias_set(C("osv_id"), C("aliases")), lambda x: x.rlike(r"(?i)^CVE-[0-9]{4}-[0-9]+$"))
    vulns = findings.select("osv_id", "aliases").distinct().withColumn("_id", F.explode(ids))
    flagged = vulns.join(listed, "_id", "left_semi").select("osv_id", "aliases").distinct()
    scored = epss.select(C("cve_id").alias("osv_id"), C("epss").alias("_epss"))
    marked = findings.drop("cisa_kev").join(
        flagged.select(C("osv_id").alias("_o"), C("aliases").alias("_a"), F.lit(True).alias("_kev")),
        (C("osv_id") == C("_o")) & C("aliases").eqNullSafe(C("_a")), "left",
    )
    return (
        marked.join(scored, "osv_id", "left")
        .withColumn("cisa_kev", F.coalesce(C("_kev"), F.lit(False)))
        .withColumn("epss_score", F.coalesce(C("epss_score"), C("_epss")))
        .drop("_o", "_a", "_kev", "_epss")
    )


def kev_epss_lookup(findings: DataFrame) -> DataFrame:
    """Organization-wide threat signal per id or alias: any KEV flag, highest EPSS, affected projects."""
    return (
        findings.select("project_id", "cisa_kev", "epss_score", F.explode(packages.full_alias_set(C("osv_id"), C("aliases"))).alias("vuln_id"))
        .groupBy("vuln_id")
        .agg(F.bool_or("cisa_kev").alias("cisa_kev"), F.max("epss_score").alias("epss_score"), F.countDistinct("project_id").alias("projects"))
    )


def latest_snapshot(snapshots: DataFrame, key: list[str], time: str, tie: str) -> DataFrame:
    """Most recent row per key; a tie on time goes to the larger tie-break value."""
    best = row_number_at_most(snapshots, key, [C(time).desc(), C(tie).desc()], 1)
    return best.select(*key, *[c for c in snapshots.columns if c not in key])


def as_of_baseline(packages_df: DataFrame, snapshots: DataFrame, *, now: Column, lag_days: int = 30) -> DataFrame:
    """Each package with its latest snapshot strictly older than ``now - lag_days`` (nulls when there is none).

    The cut is one instant for all packages, so the snapshots are reduced to one per package before the join.
    """
    cut = now - F.make_dt_interval(F.lit(lag_days))
    old = latest_snapshot(snapshots.filter(C("observed_at") < cut), ["package_id"], "observed_at", "snapshot_id")
    renamed = old.select("package_id", *[C(c).alias(f"base_{c}") for c in old.columns if c != "package_id"])
    return packages_df.join(renamed, "package_id", "left")


def same_set(a: Column, b: Column) -> Column:
    """Order-free equality of two arrays, repeats ignored."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.coalesce(a, empty))) == F.array_sort(F.array_distinct(F.coalesce(b, empty)))


def maintainer_signals(rows: DataFrame, *, now: Column, created: str = "package_created_at") -> DataFrame:
    """Ownership-change signals of current snapshots against ``base_*`` columns, and the first severity rung.

    Without a baseline every change signal is false; account age and install hook are still reported.
    """
    has_base = C("base_observed_at").isNotNull()

    def changed(column: str) -> Column:
        a, b = C(f"base_{column}"), C(column)
        return has_base & F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))

    age = F.greatest(F.lit(0), F.floor(F.timestamp_diff("SECOND", C(created), now) / 86400))
    out = (
        rows.withColumn("account_age_days", age)
        .withColumn("install_script_present", C("postinstall_hash").isNotNull())
        .withColumn("email_changed", changed("primary_maintainer_email"))
        .withColumn("maintainer_changed", has_base & ~same_set(C("base_maintainer_handles"), C("maintainer_handles")))
        .withColumn("signing_changed", changed("signing_config_hash"))
        .withColumn("new_postinstall", has_base & (F.coalesce(C("base_postinstall_hash"), F.lit("")) == "") & (F.coalesce(C("postinstall_hash"), F.lit("")) != ""))
    )
    new_account = F.coalesce(C("account_age_days") < 30, F.lit(False))
    rungs = [
        (new_account & C("install_script_present"), "new_account_with_install_script", "critical"),
        (C("email_changed") & C("new_postinstall"), "email_changed_with_new_postinstall", "critical"),
        (C("maintainer_changed") & C("new_postinstall"), "maintainer_changed_with_new_postinstall", "critical"),
        (C("new_postinstall"), "new_postinstall_added", "high"),
        (C("signing_changed"), "signing_setup_changed", "high"),
        (C("email_changed"), "email_changed", "medium"),
        (C("maintainer_changed"), "maintainer_changed", "medium"),
        (new_account, "new_account", "medium"),
    ]
    rule, severity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, name, level in reversed(rungs):
        rule = F.when(condition, f"maintainer:{name}").otherwise(rule)
        severity = F.when(condition, level).otherwise(severity)
    return out.withColumn("signal_rule", rule).withColumn("signal_severity", severity)


def allowlist_apply(findings: DataFrame, deps: DataFrame, projects: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Unsuppressed malware findings that an unrevoked allowlist entry covers, with the winning entry.

    An entry for exactly the installed version beats one for every version; among equals the newest wins.
    The two kinds are reduced per key first, so no pair list is built.
    """
    live = allowlist.filter(C("revoked_at").isNull()).withColumn("eco", C("ecosystem"))
    newest = F.max(F.struct("added_at", "allowlist_id"))["allowlist_id"]
    exact = live.filter(C("version").isNotNull()).groupBy("organization_id", "eco", "package_name", "version").agg(newest.alias("_exact"))
    general = live.filter(C("version").isNull()).groupBy("organization_id", "eco", "package_name").agg(newest.alias("_general"))
    named = (
        findings.filter(~C("suppressed"))
        .join(projects.select("project_id", "organization_id"), "project_id")
        .join(deps.select("project_id", "dependency_id", C("name").alias("package_name"), "version",
                          packages.canonical_ecosystem(C("ecosystem")).alias("eco")), ["project_id", "dependency_id"])
    )
    return (
        named.join(exact, ["organization_id", "eco", "package_name", "version"], "left")
        .join(general, ["organization_id", "eco", "package_name"], "left")
        .withColumn("allowlist_id", F.coalesce("_exact", "_general"))
        .filter(C("allowlist_id").isNotNull()).drop("_exact", "_general")
    )


def is_malicious(dependencies: DataFrame, malicious_findings: DataFrame, feed: DataFrame) -> DataFrame:
    """Flag packages with an open malware finding or a live feed row under their exact name."""
    bad = malicious_findings.filter(
        ~C("suppressed") & ~C("risk_accepted") & ~C("status").isin("ignored", "resolved")
    ).select("dependency_id").distinct().withColumn("_f", F.lit(True))
    listed = feed_keys(feed).select("eco", C("package_name").alias("name")).distinct().withColumn("_k", F.lit(True))
    return (
        dependencies.withColumn("eco", packages.canonical_ecosystem(C("ecosystem")))
        .join(bad, "dependency_id", "left").join(listed, ["eco", "name"], "left")
        .withColumn("is_malicious", F.coalesce(C("_f"), C("_k"), F.lit(False))).drop("_f", "_k", "eco")
    )


def project_findings_view(findings: DataFrame, deps: DataFrame, projects: DataFrame) -> DataFrame:
    """Active-run findings with package name (scoped npm name rebuilt) and version."""
    from larkspur.operators.filters import active_run

    scoped = F.coalesce(C("namespace"), F.lit("")).startswith("@")
    named = deps.select(
        "project_id", "project_dependency_id", "version",
        F.when(scoped, F.concat_ws("/", "namespace", "name")).otherwise(C("name")).alias("dependency_name"),
    )
    return active_run(findings, projects).join(named, ["project_id", "project_dependency_id"])


def catalog_findings_view(advisories: DataFrame, deps: DataFrame) -> DataFrame:
    """Advisories of every package a project uses, whatever the version or run."""
    use = deps.select("project_id", "dependency_id", "name", "version", "project_dependency_id")
    return advisories.join(use, "dependency_id")


def with_names(facts: DataFrame, dim: DataFrame, key: str, name: str, alias: str) -> DataFrame:
    """Left join one display name; Spark broadcasts the dimension when its measured size allows."""
    return facts.join(dim.select(key, C(name).alias(alias)), key, "left")


def banned_versions(uses: DataFrame, bans: DataFrame, projects: DataFrame, project_teams: DataFrame) -> DataFrame:
    """Distinct (project, dependency, version) that the organization or one of the project's teams bans.

    Starts from the packages a project uses, so bans are never spread over projects that lack the package; packages that
    nobody bans leave first.
    """
    named = bans.select("dependency_id").distinct()
    mine = written(uses.select("project_id", "dependency_id").join(named.hint("merge"), "dependency_id", "left_semi").distinct())
    org = bans.filter(C("organization_id").isNotNull()).select("organization_id", "dependency_id", C("banned_version").alias("version"))
    team = bans.filter(C("team_id").isNotNull()).select("team_id", "dependency_id", C("banned_version").alias("version"))
    by_org = mine.join(projects.select("project_id", "organization_id"), "project_id").join(org, ["organization_id", "dependency_id"])
    by_team = mine.join(project_teams.select("project_id", "team_id"), "project_id").join(team, ["team_id", "dependency_id"])
    cols = ["project_id", "dependency_id", "version"]
    return by_org.select(cols).union(by_team.select(cols)).distinct()


def banned_in_use(uses: DataFrame, bans: DataFrame, projects: DataFrame, project_teams: DataFrame) -> DataFrame:
    """Installed (project, dependency, version) rows that are banned.

    Only versions that somebody bans are told apart by project, so what is sorted and joined is not all packages of all projects.
    """
    cols, ban = ["project_id", "dependency_id", "version"], ["dependency_id", "version"]
    named = bans.withColumnRenamed("banned_version", "version")
    hit = written(uses.select(cols).join(named.select(ban).distinct().hint("merge"), ban, "left_semi").distinct())
    org, team = (named.filter(C(c).isNotNull()).select(c, *ban).distinct() for c in ("organization_id", "team_id"))
    by_org = hit.join(projects.select("project_id", "organization_id"), "project_id").join(org, ["organization_id", *ban], "left_semi")
    by_team = hit.join(project_teams.select("project_id", "team_id"), "project_id").join(team, ["team_id", *ban], "left_semi")
    return by_org.select(cols).union(by_team.select(cols)).distinct()


def vuln_counts_by_version(version_rows: DataFrame, advisories: DataFrame) -> DataFrame:
    """Applying advisories per package version and severity; versions without any keep a zero row."""
    level = labels.severity_norm(C("severity"))
    hits = affected_versions(version_rows.select("version_id", "dependency_id", "version"), advisories)
    counts = hits.groupBy("version_id").agg(
        *[F.count_if(level == s).alias(f"{s}_vulns") for s in ("critical", "high", "medium", "low")]
    )
    out = version_rows.select("version_id", "dependency_id", "version").join(counts, "version_id", "left")
    return out.fillna(0, [f"{s}_vulns" for s in ("critical", "high", "medium", "low")])


def merge_advisories(advisories: DataFrame) -> DataFrame:
    """Advisories folded by canonical id (first CVE alias, else own id), in long form.

    One row per (canonical id, kind, value) with kind ``alias`` or ``affected``; long form keeps a vulnerability
    with very many packages splittable across tasks.
    """
    cve = F.try_element_at(
        F.filter(F.coalesce(C("aliases"), F.array().cast("array<string>")), lambda a: a.rlike(r"(?i)^CVE-[0-9]{4}-[0-9]+$")), F.lit(1)
    )
    keyed = advisories.withColumn("canonical_id", F.coalesce(cve, C("osv_id")))
    others = F.filter(packages.full_alias_set(C("osv_id"), C("aliases")), lambda a: a != C("canonical_id"))
    aliases = keyed.select("canonical_id", F.lit("alias").alias("kind"), F.explode(others).alias("value"))
    affected = keyed.select("canonical_id", F.lit("affected").alias("kind"), C("dependency_id").cast("string").alias("value"))
    return aliases.unionByName(affected).distinct()


def advisory_runs(ordered: DataFrame, hits: DataFrame) -> DataFrame:
    """(dependency_id, advisory_id, runs): the versions of a package that an advisory affects, as runs of places in its version order.

    ``ordered`` has (dependency_id, version_id, place), ``hits`` (version_id, advisory_id).  An advisory has about as many
    runs as it has ranges, however many versions lie in them.
    """
    placed = hits.join(ordered.select("dependency_id", "version_id", "place").hint("merge"), "version_id")
    inside = Window.partitionBy("dependency_id", "advisory_id").orderBy("place")
    islands = placed.withColumn("_island", C("place") - F.row_number().over(inside)).groupBy("dependency_id", "advisory_id", "_island").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    return islands.groupBy("dependency_id", "advisory_id").agg(F.collect_list(F.struct("low", "high")).alias("runs"))


def version_candidates(current: DataFrame, candidates: DataFrame, advisories: DataFrame, banned: DataFrame) -> DataFrame:
    """Per project package and candidate version: CVEs fixed, CVEs introduced, major bump and ban flags.

    ``current`` has (project_id, dependency_id, version); candidates are the stable versions of the package above
    the current one.  A sweep along the version order counts what a candidate shares with a version in use: an advisory
    of the latter adds one where a run of its begins and takes one off behind its end.  So an advisory costs its runs, not
    its versions; numbers come from the sizes of the two advisory sets and of their common part.
    """
    stable = candidates.select("dependency_id", "version_id", "version").withColumn("_k", versions.version_key(C("version")))
    stable = stable.filter(C("_k").isNotNull() & ~versions.is_prerelease(C("version")))
    hits = affected_versions(candidates.select("version_id", "dependency_id", "version"), advisories).select("version_id", "advisory_id").distinct()
    total = hits.groupBy("version_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("dependency_id").orderBy("_k", "version_id"))
    rows = stable.join(total, "version_id", "left").fillna(0, ["n"]).withColumn("place", place)
    in_use = current.select("dependency_id", "version").distinct()
    now = rows.join(in_use, ["dependency_id", "version"], "left_semi").select(
        "dependency_id", C("version").alias("cur_version"), C("version_id").alias("cur_id"), C("_k").alias("_ck"), C("n").alias("cur_n"), C("place").alias("cur_place"))
    ladder = now.join(rows.select("dependency_id", C("version").alias("candidate"), "_k", C("n").alias("cand_n"), "place").hint("merge"), "dependency_id").filter(C("_k") > C("_ck"))

    mine = now.select("dependency_id", "cur_id", "cur_place").join(advisory_runs(rows, hits).hint("merge"), "dependency_id")
    mine = mine.filter(F.exists("runs", lambda r: (r["low"] <= C("cur_place")) & (r["high"] >= C("cur_place"))))
    ends = mine.select("cur_id", "cur_place", F.explode("runs").alias("r")).filter(C("r.high") > C("cur_place"))
    turns = F.array(F.struct(F.greatest(C("r.low"), C("cur_place") + 1).alias("place"), F.lit(1).alias("turn")), F.struct((C("r.high") + 1).alias("place"), F.lit(-1).alias("turn")))
    events = ends.select("cur_id", F.explode(turns).alias("t")).groupBy("cur_id", "t.place").agg(F.sum("t.turn").alias("turn"))
    marks = ladder.withColumn("turn", F.lit(0).cast("long")).unionByName(events, allowMissingColumns=True)
    sweep = Window.partitionBy("cur_id").orderBy("place", C("candidate").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    scored = (
        marks.withColumn("shared", F.sum("turn").over(sweep)).filter(C("candidate").isNotNull())
        .select("dependency_id", "cur_version", "candidate", (C("cur_n") - C("shared")).alias("cves_fixed"),
                (C("cand_n") - C("shared")).alias("cves_new"), (C("_k.major") > C("_ck.major")).alias("is_major_bump"))
    )
    used = current.select("project_id", "dependency_id", C("version").alias("cur_version")).distinct()
    bans = banned.select("project_id", "dependency_id", C("version").alias("candidate"), F.lit(True).alias("_b"))
    return (
        used.join(scored, ["dependency_id", "cur_version"])
        .join(bans, ["project_id", "dependency_id", "candidate"], "left")
        .withColumn("is_banned", F.coalesce(C("_b"), F.lit(False))).drop("_b")
    )
