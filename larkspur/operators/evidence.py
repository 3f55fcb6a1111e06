"""Reachability evidence and its use: flows, usages, routes, composition (JN8-JN11, JN13, JN32-JN37, AGG24-AGG26, AGG45, SCL28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import labels, packages, scores, text
from larkspur.operators.filters import RUN, active_run, row_number_at_most
from larkspur.session import written

C = F.col
#: Letters of a gram: the largest number that a needle has, else all of the needle.
GRAMS = (12, 8, 4)
#: Pairs of places and needles that one task should compare for a gram, most tasks for a gram, and most grams dealt so.
HOT_PAIRS, MOST_SALTS, MOST_HOT = 200_000, 1024, 1000
#: Call sites of a project that one task should take.
HOT_SITES = 2_000_000
# Runtime components that frameworks embed, and packages that frameworks load by convention.
EMBEDDED_RUNTIME = [
    "tomcat-embed", "jetty", "undertow", "netty", "spring-boot-starter-tomcat", "thymeleaf", "freemarker", "mustache",
    "pebble", "groovy-templates",
]
CONVENTION_RUNTIME = [
    "next", "react", "react-dom", "react-native", "vue", "nuxt", "@angular/core", "@angular/common",
    "@angular/platform-browser", "svelte", "@sveltejs/kit", "solid-js", "preact", "gatsby", "astro", "@remix-run/react",
]
DEV_SCOPES = ["dev", "development", "test", "build"]
EXPLICIT_IMPORT = ["composer", "pypi", "npm"]
# Call names too common to prove anything alone.
COMMON_CALLS = [
    "error", "warn", "warning", "info", "log", "debug", "get", "set", "run", "handle", "send", "render", "write",
    "read", "add", "remove", "execute", "call",
]
# PyPI distributions whose import name differs.
PYPI_IMPORTS = {
    "pillow": ["pil"], "pyyaml": ["yaml"], "beautifulsoup4": ["bs4"], "scikit-learn": ["sklearn"], "opencv-python": ["cv2"],
    "opencv-python-headless": ["cv2"], "python-dateutil": ["dateutil"], "python-dotenv": ["dotenv"], "python-jose": ["jose"],
    "python-multipart": ["multipart"], "pyjwt": ["jwt"], "pycryptodome": ["crypto", "cryptodome"], "pymysql": ["pymysql"],
    "psycopg2-binary": ["psycopg2"], "protobuf": ["google.protobuf"], "attrs": ["attr"], "ruamel.yaml": ["ruamel"],
}


def _spots(rows: DataFrame, column: str, size: Column) -> DataFrame:
    """(column, _gram, _at): every place of a text and the letters that follow there."""
    at = F.sequence(F.lit(1), F.length(column) - size + 1)
    return rows.filter(F.length(column) >= size).select(column, F.explode(F.transform(at, lambda i: F.struct(C(column).substr(i, size).alias("_gram"), i.alias("_at")))).alias("_g")).select(column, "_g._gram", "_g._at")


def filed_needles(words: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Needles, each under its rarest gram with the number of places of texts that have it, and the places of texts.

    A needle with a gram that no text has is in none and leaves.  Needles under four letters are their own gram, which
    texts only produce when such needles exist.  Longer needles have longer grams: of four letters there are too few to
    tell many texts and needles apart, and their pairs would grow with the product of both.
    """
    size = F.coalesce(*[F.when(F.length("needle") >= n, n) for n in GRAMS], F.length("needle"))
    # the gram lengths in use: those above, and the lengths of any shorter needles (at most six numbers)
    lengths = parts.agg(F.collect_set(size)).scalar()
    places = _spots(words.select("text", F.explode(lengths).alias("_n")), "text", C("_n"))
    common = places.groupBy("_gram").agg(F.count("*").alias("_df"))
    own = _spots(parts, "needle", size).join(common, "_gram", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    return row_number_at_most(own, ["needle"], [C("_df"), C("_gram"), C("_at")], 1).filter(C("_df") > 0), places


def found_pairs(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Distinct (text, needle) where the text contains the needle, of written distinct texts and needles.

    Equi joins on grams of 12, 8 or 4 letters.  A needle is filed under the gram of its that texts have least often, so
    endings and beginnings that many needles share do not bring them together; a gram tells the place at which the needle
    must stand, and only that place is compared.  Grams whose places and needles make many pairs are dealt over salts.
    """
    filed, places = filed_needles(texts, needles)
    filed = written(filed)
    pairs = filed.groupBy("_gram").agg((F.count("*") * F.first("_df")).alias("_pairs")).filter(C("_pairs") > HOT_PAIRS)
    salts = F.least(F.ceil(C("_pairs") / HOT_PAIRS), F.lit(MOST_SALTS)).cast("int").alias("salts")
    # the grams with most pairs, at most MOST_HOT of them; others stay whole
    hot = pairs.orderBy(C("_pairs").desc()).limit(MOST_HOT).agg(F.map_from_entries(F.collect_list(F.struct("_gram", salts)))).scalar()
    dealt = lambda rows: rows.withColumn("_salts", F.coalesce(F.try_element_at(hot, C("_gram")), F.lit(1)))
    keyed = dealt(filed.select("needle", "_gram", C("_at").alias("_from"))).withColumn("_salt", F.explode(F.sequence(F.lit(0), C("_salts") - 1))).drop("_salts")
    spread = dealt(places).withColumn("_salt", F.pmod(F.xxhash64("text", "_at"), C("_salts")).cast("int")).drop("_salts")
    start = C("_at") - C("_from") + 1
    return spread.join(keyed, ["_gram", "_salt"]).filter((start > 0) & (C("text").substr(start, F.length("needle")) == C("needle"))).select("text", "needle").distinct()


def contains_match(texts: DataFrame, needles: DataFrame, key: list[str]) -> DataFrame:
    """Distinct (key, text, needle) where the text contains the needle.

    The search runs once over the distinct texts and distinct needles of all keys; the matching pairs are then joined
    back to the keys that have both.
    """
    wanted = needles.select(*key, "needle").filter(F.length("needle") > 0).distinct()
    have = texts.select(*key, "text").filter(F.length("text") > 0).distinct()
    # several steps read the distinct texts and needles; they are written once
    found = found_pairs(written(have.select("text").distinct()), written(wanted.select("needle").distinct()))
    return have.join(found, "text").join(wanted, [*key, "needle"]).select(*key, "text", "needle")


def boundary_match(texts: DataFrame, needles: DataFrame, key: list[str]) -> DataFrame:
    """Distinct (key, text, needle) where the lower-case text has the needle with no letter or digit next to it.

    At such a place the needle's first run of letters and digits is a whole token of the text, so an equi join on the
    key and that token misses nothing; needles without letters and digits match nothing.
    """
    wanted = needles.select(*key, "needle").distinct().withColumn("_token", F.regexp_extract("needle", "[a-z0-9]+", 0)).filter(C("_token") != "")
    have = texts.select(*key, "text").distinct().withColumn("_token", F.explode(F.array_distinct(F.split("text", "[^a-z0-9]+"))))
    bounded = F.concat(F.lit(r"(?<![a-z0-9])\Q"), C("needle"), F.lit(r"\E(?![a-z0-9])"))
    return have.join(wanted, [*key, "_token"]).filter(F.contains(C("text"), C("needle")) & F.regexp_like(C("text"), bounded)).select(*key, "text", "needle")


def name_variants(name: Column) -> Column:
    """Spellings under which code may mention a package: name, dotted name, first part, import names, without ``py``."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    first = F.substring_index(lower, "-", 1)
    aliases = F.try_element_at(F.create_map(*[x for k, v in PYPI_IMPORTS.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))]), lower)
    stripped = F.when(lower.startswith("py") & (F.length(lower) > 3), lower.substr(F.lit(3), F.length(lower)))
    own = F.array(lower, F.regexp_replace(lower, "-", "."), F.when(F.length(first) > 3, first), stripped)
    return F.array_distinct(F.filter(F.concat(own, F.coalesce(aliases, F.array().cast("array<string>"))), lambda v: v.isNotNull() & (v != "")))


def usage_match(usages: DataFrame, deps: DataFrame) -> DataFrame:
    """Distinct (project, package row, file) where a call site mentions the package under any spelling.

    Distinct texts and spellings are searched once for all projects.  A site then travels with the spellings that its text
    has, a package with its own, both once, to their project; spellings are told apart there.  Projects with very many
    sites are dealt over salts by file, and their packages go to each.
    """
    words = F.filter(F.array(F.lower("target_type"), F.lower("resolved_method")), lambda t: t.isNotNull() & (t != ""))
    sites = written(usages.filter(C("file_path").isNotNull() & C("project_id").isNotNull()).select("project_id", "file_path", F.explode(F.array_distinct(words)).alias("text")))
    packages_of = written(deps.filter(C("project_id").isNotNull()).select("project_id", "project_dependency_id", "name"))
    spelt = packages_of.select("name").distinct().select(F.explode(name_variants(C("name"))).alias("needle")).distinct()
    found = found_pairs(written(sites.select("text").distinct()), written(spelt))
    # a text has as many spellings as it has parts
    by_text = found.groupBy("text").agg(F.collect_set("needle").alias("_needles"))
    large = sites.groupBy("project_id").agg(F.count("*").alias("_n")).filter(C("_n") > HOT_SITES)
    salts = F.least(F.ceil(C("_n") / HOT_SITES), F.lit(MOST_SALTS)).cast("int").alias("salts")
    hot = large.orderBy(C("_n").desc()).limit(MOST_HOT).agg(F.map_from_entries(F.collect_list(F.struct("project_id", salts)))).scalar()
    salted = F.coalesce(F.try_element_at(hot, C("project_id")), F.lit(1))
    mentions = sites.join(by_text.hint("merge"), "text").select("project_id", F.pmod(F.xxhash64("file_path"), salted).cast("int").alias("_salt"), "file_path", "_needles")
    offers = packages_of.select("project_id", "project_dependency_id", name_variants(C("name")).alias("_needles"), F.explode(F.sequence(F.lit(0), salted - 1)).alias("_salt"))
    place = ["project_id", "_salt"]
    rows = mentions.unionByName(offers, allowMissingColumns=True).repartition(*place).withColumn("needle", F.explode("_needles"))
    met = rows.groupBy(*place, "needle").agg(F.collect_set("file_path").alias("_files"), F.collect_set("project_dependency_id").alias("_packages"))
    met = met.filter((F.size("_files") > 0) & (F.size("_packages") > 0))
    pairs = met.select(*place, "_files", F.explode("_packages").alias("project_dependency_id")).select(*place, "project_dependency_id", F.explode("_files").alias("file_path"))
    return pairs.distinct().drop("_salt")


def import_counts(usages: DataFrame, deps: DataFrame) -> DataFrame:
    """Distinct importing files per direct package: npm keeps the larger of stored and found, others take the found
    number, and zero becomes null."""
    direct = deps.filter(C("is_direct"))
    counts = usage_match(usages, direct).groupBy("project_dependency_id").agg(F.count("*").alias("_n"))
    out = direct.join(counts, "project_dependency_id", "left")
    found = F.coalesce("_n", F.lit(0))
    npm = F.greatest(F.coalesce("files_importing_count", F.lit(0)), found)
    # an npm row whose stored count is unknown stays unknown when nothing is found
    kept = F.when(C("files_importing_count").isNull() & (found == 0), F.lit(None)).otherwise(npm)
    return out.withColumn("files_importing_count", F.when(C("ecosystem") == "npm", kept).when(found > 0, found)).drop("_n")


def flow_evidence(findings: DataFrame, flows: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Flow counts per finding: ``confirmed_flows`` (taint flow of one of its ids, not suppressed) and
    ``data_flow_flows`` (any flow of the package without an id or with one of its ids).

    Flows are counted per (project, run, package, id) before the join.
    """
    from larkspur.operators.runs import suppressed_flag

    taint = C("reachability_source").isin("semgrep_taint", "taint_engine") & C("osv_id").isNotNull()
    per_id = suppressed_flag(flows, suppressions).groupBy(*RUN, "dependency_id", "osv_id").agg(
        F.count("*").alias("_all"), F.count_if(taint & ~C("is_suppressed")).alias("_taint"))
    any_id = per_id.filter(C("osv_id").isNull()).select(*RUN, "dependency_id", C("_all").alias("_open"))
    mine = findings.select("finding_id", *RUN, "dependency_id", F.explode(packages.full_alias_set(C("osv_id"), C("aliases"))).alias("osv_id"))
    own = mine.join(per_id.filter(C("osv_id").isNotNull()), [*RUN, "dependency_id", "osv_id"]).groupBy("finding_id").agg(
        F.sum("_taint").alias("confirmed_flows"), F.sum("_all").alias("_own"))
    out = findings.join(own, "finding_id", "left").join(any_id, [*RUN, "dependency_id"], "left")
    return (
        out.withColumn("confirmed_flows", F.coalesce("confirmed_flows", F.lit(0)))
        .withColumn("data_flow_flows", F.coalesce("_own", F.lit(0)) + F.coalesce("_open", F.lit(0))).drop("_own", "_open")
    )


def symbol_match(findings: DataFrame, sinks: DataFrame, usages: DataFrame) -> DataFrame:
    """Per finding with a known vulnerable call: is one of its tokens part of any usage text of the project?

    Findings without a known call get null.
    """
    tokens = sinks.select("osv_id", F.explode(text.symbol_tokens(C("pattern"))).alias("needle")).distinct()
    ids = findings.select("finding_id", "project_id", F.explode(packages.full_alias_set(C("osv_id"), C("aliases"))).alias("osv_id"))
    asked = ids.join(tokens.hint("merge"), "osv_id").select("finding_id", "project_id", "needle").distinct()
    words = F.filter(F.array(F.lower("target_type"), F.lower("resolved_method")), lambda t: t.isNotNull() & (t != ""))
    sites = usages.select("project_id", F.explode(words).alias("text")).distinct()
    found = contains_match(sites, asked.select("project_id", "needle"), ["project_id"]).select("project_id", "needle").distinct().withColumn("_hit", F.lit(True))
    verdict = asked.join(found, ["project_id", "needle"], "left").groupBy("finding_id").agg(F.bool_or(F.coalesce("_hit", F.lit(False))).alias("symbol_hit"))
    return findings.join(verdict, "finding_id", "left")


def usage_strength(usages: DataFrame, deps: DataFrame) -> DataFrame:
    """Per package row that call sites mention: does any site prove more than a common call name?

    A mention has no letter or digit next to it.  A site is strong when its bare method is distinctive, or when the receiver carries a distinctive spelling of the
    package (four letters or more, not a common call name).
    """
    lower = F.lower(C("name"))
    first = F.substring_index(lower, "-", 1)
    spell = F.array_distinct(F.filter(F.array(lower, F.regexp_replace(lower, "-", "."), F.when(F.length(first) > 3, first)), lambda v: v.isNotNull() & (v != "")))
    variants = deps.select("project_id", "project_dependency_id", F.explode(spell).alias("needle"))
    bare = F.lower(F.element_at(F.split(F.concat(F.lit("."), F.coalesce("resolved_method", F.lit(""))), "[^A-Za-z0-9_$]+"), -1))
    distinct_call = (bare != "") & ~bare.isin(COMMON_CALLS)
    rows = usages.select("project_id", F.lower("target_type").alias("t"), F.lower("resolved_method").alias("m"), distinct_call.alias("strong"))
    sites = rows.select("project_id", "strong", F.explode(F.array(F.struct(C("t").alias("text"), F.lit(True).alias("receiver")), F.struct(C("m").alias("text"), F.lit(False).alias("receiver")))).alias("x"))
    sites = sites.select("project_id", "x.text", "x.receiver", "strong").filter(C("text").isNotNull()).groupBy("project_id", "text").agg(F.bool_or("receiver").alias("receiver"), F.bool_or("strong").alias("strong"))
    found = boundary_match(sites, variants, ["project_id"]).join(sites, ["project_id", "text"])
    good = C("strong") | (C("receiver") & (F.length("needle") >= 4) & ~C("needle").isin(COMMON_CALLS))
    per_needle = found.groupBy("project_id", "needle").agg(F.bool_or(good).alias("g"))
    return per_needle.join(variants, ["project_id", "needle"]).groupBy("project_dependency_id").agg(F.bool_or("g").alias("usage_strong")).withColumn("usage_seen", F.lit(True))


def is_dev(environment: Column) -> Column:
    return F.coalesce(F.lower(F.trim(environment)).isin(DEV_SCOPES), F.lit(False))


def is_framework_runtime(name: Column) -> Column:
    """Loaded by a framework without any import in the project's own code."""
    return F.lower(F.coalesce(name, F.lit(""))).isin(CONVENTION_RUNTIME) | labels.any_of(F.lower(F.coalesce(name, F.lit(""))).contains(p) for p in EMBEDDED_RUNTIME)


def reachability_level() -> Column:
    """Ladder over evidence columns.

    Expects confirmed_flows, data_flow_flows, environment, symbol_hit, usage_seen, usage_strong, usage_ran,
    files_importing_count, is_direct, ecosystem, name, graph_trusted, client_spa, transitive_of_reachable, call_reached.
    Without usage analysis or with an untrusted graph nothing becomes unreachable for want of imports.
    """
    true, false = F.lit(True), F.lit(False)
    dev = is_dev(C("environment"))
    imported = F.coalesce("files_importing_count", F.lit(0)) > 0
    ran = F.coalesce("usage_ran", false)
    orphan = (
        F.coalesce("graph_trusted", true) & ran & (~C("is_direct") | C("ecosystem").isin(EXPLICIT_IMPORT))
        & (C("files_importing_count") == 0) & ~is_framework_runtime(C("name"))
        & ~(F.coalesce("client_spa", false) & ~dev) & ~F.coalesce("call_reached", false)
    )
    return (
        F.when(C("confirmed_flows") > 0, "confirmed").when(C("data_flow_flows") > 0, "data_flow").when(dev, "unreachable")
        .when(C("symbol_hit"), "function").when((~C("symbol_hit")) & ran & imported, "unreachable")
        .when(F.coalesce("usage_strong", false), "function").when(F.coalesce("usage_seen", false), "module")
        .when(F.coalesce(orphan, false) & ~F.coalesce("transitive_of_reachable", false), "unreachable").otherwise("module")
    )


def trusted_graphs(bom_edges: DataFrame, root: str = "root") -> DataFrame:
    """(project_id, graph_trusted): projects whose bill of materials says what is direct; others are not listed."""
    return bom_edges.filter(C("parent") == root).select("project_id").distinct().withColumn("graph_trusted", F.lit(True))


def classify(findings, deps, projects, flows, suppressions, sinks, usages, edges, bom_edges, reached) -> DataFrame:
    """All evidence of the active run joined to its findings, with the resulting level in ``new_level``.

    ``bom_edges`` (project_id, parent, child) tells which projects' graphs are wired: in the others every package looks
    transitive, so nothing is called unreachable for want of imports and nothing is inherited.  ``reached`` (project_id,
    package in lower case) are the packages that the project's call graph enters: they are evidence of their own and
    pass on to what they depend on.
    """
    from larkspur.operators.graph import transitive_of_reachable

    rows = written(active_run(findings, projects))
    named = rows.select("project_dependency_id").distinct()
    calls = written(active_run(usages, projects).select("project_id", "target_type", "resolved_method"))
    rows = flow_evidence(rows, active_run(flows, projects), suppressions)
    rows = symbol_match(rows, sinks, calls)
    # one row a project, made from much larger tables: written, the planner knows their size
    ran = written(calls.select("project_id").distinct()).withColumn("usage_ran", F.lit(True))
    trusted = written(trusted_graphs(bom_edges))
    entered = reached.select("project_id", C("package").alias("_package"), F.lit(True).alias("call_reached")).distinct()
    meta = deps.select("project_id", "project_dependency_id", "name", "version_id", "environment", "is_direct", "ecosystem", "files_importing_count", F.lower("name").alias("_package"))
    meta = written(meta.join(entered, ["project_id", "_package"], "left").join(trusted, "project_id", "left").drop("_package").fillna(False, ["call_reached", "graph_trusted"]))
    # only packages with a finding have their call sites looked at
    own = written(meta.join(named, "project_dependency_id", "left_semi"))
    rows = rows.join(usage_strength(calls, own), "project_dependency_id", "left").join(ran, "project_id", "left")
    rows = rows.join(own.drop("project_id"), "project_dependency_id").join(projects.select("project_id", C("is_client_spa").alias("client_spa")), "project_id")
    explicit = C("ecosystem").isin(EXPLICIT_IMPORT)
    proof = (F.coalesce("files_importing_count", F.lit(0)) > 0) | is_framework_runtime(C("name")) | (C("is_direct") & ~explicit) | C("call_reached")
    wired = meta.filter("graph_trusted")
    evidence = wired.filter(~is_dev(C("environment")) & proof)
    via = transitive_of_reachable(wired, edges, evidence.select("project_id", "version_id")).select(
        "project_id", C("node").alias("version_id"), F.lit(True).alias("transitive_of_reachable"))
    return rows.join(via, ["project_id", "version_id"], "left").withColumn("new_level", reachability_level())


def route_match(requests: DataFrame, routes: DataFrame, key: list[str]) -> DataFrame:
    """First route (by route id) whose method and pattern fit a request of the same project.

    Equal patterns count once, and a distinct (method, path) only meets patterns of its segment count that have the same
    literal segments, at the places where the project's patterns have any; the pattern itself is tested on those pairs.
    A route without a method fits every method; one with a trailing wildcard fits every length.
    """
    path = text.url_path(C("endpoint_url"))
    asked = requests.select("finding_id", *key, F.upper("http_method").alias("_m"), path.alias("_path"))
    lookups = asked.select(*key, "_m", "_path").distinct().select(
        *key, "_m", "_path", F.explode(F.array(C("_m"), F.lit("*"))).alias("_method"), text.segment_count(C("_path")).alias("_n"))
    lookups = lookups.withColumn("_segments", F.explode(F.array(C("_n"), F.lit(-1))))
    star = C("route_pattern").rlike(r"/\*+$")
    targets = routes.filter(C("route_pattern").isNotNull()).select(
        *key, "route_id", F.coalesce(F.upper("http_method"), F.lit("*")).alias("_method"),
        F.when(star, -1).otherwise(text.segment_count(C("route_pattern"))).alias("_segments"), text.route_regex(C("route_pattern")).alias("_regex"),
        text.literal_places(C("route_pattern")).alias("_at"), text.segments_at(C("route_pattern"), text.literal_places(C("route_pattern"))).alias("_literal"))
    shape = [*key, "_method", "_segments"]
    targets = targets.groupBy(*shape, "_at", "_literal", "_regex").agg(F.min("route_id").alias("route_id"))
    placed = lookups.join(targets.select(*shape, "_at").distinct(), shape).withColumn("_literal", text.segments_at(C("_path"), C("_at")))
    hits = placed.join(targets, [*shape, "_at", "_literal"]).filter(F.regexp(C("_path"), C("_regex")))
    best = hits.groupBy(*key, "_m", "_path").agg(F.min("route_id").alias("route_id"))
    return asked.join(best, [*key, "_m", "_path"], "left").select("finding_id", *key, "route_id")


def cross_link(requests: DataFrame, routes: DataFrame, flows: DataFrame, findings: DataFrame, key: str = "project_id") -> DataFrame:
    """Request to route to first flow of the handler to the worst finding of the flow's package.

    The chain is followed once for each matched route; requests then look up their route, so a popular handler costs no more.
    ``match_method`` says how far the chain got: none, route_only, route_and_flow_no_vuln, route_flow_vuln.
    """
    matched = written(route_match(requests, routes, [key]))
    handlers = routes.select("route_id", C("file_path").alias("entry_point_file"), C("handler_name").alias("entry_point_method"))
    chosen = matched.filter(C("route_id").isNotNull()).select(key, "route_id").distinct().join(handlers, "route_id")
    first = F.min(F.struct("flow_id", "dependency_id"))
    # flows and findings of other handlers and projects leave before they are grouped
    mine = flows.withColumn(key, C("project_id")).join(chosen.select(key, "entry_point_file").distinct(), [key, "entry_point_file"], "left_semi")
    by_method = mine.groupBy(key, "entry_point_file", "entry_point_method").agg(first.alias("_fm"))
    by_file = mine.groupBy(key, "entry_point_file").agg(first.alias("_ff"))
    links = chosen.join(by_method, [key, "entry_point_file", "entry_point_method"], "left").join(by_file, [key, "entry_point_file"], "left")
    flow = F.when(C("entry_point_method").isNull(), C("_ff")).otherwise(C("_fm"))
    links = links.select(key, "route_id", flow["dependency_id"].alias("dependency_id"))
    hit = findings.withColumn(key, C("project_id")).join(chosen.select(key).distinct(), key, "left_semi")
    worst = hit.groupBy(key, "dependency_id").agg(
        F.min(F.struct((-labels.severity_rank(C("severity"))).alias("r"), C("osv_id").alias("o"))).alias("_w"), F.count("*").alias("_n"))
    rows = matched.join(links.join(worst, [key, "dependency_id"], "left"), [key, "route_id"], "left")
    method = (
        F.when(C("route_id").isNull(), "none").when(C("dependency_id").isNull(), "route_only")
        .when(C("_w").isNull(), "route_and_flow_no_vuln").otherwise("route_flow_vuln")
    )
    return rows.select("finding_id", key, "route_id", "dependency_id", C("_w.o").alias("linked_osv_id"), C("_n").alias("candidates"), method.alias("match_method"))


def _container_ids(container: DataFrame) -> DataFrame:
    """Container findings by (project, run, CVE) with their OS package and weight."""
    ids = F.array_distinct(F.array_compact(F.array(F.upper("cve_id"), F.upper("osv_id"))))
    return container.select(C("finding_id").alias("container_finding_id"), *RUN, F.lower("os_package_name").alias("_os"), F.explode(ids).alias("cve"),
                            F.when(C("reachability_level") == "unreachable", scores.CONTAINER_UNREACHABLE).otherwise(1.0).alias("container_mult"))


def _container_side(container: DataFrame, bindings: DataFrame) -> DataFrame:
    """Container findings by (project, run, CVE, library) with their weight."""
    os_names = bindings.filter(C("scope") == "os").select(F.lower("package_identifier").alias("_os"), "soname").distinct()
    return _container_ids(container).join(os_names, "_os").drop("_os")


def _code_side(findings: DataFrame) -> DataFrame:
    """Code findings that have a weight, by (project, run, CVE, package row)."""
    weight = scores.lookup(scores.COMPOSE_WEIGHT, C("reachability_level"))
    return findings.withColumn("code_mult", weight).filter(C("code_mult").isNotNull()).select(
        "finding_id", "project_dependency_id", *RUN, "code_mult", F.explode(packages.alias_set(C("osv_id"), C("aliases"))).alias("cve"))


def _libraries(deps: DataFrame, bindings: DataFrame) -> DataFrame:
    """(project_dependency_id, soname): native libraries that package rows bring along."""
    lang = bindings.filter(C("scope") == "language").select(F.lower("package_ecosystem").alias("_e"), F.lower("package_identifier").alias("_p"), "soname").distinct()
    named = deps.select("project_dependency_id", F.lower("ecosystem").alias("_e"), F.lower("name").alias("_p"))
    return named.join(lang, ["_e", "_p"]).select("project_dependency_id", "soname")


def compose_container(container: DataFrame, findings: DataFrame, deps: DataFrame, bindings: DataFrame) -> DataFrame:
    """Smallest composition factor per code finding that shares a CVE and a native library with a container finding.

    Both sides are exchanged once to their (project, run, CVE).  There the container side comes first in each library, and
    a code finding takes the smallest weight so far: no pair of findings is built.  Container findings travel with the
    list of their OS package's libraries.
    """
    key = [*RUN, "cve"]
    os_names = bindings.filter(C("scope") == "os").groupBy(F.lower("package_identifier").alias("_os")).agg(F.collect_set("soname").alias("sonames"))
    # few rows, made from much larger files: written, the planner knows their size
    left = _container_ids(container).join(written(os_names), "_os").select(*key, "container_mult", "sonames")
    right = _code_side(findings).join(_libraries(deps, bindings), "project_dependency_id").select(*key, "finding_id", "code_mult", F.array("soname").alias("sonames"))
    rows = left.unionByName(right, allowMissingColumns=True)
    for column in key:
        rows = rows.filter(C(column).isNotNull())
    rows = rows.repartition(*key).withColumn("soname", F.explode("sonames")).filter(C("soname").isNotNull())
    before = Window.partitionBy(*key, "soname").orderBy(C("code_mult").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    lowest = rows.withColumn("_least", F.min("container_mult").over(before)).filter(C("code_mult").isNotNull() & C("_least").isNotNull())
    return lowest.groupBy("finding_id").agg(F.min(F.round(C("_least") * C("code_mult"), 3)).alias("composition_factor"))


def composition_edges(container: DataFrame, findings: DataFrame, deps: DataFrame, bindings: DataFrame, evidence: int = 20) -> DataFrame:
    """Partner pairs with their factor and up to ``evidence`` shared libraries as proof."""
    left = _container_side(container, bindings)
    right = _code_side(findings).join(_libraries(deps, bindings), "project_dependency_id")
    pairs = left.join(right, [*RUN, "cve", "soname"]).select("container_finding_id", "finding_id", "container_mult", "code_mult", "soname").distinct()
    kept = row_number_at_most(pairs, ["container_finding_id", "finding_id"], [C("soname").asc()], evidence)
    return kept.groupBy("container_finding_id", "finding_id").agg(
        F.round(F.min(C("container_mult") * C("code_mult")), 3).alias("composition_factor"), F.array_sort(F.collect_list("soname")).alias("sonames"))


def min_factor(findings: DataFrame, factors: DataFrame) -> DataFrame:
    """Fold the smallest factor per finding into the contextual score; rows without a score stay as they are."""
    least = factors.groupBy("finding_id").agg(F.min("composition_factor").alias("composition_factor"))
    out = findings.join(least, "finding_id", "left")
    folded = F.round(C("contextual_depscore") * F.coalesce("composition_factor", F.lit(1.0)), 4)
    return out.withColumn("contextual_depscore", folded)


def transitive_veto(questions: DataFrame, imports: DataFrame) -> DataFrame:
    """Does a package other than the owners import the module or a module below it?

    Modules are expanded to all their ancestors, so prefix matching is an equi join.  The veto holds when more
    packages import the module than owners do, which needs two counts and no pairs.
    """
    parts = F.split(C("module"), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    users = imports.select("project_id", "package", F.explode(prefixes).alias("module")).distinct()
    total = users.groupBy("project_id", "module").agg(F.count("*").alias("_all"))
    asked = questions.select("project_id", "question_id", "module").distinct()
    owners = questions.select("project_id", "question_id", "module", C("owner").alias("package")).distinct()
    owned = owners.join(users, ["project_id", "module", "package"], "left_semi").groupBy("project_id", "question_id", "module").agg(F.count("*").alias("_own"))
    rows = asked.join(total, ["project_id", "module"], "left").join(owned, ["project_id", "question_id", "module"], "left")
    veto = F.coalesce("_all", F.lit(0)) > F.coalesce("_own", F.lit(0))
    return rows.groupBy("project_id", "question_id").agg(F.bool_or(veto).alias("veto"))


def os_package_loaded(findings: DataFrame, package_files: DataFrame, loaded: DataFrame) -> DataFrame:
    """Level of container findings: null when the package is unknown to the image, module when it owns a loaded
    library, else unreachable."""
    libs = loaded.select(C("soname").alias("basename")).distinct().withColumn("_l", F.lit(True))
    per = package_files.select(F.lower("package").alias("_p"), "basename").distinct().join(libs, "basename", "left").groupBy("_p").agg(
        F.bool_or(F.coalesce("_l", F.lit(False))).alias("_loaded"))
    out = findings.withColumn("_p", F.lower("os_package_name")).join(per, "_p", "left")
    return out.withColumn("reachability_level", F.when(C("_loaded"), "module").when(~C("_loaded"), "unreachable")).drop("_p", "_loaded")


LINE_BUCKET = 64


def route_of_flow(flows: DataFrame, routes: DataFrame, key: str = "project_id") -> DataFrame:
    """Exposure tag of the handler whose line span holds the flow's source.

    A public handler wins; an unknown one makes the flow unmatched; otherwise the most exposed class counts.  The
    narrowest span is reported as context.  Spans are cut into line buckets, which turns the interval join into an
    equi join with a residual test.
    """
    spans = routes.select(
        C(key).alias("_k"), C("file_path").alias("_f"), "route_id", "classification", C("line_number").alias("_lo"), C("end_line").alias("_hi"),
        F.explode(F.sequence(F.floor(C("line_number") / LINE_BUCKET), F.floor(C("end_line") / LINE_BUCKET))).alias("_b"))
    points = flows.select(C("project_id").alias("_k"), C("entry_point_file").alias("_f"), C("entry_point_line").alias("_line")).distinct().withColumn("_b", F.floor(C("_line") / LINE_BUCKET))
    inside = points.join(spans, ["_k", "_f", "_b"]).filter(C("_line").between(C("_lo"), C("_hi")))
    cls = C("classification")
    tag = (
        F.when(F.bool_or(cls == "PUBLIC_UNAUTH"), "framework-route:public_unauth")
        .when(F.bool_or(F.coalesce(~cls.isin("AUTH_INTERNAL", "OFFLINE_WORKER"), F.lit(True))), "framework-input:unmatched")
        .when(F.bool_or(cls == "AUTH_INTERNAL"), "framework-route:auth_internal").otherwise("framework-route:offline_worker")
    )
    verdict = inside.groupBy("_k", "_f", "_line").agg(tag.alias("_tag"), F.min_by("route_id", F.struct((C("_hi") - C("_lo")).alias("w"), "route_id")).alias("context_route_id"))
    out = flows.join(verdict, (C("project_id") == C("_k")) & (C("entry_point_file") == C("_f")) & (C("entry_point_line") == C("_line")), "left")
    return out.withColumn("stamp_tag", F.coalesce("_tag", F.lit("framework-input:unmatched"))).drop("_k", "_f", "_line", "_tag")


def malware_reachability(rows: DataFrame, imports: DataFrame, usages: DataFrame, sites: int = 5) -> DataFrame:
    """How far code uses a suspicious package: unimported, imported_unused, module (reads only) or function.

    The first ``sites`` invocations, by file and line, are listed.
    """
    key = ["project_id", "dependency_name"]
    wanted = rows.select(*key).distinct()
    imported = imports.join(wanted, key, "left_semi").select(*key).distinct().withColumn("_i", F.lit(True))
    mine = usages.join(wanted, key, "left_semi")
    kinds = mine.groupBy(*key).agg(F.bool_or(C("usage_kind") != "member").alias("_called"))
    calls = mine.filter(C("usage_kind") != "member").select(*key, "file_path", "line_number", "containing_method").distinct()
    order = [C("file_path").asc(), C("line_number").asc(), C("containing_method").asc_nulls_first()]
    first = row_number_at_most(calls, key, order, sites)
    where = F.concat(C("file_path"), F.lit(":"), C("line_number").cast("string"), F.coalesce(F.concat(F.lit(" ("), C("containing_method"), F.lit(")")), F.lit("")))
    chain = first.groupBy(*key).agg(F.array_sort(F.collect_list(where)).alias("call_chain"))
    out = rows.join(imported, key, "left").join(kinds, key, "left").join(chain, key, "left")
    level = F.when(C("_i").isNull(), "unimported").when(C("_called").isNull(), "imported_unused").when(C("_called"), "function").otherwise("module")
    return out.withColumn("level", level).withColumn("call_chain", F.when(C("level") == "function", C("call_chain"))).drop("_i", "_called")


ENDPOINT_RANK = {"PUBLIC_UNAUTH": 3, "AUTH_INTERNAL": 2, "OFFLINE_WORKER": 1, "UNKNOWN": 0}
VOTE_CONFIDENCE = 0.75


def epd_aggregate(flows: DataFrame, base: DataFrame, key: list[str], order: str = "flow_id") -> DataFrame:
    """Execution-path verdict per key from its flows' votes.

    Needs flow_length, is_suppressed, ai_error, is_sanitized, confidence, endpoint_class, entry_point_tag per flow
    and base_depscore, reachability_level, is_reachable per key.
    """
    rank = lambda c: scores.lookup(ENDPOINT_RANK, c)
    usable = ~C("is_suppressed") & ~C("ai_error")
    sure = F.coalesce(C("confidence") >= VOTE_CONFIDENCE, F.lit(False)) & C("endpoint_class").isNotNull()
    token = F.upper(F.regexp_extract("entry_point_tag", "^framework-route:(.*)$", 1))
    evidence = F.when(token.isin("AUTH_INTERNAL", "OFFLINE_WORKER", "PUBLIC_UNAUTH"), rank(token))
    vote = F.when(usable, F.greatest(F.when(sure, rank(C("endpoint_class"))), evidence))
    last = F.max_by(F.struct(
        F.coalesce("endpoint_class", F.lit("OFFLINE_WORKER")).alias("cls"),
        F.when(C("confidence").isNull(), True).otherwise(F.coalesce("is_sanitized", F.lit(True))).alias("clean")), C(order))
    votes = flows.groupBy(*key).agg(
        F.count("*").alias("flows_considered"), F.count(vote).alias("flows_aggregated"), F.max(vote).alias("_worst"),
        F.min(F.greatest(F.lit(1), F.coalesce("flow_length", F.lit(1)))).alias("_len"),
        F.count_if(usable & sure).alias("_voters"), F.bool_and(F.when(usable & sure, F.coalesce("is_sanitized", F.lit(False)))).alias("_clean"),
        F.bool_and("is_suppressed").alias("_all_off"), last.alias("_last"))
    rows = base.join(votes, key, "left")
    none = F.coalesce("flows_considered", F.lit(0)) == 0
    level = C("reachability_level")
    depth = F.when(none, F.when(level.isin("data_flow", "confirmed"), 2).when(level == "function", 3).when(level == "module", 4).otherwise(1)).otherwise(C("_len") - 1)
    status = F.when(none, "no_flows_evaluated").when(C("flows_aggregated") > 0, "flow_aggregated").when(C("_all_off"), "all_flows_suppressed").otherwise("no_flows_evaluated")
    named = F.when(C("_worst") == 3, "PUBLIC_UNAUTH").when(C("_worst") == 2, "AUTH_INTERNAL").when(C("_worst") == 1, "OFFLINE_WORKER").otherwise("UNKNOWN")
    cls = F.when(status == "flow_aggregated", named).when(status == "all_flows_suppressed", C("_last.cls")).otherwise("UNKNOWN")
    clean = F.when(status == "flow_aggregated", (C("_voters") > 0) & C("_clean")).when(status == "all_flows_suppressed", C("_last.clean")).otherwise(False)
    reachable = ~((level == "unreachable") | F.coalesce(~C("is_reachable"), F.lit(False))) & (level.isin("data_flow", "function", "module", "confirmed") | F.coalesce("is_reachable", F.lit(False)))
    reachable = F.coalesce(reachable, F.coalesce("is_reachable", F.lit(False)))
    factor = F.when(reachable, scores.epd_factor(scores.lookup(scores.ENTRY_WEIGHT, cls), depth, clean)).otherwise(0.0)
    return rows.select(
        *key, depth.cast("long").alias("epd_depth"), cls.alias("entry_point_classification"), F.coalesce(clean, F.lit(False)).alias("is_sanitized"), status.alias("epd_status"),
        F.round(factor, 6).alias("epd_factor"), F.round(C("base_depscore") * factor, 4).alias("contextual_depscore"),
        F.coalesce("flows_considered", F.lit(0)).alias("flows_considered"), F.coalesce("flows_aggregated", F.lit(0)).alias("flows_aggregated"))


def flow_ids(findings: DataFrame, advisories: DataFrame, key: list[str]) -> DataFrame:
    """Distinct ids under which a vulnerability of a project may be known: its own, its aliases, its advisory's aliases."""
    own = findings.select(*key, "osv_id", F.explode(packages.full_alias_set(C("osv_id"), C("aliases"))).alias("flow_osv_id"))
    extra = findings.select(*key, "osv_id").distinct().join(
        advisories.select("osv_id", F.explode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("flow_osv_id")).hint("merge"), "osv_id")
    return own.unionByName(extra).distinct()


def affected_packages(findings: DataFrame, projects: DataFrame, deps: DataFrame) -> DataFrame:
    """Live package rows that findings of the active runs name; written once, as several sections of a detail read them."""
    named = active_run(findings, projects).select("project_dependency_id").distinct()
    columns = ["project_id", "project_dependency_id", "dependency_id", "name", "version", "is_direct", "environment", "files_importing_count", "removed_at"]
    return written(deps.filter(C("removed_at").isNull()).select(columns).join(named, "project_dependency_id", "left_semi"))


def finding_detail(findings, deps, catalog, projects, events, advisories, flows, suppressions, files, candidates, *, n_events: int = 50, n_flows: int = 20) -> DataFrame:
    """Everything about each (project, vulnerability) of the active runs, in long form with one JSON payload per row.

    Sections: importance, vulnerability, dependency, file (of a dependency), candidate (version of a dependency), event
    (newest 50), advisory (own id before alias), flow (shortest 20 with suppressed flag).  ``files`` has
    (project_dependency_id, file_path), ``candidates`` the rows of ``version_candidates``.  Rows instead of one nested
    document keep a vulnerability with many packages splittable.  What several sections read is written once.
    """
    from larkspur.operators.runs import suppressed_flag

    key = ["project_id", "osv_id"]
    rows = written(active_run(findings, projects).select(*key, "finding_id", "aliases", "project_dependency_id", "severity", "depscore", "reachability_level", "status"))
    wanted = rows.select(*key).distinct()

    def section(df: DataFrame, name: str, item: Column, *columns: str | Column) -> DataFrame:
        return df.select(*key, F.lit(name).alias("section"), item.cast("string").alias("item"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("payload"))

    weight = section(wanted.join(projects.select("project_id", "importance"), "project_id"), "importance", C("project_id"), "importance")
    vulns = section(rows, "vulnerability", C("finding_id"), "severity", "depscore", "reachability_level", "status")
    live = deps.filter(C("removed_at").isNull()).join(catalog.select("dependency_id", F.coalesce("score", F.lit(0)).alias("package_score")), "dependency_id", "left")
    parts = ["dependency_id", "name", "version", "is_direct", "environment", "files_importing_count", "package_score"]
    used = written(rows.select(*key, "project_dependency_id").distinct().join(live.select("project_dependency_id", *parts), "project_dependency_id"))
    affected = section(used, "dependency", C("project_dependency_id"), *parts[1:])
    paths_of = section(used.join(files.select("project_dependency_id", "file_path").distinct(), "project_dependency_id"), "file", F.concat_ws("|", "project_dependency_id", "file_path"), "file_path")
    ladder = used.select(*key, "dependency_id", C("version").alias("cur_version")).distinct().join(candidates, ["project_id", "dependency_id", "cur_version"])
    upgrades = section(ladder, "candidate", F.concat_ws("|", C("dependency_id").cast("string"), "cur_version", "candidate"), "cves_fixed", "cves_new", "is_major_bump", "is_banned")
    at = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    named = events.join(wanted, key, "left_semi").withColumn("item", F.sha2(F.concat_ws("|", "event_type", "project_dependency_id", at), 256))
    log = row_number_at_most(named, key, [C("created_at").desc(), C("item").asc()], n_events)
    timeline = section(log, "event", C("item"), "event_type", at.alias("created_at"))
    own = advisories.select("osv_id", F.struct(F.lit(0).alias("rank"), C("advisory_id").alias("id")).alias("a"), "severity")
    by_alias = advisories.select(F.explode("aliases").alias("osv_id"), F.struct(F.lit(1).alias("rank"), C("advisory_id").alias("id")).alias("a"), "severity")
    best = row_number_at_most(own.unionByName(by_alias), ["osv_id"], [C("a")], 1).select("osv_id", C("a.id").alias("advisory_id"), C("severity").alias("advisory_severity"))
    advice = section(wanted.join(best.hint("merge"), "osv_id"), "advisory", C("advisory_id"), "advisory_id", C("advisory_severity").alias("severity"))
    ids = flow_ids(rows, advisories, ["project_id"])
    packages_of = used.select("project_id", "osv_id", "dependency_id").distinct()
    mine = suppressed_flag(active_run(flows, projects), suppressions).withColumnRenamed("osv_id", "flow_osv_id")
    linked = mine.join(ids, ["project_id", "flow_osv_id"]).join(packages_of, ["project_id", "osv_id", "dependency_id"], "left_semi")
    shortest = row_number_at_most(linked, key, [C("flow_length").asc_nulls_last(), C("flow_id").asc()], n_flows)
    paths = section(shortest, "flow", C("flow_id"), "flow_length", "entry_point_file", "sink_method", "is_suppressed")
    out = weight
    for part in (vulns, affected, paths_of, upgrades, timeline, advice, paths):
        out = out.unionByName(part)
    return out


def license_obligations(deps: DataFrame, catalog: DataFrame, obligations: DataFrame) -> DataFrame:
    """Live packages per project and licence with the obligations of the licence; a missing licence is Unknown."""
    live = deps.filter(C("removed_at").isNull()).join(catalog.select("dependency_id", "license"), "dependency_id", "left")
    groups = live.groupBy("project_id", F.coalesce("license", F.lit("Unknown")).alias("license")).agg(F.count("*").alias("packages"))
    return groups.join(obligations.withColumnRenamed("license_spdx_id", "license"), "license", "left")


def capability_or(files: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """OR of the capability flags over all files of a package."""
    flags = text.capability_flags(C(column))
    return files.groupBy(*key).agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
