"""Readers of reports and feeds (SRC*).  Every reader takes a path or folder and declares its schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import schemas
from larkspur.functions import packages, scores, text
from larkspur.functions.labels import is_vendored, severity_band, severity_norm

C = F.col


def read_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """Typed Parquet read of one table; Spark prunes columns and pushes filters into it."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    """JSON documents with the file they came from; ``multi_line`` for one document per file."""
    return spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path).withColumn("document", C("_metadata.file_path"))


def read_sbom(spark: SparkSession, path: str, *, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, edges, roots) of bills of materials.

    A component's name and version fall back to its package URL, a leading ``v`` before a digit is dropped except
    for Go, and components without name or version are left out.  ``document`` identifies the bill: its file, or
    file and root when a file holds one bill per line.  Edges of the root itself are marked ``from_root``, so that direct
    packages are found without a join to ``roots``.
    """
    docs = read_json(spark, path, schemas.SBOM, multi_line).withColumn("root", C("metadata.component.`bom-ref`"))
    if not multi_line:
        docs = docs.withColumn("document", F.concat_ws("#", "document", "root"))
    roots = docs.filter(C("root").isNotNull()).select("document", "root").distinct()
    parts = docs.select("document", "root", F.explode("components").alias("c"))
    purl = C("c.purl")
    kind = F.regexp_extract(purl, "^pkg:([^/]+)/", 1)
    url_name = F.try_url_decode(F.regexp_extract(purl, r"^pkg:[^/]+/([^@?#]+)", 1))
    url_version = F.try_url_decode(F.regexp_extract(purl, r"@([^?#]+)", 1))
    version = F.coalesce("c.version", F.when(url_version != "", url_version))
    version = F.when(purl.isNull() | (F.lower(kind) == "golang"), version).otherwise(F.regexp_replace(version, "^[vV](?=[0-9])", ""))
    namespace = F.coalesce("c.group", F.when(url_name.contains("/"), F.regexp_extract(url_name, "^(.*)/[^/]*$", 1)))
    first_license = F.try_element_at("c.licenses", F.lit(1))["license"]
    components = parts.select(
        "document", C("c.`bom-ref`").alias("component"), F.coalesce("c.name", F.when(url_name != "", url_name)).alias("name"), version.alias("version"),
        namespace.alias("namespace"), F.coalesce(first_license["id"], first_license["name"]).alias("license"), purl.alias("purl"),
        F.coalesce(C("c.`bom-ref`") == C("root"), F.lit(False)).alias("is_root"),
    ).filter(~C("is_root") & C("component").isNotNull() & (C("name") != "") & (C("version") != ""))
    links = docs.select("document", "root", F.explode("dependencies").alias("d"))
    from_root = F.coalesce(C("d.ref") == C("root"), F.lit(False)).alias("from_root")
    edges = links.select("document", C("d.ref").alias("parent"), from_root, F.explode("d.dependsOn").alias("child")).distinct()
    return components, edges, roots


def read_osv_feed(spark: SparkSession, path: str, *, malware_only: bool = False, multi_line: bool = True) -> DataFrame:
    """One row per (advisory, affected package) with its ordered intervals, listed versions and severity.

    Several introduced/fixed pairs of one range stay separate intervals.
    """
    docs = read_json(spark, path, schemas.OSV, multi_line)
    if malware_only:
        docs = docs.filter(C("id").startswith("MAL-"))
    vector = F.filter(F.transform(C("severity"), lambda s: scores.cvss3_score(s["score"])), lambda x: x.isNotNull())
    score = F.try_element_at(vector, F.lit(1))
    word = C("database_specific.severity")
    known = F.lower(F.trim(word)).isin("low", "moderate", "medium", "high", "critical")
    rows = docs.select("id", "aliases", "published", "withdrawn", F.when(known, severity_norm(word)).otherwise(severity_band(score)).alias("severity"), score.alias("cvss_score"), F.explode_outer("affected").alias("a"))

    def intervals(events: Column) -> Column:
        # an interval runs from an introduced event to the next event, if that is a fix
        numbered = F.transform(events, lambda e, i: F.struct(e["introduced"].alias("introduced"), F.get(events, i + 1)["fixed"].alias("next_fixed"), e["fixed"].alias("own_fixed")))
        starts = F.filter(numbered, lambda e: e["introduced"].isNotNull())
        return F.transform(starts, lambda e: F.struct(e["introduced"].alias("introduced"), F.coalesce(e["own_fixed"], e["next_fixed"]).alias("fixed")))

    ranges = F.flatten(F.transform(F.coalesce("a.ranges", F.array().cast("array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>")), lambda r: intervals(r["events"])))
    return rows.select(
        C("id").alias("osv_id"), "aliases", "severity", "cvss_score", "published", "withdrawn", packages.canonical_ecosystem(C("a.package.ecosystem")).alias("ecosystem"),
        C("a.package.name").alias("package_name"), ranges.alias("ranges"), C("a.versions").alias("versions"),
        (C("a.ranges").isNull() & C("a.versions").isNull()).alias("ranges_missing"),
    )


def read_vdr(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Normalized hits of vulnerability reports in either shape.

    A report is of the CycloneDX kind when its first vulnerability has ``affects``; then there is one row per
    affected reference, else one row per vulnerability.
    """
    docs = read_json(spark, path, schemas.VDR, multi_line)
    cyclone = F.try_element_at("vulnerabilities", F.lit(1))["affects"].isNotNull()
    rows = docs.select("document", cyclone.alias("_c"), F.explode("vulnerabilities").alias("v"))
    rating = F.try_element_at("v.ratings", F.lit(1))
    severity = F.coalesce(F.when(~C("_c"), C("v.severity")), rating["severity"])
    bucket = scores.lookup(scores.SEVERITY_CVSS, severity)

    def prop(*names: str) -> Column:
        return F.try_element_at(F.filter(C("v.properties"), lambda p: p["name"].isin(*names)), F.lit(1))["value"]

    fixed = F.array_distinct(F.transform(
        F.filter(F.flatten(F.transform("v.affects", lambda a: F.coalesce(a["versions"], F.array().cast("array<struct<version:string,status:string>>")))), lambda x: (x["status"] == "unaffected") & x["version"].isNotNull()),
        lambda x: x["version"]))
    new = rows.filter("_c").select("document", "v", rating.alias("r"), severity.alias("severity"), bucket.alias("bucket"), fixed.alias("fixed"), F.explode("v.affects").alias("a"), prop("depscan:insights").alias("insight"), prop("depscan:epss", "epss").alias("epss"))
    parsed = packages.parse_purl(C("a.ref"))
    new = new.withColumn("p", parsed).filter(C("p").isNotNull()).select(
        "document", F.coalesce("v.id", F.lit("unknown")).alias("osv_id"), C("p.name").alias("ref_name"), C("p.version").alias("version"), C("p.ecosystem").alias("ecosystem"), "severity",
        F.coalesce("r.score", "bucket").alias("cvss_score"), C("epss").try_cast("double").alias("epss_score"), F.when(F.size("fixed") > 0, C("fixed")).alias("fixed_versions"),
        C("v.aliases").alias("aliases"), F.coalesce(C("insight").startswith("Used in"), F.lit(False)).alias("is_reachable"))
    old = rows.filter(~F.coalesce("_c", F.lit(False))).select(
        "document", F.coalesce("v.vuln_id", "v.id", F.lit("unknown")).alias("osv_id"), F.trim("v.component").alias("ref_name"), F.trim("v.version").alias("version"), F.lit(None).cast("string").alias("ecosystem"), severity.alias("severity"),
        bucket.alias("cvss_score"), C("v.epss").alias("epss_score"), F.when(C("v.fixed_version").isNotNull(), F.array("v.fixed_version")).alias("fixed_versions"), C("v.aliases").alias("aliases"), F.lit(True).alias("is_reachable"))
    return new.unionByName(old)


def read_flow_slices(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """One flow row per (slice of two or more nodes, package URL): first node is the entry, last the sink."""
    docs = read_json(spark, path, schemas.FLOW_SLICES, multi_line).filter((F.size("flows") >= 2) & (F.size("purls") > 0))
    first, last = F.element_at("flows", 1), F.element_at("flows", -1)
    return docs.select("document", first.alias("f"), last.alias("l"), F.size("flows").cast("long").alias("flow_length"), F.explode("purls").alias("purl")).filter(C("purl") != "").select(
        "document", "purl", C("f.parentFileName").alias("entry_point_file"), C("f.parentMethodName").alias("entry_point_method"), C("f.lineNumber").alias("entry_point_line"),
        F.when(C("f.tags") != "", C("f.tags")).alias("entry_point_tag"), C("l.parentFileName").alias("sink_file"), F.coalesce(F.when(C("l.fullName") != "", C("l.fullName")), F.when(C("l.name") != "", C("l.name"))).alias("sink_method"),
        C("l.lineNumber").alias("sink_line"), F.coalesce("l.isExternal", F.lit(True)).alias("sink_is_external"), "flow_length")


def read_usage_slices(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """One row per call site of object slices and user-defined types; sites without file or line are dropped."""
    docs = read_json(spark, path, schemas.USAGE_SLICES, multi_line)
    objects = docs.select("document", F.explode("objectSlices").alias("o")).select("document", "o", F.explode("o.usages").alias("u")).filter(C("u.targetObj").isNotNull()).select(
        "document", C("o.fileName").alias("file_path"), F.coalesce("u.targetObj.lineNumber", "o.lineNumber", F.lit(0)).alias("line_number"), C("o.fullName").alias("containing_method"),
        F.coalesce("u.targetObj.name", F.lit("unknown")).alias("target_name"), C("u.targetObj.typeFullName").alias("target_type"), F.try_element_at("u.invokedCalls", F.lit(1))["resolvedMethod"].alias("resolved_method"), C("u.targetObj.label").alias("usage_label"),
    ).filter(C("file_path").isNotNull() & (C("line_number") > 0))
    types = docs.select("document", F.explode("userDefinedTypes").alias("t")).select("document", "t", F.explode("t.procedures").alias("p")).filter((C("p.callName") != "") & (C("p.lineNumber") > 0)).select(
        "document", F.coalesce("t.fileName", F.lit("unknown")).alias("file_path"), C("p.lineNumber").alias("line_number"), F.lit(None).cast("string").alias("containing_method"), C("p.callName").alias("target_name"), C("t.name").alias("target_type"),
        F.concat(F.coalesce("t.name", F.lit("")), F.lit("."), C("p.callName")).alias("resolved_method"), F.lit("userDefinedType").alias("usage_label"))
    return objects.unionByName(types)


def read_secret_report(spark: SparkSession, path: str, *, workspace: str = "") -> DataFrame:
    """Detector hits of newline JSON: redacted, own files only, weak unverified hits dropped, one per place.

    Of several hits at one place the verified one with the greatest value hash stays.
    """
    from larkspur.operators.runs import dedup

    docs = read_json(spark, path, schemas.SECRETS, False)
    data = C("SourceMetadata.Data")
    file = F.coalesce(data["Filesystem"]["file"], data["Git"]["file"], F.lit("unknown"))
    rows = docs.select(
        "document", F.coalesce("DetectorName", F.lit("Unknown")).alias("detector_type"), F.regexp_replace(file, F.lit("^" + workspace) if workspace else F.lit("^$"), F.lit("")).alias("file_path"),
        F.coalesce(data["Filesystem"]["line"], data["Git"]["line"]).alias("start_line"), F.coalesce("Verified", F.lit(False)).alias("is_verified"), data["Filesystem"].isNotNull().alias("is_current"),
        text.redact(C("Raw")).alias("redacted_value"), F.sha2(F.coalesce("Raw", F.lit("")), 256).alias("value_hash"), F.coalesce("Raw", F.lit("")).alias("_raw"))
    weak = (F.lower("detector_type") == "gitlab") & ~C("is_verified") & ~C("_raw").startswith("glpat-")
    kept = rows.filter(~weak & ((C("detector_type") != "Unknown") | (C("file_path") != "unknown")) & ~C("file_path").rlike(r"^\.git[/\\]") & ~is_vendored(C("file_path"))).drop("_raw")
    return dedup(kept, ["document", "detector_type", "file_path", "start_line"], ["is_verified", "value_hash"])


def read_kev(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    docs = read_json(spark, path, schemas.KEV, multi_line)
    return docs.select(F.explode("vulnerabilities.cveID").alias("cve_id")).filter(C("cve_id") != "").distinct()


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    """Probability table as CSV with a header and optional comment lines; unparsable scores are dropped."""
    rows = spark.read.schema("cve string, epss string, percentile string").option("header", "true").option("comment", "#").csv(path)
    return rows.select(C("cve").alias("cve_id"), C("epss").try_cast("double").alias("epss")).filter(C("epss").isNotNull())
