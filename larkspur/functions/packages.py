"""Package identity: ecosystems, canonical names, package URLs and content keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ecosystem spellings and their canonical form.
ECOSYSTEM_ALIASES = {
    "npm": "npm", "pypi": "pypi", "pip": "pypi", "maven": "maven", "golang": "golang", "go": "golang",
    "rubygems": "rubygems", "gem": "rubygems", "composer": "composer", "packagist": "composer", "php": "composer",
    "cargo": "cargo", "rust": "cargo", "crates.io": "cargo", "nuget": "nuget", "csharp": "nuget", "dotnet": "nuget",
    ".net": "nuget", "github-actions": "github-actions", "github-action": "github-actions",
    "github actions": "github-actions", "vscode": "vscode",
}
# Package URL type of each canonical ecosystem.
PURL_TYPES = {
    "npm": "npm", "pypi": "pypi", "maven": "maven", "golang": "golang", "rubygems": "gem", "composer": "composer",
    "cargo": "cargo", "nuget": "nuget",
}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def canonical_ecosystem(raw: Column) -> Column:
    return F.try_element_at(literal_map(ECOSYSTEM_ALIASES), F.lower(F.coalesce(raw, F.lit(""))))


def canonical_name(name: Column, ecosystem: Column) -> Column:
    return (
        F.when(ecosystem == "pypi", F.regexp_replace(F.lower(name), "[-_.]+", "-"))
        .when(ecosystem.isin("npm", "nuget", "composer", "cargo", "vscode"), F.lower(name))
        .otherwise(name)
    )


def join_name(name: Column, ecosystem: Column) -> Column:
    """Name form of the loosest advisory join: trimmed lower case, with PyPI separators folded."""
    lower = F.lower(F.trim(name))
    return F.when(F.lower(ecosystem) == "pypi", F.regexp_replace(lower, "[-_.]+", "-")).otherwise(lower)


def build_purl(ecosystem: Column, name: Column, version: Column) -> Column:
    kind = F.try_element_at(literal_map(PURL_TYPES), canonical_ecosystem(ecosystem))
    body = F.when(kind == "maven", F.regexp_replace(name, "^([^:]*):", "$1/")).otherwise(name)
    suffix = F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("@"), version)).otherwise("")
    return F.when((name != "") & kind.isNotNull(), F.concat(F.lit("pkg:"), kind, F.lit("/"), body, suffix))


def parse_purl(purl: Column) -> Column:
    """(ecosystem, name, version, namespace) or null; Maven names come back as ``group:artifact``."""
    path = F.regexp_extract(purl, r"^pkg:([^?#]*)", 1)
    kind = F.substring_index(path, "/", 1)
    ecosystem = F.try_element_at(literal_map({v: k for k, v in PURL_TYPES.items()}), kind)
    rest = F.try_url_decode(F.regexp_replace(path.substr(F.length(kind) + 2, F.length(path)), r"\+", "%2B"))
    full = F.regexp_extract(rest, r"^(.*)@[^@]*$", 1)
    version = F.regexp_extract(rest, r"@([^@]*)$", 1)
    pieces = F.split(full, "/")
    two = F.size(pieces) == 2
    name = F.when((kind == "maven") & two, F.regexp_replace(full, "/", ":")).otherwise(full)
    namespace = F.when((kind == "maven") & two, pieces[0]).when((kind == "npm") & (F.size(pieces) > 1), pieces[0])
    good = purl.startswith("pkg:") & path.contains("/") & ecosystem.isNotNull() & F.contains(rest, F.lit("@"))
    return F.when(
        good,
        F.struct(ecosystem.alias("ecosystem"), name.alias("name"), version.alias("version"), namespace.alias("namespace")),
    )


def finding_key(*parts: Column) -> Column:
    """sha256 of the lower-cased parts joined by the unit separator; null parts count as empty."""
    filled = [F.lower(F.coalesce(p.cast("string"), F.lit(""))) for p in parts]
    return F.sha2(F.concat_ws("\x1f", *filled), 256)


def content_hash(**fields: Column) -> Column:
    """sha256 of the JSON object with its keys in order; nulls are written as null."""
    row = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def repo_path(path: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(path, "^﻿", ""), r"\\", "/")
    return F.lower(F.regexp_replace(p, "^/", ""))


def flow_signature(source: Column, source_line: Column, sink: Column, sink_line: Column, method: Column, osv: Column) -> Column:
    text = F.concat(
        repo_path(source), F.lit(":"), source_line.cast("string"), F.lit("|"),
        repo_path(sink), F.lit(":"), sink_line.cast("string"), F.lit("|"), method, F.lit("|"), F.coalesce(osv, F.lit("")),
    )
    return F.sha2(text, 256)


def alias_set(osv_id: Column, aliases: Column) -> Column:
    """Upper-cased own id plus every alias that looks like a CVE, without repeats."""
    cves = F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.upper(a).startswith("CVE-"))
    own = F.when(osv_id.isNotNull(), F.array(osv_id)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(own, cves), F.upper))


def full_alias_set(osv_id: Column, aliases: Column) -> Column:
    own = F.array(osv_id)
    return F.array_distinct(F.filter(F.concat(own, F.coalesce(aliases, F.array().cast("array<string>"))), lambda a: a.isNotNull()))
