"""Score formulas as column expressions.  All arithmetic is in doubles; rounding is half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.labels import any_of
from larkspur.functions.packages import literal_map

# Weights of the reachability levels, severity bases, detector weights.
LEVEL_WEIGHT = {"confirmed": 1.0, "data_flow": 0.9, "function": 0.7, "module": 0.5}
COMPOSE_WEIGHT = {**LEVEL_WEIGHT, "unreachable": 0.0}
SEVERITY_CVSS = {"critical": 9.0, "high": 7.0, "medium": 4.0, "low": 2.0}
DETECTOR_WEIGHT = {
    "AWS": 1.0, "GCP": 1.0, "Azure": 1.0, "PrivateKey": 1.0, "Stripe": 0.95, "GitHub": 0.9, "GitLab": 0.9,
    "Postgres": 0.85, "MySQL": 0.85, "MongoDB": 0.85, "Redis": 0.8, "SendGrid": 0.8, "Twilio": 0.8, "Mailgun": 0.8,
    "SlackWebhook": 0.7, "Slack": 0.7, "URI": 0.5,
}
HIGH_IMPACT_CWES = [
    "CWE-79", "CWE-89", "CWE-78", "CWE-94", "CWE-502", "CWE-918", "CWE-22", "CWE-611", "CWE-77", "CWE-74",
]
CONTAINER_BASE = {"CRITICAL": 90, "HIGH": 70, "MEDIUM": 50, "LOW": 30, "INFO": 10}
CONTAINER_UNREACHABLE = 0.4
ENTRY_WEIGHT = {"PUBLIC_UNAUTH": 1.0, "AUTH_INTERNAL": 0.5, "OFFLINE_WORKER": 0.2, "UNKNOWN": 1.0}
FLOW_BAND = {
    "sql_injection": 92, "command_injection": 92, "code_injection": 92, "deserialization": 92, "xss": 78, "ssrf": 78,
    "path_traversal": 78, "file_upload": 78, "prototype_pollution": 78, "auth_bypass": 78,
}
DAST_BASE = {"critical": 90, "high": 72, "medium": 48, "low": 26, "info": 10}
DAST_CONFIDENCE = {"confirmed": 10, "high": 6, "low": -12}
EPD_ALPHA = 0.85


def js_round(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def capped(x: Column) -> Column:
    """At most 100; a null score stays null (least and greatest skip nulls)."""
    return F.when(x.isNotNull(), F.least(F.lit(100), js_round(x))).cast("long")


def lookup(table: dict, key: Column, default=None) -> Column:
    found = F.try_element_at(literal_map(table), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def importance_weight(importance: Column) -> Column:
    """Importance between 0.5 and 2; 1 if there is none."""
    return F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.coalesce(importance, F.lit(1.0))))


def _base(cvss: Column, epss: Column, kev: Column, importance: Column) -> Column:
    """A null CVSS or EPSS counts as 0, the least that is known of it."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(cvss, F.lit(0.0))))
    e = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(epss, F.lit(0.0))))
    threat = F.when(kev, F.lit(1.2)).otherwise(F.lit(0.6) + F.lit(0.6) * F.sqrt(e))
    return c * 10.0 * threat * importance_weight(importance)


def _context(is_direct: Column, is_dev: Column, malicious: Column, package_score: Column) -> Column:
    direct = F.when(~is_direct, 0.75).otherwise(1.0)
    dev = F.when(is_dev, 0.4).otherwise(1.0)
    bad = F.when(malicious, 1.3).otherwise(1.0)
    reputation = F.when(package_score < 30, 1.15).when(package_score > 70, 0.95).otherwise(1.0)
    return direct * dev * bad * reputation


def reachability_weight(level: Column, reachable: Column) -> Column:
    return (
        F.when(level == "unreachable", F.lit(0.0))
        .when(F.coalesce(level, F.lit("")) != "", lookup(LEVEL_WEIGHT, level, 0.5))
        .when(~F.coalesce(reachable, F.lit(False)), F.lit(0.2))
        .otherwise(F.lit(1.0))
    )


def base_depscore(cvss, epss, kev, importance, is_direct, is_dev, malicious, package_score) -> Column:
    return capped(_base(cvss, epss, kev, importance) * _context(is_direct, is_dev, malicious, package_score))


def depscore(cvss, epss, kev, importance, is_direct, is_dev, malicious, package_score, level, reachable) -> Column:
    return capped(
        _base(cvss, epss, kev, importance)
        * reachability_weight(level, reachable)
        * _context(is_direct, is_dev, malicious, package_score)
    )


def dast_impact(vuln_type: Column) -> Column:
    t = F.lower(F.coalesce(vuln_type, F.lit("")))
    return (
        F.when(
            t.rlike(
                "sql injection|command injection|code injection|template injection|ldap injection|xpath|path traversal|"
                "remote os command|remote code|server side request|ssrf|xxe|xml external|deserial"
            ),
            "injection",
        )
        .when(
            t.rlike(
                r"cross site scripting|cross-site scripting|\bxss\b|cross site request|cross-site request|\bcsrf\b|"
                "open redirect"
            ),
            "xss",
        )
        .when(
            t.rlike(
                r"header|\bcache|cookie|\bcsp\b|content security policy|clickjack|x-powered-by|information disclosure|"
                "source code disclosure|strict-transport|spectre|site isolation|storable|cacheable|permissions policy|"
                "sec-fetch|mime|x-content-type|charset|timestamp|comment"
            ),
            "passive",
        )
        .otherwise("other")
    )


def dast_depscore(severity, confidence, vuln_type, exploitable, kev, unknown_base: int | None = None) -> Column:
    """Runtime finding score; an unknown severity gives null, or ``unknown_base`` where a summary needs a number."""
    base = lookup(DAST_BASE, F.lower(F.coalesce(severity, F.lit(""))), unknown_base)
    impact = dast_impact(vuln_type)
    raw = (
        base
        + lookup(DAST_CONFIDENCE, F.lower(F.coalesce(confidence, F.lit(""))), 0)
        + F.when(impact == "injection", 10).when(impact == "xss", 4).when(impact == "passive", -8).otherwise(0)
    )
    lifted = F.when(kev, F.greatest(raw, F.lit(96))).when(exploitable, F.greatest(raw, F.lit(90))).otherwise(raw)
    # greatest/least skip nulls, so an unknown severity is kept null explicitly
    return F.when(base.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), lifted)))


def secret_depscore(detector, verified, current, importance) -> Column:
    base = F.when(verified, 90.0).otherwise(60.0)
    return capped(
        base * lookup(DETECTOR_WEIGHT, detector, 0.6) * F.when(current, 1.0).otherwise(0.8) * importance_weight(importance)
    )


def semgrep_depscore(severity, cwe_ids, category, importance) -> Column:
    base = lookup({"ERROR": 70, "WARNING": 45, "INFO": 20}, F.upper(F.coalesce(severity, F.lit(""))), 30)
    hit = F.exists(cwe_ids, lambda c: any_of(c.startswith(p) for p in HIGH_IMPACT_CWES))
    boosted = base + F.when(hit, 15).otherwise(0) + F.when(category == "security", 5).otherwise(0)
    return capped(boosted * importance_weight(importance))


def license_depscore(reasons: Column, is_direct, is_dev, importance) -> Column:
    """Score of a blocked package from its reasons; malware wording wins over every licence wording."""
    t = F.lower(F.array_join(reasons, " "))
    base = (
        F.when(t.contains("malicious") | t.contains("malware"), 95)
        .when(t.contains("agpl"), 80)
        .when(t.contains("copyleft") | t.contains("gpl"), 70)
        .when(t.contains("banned") | t.contains("blocked"), 75)
        .when(t.contains("unknown") | t.contains("no license"), 50)
        .otherwise(55)
    )
    return capped(
        base * F.when(is_direct, 1.0).otherwise(0.75) * F.when(is_dev, 0.4).otherwise(1.0) * importance_weight(importance)
    )


def container_depscore(severity, level) -> Column:
    base = lookup(CONTAINER_BASE, F.upper(F.coalesce(severity, F.lit(""))))
    return F.when(level == "unreachable", js_round(base * CONTAINER_UNREACHABLE)).otherwise(base).cast("long")


def flow_depscore(vuln_class, length) -> Column:
    """Class score nudged by path length, never leaving the class band."""
    base = lookup(FLOW_BAND, F.lower(F.coalesce(vuln_class, F.lit(""))), 55)
    nudge = (
        F.when(length.isNull(), 0).when(length <= 2, 3).when(length <= 3, 2).when(length <= 4, 1).when(length <= 6, 0)
        .when(length <= 8, -1).when(length <= 11, -2).otherwise(-3)
    )
    low = F.when(base == 92, 90).when(base == 78, 70).otherwise(40)
    high = F.when(base == 92, 99).when(base == 78, 89).otherwise(69)
    return F.greatest(low, F.least(high, base + nudge)).cast("long")


def epd_factor(weight, depth, sanitized) -> Column:
    return F.when(sanitized, F.lit(0.0)).otherwise(weight * F.pow(F.lit(EPD_ALPHA), F.greatest(F.lit(0), depth)))


def entry_class(tag: Column) -> Column:
    """Exposure class of an entry point tag; explicit class words win over the other wording."""
    t = F.lower(F.coalesce(tag, F.lit("")))
    return (
        F.when(t.contains("public_unauth"), "PUBLIC_UNAUTH")
        .when(t.contains("auth_internal"), "AUTH_INTERNAL")
        .when(t.contains("offline_worker"), "OFFLINE_WORKER")
        .when(t.rlike("worker|cron|batch|queue"), "OFFLINE_WORKER")
        .when(t.rlike("framework-input|http|route|controller"), "PUBLIC_UNAUTH")
        .otherwise("AUTH_INTERNAL")
    )


def reputation_score(openssf, downloads, releases, slsa, malicious) -> Column:
    scorecard = F.when(openssf.isNull(), 11.0).otherwise((F.lit(10.0) - openssf) * 3.3)
    popularity = F.when(downloads.isNull(), 16.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(33.0), F.lit(34.0) - F.log10(downloads + 1.0) * 7.0))
    )
    upkeep = (
        F.when(releases.isNull(), 16.0).when(releases >= 12, 0.0).when(releases >= 6, 8.0).when(releases >= 3, 16.0)
        .when(releases >= 1, 24.0).otherwise(33.0)
    )
    provenance = F.when(slsa >= 3, 1.1).when(slsa >= 1, 1.05).otherwise(1.0)
    bad = F.when(malicious, 0.15).otherwise(1.0)
    score = js_round((F.lit(100.0) - scorecard - popularity - upkeep) * provenance * bad)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long")


# CVSS v3 base metric weights.
CVSS_AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
CVSS_AC = {"L": 0.77, "H": 0.44}
CVSS_UI = {"N": 0.85, "R": 0.62}
CVSS_PR = {"N": 0.85, "L": 0.62, "H": 0.27}
CVSS_PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}
CVSS_CIA = {"H": 0.56, "L": 0.22, "N": 0.0}


def cvss3_score(vector: Column) -> Column:
    """Base score of a v3.0/3.1 vector; null for other versions or when a base metric is missing."""
    v = F.upper(F.trim(vector))
    metrics = F.str_to_map(v, F.lit("/"), F.lit(":"))

    def metric(name: str) -> Column:
        return F.try_element_at(metrics, F.lit(name))

    changed = metric("S") == "C"
    av, ac, ui = lookup(CVSS_AV, metric("AV")), lookup(CVSS_AC, metric("AC")), lookup(CVSS_UI, metric("UI"))
    pr = F.when(changed, lookup(CVSS_PR_CHANGED, metric("PR"))).otherwise(lookup(CVSS_PR, metric("PR")))
    c, i, a = (lookup(CVSS_CIA, metric(m)) for m in ("C", "I", "A"))
    iss = 1.0 - (1.0 - c) * (1.0 - i) * (1.0 - a)
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss)
    exploit = 8.22 * av * ac * pr * ui
    raw = F.least(F.when(changed, 1.08 * (impact + exploit)).otherwise(impact + exploit), F.lit(10.0))
    scaled = js_round(raw * 100000)
    up = F.when(scaled % 10000 == 0, scaled / 100000.0).otherwise((F.floor(scaled / 10000) + 1) / 10.0)
    complete = metric("S").isin("U", "C") & (impact + exploit).isNotNull()
    return F.when(v.rlike(r"^CVSS:3\.[01]/") & complete, F.when(impact <= 0, F.lit(0.0)).otherwise(up))


def engine_confidence(hops, sink_pattern, sink_file) -> Column:
    score = (
        F.lit(1.0)
        - F.when(hops > 3, F.least(F.lit(0.4), (hops - 3) * 0.1)).otherwise(0.0)
        - F.when(sink_pattern.startswith("*."), 0.2).otherwise(0.0)
        - F.when(sink_file.contains("node_modules"), 0.1).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.99), score)), 2)
