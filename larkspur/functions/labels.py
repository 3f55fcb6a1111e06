"""Severity, reachability and status labels, ranks and decision tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.packages import literal_map

# Ranks.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
REACHABILITY_RANK = {"confirmed": 4, "data_flow": 3, "function": 2, "module": 1}
# Infrastructure rules that always count, and rules that never do.
IAC_ALWAYS = [
    "CKV_K8S_16", "CKV_K8S_20", "CKV_K8S_23", "CKV_K8S_19", "CKV_K8S_17", "CKV_K8S_18",
    "KSV-0023", "KSV023", "AVD-KSV-0023", "KSV-0121",
]
IAC_NEVER = [
    "CKV_K8S_38", "CKV_K8S_28", "CKV_K8S_37", "CKV2_K8S_6", "CKV_K8S_31", "CKV_K8S_22", "CKV_K8S_29", "CKV_K8S_14",
    "CKV_K8S_43", "CKV_K8S_40", "CKV_K8S_13", "CKV_K8S_11", "CKV_K8S_10", "CKV_K8S_12", "CKV_K8S_8", "CKV_K8S_9",
    "CKV_K8S_21",
]
# Static-analysis rule noise lists.
SAST_DROP_PREFIXES = ["generic.secrets.", "yaml.kubernetes.", "dockerfile.", "terraform."]
SAST_DROP_PARTS = ["express-check-", "unsafe-formatstring"]
SAST_DROP_PARTS_SPA = [
    "detect-non-literal-regexp", "detect-non-literal-fs-filename", "detect-child-process",
    "detect-non-literal-require", "detect-no-csrf-before-method-override",
]
SAST_DOWNRANK_PARTS = ["detect-non-literal-regexp"]
SAST_DROP_PATHS = ["depscan-reports/", "node_modules/"]
# Folders that hold third-party code.
VENDOR_SEGMENTS = [
    "node_modules", ".pnpm", "bower_components", ".yarn", "vendor", ".venv", "venv", "site-packages", ".tox",
    ".gradle", ".cargo",
]
# Malware rules, matched by suffix.
MALWARE_DROP_SUFFIXES = ["api-obfuscation", "npm-install-script", "shady-links"]
MALWARE_WEAK_SUFFIXES = [
    "empty-information", "release-zero", "single-python-file", "bundled-binary", "deceptive-author",
    "metadata-mismatch", "repository-integrity-mismatch", "direct-url-dependency",
]
# Weakness ids and the vulnerability type they stand for.
CWE_TYPES = {
    "CWE-79": "xss", "CWE-89": "sql-injection", "CWE-1321": "prototype-pollution", "CWE-22": "path-traversal",
    "CWE-78": "command-injection", "CWE-502": "deserialization", "CWE-918": "ssrf", "CWE-287": "auth-bypass",
    "CWE-200": "information-disclosure", "CWE-400": "denial-of-service", "CWE-77": "code-injection", "CWE-611": "xxe",
    "CWE-352": "csrf", "CWE-601": "open-redirect", "CWE-94": "code-injection", "CWE-362": "race-condition",
    "CWE-863": "authorization-bypass", "CWE-798": "hardcoded-credentials", "CWE-327": "weak-crypto",
    "CWE-295": "improper-cert-validation", "CWE-190": "integer-overflow", "CWE-416": "use-after-free",
    "CWE-120": "buffer-overflow",
}


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def rank(label: Column, ranks: dict) -> Column:
    return F.coalesce(F.try_element_at(literal_map(ranks), F.lower(F.coalesce(label, F.lit("")))), F.lit(0))


def severity_rank(label: Column) -> Column:
    return rank(label, SEVERITY_RANK)


def reachability_rank(label: Column) -> Column:
    return rank(label, REACHABILITY_RANK)


def severity_band(score: Column) -> Column:
    """Severity word of a 0-10 base score."""
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low")


def severity_norm(word: Column) -> Column:
    """Advisory wording to the four levels; anything unknown, and null, is medium."""
    w = F.lower(F.trim(F.coalesce(word, F.lit(""))))
    return F.when(w.isin("critical", "high", "low"), w).otherwise("medium")


def score_band(score: Column) -> Column:
    """Band of a 0-100 priority score."""
    s = F.coalesce(score, F.lit(0))
    return F.when(s >= 90, "critical").when(s >= 70, "high").when(s >= 40, "medium").otherwise("low")


def ranking_score(contextual: Column, depscore: Column, default: int = 0) -> Column:
    return F.coalesce(contextual.cast("double"), depscore.cast("double"), F.lit(float(default)))


def is_open() -> Column:
    """Open finding: not closed, suppressed, accepted, or silenced without a runtime hit."""
    silenced = F.coalesce(F.col("auto_ignored"), F.lit(False)) & F.col("runtime_confirmed_at").isNull()
    return (
        ~F.col("status").isin("ignored", "resolved")
        & ~F.coalesce(F.col("suppressed"), F.lit(False))
        & ~F.coalesce(F.col("risk_accepted"), F.lit(False))
        & ~silenced
    )


def iac_is_critical(rule: Column, severity: Column) -> Column:
    return (
        F.when(rule.isin(IAC_ALWAYS), True)
        .when(rule.isin(IAC_NEVER), False)
        .otherwise(F.upper(F.coalesce(severity, F.lit(""))).isin("HIGH", "CRITICAL"))
    )


def auto_ignore_reason(kind: Column, level: Column, reachable: Column, kev: Column, rule: Column, severity: Column, payload: Column) -> Column:
    """Why a finding of the given type is silenced by default; null means it stays visible."""
    none = F.lit(None).cast("string")
    lvl = F.lower(F.coalesce(level, F.lit("")))
    loud = F.lower(F.coalesce(severity, F.lit(""))).isin("high", "critical")
    has_payload = F.coalesce(F.trim(payload) != "", F.lit(False))
    not_reached = (lvl == "unreachable") | F.coalesce(~reachable, F.lit(False))
    return (
        F.when(kind == "container", F.when(F.coalesce(kev, F.lit(False)), none).otherwise("base_image"))
        .when(kind == "iac", F.when(iac_is_critical(rule, severity), none).otherwise("iac_hardening"))
        .when(kind == "dast", F.when(has_payload | loud, none).otherwise("passive_hygiene"))
        .when(
            kind == "vulnerability",
            F.when(lvl.isin("confirmed", "data_flow"), none)
            .when(not_reached, "not_reachable")
            .when(lvl == "module", "unconfirmed_reachable"),
        )
    )


def sast_is_noise(rule: Column, client_spa: Column) -> Column:
    r = F.coalesce(rule, F.lit(""))
    return (
        any_of(r.startswith(p) for p in SAST_DROP_PREFIXES)
        | any_of(r.contains(p) for p in SAST_DROP_PARTS)
        | (client_spa & any_of(r.contains(p) for p in SAST_DROP_PARTS_SPA))
    )


def sast_path_is_generated(path: Column) -> Column:
    return any_of(F.coalesce(path, F.lit("")).contains(p) for p in SAST_DROP_PATHS)


def downrank_severity(rule: Column, severity: Column) -> Column:
    noisy = any_of(F.coalesce(rule, F.lit("")).contains(p) for p in SAST_DOWNRANK_PARTS)
    return F.when(noisy, "INFO").otherwise(F.coalesce(severity, F.lit("INFO")))


def is_vendored(path: Column) -> Column:
    segments = F.split(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), "/")
    return F.arrays_overlap(segments, F.array(*[F.lit(s) for s in VENDOR_SEGMENTS]))


def _has_suffix(rule: Column, suffixes: list[str]) -> Column:
    r = F.regexp_replace(F.lower(F.coalesce(rule, F.lit(""))), "_", "-")
    return any_of(r.endswith(s) for s in suffixes)


def malware_rule_dropped(rule: Column) -> Column:
    return _has_suffix(rule, MALWARE_DROP_SUFFIXES)


def malware_rule_weak(rule: Column) -> Column:
    return _has_suffix(rule, MALWARE_WEAK_SUFFIXES)


def cwe_to_type(cwe_ids: Column) -> Column:
    """Type of the first weakness id that has one."""
    known = F.filter(F.transform(cwe_ids, lambda c: F.try_element_at(literal_map(CWE_TYPES), c)), lambda t: t.isNotNull())
    return F.try_element_at(known, F.lit(1))


def failure_category(category: Column, message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(category == "no_changes", "empty_diff")
        .when(category.isin("auth_failed", "pr_creation_failed", "timeout"), category)
        .when(m.rlike("npm err!|yarn error|pnpm err|build.*fail"), "build_error")
        .when(m.rlike("test.*fail|jest.*fail|mocha.*fail"), "test_failure")
        .when(m.rlike("no.*safe.*version|no.*patched"), "no_safe_version")
        .when(m.rlike("breaking.*change|major.*version"), "breaking_changes")
        .when(m.rlike("rate.*limit|429|quota"), "api_error")
        .otherwise("unknown")
    )


def vuln_family(vuln_type: Column, rule: Column, message: Column) -> Column:
    """Family of a runtime finding, from the words of its type, rule and message."""
    empty = F.lit("")
    text = F.lower(F.concat_ws(" ", F.coalesce(vuln_type, empty), F.coalesce(rule, empty), F.coalesce(message, empty)))
    return (
        F.when(text.rlike("(sql ?injection|sqli)"), "sqli")
        .when(text.rlike(r"(template ?injection|ssti|cross.?site.?script|\bxss\b)"), "output-injection")
        .when(text.rlike(r"(path ?traversal|directory ?traversal|local file inclusion|\blfi\b)"), "path-traversal")
        .when(text.rlike("(command ?injection|os ?command)"), "command-injection")
        .otherwise(F.concat(F.lit("rule:"), F.lower(F.coalesce(rule, vuln_type, F.lit("other")))))
    )


def days_since(then: Column, now: Column) -> Column:
    """Whole days between two instants; infinity when ``then`` is missing."""
    seconds = F.timestamp_diff("SECOND", then, now)
    return F.coalesce(F.floor(seconds / 86400).cast("double"), F.lit(float("inf")))
