"""Policies as SQL rules over rows, and detectors over documents (UDF1-UDF6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from larkspur.functions import text

C = F.col


@dataclass(frozen=True)
class Rule:
    """A named rule: when the SQL ``predicate`` holds the row is refused for the SQL ``reason``."""

    label: str
    predicate: str
    reason: str


# The default package policy: malware never; strict licences and reputation for important projects; no AGPL elsewhere.
DEFAULT_RULES = [
    Rule("malicious", "is_malicious", "'Package flagged as malicious: ' || coalesce(malicious_reason, 'unknown')"),
    Rule("banned_license", "NOT is_malicious AND importance >= 1.3 AND (license LIKE '%GPL-3.0%')", "'Banned license for high-importance project: ' || license"),
    Rule("low_reputation", "NOT is_malicious AND importance >= 1.3 AND NOT coalesce(license LIKE '%GPL-3.0%', false) AND score < 40", "'Low reputation score for high-importance project: ' || score"),
    Rule("agpl", "NOT is_malicious AND importance < 1.3 AND license LIKE '%AGPL%'", "'AGPL not allowed'"),
]


def evaluate(rows: DataFrame, rules: list[Rule], column: str = "policy_result") -> DataFrame:
    """Add {allowed, reasons}; a rule whose predicate is null does not apply."""
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(r.predicate), F.lit(False)), F.expr(r.reason)) for r in rules]))
    return rows.withColumn("_reasons", reasons).withColumn(column, F.struct((F.size("_reasons") == 0).alias("allowed"), C("_reasons").alias("reasons"))).drop("_reasons")


def evaluate_python(rows: DataFrame, decide: Callable[[pd.DataFrame], pd.DataFrame], column: str = "policy_result") -> DataFrame:
    """Escape hatch: ``decide`` maps a pandas batch to columns ``allowed`` and ``reasons``.

    A batch that raises is refused row by row with the error as the reason.
    """
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                verdict = decide(batch)
                allowed, reasons = list(verdict["allowed"]), list(verdict["reasons"])
            except Exception as exc:  # a broken policy refuses, it never lets packages through
                allowed, reasons = [False] * len(batch), [[f"Policy execution error: {exc}"]] * len(batch)
            yield batch[columns].assign(_allowed=allowed, _reasons=reasons)

    extra = [StructField("_allowed", BooleanType()), StructField("_reasons", ArrayType(StringType()))]
    schema = StructType([*rows.schema.fields, *extra])
    out = rows.mapInPandas(run, schema)
    return out.withColumn(column, F.struct(C("_allowed").alias("allowed"), C("_reasons").alias("reasons"))).drop("_allowed", "_reasons")


def project_status(evaluated: DataFrame, known: tuple[str, ...] = ("Compliant", "Non-Compliant")) -> tuple[DataFrame, DataFrame]:
    """(status per project, violation rows).  One blocked package makes a project Non-Compliant.

    Violations stay rows, since a project may have any number of them.
    """
    blocked = ~C("policy_result.allowed")
    status = evaluated.groupBy("project_id").agg(F.count_if(blocked).alias("violations")).withColumn("status", F.when(C("violations") > 0, "Non-Compliant").otherwise("Compliant"))
    rows = evaluated.filter(blocked).select("project_id", F.concat_ws(": ", "name", F.array_join("policy_result.reasons", ", ")).alias("violation"))
    return status.withColumn("status", known_status(C("status"), known)), rows


def known_status(status, known: tuple[str, ...]):
    """A status outside the organization's list counts as Non-Compliant."""
    return F.when(status.isin(*known), status).otherwise("Non-Compliant")


def pr_check(changes: DataFrame, rules: list[Rule]) -> DataFrame:
    """Pull requests pass when none of their changed packages is refused."""
    judged = evaluate(changes, rules)
    return judged.groupBy("pr_id").agg(F.bool_and("policy_result.allowed").alias("passed"), F.count_if(~C("policy_result.allowed")).alias("violations"))


def notification_triggers(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each event under each trigger: (trigger, notify, message) beside the event's columns.

    A trigger is a rule: when its predicate holds it notifies with its reason as the message.  A predicate that is null
    for an event does not notify; a null message stays empty.
    """
    fires = [F.coalesce(F.expr(r.predicate), F.lit(False)) for r in rules]
    verdicts = [F.struct(F.lit(r.label).alias("trigger"), fire.alias("notify"), F.when(fire, F.expr(r.reason)).alias("message")) for r, fire in zip(rules, fires)]
    return events.withColumn("_t", F.explode(F.array(*verdicts))).select(*events.columns, "_t.*")


def preflight(spark: SparkSession, package: dict, rules: list[Rule], schema: str) -> DataFrame:
    """Judge one hypothetical package before it is added."""
    return evaluate(spark.createDataFrame([package], schema), rules)


def preflight_candidates(candidates: DataFrame, installed: DataFrame, catalog: DataFrame, projects: DataFrame, rules: list[Rule]) -> DataFrame:
    """Judge packages that projects do not have yet, as if they were added: candidates (project_id, dependency_id) with their verdict.

    Candidates that the project has already are left to the policy of installed packages; one that the catalog does not
    know is refused, as nothing is known about it.
    """
    new = candidates.select("project_id", "dependency_id").distinct().join(installed.select("project_id", "dependency_id"), ["project_id", "dependency_id"], "left_anti")
    rows = new.join(catalog.withColumn("is_known", F.lit(True)), "dependency_id", "left").join(projects.select("project_id", "importance"), "project_id")
    unknown = Rule("unknown", "is_known IS NULL", "'Package is not in the catalog'")
    return evaluate(rows, [unknown, *rules])


#: Packages of one slice are dealt over so many tasks, each of which gets the slice's projects.
SLICE_PARTS = 16


def preflight_slices(asked: DataFrame, installed: DataFrame, catalog: DataFrame, projects: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """``preflight_candidates`` for every project and package of one slice: (project_id, dependency_id, policy_result).

    ``asked`` (dependency_id), ``installed`` (project_id, dependency_id) and ``projects`` (project_id, importance) all
    carry the slice in ``key``.  A verdict depends on the package and the project's importance, so it is found once for
    each of those; pairs of project and package are made last and never exchanged.  Projects take along the packages of
    their slice that they have, which is what a pair has to be checked against.
    """
    has = installed.select("project_id", key, "dependency_id").groupBy("project_id", key).agg(F.collect_set("dependency_id").alias("_has"))
    owners = projects.select("project_id", key, "importance").join(has.hint("merge"), ["project_id", key], "left")
    levels = owners.select(key, "importance").distinct()
    known = asked.select("dependency_id", key).distinct().join(catalog.withColumn("is_known", F.lit(True)).hint("merge"), "dependency_id", "left")
    unknown = Rule("unknown", "is_known IS NULL", "'Package is not in the catalog'")
    judged = evaluate(known.join(levels, key), [unknown, *rules]).select(key, "importance", "dependency_id", "policy_result")
    judged = judged.withColumn("_part", F.pmod(F.xxhash64("dependency_id"), F.lit(SLICE_PARTS)).cast("int"))
    dealt = owners.select("project_id", C(key).alias("_k2"), C("importance").alias("_i2"), "_has", F.explode(F.sequence(F.lit(0), F.lit(SLICE_PARTS - 1))).alias("_p2"))
    same = (C(key) == C("_k2")) & C("importance").eqNullSafe(C("_i2")) & (C("_part") == C("_p2"))
    pairs = judged.join(dealt.hint("merge"), same).filter(~F.coalesce(F.array_contains("_has", C("dependency_id")), F.lit(False)))
    return pairs.select("project_id", "dependency_id", "policy_result")


def extract_purls(components: DataFrame) -> DataFrame:
    """Distinct versioned package URLs of bill-of-materials components, without the document's own component."""
    good = C("purl").startswith("pkg:") & C("purl").contains("@") & ~F.coalesce(C("is_root"), F.lit(False))
    return components.filter(F.coalesce(good, F.lit(False))).select("document", "purl").distinct()


def expand_ranges(feed: DataFrame) -> DataFrame:
    """One row per clause of every well-formed range text."""
    from larkspur.functions.versions import parse_range

    return feed.select("feed_id", F.posexplode(parse_range(C("vulnerable_range"))).alias("position", "clause")).select("feed_id", "position", "clause.*")


def detect_secrets(documents: DataFrame) -> DataFrame:
    """Every secret-shaped value of every document, redacted, one row per match."""
    hits = documents.select("doc_id", F.posexplode(text.secret_hits(C("text"))).alias("position", "hit"))
    return hits.select("doc_id", "position", "hit.detector_type", text.redact(C("hit.raw_value")).alias("redacted_value"), F.sha2("hit.raw_value", 256).alias("value_hash"))


def detect_licenses(documents: DataFrame) -> DataFrame:
    """Licence lines of every document with their family key."""
    lines = documents.select("doc_id", F.posexplode(text.license_lines(C("text"))).alias("position", "line"))
    return lines.withColumn("license_key", text.license_key(C("line")))
