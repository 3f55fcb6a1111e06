"""Version keys that sort natively: coerced triples, PEP 440 keys, gem keys, and range expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First number group of up to three dotted parts, at most 16 digits each, not glued to other digits.
_COERCE = r"(?:^|[^0-9])([0-9]{1,16})(?:\.([0-9]{1,16}))?(?:\.([0-9]{1,16}))?(?:$|[^0-9])"


def version_key(version: Column) -> Column:
    """(major, minor, patch) as a struct of longs, or null when no number can be found."""

    def part(i: int) -> Column:
        text = F.regexp_extract(version, _COERCE, i)
        return F.when(text == "", F.lit(0)).otherwise(text.cast("long"))

    key = F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))
    return F.when(F.regexp_extract(version, _COERCE, 1) != "", key)


def is_prerelease(version: Column) -> Column:
    """True for ``1.2.3-something``; build metadata after ``+`` does not count."""
    return F.coalesce(version.rlike(r"^[vV=\s]*[0-9]+\.[0-9]+\.[0-9]+-[0-9A-Za-z.-]+"), F.lit(False))


def key_text(key: Column) -> Column:
    return F.concat_ws(".", key["major"].cast("string"), key["minor"].cast("string"), key["patch"].cast("string"))


def version_norm(raw: Column, ecosystem: Column) -> Column:
    """Ecosystem-specific text form in which equal versions are equal strings; null when it has none."""
    v = F.trim(F.regexp_replace(F.trim(raw), r"^[vV](?=[0-9])", ""))
    v = F.trim(F.substring_index(v, "+", 1))
    semver = r"^([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:-([0-9A-Za-z.-]+))?$"

    def part(i: int) -> Column:
        text = F.regexp_extract(v, semver, i)
        return F.when(text == "", F.lit("0")).otherwise(text)

    tail = F.lower(F.regexp_extract(v, semver, 4))
    padded = F.concat_ws(".", part(1), part(2), part(3))
    as_semver = F.when(v.rlike(semver), F.when(tail == "", padded).otherwise(F.concat(padded, F.lit("-"), tail)))

    lower = F.lower(v)
    release = F.regexp_extract(lower, r"^([0-9]+(?:\.[0-9]+)*)", 1)
    segments = F.transform(F.split(release, r"\."), lambda s: F.regexp_replace(s, r"^0+(?=[0-9])", ""))
    filled = F.concat(segments, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(3) - F.size(segments))))
    suffix = F.regexp_replace(lower.substr(F.length(release) + 1, F.length(lower)), r"[-_\s]", "")
    as_pypi = F.when(release != "", F.concat(F.array_join(filled, "."), suffix))

    as_maven = F.regexp_replace(lower, r"[-_.]+([a-z])", ".$1")
    return F.when(
        (v != "") & raw.isNotNull(),
        F.when(ecosystem.isin("npm", "cargo"), as_semver)
        .when(ecosystem == "pypi", as_pypi)
        .when(ecosystem == "maven", as_maven)
        .otherwise(lower),
    )


def pep440_key(raw: Column) -> Column:
    """Sortable key: release numbers, phase (dev < pre < final < post), pre tag, pre, post and dev numbers.

    Release tuples of unequal length compare as if padded with zeros, so trailing zeros are removed.  An
    epoch prefix is ignored.
    """
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), "^v", ""), "^[0-9]+!", "")
    strict = r"^([0-9]+(?:\.[0-9]+)*)(?:(a|b|rc)([0-9]+))?(?:\.post([0-9]+))?(?:\.dev([0-9]+))?$"
    ok = text.rlike(strict)
    release = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)*)", 1)
    trimmed = F.regexp_replace(release, r"(\.0+)+$", "")

    def num(i: int) -> Column:
        s = F.regexp_extract(text, strict, i)
        return F.when(ok & (s != ""), s.cast("long"))

    tag = F.when(ok, F.regexp_extract(text, strict, 2)).otherwise(F.lit(""))
    post, dev = num(4), num(5)
    phase = (
        F.when(dev.isNotNull() & (tag == "") & post.isNull(), 0)
        .when(tag != "", 1)
        .when(post.isNotNull(), 3)
        .otherwise(2)
    )
    return F.when(
        release != "",
        F.struct(
            F.transform(F.split(trimmed, r"\."), lambda s: s.cast("long")).alias("release"),
            phase.alias("phase"),
            tag.alias("tag"),
            F.coalesce(num(3), F.lit(0)).alias("pre"),
            F.coalesce(post, F.lit(0)).alias("post"),
            F.coalesce(dev, F.lit(0)).alias("dev"),
        ),
    )


def gem_key(raw: Column) -> Column:
    """Sortable key for dotted gem versions: words sort before the end, the end before numbers."""
    text = F.regexp_replace(F.lower(F.trim(raw)), "-", ".")
    part = F.transform(
        F.split(text, r"\."),
        lambda s: F.when(
            s.rlike("^[0-9]+$"), F.struct(F.lit(2).alias("kind"), s.try_cast("long").alias("n"), F.lit("").alias("word"))
        ).otherwise(F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), s.alias("word"))),
    )
    end = F.array(F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit("").alias("word")))
    return F.when(text != "", F.concat(part, end))


def parse_range(text: Column) -> Column:
    """``>= 1.0, < 2.0`` to an array of (op, version); a bare version means ``=``; null when malformed."""
    t = F.trim(text)
    bare = t.rlike(r"^[\w.+-]+$")
    item = r"^(>=|<=|>|<|=)\s*([\w.+-]+)$"
    parts = F.filter(F.transform(F.split(t, ","), lambda p: F.trim(p)), lambda p: p != "")

    def clause(op: Column, version: Column) -> Column:
        return F.struct(op.alias("op"), version.alias("version"))

    many = F.transform(parts, lambda p: clause(F.regexp_extract(p, item, 1), F.regexp_extract(p, item, 2)))
    well_formed = F.forall(parts, lambda p: p.rlike(item)) & (F.size(parts) > 0)
    return F.when(bare, F.array(clause(F.lit("="), t))).when(well_formed, many)


def in_range(key: Column, clauses: Column) -> Column:
    """Does a version key satisfy every clause?  A clause that does not coerce satisfies nothing."""

    def holds(c: Column) -> Column:
        k = version_key(c["version"])
        return F.coalesce(
            F.when(c["op"] == ">=", key >= k).when(c["op"] == "<=", key <= k).when(c["op"] == ">", key > k)
            .when(c["op"] == "<", key < k).otherwise(key == k),
            F.lit(False),
        )

    return F.coalesce(F.forall(clauses, holds), F.lit(False))
