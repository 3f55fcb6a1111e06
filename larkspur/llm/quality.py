"""Quality rules with risk-controlled thresholds.

A rule is a ratio of a document's counts and a list of cutoffs from lenient to strict.  Labelled good documents are the
holdout.  Within a stratum a rule's cutoffs are tested in that order: the number of good documents beyond a cutoff must
be so small that, were the true rate of false rejection as high as the rule may cost, so few would be seen with a
probability of at most ``delta`` over the number of strata and rules (exact binomial tail).  The first cutoff that
fails ends the sequence, so the order needs no further correction.  With probability 1 - delta all cutoffs in use keep
their rates, and the rules of a stratum together reject at most ``risk`` of its good documents.  Of the certified
cutoffs the strictest is used that rejects mostly documents labelled bad; without one, the rule rejects nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import text_or_empty, words_of
from larkspur.session import written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
RISK, DELTA, MIN_BAD = 0.05, 0.05, 0.9

#: rule -> (numerator, denominator, cutoffs of 1000 * numerator / denominator from lenient to strict)
RULES = {
    "symbols": ("n_symbols", "word_chars", (500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10)),
    "dup_lines": ("n_dup_lines", "n_lines", (800, 700, 600, 500, 400, 300, 250, 200, 150, 100)),
    "repeats": ("n_repeat_words", "n_words", (300, 250, 200, 150, 120, 100, 80, 60, 40, 20)),
    "capitals": ("n_capitals", "word_chars", (900, 800, 700, 600, 500, 400, 300, 250, 200)),
    "long_words": ("word_chars", "n_words", (40000, 30000, 25000, 20000, 17000, 15000, 13000, 12000, 11000, 10000)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def metrics(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang, the columns to ``keep`` and the counts of each whole text, all within a row.

    Repeated windows are found by hashes of 1, 2, 4 and 8 words.  Only texts in which a hash comes twice are looked at
    again: their (hash, place) pairs are sorted and neighbours with equal hashes compared word by word.
    """
    word = "transform(words, w -> xxhash64(w))"
    pair = lambda name, step: f"if(size({name}) > {step}, zip_with(slice({name}, 1, size({name}) - {step}), slice({name}, {step + 1}, size({name}) - {step}), (a, b) -> xxhash64(a, b)), cast(array() as array<bigint>))"
    places = """array_sort(array_distinct(flatten(zip_with(slice(sorted, 1, size(sorted) - 1), slice(sorted, 2, size(sorted) - 1),
        (a, b) -> if(a.h = b.h and slice(words, a.p + 1, 8) = slice(words, b.p + 1, 8), array(a.p, b.p), cast(array() as array<int>))))))"""
    covered = "aggregate(places, named_struct('n', 0L, 'end', 0), (s, p) -> named_struct('n', s.n + p + 8 - greatest(s.end, p), 'end', p + 8), s -> s.n)"
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.select(F.col("doc_id").cast("long"), "lang", text_or_empty().alias("text"), F.struct(*keep).alias("kept_columns") if keep else F.lit(None).alias("kept_columns"))
        .withColumn("words", words_of(F.col("text")))
        .withColumn("lines", lines)
        .withColumn("w1", F.expr(word)).withColumn("w2", F.expr(pair("w1", 1))).withColumn("w4", F.expr(pair("w2", 2))).withColumn("w8", F.expr(pair("w4", 4)))
        .withColumn("sorted", F.expr("if(size(array_distinct(w8)) < size(w8), array_sort(zip_with(w8, sequence(0, size(w8) - 1), (h, p) -> named_struct('h', h, 'p', p))), null)"))
        .withColumn("places", F.expr(f"if(sorted is null, null, {places})"))
        .select("doc_id", "lang", "kept_columns", F.explode(F.array(F.struct(  # exploded, so that later steps see columns and not formulas to repeat
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(F.expr(f"if(places is null, null, {covered})"), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        ))).alias("m"))
        .select("doc_id", "lang", *[F.col(f"kept_columns.{c}").alias(c) for c in keep], "m.*")
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def beyond(rule: str) -> Column:
    """How many of a rule's cutoffs a document is beyond."""
    top, bottom, cutoffs = RULES[rule]
    return sum(((1000 * F.col(top) > c * F.col(bottom)).cast("int") for c in cutoffs), F.lit(0))


def _log_gamma(x: str) -> str:
    """SQL: log gamma of x >= 1 by Stirling's series, eight steps up."""
    z = f"({x} + 8D)"
    steps = " * ".join(f"({x} + {i}D)" for i in range(8))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1D / (12D * {z}) - 1D / (360D * pow({z}, 3)) + 1D / (1260D * pow({z}, 5)) - 1D / (1680D * pow({z}, 7)) - ln({steps}))"


def binomial_tail(k: str, n: str, p: float) -> str:
    """SQL: P(X <= k) for X binomial of n and p, and 1 where k is above the mean.

    The largest term is taken in logarithms; the others follow downwards by ratios, as far as they can matter.
    """
    log_top = f"{_log_gamma(f'double({n} + 1)')} - {_log_gamma(f'double({k} + 1)')} - {_log_gamma(f'double({n} - {k} + 1)')} + {k} * ln({p!r}D) + ({n} - {k}) * ln({1 - p!r}D)"
    reach = f"least({k}, bigint(12 * sqrt({n} * {p * (1 - p)!r}D)) + 60)"
    series = f"aggregate(sequence(0L, {reach}), named_struct('sum', 0D, 'term', 1D), (s, i) -> named_struct('sum', s.sum + s.term, 'term', s.term * double(greatest({k} - i, 0L)) * {1 - p!r}D / (double({n} - {k} + i + 1) * {p!r}D)), s -> s.sum)"
    return f"if({k} > {n} * {p!r}D, 1D, least(1D, exp({log_top}) * {series}))"


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, min_bad: float = MIN_BAD) -> DataFrame:
    """(lang, rule, used): of how many of a rule's cutoffs a document of a stratum may not be beyond.

    A document is good if all its labels are 1 and bad if all are 0; null labels count as none.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    held = measured.where(~base_failed()).join(marks.select("doc_id", F.col("low").alias("good")), "doc_id")
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), beyond(r).alias("beyond")) for r in RULES])
    counts = (
        held.select("lang", "good", F.explode(rules).alias("r")).groupBy("lang", "r.rule", "r.beyond")
        .agg(F.sum((F.col("good") == 1).cast("long")).alias("good"), F.sum((F.col("good") == 0).cast("long")).alias("bad"))
    )
    sizes = F.create_map(*[x for r in RULES for x in (F.lit(r), F.lit(len(RULES[r][2])))])
    # "cutoff" c rejects a document that is beyond c or more of them: the largest c is the most lenient
    tested = (
        counts.groupBy("lang", "rule").agg(F.collect_list(F.struct("beyond", "good", "bad")).alias("found"), F.sum("good").alias("n"))
        .withColumn("strata", F.size(F.collect_set(F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))).over(W.partitionBy(F.lit(1)))))
        .withColumn("cutoff", F.explode(F.sequence(F.lit(1), sizes[F.col("rule")])))
        .withColumn("k", F.expr("aggregate(found, 0L, (a, f) -> a + if(f.beyond >= cutoff, f.good, 0L))"))
        .withColumn("b", F.expr("aggregate(found, 0L, (a, f) -> a + if(f.beyond >= cutoff, f.bad, 0L))"))
        .withColumn("p", F.expr(binomial_tail("k", "n", risk / len(RULES))))
        .withColumn("holds", F.col("p") <= F.lit(delta) / (F.col("strata") * len(RULES)))
    )
    in_order = W.partitionBy("lang", "rule").orderBy(F.col("cutoff").desc())
    certified = tested.withColumn("certified", F.min("holds").over(in_order)).where("certified")
    useful = certified.where((F.col("b") > 0) & (F.col("b") >= F.lit(min_bad) * (F.col("b") + F.col("k"))))
    return useful.groupBy("lang", "rule").agg(F.min("cutoff").alias("used"))


def judge(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """``measured`` with base_failed, rejected_by (rules) and kept."""
    used = chosen.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("rule", "used"))).alias("used")).withColumnRenamed("lang", "_lang")
    hit = F.filter(F.array(*[F.when(beyond(r) >= F.col("used")[r], F.lit(r)) for r in RULES]), lambda r: r.isNotNull())
    return (
        measured.join(F.broadcast(used) if used.limit(10_001).count() <= 10_000 else used, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", F.when(~F.col("base_failed"), F.coalesce(hit, F.array())).otherwise(F.array().cast("array<string>"))).drop("used")
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    )


def quality_rules(docs: DataFrame, labels: DataFrame, keep: Sequence[str] = (), **settings) -> DataFrame:
    """Per document: doc_id, lang, the columns to ``keep``, its counts, base_failed, rejected_by, kept.

    Columns to keep go with the counts in one more pass over the texts, so that no text is stored or shuffled.

    A null or empty text has no words and fails the base rules.  A null lang is a stratum of its own.  Repeated rows
    are judged one by one; a null doc_id has no label.  Without labels, or with too few for a certificate, only the base
    rules reject.  Other columns are ignored; an empty table gives no rows.
    """
    measured = written(metrics(docs))
    chosen = written(cutoffs(measured, labels, **settings))
    return judge(metrics(docs, keep) if keep else measured, chosen)


def _query(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERY = {"op2_quality_rules": _query}


def _oracle() -> str:
    per_rule = " UNION ALL ".join(
        f"SELECT doc_id, lang, '{r}' AS rule, len(list_filter({list(c)}, lambda c: 1000 * {top} > c * {bottom})) AS beyond, {len(c)} AS cutoffs FROM m"
        for r, (top, bottom, c) in RULES.items()
    )
    p, level = RISK / len(RULES), f"{DELTA} / (strata * {len(RULES)})"
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, row_number() OVER () AS row FROM documents),
x AS (SELECT row, unnest(range(0, len(words) - 7)) AS p, words FROM t WHERE len(words) >= 8),
y AS (SELECT row, p, count(*) OVER (PARTITION BY row, words[p + 1:p + 8]) AS n FROM x),
z AS (SELECT row, p, lead(p) OVER (PARTITION BY row ORDER BY p) AS next FROM y WHERE n > 1),
rep AS (SELECT row, sum(least(8, coalesce(next - p, 8))) AS n_repeat_words FROM z GROUP BY row),
li AS (SELECT row, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
m AS (SELECT t.row, doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals
      FROM t JOIN li USING (row) LEFT JOIN rep USING (row)),
b AS (SELECT row, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m),
ru AS ({per_rule.replace("doc_id, lang,", "row, doc_id, lang,")}),
g AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)),
c AS (SELECT lang, rule, cutoffs, beyond, sum((good = 1)::INT) AS good, sum((good = 0)::INT) AS bad FROM ru JOIN b USING (row) JOIN g USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
s AS (SELECT c.lang, c.rule, cutoff, any_value(n) AS n, any_value(strata) AS strata, sum(CASE WHEN beyond >= cutoff THEN good ELSE 0 END)::BIGINT AS k, sum(CASE WHEN beyond >= cutoff THEN bad ELSE 0 END)::BIGINT AS bad
      FROM (SELECT *, unnest(range(1, cutoffs + 1)) AS cutoff, sum(good) OVER (PARTITION BY lang, rule) AS n, (SELECT count(*) FROM (SELECT DISTINCT lang FROM c)) AS strata FROM c) c GROUP BY ALL),
h AS (SELECT *, (CASE WHEN k > n * {p!r} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln(1 - {p!r})))) END) <= {level} AS holds FROM s),
o AS (SELECT *, bool_and(holds) OVER (PARTITION BY lang, rule ORDER BY cutoff DESC) AS certified FROM h),
u AS (SELECT lang, rule, min(cutoff) AS used FROM o WHERE certified AND bad > 0 AND bad >= {MIN_BAD} * (bad + k) GROUP BY ALL),
bad AS (SELECT DISTINCT row FROM ru JOIN u ON ru.lang IS NOT DISTINCT FROM u.lang AND ru.rule = u.rule WHERE beyond >= used)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.row IS NULL AS kept
FROM m JOIN b USING (row) LEFT JOIN bad USING (row)
"""


ORACLE = {"op2_quality_rules": _oracle()}
