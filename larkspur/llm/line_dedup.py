"""Removal of repeated runs of lines by a suffix array over line ids.

The corpus is one long sequence of line ids, text after text, with a gap between texts.  Prefix doubling ranks its
suffixes: round 0 ranks by the line, and a round ranks by the pair (rank here, rank 2^k lines further on), so that equal
ranks mean 2^(k+1) equal lines.  A rank is a place in the sorted order of suffixes: distinct pairs are sorted over all
tasks by range, and counts before them summed over tasks, so no task sorts everything.  Suffixes alone in their rank
are settled and leave; a round only moves the others.  The suffixes of one rank form an interval of the suffix array
whose common prefix is at least so long; within it every run but the one that comes first in the corpus is a later copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import partitions, text_or_empty
from larkspur.session import written

MIN_LINES = 2
#: A line of so many words is a run by itself, as a passage often stands on a single line.
LONG_WORDS = 50
ADDED = ("n_lines", "n_removed", "longest_run")


def _running(rows: DataFrame, keys: list[str], amount: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``amount`` over all rows before in the order of ``keys`` (unique, not null)."""
    placed = written(rows.repartitionByRange(partitions(rows.sparkSession), *keys).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.sum(amount).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = F.sum(amount).over(W.partitionBy("_part").orderBy(*keys)) - F.col(amount)
    return placed.withColumn(name, inside).join(starts, "_part").withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")


def _name(text: Column) -> list[Column]:
    """Two hashes, of 64 and 32 bits, that stand for a line or a text."""
    return [F.xxhash64(text), F.hash(text)]


def _is_long(line: str) -> str:
    """SQL: whether a line has LONG_WORDS words; shorter lines are told by their length alone."""
    return f"(length({line}) >= {2 * LONG_WORDS - 1} and regexp_count({line}, '[^\\\\x20\\\\x09-\\\\x0D]+') >= {LONG_WORDS})"


def texts_in_order(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, t1, t2, copies, n, start; ``start`` is its place in the corpus.

    Texts follow by doc_id, those without an id last.  ``n`` is the number of lines that have a word.
    """
    lines = F.size(F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    t1, t2 = _name(F.col("text"))
    found = rows.select("doc_id", t1.alias("t1"), t2.alias("t2"), lines.alias("n")).groupBy("doc_id", "t1", "t2", "n").agg(F.count("*").alias("copies"))
    found = found.select("*", F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", F.lit(0)).alias("_id"), (F.col("n") + 1).alias("_room"))
    return _running(found, ["_no_id", "_id", "t1", "t2", "n"], "_room", "start").drop("_no_id", "_id", "_room")


def line_sequence(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(start, p, line, l1, l2, long): every line that has a word, its place p in the corpus and ``line`` in its text."""
    t1, t2 = _name(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("text"))
    named = rows.select("_id", t1.alias("_t1"), t2.alias("_t2"), F.expr(
        "filter(transform(split(text, '\\n', -1), (l, i) -> named_struct('line', i, 'has', l rlike '[^\\\\x20\\\\x09-\\\\x0D]', 'l1', xxhash64(l), 'l2', hash(l), 'long', " + _is_long("l") + ")), l -> l.has)"
    ).alias("lines"))
    once = texts.select("doc_id", "t1", "t2", "start", "copies")
    joined = named.join(once, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")))
    exploded = joined.select("start", "copies", F.posexplode("lines").alias("i", "l")).select("start", "copies", (F.col("start") + F.col("i")).alias("p"), "l.line", "l.l1", "l.l2", "l.long")
    several = exploded.where("copies > 1").drop("copies").dropDuplicates(["p"])  # rows that repeat id and text are one text
    return exploded.where("copies = 1").drop("copies").union(several)


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(start, p, rank) of the rows that are not alone with their keys."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    ranks = _running(groups, keys, "_n", "_rank").drop("_n")
    return written(rows.join(ranks, keys).select("start", "p", F.col("_rank").alias("rank")))


def _ahead(rows: DataFrame, lines: int) -> DataFrame:
    """Rows that have a rank ``lines`` places on in the same text, with it as ``then``."""
    there = rows.select("start", (F.col("p") - lines).alias("p"), F.col("rank").alias("then"))
    return rows.join(there, ["start", "p"])


def suffix_ranks(lines: DataFrame, first: int = 1) -> list[tuple[int, DataFrame]]:
    """Rounds of prefix doubling: (length, (start, p, rank)) for 1, 2, 4, ... lines until all suffixes are settled.

    Equal ranks mean equal runs of that length.  For ``first`` above 1 a round of that length is added; its pairs
    overlap unless it is a power of two.
    """
    length, ranked, rounds = 1, _ranked(lines, ["l1", "l2"]), []
    while not ranked.isEmpty():
        rounds.append((length, ranked))
        if length < first < 2 * length:
            rounds.append((first, _ranked(_ahead(ranked, first - length), ["rank", "then"])))
        ranked, length = _ranked(_ahead(ranked, length), ["rank", "then"]), 2 * length
    return rounds


def later_copies(rounds: list[tuple[int, DataFrame]], lines: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(start, p, source, length): runs of ``min_lines`` lines or more, or of one long line, that also start at the earlier place ``source``."""
    out = lines.sparkSession.createDataFrame([], "start long, p long, source long, length int")
    for length, ranked in rounds:
        if length == 1 < min_lines:
            ranked = ranked.join(lines.where("long").select("start", "p"), ["start", "p"], "left_semi")
        if length >= min_lines or length == 1:
            sources = ranked.groupBy("rank").agg(F.min("p").alias("source"))
            out = out.union(ranked.join(sources, "rank").where("p > source").select("start", "p", "source", F.lit(length).alias("length")))
    return out


def repeated_runs(copies: DataFrame) -> DataFrame:
    """(start, p, source, length): maximal later copies, the overlapping and touching ones of one source put together."""
    along = W.partitionBy("start", F.col("p") - F.col("source")).orderBy("p")
    reach = F.max(F.col("p") + F.col("length")).over(along.rowsBetween(W.unboundedPreceding, -1))
    islands = copies.withColumn("new", F.coalesce(F.col("p") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy("start", (F.col("p") - F.col("source")).alias("_shift"), "island").agg(F.min("p").alias("p"), F.min("source").alias("source"), (F.max(F.col("p") + F.col("length")) - F.min("p")).alias("length")).select("start", "p", "source", "length")


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """The documents with all their columns; ``text`` without the later copies of runs of ``min_lines`` lines or more and
    of single lines of 50 words or more, ``n_lines``, ``n_removed`` and ``longest_run``, the longest stretch of lines
    copied from one place.

    Lines without a word are no part of runs and stay.  Lines are equal if all their characters are.  Of equal runs the
    first in the corpus stays: the smallest doc_id, those without an id last.  A null text stays null.  Of rows that
    repeat both id and text one is the first, the others are copies of it.  Columns named as the three new ones are
    replaced.  An empty table gives no rows.
    """
    texts = written(texts_in_order(docs))
    lines = written(line_sequence(docs, texts))
    copies = written(later_copies(suffix_ranks(lines, min_lines), lines, min_lines))
    runs = repeated_runs(copies)
    covered = runs.select("start", F.explode(F.expr("sequence(p, p + length - 1)")).alias("p")).distinct()
    gone = covered.join(lines.select("start", "p", "line"), ["start", "p"]).groupBy("start").agg(F.collect_list("line").alias("_gone"))  # a text's lines at most
    longest = runs.groupBy("start").agg(F.max("length").alias("_longest"))
    per_text = texts.join(gone, "start", "left").join(longest, "start", "left").select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("n").alias("_n"), F.col("copies").alias("_copies"), "_gone", "_longest")
    t1, t2 = _name(text_or_empty())
    keyed = docs.withColumn("_k1", t1).withColumn("_k2", t2)
    joined = keyed.join(per_text, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_k1") == F.col("_t1")) & (F.col("_k2") == F.col("_t2")))
    single = joined.where("_copies = 1").withColumn("_nth", F.lit(1))
    several = joined.where("_copies > 1").withColumn("_nth", F.row_number().over(W.partitionBy("_id", "_k1", "_k2").orderBy(F.lit(1))))
    kept = "array_join(transform(array_except(sequence(0, size(_all) - 1), coalesce(_gone, cast(array() as array<int>))), i -> _all[i]), '\\n')"
    blank = "array_join(filter(_all, l -> not l rlike '[^\\\\x20\\\\x09-\\\\x0D]'), '\\n')"
    later = (F.col("_nth") > 1) & F.col("_n").isNotNull()
    whole, n_long = later & (F.col("_n") >= min_lines), F.expr(f"size(filter(_all, l -> {_is_long('l')}))").cast("long")
    some = later & (F.col("_n") < min_lines) & (n_long > 0)  # too few lines for a run, but long ones
    return (
        single.unionByName(several).withColumn("_all", F.split("text", "\n", -1)).withColumn("_some", F.coalesce(some, F.lit(False))).withColumn("_long", n_long)
        .withColumn("text", F.when(whole, F.expr(blank)).when(F.col("_some"), F.expr(f"array_join(filter(_all, l -> not {_is_long('l')}), '\\n')")).when(F.col("_gone").isNull(), F.col("text")).otherwise(F.expr(kept)))
        .select(*[c for c in docs.columns if c not in ADDED], F.col("_n").alias("n_lines"), F.when(whole, F.col("_n")).when(F.col("_some"), F.col("_long")).otherwise(F.coalesce(F.size("_gone"), F.lit(0)).cast("long")).alias("n_removed"),
                F.when(whole, F.col("_n")).when(F.col("_some"), F.lit(1)).otherwise(F.coalesce("_longest", F.lit(0)).cast("long")).alias("longest_run"))
    )


def _query(spark, sf_dir):
    done = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(text_or_empty().cast("binary"), 256).alias("kept_sha256"))


QUERY = {"op5_line_dedup": _query}

ORACLE = {
    "op5_line_dedup": rf"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS LAST) AS row FROM documents),
a AS (SELECT row, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS j FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY j) AS i FROM a WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT row, i, list(line) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND {MIN_LINES - 1} FOLLOWING) AS run FROM l),
c AS (SELECT row, i, row_number() OVER (PARTITION BY run ORDER BY row, i) AS nth FROM w WHERE len(run) = {MIN_LINES}),
o AS (SELECT row, i, row_number() OVER (PARTITION BY line ORDER BY row, i) AS nth FROM l WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {LONG_WORDS}),
g AS (SELECT DISTINCT row, i + unnest(range({MIN_LINES})) AS i FROM c WHERE nth > 1 UNION SELECT row, i FROM o WHERE nth > 1),
r AS (SELECT l.row, l.j FROM l JOIN g USING (row, i)),
k AS (SELECT row, string_agg(line, chr(10) ORDER BY j) AS kept FROM (SELECT * FROM a ANTI JOIN r USING (row, j)) GROUP BY row)
SELECT doc_id, coalesce((SELECT count(*) FROM l WHERE l.row = d.row), 0)::BIGINT AS n_lines, coalesce((SELECT count(*) FROM r WHERE r.row = d.row), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (row)
"""
}
