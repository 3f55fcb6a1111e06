"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents lie in blocks by a keyed hash, so the blocks and the documents in them are in random order.  A
source with target T draws the first blocks of that order until they hold T words, starting over for words beyond its
size; the last block drawn is cut.  Which output shard gets a draw is decided from the root down: a node splits its
exact counts per source between its two halves by a multivariate hypergeometric draw, down to single shards.  Shards
take disjoint stretches of each source's draws, and rows are shuffled inside their shard by another hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import n_words_of, text_or_empty
from larkspur.session import written

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 4_000_000
MIN_BLOCKS = 64
SHARDS = 16


def _order_key(seed: int, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(f"mix{seed}"), doc_id.cast("string")).cast("binary"))


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, ord): words of each document and its place in the random order of its source."""
    return docs.select("doc_id", "source", n_words_of(text_or_empty()).alias("size"), _order_key(seed, F.col("doc_id")).alias("ord"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, rank, source_size, target): the sources share ``share`` times all words by weight, each up to ``most``
    times its own size.

    In order of size over weight the sources that are full are the first ones; the others get the same words for a
    unit of weight.  That is where handing on the excess again and again ends.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    by_fill = W.orderBy(F.col("full") / F.col("weight"), "rank")
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    everything = by_fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = (
        rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight).withColumn("full", F.col("source_size") * most)
        .withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("full").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    )
    unit = F.first(F.when(F.col("full") > F.col("weight") * F.col("level"), F.col("level")), ignorenulls=True).over(everything)
    target = F.least(F.col("full").cast("double"), F.col("weight") * F.coalesce(unit, F.lit(float("inf"))))
    return filled.withColumn("target", target).select("source", F.col("rank").cast("int").alias("rank"), "source_size", "target")


def hypergeometric(total: str, marked: str, taken: str, uniform: str) -> str:
    """SQL: how many of ``taken`` items drawn from ``total``, ``marked`` of them marked, are marked.

    Inverts the distribution at ``uniform``.  Both classes are turned so that neither is over half; then the smallest
    value is 0, whose log-probability is a sum, and the others follow by ratios.
    """
    k, m = f"least({marked}, {total} - {marked})", f"least({taken}, {total} - {taken})"
    log_none = f"aggregate(sequence(0L, {k} - 1L), 0D, (q, i) -> q + ln(double({total} - {m} - i) / double({total} - i)))"
    found = (
        f"aggregate(sequence(0L, least({k}, {m})), named_struct('cum', 0D, 'log', {log_none}, 'x', 0L), "
        f"(q, j) -> if(q.cum >= {uniform}, q, named_struct('cum', q.cum + exp(q.log), "
        f"'log', q.log + ln(greatest(double({k} - j) * double({m} - j), 1e-300D)) - ln(double(j + 1L) * double({total} - {k} - {m} + j + 1L)), 'x', j)), q -> q.x)"
    )
    rare = f"if({k} = 0 or {m} = 0, 0L, {found})"
    turned = f"if({taken} > {total} - {taken}, {k} - v, v)"
    return f"transform(transform(array({rare}), v -> {turned}), f -> if({marked} > {total} - {marked}, {taken} - f, f))[0]"


def split_counts(counts: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(shard, counts): splits the draws per source (one row, array ``counts``) among the shards, which get equal numbers.

    One level of the tree is one projection; a row holds a node's counts, as many as there are sources.
    """
    per, more = F.floor(F.col("total") / shards), F.col("total") % shards
    nodes = counts.withColumn("total", F.expr("aggregate(counts, 0L, (a, x) -> a + x)"))
    nodes = nodes.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "counts", per.alias("per"), more.alias("more"))
    for _ in range(math.ceil(math.log2(max(shards, 1)))):
        nodes = nodes.withColumn("mid", F.expr("lo + int((hi - lo) div 2)")).withColumn("total", F.expr("aggregate(counts, 0L, (a, x) -> a + x)"))
        nodes = nodes.withColumn("cap", F.expr("per * (mid - lo) + greatest(least(more, mid) - least(more, lo), 0)"))
        draw = hypergeometric("s.total", "c", "s.cap", f"double(pmod(xxhash64({seed}, lo, hi, size(s.got)), 1000000007L)) / 1000000007D")
        state = "named_struct('total', total, 'cap', cap, 'got', cast(array() as array<bigint>))"
        step = f"transform(array({draw}), d -> named_struct('total', s.total - c, 'cap', s.cap - d, 'got', array_append(s.got, d)))[0]"
        nodes = nodes.withColumn("left", F.expr(f"if(hi - lo < 2, counts, aggregate(counts, {state}, (s, c) -> {step}, s -> s.got))"))
        halves = F.expr("if(hi - lo < 2, array(struct(lo, hi, counts)), array(struct(lo as lo, mid as hi, left as counts), struct(mid as lo, hi as hi, zip_with(counts, left, (a, b) -> a - b) as counts)))")
        nodes = nodes.select(F.explode(halves).alias("n"), "per", "more").select("n.lo", "n.hi", "n.counts", "per", "more")
    return nodes.select(F.col("lo").alias("shard"), "counts")


def _block(blocks: int) -> Column:
    return F.floor(F.conv(F.substring("ord", 1, 8), 16, 10).cast("long") * F.lit(blocks) / F.lit(float(1 << 32))).cast("long")


def draws(rows: DataFrame, plan: DataFrame, blocks: int, most: int, shards: int, seed: int) -> DataFrame:
    """(source, block, pass, take, shard): the blocks drawn, in order, and the words taken of each."""
    in_order = W.partitionBy("source").orderBy("block")
    sums = (
        rows.groupBy("source", _block(blocks).alias("block")).agg(F.sum("size").alias("words"))
        .withColumn("before", F.sum("words").over(in_order) - F.col("words")).withColumn("place", F.row_number().over(in_order) - 1)
        .withColumn("n", F.count("*").over(W.partitionBy("source")))
    )
    wanted = plan.withColumn("wanted", F.round("target").cast("long"))
    drawn = (
        sums.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .join(wanted.select(F.col("source").alias("_s"), "rank", "source_size", "wanted"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        .withColumn("at", F.col("pass") * F.col("source_size") + F.col("before")).where(F.col("at") < F.col("wanted"))
        .withColumn("take", F.least("words", F.col("wanted") - F.col("at"))).withColumn("draw", F.col("pass") * F.col("n") + F.col("place"))
    )
    drawn = written(drawn.select("source", "rank", "block", "pass", "take", "draw"))
    counts = plan.join(drawn.groupBy("rank").agg(F.count("*").alias("n")), "rank", "left").agg(F.expr("transform(array_sort(collect_list(struct(rank, coalesce(n, 0L) as n))), x -> x.n)").alias("counts"))
    quotas = split_counts(counts, shards, seed).select("shard", F.posexplode("counts").alias("rank", "quota"))
    ends = quotas.withColumn("end", F.sum("quota").over(W.partitionBy("rank").orderBy("shard"))).groupBy("rank").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    return drawn.join(ends, "rank").select("source", "block", "pass", "take", F.expr("size(filter(ends, e -> e <= draw))").alias("shard"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and ``parts``, the draws of the document
    as (pass, taken, shard, place in the shard's shuffle).

    A null text has no words.  A null source is a source of its own, the last one.  Documents without words are drawn
    with nothing.  Rows that repeat a doc_id are documents of their own, ordered by size.  Other columns are ignored;
    an empty table gives no rows.  The same rows give the same mix, however they are partitioned.
    """
    rows = written(sized(docs, seed))
    plan = written(targets(rows, weights, share, most))
    words = plan.agg(F.sum("source_size")).first()[0] or 0
    blocks = max(MIN_BLOCKS, -(-words // block_words))
    taken = draws(rows, plan, blocks, most, shards, seed).groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "take", "shard"))).alias("drawn"))
    in_order = W.partitionBy("source", "block").orderBy("ord", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("block", _block(blocks)).withColumn("before", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    joined = inside.alias("r").join(taken.alias("t"), (F.col("r.block") == F.col("t.block")) & F.col("r.source").eqNullSafe(F.col("t.source")), "left").select("r.*", "t.drawn")
    parts = F.expr(
        "filter(transform(coalesce(drawn, cast(array() as array<struct<pass:int,take:bigint,shard:int>>)), d -> named_struct('pass', d.pass, 'taken', greatest(0L, least(size, d.take - before)), 'shard', d.shard, 'place', xxhash64(d.pass, d.shard, ord))), p -> p.taken > 0)"
    )
    sources = plan.select(F.col("source").alias("_s"), "source_size", "target")
    return (
        joined.withColumn("parts", parts).withColumn("taken", F.expr("aggregate(parts, 0L, (a, p) -> a + p.taken)"))
        .join(F.broadcast(sources) if _few(plan) else sources, F.col("source").eqNullSafe(F.col("_s")))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "parts")
    )


def _few(plan: DataFrame, most: int = 10_000) -> bool:
    """Whether the sources may be sent to every task; else the join shuffles."""
    return plan.limit(most + 1).count() <= most


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix with all their columns, and ``shard`` and ``place``: as many rows as whole copies are
    taken, where the cut copy counts as a whole one if at least half of it is taken.  Columns of these two names are
    replaced."""
    key = lambda size: F.struct("doc_id", "source", F.col(size).alias("size"))
    nth = lambda order: F.row_number().over(W.partitionBy("_key").orderBy(order))
    plan = mix(docs, **settings).select(key("size").alias("_key"), F.expr("filter(parts, p -> 2 * p.taken >= size)").alias("_parts"))
    plan = plan.withColumn("_nth", nth("_parts")).where(F.size("_parts") > 0)
    keyed = docs.withColumn("_size", n_words_of(text_or_empty())).withColumn("_key", key("_size"))
    joined = keyed.withColumn("_nth", nth("text")).join(plan, ["_key", "_nth"])
    return joined.withColumn("_part", F.explode("_parts")).select(*[c for c in docs.columns if c not in ("shard", "place")], F.col("_part.shard").alias("shard"), F.col("_part.place").alias("place"))


def _query(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("parts")


QUERY = {"op8_mix_sources": _query}

ORACLE = {
    "op8_mix_sources": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix0' || coalesce('|' || doc_id, '')) AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [5, 2, 1][(rank % 3 + 1)::INT] AS weight, source_size * 2 AS full_size FROM r),
l AS (SELECT *, full_size / weight AS fill, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(full_size) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
      FROM w WINDOW f AS (ORDER BY full_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT arg_min(level, (fill, rank)) FILTER (WHERE full_size > weight * level) AS unit FROM l),
t AS (SELECT source, source_size, least(full_size::DOUBLE, weight * coalesce(unit, 'infinity'::DOUBLE)) AS target FROM l, u),
c AS (SELECT d.*, source_size, target, round(target)::BIGINT AS wanted,
      coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size::BIGINT AS size, source_size, target,
       (greatest(0, least(size, wanted - before)) + greatest(0, least(size, wanted - source_size - before)))::BIGINT AS taken
FROM c
"""
}
