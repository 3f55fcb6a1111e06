"""Batch vector search over inverted lists (TOP10 for many queries)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.filters import row_number_at_most
from larkspur.session import written

C = F.col
#: Most inverted lists, and rows of one side that are multiplied at once.
MOST_LISTS, BLOCK = 1024, 4096
#: Angles are lowered by more than the rounding errors of an arc cosine.
SLACK = 1e-6
#: Similarities are ranked to so many digits: sums of doubles differ in the last ones with their order.
DIGITS = 9
MEMBER = "memory_id long, scope string, embedding array<double>, list int, angle double"
PROBE = "query_id long, scope string, embedding array<double>, list int, asked boolean"
HIT = "query_id long, memory_id long, similarity double"


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), values.shape[1]).cast(pa.list_(pa.float64()))


def _angles(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centroids.T, -1.0, 1.0))


def unit_vectors(rows: DataFrame, key: str, dimensions: int, scope: Column) -> DataFrame:
    """(key, scope, embedding): finite vectors of the given length, scaled to norm one; others have no similarity."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda s, v: s + v * v))
    usable = rows.select(C(key).cast("long"), scope.cast("string").alias("scope"), x.alias("_x")).filter((F.size("_x") == dimensions) & F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)))
    scaled = usable.withColumn("_norm", norm).filter((C("_norm") > 0) & (C("_norm") < float("inf")))
    return scaled.select(key, "scope", F.transform("_x", lambda v: v / C("_norm")).alias("embedding"))


def inverted_lists(units: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each vector with the list of its nearest centroid and its angle to it."""
    shared = units.sparkSession.sparkContext.broadcast(centroids)  # MOST_LISTS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(_rows(batch.column(2)), shared.value)
                own = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(angles[np.arange(len(own)), own])], ["memory_id", "scope", "embedding", "list", "angle"])

    return units.mapInArrow(run, MEMBER)


def probes(queries: DataFrame, centroids: np.ndarray, sizes: np.ndarray, radius: np.ndarray, k: int, first: bool) -> DataFrame:
    """The lists that a query must look into: (query, list, asked).

    At first the nearest ones that hold k members.  Then, given the query's ``floor``, all others that may still hold a
    member at least as similar: an angle to a member is at least that to the centroid less the list's largest.
    """
    shared = queries.sparkSession.sparkContext.broadcast((centroids, sizes, radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, widest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _rows(batch.column(2))
            angles = _angles(units, own)
            order = np.argsort(angles, axis=1, kind="stable")
            before = np.cumsum(held[order], axis=1) - held[order]
            near = np.zeros(angles.shape, bool)
            np.put_along_axis(near, order, before < k, axis=1)
            if first:
                wanted = near
            else:
                floor = np.arccos(np.clip(batch.column(3).to_numpy(), -1.0, 1.0))
                wanted = ~near & (angles - widest[None, :] - SLACK <= floor[:, None])
            row, at = np.nonzero(wanted & (held[None, :] > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), _lists(units[row]) if len(row) else pa.array([], pa.list_(pa.float64())), pa.array(at, pa.int32()), pa.array(np.full(len(row), first))], ["query_id", "scope", "embedding", "list", "asked"])

    return queries.mapInArrow(run, PROBE)


def score_blocks(asked: DataFrame, members: DataFrame, *, k: int, threshold: float, scoped: bool) -> DataFrame:
    """The k best members of each query within each block, by dot products of blocks.

    Members and queries of a list are dealt over blocks of about ``BLOCK`` rows, so a list that holds much or that all
    queries ask for is many groups.
    """
    blocks = lambda n: F.greatest(F.ceil(C(n) / BLOCK), F.lit(1)).cast("int")
    counts = members.groupBy("list").agg(F.count("*").alias("_m")).join(asked.groupBy("list").agg(F.count("*").alias("_q")), "list").select("list", blocks("_m").alias("_mb"), blocks("_q").alias("_qb"))
    key = ["list", "_i", "_j"]
    left = asked.join(counts, "list").withColumn("_j", F.pmod(F.xxhash64("query_id"), "_qb").cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), C("_mb") - 1)))
    right = members.join(counts, "list").withColumn("_i", F.pmod(F.xxhash64("memory_id"), "_mb").cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), C("_qb") - 1)))

    def run(q: pa.Table, m: pa.Table) -> pa.Table:
        found = []
        if q.num_rows and m.num_rows:
            similar = np.round(_rows(q.column("embedding").combine_chunks()) @ _rows(m.column("embedding").combine_chunks()).T, DIGITS)
            fits = similar > threshold
            if scoped:
                one, two = (t.column("scope").to_numpy() for t in (q, m))
                fits &= one[:, None] == two[None, :]
            ids = m.column("memory_id").to_numpy()
            for row in range(q.num_rows):
                at = np.flatnonzero(fits[row])
                found.append(at[np.lexsort((ids[at], -similar[row, at]))[:k]])
            n = [len(at) for at in found]
            at = np.concatenate(found)
            row = np.repeat(np.arange(len(n)), n)
            return pa.table({"query_id": q.column("query_id").to_numpy()[row], "memory_id": ids[at], "similarity": similar[row, at]})
        return pa.table({"query_id": pa.array([], pa.int64()), "memory_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})

    return left.select("query_id", "scope", "embedding", *key).groupBy(*key).cogroup(right.select("memory_id", "scope", "embedding", *key).groupBy(*key)).applyInArrow(run, HIT)


def vector_topk_batch(memories: DataFrame, queries: DataFrame, *, now: Column, threshold: float, k: int, dimensions: int, scope: str | None = None, category: str | None = None) -> DataFrame:
    """(query_id, memory_id, similarity, rank): per query the k most similar unexpired memories above the threshold.

    ``queries`` has (query_id, embedding) and, if a ``scope`` column is named, that column as well: only memories of the
    query's own scope count.  Vectors go into lists by their nearest coarse centroid, a sample of at most
    ``MOST_LISTS``.  A query looks into its nearest lists first; the similarity of its k-th hit then rules out lists whose
    members all lie at too wide an angle, and the rest are looked into as well, so nothing is missed.  Equal
    similarities (to 9 digits) rank by id.  Vectors without the given length, with nulls or without a norm are left out.
    """
    if scope:  # a null scope is nobody's own
        memories, queries = memories.filter(C(scope).isNotNull()), queries.filter(C(scope).isNotNull())
    live = memories.filter(C("expires_at").isNull() | (C("expires_at") > now))
    if category is not None:
        live = live.filter(C("category") == category)
    own_scope = C(scope) if scope else F.lit(None)
    units = written(unit_vectors(live, "memory_id", dimensions, own_scope))
    asked = written(unit_vectors(queries, "query_id", dimensions, own_scope))
    n = min(MOST_LISTS, math.isqrt(units.count()) + 1)
    centroids = np.array([r.embedding for r in units.orderBy(F.xxhash64("memory_id"), "memory_id").limit(n).select("embedding").collect()]).reshape(-1, dimensions)
    members = written(inverted_lists(units, centroids)) if len(centroids) else units.sparkSession.createDataFrame([], MEMBER)
    sizes, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in members.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).collect():  # a row a list
        sizes[r.list], radius[r.list] = r.n, r.widest
    limits = {"k": k, "threshold": threshold, "scoped": scope is not None}
    best = [C("similarity").desc(), C("memory_id").asc()]
    near = written(row_number_at_most(score_blocks(probes(asked, centroids, sizes, radius, k, True), members, **limits), ["query_id"], best, k)) if len(centroids) else members.select(C("memory_id").alias("query_id"), "memory_id", C("angle").alias("similarity"))
    full = near.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("similarity").alias("floor")).filter(C("_n") >= k).select("query_id", "floor")
    bounded = asked.join(full, "query_id", "left").select("query_id", "scope", "embedding", F.coalesce("floor", F.lit(threshold)).alias("floor"))
    far = score_blocks(probes(bounded, centroids, sizes, radius, k, False), members, **limits) if len(centroids) else near
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)))
    return ranked.filter(C("rank") <= k)
