"""Centroid clustering with Ptolemaic pivots.

Some starting centroids, far apart, are fixed as pivots, and each vector's distances to them are kept beside it.  For any
two pivots p and s, Ptolemy's inequality bounds the distance of a vector x from a centroid c from below:
d(x, c) d(p, s) >= |d(x, p) d(c, s) - d(x, s) d(c, p)|.  The centroid of the smallest bound is measured first; others are
measured, in exact integers, only if their bound, lowered by more than the rounding errors, does not exceed the best so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import written

SCALE, DIMENSIONS = 256, 64
#: Larger components are not kept: squared distances would not fit into a long.
LARGEST = 1 << 19
PIVOTS = 6
#: Vectors looked at together.
ROWS = 4096
#: Relative errors of a bound are a few times 2^-52; it is lowered, and the distance it must exceed raised, by more.
SLACK = 1e-12
KEPT_SCHEMA = "vec_id long, vec array<int>, pivot_distances array<double>"
SUM_SCHEMA = "cluster int, n long, sums array<long>"
ASSIGNED_SCHEMA = "vec_id long, cluster int, distance long"


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): the vectors of 64 finite components, each as floor(256 x)."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fits = (F.size(x) == DIMENSIONS) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= -LARGEST) & (v < LARGEST))
    return vectors.filter(F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v * SCALE).cast("int")).alias("vec"))


def starting_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hashes of ``seed:vec_id``; of equal ids the smaller vectors, a null id counts as empty text."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(name.alias("name"), "vec").orderBy("name", "vec").limit(k).collect()  # k rows
    return np.array([r.vec for r in rows], np.int64).reshape(-1, DIMENSIONS)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; components are below 2^27."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def choose_pivots(centroids: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to n distinct centroids, each the farthest from those before it."""
    chosen = [0]
    nearest = squared(centroids, centroids[0])
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(centroids, centroids[chosen[-1]]))
    return centroids[chosen]


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(vectors, p) for p in pivots], axis=1).astype(np.float64))


@dataclass
class Round:
    """Centroids of a round with all that the bounds need of them."""

    centroids: np.ndarray
    own: np.ndarray  # their distances to the pivots
    first: np.ndarray  # pivot pairs
    second: np.ndarray
    between: np.ndarray  # distance of each pair


def make_round(centroids: np.ndarray, pivots: np.ndarray) -> Round:
    first, second = np.triu_indices(len(pivots), 1)
    return Round(centroids, pivot_distances(centroids, pivots), first, second, np.sqrt(squared(pivots[first], pivots[second]).astype(np.float64)))


def lower_bounds(r: Round, near: np.ndarray) -> np.ndarray:
    """Squared lower bounds (vectors x centroids), rounded down."""
    best = np.zeros((len(near), len(r.centroids)))
    for p, s, d in zip(r.first, r.second, r.between):
        a, b = np.outer(near[:, p], r.own[:, s]), np.outer(near[:, s], r.own[:, p])
        np.maximum(best, (np.abs(a - b) - SLACK * (a + b)) / d, out=best)
    return best * best * (1 - SLACK)


def assign(r: Round, vectors: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (of equals the smaller number), its squared distance, and how many distances were measured."""
    bounds = lower_bounds(r, near)
    cluster = bounds.argmin(axis=1)
    distance = squared(vectors, r.centroids[cluster])
    tried, measured = cluster.copy(), len(vectors)
    for c, centroid in enumerate(r.centroids):
        rows = np.flatnonzero((bounds[:, c] <= distance * (1 + SLACK)) & (tried != c))
        if len(rows):
            d = squared(vectors[rows], centroid)
            measured += len(rows)
            better = (d < distance[rows]) | ((d == distance[rows]) & (c < cluster[rows]))
            cluster[rows[better]], distance[rows[better]] = c, d[better]
    return cluster, distance, measured


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray | None]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            vectors = part.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, DIMENSIONS)
            yield part.column(0), vectors, part.column(2).flatten().to_numpy().reshape(len(vectors), -1) if part.num_columns > 2 else None


def _with_pivots(kept: DataFrame, pivots) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors, _ in _parts(batches):
            near = pivot_distances(vectors, pivots.value)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(kind)) for x, kind in ((vectors.astype(np.int32), pa.int32()), (near, pa.float64()))]
            yield pa.RecordBatch.from_arrays([ids, *lists], ["vec_id", "vec", "pivot_distances"])

    return kept.mapInArrow(run, KEPT_SCHEMA)


def _sums(kept: DataFrame, step) -> dict[tuple[int, int], tuple[int, int]]:
    """(cluster, component) -> (count, sum); tasks add up their vectors first, so k rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(step.value.centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, DIMENSIONS), np.int64)
        for _, vectors, near in _parts(batches):
            cluster = assign(step.value, vectors, near)[0]
            n += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, vectors)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    wide = F.col("sum").cast("decimal(38,0)")
    rows = kept.mapInArrow(run, SUM_SCHEMA).select("cluster", "n", F.posexplode("sums").alias("component", "sum")).groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum(wide).alias("sum")).collect()
    return {(r.cluster, r.component): (int(r.n), int(r.sum)) for r in rows}  # k x 64 entries


def _assigned(kept: DataFrame, step) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors, near in _parts(batches):
            cluster, distance, _ = assign(step.value, vectors, near)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, ASSIGNED_SCHEMA)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors without exactly 64 finite components, and those with a component of 2^19 or more in size, are left out.  Rows
    are taken as they come: repeated rows count as often as they are there, a null id stays null.  With fewer than k kept
    vectors there are as many clusters; without any there are no rows.  Empty clusters keep their centroid.  Other
    columns are ignored.  Inertias beyond a long are null.
    """
    spark = vectors.sparkSession
    whole = integer_vectors(vectors)
    centroids = starting_centroids(whole, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], ASSIGNED_SCHEMA + ", cluster_inertia long, inertia long, centroid_sha256 string")
    pivots = choose_pivots(centroids)
    share = spark.sparkContext.broadcast  # k vectors and a few pivots
    kept = written(_with_pivots(whole, share(pivots)))
    for _ in range(rounds):
        sums = _sums(kept, share(make_round(centroids, pivots)))
        centroids = centroids.copy()
        for (c, component), (n, total) in sums.items():
            centroids[c, component] = total // n
    rows = written(_assigned(kept, share(make_round(centroids, pivots))))
    inertia = {r.cluster: int(r.inertia) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    total = sum(inertia.values())
    fits = lambda v: v if v < 1 << 63 else None
    facts = [(c, fits(v), fits(total), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, v in inertia.items()]
    own = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


QUERY = {"op11_centroid_clustering": lambda spark, sf_dir: cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))}


def _oracle(k: int = 40, rounds: int = 5) -> str:
    near = "SELECT r, min(d) AS distance, arg_min(cluster, d * 64 + cluster) AS cluster FROM (SELECT v.r, c.cluster, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.vec[i] - c.vec[i]) * (v.vec[i] - c.vec[i]))) AS BIGINT) AS d FROM v, {c} c) GROUP BY r"
    steps = []
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED ({near.format(c=f"c{i}")}),
s{i} AS (SELECT a.cluster, u.i, sum(v.vec[u.i]) AS s, count(*) AS n FROM a{i} a JOIN v USING (r), range(1, 65) u(i) GROUP BY a.cluster, u.i),
m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS vec FROM s{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.vec, c.vec) AS vec FROM c{i} c LEFT JOIN m{i} m USING (cluster))""")
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE len(embedding) = 64),
v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(x, lambda a: CAST(floor(256 * a) AS BIGINT)) AS vec
    FROM e WHERE len(list_filter(x, lambda a: a IS NOT NULL AND isfinite(a))) = 64
),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, vec
    FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, vec FROM v ORDER BY h LIMIT {k})
),
{", ".join(steps)},
a AS MATERIALIZED ({near.format(c=f"c{rounds}")})
SELECT v.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.vec, ',')) AS centroid_sha256
FROM a JOIN v USING (r) JOIN c{rounds} c ON c.cluster = a.cluster
"""


ORACLE = {"op11_centroid_clustering": _oracle()}
