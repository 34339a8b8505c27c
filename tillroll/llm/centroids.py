"""Exact k-means with a LAESA pivot table.

Each component becomes a whole number, floor(scale * x).  The first centroids
also serve as the fixed pivots: every vector's distances to them are computed
once and stored beside it.  In each round the distances of the centroids to
the pivots are known too, and by the triangle inequality a centroid is at
least as far from a vector as their distances to any pivot differ.  A vector
computes exact whole squared distances only to centroids whose bound does not
exceed the best distance so far, beginning with the least bound.

Vectors and pivot distances are written once to the shared folder; a round
reads that table, adds up each task's vectors by centroid, and sends k sums to
the driver (k x components whole numbers, whatever the input), which divides
them exactly.  No group is gathered anywhere.

Defined results: vectors that are null or not of ``size`` components, or that
have a null or non-finite component or one of 2**26 or more in size after
scaling (squares would not fit 64 bits), are left out.  Rows with a null id
are clustered but are no first centroids; repeated rows are rows of their own,
and equal ids are ordered by their components.  With fewer vectors than k
there are so many centroids; an empty table gives an empty result.  Ties go to
the smaller centroid number; a centroid without vectors stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import need
from .negatives import whole_numbers

LARGEST = 1 << 26


def _vectors(q: pa.Array, size: int) -> np.ndarray:
    return q.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, to_pivot: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance, exact distances computed) of each vector's nearest centroid; ties: the smaller number."""
    k = len(centroids)
    of_pivot = np.sqrt(np.stack([squared(centroids, p) for p in pivots]).astype(float))  # pivots x centroids
    least = np.zeros((len(x), k))
    for j in range(len(pivots)):
        np.maximum(least, np.abs(to_pivot[:, j, None] - of_pivot[j][None, :]), out=least)
    least *= least * (1 - 1e-12)
    least -= 1e-3 + 1e-11 * least  # wider than square roots round
    order = np.argsort(least, axis=1, kind="stable")
    best, number = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), k)
    computed = 0
    alive = np.arange(len(x))
    for place in range(k):
        c = order[alive, place]
        alive_now = least[alive, c] <= best[alive]
        alive, c = alive[alive_now], c[alive_now]  # bounds ascend: who stops here is done
        if not len(alive):
            break
        d = squared(x[alive], centroids[c])
        computed += len(alive)
        better = (d < best[alive]) | ((d == best[alive]) & (c < number[alive]))
        best[alive[better]], number[alive[better]] = d[better], c[better]
    return number, best, computed


def first_centroids(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """Vectors of the k smallest hashes of ``seed`` and the id, in ascending order."""
    hashed = rows.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "q")
    return [r.q for r in hashed.orderBy("h", "q").limit(k).collect()]


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, size: int = 64, seed: str = "3:",
            key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance), final centroids)."""
    need(df, key, vector)
    own = df.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("_v")).where(F.size("_v") == size)
    rows = whole_numbers(own, "_v", scale, LARGEST).select("vec_id", "q")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return df.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), []
    pivots = np.array(centroids, dtype=np.int64)

    @F.arrow_udf("array<double>")
    def pivot_distances(q: pa.Array) -> pa.Array:
        x = _vectors(q, size)
        d = np.sqrt(np.stack([squared(x, p) for p in pivots], axis=1).astype(float)) if len(x) else np.empty((0, len(pivots)))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, len(pivots)), pa.int32()), pa.array(d.ravel()))

    table = cut_lineage(rows.select("vec_id", "q", pivot_distances("q").alias("to_pivot")), "laesa")

    def stored(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return _vectors(batch.column("q"), size), batch.column("to_pivot").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(pivots))

    def sums(now: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(now), np.int64), [[0] * size for _ in now]
            for batch in batches:
                x, to_pivot = stored(batch)
                number, _, _ = nearest(x, to_pivot, now, pivots)
                for c in np.unique(number):
                    mine = x[number == c]
                    n[c] += len(mine)
                    total[c] = [a + int(b) for a, b in zip(total[c], mine.sum(axis=0), strict=True)]
            used = [c for c in range(len(now)) if n[c]]
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(np.repeat(used, size), pa.int32()), "place": pa.array(np.tile(np.arange(size), len(used)), pa.int32()),
                "n": pa.array(np.repeat(n[used], size), pa.int64()), "total": pa.array([str(v) for c in used for v in total[c]], pa.string())})
        each = table.select("q", "to_pivot").mapInArrow(run, "cluster int, place int, n bigint, total string")
        return each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))

    now = pivots
    for _ in range(rounds):
        now = now.copy()
        for r in sums(now).collect():  # k x size rows
            now[r.cluster, r.place] = int(r.total) // r.n

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, best, _ = nearest(*stored(batch), now, pivots)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(best)], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"), now.tolist()


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = cut_lineage(rows, "clusters")
    inertia = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    facts = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), d) for c, d in enumerate(digests)],
                                  "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds written out one after another."""
    steps = [f"""fit AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, row_number() OVER () AS at
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS INTEGER) AS cluster, q
  FROM fit WHERE vec_id IS NOT NULL QUALIFY cluster < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT f.vec_id, f.at, f.q, c.cluster,
         CAST(list_sum(list_transform(list_zip(f.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance
  FROM fit f CROSS JOIN c{r} c
  QUALIFY row_number() OVER (PARTITION BY f.at ORDER BY distance, c.cluster) = 1)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT cluster, i, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x
  FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(n.q, c.q) AS q
  FROM c{r} c LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS q FROM s{r} GROUP BY cluster) n ON n.cluster = c.cluster)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster
"""


OP12_SQL = _op12_sql()
