"""Centroids of vectors in whole numbers, nearest ones found by the threshold algorithm.

For each dimension the centroids are listed in the order of their values there. A vector walks each
list outward from its own value, one centroid of each list at a time; a centroid met for the first
time, in whatever list, is compared in full, with an exact squared distance. A centroid that no list
has come to yet is at least as far in every dimension as that list's frontier, so its distance is at
least the sum of the squared frontier distances. The walk ends when this sum strictly exceeds the
best distance so far, or when no centroid is left to meet; at an equal sum it goes on, so that ties
fall to the smaller number.

The lists are sorted by the driver from the centroids, whose number is a parameter. Vectors are
read once in each round; tasks add up their vectors and the driver gets a row for each centroid
component.

Rows whose vector is null, has another number of components than ``dims``, or holds null or
non-finite ones are left out. The first centroids are the vectors of the smallest hashes of their
ids; null ids come behind all others and rows of equal id in the order of their vectors. With fewer
rows than centroids there are as many centroids as rows. Repeated rows count as often as they come.
An empty table, or one in which no row counts, gives an empty result; columns other than id and
vector aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import Scratch, map_batches
from rillframe.llm.vectors import digest, floor_means, integer_row, integers, kept_vectors

DIMS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Distances of this size stand for the end of a list.
_END = np.int64(1) << 29


class Lists:
    """The centroids' values in each dimension, in order, with the centroids that have them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")  # [place, dimension]
        self.values = np.take_along_axis(centroids, self.order, 0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of ``x`` the nearest centroid (ties: the smaller number), its squared
        distance, and how many centroids were compared in full."""
        n, dims = x.shape
        k = len(self.centroids)
        best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        seen = np.zeros((n, k), bool)
        column = np.arange(dims)
        right = (self.values[None, :, :] < x[:, None, :]).sum(1)  # the first place at or above the value
        left = right - 1
        rows = np.arange(n)
        while len(rows):
            value, low, high = x[rows], left[rows], right[rows]
            down = np.where(low >= 0, value - self.values[np.maximum(low, 0), column], _END)
            up = np.where(high < k, self.values[np.minimum(high, k - 1), column] - value, _END)
            take_down = down <= up
            frontier = np.where(take_down, down, up)
            met = self.order[np.where(take_down, np.maximum(low, 0), np.minimum(high, k - 1)), column]
            left[rows], right[rows] = low - take_down, high + ~take_down
            fresh = np.zeros((len(rows), k), bool)
            fresh[np.arange(len(rows))[:, None], met] = True
            fresh &= ~seen[rows]
            seen[rows] |= fresh
            for j in range(k):
                own = rows[fresh[:, j]]
                if not len(own):
                    continue
                d = x[own] - self.centroids[j]
                d = np.einsum("ij,ij->i", d, d)
                wins = (d < best[own]) | ((d == best[own]) & (j < at[own]))
                best[own[wins]], at[own[wins]] = d[wins], j
            bound = np.einsum("ij,ij->i", frontier, frontier)
            rows = rows[~((bound > best[rows]) | seen[rows].all(1))]
        return at, best, seen.sum(1)


def train(rows: DataFrame, dims: int = DIMS, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The centroids [number, component] of rows with ``id`` and ``v``; none without rows."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256).alias("h")
    first = rows.select(key, "id", "v").orderBy(F.asc_nulls_last("h"), "v").limit(centroids).collect()
    held = np.stack([integer_row(r.v, scale) for r in first]) if first else np.empty((0, dims), np.int64)
    for _ in range(rounds if first else 0):
        lists = Lists(held)

        def cells(x: np.ndarray, lists: Lists = lists) -> np.ndarray:
            return lists.nearest(x)[0][:, None] * dims + np.arange(dims)

        means = floor_means(rows, dims, scale, held.size, cells)
        held = np.array([old if new is None else new for old, new in zip(held.ravel().tolist(), means, strict=True)], np.int64).reshape(held.shape)
    return held


def assigned(rows: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``id``, ``cluster`` and the squared ``distance`` of rows with ``id`` and ``v``."""
    lists = Lists(centroids)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, distance, _ = lists.nearest(integers(batch.column("v"), centroids.shape[1], scale))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return map_batches(rows.select("id", "v"), run, "id bigint, cluster int, distance bigint", 4096)


def cluster(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dims: int = DIMS, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """A row for each row that counts: id, ``cluster``, squared ``distance``, ``cluster_inertia``
    and ``inertia`` (distances summed over the cluster and over all) and ``centroid_sha256`` of the
    cluster's centroid."""
    spark = df.sparkSession
    rows = kept_vectors(df, id_column, vector, dims)
    held = train(rows, dims, centroids, rounds, scale, seed)
    found = Scratch(spark).save(assigned(rows, held, scale), "clusters") if len(held) else rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).where("false")
    # One row for each centroid at most: the driver holds the centroids themselves already.
    totals = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    of = [(j, totals[j], sum(totals.values()), digest(held[j])) for j in sorted(totals)]
    by = spark.createDataFrame(of, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(by), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: clusters of every row of ``embeddings`` that counts."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The contract's rounds as SQL over one row for each component."""
    floor = "(s - ((s % n) + n) % n) // n"
    sql = [
        f"""WITH v AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {DIMS} AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
x AS MATERIALIZED (SELECT vec_id, i AS k, CAST(floor({SCALE} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT vec_id, e, unnest(range(1, {DIMS} + 1)) AS i FROM v)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS j FROM v QUALIFY j < {CENTROIDS}),
b0 AS MATERIALIZED (SELECT j, k, x AS b FROM x JOIN f USING (vec_id))"""
    ]
    for r in range(ROUNDS + 1):
        sql.append(f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(j, (d, j)) AS j, CAST(min(d) AS BIGINT) AS d FROM (SELECT vec_id, j, sum((x - b) * (x - b)) AS d FROM x JOIN b{r} USING (k) GROUP BY ALL) GROUP BY ALL)")
        if r < ROUNDS:
            sql.append(f"m{r} AS (SELECT j, k, {floor} AS b FROM (SELECT j, k, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id) GROUP BY ALL))")
            sql.append(f"b{r + 1} AS MATERIALIZED (SELECT j, k, coalesce(m.b, o.b) AS b FROM b{r} o LEFT JOIN m{r} m USING (j, k))")
    sql.append(f"h AS (SELECT j, sha256(string_agg(CAST(b AS VARCHAR), ',' ORDER BY k)) AS centroid_sha256 FROM b{ROUNDS} GROUP BY j)")
    return ",\n".join(sql) + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN h USING (j)"""


ORACLE = _oracle()
