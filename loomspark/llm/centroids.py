"""Centroid clustering: rounds of nearest centroids over integer vectors, by lookup tables.

In every round a task tabulates, for each dimension, the squared difference
of every occurring value and every centroid; a vector's distances are
then entries of these tables, added up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import blocks, decimals, exact, integers, largest, sums, whole


def _occurring(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a column, ascending, and the place of each entry's value among them."""
    low, span = int(x.min()), int(x.max()) - int(x.min())
    if span > 4 * len(x) + 4096:
        return np.unique(x, return_inverse=True)
    seen = np.zeros(span + 1, bool)
    seen[x - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[x - low]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of, and squared distance to, the nearest centroid of every row of x; of ties the smaller number."""
    most = (largest(x) + largest(centroids)) ** 2 * x.shape[1]
    kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 62 else object
    total, part = np.zeros((len(x), len(centroids)), kind), np.empty((len(x), len(centroids)), kind)
    for d in range(x.shape[1]):
        values, place = _occurring(x[:, d])
        table = values.astype(kind)[:, None] - centroids[:, d].astype(kind)[None, :]
        np.take(table * table, place, axis=0, out=part, mode="clip")
        total += part
    best = total.argmin(1)
    return best, total[np.arange(len(x)), best]


def _summed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, place, total: sums by dimension of the vectors nearest to each centroid; at place -1 their number."""

    def work(batches):
        import pyarrow as pa

        k, d = centroids.shape
        held = np.zeros((k, d + 1), object)
        for batch in batches:
            for _, x in blocks(batch.column(0)):
                best, _ = nearest(x, centroids)
                order = np.argsort(best, kind="stable")
                there, first = np.unique(best[order], return_index=True)
                held[there, 1:] += np.add.reduceat(exact(x, largest(x) * len(x))[order], first, axis=0).astype(object)
                held[there, 0] += np.diff(np.append(first, len(x)))
        for c in np.flatnonzero(held[:, 0]):
            yield pa.RecordBatch.from_pydict({"cluster": pa.array([c] * (d + 1), pa.int32()), "place": pa.array(range(-1, d), pa.int32()), "total": decimals(held[c].tolist())})

    return sums(rows.select("x").mapInArrow(work, "cluster int, place int, total decimal(38,0)"), ["cluster", "place"], "total")


def first_centroids(rows: DataFrame, id_col: str, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest sha256 of `<seed>:<id>`; fewer where there are fewer.

    Null ids come last; equal ids by their vectors.
    """
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256)
    got = rows.select(place.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).toArrow()
    return np.array([v.as_py() for v in got.column("x")], np.int64)


def cluster(df: DataFrame, id_col: str = "vec_id", col: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid of every vector of `dims` finite entries.

    Entries become integers floor(scale * c). A round assigns every vector to
    its nearest centroid (squared distance; of ties the smaller number) and moves each centroid that has
    vectors to floor(sum / count) by dimension; the others stay. After the rounds vectors are assigned once
    more. Distances and inertias are exact, decimal(38,0); null beyond 38 digits.

    Other vectors (null, of another length, with null or non-finite entries)
    give no row; repeated rows and null ids each give one. With fewer than k
    vectors each is a centroid; equal vectors may start several, of which the smaller
    number gets all. An empty table gives no rows. Of df only the id and `col` are read. The driver
    holds the centroids alone, k * dims numbers.
    """
    kept = df.filter(whole(col, dims)).select(F.col(id_col).alias("id"), integers(col, scale).alias("x"))
    kept = stored(kept, "vectors")
    centroids = first_centroids(kept, "id", k, seed).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.astype(object)
        found: dict[int, dict[int, int]] = {}
        for row in _summed(kept, centroids).toArrow().to_pylist():
            if row["total"] is None:
                raise ValueError("a sum of vectors has more than 38 digits")
            found.setdefault(row["cluster"], {})[row["place"]] = int(row["total"])
        for c, total in found.items():
            moved[c] = [total[d] // total[-1] for d in range(dims)]
        centroids = moved.astype(np.int64)

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            for rows, x in blocks(batch.column(1)):
                best, distance = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(best, pa.int32()), decimals(distance)], names=["id", "cluster", "distance"])

    kind = kept.schema["id"].dataType.simpleString()
    placed = stored(kept.select("id", "x").mapInArrow(assign, f"id {kind}, cluster int, distance decimal(38,0)"), "assigned")
    by = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    every = None if None in by.values() else sum(by.values())
    where = df.sparkSession.createDataFrame(
        [(c, by.get(c), None if every is None or every >= 10**38 else every, v) for c, v in enumerate(centroids.tolist())],
        "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<long>",
    )
    return placed.join(F.broadcast(where), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
