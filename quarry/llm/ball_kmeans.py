"""Centroid clustering by ball k-means.

A cluster is a ball: its centroid and the radius that its farthest member gives it. In a round each member's distance
to its own moved centroid is found first. By the triangle inequality another centroid j can be as near to a member x of
cluster c only if |c - j| <= 2 |x - c|: so the neighbours of a ball are the centroids within twice its radius, and the
halves of their distances, in order, cut it into a stable core, whose members stay without any comparison, and annuli,
whose members meet the nearest neighbours only, as many as the annulus tells. All of it is exact: components are
integers, distances squared integers, and bounds compare squares.

Centroids and radii are broadcast, k of each, whatever the table's size. Tasks add their members up for each cluster
before the shuffle, so a cluster, or a vector, with a third of the rows costs no more than others. Vectors stay where
they are; each round writes them once with their cluster, as small integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vector_codes import exact, integers
from .vectors import matrix

CLUSTERS, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
#: Vectors that are compared at once.
AT_ONCE = 8192

_STATE = "vec_id long, v array<long>, cluster int, distance long, compared int"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    diff = x - c
    return (diff * diff).sum(axis=1)


def nearest_of_all(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) by all distances: where no ball is known yet."""
    d = np.stack([squared(x, c) for c in centroids], axis=1)
    near = d.argmin(axis=1)
    return near, d[np.arange(len(x)), near]


class Balls:
    """Centroids with squared radii, and the neighbours of each, nearest first."""

    def __init__(self, centroids: np.ndarray, radii: dict[int, int]) -> None:
        self.centroids = centroids
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        for c in range(len(centroids)):
            d = squared(centroids, centroids[c])
            ours = np.flatnonzero(d <= 4 * radii.get(c, -1))
            ours = ours[ours != c]
            ours = ours[np.argsort(d[ours], kind="stable")]
            self.near.append((ours, d[ours]))

    def settle(self, x: np.ndarray, cluster: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance, comparisons) of members, given their cluster and their distance to it."""
        new, least, compared = cluster.copy(), own.copy(), np.zeros(len(x), np.int32)
        for c in np.unique(cluster):
            others, apart = self.near[c]
            mine = np.flatnonzero(cluster == c)
            annulus = np.searchsorted(apart, 4 * own[mine], side="right")  # how many neighbours may be as near: 0 in the core
            compared[mine] = annulus
            for t, j in enumerate(others[: annulus.max(initial=0)]):
                at = mine[annulus > t]
                d = squared(x[at], self.centroids[j])
                wins = (d < least[at]) | ((d == least[at]) & (j < new[at]))
                new[at[wins]], least[at[wins]] = j, d[wins]
        return new, least, compared


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, len(batch), AT_ONCE):
            part = batch.slice(i, AT_ONCE)
            yield part, exact(matrix(part.column("v"), np.int64))


def _state(part: pa.RecordBatch, cluster: np.ndarray, distance: np.ndarray, compared: np.ndarray) -> pa.RecordBatch:
    columns = [part.column("vec_id"), part.column("v"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(compared.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "distance", "compared"])


def _first(centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _pieces(batches):
            cluster, distance = nearest_of_all(x, centroids.value)
            yield _state(part, cluster, distance, np.full(len(x), len(centroids.value)))

    return run


def _reassigned(balls):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _pieces(batches):
            cluster = part.column("cluster").to_numpy().astype(np.int64)
            yield _state(part, *balls.value.settle(x, cluster, squared(x, balls.value.centroids[cluster])))

    return run


def _sums(k: int):
    """Each task's number and sum of members by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), None
        for part, x in _pieces(batches):
            s = np.zeros((k, x.shape[1]), np.int64) if s is None else s
            cluster = part.column("cluster").to_numpy()
            np.add.at(s, cluster, x)
            n += np.bincount(cluster, minlength=k)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[has]), pa.array([s[c].tolist() for c in has], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _radii(centroids):
    """Each task's farthest member of each cluster, squared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.full(len(centroids.value), -1, np.int64)
        for part, x in _pieces(batches):
            cluster = part.column("cluster").to_numpy()
            np.maximum.at(far, cluster, squared(x, centroids.value[cluster]))
        has = np.flatnonzero(far >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(far[has])], names=["cluster", "radius"])

    return run


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at their members' floored means; one without members stays."""
    sums = state.select("v", "cluster").mapInArrow(_sums(len(centroids)), "cluster int, n long, sums array<long>")
    merged = sums.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    new = centroids.copy()
    for c, at, n, s in merged.collect():  # k * width rows
        new[c, at] = s // n
    return new


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared for each vector of `width` components.

    Vectors that are null, of another length or with a component that is null or not finite are left out. Centroids
    start at the k vectors with the smallest sha256 of `1:<vec_id>`; rows of one id by their vectors, rows with a null
    id last. With fewer than k vectors there are as many centroids. Repeated rows are all clustered, and equal ones
    that start two centroids go to the one with the smaller number. Distances are squared; `compared` tells with how
    many centroids the last assignment compared a vector besides its own. Other columns are not used. Components too
    large for exact sums are an error. Empty input gives an empty result.
    """
    spark = vectors.sparkSession
    rows = integers(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding")).where(F.size(vec_col) == width), "embedding", scale)
    rows = written(rows.select("vec_id", "v"), "vectors-as-integers")
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("v", hashed.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared int")
    centroids = exact(np.array([r["v"] for r in first], np.int64))
    send = spark.sparkContext.broadcast

    state = written(rows.mapInArrow(_first(send(centroids)), _STATE), "clusters")
    for _ in range(rounds):
        centroids = moved(state, centroids)
        found = state.select("v", "cluster").mapInArrow(_radii(send(centroids)), "cluster int, radius long")
        radii = {r["cluster"]: r["radius"] for r in found.groupBy("cluster").agg(F.max("radius").alias("radius")).collect()}
        state = written(state.select("vec_id", "v", "cluster").mapInArrow(_reassigned(send(Balls(centroids, radii))), _STATE), "clusters")
    inertia = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    of = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])[F.col("cluster")]
    return state.select(
        "vec_id", "cluster", "distance", of([inertia.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids], "string").alias("centroid_sha256"), "compared",
    )
