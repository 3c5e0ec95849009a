"""Clusters around integer centroids: Lloyd's rounds with Hamerly's two bounds a vector.

A work table holds for each vector its cluster, an upper bound of the distance to its own
centroid and a lower bound of the distance to the second nearest. After centroids moved, the
upper bound grows by what the own centroid drifted, the lower one shrinks by the largest drift of
another. While the upper bound is below the lower one, or below half the way from the own centroid
to the next, the vector can't have changed. Else the upper bound is made exact, and if that doesn't
tell, the vector is ambiguous and gets an exact scan in integers over all centroids, ties to
the smaller number. Bounds are doubles and are rounded outwards, so that a tie is always ambiguous.

A round is a map over the table and an aggregation to one row of sums a cluster and task; only the
centroids (``k`` rows) come to the driver and go out with the tasks. A vector that very many rows
repeat is partially aggregated like all others.

Nulls and odd input: vectors that are null, have another number of components than ``dims``, a component
that is null, NaN or infinite, or one that scales beyond ``vectors.LARGEST`` (its squared distance is no long) are left out. Rows
without vec_id are clustered but start no centroid; repeated rows count each. Equal hashes start in order of the vector. With fewer vectors than
``k`` there are as many clusters as vectors. An empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import discard, partitions, written
from corpuslake.llm.vectors import matrix, squared_distances, usable, whole

#: How much wider a bound is made for what doubles round off.
_WIDER = 1e-9


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + _WIDER) + _WIDER


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - _WIDER) - _WIDER, 0)


def scanned(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance to it, squared distance to the second nearest), exactly."""
    far = squared_distances(v, centroids)
    near = far.argmin(axis=1)  # the first of equal ones
    rows = np.arange(len(v))
    least = far[rows, near]
    far[rows, near] = np.iinfo(np.int64).max
    return near, least, far.min(axis=1, initial=np.iinfo(np.int64).max)


def half_ways(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one."""
    between = squared_distances(centroids, centroids).astype(float)
    np.fill_diagonal(between, np.inf)
    return _down(np.sqrt(between.min(axis=1)) / 2)


def drifts(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and for each the farthest that another one did."""
    moved = _up(np.sqrt(((new - old) ** 2).sum(axis=1).astype(float)))
    others = np.array([np.delete(moved, j).max(initial=0) for j in range(len(moved))])
    return moved, others


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray, others: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, vectors scanned in full) after the centroids moved."""
    cluster, upper, lower = cluster.copy(), _up(upper + moved[cluster]), _down(lower - others[cluster])
    least = np.maximum(lower, half[cluster])
    open_ = np.flatnonzero(upper >= least)
    gap = v[open_] - centroids[cluster[open_]]
    upper[open_] = _up(np.sqrt((gap * gap).sum(axis=1).astype(float)))
    open_ = open_[upper[open_] >= least[open_]]
    if len(open_):
        cluster[open_], near, second = scanned(v[open_], centroids)
        upper[open_], lower[open_] = _up(np.sqrt(near.astype(float))), _down(np.sqrt(second.astype(float)))
    return cluster, upper, lower, len(open_)


_STATE = "vec_id long, v array<int>, cluster int, upper double, lower double"


def _first(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), centroids.shape[1])
            cluster, near, second = scanned(v, centroids)
            bounds = _up(np.sqrt(near.astype(float))), _down(np.sqrt(second.astype(float)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), *map(pa.array, bounds)], names=["vec_id", "v", "cluster", "upper", "lower"])

    return run


def _next(old: np.ndarray, new: np.ndarray):
    moved, others = drifts(old, new)
    half = half_ways(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), new.shape[1])
            at, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
            cluster, upper, lower, _ = assign(v, at, upper, lower, new, moved, others, half)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)], names=["vec_id", "v", "cluster", "upper", "lower"])

    return run


def _last(old: np.ndarray, new: np.ndarray):
    step = _next(old, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in step(batches):
            gap = matrix(batch.column("v"), new.shape[1]) - new[batch.column("cluster").to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array((gap * gap).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    return run


def _means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors, exactly; a cluster without vector keeps its centroid."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(before.shape[1])]
    out = before.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row a cluster
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(before.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2") -> DataFrame:
    """One row per vector kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids start as the ``k`` vectors with the smallest hex sha256 of ``salt:vec_id``.
    """
    spark = vectors.sparkSession
    kept = vectors.filter(usable(F.col("embedding")) & (F.size("embedding") == dims)).select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("v"))
    hashed = kept.filter("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "v")
    start = [row["v"] for row in hashed.orderBy("h", "v").limit(k).collect()]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], schema)
    now = np.array(start, np.int64)
    state = written(kept.repartition(partitions(spark)).mapInArrow(_first(now), _STATE), "clusters")
    for turn in range(rounds):
        old, now = now, _means(state, now)
        if turn + 1 < rounds:
            before, state = state, written(state.mapInArrow(_next(old, now), _STATE), "clusters")
            discard(before)
    if not rounds:
        old = now
    final = written(state.mapInArrow(_last(old, now), "vec_id long, cluster int, distance long"), "clustered")
    discard(state)
    sums = {row["cluster"]: row["s"] for row in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = {j: hashlib.sha256(",".join(map(str, now[j].tolist())).encode()).hexdigest() for j in sums}
    facts = spark.createDataFrame([(j, s, sum(sums.values()), digest[j]) for j, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
