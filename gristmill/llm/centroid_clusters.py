"""K-means over integer vectors by exponion search.

Vectors are scaled to integers, so that distances, sums and centroids are exact and reruns agree.
Each vector keeps its centroid, an upper bound of its distance to it and a lower bound of its distance
to the second nearest. A vector whose upper bound lies below the lower bound, or below half the way
from its centroid to the nearest other one, keeps its centroid unscanned. Otherwise the upper bound is
tightened to the true distance, and only centroids inside the ball of radius ``2 u + s`` around
the vector's centroid are scanned, where s is that centroid's distance to its nearest neighbour; the ball
holds the nearest and the second nearest. These are a prefix of the centroid's list of others, sorted by
distance. Strict bounds and the inclusive radius keep ties, which go to the smaller number.

A round is one pass of Spark tasks over the written vectors, which writes their new state and, for each
task and cluster, the count and the sums of its vectors; Spark adds these up, and only clusters times
dimensions numbers reach the driver, which sends the centroids out again. Bounds are doubles, rounded
to the safe side; decisions between centroids compare whole squared distances.

Defined cases: vectors that are null, of another length, or with null or non-finite components are left out; with fewer than ``clusters`` kept vectors each is a centroid at first; equal centroids leave the
larger number empty, which stays where it is; null ids hash as empty; repeated rows are
vectors like others; no kept vectors give no rows; extra columns are ignored. A scaled component with
which a squared distance could pass 64 bits (beyond 189,812,531 for 64 dimensions) is refused.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Relative slack of a bound, far above the rounding of a square root.
SLACK = 1e-12


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, vector) of the rows whose vector has ``dimensions`` finite components, each floor(scale * x)."""
    largest = math.isqrt(((1 << 63) - 1) // dimensions) // 2
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter((F.size("vector") == dimensions) & F.forall("vector", finite))
    whole = lambda x: F.when(F.abs(x * scale) < largest, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a scaled component is beyond {largest}")).cast("bigint"))
    return kept.select("id", F.transform("vector", lambda x: whole(x).cast("int")).alias("vector"))


class Centroids:
    """Centroids of one round: their distances to each other, each one's others sorted by distance, and how far they moved."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None):
        self.points = points.astype(np.int64)
        k = len(points)
        squares = np.stack([squared(self.points, p) for p in self.points])
        away = np.sqrt(squares.astype(float))
        away[np.arange(k), np.arange(k)] = -1  # itself comes first in its own list
        self.order = np.argsort(away, axis=1, kind="stable")
        self.sorted = np.take_along_axis(away, self.order, axis=1)[:, 1:] * (1 - SLACK)
        self.order = self.order[:, 1:]
        self.nearest = self.sorted[:, 0] if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((self.points - before) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
        self.moved = moved
        others = np.sort(moved)[::-1]
        self.others = np.where(np.arange(k) == np.argmax(moved), others[1] if k > 1 else 0.0, others[0])


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Whole squared distances, dimension by dimension, without a copy of all differences."""
    out = np.zeros(len(vectors), np.int64)
    for j in range(vectors.shape[1]):
        out += (vectors[:, j].astype(np.int64) - point[j]) ** 2
    return out


def nearest(vectors: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """First assignment, over all centroids: number, upper and lower bound; and the distances computed."""
    rows = len(vectors)
    best, second, number = np.full(rows, np.iinfo(np.int64).max), np.full(rows, np.iinfo(np.int64).max), np.zeros(rows, np.int32)
    for k in range(len(c.points)):
        _offer(best, second, number, np.arange(rows), squared(vectors, c.points[k]), k)
    return number, _up(best), _down(second), rows * len(c.points)


def exponion(vectors: np.ndarray, number: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Assignment after the centroids moved: number, upper and lower bound; and the distances computed."""
    number, upper, lower = number.copy(), upper + c.moved[number], np.maximum(lower - c.others[number], 0)
    open_rows = np.flatnonzero(upper >= np.maximum(lower, c.nearest[number] / 2))
    scanned = len(open_rows)
    own = np.zeros(len(number), np.int64)
    for k in np.unique(number[open_rows]):
        rows = open_rows[number[open_rows] == k]
        own[rows] = squared(vectors[rows], c.points[k])
    upper[open_rows] = _up(own[open_rows])
    open_rows = open_rows[upper[open_rows] >= np.maximum(lower[open_rows], c.nearest[number[open_rows]] / 2)]
    around = number[open_rows]
    for k in np.unique(around):
        rows = open_rows[around == k]
        reach = (2 * upper[rows] + c.nearest[k]) * (1 + SLACK)
        inside = np.searchsorted(c.sorted[k], reach, side="right")  # inclusive
        best, second, now = own[rows], np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), k, np.int32)
        for turn in range(int(inside.max(initial=0))):
            some = np.flatnonzero(inside > turn)
            scanned += len(some)
            _offer(best, second, now, some, squared(vectors[rows[some]], c.points[c.order[k, turn]]), int(c.order[k, turn]))
        number[rows], upper[rows], lower[rows] = now, _up(best), _down(second)
    return number, upper, lower, scanned


def _offer(best: np.ndarray, second: np.ndarray, number: np.ndarray, rows: np.ndarray, away: np.ndarray, k: int) -> None:
    """Take centroid ``k`` for ``rows`` where it is nearer, or as near with a smaller number."""
    was = best[rows]
    wins = (away < was) | ((away == was) & (k < number[rows]))
    second[rows] = np.minimum(second[rows], np.where(wins, was, away))
    best[rows], number[rows] = np.where(wins, away, was), np.where(wins, k, number[rows])


def _up(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float)) * (1 + SLACK)


def _down(squares: np.ndarray) -> np.ndarray:
    return np.where(squares == np.iinfo(np.int64).max, np.inf, np.sqrt(squares.astype(float)) * (1 - SLACK))


STATE = "id {id}, vector array<int>, number int, upper double, lower double, members long, sums array<bigint>, scanned long"


def _rows_of(lists: pa.Array, dimensions: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _round(dimensions: int, c: Centroids, first: bool):
    """Task function of a round: the vectors' new state, then a row for each cluster with its count and sums in this task."""

    def run(batches):
        k = len(c.points)
        members, sums, scans, ids = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = batch.column(0).type, _rows_of(batch.column(1), dimensions)
            if first:
                number, upper, lower, n = nearest(vectors, c)
            else:
                number, upper, lower, n = exponion(vectors, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)), c)
            scans += n
            members += np.bincount(number, minlength=k)
            for j in np.unique(number):
                sums[j] += vectors[number == j].sum(axis=0, dtype=np.int64)
            rows = batch.num_rows
            yield _state(batch.column(0), batch.column(1), number, upper, lower, pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.list_(pa.int64())), pa.nulls(rows, pa.int64()))
        if ids is not None:
            some = np.flatnonzero(members)
            none = np.zeros(len(some))
            yield _state(pa.nulls(len(some), ids), pa.nulls(len(some), pa.list_(pa.int32())), some.astype(np.int32), none, none, pa.array(members[some]), pa.array(list(sums[some]), pa.list_(pa.int64())), pa.array([scans, *[0] * (len(some) - 1)], pa.int64()))

    return run


def _state(ids, vectors, number, upper, lower, members, sums, scanned) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, vectors, pa.array(number, pa.int32()), pa.array(upper), pa.array(lower), members, sums, scanned], ["id", "vector", "number", "upper", "lower", "members", "sums", "scanned"])


def _last(dimensions: int, c: Centroids):
    """Task function after the last assignment: (id, cluster, squared distance)."""

    def run(batches):
        for batch in batches:
            vectors, number = _rows_of(batch.column(1), dimensions), batch.column(2).to_numpy(zero_copy_only=False)
            away = np.zeros(len(number), np.int64)
            for k in np.unique(number):
                away[number == k] = squared(vectors[number == k], c.points[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(away)], ["id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the least SHA-256 of ``seed:id``."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(order.alias("order"), "vector").orderBy("order", "vector").limit(clusters).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def moved_centroids(state: DataFrame, points: np.ndarray) -> np.ndarray:
    """Floored means of the clusters' vectors; empty clusters stay. Clusters times dimensions numbers reach the driver."""
    each = state.filter("members is not null").select("number", "members", F.posexplode("sums").alias("j", "sum"))
    # Sums of whole tables may pass 64 bits.
    found = each.groupBy("number", "j").agg(F.sum(F.col("sum").cast("decimal(28,0)")).alias("sum"), F.sum("members").alias("members")).collect()
    after = points.copy()
    for r in found:
        after[r["number"], r["j"]] = int(r["sum"]) // int(r["members"])
    return after


def centroid_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    *, dimensions: int = DIMENSIONS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
) -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    ``clusters`` times ``dimensions`` numbers are held by the driver and each task.
    """
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession)
    kept = work.table(integer_vectors(vectors, id_col, vector_col, dimensions, scale), "vectors")
    id_type = kept.schema["id"].dataType.simpleString()
    points = first_centroids(kept, clusters, seed)
    if not len(points):
        return spark.createDataFrame([], f"`{id_col}` {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state, before = kept, None
    for turn in range(rounds + 1):
        task = _round(dimensions, Centroids(points, before), turn == 0)
        read = state if turn == 0 else state.filter("members is null").select("id", "vector", "number", "upper", "lower")
        state = work.table(read.mapInArrow(task, STATE.format(id=id_type)), f"state-{turn}")
        work.drop("vectors" if turn == 0 else f"state-{turn - 1}")
        if turn < rounds:
            before, points = points, moved_centroids(state, points)
    last = state.filter("members is null").select("id", "vector", "number").mapInArrow(_last(dimensions, Centroids(points)), f"id {id_type}, cluster int, distance long")
    found = work.table(last, "found")
    work.drop(f"state-{rounds}")
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a cluster
    whole = sum(r["cluster_inertia"] for r in by_cluster)
    digests = [(r["cluster"], r["cluster_inertia"], whole, hashlib.sha256(",".join(map(str, points[r["cluster"]].tolist())).encode()).hexdigest()) for r in by_cluster]
    told = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
