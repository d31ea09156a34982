import hashlib
import math
import random

import numpy as np
import pytest

from gristmill.llm import centroid_clusters as m
from gristmill.llm.centroid_clusters import Centroids, centroid_clusters, exponion, nearest


def brute(rows, dimensions=64, scale=64, clusters=16, rounds=3, seed=1):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, p)), k) for k, p in enumerate(points)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for k in range(len(points)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == k]
            if own:
                points[k] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    inertia = {}
    for d, c in near:
        inertia[c] = inertia.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, near)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def vectors(seed, n, dimensions, spread=0.3):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 0.6, (9, dimensions))
    return [(int(i * 3 % 1009), [float(np.float32(x)) for x in centres[r.integers(9)] + r.normal(0, spread, dimensions)]) for i in range(n)]


def test_given_table_matches_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert got(centroid_clusters(df)) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_ties_repeats_and_left_out_rows(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([0.0, 0.25, -0.25, 0.5]) for _ in range(4)]) for i in range(150)]
    rows += [(500, rows[3][1]), (500, rows[3][1]), (None, [0.0] * 4), (None, [0.25, 0.0, 0.0, 0.0]), (501, None), (502, []), (503, [0.0] * 3), (504, [0.0] * 5), (505, [0.0, None, 0.0, 0.0]), (506, [0.0, float("nan"), 0.0, 0.0]), (507, [float("-inf"), 0.0, 0.0, 0.0])]
    for options in ({"clusters": 16}, {"clusters": 5, "rounds": 7, "scale": 4, "seed": 9}, {"clusters": 1}, {"clusters": 1000, "rounds": 2}, {"rounds": 0}):
        assert got(centroid_clusters(frame(spark, rows), dimensions=4, **options)) == brute(rows, 4, **{"scale": 64, **options})


def test_equal_vectors_empty_table_and_extra_columns(spark):
    rows = [(i, [0.5] * 4) for i in range(40)]
    assert got(centroid_clusters(frame(spark, rows), dimensions=4)) == brute(rows, 4)
    assert got(centroid_clusters(frame(spark, []))) == [] and centroid_clusters(frame(spark, [])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows = vectors(1, 60, 4)
    wide = frame(spark, rows).selectExpr("vec_id AS key", "embedding AS v", "1 AS cluster", "2 AS id", "3 AS number", "'x' AS distance")
    assert got(centroid_clusters(wide, "key", "v", dimensions=4)) == brute(rows, 4)


def test_a_component_beyond_64_bits_is_refused(spark):
    with pytest.raises(Exception, match="beyond"):
        centroid_clusters(frame(spark, [(1, [3e6 * 64] * 64)])).collect()
    near = [(1, [2.0e6] * 64), (2, [-2.0e6] * 64), (3, [1.9e6] * 64)]
    assert got(centroid_clusters(frame(spark, near), clusters=2)) == brute(near, clusters=2)


def test_bounds_spare_scans_and_change_nothing():
    r = np.random.default_rng(4)
    spots = r.integers(-60, 60, (40, 8))
    points = spots[r.integers(40, size=6000)] + r.integers(-6, 7, (6000, 8))
    c = Centroids(points[:40])
    number, upper, lower, full = nearest(points, c)
    scans = []
    for _ in range(6):
        after = c.points.copy()
        for k in range(40):
            if (number == k).any():
                after[k] = points[number == k].sum(axis=0) // (number == k).sum()
        c = Centroids(after, c.points)
        number, upper, lower, n = exponion(points, number, upper, lower, c)
        away = np.stack([m.squared(points, p) for p in c.points], 1)
        assert (number == away.argmin(axis=1)).all()  # argmin takes the first of equals
        scans.append(n)
        best = np.sort(away, axis=1)
        assert (upper**2 >= best[:, 0] * (1 - 1e-9)).all() and (lower**2 <= best[:, 1] * (1 + 1e-9)).all()
    assert full == 240_000 and scans[-1] < full / 5
