"""Clusters against plain squared distances and exact means."""

import hashlib
import math
import random

import numpy as np
import pytest

from depotcast.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string"


def by_hand(rows, clusters, rounds, seed=2):
    kept = [
        (k, [math.floor(256 * float(np.float32(x))) for x in v]) for k, v, *_ in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    marked = sorted((hashlib.sha256(f"{seed}:{k}".encode()).hexdigest(), v) for k, v in kept if k is not None)
    centroids = [v for _, v in marked[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centroids)]
    found = [(k, *reversed(near(v))) for k, v in kept] if centroids else []
    return sorted(found, key=str), centroids


def clustered(spark, rows, **options):
    found, centroids = clustering.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=str), centroids


def vectors(n, seed=1, centres=6):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(centres)]
    return [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(middle)], i % 3, "c", "d") for i in range(n)]


def test_clusters_equal_plain_distances(spark):
    rows = vectors(300)
    rows += [(1000, None, 1, "", ""), (1001, [0.5] * 63, 1, "", ""), (1002, [None] + [0.1] * 63, 1, "", ""),
             (1003, [math.inf] + [0.1] * 63, 1, "", ""), (1004, [math.nan] * 64, 1, "", ""), (None, [0.25] * 64, None, "", ""),
             (5, [0.0] * 64, None, "", ""), (1005, [], 1, "", "")] + rows[:30]
    got, centroids = clustered(spark, rows, clusters=12, rounds=4)
    want, wanted = by_hand(rows, 12, 4)
    assert got == want and centroids.tolist() == wanted


def test_ties_and_far_values(spark):
    rng = random.Random(5)
    # few different values: many equal distances, empty clusters and copies among the first centroids
    rows = [(i, [float(rng.choice([-1, 1]))] * 32 + [0.0] * 32, 0, "", "") for i in range(60)]
    rows += [(100 + i, [rng.choice([-65536.0, 65536.0]) for _ in range(64)], 0, "", "") for i in range(40)]
    got, centroids = clustered(spark, rows, clusters=9, rounds=5)
    want, wanted = by_hand(rows, 9, 5)
    assert got == want and centroids.tolist() == wanted


def test_few_rows_and_none(spark):
    rows = vectors(3)
    got, centroids = clustered(spark, rows, clusters=40, rounds=5)
    assert got == by_hand(rows, 40, 5)[0] and len(centroids) == 3 and {d for _, _, d in got} == {0}
    found, centroids = clustering.cluster(spark.createDataFrame([], SCHEMA))
    assert clustering.with_inertia(found, centroids).collect() == []
    assert clustered(spark, [(1, [1.0], 0, "", "")])[0] == []


def test_values_that_would_not_fit_fail_with_a_message(spark):
    with pytest.raises(Exception, match="would not fit 64 bits"):
        clustered(spark, [(1, [70000.0] * 64, 0, "", "")])


def test_the_search_drops_only_strictly_worse_centroids():
    rng = np.random.default_rng(2)
    assert sorted(clustering.ORDER) == list(range(64))
    for spread in (1, 3, 1000):
        x, c = rng.integers(-spread, spread + 1, (500, 64)), rng.integers(-spread, spread + 1, (40, 64))
        c[7] = c[3]
        x[::9] = c[7]
        plain = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        at, distance = clustering.nearest(clustering.coefficients(x), clustering.coefficients(c))
        assert (at == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
        assert (clustering.components(clustering.coefficients(x)) == x).all()


def test_inertia_adds_up(spark):
    rows = vectors(120, 3)
    frame = spark.createDataFrame(rows, SCHEMA).select("vec_id", "embedding")
    out = clustering.with_inertia(*clustering.cluster(frame, clusters=5)).collect()
    want, centroids = by_hand(rows, 5, 5)
    assert {r.inertia for r in out} == {sum(d for _, _, d in want)} and len(out) == 120
    for r in out:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
