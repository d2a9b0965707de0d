import hashlib
import math
import random

import numpy as np
import pytest

from tests.oracle import compare
from veilframe.llm import centroids, queries

LONG = (1 << 63) - 1


def brute(rows, k, rounds, seed, dims):
    def ints(v):
        if v is None or len(v) != dims or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [min(max(math.floor(256 * x), -LONG - 1), LONG) for x in v]

    kept = [(i, q) for i, v in rows if (q := ints(v)) is not None]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    now = [list(q) for _, q in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda q: min((far(q, c), n) for n, c in enumerate(now))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        for n, members in groups.items():
            now[n] = [sum(m[j] for m in members) // len(members) for j in range(dims)]
    return sorted(((i, near(q)[1], min(near(q)[0], LONG)) for i, q in kept), key=repr), now


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id long, cluster string")
    made = centroids.cluster(df, **more)
    return sorted((tuple(r) for r in made.rows.collect()), key=repr), made.centroids


def test_query_equals_sql(spark, sf_dir):
    assert compare(spark, queries.queries()["op12_centroid_clusters"], queries.SQL["op12_centroid_clusters"], sf_dir) > 0


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    r = random.Random(seed)
    dims = (5, 16, 33)[seed]
    rows = [(i, [r.choice([0.0, 0.5, -0.25, r.gauss(0, 1)]) for _ in range(dims)]) for i in range(150)]
    rows += [(i + 1000, rows[0][1]) for i in range(90)] + rows[:5] + [(None, rows[1][1])]
    rows += [(5000, None), (5001, [1.0] * (dims + 1)), (5002, [math.nan] + [0.0] * (dims - 1)), (5003, [math.inf] * dims), (5004, [None] * dims), (5005, [])]
    assert got(spark, rows, k=7, rounds=4, seed=seed, dims=dims) == brute(rows, 7, 4, seed, dims)


def test_edges(spark):
    huge = [(1, [1e300, -1e300]), (2, [-1e300, 3.0]), (3, [1e17, 5.0]), (4, [1e17, 4.0]), (5, [0.0, 0.0])]
    assert got(spark, huge, k=2, rounds=3, seed=2, dims=2) == brute(huge, 2, 3, 2, 2)
    few = [(1, [1.0]), (2, [1.0])]
    assert got(spark, few, k=9, rounds=2, seed=2, dims=1) == brute(few, 9, 2, 2, 1)
    df = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    made = centroids.with_inertia(centroids.cluster(df.limit(0), dims=1))
    assert made.count() == 0 and made.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    middles = rng.integers(-200, 200, (40, 64))
    rows = middles[rng.integers(0, 40, 500)] + rng.integers(-20, 20, (500, 64))
    exact = ((rows[:, None] - middles) ** 2).sum(axis=2)
    low = centroids.bounds(centroids.compressed(rows), centroids.compressed(middles))
    assert (low <= exact).all()
    best, distance, n = centroids.nearest(rows, centroids.compressed(rows), middles, centroids.compressed(middles))
    assert (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and n < exact.size / 10
