"""Grids of models over all rows against plain numpy on one matrix, against the sample's trials, and their noise against its distribution."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe import runtime
from veilframe.operators import accounting, experiments, grids, ml

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    made = [(i, r.gauss(50 + 3 * (i % 3), 1), r.gauss((i % 3 == 2) * 2, 1), i % 3) for i in range(600)]
    df = spark.createDataFrame([*made, (None, 50.0, 0.0, 0), (601, None, 1.0, 1), (602, 1.0, 1.0, None)], "i long, a double, b double, label int")
    return experiments.sample(df, FEATURES, F.col("label"), F.col("i"), None).cache()


def settings(spark, *given):
    return spark.createDataFrame([(*g[:3], list(g[3])) for g in given], "setting string, mechanism string, epsilon double, scales array<double>")


def matrix(rows, test):
    data = grids.packed(rows.where("test" if test else "not test"), FEATURES).blocks.collect()
    x = np.concatenate([np.frombuffer(b.x, np.float64).reshape(b.n, -1) for b in data])
    return x, np.concatenate([np.frombuffer(b.y, np.int32) for b in data]), np.concatenate([np.frombuffer(b.u, np.float64) for b in data])


def test_rows_without_label_or_feature_are_left_out(rows):
    assert rows.count() == 601


@pytest.mark.parametrize("classes", [2, 3])
def test_equals_numpy_on_one_matrix(spark, rows, classes):
    df = rows.withColumn("y", (F.col("y") == 0).cast("int")) if classes == 2 else rows
    given = settings(spark, ("p", "laplace", 1.0, [2.0, 0.5]), ("p", "gaussian", 1.0, [1.0, 3.0]), ("none", "none", math.inf, []))
    got = {(r.mechanism, r.run): r for r in grids.sweep(df, FEATURES, given, "m", 2, classes, steps=30).collect()}
    assert set(got) == {("laplace", 0), ("laplace", 1), ("gaussian", 0), ("gaussian", 1), ("none", 0)}
    (x, y, u), (tx, ty, _) = matrix(df, False), matrix(df, True)
    for m in grids.models(given, 2):
        seen = grids.noisy(x, u, m)
        mean, deviation = seen.mean(axis=0), seen.std(axis=0) + 1e-8
        w = np.zeros((1 if classes == 2 else classes, 3))
        for _ in range(30):
            w = ml.stepped(w, ml.gradient_sum(w, np.column_stack([(seen - mean) / deviation, np.ones(len(x))]), y), len(x))
        z = np.column_stack([(tx - mean) / deviation, np.ones(len(tx))]) @ w.T
        guess = (z[:, 0] >= 0).astype(int) if classes == 2 else z.argmax(axis=1)
        r = got[m.mechanism, m.run]
        assert r.n == len(ty) and r.accuracy == pytest.approx((guess == ty).mean(), abs=1e-12)
        accuracy, f1, macro, recalls = experiments.scored(ty.astype(int), guess, classes)
        assert (r.accuracy, r.f1, r.macro_f1, *r.recalls) == pytest.approx((accuracy, f1, macro, *recalls))


def test_without_noise_as_the_trial_on_the_sample(spark, rows):
    one = experiments.trials(experiments.block(rows, FEATURES), experiments.plain(rows), "softmax", 1, 3, steps=40).first()
    got = grids.sweep(rows, FEATURES, experiments.plain(rows), "softmax", 1, 3, steps=40).first()
    assert (one.n, one.accuracy, one.macro_f1, one.recalls) == (got.n, got.accuracy, got.macro_f1, got.recalls)


def test_weights_dont_depend_on_partitions_or_on_who_adds_up(spark, rows, monkeypatch):
    grid = grids.models(settings(spark, ("p", "laplace", 1.0, [2.0, 0.5]), ("none", "none", math.inf, [])), 2)
    found = []
    for parts, direct in ((1, 1 << 20), (7, 0)):
        monkeypatch.setattr(grids, "DIRECT_VALUES", direct)
        data = grids.packed(rows.where("not test").repartition(parts), FEATURES)
        scaled = grids.scaling(data, grid, 2)
        found.append(grids.fit(data, grid, scaled, 3, steps=10))
    assert found[0] == pytest.approx(found[1], abs=1e-9) and abs(found[0][0] - found[0][1]).max() > 1e-3


def test_noise_follows_its_distribution():
    u = np.random.default_rng(2).random(100_000)
    x = np.zeros((len(u), 2))
    for mechanism, variance, beyond in (("laplace", 2.0, math.exp(-3)), ("gaussian", 1.0, math.erfc(3 / math.sqrt(2)))):
        a, b = (grids.noisy(x, u, grids.Model("s", mechanism, 1.0, run, (1.0, 10.0), 77 + run)) for run in (0, 1))
        both = np.column_stack([a, b])
        assert abs(both.mean(axis=0) / [1, 10, 1, 10]).max() < 0.02
        assert both.std(axis=0) / [1, 10, 1, 10] == pytest.approx([math.sqrt(variance)] * 4, rel=0.02)
        assert (abs(a[:, 0]) > 3).mean() == pytest.approx(beyond, rel=0.2)
        assert abs(np.corrcoef(both.T) - np.eye(4)).max() < 0.02
        assert (grids.noisy(x, u, grids.Model("s", mechanism, 1.0, 0, (1.0, 10.0), 77)) == a).all()


def test_private_grid_keeps_budgets(spark, rows):
    df = rows.withColumn("y", (F.col("y") == 0).cast("int"))
    given = settings(spark, ("sgd", "gaussian", 0.01, []), ("sgd", "gaussian", 1.0, []), ("sgd", "gaussian", 50.0, []))
    got = grids.sweep(df, FEATURES, given, "private", 2, steps=60, sampling=0.2).collect()
    by = {(r.epsilon, r.run): r for r in got}
    assert len(by) == 6 and by[0.01, 0].sigma is None and by[0.01, 0].spent is None
    assert 0.99 < by[1.0, 0].spent <= 1.0 and by[1.0, 0].sigma == accounting.poisson_sigma(0.2, 60, 1.0) > by[50.0, 0].sigma
    assert by[50.0, 0].accuracy > 0.85
    again = grids.sweep(df, FEATURES, given, "private", 2, steps=60, sampling=0.2).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_each_step_of_private_descent_by_hand(spark, rows):
    df = rows.withColumn("y", (F.col("y") == 0).cast("int"))
    grid = grids.models(settings(spark, ("sgd", "gaussian", 8.0, [])), 2, True)
    data = grids.packed(df.where("not test"), FEATURES)
    scaled = grids.scaling(data, grid, 2)
    got = grids.fit_private(data, grid, scaled, [1.5, 0.7], 5, 0.3, seed=9)
    x, y, u = matrix(df, False)
    z = np.column_stack([(x - x.mean(axis=0)) / (x.std(axis=0) + 1e-8), np.ones(len(x))])
    for i, sigma in enumerate((1.5, 0.7)):
        rng, w = np.random.default_rng([9, grid[i].draws]), np.zeros((1, 3))
        for step in range(5):
            take = ml.drawn(u, 0.3, step, grid[i].draws)
            g = (ml.gradient_sum(w, z[take], y[take], 1.0) + rng.normal(0, sigma, w.shape)) / (0.3 * len(x))
            g[:, :-1] += ml.SGD_L2 * w[:, :-1]
            w = w - g
        assert got[i] == pytest.approx(w, abs=1e-9)


def test_empty_tables(spark, rows):
    got = grids.sweep(rows.where("false"), FEATURES, settings(spark, ("p", "laplace", 1.0, [2.0, 0.5])), "logistic", 1, steps=3).collect()
    assert [(r.n, r.accuracy, r.recalls) for r in got] == [(0, 0.0, [None, None])]


def test_equal_rows_are_computed_once_and_drawn_each(spark):
    df = spark.range(2000).select(F.array((F.col("id") % 5).cast("double"), F.lit(1.5)).alias("x"), (F.col("id") % 2).cast("int").alias("y"), ((F.hash("id") % 1000 + 1000.5) / 2000).alias("u"))
    data = ml.packed(df)
    blocks = [block for b in data.blocks.toArrow().to_batches() for block in ml.unpacked(b)]
    assert sum(len(k) for _, _, k, _ in blocks) <= 10 * data.tasks + 10 and sum(k.sum() for _, _, k, _ in blocks) == sum(len(u) for *_, u in blocks) == 2000
    x, y, u = (np.array([r[c] for r in df.collect()]) for c in ("x", "y", "u"))
    w, ones = np.array([[0.3, -0.2, 0.1]]), np.ones(2000)
    for clip, rate in ((None, 1.0), (0.5, 0.3)):
        total, n = ml._sums(data, w, clip, rate, 7, 11)
        take = ml.drawn(u, rate, 7, 11)
        assert n == take.sum() and total == pytest.approx(ml.gradient_sum(w, np.column_stack([x, ones])[take], y[take], clip), abs=1e-9)


@pytest.mark.parametrize("classes", [2, 3])
def test_full_descent_takes_few_passes_and_the_same_steps(spark, rows, classes, monkeypatch):
    df = rows.withColumn("y", (F.col("y") == 0).cast("int")) if classes == 2 else rows
    grid = grids.models(settings(spark, ("p", "laplace", 1.0, [2.0, 0.5]), ("none", "none", math.inf, [])), 2)
    data = grids.packed(df.where("not test"), FEATURES)
    scaled = grids.scaling(data, grid, 2)
    jobs, summed = [], grids._summed
    monkeypatch.setattr(grids, "_summed", lambda *a, **k: jobs.append(1) or summed(*a, **k))
    got = grids.fit(data, grid, scaled, classes)
    assert len(jobs) <= 8
    monkeypatch.setattr(ml, "PASSES", 0)
    assert len(grid) == 3 and grids.fit(data, grid, scaled, classes, steps=200) == pytest.approx(got, abs=1e-9) and len(jobs) > 200


def test_rows_taken_by_many_models_at_once_are_those_drawn():
    rng = np.random.default_rng(4)
    u, x, y = rng.random(5000), np.column_stack([rng.normal(size=(5000, 2)), np.ones(5000)]), rng.integers(0, 2, 5000)
    w, bits, times = rng.normal(size=(3, 3)), ml.row_bits(u, 0), np.zeros((3, 5000), np.int32)
    for i, (seed, rate) in enumerate(((7, 0.05), (1 << 31, 0.4), (9, 1.0))):
        found = ml.hits(bits, rate, 3, seed)
        assert (found == np.flatnonzero(ml.drawn(u, rate, 3, seed))).all()
        times[i, found] = 1 + i
    got = ml.clipped_sums(w, x, y, (x * x).sum(axis=1), times, 0.5)
    for i in range(3):
        assert got[i] == pytest.approx(ml.gradient_sum(w[i : i + 1], x, y, 0.5, times[i])[0], abs=1e-9)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_moves_no_rows_and_takes_the_first_hashes(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 7 > 0, (F.col("id") % 3).cast("int")).alias("y"))
    for given, key in ((df, F.col("id")), (ml.hashed(df, F.col("id")), None)):
        got = ml.stratified_split(given, key)
        assert got.columns == ["id", "y", "test"] and "Exchange hashpartitioning" not in _plan(got) and "Sort" not in _plan(got)
        by = {}
        for r in got.collect():
            by.setdefault(r.y, []).append((hashlib.md5(f"42|{r.id}".encode()).hexdigest(), r.test))
        assert set(by) == {None, 0, 1, 2} and sum(map(len, by.values())) == 5000
        for held in by.values():
            assert [t for _, t in sorted(held)] == [i < int(0.3 * len(held)) for i in range(len(held))]


def test_split_of_equal_keys_has_its_share(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("y"), F.lit("same").alias("key"))
    got = [r.id for r in ml.stratified_split(df, F.col("key")).where("test").collect()]
    assert len(got) == len(set(got)) == 300 and sum(i % 2 for i in got) == 150
    assert sorted(got) == sorted(r.id for r in ml.stratified_split(df.repartition(3), F.col("key")).where("test").collect())


@pytest.mark.parametrize("classes", [2, 3])
def test_baseline_packs_rows_where_they_are(spark, rows, classes, monkeypatch):
    df = rows.withColumn("y", (F.col("y") == 0).cast("int")) if classes == 2 else rows
    plans, table = [], runtime.Scratch.table
    monkeypatch.setattr(runtime.Scratch, "table", lambda self, made, *a: plans.append(_plan(made)) or table(self, made, *a))
    counts = grids.baseline(df.coalesce(1), FEATURES, classes, steps=60)
    assert len(plans) == 1 and "rangepartitioning" not in plans[0] and "Sort" not in plans[0]
    (x, y, _), (tx, ty, _) = matrix(df, False), matrix(df, True)
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-8
    w = np.zeros((1 if classes == 2 else classes, 3))
    for _ in range(60):
        w = ml.stepped(w, ml.gradient_sum(w, np.column_stack([(x - mean) / deviation, np.ones(len(x))]), y), len(x))
    z = np.column_stack([(tx - mean) / deviation, np.ones(len(tx))]) @ w.T
    guess = (z[:, 0] >= 0).astype(int) if classes == 2 else z.argmax(axis=1)
    want = {(a, b): int(((ty == a) & (guess == b)).sum()) for a in range(classes) for b in range(classes)}
    assert {(r.y, r.yhat): r.k for r in counts.collect()} == {at: k for at, k in want.items() if k}
    one = grids.scored(counts, classes).first()
    assert one.n == len(ty) and (one.accuracy, one.f1, one.macro_f1) == pytest.approx(experiments.scored(ty.astype(int), guess, classes)[:3])


@pytest.mark.parametrize("classes", [2, 3, 4])
def test_sums_at_points_are_those_of_all_classes(classes):
    rng, c = np.random.default_rng(8), 1 if classes == 2 else classes
    x, y, k = np.column_stack([rng.normal(size=(700, 2)), np.ones(700)]), rng.integers(0, classes, 700), rng.integers(1, 4, 700)
    points = rng.normal(size=(2, c, 3))
    gradients, seconds = ml.split_sums(ml.point_sums(points, x, y, k), points.shape)
    for w, g, h in zip(points, gradients, seconds, strict=True):
        assert g == pytest.approx(ml.gradient_sum(w, x, y, None, k), abs=1e-9)
        for i in range(c * 3):
            step = np.zeros(c * 3)
            step[i] = 1e-5
            near = [ml.gradient_sum(w + s * step.reshape(c, 3), x, y, None, k).ravel() for s in (1, -1)]
            assert h[i] == pytest.approx((near[0] - near[1]) / 2e-5, abs=1e-4)


@pytest.mark.parametrize("classes", [2, 3, 4])
def test_gradients_at_points_are_those_of_all_classes(classes):
    rng, c = np.random.default_rng(8), 1 if classes == 2 else classes
    x, y, k = np.column_stack([rng.normal(size=(700, 2)), np.ones(700)]), rng.integers(0, classes, 700), rng.integers(1, 4, 700)
    points = rng.normal(size=(3, c, 3))
    points[2] *= 1e4
    for times in (None, k):
        got = ml.point_gradients(points, np.asfortranarray(x), y, times)
        assert got == pytest.approx(np.array([ml.gradient_sum(w, x, y, None, times) for w in points]), abs=1e-9)


@pytest.mark.parametrize("classes", [2, 3])
def test_descent_over_many_rows_reads_all_of_them_a_few_times(spark, classes, monkeypatch):
    made = spark.range(60_000).select(
        F.col("id").alias("key"), (F.rand(3) * 40 + F.col("id") % 3).alias("a"), (F.randn(4) * (1 + F.col("id") % 2)).alias("b"), (F.col("id") % classes).cast("int").alias("y"), (F.rand(5) < 0.3).alias("test")
    )
    rows = made.cache()
    given = settings(spark, ("p", "laplace", 1.0, [2.0, 0.5]), ("p", "gaussian", 1.0, [1.0, 3.0]), ("none", "none", math.inf, []))
    grid, data = grids.models(given, 2), grids.packed(rows.where("not test"), FEATURES)
    scaled = grids.scaling(data, grid, 2)
    want = grids.fit(data, grid, scaled, classes)
    full, passes, summed = data.blocks, [], grids._summed
    monkeypatch.setattr(grids, "_summed", lambda data, *a, **k: passes.append(data.blocks is full) or summed(data, *a, **k))
    monkeypatch.setattr(grids, "THIN_ROWS", 10_000)
    got, near = grids.fit_scaled(data, grid, 2, runtime.materialize, classes)
    assert 2 <= sum(passes) <= 4 < len(passes) - 4
    assert near.n == scaled.n and near.mean == pytest.approx(scaled.mean) and near.deviation == pytest.approx(scaled.deviation)
    assert got == pytest.approx(want, abs=1e-8)
    # what such passes don't settle goes by passes of the whole
    monkeypatch.setattr(ml, "NEAR_POINTS", (14,))
    got, _ = grids.fit_scaled(data, grid, 2, runtime.materialize, classes)
    assert got == pytest.approx(want, abs=1e-8)


def test_draws_keep_their_rate_and_are_independent_by_pairs():
    u, seeds = np.random.default_rng(3).random(200_000), [7, 8, 1 << 31, 12345]
    masks = np.array([[ml.drawn(u, 0.05, step, s) for s in seeds] for step in (0, 1, 199)]).reshape(12, -1)
    assert abs(masks.mean(axis=1) - 0.05).max() < 0.0025
    both = masks.astype(float) @ masks.T / len(u)
    assert abs(both - 0.05**2)[~np.eye(12, dtype=bool)].max() < 0.0006
    bits = ml.step_bits(ml.row_bits(u, 0), 1)
    rows, sizes = ml.places(bits, 0.05, seeds)
    assert (np.split(rows, np.cumsum(sizes)[:-1])[2] == np.flatnonzero(masks[4 + 2])).all() and sizes.sum() == masks[4:8].sum()
    assert all((r == np.arange(5)).all() for r in ml.places(bits[:5], 1.0, seeds)[0].reshape(4, 5))
    # a rate that ends within one value of the upper half is kept by the lower half
    few = (np.arange(8, dtype=np.uint64) << np.uint64(29)).copy()
    assert ml.places(few, 2.0**-33, [5])[0].tolist() == [0, 1, 2, 3]


def test_gradients_of_taken_rows_are_those_of_each_model():
    rng = np.random.default_rng(6)
    x, y, w = rng.normal(size=(900, 2)) * 3 + 5, rng.integers(0, 2, 900), rng.normal(size=(4, 3)) * [1, 1, 50]
    rows, sizes = np.concatenate([np.arange(0, 900, 3), np.arange(7), np.arange(900)]), np.array([300, 0, 7, 900])
    mean, deviation = x.mean(axis=0), x.std(axis=0)
    got = ml.taken_sums(w, x, y, rows, sizes, mean, deviation, 0.5)
    seen = np.column_stack([(x - mean) / deviation, np.ones(900)])
    for i, own in enumerate(np.split(rows, np.cumsum(sizes)[:-1])):
        assert got[i] == pytest.approx(ml.gradient_sum(w[i : i + 1], seen[own], y[own], 0.5)[0], abs=1e-9)
    assert (ml.taken_sums(w, x, y, rows[:0], np.zeros(4, int), mean, deviation, 0.5) == 0).all()


def test_private_rows_are_packed_where_they_are(spark, rows, monkeypatch):
    plans, table = [], runtime.Scratch.table
    monkeypatch.setattr(runtime.Scratch, "table", lambda self, made, *a: plans.append(_plan(made)) or table(self, made, *a))
    df = rows.withColumn("y", (F.col("y") == 0).cast("int"))
    grids.sweep(df, FEATURES, settings(spark, ("sgd", "gaussian", 1.0, [])), "private", 1, steps=2, sampling=0.2).collect()
    assert len(plans) == 2 and not any("rangepartitioning" in p or "Sort" in p for p in plans)
