import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.operators import accounting, experiments, longform, ml


def numbers(seed):
    r = random.Random(seed)
    some = [0.0, 1.0, 2.0, -1.0, -2.0, 0.5, 1e-300, -1e-300, 1e300, -1e300, 4096.0, math.nextafter(2.0, 0), math.nextafter(2.0, 3), 5e-324]
    return some + [r.uniform(-1, 1) * 10 ** r.randint(-12, 12) for _ in range(400)] + [float(r.randint(-50, 50)) for _ in range(300)]


def test_slices_never_fall(spark):
    rows = spark.createDataFrame([(x,) for x in numbers(1)], "x double").withColumn("s", longform.slice_of(F.col("x"))).orderBy("x").collect()
    assert all(a.s <= b.s for a, b in itertools.pairwise(rows)) and len({r.s for r in rows}) > 300


def test_percentiles_equal_numpy(spark):
    r = random.Random(5)
    data = {"all": numbers(2), "one": [7.0] * 30, "single": [3.5], "two": [1.0, 2.0], "ties": [float(r.randint(0, 3)) for _ in range(200)], "near": [1 + i * 1e-15 for i in range(50)], "none": []}
    long = spark.createDataFrame([(f, x) for f, v in data.items() for x in [*v, None, float("nan")]], "feature string, x double")
    shares = [0.0, 0.001, 0.25, 0.5, 0.9, 0.995, 1.0]
    got = {(r.feature, r.share): r.value for r in longform.percentiles(long, shares).collect()}
    assert set(got) == {(f, s) for f in data if f != "none" for s in shares}
    for (f, s), v in got.items():
        assert v == pytest.approx(float(np.quantile(np.array(data[f]), s)), rel=1e-12, abs=1e-300), (f, s)


def test_running_sums(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", None]), r.choice(numbers(4)), i, r.randint(1, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x double, i long, v long")
    got = {r.i: r.before for r in longform.running_sum(df, ["g"], "x", "v", "before", ["i"]).collect()}
    for g, x, i, _ in rows:
        assert got[i] == sum(v for h, y, j, v in rows if h == g and (y, j) < (x, i))


def test_steps_take_rows_independently():
    u = np.random.default_rng(1).random(20_000)
    takes = np.array([ml.drawn(u, 0.05, step, 42) for step in range(60)])
    rates = takes.mean(axis=1)
    assert abs(rates.mean() - 0.05) < 0.001 and rates.std() < 1.5 * math.sqrt(0.05 * 0.95 / 20_000)
    joint = np.array([(takes[i] & takes[j]).sum() for i, j in itertools.combinations(range(60), 2)])
    # as many common rows as independent draws have: a binomial of 20,000 at 0.0025
    assert abs(joint.mean() - 50) < 1 and 0.85 < joint.std() / math.sqrt(50) < 1.15
    assert (ml.drawn(u, 0.05, 3, 42) != ml.drawn(u, 0.05, 3, 43)).any()
    per_row = takes.sum(axis=0)
    assert 0.9 < per_row.std() / math.sqrt(60 * 0.05 * 0.95) < 1.1


def test_bound_of_independent_samples(spark):
    for q, sigma in ((0.01, 1.0), (0.2, 3.0)):
        df = accounting.grid(spark, alpha=[2, 3, 64], q=[q], sigma=[sigma])
        got = {r.alpha: r.rdp for r in df.withColumn("rdp", accounting.rdp_gaussian_poisson(F.col("alpha"), F.col("q"), F.col("sigma"))).collect()}
        assert got[2] == pytest.approx(math.log(1 + q * q * (math.exp(1 / sigma**2) - 1)), rel=1e-9)
        third = (1 - q) ** 3 + 3 * q * (1 - q) ** 2 + 3 * q * q * (1 - q) * math.exp(1 / sigma**2) + q**3 * math.exp(3 / sigma**2)
        assert got[3] == pytest.approx(math.log(third) / 2, rel=1e-9)
        # by integration: E over N(0, sigma) of the likelihood ratio of the mixture to the power alpha
        z = np.linspace(-40 * sigma, 64 + 40 * sigma, 2_000_001)
        log = 64 * np.logaddexp(math.log1p(-q), math.log(q) + (2 * z - 1) / (2 * sigma**2)) - z * z / (2 * sigma**2) - math.log(sigma * math.sqrt(2 * math.pi))
        assert got[64] == pytest.approx((log.max() + math.log(np.exp(log - log.max()).sum() * (z[1] - z[0]))) / 63, rel=1e-4)
    sigma = accounting.poisson_sigma(0.05, 200, 1.0)
    assert accounting.poisson_epsilon(0.05, sigma, 200) <= 1.0 < accounting.poisson_epsilon(0.05, sigma * 0.999, 200)
    assert accounting.poisson_sigma(0.05, 200, 0.01) is None


@pytest.fixture(scope="module")
def flowers(spark):
    """Two features that separate three classes, the third badly, and one without meaning."""
    r = random.Random(11)
    rows = []
    for i in range(900):
        y = i % 3
        rows.append((i, r.gauss(3 * y, 1), r.gauss((y == 2) * 2, 1), r.gauss(0, 100), y))
    return spark.createDataFrame(rows, "i long, a double, b double, c double, label int").cache()


FEATURES = ["a", "b", "c"]


@pytest.mark.parametrize("classes", [2, 3])
def test_a_trial_without_noise_is_the_trained_model(spark, flowers, classes):
    y = F.col("label") if classes == 3 else (F.col("label") == 0).cast("int")
    rows = experiments.sample(flowers, FEATURES, y, F.col("i")).cache()
    one = experiments.trials(experiments.block(rows, FEATURES), experiments.plain(rows), "logistic" if classes == 2 else "softmax", 1, classes, steps=40).first()
    scaled = ml.standardized(rows, FEATURES, ~F.col("test"))
    train, test = (ml.vectors(scaled.where(c), FEATURES, F.col("key")) for c in ("not test", "test"))
    guessed = ml.predicted(test, ml.train(train, 3, classes, steps=40))
    assert one.n == guessed.count() and one.accuracy == pytest.approx(guessed.where("y = yhat").count() / one.n, abs=1e-12)
    assert one.accuracy > 0.75 and len(one.recalls) == classes
    rows.unpersist()


def test_noise_costs_accuracy_and_reruns_agree(spark, flowers):
    rows = experiments.sample(flowers, FEATURES, (F.col("label") == 0).cast("int"), F.col("i"), rows=600).cache()
    assert rows.count() == 600
    weights = spark.createDataFrame([("uniform", f, 1 / 3) for f in FEATURES] + [("best", "a", 0.98), ("best", "b", 0.01), ("best", "c", 0.01)], "method string, feature string, weight double")
    settings = experiments.noise_scales(experiments.train_long(rows, FEATURES), weights, [0.5, 1e6], FEATURES).unionByName(experiments.plain(rows))
    one = experiments.block(rows, FEATURES)
    results = experiments.trials(one, settings, "logistic", 6, steps=40).cache()
    assert results.count() == 2 * 2 * 2 * 6 + 1
    again = experiments.trials(one, settings.repartition(3), "logistic", 6, steps=40)
    key = lambda r: (r.setting, r.mechanism, r.epsilon, r.run, r.accuracy)
    assert sorted(map(key, results.collect())) == sorted(map(key, again.collect()))
    means = {(r.setting, r.mechanism, r.epsilon): r for r in experiments.summarized(results).collect()}
    plain = means["none", "none", math.inf]
    assert plain.runs == 1 and plain.loss_pct == 0
    assert means["uniform", "laplace", 1e6].accuracy == pytest.approx(plain.accuracy, abs=0.03)
    assert means["uniform", "laplace", 0.5].accuracy < plain.accuracy - 0.1
    tests = experiments.compared(results).collect()
    assert len(tests) == 4 and all(0 <= r.p <= 1 and r.n == 6 for r in tests)
    results.unpersist()
    rows.unpersist()


def test_private_descent_keeps_its_budget(spark, flowers):
    rows = experiments.sample(flowers, FEATURES, (F.col("label") == 0).cast("int"), F.col("i"))
    settings = accounting.grid(spark, setting=["sgd"], mechanism=["gaussian"], epsilon=[0.01, 1.0, 8.0]).withColumn("scales", F.array().cast("array<double>"))
    got = {r.epsilon: r for r in experiments.trials(experiments.block(rows, FEATURES), settings, "private", 1, batch=64, epochs=20).collect()}
    assert got[0.01].sigma is None  # no noise keeps that
    assert 0.99 < got[1.0].spent <= 1 and 7.9 < got[8.0].spent <= 8 and got[1.0].sigma > got[8.0].sigma
    assert got[8.0].accuracy > 0.8


def test_scores_by_hand():
    y, guess = np.array([0, 0, 1, 1, 1, 2]), np.array([0, 1, 1, 1, 0, 0])
    accuracy, f1, macro, recalls = experiments.scored(y, guess, 4)
    assert accuracy == 0.5 and f1 == pytest.approx(2 / 3) and macro == pytest.approx((2 / 5 + 2 / 3 + 0 + 0) / 4)
    assert recalls == [0.5, pytest.approx(2 / 3), 0.0, None]


def test_running_budgets_are_never_broadcast(spark):
    log = spark.range(3000).select((F.col("id") % 2).alias("who"), "id", F.lit("laplace").alias("mechanism"), F.lit(0.01).alias("epsilon"), F.lit(1.0).alias("sensitivity"), F.lit(1.0).alias("sigma"), F.lit(1.0).alias("sampling_rate"))
    made = accounting.running(log, "id", by=["who"])
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().sparkPlan().toString()
    total = {r.who: r.epsilon for r in made.where("id >= 2998").collect()}
    every = accounting.best(accounting.curve(log, by=["who"]), ["who"])
    assert total == pytest.approx({r.who: r.epsilon for r in every.collect()})
