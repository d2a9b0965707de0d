import math
import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions import noise
from veilframe.operators import accounting, longform, private, prv, release
from veilframe.plans import pipeline

DOMAIN = [("a", 0.0, 100.0), ("b", -1.0, 1.0)]


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(4)
    rows = []
    for i in range(3000):
        y = r.choice("NA")
        rows.append((str(i), y, r.expovariate(1 / 10) + (15 if y == "A" else 0), r.uniform(-0.5, 0.5)))
    rows += [("x", "A", None, math.inf), ("y", "other", 1e9, -1e9), ("z", None, 5.0, math.nan)]
    return spark.createDataFrame(rows, "k string, y string, a double, b double").cache()


def long(table):
    return longform.unpivot(table, ["a", "b"], "y", F.col("k"))


def domain(spark):
    return spark.createDataFrame(DOMAIN, "feature string, low double, high double")


def test_percentiles_are_near_with_a_budget_and_not_without(spark, table):
    exact = {(r.feature, r.share): r.value for r in longform.percentiles(private.clipped(long(table), domain(spark)).select("feature", "x"), [0.5, 0.99]).collect()}
    rich = private.percentiles(long(table), domain(spark), [0.5, 0.99], 40.0, seed=1).collect()
    assert len(rich) == 4 and all(r.eps == 10.0 for r in rich)
    for r in rich:
        lo, hi = {f: (a, b) for f, a, b in DOMAIN}[r.feature]
        assert abs(r.value - exact[r.feature, r.share]) <= 0.02 * (hi - lo)
    poor = [r.value for s in range(30) for r in private.percentiles(long(table).limit(0), domain(spark), [0.5], 1e-6, cells=16, seed=s).where("feature = 'a'").collect()]
    assert len(set(poor)) > 8 and all(0 < v <= 100 for v in poor)  # without values all edges are alike


def test_one_record_moves_utilities_by_no_more_than_one():
    r = random.Random(2)
    for _ in range(200):
        n, q = r.randint(0, 9), r.random()
        below = r.randint(0, n)
        for b, m in ((below, n + 1), (below + 1, n + 1)):
            assert abs(abs(b - q * m) - abs(below - q * n)) <= 1 + 1e-12


def test_counts_are_noisy_everywhere_and_scores_follow(spark, table):
    exact = {(r.feature, r.bin, r.label): r.k for r in longform.joint_counts(longform.unpivot(table.where("y in ('N', 'A')"), ["b"], "y"), 4).collect()}
    assert sum(exact.values()) == 3000
    counts = private.joint_counts(long(table), domain(spark), ["N", "A"], 1000.0, seed=3)
    got = counts.collect()
    assert len(got) == 2 * 20 * 2 and abs(sum(r.k for r in got if r.feature == "a") - 3000) < 1
    empty = private.joint_counts(long(table).limit(0), domain(spark), ["N", "A"], 0.2, seed=3).agg(F.avg("k"), F.avg((F.col("k") > 0).cast("double"))).first()
    assert 0.3 < empty[1] < 0.7 and 3 < empty[0] < 8  # half of the noise of scale 10 is above 0
    scored = {(r.method, r.feature): r.score for r in private.scores(counts).collect()}
    true = {r.feature: r.mi for r in longform.mutual_information(private.clipped(long(table).where("label in ('N', 'A')"), domain(spark)).select("feature", "label", "x")).collect()}
    assert scored["mi", "a"] > 10 * scored["mi", "b"] and scored["mi", "a"] == pytest.approx(true["a"], rel=0.5)
    assert scored["variance", "b"] == pytest.approx(1 / 12, rel=0.1) and scored["uniform", "a"] == 1
    with pytest.raises(ValueError):
        private.scores(counts, ["rank"])


@pytest.mark.parametrize(("method", "mechanism"), [("mi", "laplace"), ("variance", "gaussian"), ("uniform", "laplace")])
def test_the_whole_release_keeps_its_budget(spark, table, method, mechanism):
    made = pipeline.release_private(table, "y", domain(spark), ["N", "A"], 2.0, method, mechanism, key=F.col("k"), seed=5)
    log = made.log.collect()
    pure = sum(r.epsilon for r in log if r.mechanism == "laplace")
    if mechanism == "laplace":
        assert pure == pytest.approx(2.0) and prv.spent(made.log).first().prv <= 2.0 + 1e-9
    else:
        assert pure == pytest.approx(0.4) and sum(r.mechanism == "gaussian" for r in log) == 2 and math.isfinite(prv.spent(made.log).first().prv)
    assert len(log) == (4 if method == "uniform" else 6)
    assert {r.feature for r in made.settings.collect()} == {"a", "b"}
    spent = accounting.spent(made.log.where("mechanism = 'laplace'")).first()
    assert spent.basic == pytest.approx(pure)


def test_utility_is_near_that_of_public_bounds(spark, table):
    """With a few thousand records, buying bounds and weights costs little more than the tenths of the budget that they take."""
    public = spark.createDataFrame([("a", 0.0, 62.0), ("b", -1.0, 0.5)], "feature string, lo double, tau double")
    free = pipeline.release_table(table.where("y in ('N', 'A')"), "y", ["a", "b"], 4.0, "mi", key=F.col("k"), bounds=public, seed=1)
    paid = pipeline.release_private(table.where("y in ('N', 'A')"), "y", domain(spark), ["N", "A"], 4.0, "mi", key=F.col("k"), seed=1)
    a, b = ({r.feature: r.mean_abs_error for r in pipeline.checked(x).collect()} for x in (free, paid))
    assert b["a"] < 1.6 * a["a"]
    with pytest.raises(ValueError):
        pipeline.release_private(table, "y", domain(spark), ["N"], 1.0, bounds_share=0.6, weights_share=0.5)


def tail(h, n, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(h, n + 1))


def test_binomial_limits(spark):
    cases = [(0, 10), (10, 10), (3, 10), (1, 1600), (800, 1600), (870, 1600), (1599, 1600), (1600, 1600)]
    df = spark.createDataFrame(cases, "h long, n long")
    low, high = release.binomial_limits(F.col("h"), F.col("n"))
    for r in df.select("h", "n", low.alias("low"), high.alias("high")).collect():
        assert r.low == 0 if r.h == 0 else tail(r.h, r.n, r.low) == pytest.approx(0.025, rel=1e-6)
        assert r.high == 1 if r.h == r.n else 1 - tail(r.h + 1, r.n, r.high) == pytest.approx(0.025, rel=1e-6)
    probes = spark.createDataFrame([(h, n, p) for h, n in cases for p in (0.01, 0.4, 0.97)], "h long, n long, p double")
    for r in probes.select("*", release.binomial_tail(F.col("h"), F.col("n"), F.col("p")).alias("t")).collect():
        assert r.t == pytest.approx(tail(r.h, r.n, r.p), rel=1e-6, abs=1e-12)


def test_attacks_are_judged_by_their_own_bounds(spark):
    def accuracy(mechanism, e):
        """Of the best attack, by integrating the smaller density."""
        scale = 1 / e if mechanism == "laplace" else math.sqrt(2 * math.log(1.25 / noise.DELTA)) / e
        f = (lambda x: math.exp(-abs(x) / scale) / (2 * scale)) if mechanism == "laplace" else (lambda x: math.exp(-x * x / (2 * scale * scale)) / (scale * math.sqrt(2 * math.pi)))
        h = 0.002 * scale
        return 1 - sum(min(f(i * h), f(i * h - 1)) for i in range(-8000, 8000 + int(1 / h))) * h / 2

    df = spark.createDataFrame([(m, e) for m in noise.MECHANISMS for e in (0.5, 2.0)], "mechanism string, epsilon double")
    a, b = release.attack_bounds(F.col("mechanism"), F.col("epsilon"))
    for r in df.select("*", a.alias("budget"), b.alias("own")).collect():
        assert r.own == pytest.approx(accuracy(r.mechanism, r.epsilon), abs=1e-3) and r.own <= r.budget
    found = spark.createDataFrame([("f", "laplace", 1.0, e / (1 + e) + d) for e in (math.e,) for d in (0.0, 0.01, 0.05)], "feature string, mechanism string, epsilon double, accuracy double")
    status = [r.status for r in release.judged(found, 800).orderBy("accuracy").collect()]
    assert status == ["VALID", "VALID", "VIOLATED"]  # a hundredth above is within the interval of 1600 trials
