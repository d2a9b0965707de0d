import itertools
import math
import os
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import oracle
from veilframe.operators import accounting, prv
from veilframe.plans import privacy

D = 1e-5
LOG = "who string, mechanism string, epsilon double, sensitivity double, sigma double, sampling_rate double"


def upto(u):
    return 0.5 * math.erfc(-u / math.sqrt(2))


def gaussian_delta(m, e):
    return upto(-e / m + m / 2) - math.exp(e) * upto(-e / m - m / 2)


def density(mechanism, level, x):
    return np.exp(-np.abs(x) * level) * level / 2 if mechanism == "laplace" else np.exp(-x * x / (2 * level * level)) / (level * math.sqrt(2 * math.pi))


def lower_cells(release, added, step, n=400_000):
    """A plain numeric distribution of a release's loss, each rounded down to a multiple of ``step``: (multiples, mass)."""
    mechanism, level, q = release
    far = 40 / level if mechanism == "laplace" else 9 * level
    x = np.linspace(-far, 1 + far, n + 1)
    x = (x[1:] + x[:-1]) / 2
    without, moved = density(mechanism, level, x), density(mechanism, level, x - 1)
    with_ = (1 - q) * without + q * moved
    mass = (without if added else with_) * (x[1] - x[0])
    loss = np.log(without / with_) if added else np.log(with_ / without)
    at = np.floor(loss / step - 1e-9).astype(int)
    return at.min(), np.bincount(at - at.min(), weights=mass)


def lower_delta(releases, added, epsilon, step):
    """Not above the delta of a sum of releases: losses rounded down, convolved one by one."""
    low, p = 0, np.ones(1)
    for release, k in releases.items():
        a, mass = lower_cells(release, added, step)
        for _ in range(k):
            low, p = low + a, np.convolve(p, mass)
    z = (low + np.arange(len(p))) * step
    return float((p * np.clip(-np.expm1(epsilon - z), 0, None)).sum())


R = prv.Release
MIXES = [
    ({R("laplace", 0.7): 1}, 1e-4), ({R("laplace", 0.5, 0.3): 2}, 1e-4), ({R("gaussian", 1.5): 3}, 2e-3), ({R("gaussian", 0.9, 0.2): 3}, 2e-3),
    ({R("laplace", 0.4): 2, R("gaussian", 2.0, 0.5): 2, R("laplace", 1.0, 0.05): 1}, 2e-3), ({R("gaussian", 0.3, 0.01): 2}, 5e-3),
]


@pytest.mark.parametrize(("mix", "added"), list(itertools.product(range(len(MIXES)), (False, True))))
def test_never_below_and_near_a_numeric_convolution(mix, added):
    releases, step = MIXES[mix]
    made = prv.curve(releases, added)
    for e in (0.0, 0.1, 0.5, 1.0):
        least = lower_delta(releases, added, e, step)
        assert made.delta(e) >= least - 2e-6  # what the plain midpoint rule may err
        assert made.delta(e) <= lower_delta(releases, added, e - 1.2 * step * sum(releases.values()), step) * 1.001 + 2e-5


def test_closed_forms():
    for level, k in ((1.0, 1), (5.0, 1), (50.0, 100), (1000.0, 100_000)):
        m, made = math.sqrt(k) / level, prv.curve({R("gaussian", level): k}, False)
        for e in (0.1, 0.7, 1.2):
            assert gaussian_delta(m, e) <= made.delta(e) <= 1.01 * gaussian_delta(m, e - (0.01 if k < 1000 else 0.25) * m) + 1e-7  # in deviations of the sum
        assert gaussian_delta(m, made.epsilon(D)) <= D
    for e, q in ((1.0, 0.1), (0.5, 0.01), (2.0, 1.0)):
        exact = math.log1p(q * math.expm1(e + 2 * math.log1p(-D / q)))
        assert exact <= prv.curve({R("laplace", e, q): 1}, False).epsilon(D) <= 1.001 * exact
        assert prv.curve({R("laplace", e, q): 1}, True).epsilon(D) <= 1.001 * exact
    # all ten losses are greatest with probability 2^-10
    least = 1 + math.log(1 - D * 2**10)
    assert least <= prv.bound("laplace", 0.1, 10) <= least + 1e-3


def test_memory_does_not_grow_with_the_number_of_releases():
    prv.bound("laplace", 0.001, 10)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    b = prv.bound("laplace", 0.001, 100_000)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # kB
    # nearly normal: mean k e^2 / 2 and deviation e sqrt(k)
    assert gaussian_delta(math.sqrt(0.1), b) < D and b < 1.3


@pytest.mark.parametrize(("sigma", "published"), [(12.197, 0.3), (7.441, 0.5), (3.63, 1.0)])
def test_descent_is_tighter_than_the_renyi_bound(sigma, published):
    q, steps = 256 / 14001, 30 * 14001 // 256
    by_losses = prv.sampled_gaussian(q, sigma, steps)
    assert by_losses < accounting.poisson_epsilon(q, sigma, steps) and by_losses < published
    # a sample is no worse than all rows, and no better than one with as much less in mean
    assert by_losses < prv.curve({R("gaussian", sigma): steps}, False).epsilon(D)
    assert gaussian_delta(0.95 * q * math.sqrt(steps) / sigma, by_losses) < D


def test_a_mixed_log(spark, monkeypatch):
    monkeypatch.setattr(prv, "PART", 2)
    rows = [("a", "laplace", 0.2, 1.0, None, None)] * 5 + [("a", "gaussian", None, 2.0, 8.0, 1.0)] * 3 + [("a", "laplace", 0.1 + i / 100, 1.0, None, 0.1) for i in range(6)]
    rows += [("b", "gaussian", None, 1.0, 2.0, 0.5)] * 4 + [("b", "gaussian", None, 0.0, 2.0, 1.0), ("b", "laplace", 9.0, 1.0, None, 0.0)]
    rows += [(None, "laplace", 0.3, 1.0, None, 2.0)] * 2 + [("c", "laplace", 1.0, 1.0, None, 0.0)]
    log = spark.createDataFrame(rows, LOG)
    got = {r.who: (r.n_queries, r.prv) for r in prv.spent(log, by=["who"]).collect()}
    want = {
        "a": {R("laplace", 0.2): 5, R("gaussian", 4.0): 3} | {R("laplace", 0.1 + i / 100, 0.1): 1 for i in range(6)},
        "b": {R("gaussian", 2.0, 0.5): 4},
        None: {R("laplace", 0.3): 2},
    }
    assert set(got) == set(want)
    for who, releases in want.items():
        assert got[who][0] == sum(releases.values())
        assert got[who][1] == pytest.approx(max(prv.curve(releases, added).epsilon(D) for added in (False, True)), rel=1e-9)
    curve = prv.curves(log.where("who = 'b'"), [0.0, 0.5, 1.0]).orderBy("epsilon").collect()
    assert [r.delta for r in curve] == pytest.approx([max(prv.curve(want["b"], added).delta(e) for added in (False, True)) for e in (0.0, 0.5, 1.0)], rel=1e-9)
    assert prv.spent(log.limit(0), by=["who"]).count() == 0
    counted = log.where("who = 'b'").groupBy(*log.columns).agg(F.count("*").alias("n"))
    assert prv.spent(counted, by=["who"], count="n").first().prv == got["b"][1]


@pytest.mark.parametrize("row", [("a", "cauchy", 1.0, 1.0, 1.0, 1.0), ("a", "laplace", None, 1.0, 1.0, 1.0), ("a", "gaussian", 1.0, 1.0, math.nan, 1.0), ("a", "laplace", -1.0, 1.0, 1.0, 1.0)])
def test_what_is_no_release_raises(spark, row):
    with pytest.raises(Exception, match="no release"):
        prv.spent(spark.createDataFrame([row], LOG)).collect()


def test_many_sampled_steps_stay_tighter_than_the_renyi_bound():
    """Rounding each step's loss up by a share of a cell had added 1 to the budget here."""
    n = 120_000
    q, steps = 16 / n, 5 * n // 16
    assert prv.sampled_gaussian(q, 1.0, steps) < 0.2 < accounting.poisson_epsilon(q, 1.0, steps)


@pytest.mark.parametrize("k", [16_000, 960_000])
def test_many_gaussian_releases_stay_near_their_exact_curve(k):
    made, m = prv.curve({R("gaussian", 200.0): k}, False, 1e-6), math.sqrt(k) / 200
    for e in (0.05, 0.2):
        assert gaussian_delta(m, e) <= made.delta(e) <= 1.001 * gaussian_delta(m, e)


def test_releases_without_an_analyst_stay_in_the_curves(spark, sf_dir, tmp_path):
    for t in os.listdir(sf_dir):
        if t != "events.parquet":
            os.symlink(f"{sf_dir}/{t}", tmp_path / t)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("user_id", F.when(F.col("user_id") % 10 != 3, F.col("user_id"))).write.parquet(str(tmp_path / "events.parquet"))
    n = oracle.compare(spark, privacy.prv_log_gaussian, privacy.SQL["prv_log_gaussian"], str(tmp_path))
    assert n == 20
