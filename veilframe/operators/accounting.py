"""Privacy accounting as grid DataFrames: composition, Renyi curves, amplification, noisy gradient descent.

A query log is a DataFrame (mechanism, epsilon, sensitivity, sigma, sampling_rate); everything is an expression
over the log and the grid of orders, so a log of any length is one grouped sum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import noise
from veilframe.operators import longform

# The grids of Renyi orders.
ALPHAS = (1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 16.0, 32.0, 64.0)
SGD_ALPHAS = (1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0, 64.0)
#: Exponent above which the Laplace curve is taken by its leading term.
OVERFLOW = 500.0


def grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """All combinations of the axes' values, from one row."""
    df = spark.range(1).drop("id")
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def basic(epsilon: Column, k: Column) -> Column:
    return epsilon * k


def advanced(epsilon: Column, k: Column, delta: float = noise.DELTA) -> Column:
    return epsilon * F.sqrt(2 * k * F.lit(math.log(1 / delta))) + k * epsilon * (F.exp(epsilon) - 1)


def rdp_laplace(alpha: Column, epsilon: Column) -> Column:
    x = (alpha - 1) * epsilon
    inner = alpha / (2 * alpha - 1) * F.exp(x) + (alpha - 1) / (2 * alpha - 1) * F.exp(-alpha * epsilon)
    exact = F.ln(F.greatest(inner, F.lit(1e-300))) / (alpha - 1)
    lead = (x + F.ln(alpha / (2 * alpha - 1))) / (alpha - 1)
    return F.when(alpha <= 1, epsilon).when(x > OVERFLOW, lead).otherwise(exact)


def rdp_gaussian(alpha: Column, sensitivity: Column, sigma: Column) -> Column:
    return alpha * sensitivity * sensitivity / (2 * sigma * sigma)


def amplified(epsilon: Column, q: Column) -> Column:
    """Budget after subsampling at rate q."""
    return F.when(q <= 0, F.lit(0.0)).when(q >= 1, epsilon).otherwise(F.log1p(q * F.expm1(epsilon)))


def rdp_subsampled_laplace(alpha: Column, epsilon: Column, q: Column) -> Column:
    return rdp_laplace(alpha, amplified(epsilon, q))


def rdp_gaussian_subsampled(alpha: Column, q: Column, sigma: Column) -> Column:
    """First order in q up to a rate of 0.1, three terms of the moment beyond; approximations, not bounds."""
    small = q * q * alpha / (2 * sigma * sigma)
    near, far = (alpha - 1) / (sigma * sigma), alpha * (alpha - 1) / (2 * sigma * sigma)
    rest = F.pow(1 - q, alpha - 1)
    moment = rest * (1 - q) + F.when(near < OVERFLOW, q * rest * F.exp(near)).otherwise(F.lit(0.0)) + q * q * F.exp(F.least(far, F.lit(OVERFLOW)))
    return F.when((q <= 0.1) | (far >= OVERFLOW), small).otherwise(F.ln(moment) / (alpha - 1))


#: Orders of the bound for independent samples, which is proven for whole ones.
WHOLE_ALPHAS = (*range(2, 33), 40, 48, 64, 96, 128)


def rdp_gaussian_poisson(alpha: Column, q: Column, sigma: Column) -> Column:
    """Proven for whole orders where each step takes every row with probability q, independently (Mironov, Talwar, Zhang 2019).

    1 / (alpha - 1) ln of the sum over k of C(alpha, k) (1 - q)^(alpha - k) q^k exp((k^2 - k) / (2 sigma^2)).
    """
    a = alpha.cast("double")
    choose = lambda k: F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda s, j: s + F.when(j > 0, F.ln((a - j + 1) / j)).otherwise(F.lit(0.0)))
    term = lambda k: choose(k) + (a - k) * F.log1p(-q) + k * F.ln(q) + (k * k - k) / (2 * sigma * sigma)
    terms = F.transform(F.sequence(F.lit(0), alpha.cast("int")), term)
    top = F.array_max(terms)
    total = top + F.ln(F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.exp(t - top)))
    return F.when(q >= 1, rdp_gaussian(a, F.lit(1.0), sigma)).when(q <= 0, F.lit(0.0)).otherwise(total / (a - 1))


def poisson_epsilon(q: float, sigma: float, steps: int, delta: float = noise.DELTA) -> float:
    """The budget of so many steps by the same bound, for one setting."""
    best_ = math.inf
    for a in WHOLE_ALPHAS:
        k = np.arange(a + 1)
        choose = np.concatenate([[0.0], np.cumsum(np.log((a - k[1:] + 1) / k[1:]))])
        terms = choose + ((a - k) * math.log1p(-q) + k * math.log(q) if q < 1 else np.where(k == a, 0.0, -np.inf)) + (k * k - k) / (2 * sigma * sigma)
        rdp = (terms.max() + math.log(np.exp(terms - terms.max()).sum())) / (a - 1)
        best_ = min(best_, steps * rdp + math.log(1 / delta) / (a - 1))
    return best_


def poisson_sigma(q: float, steps: int, epsilon: float, delta: float = noise.DELTA) -> float | None:
    """The least noise (to a relative 1e-4, from above) whose steps stay within the budget; none where no noise does."""
    if math.log(1 / delta) / (WHOLE_ALPHAS[-1] - 1) >= epsilon:
        return None
    low, high = 0.05, 1.0
    while poisson_epsilon(q, high, steps, delta) > epsilon:
        low, high = high, 2 * high
        if high > 1e6:
            return None
    while high / low > 1.0001:
        mid = math.sqrt(low * high)
        low, high = (mid, high) if poisson_epsilon(q, mid, steps, delta) > epsilon else (low, mid)
    return high


def to_epsilon(rdp: Column, alpha: Column, delta: float = noise.DELTA) -> Column:
    return rdp + F.lit(math.log(1 / delta)) / (alpha - 1)


def best(curves: DataFrame, by: Sequence[str], delta: float = noise.DELTA) -> DataFrame:
    """by, epsilon, alpha: the least over the orders; of equal ones the smallest order. curves: by, alpha, rdp."""
    least = F.min(F.struct(to_epsilon(F.col("rdp"), F.col("alpha"), delta).alias("epsilon"), "alpha")).alias("b")
    return curves.groupBy(*by).agg(least).select(*by, "b.epsilon", "b.alpha")


def log_rdp(mechanism: Column, alpha: Column, epsilon: Column, sensitivity: Column, sigma: Column, q: Column) -> Column:
    """Renyi cost of one logged query. A Laplace budget is that of the release whatever the sensitivity."""
    laplace = F.when(q < 1, rdp_subsampled_laplace(alpha, epsilon, q)).otherwise(rdp_laplace(alpha, epsilon))
    return F.when(mechanism == "laplace", laplace).when(mechanism == "gaussian", rdp_gaussian(alpha, sensitivity, sigma))


def curve(log: DataFrame, alphas: Sequence[float] = ALPHAS, by: Sequence[str] = ()) -> DataFrame:
    """by, alpha, rdp: the summed curve of a query log, partially aggregated before the one shuffle."""
    rows = log.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    one = log_rdp(*[F.col(c) for c in ("mechanism", "alpha", "epsilon", "sensitivity", "sigma", "sampling_rate")])
    return rows.groupBy(*by, "alpha").agg(F.sum(one).alias("rdp"))


def spent(log: DataFrame, delta: float = noise.DELTA, by: Sequence[str] = ()) -> DataFrame:
    """by, n_queries, basic, advanced, rdp (never above basic), alpha of a query log. Basic bounds need pure budgets."""
    keys = [*by] or [F.lit(1).alias("_all")]
    names = [*by] or ["_all"]
    totals = log.groupBy(*keys).agg(F.count("*").alias("n_queries"), F.sum("epsilon").alias("basic"), F.sum(F.col("epsilon") * F.col("epsilon")).alias("_squares"), F.sum(F.col("epsilon") * F.expm1("epsilon")).alias("_drift"))
    rdp = best(curve(log.select("*", *[k for k in keys if not isinstance(k, str)]), by=names), names, delta)
    rows = totals.join(rdp, names)
    heterogeneous = F.sqrt(2 * F.lit(math.log(1 / delta)) * F.col("_squares")) + F.col("_drift")
    return rows.select(*by, "n_queries", "basic", heterogeneous.alias("advanced"), F.least("basic", "epsilon").alias("rdp"), "alpha")


def running(log: DataFrame, order: str, delta: float = noise.DELTA, by: Sequence[str] = ()) -> DataFrame:
    """by, order (a number), epsilon: the Renyi bound after each query of every group's log, by running sums over slices of the order."""
    costs, before = ([f"{name}{i}_" for i in range(len(ALPHAS))] for name in ("cost", "before"))
    given = [F.col(c) for c in ("epsilon", "sensitivity", "sigma", "sampling_rate")]
    each = [log_rdp(F.col("mechanism"), F.lit(float(a)), *given).alias(c) for a, c in zip(ALPHAS, costs, strict=True)]
    # a column an order: as rows, the log would be moved and sorted once an order
    summed = longform.running_sum(log.select(*by, order, *each), by, order, costs, before)
    least = F.least(*[to_epsilon(F.col(b) + F.col(c), F.lit(float(a)), delta) for a, b, c in zip(ALPHAS, before, costs, strict=True)])
    return summed.select(*by, order, least.alias("epsilon")).groupBy(*by, order).agg(F.min("epsilon").alias("epsilon"))


def composition(spark: SparkSession, epsilons: Sequence[float], ks: Sequence[int], delta: float = noise.DELTA) -> DataFrame:
    """mechanism, nominal_epsilon, n_queries, basic, advanced, rdp, best_alpha, and how much tighter than basic."""
    rows = grid(spark, mechanism=noise.MECHANISMS, nominal_epsilon=[float(e) for e in epsilons], n_queries=list(ks), alpha=[float(a) for a in ALPHAS])
    e, k, a = F.col("nominal_epsilon"), F.col("n_queries"), F.col("alpha")
    sigma = noise.gaussian_sigma(F.lit(1.0), e, delta)
    one = F.when(F.col("mechanism") == "laplace", rdp_laplace(a, e)).otherwise(rdp_gaussian(a, F.lit(1.0), sigma))
    found = best(rows.withColumn("rdp", k * one), ["mechanism", "nominal_epsilon", "n_queries"], delta)
    b, adv = basic(e, k), advanced(e, k, delta)
    return found.select(
        "mechanism", "nominal_epsilon", "n_queries", b.alias("basic"), adv.alias("advanced"), F.col("epsilon").alias("rdp"), F.col("alpha").alias("best_alpha"),
        (b / F.col("epsilon")).alias("rdp_vs_basic"), (b / adv).alias("advanced_vs_basic"),
    )


def sgd_spent(rows: DataFrame, delta: float = noise.DELTA) -> DataFrame:
    """rows (with n, batch, epochs, sigma) and steps, epsilon, alpha: the cost of noisy gradient descent."""
    keys = rows.columns
    steps = F.floor(F.col("epochs") * F.col("n") / F.col("batch")).cast("long")
    q = F.col("batch") / F.col("n")
    curves = rows.withColumn("steps", steps).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in SGD_ALPHAS])))
    curves = curves.withColumn("rdp", F.col("steps") * rdp_gaussian_subsampled(F.col("alpha"), q, F.col("sigma")))
    return best(curves, [*keys, "steps"], delta)


def sigma_for(rows: DataFrame, delta: float = noise.DELTA) -> DataFrame:
    """rows (with n, batch, epochs, epsilon) and sigma: the least noise that stays within epsilon; null if none does.

    Up to a sampling rate of 0.1 the cost of each order is c / sigma^2, which gives its sigma in closed form; null beyond.
    """
    keys, q = rows.columns, F.col("batch") / F.col("n")
    steps = F.floor(F.col("epochs") * F.col("n") / F.col("batch"))
    unit = steps * rdp_gaussian_subsampled(F.col("alpha"), q, F.lit(1.0))
    left = F.col("epsilon") - F.lit(math.log(1 / delta)) / (F.col("alpha") - 1)
    each = rows.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in SGD_ALPHAS]))).withColumn("s", F.when((left > 0) & (q <= 0.1), F.sqrt(unit / left)))
    return each.groupBy(*keys).agg(F.min("s").alias("sigma"))


def hockey_stick_laplace(epsilon0: Column, epsilon: Column) -> Column:
    """Exact delta of one Laplace release of budget epsilon0 at epsilon >= 0."""
    return F.greatest(F.lit(0.0), 1 - F.exp((epsilon - epsilon0) / 2))


def expected_error(mechanism: Column, sensitivity: Column, epsilon: Column, delta: float = noise.DELTA) -> Column:
    """Expected absolute error of a release."""
    gaussian = noise.gaussian_sigma(sensitivity, epsilon, delta) * math.sqrt(2 / math.pi)
    return F.when(mechanism == "laplace", sensitivity / epsilon).when(mechanism == "gaussian", gaussian)
