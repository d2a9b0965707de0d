"""Noisy releases of records and aggregates, local mechanisms over whole columns, membership-inference audits.

Scalars by feature (sensitivity, budget, bounds) are tables with one row a feature, broadcast to the long layout;
runs and grids of settings are exploded from one row. Uniforms come from ``uniforms``: hashes of a row key under a seed
(reruns agree, whatever the partitioning), or ``rand()`` where the seed is None.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import noise, scalars
from veilframe.operators import accounting, longform, sensitivity


def uniforms(df: DataFrame, key: Column, streams: Sequence[str], seed: int | None) -> DataFrame:
    """Adds one column a stream. They are made once and then read, also where an expression needs them twice."""
    if seed is None:
        return df.withColumns({s: F.greatest(F.rand(), F.lit(1e-16)) for s in streams})
    return df.withColumns({s: noise.keyed_uniform(seed, s, key) for s in streams})


def perturb(long: DataFrame, settings: DataFrame, mechanism: str = "laplace", seed: int | None = None, delta: float = noise.DELTA) -> DataFrame:
    """key, [label,] feature, x, released. settings: feature, sensitivity, eps, and optionally tau and floor to clip at from above and below.

    The noise is calibrated to the sensitivity of a record, so clip where the sensitivity is a clipped one.
    """
    rows = longform.present(long).join(F.broadcast(settings), "feature")
    rows = uniforms(rows, F.concat_ws("|", "feature", "key"), ["u1", "u2"], seed)
    low, high = (F.col(c) if c in settings.columns else None for c in ("floor", "tau"))
    x = scalars.clip(F.col("x"), low, high)
    eps = F.greatest("eps", F.lit(1e-6))
    released = x + noise.dp_noise(mechanism, F.col("sensitivity"), eps, F.col("u1"), F.col("u2"), delta)
    return rows.select(*[c for c in long.columns if c != "x"], "x", released.alias("released"))


def uniform_settings(long: DataFrame, epsilon: float, method: str = "clipped", share: float = 0.99) -> DataFrame:
    """feature, sensitivity, eps, tau (null: no clipping): the budget split evenly over the features."""
    d = long.agg(F.count_distinct("feature").alias("d"))
    return sensitivity.record_bounds(long, method, share).crossJoin(F.broadcast(d)).withColumn("eps", F.lit(float(epsilon)) / F.col("d")).drop("d")  # one row


def weighted_settings(long: DataFrame, allocated: DataFrame, method: str = "clipped", share: float = 0.99) -> DataFrame:
    """feature, sensitivity, eps, tau (null: no clipping). allocated: feature, eps."""
    return sensitivity.record_bounds(long, method, share).join(F.broadcast(allocated.select("feature", "eps")), "feature")


def errors(released: DataFrame) -> DataFrame:
    """feature, n, mean_abs_error, rmse of a perturbed table."""
    d = F.col("released") - F.col("x")
    return released.groupBy("feature").agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mean_abs_error"), F.sqrt(F.avg(d * d)).alias("rmse"))


def aggregates(long: DataFrame, epsilons: Sequence[float], runs: int, seed: int | None = None, mechanisms: Sequence[str] = noise.MECHANISMS) -> DataFrame:
    """feature, mechanism, epsilon, sensitivity, noise_variance, and mean and deviation of the absolute error of releasing

    the mean (post) and of a mean from a noisy sum (agg), over ``runs`` releases.
    """
    s = longform.stats(long)
    one = s.select("feature", "n", "mean", "total", sensitivity.global_of("mean", F.col("n"), F.col("lo"), F.col("hi")).alias("sensitivity"), (F.col("hi") - F.col("lo")).alias("range"))
    for name, values in (("mechanism", list(mechanisms)), ("epsilon", [float(e) for e in epsilons]), ("run", list(range(runs)))):
        one = one.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    key = F.concat_ws("|", "feature", "mechanism", F.round(F.col("epsilon") * 1000).cast("long").cast("string"), F.col("run").cast("string"))
    one = uniforms(one, key, ["u1", "u2", "u3", "u4"], seed)
    pick = lambda s, u, v: F.when(F.col("mechanism") == "laplace", noise.dp_noise("laplace", s, F.col("epsilon"), F.col(u), F.col(v))).otherwise(noise.dp_noise("gaussian", s, F.col("epsilon"), F.col(u), F.col(v)))
    post = F.abs(pick(F.col("sensitivity"), "u1", "u2"))
    agg = F.abs((F.col("total") + pick(F.col("range"), "u3", "u4")) / F.col("n") - F.col("mean"))
    rows = one.withColumns({"post": post, "agg": agg}).groupBy("feature", "mechanism", "epsilon", "sensitivity").agg(
        F.avg("post").alias("post_mean_error"), F.stddev_pop("post").alias("post_std_error"), F.avg("agg").alias("agg_mean_error"), F.stddev_pop("agg").alias("agg_std_error")
    )
    return rows.withColumn("noise_variance", noise.noise_variance(F.col("mechanism"), F.col("sensitivity"), F.col("epsilon")))


def shuffled_mean(long: DataFrame, epsilon: float, seed: int | None = None) -> DataFrame:
    """feature, n, mean, released_mean: the mean of records that each carry Laplace noise of their whole range."""
    s = longform.stats(long).select("feature", (F.col("hi") - F.col("lo")).alias("sensitivity"), F.lit(float(epsilon)).alias("eps"))
    return perturb(long, s, "laplace", seed).groupBy("feature").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.avg("released").alias("released_mean"))


def choose(df: DataFrame, group: str, candidate: str, utility: Column, sensitivity_: float, epsilon: float, seed: int | None = None) -> DataFrame:
    """group, candidate: one draw of the exponential mechanism a group (each candidate one row), as the greatest Gumbel score."""
    rows = uniforms(df.withColumn("_utility", utility), F.concat_ws("|", group, candidate), ["u"], seed)
    score = noise.gumbel_score(F.col("_utility"), sensitivity_, F.lit(float(epsilon)), F.col("u"))
    return rows.groupBy(group).agg(F.max_by(candidate, score).alias(candidate))


LOCAL = ("laplace", "duchi", "piecewise")


def _local_draws(long: DataFrame, stats: DataFrame, key: Column, seed: int | None) -> DataFrame:
    """long with each feature's lo and hi, and u1, u2, u3: three parts of one hash, or ``rand()``."""
    rows = longform.present(long).join(F.broadcast(stats.select("feature", "lo", "hi")), "feature")
    if seed is None:
        return uniforms(rows, key, ["u1", "u2", "u3"], seed)
    rows = rows.withColumn("_digest", noise.keyed_digest(seed, "local", key))
    return rows.withColumns({f"u{i + 1}": noise.uniform_part(F.col("_digest"), i) for i in range(3)}).drop("_digest")


def _local_release(mechanism: str, e: Column) -> Column:
    x, lo, hi, u1, u2, u3 = (F.col(c) for c in ("x", "lo", "hi", "u1", "u2", "u3"))
    if mechanism == "laplace":
        return x + noise.laplace(u1, (hi - lo) / e)
    return noise.ldp_duchi(x, lo, hi, e, u1) if mechanism == "duchi" else noise.ldp_piecewise(x, lo, hi, e, u1, u2, u3)


def local_reports(long: DataFrame, epsilons: Sequence[float], seed: int | None = None, mechanisms: Sequence[str] = LOCAL) -> DataFrame:
    """key, feature, mechanism, epsilon, x, released: every record's report under each mechanism and budget."""
    rows = _local_draws(long, longform.stats(long), F.concat_ws("|", "feature", "key"), seed)
    rows = rows.withColumn("epsilon", F.explode(F.array(*[F.lit(float(e)) for e in epsilons])))
    each = F.array(*[F.struct(F.lit(m).alias("mechanism"), _local_release(m, F.col("epsilon")).alias("released")) for m in mechanisms])
    return rows.select("key", "feature", "epsilon", "x", F.inline(each))


RUNS = 20


def local_experiment(long: DataFrame, epsilons: Sequence[float], seed: int | None = None, runs: int = RUNS) -> DataFrame:
    """feature, mechanism, epsilon, n, mean, estimate, abs_error, std_error, central_error, theoretical_rmse, central_rmse, penalty.

    estimate, abs_error and std_error: mean estimate, mean and deviation of the absolute error over ``runs`` collections of reports.
    central_error: the mean absolute error of as many Laplace releases of the mean with the same budget.
    penalty: the mechanism's theoretical error over that of the central Laplace mean with the same budget (mean squared).
    """
    s = longform.stats(long)
    scale = s.select("feature", (F.col("hi") - F.col("lo")).alias("range"))
    each = long.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    rows = _local_draws(each, s, F.concat_ws("|", "feature", "key", F.col("run").cast("string")), seed)
    by = ["feature", "mechanism", "epsilon"]
    # all mechanisms and budgets in one pass: a column of sums each, not a row each for every reading
    cells = [(m, float(e)) for m in LOCAL for e in epsilons]
    sums = rows.groupBy("feature", "run").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), *[F.avg(_local_release(m, F.lit(e))).alias(f"_{i}") for i, (m, e) in enumerate(cells)])
    named = F.array(*[F.struct(F.lit(m).alias("mechanism"), F.lit(e).alias("epsilon"), F.col(f"_{i}").alias("estimate")) for i, (m, e) in enumerate(cells)])
    one = sums.select("feature", "run", "n", "mean", F.inline(named))
    off = F.abs(F.col("estimate") - F.col("mean"))
    got = one.groupBy(*by).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.avg("estimate").alias("estimate"), F.avg(off).alias("abs_error"), F.stddev_pop(off).alias("std_error"))
    drawn = aggregates(long, epsilons, runs, seed, ["laplace"]).select("feature", "epsilon", F.col("post_mean_error").alias("central_error"))
    rows = got.join(F.broadcast(scale), "feature").join(F.broadcast(drawn), ["feature", "epsilon"])
    n, r, e = F.col("n").cast("double"), F.col("range"), F.col("epsilon")
    mse, central = noise.ldp_mse(F.col("mechanism"), r, e, n), 2 * F.pow(r / n / e, F.lit(2))
    return rows.select(
        "feature", "mechanism", "epsilon", "n", "mean", "estimate", "abs_error", "std_error", "central_error",
        F.sqrt(mse).alias("theoretical_rmse"), F.sqrt(central).alias("central_rmse"), scalars.ratio(mse, central).alias("penalty"),
    )


# Membership inference


def mia_bound(epsilon: Column) -> tuple[Column, Column]:
    """Greatest accuracy and advantage that a pure budget allows."""
    e = F.exp(epsilon)
    return e / (1 + e), (e - 1) / (e + 1)


def attack_bounds(mechanism: Column, epsilon: Column, delta: float = noise.DELTA) -> tuple[Column, Column]:
    """Greatest accuracy against any release with that budget, and against this mechanism calibrated to it.

    (e^eps + delta) / (1 + e^eps), delta 0 for a pure budget; and half of 1 + the total variation between the releases with and without the
    target: 1 - e^(-eps / 2) / 2 for Laplace, and the Gaussian trade-off curve at its middle, cdf(mu / 2) with mu = sensitivity / sigma.
    """
    e, gaussian = F.exp(epsilon), mechanism == "gaussian"
    budget = (e + F.when(gaussian, F.lit(delta)).otherwise(F.lit(0.0))) / (1 + e)
    mu = epsilon / math.sqrt(2 * math.log(1.25 / delta))
    return budget, F.when(gaussian, scalars.norm_cdf(mu / 2)).otherwise(1 - F.exp(-epsilon / 2) / 2)


def log_choose(n: Column, k: Column) -> Column:
    """ln of n over k; 0 for k below 1."""
    n, k = n.cast("double"), k.cast("double")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1.0)).cast("int")), F.lit(0.0), lambda s, j: s + F.when(j <= k, F.ln((n - k + j) / j)).otherwise(F.lit(0.0)))


def binomial_tail(hits: Column, n: Column, p: Column, logs: tuple[Column, Column] | None = None) -> Column:
    """P(X >= hits) of n trials: terms by recurrence away from the mode, so that what underflows is nothing. logs: ``log_choose`` of hits and of
    hits - 1 where they are known."""
    logs = logs or (log_choose(n, hits), log_choose(n, hits - 1))
    h, n = hits.cast("double"), n.cast("double")

    def walk(k: Column, log: Column, steps: Column, ratio) -> Column:
        first = F.exp(log + k * F.ln(p) + (n - k) * F.log1p(-p))
        start = F.struct(first.alias("t"), first.alias("s"))
        more = lambda a, j: F.struct((a["t"] * ratio(k, j)).alias("t"), (a["s"] + a["t"] * ratio(k, j)).alias("s"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1.0)).cast("int")), start, lambda a, j: F.when(j <= steps, more(a, j)).otherwise(a))["s"]

    up = walk(h, logs[0], n - h, lambda k, j: (n - k - j + 1) / (k + j) * p / (1 - p))
    down = walk(h - 1, logs[1], h - 1, lambda k, j: (k - j + 1) / (n - k + j) * (1 - p) / p)
    return F.when(h <= 0, F.lit(1.0)).when(p * n <= h, up).otherwise(1 - down)


def binomial_limits(hits: Column, n: Column, confidence: float = 0.95, logs: tuple[Column, Column, Column] | None = None) -> tuple[Column, Column]:
    """The exact (Clopper and Pearson) interval of a share, by bisection. logs: ``log_choose`` of hits - 1, hits and hits + 1 where they are known."""
    out = (1 - confidence) / 2
    below, at, above = logs or tuple(log_choose(n, hits + i) for i in (-1, 0, 1))

    def lower(h: Column, logs: tuple[Column, Column]) -> Column:
        def halved(a: Column, _: Column) -> Column:
            mid = (a["lo"] + a["hi"]) / 2
            low = binomial_tail(h, n, mid, logs) < out
            return F.struct(F.when(low, mid).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(mid).alias("hi"))

        start = F.struct(F.lit(0.0).alias("lo"), (h / n).cast("double").alias("hi"))
        return F.when(h <= 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halved)["lo"])

    return lower(hits, (at, below)), 1 - lower(n - hits, (at, above))


def judged(found: DataFrame, trials: int, confidence: float = 0.95, delta: float = noise.DELTA) -> DataFrame:
    """found (of ``mia``, ``trials`` with and as many without the target): with the bounds of the budget and of the mechanism, the exact
    interval of the accuracy, and VIOLATED only where the whole interval lies above the budget's bound."""
    n = F.lit(2 * trials)
    budget, mechanism = attack_bounds(F.col("mechanism"), F.col("epsilon"), delta)
    rows = found.withColumn("hits", F.round(F.col("accuracy") * 2 * trials).cast("long"))
    names = ["_log_below", "_log_at", "_log_above"]
    rows = rows.withColumns({c: log_choose(n, F.col("hits") + i) for c, i in zip(names, (-1, 0, 1), strict=True)})
    low, high = binomial_limits(F.col("hits"), n, confidence, tuple(map(F.col, names)))
    rows = rows.withColumns({"budget_bound": budget, "mechanism_bound": mechanism, "low": low, "high": high}).drop(*names)
    return rows.withColumn("status", F.when(F.col("low") > F.col("budget_bound"), "VIOLATED").otherwise("VALID"))


def log_density(mechanism: Column, x: Column, centre: Column, scale: Column) -> Column:
    """Up to a constant that is the same for both centres."""
    d = (x - centre) / scale
    return F.when(mechanism == "laplace", -F.abs(d)).otherwise(-d * d / 2)


def mia(means: DataFrame, epsilons: Sequence[float], trials: int, seed: int | None = None, mechanisms: Sequence[str] = noise.MECHANISMS) -> DataFrame:
    """feature, mechanism, epsilon, accuracy, advantage, auc, max_accuracy, max_advantage, margin.

    means: feature, mean, sensitivity. Each trial releases the mean with (IN) or without (OUT: shifted by the whole
    sensitivity) a target; the attack says IN where the likelihood ratio is above 1.
    """
    from veilframe.operators import metrics

    rows = means
    for name, values in (("mechanism", list(mechanisms)), ("epsilon", [float(e) for e in epsilons]), ("member", [0, 1])):
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    rows = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    key = F.concat_ws("|", "feature", "mechanism", F.round(F.col("epsilon") * 1000).cast("long").cast("string"), F.col("member").cast("string"), F.col("trial").cast("string"))
    rows = uniforms(rows, key, ["u1", "u2"], seed)
    s, e, m = F.col("sensitivity"), F.col("epsilon"), F.col("mechanism")
    scale = F.when(m == "laplace", s / e).otherwise(noise.gaussian_sigma(s, e))
    drawn = F.when(m == "laplace", noise.laplace(F.col("u1"), s / e)).otherwise(noise.gaussian(F.col("u1"), F.col("u2"), noise.gaussian_sigma(s, e)))
    out = F.col("mean") - s
    rows = rows.withColumn("scale", scale).withColumn("seen", F.when(F.col("member") == 1, F.col("mean")).otherwise(out) + drawn)
    rows = rows.withColumn("llr", F.round(log_density(m, F.col("seen"), F.col("mean"), F.col("scale")) - log_density(m, F.col("seen"), out, F.col("scale")), 9))
    by = ["feature", "mechanism", "epsilon"]
    hits = rows.groupBy(*by).agg(F.avg(((F.col("llr") > 0) == (F.col("member") == 1)).cast("double")).alias("accuracy"))
    curve = metrics.auc(rows, "llr", F.col("member") == 1, by).select(*by, "auc")
    top, gap = mia_bound(F.col("epsilon"))
    found = hits.join(curve, by)
    return found.select(*by, "accuracy", (2 * F.col("accuracy") - 1).alias("advantage"), "auc", top.alias("max_accuracy"), gap.alias("max_advantage"), (top - F.col("accuracy")).alias("margin"))


def amplification(spark, epsilons: Sequence[float], rates: Sequence[float], delta: float = noise.DELTA) -> DataFrame:
    """mechanism, epsilon, sampling_rate, amplified_epsilon, amplified_delta, ratio."""
    rows = accounting.grid(spark, mechanism=noise.MECHANISMS, epsilon=[float(e) for e in epsilons], sampling_rate=[float(q) for q in rates])
    a = accounting.amplified(F.col("epsilon"), F.col("sampling_rate"))
    return rows.select("*", a.alias("amplified_epsilon"), (F.col("sampling_rate") * delta).alias("amplified_delta"), scalars.ratio(F.col("epsilon"), a).alias("ratio"))
