"""The release pipeline: label and features in, a noisy table out, in two passes over the rows.

The first pass gathers every statistic (counts, bounds, joint counts for the importance, thresholds); the second adds noise.
What joins the passes is one row a feature.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe import runtime
from veilframe.functions import noise
from veilframe.operators import budget, longform, private, release, sensitivity


class Release(NamedTuple):
    """rows: key, label, feature, x, released. settings: feature, weight, eps, sensitivity, tau. log: what the release spends, for the
    accountant, where every figure that it rests on has a budget; none where some come from the data at no budget."""

    rows: DataFrame
    settings: DataFrame
    log: DataFrame | None = None


def release_table(
    df: DataFrame, label: str, features: Sequence[str] | None, epsilon: float, method: str = "mi", mechanism: str = "laplace",
    key: Column | None = None, share: float = 0.99, bounds: DataFrame | None = None, seed: int | None = None, delta: float = noise.DELTA,
) -> Release:
    """Noisy records under a budget split by importance.

    ``features`` defaults to the numeric columns but the label. ``bounds`` (feature, lo, tau), public, replaces the data's least values
    and percentiles. Without a seed the noise is drawn anew on every evaluation, so write the result once.
    """
    features = list(features) if features is not None else longform.numeric_columns(df, [label])
    long = longform.unpivot(df, features, label, key if key is not None else F.monotonically_increasing_id())
    weighted = budget.allocate(budget.weights(budget.scores(long, [method])), [epsilon]).select("feature", "weight", "eps")
    if bounds is not None:
        s = bounds.select("feature", "tau", F.greatest(F.col("tau") - F.col("lo"), F.lit(1e-8)).alias("sensitivity"))
        settings = weighted.join(F.broadcast(s), "feature")
    else:
        settings = weighted.join(F.broadcast(release.weighted_settings(long, weighted, "clipped", share).drop("eps")), "feature")
    return Release(release.perturb(long, settings.select("feature", "eps", "sensitivity", "tau"), mechanism, seed, delta), settings)


def release_private(
    df: DataFrame, label: str, domain: DataFrame, labels: Sequence[str], epsilon: float, method: str = "mi", mechanism: str = "laplace",
    key: Column | None = None, share: float = 0.99, bounds_share: float = 0.1, weights_share: float = 0.1, seed: int | None = None, delta: float = noise.DELTA,
) -> Release:
    """``release_table`` without any figure of the data at no budget: ``bounds_share`` of epsilon buys the clipping thresholds, ``weights_share`` the
    importance (nothing for the uniform split), and the rest is for the records.

    Public are domain (feature, low, high), its features, and the list of labels. Records are clipped to low .. threshold. The label of a
    record is released as it is, as in ``release_table``, and is not covered.
    """
    weights_share = 0.0 if method == "uniform" else weights_share
    if not 0 < bounds_share + weights_share < 1:
        raise ValueError("shares for bounds and weights must leave something for the records")
    features = [r.feature for r in domain.select("feature").orderBy("feature").collect()]  # the caller's own list
    long = longform.unpivot(df, features, label, key if key is not None else F.monotonically_increasing_id())
    taus = runtime.materialize(private.percentiles(long, domain, [share], epsilon * bounds_share, seed=seed), "taus")
    parts = [taus]
    if method == "uniform":
        scored = domain.select(F.lit(method).alias("method"), "feature", F.lit(1.0).alias("score"))
    else:
        counts = runtime.materialize(private.joint_counts(long, domain, labels, epsilon * weights_share, seed=seed), "counts")
        scored = private.scores(counts, [method])
        parts.append(counts.select("feature", "eps").distinct())
    weighted = budget.allocate(budget.weights(scored), [epsilon * (1 - bounds_share - weights_share)]).select("feature", "weight", "eps")
    bounds = domain.join(taus.select("feature", F.col("value").alias("tau")), "feature")
    bounds = bounds.select("feature", "tau", F.col("low").alias("floor"), F.greatest(F.col("tau") - F.col("low"), F.lit(1e-8)).alias("sensitivity"))
    settings = runtime.materialize(weighted.join(F.broadcast(bounds), "feature"), "settings")
    rows = release.perturb(long, settings.select("feature", "eps", "sensitivity", "tau", "floor"), mechanism, seed, delta)
    spent = private.spends(*parts)
    if mechanism == "laplace":
        spent = spent.unionByName(private.spends(settings))
    else:
        sigma = noise.gaussian_sigma(F.col("sensitivity"), F.col("eps"), delta)
        spent = spent.unionByName(settings.select(F.lit(mechanism).alias("mechanism"), F.lit(None).cast("double").alias("epsilon"), "sensitivity", sigma.alias("sigma"), F.lit(1.0).alias("sampling_rate")))
    return Release(rows, settings, spent)


def wide(made: Release, features: Sequence[str]) -> DataFrame:
    """The released table with a column a feature, for keys that are unique."""
    return made.rows.groupBy("key", "label").pivot("feature", list(features)).agg(F.first("released"))


def checked(made: Release) -> DataFrame:
    """feature, n, weight, eps, tau, released_mean, mean_abs_error."""
    got = made.rows.groupBy("feature").agg(F.count("*").alias("n"), F.avg("released").alias("released_mean"), F.avg(F.abs(F.col("released") - F.col("x"))).alias("mean_abs_error"))
    return got.join(made.settings, "feature").select("feature", "n", "weight", "eps", "tau", "released_mean", "mean_abs_error")


def sweep(df: DataFrame, label: str, features: Sequence[str], epsilons: Sequence[float], methods: Sequence[str] = budget.METHODS) -> DataFrame:
    """The budget summary of every method and total: scores are made once for the whole grid."""
    long = longform.unpivot(df, features, label)
    return budget.summary(budget.allocate(budget.weights(budget.scores(long, methods)), epsilons))


def clip_sweep(df: DataFrame, features: Sequence[str], shares: Sequence[float] = sensitivity.CLIP_SHARES) -> DataFrame:
    """Clipped sensitivities of every feature at every share."""
    return sensitivity.clipped_sensitivity(longform.unpivot(df, features), shares)
