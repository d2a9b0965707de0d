"""Sensitivities of column statistics, from the long layout.

Bounds taken from the data are private themselves; every function accepts public bounds instead, as a table
(feature, lo, hi) or as thresholds. Features without values have sensitivity 1. Ratios of degenerate columns are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import scalars
from veilframe.operators import longform

QUERIES = ("mean", "sum", "count", "variance")
CLIP_SHARES = (0.90, 0.95, 0.99, 0.995)
#: Least width of a clipped range.
FLOOR = 1e-10
BETA = 0.01
K_MAX = 100


def global_of(query: str, n: Column, lo: Column, hi: Column) -> Column:
    """Change of the query when one row changes within [lo, hi]."""
    r, n = hi - lo, n.cast("double")
    value = {"mean": r / n, "sum": r, "count": F.lit(1.0), "variance": F.when(n > 1, r * r * (n - 1) / (n * n)).otherwise(F.lit(0.0))}.get(query, r / n)
    return F.when(n > 0, value).otherwise(F.lit(1.0))


def local_of(query: str, n: Column, mean: Column, lo: Column, hi: Column) -> Column:
    """Of the data at hand: the farthest value from the mean, or the greatest magnitude for sums."""
    n = n.cast("double")
    value = {"mean": F.greatest(hi - mean, mean - lo) / n, "sum": F.greatest(F.abs(lo), F.abs(hi))}.get(query)
    return F.when(n > 0, value).otherwise(F.lit(1.0)) if value is not None else global_of(query, n, lo, hi)


def bounded(stats: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """Replace lo and hi of ``longform.stats`` by public bounds."""
    if bounds is None:
        return stats
    return stats.drop("lo", "hi").join(F.broadcast(bounds.select("feature", "lo", "hi")), "feature")


def global_sensitivity(long: DataFrame, queries: Sequence[str] = QUERIES, bounds: DataFrame | None = None) -> DataFrame:
    """feature, query, n, sensitivity."""
    s = bounded(longform.stats(long), bounds)
    each = F.array(*[F.struct(F.lit(q).alias("query"), global_of(q, F.col("n"), F.col("lo"), F.col("hi")).alias("sensitivity")) for q in queries])
    return s.select("feature", "n", F.inline(each))


def local_sensitivity(long: DataFrame, queries: Sequence[str] = QUERIES) -> DataFrame:
    """feature, query, n, sensitivity."""
    s = longform.stats(long)
    each = F.array(*[F.struct(F.lit(q).alias("query"), local_of(q, F.col("n"), F.col("mean"), F.col("lo"), F.col("hi")).alias("sensitivity")) for q in queries])
    return s.select("feature", "n", F.inline(each))


def smooth_of(n: Column, mean: Column, lo: Column, hi: Column, beta: float = BETA, k_max: int = K_MAX) -> Column:
    """Smooth sensitivity of the mean: the local one, or at k changed rows e^(-beta k) min(global, range k / (n - k))."""
    gs, ls = global_of("mean", n, lo, hi), local_of("mean", n, mean, lo, hi)
    steps = F.least(F.lit(k_max), F.floor(n / 2)).cast("int")
    at = F.transform(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), lambda k: F.exp(-F.lit(beta) * k) * F.least(gs, (hi - lo) * k / (n - k)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.when(steps >= 1, F.greatest(ls, F.array_max(at))).otherwise(ls))


def smooth_sensitivity(long: DataFrame, beta: float = BETA, k_max: int = K_MAX) -> DataFrame:
    """feature, n, sensitivity of the mean."""
    s = longform.stats(long)
    return s.select("feature", "n", smooth_of(F.col("n"), F.col("mean"), F.col("lo"), F.col("hi"), beta, k_max).alias("sensitivity"))


def thresholds(long: DataFrame, shares: Sequence[float], exact: bool = True) -> DataFrame:
    """feature, share, tau: upper clip bounds by percentile."""
    found = longform.percentiles(long, shares) if exact else longform.approx_percentiles(long, shares)
    return found.withColumnRenamed("value", "tau")


def clipped_sensitivity(long: DataFrame, shares: Sequence[float] = CLIP_SHARES, query: str = "mean", taus: DataFrame | None = None) -> DataFrame:
    """feature, share, n, tau, gs_raw, gs_clipped, frac_above, bias_bound, relative_bias_pct, noise_reduction.

    Clipping at tau narrows the range to tau - lo. Reduction and relative bias are null for constant columns. ``taus``
    (feature, share, tau) replaces the percentiles of the data.
    """
    total = query == "sum"
    n = F.col("n").cast("double")
    edges = longform.stats(long).join(F.broadcast(taus if taus is not None else thresholds(long, shares)), "feature")
    edges = edges.withColumn("tau", F.greatest("tau", F.col("lo") + FLOOR))
    # a feature's rows meet every share of its thresholds: the thresholds are a handful a feature
    above = longform.present(long).join(F.broadcast(edges.select("feature", "share", "tau")), "feature")
    above = above.groupBy("feature", "share").agg(F.avg((F.col("x") > F.col("tau")).cast("double")).alias("frac_above"))
    wide, narrow = F.col("hi") - F.col("lo"), F.col("tau") - F.col("lo")
    rows = edges.join(above, ["feature", "share"]).select(
        "feature", "share", "n", "tau", "mean", "hi", "lo", "frac_above",
        (wide if total else wide / n).alias("gs_raw"), F.greatest(narrow if total else narrow / n, F.lit(FLOOR)).alias("gs_clipped"),
        (F.col("frac_above") * F.greatest(F.col("hi") - F.col("tau"), F.lit(0.0)) * (n if total else F.lit(1.0))).alias("bias_bound"),
    )
    size = F.abs(F.col("mean")) * (F.col("n") if total else F.lit(1.0))
    return rows.select(
        "feature", "share", "n", "tau", "gs_raw", "gs_clipped", "frac_above", "bias_bound",
        (100 * scalars.ratio(F.col("bias_bound"), size)).alias("relative_bias_pct"),
        F.when(F.col("hi") > F.col("lo"), F.col("gs_raw") / F.col("gs_clipped")).alias("noise_reduction"),
    )


def clipped_mean(long: DataFrame, taus: DataFrame) -> DataFrame:
    """feature, clipped_mean: mean of values clipped to [lo of the data, tau]. taus: feature, tau."""
    edges = longform.stats(long).select("feature", "lo").join(F.broadcast(taus.select("feature", "tau")), "feature")
    rows = longform.present(long).join(F.broadcast(edges), "feature")
    return rows.groupBy("feature").agg(F.avg(scalars.clip(F.col("x"), F.col("lo"), F.col("tau"))).alias("clipped_mean"))


def record_bounds(long: DataFrame, method: str = "clipped", share: float = 0.99) -> DataFrame:
    """feature, sensitivity of releasing a record's value (its range, clipped range, or two deviations), tau to clip at (null where not clipped)."""
    s = longform.stats(long)
    if method == "clipped":
        s = s.join(F.broadcast(thresholds(long, [share]).select("feature", "tau")), "feature", "left")
        value = F.greatest(F.col("tau") - F.col("lo"), F.lit(FLOOR))
    elif method in ("range", "std"):
        s = s.withColumn("tau", F.lit(None).cast("double"))
        value = F.col("hi") - F.col("lo") if method == "range" else 2 * F.sqrt("var_pop")
    else:
        raise ValueError(f"unknown method {method!r}; clipped, range or std")
    return s.select("feature", F.when(F.col("n") > 0, F.greatest(value, F.lit(1e-8))).otherwise(F.lit(1.0)).alias("sensitivity"), "tau")


def record_sensitivity(long: DataFrame, method: str = "clipped", share: float = 0.99) -> DataFrame:
    """feature, sensitivity of releasing a record's value."""
    return record_bounds(long, method, share).select("feature", "sensitivity")


def report(long: DataFrame, share: float = 0.99) -> DataFrame:
    """feature, n, gs, ls, ss, ls_to_gs, tau, gs_clipped, noise_reduction: of the mean."""
    s = longform.stats(long)
    n, mean, lo, hi = (F.col(c) for c in ("n", "mean", "lo", "hi"))
    rows = s.select("feature", "n", global_of("mean", n, lo, hi).alias("gs"), local_of("mean", n, mean, lo, hi).alias("ls"), smooth_of(n, mean, lo, hi).alias("ss"))
    clipped = clipped_sensitivity(long, [share]).select("feature", "tau", "gs_clipped", "noise_reduction")
    return rows.withColumn("ls_to_gs", scalars.ratio(F.col("ls"), F.col("gs"))).join(clipped, "feature", "left")
