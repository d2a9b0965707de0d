"""Feature importance, and the split of a privacy budget by it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators import longform

METHODS = ("mi", "variance", "snr", "uniform")
EPSILONS = (0.1, 0.3, 0.5, 1.0, 2.0, 5.0)


def _finite(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))


def scores(long: DataFrame, methods: Sequence[str] = METHODS, bins: int = longform.BINS) -> DataFrame:
    """method, feature, score. All methods but mutual information share one pass."""
    n = F.col("n").cast("double")
    snr = F.when(n >= 2, F.sqrt("var_samp") / ((F.col("hi") - F.col("lo")) / n + 1e-10)).otherwise(F.lit(0.0))
    simple = {"variance": _finite(F.col("var_samp")), "snr": _finite(snr), "uniform": F.lit(1.0)}
    wanted = [m for m in methods if m in simple]
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown methods {sorted(unknown)}; of {METHODS}")
    each = [F.struct(F.lit(m).alias("method"), simple[m].alias("score")) for m in wanted]
    parts = [longform.stats(long).select("feature", F.inline(F.array(*each))).select("method", "feature", "score")] if each else []
    if "mi" in methods:
        parts.append(longform.mutual_information(long, bins).select(F.lit("mi").alias("method"), "feature", F.col("mi").alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weights(scored: DataFrame) -> DataFrame:
    """method, feature, score, weight: shares of the scores, none below 1 / (100 d), summing to 1 a method.

    A method whose scores are all zero weighs its features alike. One row a feature meets in a method's window.
    """
    w = Window.partitionBy("method")
    total, d = F.sum("score").over(w), F.count("*").over(w)
    share = F.when(total > 0, F.col("score") / total).otherwise(1 / d)
    floored = scored.withColumn("weight", F.greatest(share, 1 / (100 * d)))
    return floored.withColumn("weight", F.col("weight") / F.sum("weight").over(w))


def allocate(weighted: DataFrame, epsilons: Sequence[float] = EPSILONS) -> DataFrame:
    """method, feature, weight, eps_total, eps: the budget of each feature sums to eps_total."""
    grid = F.explode(F.array(*[F.lit(float(e)) for e in epsilons])).alias("eps_total")
    return weighted.select("method", "feature", "weight", grid).withColumn("eps", F.col("eps_total") * F.col("weight"))


def summary(allocated: DataFrame, top: int = 3) -> DataFrame:
    """method, eps_total, n_features, top_features (feature=eps by falling eps), min_eps, max_eps, ratio."""
    order = F.row_number().over(Window.partitionBy("method", "eps_total").orderBy(F.desc("eps"), "feature"))
    named = F.format_string("%s=%.4f", "feature", "eps")
    ranked = allocated.withColumn("rank", order)
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", named.alias("name")))))
    rows = ranked.groupBy("method", "eps_total").agg(F.count("*").alias("n_features"), first.alias("first"), F.min("eps").alias("min_eps"), F.max("eps").alias("max_eps"))
    return rows.select(
        "method", "eps_total", "n_features", F.array_join("first.name", " | ").alias("top_features"), "min_eps", "max_eps", (F.col("max_eps") / F.col("min_eps")).alias("ratio")
    )


def report(long: DataFrame, eps_total: float = 1.0) -> DataFrame:
    """feature, sensitivity, and for each method its weight, budget and Laplace scale (sensitivity / budget)."""
    from veilframe.operators import sensitivity

    rows = allocate(weights(scores(long)), [eps_total])
    gs = sensitivity.global_sensitivity(long, ["mean"]).select("feature", "sensitivity")
    wide = rows.groupBy("feature").pivot("method", list(METHODS)).agg(F.first("weight").alias("weight"), F.first("eps").alias("eps"))
    out = gs.join(wide, "feature")
    return out.select("feature", "sensitivity", *[c for m in METHODS for c in (f"{m}_weight", f"{m}_eps", (F.col("sensitivity") / F.col(f"{m}_eps")).alias(f"{m}_scale"))])
