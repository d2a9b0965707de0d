"""Evaluation: confidence intervals, classification metrics, ranking and paired tests. All are grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import scalars
from veilframe.operators import longform


def ci95(df: DataFrame, value: str, by: Sequence[str], sample: bool = True) -> DataFrame:
    """by, n, mean, half_width: 1.96 s / sqrt(n); s of the sample, or of the population."""
    s = F.stddev_samp(value) if sample else F.stddev_pop(value)
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (1.96 * s / F.sqrt(F.count(value).cast("double"))).alias("half_width"))


def confusion(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """by, y, yhat, k. Everything below works on these few rows."""
    return df.groupBy(*by, F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count("*").alias("k"))


def binary(counts: DataFrame, by: Sequence[str] = (), positive: int = 1) -> DataFrame:
    """by, n, accuracy, precision, recall, f1 of the positive class; 0 where a denominator is 0."""
    p, q = F.col("y") == positive, F.col("yhat") == positive
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0)).cast("double")
    sums = counts.groupBy(*by).agg(F.sum("k").alias("n"), total(F.col("y") == F.col("yhat")).alias("hit"), total(p & q).alias("tp"), total(~p & q).alias("fp"), total(p & ~q).alias("fn"))
    zero = F.lit(0.0)
    return sums.select(
        *by, "n", (F.col("hit") / F.col("n")).alias("accuracy"),
        scalars.ratio(F.col("tp"), F.col("tp") + F.col("fp"), zero).alias("precision"),
        scalars.ratio(F.col("tp"), F.col("tp") + F.col("fn"), zero).alias("recall"),
        scalars.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), zero).alias("f1"),
    )


def per_class(counts: DataFrame, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """by, class, support, recall (null without support), f1 (0 then). Every class has a row in every group."""
    each = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    rows = counts.select("*", each)
    p, q = F.col("y") == F.col("class"), F.col("yhat") == F.col("class")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0)).cast("double")
    sums = rows.groupBy(*by, "class").agg(total(p & q).alias("tp"), total(~p & q).alias("fp"), total(p & ~q).alias("fn"))
    support = F.col("tp") + F.col("fn")
    return sums.select(
        *by, "class", support.cast("long").alias("support"), scalars.ratio(F.col("tp"), support).alias("recall"),
        scalars.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0.0)).alias("f1"),
    )


def macro_f1(counts: DataFrame, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """by, macro_f1 over all classes, absent ones as 0."""
    return per_class(counts, classes, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def auc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """by, n_positive, n_negative, auc with ties counted half.

    Rows collapse to (score, positives, negatives) first; negatives below each score are summed by slices of the scores.
    """
    by = list(by)
    sums = df.where(positive.isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(
        F.sum(positive.cast("long")).alias("_p"), F.sum((~positive).cast("long")).alias("_n")
    )
    won = longform.running_sum(sums, by, "_s", "_n", "_below").withColumn("_won", F.col("_p") * (F.col("_below") + F.col("_n") / 2.0))
    n = won.groupBy(*by).agg(F.sum("_p").alias("n_positive"), F.sum("_n").alias("n_negative"), F.sum("_won").alias("_won"))
    return n.select(*by, "n_positive", "n_negative", scalars.ratio(F.col("_won"), F.col("n_positive").cast("double") * F.col("n_negative")).alias("auc"))


def wilcoxon(df: DataFrame, a: str, b: str, key: str = "", by: Sequence[str] = (), least: int = 5, ties: str = "average") -> DataFrame:
    """by, n, w_plus, w_minus, z, p: signed ranks of a - b; zeros, nulls and NaN take no part; p 1 below ``least`` pairs.

    ties "average": equal magnitudes share the average of their ranks and the variance is corrected for them. Rows collapse to
    (magnitude, counts by sign) first, so a tie is one row however many pairs it has. "key": equal magnitudes are ranked by
    ``key`` and the variance isn't corrected, as the common short form has it; a tie then meets in one task.
    """
    if ties not in ("average", "key"):
        raise ValueError(f"ties: {ties}")
    d = df.withColumn("_d", F.col(a) - F.col(b)).where((F.col("_d") != 0) & ~F.isnan("_d"))
    up, down = ((F.col("_d") > 0).cast("long"), (F.col("_d") < 0).cast("long"))
    if ties == "average":
        sized = d.groupBy(*by, F.abs("_d").alias("_a")).agg(F.sum(up).alias("_p"), F.sum(down).alias("_m")).withColumn("_t", F.col("_p") + F.col("_m"))
        ranked = longform.running_sum(sized, by, "_a", "_t", "_before")
    else:
        sized = d.select(*by, F.abs("_d").alias("_a"), up.alias("_p"), down.alias("_m"), F.lit(1).cast("long").alias("_t"), F.col(key).alias("_key"))
        ranked = longform.running_sum(sized, by, "_a", "_t", "_before", ["_key"])
    rank, t = F.col("_before") + (F.col("_t") + 1) / 2.0, F.col("_t").cast("double")
    sums = ranked.groupBy(*by).agg(F.sum("_t").alias("n"), F.sum(F.col("_p") * rank).alias("w_plus"), F.sum(F.col("_m") * rank).alias("w_minus"), F.sum(t * t * t - t).alias("_ties"))
    n = F.col("n").cast("double")
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_ties") / 2) / 24)
    p = F.when(n < least, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * scalars.norm_cdf(-F.abs(F.col("z")))))
    return sums.withColumn("z", z).withColumn("p", p).drop("_ties")


def decibels(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), 10 * F.log10(a / b))
