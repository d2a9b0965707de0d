"""Bounds and importance at a budget: percentiles by the exponential mechanism, scores from noisy joint counts.

Both start from what is public: for each feature a domain (least and greatest value that a record can have, not that the data has) and the
list of labels. A record's values are clipped into the domain. Neighbouring tables differ in one record, which is added or removed.

* A percentile is one of the edges of ``CELLS`` equal cells of the domain, chosen with a utility of minus the distance between the number of
  values below it and the wanted rank. One record moves both by no more than 1, and together by no more than 1.
* Scores come from a histogram over cells and labels. Every cell gets Laplace noise of scale 1 / eps, empty ones too; counts below 0 become 0,
  and mutual information, variance and the ratio of deviation to range are computed from what is left.

Features are columns of the same records, so their budgets add up; ``spends`` lists each one for the accountant.

Scale: one scan and one grouped count a release, behind partial aggregation; what comes after has cells x labels x features rows.

Defined results: null, NaN and infinities don't count; values beyond the domain count at its end; a label that isn't in the list
doesn't count; a feature without a domain isn't released; an empty table gives percentiles and scores of noise alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import noise, scalars
from veilframe.operators import budget, longform, release

CELLS = 1024


def clipped(long: DataFrame, domain: DataFrame) -> DataFrame:
    """long with low and high, its values within them. domain: feature, low, high; public, one row a feature."""
    rows = longform.present(long).join(F.broadcast(domain.select("feature", "low", "high")), "feature")
    finite = rows.where(F.abs("x") < F.lit(float("inf")))
    return finite.withColumn("x", F.least(F.greatest("x", "low"), "high"))


def _cell(cells: int) -> Column:
    """0 .. cells - 1, by equal widths."""
    return scalars.bin_of(F.col("x"), F.col("low"), F.col("high"), cells)


def percentiles(long: DataFrame, domain: DataFrame, shares: Sequence[float], epsilon: float, cells: int = CELLS, seed: int | None = None) -> DataFrame:
    """feature, share, value, eps: each share of each feature at epsilon / (features x shares)."""
    n_features = domain.select(F.count("*").alias("d"))
    held = clipped(long, domain).withColumn("cell", _cell(cells)).groupBy("feature", "cell").agg(F.count("*").alias("k"))
    # every edge 1 .. cells is a candidate, whether its cell has values or not
    edges = domain.select("feature", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    edges = edges.join(held, ["feature", "cell"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    upto = F.sum("k").over(Window.partitionBy("feature").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    edges = edges.withColumns({"below": upto, "n": F.sum("k").over(Window.partitionBy("feature"))})
    rows = edges.crossJoin(F.broadcast(n_features)).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))  # one row
    rows = rows.withColumn("eps", F.lit(float(epsilon)) / (F.col("d") * len(shares)))
    key = F.concat_ws("|", "feature", F.round(F.col("share") * 1e6).cast("long").cast("string"), F.col("cell").cast("string"))
    rows = release.uniforms(rows, key, ["u"], seed)
    utility = -F.abs(F.col("below") - F.col("share") * F.col("n"))
    score = noise.gumbel_score(utility, 1.0, F.col("eps"), F.col("u"))
    edge = F.col("low") + (F.col("cell") + 1) * (F.col("high") - F.col("low")) / cells
    return rows.groupBy("feature", "share", "eps").agg(F.max_by(edge, score).alias("value")).select("feature", "share", "value", "eps")


def joint_counts(long: DataFrame, domain: DataFrame, labels: Sequence[str], epsilon: float, bins: int = longform.BINS, seed: int | None = None) -> DataFrame:
    """feature, bin, label, k (noisy, at least 0), low, high, eps: all cells, each feature at epsilon / features."""
    n_features = domain.select(F.count("*").alias("d"))
    held = clipped(long, domain).where(F.col("label").isin(list(labels))).withColumn("bin", _cell(bins)).groupBy("feature", "bin", "label").agg(F.count("*").alias("n"))
    cells = domain.select("feature", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    rows = cells.join(held, ["feature", "bin", "label"], "left").crossJoin(F.broadcast(n_features))  # one row
    rows = release.uniforms(rows.withColumn("eps", F.lit(float(epsilon)) / F.col("d")), F.concat_ws("|", "feature", F.col("bin").cast("string"), "label"), ["u"], seed)
    k = F.greatest(F.coalesce("n", F.lit(0)) + noise.laplace(F.col("u"), 1 / F.col("eps")), F.lit(0.0))
    return rows.select("feature", "bin", "label", k.alias("k"), "low", "high", "eps")


def scores(counts: DataFrame, methods: Sequence[str] = budget.METHODS, bins: int = longform.BINS) -> DataFrame:
    """method, feature, score from noisy joint counts."""
    if unknown := set(methods) - set(budget.METHODS):
        raise ValueError(f"unknown methods {sorted(unknown)}; of {budget.METHODS}")
    by = lambda *c: F.sum("k").over(Window.partitionBy("feature", *c))
    rows = counts.withColumns({"n": by(), "nb": by("bin"), "nl": by("label"), "at": F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins})
    k, n, at = F.col("k"), F.col("n"), F.col("at")
    term = F.when(k > 0, k / n * F.ln(k * n / (F.col("nb") * F.col("nl")))).otherwise(F.lit(0.0))
    sums = rows.groupBy("feature").agg(
        F.greatest(F.lit(0.0), F.sum(term)).alias("mi"), F.sum(k).alias("n"), F.sum(k * at).alias("s"), F.sum(k * at * at).alias("q"), F.max(F.col("high") - F.col("low")).alias("range")
    )
    some = F.greatest("n", F.lit(1.0))
    variance = F.greatest(F.col("q") / some - F.pow(F.col("s") / some, F.lit(2.0)), F.lit(0.0))
    made = {"mi": F.col("mi"), "variance": variance, "snr": F.sqrt(variance) / (F.col("range") / some + 1e-10), "uniform": F.lit(1.0)}
    return sums.select("feature", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), made[m].alias("score")) for m in methods]))).select("method", "feature", "score")


def spends(*parts: DataFrame) -> DataFrame:
    """A query log (mechanism, epsilon, sensitivity, sigma, sampling_rate) of pure releases: one row for each row of ``parts`` (eps)."""
    out = None
    for p in parts:
        rows = p.select(F.lit("laplace").alias("mechanism"), F.col("eps").cast("double").alias("epsilon"), F.lit(1.0).alias("sensitivity"), F.lit(None).cast("double").alias("sigma"), F.lit(1.0).alias("sampling_rate"))
        out = rows if out is None else out.unionByName(rows)
    return out
