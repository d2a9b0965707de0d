"""The long layout (key, label, feature, x) and its column statistics, all features in one pass.

Statistics skip null and NaN. ``unpivot`` and ``from_array`` read what is no number, NaN and both infinities as null; a long table made
otherwise may hold infinities, which order as they should. Features form a handful of groups that each hold all rows, so every shuffle
sits behind partial aggregation. Exact percentiles and running sums go by slices of the values, so that no task holds a whole feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe import runtime
from veilframe.functions import scalars

BINS = 20


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def unpivot(df: DataFrame, features: Sequence[str], label: str | None = None, key: Column | None = None) -> DataFrame:
    """[key,] [label,] feature, x double. One scan, one row a value."""
    ids = ([key.alias("key")] if key is not None else []) + ([F.col(label).cast("string").alias("label")] if label else [])
    names = (["key"] if key is not None else []) + (["label"] if label else [])
    wide = df.select(*ids, *[scalars.number(F.col(f"`{f}`")).alias(f) for f in features])
    return wide.unpivot(names, list(features), "feature", "x")


def from_array(df: DataFrame, array: str, label: str | None = None, key: Column | None = None, prefix: str = "f") -> DataFrame:
    """The same layout from an array column: feature names are prefix and place."""
    ids = ([key.alias("key")] if key is not None else []) + ([F.col(label).cast("string").alias("label")] if label else [])
    names = (["key"] if key is not None else []) + (["label"] if label else [])
    rows = df.select(*ids, F.posexplode(array).alias("_place", "_x"))
    return rows.select(*names, F.concat(F.lit(prefix), F.col("_place")).alias("feature"), scalars.number(F.col("_x")).alias("x"))


def present(long: DataFrame) -> DataFrame:
    return long.where(F.col("x").isNotNull() & ~F.isnan("x"))


def stats(long: DataFrame) -> DataFrame:
    """feature, n, n_rows, total, mean, lo, hi, var_pop, var_samp. Features without values keep a row (n = 0)."""
    x = F.when(~F.isnan("x"), F.col("x"))
    return long.groupBy("feature").agg(
        F.count(x).alias("n"), F.count("*").alias("n_rows"), F.sum(x).alias("total"), F.avg(x).alias("mean"),
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.var_pop(x).alias("var_pop"), F.var_samp(x).alias("var_samp"),
    )


#: Slices of each range between two powers of two.
SLICES = 4096


#: Rows of different values beyond which a slice is cut again.
SLICE_ROWS = 1 << 18
_LARGEST = 1.7976931348623157e308


def slice_of(x: Column) -> Column:
    """A long that never falls as ``x`` rises: sign, power of two and ``SLICES`` equal parts up to the next power; each infinity and NaN has its own."""
    x = x.cast("double")
    size = F.least(F.abs(x), F.lit(_LARGEST))
    power = F.least(F.floor(F.log2(size)), F.lit(1023))
    part = (power + 1100) * SLICES + F.floor((size / F.pow(F.lit(2.0), power) - 1) * SLICES)
    far = F.when(F.isnan(x), F.lit(1 << 61)).when(x > _LARGEST, F.lit(1 << 60)).when(x < -_LARGEST, F.lit(-(1 << 60)))
    return F.when(x.isNull(), F.lit(None)).otherwise(F.coalesce(far, F.when(size == 0, F.lit(0)).otherwise((F.signum(x) * part).cast("long"))))


def same(names: Sequence[str], a: DataFrame, b: DataFrame) -> Column:
    """Equality of columns of two DataFrames, nulls equal."""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def _sliced(df: DataFrame, by: Sequence[str], order: str, value: str | Sequence[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """``df`` with slice_ (longs, ordered as ``order`` is), and the sum of ``value`` of every slice: sum_, or sum_0, sum_1, ... of several.

    Slices with more than ``rows`` rows are cut again into ``SLICES`` parts between their own least and greatest value, level by
    level, until none has more or only rows with one value. A double has no more than five levels.
    """
    cut = df.withColumn("slice_", F.array(slice_of(F.col(order))))
    totals = [F.sum(value).alias("sum_")] if isinstance(value, str) else [F.sum(v).alias(f"sum_{i}") for i, v in enumerate(value)]
    while True:
        sums = cut.groupBy(*by, "slice_").agg(*totals, F.count("*").alias("k_"), F.min(order).alias("lo_"), F.max(order).alias("hi_"))
        sums = runtime.materialize(sums, "slices")
        heavy = sums.where((F.col("k_") > rows) & (F.col("lo_") < F.col("hi_"))).select(*by, "slice_", "lo_", "hi_")
        if not heavy.take(1):
            return cut, sums
        part = F.floor((F.col(order) - F.col("lo_")) / (F.col("hi_") - F.col("lo_")) * SLICES)
        finer = F.when(F.col("lo_").isNull(), F.col("slice_")).otherwise(F.concat("slice_", F.array(part)))
        cut = cut.alias("r").join(heavy.alias("s"), same([*by, "slice_"], cut, heavy), "left").select("r.*", "s.lo_", "s.hi_").withColumn("slice_", finer).drop("lo_", "hi_")


def running_sum(df: DataFrame, by: Sequence[str], order: str, value: str | Sequence[str], into: str | Sequence[str], ties: Sequence[str] = (), rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` and ``into``: the sum of ``value`` over the rows before (a number in ``order``, then ``ties``) with equal ``by``; several at once, if lists.

    Slices of ``order`` are summed first and placed one after the other, so only rows of one slice meet in a task: no more than
    ``rows``, or those with one value. Where many rows can have one value, collapse them first, as the callers do. Sparse values have
    nearly as many slices as rows, so their sums are merged with the rows and never broadcast, however small their file is.
    """
    cut, sums = _sliced(df, by, order, value, rows)
    names = {"sum_": (value, into)} if isinstance(value, str) else {f"sum_{i}": pair for i, pair in enumerate(zip(value, into, strict=True))}
    ahead = Window.partitionBy(*by).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "slice_", *[F.coalesce(F.sum(s).over(ahead), F.lit(0)).alias(f"ahead_{s}") for s in names])
    placed = cut.alias("r").join(sums.alias("s").hint("merge"), same([*by, "slice_"], cut, sums)).select("r.*", *[f"s.ahead_{s}" for s in names])
    within = Window.partitionBy(*by, "slice_").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    made = {i: F.col(f"ahead_{s}") + F.coalesce(F.sum(v).over(within), F.lit(0)) for s, (v, i) in names.items()}
    return placed.withColumns(made).drop("slice_", *[f"ahead_{s}" for s in names])


def _at_rank(counts: DataFrame, by: Sequence[str], order: str, targets: DataFrame) -> DataFrame:
    """``targets`` (by, feature, share, side, rank) with the row of ``counts`` (k rows each) that holds their rank, and the rank within it."""
    before = F.coalesce(F.sum("k").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("before", before)
    rows = placed.join(F.broadcast(targets), list(by))  # one row a feature and share
    rows = rows.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("k")))
    return rows.withColumn("rank", F.col("rank") - F.col("before")).drop("before", "k")


def percentiles(long: DataFrame, shares: Sequence[float]) -> DataFrame:
    """feature, share, value: exact, by linear interpolation between order statistics (shares in 0 .. 1).

    Three scans, each behind partial aggregation: values are counted by slice; those in the slices that hold a wanted rank by
    ``SLICES`` equal parts; and those in the parts that hold one, by value. The counts are written, as what follows reads them several times.
    """
    x = present(long).select("feature", "x")
    # what lies between the ends of a slice, or of a part, is all of it
    between = lambda ends: x.join(F.broadcast(ends), "feature").where(F.col("x").between(F.col("lo"), F.col("hi")))
    first = runtime.materialize(x.withColumn("slice", slice_of(F.col("x"))).groupBy("feature", "slice").agg(F.count("*").alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi")), "ranks")
    n = first.groupBy("feature").agg(F.sum("k").alias("n"))
    place = F.col("share") * (F.col("n") - 1)
    targets = n.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("part", place - F.floor(place))
    targets = targets.select("feature", "share", "part", F.posexplode(F.array(F.floor(place), F.ceil(place))).alias("side", "rank"))
    wanted = _at_rank(first, ["feature"], "slice", targets)
    inside = between(wanted.select("feature", "slice", "lo", "hi").distinct())
    part = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * SLICES)).otherwise(F.lit(0))
    second = inside.withColumn("piece", part).groupBy("feature", "slice", "piece").agg(F.count("*").alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    second = runtime.materialize(second, "ranks")
    wanted = _at_rank(second, ["feature", "slice"], "piece", wanted.drop("lo", "hi"))
    edges = wanted.select("feature", "slice", "lo", "hi").distinct()
    third = between(edges).groupBy("feature", "slice", "lo", "x").agg(F.count("*").alias("k"))
    found = _at_rank(third, ["feature", "slice", "lo"], "x", wanted.drop("piece", "hi"))
    low, high = (F.max(F.when(F.col("side") == i, F.col("x"))) for i in (0, 1))
    found = found.groupBy("feature", "share").agg(low.alias("low"), high.alias("high"), F.max("part").alias("part"))
    middle = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    return found.select("feature", "share", F.when((F.col("part") == 0) | (F.col("low") == F.col("high")), F.col("low")).otherwise(middle).alias("value"))


def approx_percentiles(long: DataFrame, shares: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """feature, share, value: within 1 / accuracy of the rank; bounded memory whatever the number of values."""
    got = present(long).groupBy("feature").agg(F.percentile_approx("x", list(shares), accuracy).alias("values"))
    named = F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), F.col("values").alias("value"))
    return got.select("feature", F.inline(named).alias("share", "value"))


def binned(long: DataFrame, bins: int = BINS) -> DataFrame:
    """feature, [label,] x, bin in equal widths between each feature's least and greatest value."""
    return _binned(long, stats(long), bins)


def _binned(long: DataFrame, made: DataFrame, bins: int) -> DataFrame:
    bounds = made.select("feature", "lo", "hi")
    rows = present(long).join(F.broadcast(bounds), "feature")  # one row a feature
    return rows.withColumn("bin", scalars.bin_of(F.col("x"), F.col("lo"), F.col("hi"), bins)).drop("lo", "hi")


def joint_counts(long: DataFrame, bins: int = BINS) -> DataFrame:
    """feature, bin, label, k. At most bins * labels rows a feature."""
    return _joint_counts(binned(long.where(F.col("label").isNotNull()), bins))


def _joint_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feature", "bin", "label").agg(F.count("*").alias("k"))


def mutual_information(long: DataFrame, bins: int = BINS) -> DataFrame:
    """feature, mi in nats between binned value and label, at least 0; features without values have 0."""
    # one scan for the bounds of the labelled values and for the features: one row a feature, which is written
    ofs = F.when(~F.isnan("x") & F.col("label").isNotNull(), F.col("x"))
    bounds = runtime.materialize(long.groupBy("feature").agg(F.min(ofs).alias("lo"), F.max(ofs).alias("hi")), "bounds")
    counts = _joint_counts(_binned(long.where(F.col("label").isNotNull()), bounds, bins))
    by = lambda *c: F.sum("k").over(Window.partitionBy("feature", *c))
    k, n, nb, nl = (c.cast("double") for c in (F.col("k"), by(), by("bin"), by("label")))
    terms = counts.select("feature", (k / n * F.ln(k * n / (nb * nl))).alias("t"))
    mi = terms.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum("t")).alias("mi"))
    return bounds.select("feature").join(mi, "feature", "left").select("feature", F.coalesce("mi", F.lit(0.0)).alias("mi"))


def numeric_profile(df: DataFrame, exclude: Sequence[str] = (), least: float = 0.95) -> DataFrame:
    """column, share of the rows that read as a number, numeric (share above ``least``). One pass over all columns."""
    columns = [c for c in df.columns if c.lower() not in {x.lower() for x in exclude}]
    shares = [F.avg(F.col(f"`{c}`").cast("string").try_cast("double").isNotNull().cast("double")).alias(c) for c in columns]
    return df.agg(*shares).unpivot([], columns, "column", "share").withColumn("numeric", F.coalesce(F.col("share") > least, F.lit(False)))
