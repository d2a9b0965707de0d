"""Privacy-loss distributions of logs of releases, mixed and sampled, and their composition by FFT.

A release is a Laplace or Gaussian one, of all rows or of a Poisson sample of them. Its loss has two distributions, for a row that is
removed and for one that is added, which differ where rows are sampled; the worse result counts.

1. The distinct releases of a group's log are counted behind partial aggregation.
2. Each one's loss is cut into ``FINE`` cells, even in what the release adds its noise to. Its log moments at a fixed list of orders are summed by
   group; by Chernoff's bound they tell the window in which the group's total loss lies but for a tail, and its width the step of the group's grid.
3. Each cell's mass goes to the two points of that grid around the cell, such that its mean of exp(-loss) stays; the release's spectrum is raised
   to its count and multiplied into the group's: within tasks first, at most ``PART`` releases in a part, then part by part. One inverse transform
   a group gives the total.

The grid has ``CELLS`` cells around the sum whatever the number of releases, so memory doesn't grow with it. Bounds stay upper bounds: delta is the
mean of a convex function of exp(-total loss), a product of independent factors, so spreading a factor's mass around its mean never makes it
less ("connecting the dots", Doroshenko and others 2022). What it makes more is of second order in the step, so nothing adds up with the number
of releases, as rounding up would. What the transform wraps around (by Chernoff's bound on the spread losses) and its rounding go into delta, of which ``MARGIN`` is kept back.

Defined results: an unknown mechanism raises; a sampling rate that is null counts as 1, and of 0 or less as no release; a
budget, sensitivity or deviation that is null, NaN or not above 0 raises, but a sensitivity of 0 is no release; an empty log gives no
rows. ``delta`` that can't be kept gives an infinite budget.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe import runtime
from veilframe.functions import noise
from veilframe.operators import accounting

FINE = 1 << 16
CELLS = 1 << 18
#: Distinct releases of a group that one task multiplies into one spectrum.
PART = 4096
#: Deviations of a Gaussian release that its cells cover; what lies above counts as an infinite loss.
REACH = 12.0
#: The share of delta that the window's tails may take, and what is kept back of it for the arithmetic.
TAIL_SHARE, MARGIN = 1e-5, 5e-3
ORDERS = np.array([s * 2 ** (j / 2) for s in (-1, 1) for j in range(-28, 29)])
_BISECTIONS = 60
_erfc = np.vectorize(math.erfc, otypes=[float])


class Release(NamedTuple):
    """level: the budget of a Laplace release; the deviation of a Gaussian one in units of its sensitivity."""

    mechanism: str
    level: float
    rate: float = 1.0


def _laplace_upto(x: np.ndarray) -> np.ndarray:
    """P(X <= x) of the unit Laplace distribution."""
    return np.where(x < 0, 0.5 * np.exp(np.minimum(x, 0)), 1 - 0.5 * np.exp(-np.maximum(x, 0)))


def _normal_upto(x: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-x / math.sqrt(2))


class Loss:
    """A release's loss where a row is removed (``added`` false: x from the data with the row) or added (x from those without it).

    With the row at 1 and the others' sum at 0, x has density (1 - q) f(x) + q f(x - 1) with the row, and f(x) without; the loss is the
    logarithm of their ratio, which rises with x, or the negative of it.
    """

    def __init__(self, release: Release, added: bool):
        self.release, self.added = release, added
        laplace, level = release.mechanism == "laplace", release.level
        self.ends = (0.0, 1.0) if laplace else (-REACH * level, 1 + REACH * level)
        ends = [float(v) for v in self._at(np.array(self.ends))]
        self.low, self.high = (-ends[1], -ends[0]) if added else ends

    def _at(self, x: np.ndarray) -> np.ndarray:
        """The logarithm of the ratio at x."""
        mechanism, level, q = self.release
        y = level * (2 * x - 1) if mechanism == "laplace" else (2 * x - 1) / (2 * level * level)
        # near 1 the ratio's logarithm is that of a small excess
        return y if q >= 1 else np.where(y < 30, np.log1p(q * np.expm1(np.minimum(y, 30))), np.logaddexp(math.log1p(-q), math.log(q) + y))

    def _share(self, x: np.ndarray, at: float) -> np.ndarray:
        """P(a < X <= b) for neighbours a, b of x, noise around ``at``, from the nearer tail."""
        mechanism, level, _ = self.release
        of, u = (_laplace_upto, (x - at) * level) if mechanism == "laplace" else (_normal_upto, (x - at) / level)
        upto, beyond = of(u), of(-u)
        return np.where(upto[1:] < 0.5, np.diff(upto), -np.diff(beyond))

    def cells(self, n: int = FINE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """Each cell's least and greatest loss, its mass p, its mass under the other distribution, p less that, and the mass of infinite losses.

        The first cell is what lies below all others, moved up to the least loss; of a Laplace release the last is the greatest loss, an atom.
        """
        mechanism, level, q = self.release
        x = np.linspace(*self.ends, n + 1)
        z = self._at(x)
        upto, scale = (_laplace_upto, level) if mechanism == "laplace" else (_normal_upto, 1 / level)
        tail = lambda d: upto(np.array([d * scale]))
        full = [np.concatenate([tail(x[0] - at), self._share(x, at), tail(at - x[-1])]) for at in (0.0, 1.0)]
        without, more = full[0], q * (full[1] - full[0])  # the other mixture is without + more
        low, high = np.append(z[0], z), np.append(z, z[-1])
        if self.added:
            low, high, without, more = -high[::-1], -low[::-1], without[::-1], more[::-1]
        p, other, gain = (without, without + more, -more) if self.added else (without + more, without, more)
        if mechanism == "laplace":
            return low, high, p, other, gain, 0.0
        return low[:-1], high[:-1], p[:-1], other[:-1], gain[:-1], float(p[-1])


@lru_cache(maxsize=32)
def _cells(release: Release, added: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float, float]:
    loss = Loss(release, added)
    *cells, above = loss.cells()
    return *cells, above, math.inf if above > 0 else loss.high


def _log_moments(z: np.ndarray, p: np.ndarray, width: int = 1024) -> np.ndarray:
    """ln E exp(order * loss) at ``ORDERS``, from above: groups of cells count at their end that weighs more."""
    groups = np.minimum(np.arange(len(z)) * width // len(z), width - 1)
    first = np.searchsorted(groups, np.arange(width))
    mass = np.add.reduceat(p, first)
    low, high = z[first], z[np.append(first[1:], len(z)) - 1]
    with np.errstate(divide="ignore"):
        e = np.where(ORDERS[:, None] > 0, ORDERS[:, None] * high, ORDERS[:, None] * low) + np.log(mass)
    top = e.max(axis=1)
    return top + np.log(np.exp(e - top[:, None]).sum(axis=1))


class Total:
    """The spectrum of a sum of losses on a grid, and what bounds the grid's errors."""

    def __init__(self, step: float, cells: int = CELLS):
        self.step, self.cells = step, cells
        self.spectrum = np.ones(cells // 2 + 1, complex)
        self.moments = np.zeros(len(ORDERS))
        #: releases; ln of the chance that no loss is infinite; least and greatest sums of spread losses; the greatest sum of losses
        self.k, self.finite, self.low, self.high, self.most = 0, 0.0, 0, 0, 0.0

    def add(self, release: Release, added: bool, k: int) -> None:
        low, high, p, other, gain, above, most = _cells(release, added)
        lo = np.floor(low / self.step).astype(np.int64)
        hi = np.maximum(np.ceil(high / self.step).astype(np.int64), lo + 1)
        with np.errstate(over="ignore", invalid="ignore"):
            # p - other exp(lower point), with p's small difference to the other mass kept apart
            up = (gain - other * np.expm1(lo * self.step)) / -np.expm1((lo - hi) * self.step)
        up = np.where((other > 1e-290) & np.isfinite(up), np.clip(up, 0.0, p), p)
        at, mass = np.concatenate([lo, hi]), np.concatenate([p - up, up])
        self.spectrum *= np.fft.rfft(np.bincount(at % self.cells, weights=mass, minlength=self.cells)) ** k
        self.finite += k * math.log1p(-above)
        self.moments += k * np.logaddexp(_log_moments(lo * self.step, p - up), _log_moments(hi * self.step, up))
        used = at[mass > 0]
        self.low, self.high = self.low + k * int(used.min()), self.high + k * int(used.max())
        self.k, self.most = self.k + k, self.most + k * most

    def parts(self) -> tuple:
        return self.k, self.finite, self.low, self.high, self.most

    def merge(self, spectrum: np.ndarray, moments: np.ndarray, parts: Sequence) -> None:
        self.spectrum *= spectrum
        self.moments += moments
        self.k, self.finite, self.low, self.high, self.most = (a + b for a, b in zip(self.parts(), parts, strict=True))

    def curve(self, low: float, high: float, delta: float) -> Curve:
        """``low`` .. ``high``: where the sum of losses lies but for a tail."""
        first = math.floor((low + high) / 2 / self.step) - self.cells // 2
        p = np.roll(np.clip(np.fft.irfft(self.spectrum, self.cells), 0.0, None), -(first % self.cells))
        z = (first + np.arange(self.cells)) * self.step
        outside = 0.0
        for side, end, covered in ((1, first + self.cells, self.high < first + self.cells), (-1, first - 1, self.low >= first)):
            if not covered:
                orders = ORDERS * side > 0
                outside += math.exp(min(0.0, float((self.moments[orders] - ORDERS[orders] * end * self.step).min())))
        return Curve(z, p, -math.expm1(self.finite) + outside + MARGIN * delta + 1e-15 * (self.k + 64), self.most)


class Curve(NamedTuple):
    """Cells and probabilities of the total loss; what delta has besides; and the greatest total loss."""

    z: np.ndarray
    p: np.ndarray
    besides: float
    most: float

    def delta(self, epsilon: float) -> float:
        if epsilon >= self.most:
            return 0.0
        gain = -np.expm1(np.minimum(epsilon - self.z, 0.0))
        return min(1.0, float((self.p * gain).sum()) + self.besides)

    def epsilon(self, delta: float) -> float:
        if self.delta(0.0) <= delta:
            return 0.0
        low, high = 0.0, float(self.z[-1])
        if self.delta(high) > delta:
            return self.most
        for _ in range(_BISECTIONS):
            mid = (low + high) / 2
            low, high = (low, mid) if self.delta(mid) <= delta else (mid, high)
        return min(high, self.most)


def _window(moments: np.ndarray, low: float, high: float, delta: float) -> tuple[float, float]:
    """Where a sum lies but for a tail, from its log moments and its least and greatest value."""
    ends = (moments - math.log(TAIL_SHARE * delta)) / ORDERS
    return max(low, float(ends[ORDERS < 0].max())), min(high, float(ends[ORDERS > 0].min()))


def _step(low: float, high: float, cells: int) -> float:
    return max((high - low) * 1.05 / (cells - 64), 1e-12)


def _facts(release: Release, added: bool, k: int) -> tuple[np.ndarray, float, float]:
    """k times the log moments, and the least and greatest sum."""
    low, high, p, *_ = _cells(release, added)
    return k * _log_moments((low + high) / 2, p), k * float(low[0]), k * float(high[-1])


def curve(releases: dict[Release, int], added: bool, delta: float = noise.DELTA, cells: int = CELLS) -> Curve:
    """Of one short list of releases with their counts, where no Spark is needed."""
    facts = [_facts(r, added, k) for r, k in releases.items()]
    low, high = _window(sum(f[0] for f in facts), sum(f[1] for f in facts), sum(f[2] for f in facts), delta)
    total = Total(_step(low, high, cells), cells)
    for r, k in releases.items():
        total.add(r, added, k)
    return total.curve(low, high, delta)


def bound(mechanism: str, epsilon: float, k: int, delta: float = noise.DELTA, cells: int = CELLS) -> float:
    """Budget of k releases of (pure or calibrated) budget epsilon each."""
    level = epsilon if mechanism == "laplace" else math.sqrt(2 * math.log(1.25 / delta)) / epsilon
    return curve({Release(mechanism, level): k}, False, delta, cells).epsilon(delta)


def sampled_gaussian(rate: float, sigma: float, steps: int, delta: float = noise.DELTA) -> float:
    """Budget of so many steps of noisy descent, each over a Poisson sample: the worse of a removed and an added row."""
    return max(curve({Release("gaussian", sigma, rate): steps}, added, delta).epsilon(delta) for added in (False, True))


# Logs

Fold = Callable[[Iterator[dict]], dict]


def _folded(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, made: T.StructType) -> DataFrame:
    """``keys`` and what ``fold`` makes of the rows of each of their values, read as a stream in ``order``."""
    schema = T.StructType([*[rows.schema[k] for k in keys], *made.fields])
    arrow = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, pa.DataType] = {}

        def stream() -> Iterator[dict]:
            for b in batches:
                kinds.update({k: b.schema.field(k).type for k in keys})
                for i in range(b.num_rows):
                    yield b.slice(i, 1).to_pylist()[0]

        for key, group in itertools.groupby(stream(), key=lambda r: tuple(r[k] for k in keys)):
            found = fold(group)
            columns = [pa.array([v], kinds[k]) for k, v in zip(keys, key, strict=True)] + [pa.array([found[f.name]], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return _spread(rows, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Dealt by ``keys`` into as many tasks as the session has for shuffles: the rows are few, but each takes a transform."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
_PARTS = ("k", "finite", "low", "high", "most")


def releases(log: DataFrame, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """by, mechanism, level, rate, k: the distinct releases of a log (mechanism, epsilon, sensitivity, sigma, sampling_rate), or of
    one that already has the number of each in ``count``."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0)
    laplace, gaussian = F.col("mechanism") == "laplace", F.col("mechanism") == "gaussian"
    level = (
        F.when(laplace & good("epsilon"), F.col("epsilon")).when(gaussian & (F.col("sensitivity") == 0), F.lit(math.inf)).when(gaussian & good("sigma") & good("sensitivity"), F.col("sigma") / F.col("sensitivity"))
    ).otherwise(F.raise_error(F.concat(F.lit("no release to account for: "), F.to_json(F.struct("mechanism", "epsilon", "sensitivity", "sigma")))))
    rate = F.least(F.coalesce("sampling_rate", F.lit(1.0)), F.lit(1.0))
    rows = log.select(*by, "mechanism", level.cast("double").alias("level"), rate.cast("double").alias("rate"), (F.col(count) if count else F.lit(1)).cast("long").alias("k"))
    rows = rows.where((F.col("rate") > 0) & (F.col("level") < math.inf) & (F.col("k") > 0))
    return rows.groupBy(*by, "mechanism", "level", "rate").agg(F.sum("k").alias("k"))


def _facts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [_facts(Release(m, level, q), a, k) for m, level, q, k, a in zip(*[b[c].to_pylist() for c in ("mechanism", "level", "rate", "k", "added")], strict=True)]
        new = [pa.array([f[0].tolist() for f in found], pa.list_(pa.float64())), *[pa.array([f[i] for f in found], pa.float64()) for i in (1, 2)]]
        yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "moments", "least", "greatest"])


def _totals(log: DataFrame, by: Sequence[str], delta: float, read: Callable[[Curve], dict], made: T.StructType, count: str | None, cells: int) -> DataFrame:
    """by, added, k and what ``read`` takes from the curve of each group's log."""
    runtime.ship(log.sparkSession)
    by = list(by)
    each = releases(log, by, count).withColumn("added", F.explode(F.array(F.lit(False), F.lit(True))))
    schema = T.StructType([*each.schema.fields, T.StructField("moments", T.ArrayType(T.DoubleType())), T.StructField("least", T.DoubleType()), T.StructField("greatest", T.DoubleType())])
    each = runtime.materialize(_spread(each, *by, "mechanism", "level", "rate", "added").mapInArrow(_facts_of, schema), "releases")
    keys = [*by, "added"]
    ends = each.groupBy(*keys).agg(F.sum("least").alias("least"), F.sum("greatest").alias("greatest"), F.count("*").alias("n_distinct"), F.min("rate").alias("least_rate"))
    sums = each.select(*keys, F.posexplode("moments").alias("i", "m")).groupBy(*keys, "i").agg(F.sum("m").alias("m"))
    sums = sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("sums"))  # as many as ORDERS
    # without samples both losses have one distribution
    ends = ends.where(~F.col("added") | (F.col("least_rate") < 1)).drop("least_rate")
    windows = runtime.materialize(joined(ends, sums, keys), "windows")
    rows = joined(each.drop("moments", "least", "greatest"), windows, keys)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("mechanism", "level", "rate"), F.ceil(F.col("n_distinct") / PART)))

    def multiplied(group: Iterator[dict]) -> dict:
        total = None
        for r in group:
            if total is None:
                low, high = _window(np.array(r["sums"]), r["least"], r["greatest"], delta)
                total = Total(_step(low, high, cells), cells)
            total.add(Release(r["mechanism"], r["level"], r["rate"]), r["added"], r["k"])
        return {"spectrum": total.spectrum.tobytes(), "moments": total.moments.tolist(), "step": total.step, "lo": low, "hi": high} | {n: float(v) for n, v in zip(_PARTS, total.parts(), strict=True)}

    double = lambda *names: [T.StructField(n, T.DoubleType()) for n in names]
    partial = T.StructType([T.StructField("spectrum", T.BinaryType()), T.StructField("moments", T.ArrayType(T.DoubleType())), *double("step", "lo", "hi", *_PARTS)])
    parts = _folded(rows, [*keys, "part"], ["mechanism", "level", "rate"], multiplied, partial)

    def summed(group: Iterator[dict]) -> dict:
        total = None
        for r in group:
            total = total or Total(r["step"], cells)
            total.merge(np.frombuffer(r["spectrum"], complex), np.array(r["moments"]), [r[n] for n in _PARTS])
            low, high = r["lo"], r["hi"]
        total.low, total.high = int(total.low), int(total.high)
        return read(total.curve(low, high, delta)) | {"n_queries": int(total.k)}

    return _folded(parts, keys, ["part"], summed, T.StructType([T.StructField("n_queries", T.LongType()), *made.fields]))


def joined(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``a`` with the columns of ``b``, nulls in the keys equal."""
    other = b.select(*[F.col(k).alias(f"{k}__") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__"))
    return a.join(other, on).drop(*[f"{k}__" for k in keys])


def spent(log: DataFrame, delta: float = noise.DELTA, by: Sequence[str] = (), count: str | None = None, cells: int = CELLS) -> DataFrame:
    """by, n_queries, prv: the budget that a log of mixed and sampled releases keeps at ``delta``."""
    rows = _totals(log, by, delta, lambda c: {"prv": c.epsilon(delta)}, T.StructType([T.StructField("prv", T.DoubleType())]), count, cells)
    return rows.groupBy(*by).agg(F.max("n_queries").alias("n_queries"), F.max("prv").alias("prv"))


def curves(log: DataFrame, at: Sequence[float], by: Sequence[str] = (), count: str | None = None, delta: float = noise.DELTA, cells: int = CELLS) -> DataFrame:
    """by, epsilon, delta: the privacy curve of a log at the budgets ``at``; ``delta``: about the least that is wanted precisely."""
    at = [float(e) for e in at]
    rows = _totals(log, by, delta, lambda c: {"deltas": [c.delta(e) for e in at]}, T.StructType([T.StructField("deltas", T.ArrayType(T.DoubleType()))]), count, cells)
    rows = rows.select(*by, F.posexplode("deltas").alias("i", "delta")).groupBy(*by, "i").agg(F.max("delta").alias("delta"))
    return rows.select(*by, F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1).alias("epsilon"), "delta")


def _nominal(rows: DataFrame, delta: float) -> DataFrame:
    """rows (with mechanism, nominal_epsilon) and the columns of a log: releases calibrated to that budget."""
    e = F.col("nominal_epsilon")
    return rows.withColumns({"epsilon": e, "sensitivity": F.lit(1.0), "sigma": noise.gaussian_sigma(F.lit(1.0), e, delta), "sampling_rate": F.lit(1.0)})


def composition(spark: SparkSession, epsilons: Sequence[float], ks: Sequence[int], mechanisms: Sequence[str] = noise.MECHANISMS, delta: float = noise.DELTA) -> DataFrame:
    """mechanism, nominal_epsilon, n_queries, prv, and rdp, advanced and basic beside it, with prv's gain over rdp in percent."""
    grid = accounting.grid(spark, mechanism=list(mechanisms), nominal_epsilon=[float(e) for e in epsilons], setting=list(ks))
    log = _nominal(grid, delta).withColumns({"kind": F.col("mechanism"), "n": F.col("setting")})
    made = spent(log, delta, ["kind", "nominal_epsilon", "setting"], "n").select(F.col("kind").alias("mechanism"), "nominal_epsilon", F.col("setting").alias("n_queries"), "prv")
    others = accounting.composition(spark, epsilons, ks, delta).select("mechanism", "nominal_epsilon", "n_queries", "rdp", "advanced", "basic")
    rows = made.join(others, ["mechanism", "nominal_epsilon", "n_queries"])
    return rows.selectExpr("*", "prv / rdp as prv_vs_rdp", "100 * (1 - prv / rdp) as tightening_pct")


def profile(spark: SparkSession, mechanism: str, epsilon: float, k: int, at: Sequence[float], cells: int = CELLS) -> DataFrame:
    """epsilon, delta: the privacy curve of k releases."""
    log = _nominal(accounting.grid(spark, mechanism=[mechanism], nominal_epsilon=[float(epsilon)], n=[k]), noise.DELTA)
    return curves(log, at, count="n", cells=cells)
