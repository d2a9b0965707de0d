"""Training of all models of a grid over all rows, in the same scans.

``experiments`` trains each model in one task on a sample of bounded size. Here rows are of any number: they are written once in
packed blocks, and each job is one for the whole grid, in which every task adds up the gradients of all models over its
blocks. A grid of 500 models takes as many jobs as one model, so that what a job costs to start is shared.

Where no model draws (``baseline``, or settings without noise only), rows are packed where they are: none is moved or ordered.

Full descent needs the gradients of all its steps at a few places only (``ml.descended``), so its noise is drawn in five or six passes, not 200.

No perturbed copy of the rows is stored. The noise of a row, model and feature is a hash of the row's own uniform (which comes from
its key) and of the model, made anew in each job: it is the same in every job, whatever the partitioning, and after a lost executor.

What reaches the driver in a job has the size of the sums of all models, for each task or, beyond ``DIRECT_VALUES``, once.

Defined results: rows with a null label or a feature that doesn't read as a number are left out. Rows without a key draw as one row.
Repeated rows with different keys count and draw each. Without training rows all weights are zero; without test rows accuracies are 0 and
recalls null. A setting whose budget no noise keeps is scored at zero weights, with null sigma and spent.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe import runtime
from veilframe.functions import noise
from veilframe.operators import accounting, experiments, ml

#: Doubles that go to the driver in a job directly; beyond, Spark adds them up first.
DIRECT_VALUES = ml.DIRECT_VALUES
#: Steps and sampling rate of noisy descent.
PRIVATE_STEPS, PRIVATE_SAMPLING = 200, 0.05


class Model(NamedTuple):
    """One model: a setting and run, the noise of each feature (empty: none), and a number that sets its draws apart."""

    setting: str
    mechanism: str
    epsilon: float
    run: int
    scales: tuple[float, ...]
    draws: int


class Scaling(NamedTuple):
    """Number of training rows, and each model's means and deviations of its noisy features: (models, features)."""

    n: float
    mean: np.ndarray
    deviation: np.ndarray


def models(settings: DataFrame, runs: int, repeated: bool = False, seed: int = 42) -> list[Model]:
    """A model for each row of settings (setting, mechanism, epsilon, scales; a grid of bounded size) and run; one run where nothing is drawn, unless ``repeated``."""
    made = []
    for r in sorted(settings.collect(), key=lambda r: (r.setting, r.mechanism, r.epsilon)):
        for run in range(runs if len(r.scales) or repeated else 1):
            draws = zlib.crc32(f"{seed}|{r.setting}|{r.mechanism}|{r.epsilon}|{run}".encode())
            made.append(Model(r.setting, r.mechanism, r.epsilon, run, tuple(r.scales), draws))
    return made


def packed(rows: DataFrame, features: Sequence[str]) -> ml.Packed:
    """Blocks of rows (key, features, y), with the rows' own uniforms."""
    made = rows.select(F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("x"), F.col("y").cast("int").alias("y"), own_uniform(F.col("key")).alias("u"))
    return ml.packed(made)


def own_uniform(key: Column) -> Column:
    """A row's own uniform."""
    return noise.keyed_uniform(0, "batch", F.coalesce(key.cast("string"), F.lit("")))


def noisy(x: np.ndarray, u: np.ndarray, model: Model) -> np.ndarray:
    """x (rows, features) with the model's noise, Laplace or Gaussian."""
    if not model.scales:
        return x
    out, base = np.empty(x.shape, order="F"), ml.mixed(ml.row_bits(u, model.draws), model.draws)

    def uniform(k):
        h = ml.mixed(base, k)
        h >>= np.uint64(12)
        v = h.astype(np.float64)
        v += 0.5
        v *= 2.0**-52
        return v

    for j, scale in enumerate(model.scales):
        first = uniform(2 * j + 1)
        if model.mechanism == "laplace":
            # -sign(v) ln(1 - 2 |v|) of v = first - 1/2
            drawn = np.copysign(np.log(2 * np.minimum(first, 1 - first)), first - 0.5)
        else:
            drawn = np.sqrt(-2 * np.log(first)) * np.cos(2 * np.pi * uniform(2 * j + 2))
        drawn *= scale
        np.add(x[:, j], drawn, out=out[:, j])
    return out


def _summed(data: ml.Packed, part: Callable[..., np.ndarray], size: int, own: bool) -> np.ndarray:
    return ml.summed(data, part, size, own, DIRECT_VALUES)


def _draws(grid: Sequence[Model]) -> bool:
    """Whether any model sees noise."""
    return any(m.scales for m in grid)


def _each(x: np.ndarray, k: np.ndarray, u: np.ndarray | None, grid: Sequence[Model]):
    """What each model sees of a block, and how often: every row by its own noise, or equal rows once."""
    every = np.repeat(x, k, axis=0) if u is not None and len(u) > len(k) and _draws(grid) else x
    for i, m in enumerate(grid):
        yield (i, noisy(every, u, m), None) if m.scales else (i, x, k)


def scaling(data: ml.Packed, grid: Sequence[Model], n_features: int) -> Scaling:
    """Means, then deviations around them, of what each model sees: two jobs."""
    shape, own = (len(grid), n_features), _draws(grid)
    total = lambda rows, k: rows.sum(axis=0) if k is None else k @ rows
    sums = lambda x, y, k, u: np.append(np.array([total(rows, times) for _, rows, times in _each(x, k, u, grid)]).ravel(), k.sum())
    found = _summed(data, sums, len(grid) * n_features + 1, own)
    n, mean = found[-1], (found[:-1] / max(found[-1], 1)).reshape(shape)
    squares = lambda x, y, k, u: np.array([total((rows - mean[i]) ** 2, times) for i, rows, times in _each(x, k, u, grid)]).ravel()
    return Scaling(n, mean, np.sqrt(_summed(data, squares, len(grid) * n_features, own).reshape(shape) / max(n, 1)) + 1e-8)


def _seen(x: np.ndarray, y: np.ndarray, k: np.ndarray, u: np.ndarray | None, grid: Sequence[Model], scaled: Scaling):
    """Each model's standardised rows with a last column of ones, their labels and how often each counts, one model after the other;
    noise is left out where u is None."""
    plain = {}  # all models without noise see the same
    bare = [m._replace(scales=()) for m in grid] if u is None else grid
    labels = y if u is None or len(u) == len(k) else np.repeat(y, k)
    for i, rows, times in _each(x, k, u, bare):
        same = not grid[i].scales
        made = plain.get("rows") if same else None
        if made is None:
            made = np.empty((len(rows), rows.shape[1] + 1), order="F")
            np.subtract(rows, scaled.mean[i], out=made[:, :-1])
            made[:, :-1] /= scaled.deviation[i]
            made[:, -1] = 1
            if same:
                plain["rows"] = made
        yield i, made, y if times is not None else labels, times


def fit(
    data: ml.Packed, grid: Sequence[Model], scaled: Scaling, classes: int = 2, steps: int = ml.STEPS, rate: float = ml.RATE, l2: float = ml.L2,
    ways: dict[int, ml.Way] | None = None,
) -> np.ndarray:
    """Weights (models, 1 or classes, features + 1) of regressions by full gradient steps from zero: a job a pass of ``ml.descended``."""
    shape = (1 if classes == 2 else classes, scaled.mean.shape[1] + 1)
    each = ml.sums_size(shape)

    def sums(points: ml.Points) -> list[ml.Sums]:
        live = [i for i, p in enumerate(points) if len(p)]
        some, at = [grid[i] for i in live], [points[i] for i in live]
        own = scaled._replace(mean=scaled.mean[live], deviation=scaled.deviation[live])
        part = lambda x, y, k, u: np.concatenate([ml.point_sums(at[i], rows, labels, times) for i, rows, labels, times in _seen(x, y, k, u, some, own)])
        ends = np.cumsum([len(p) * each for p in at])
        parts = np.split(_summed(data, part, int(ends[-1]), own=_draws(some)), ends[:-1])
        found = {i: ml.split_sums(total, points[i].shape) for i, total in zip(live, parts, strict=True)}
        return [(*found[i], scaled.n) if i in found else None for i in range(len(grid))]

    return ml.descended(sums, len(grid), shape, steps, rate, l2, ways)


#: Rows of the first thinned copy at least, its share from which it isn't worth while, and its share at least; share of the second copy.
THIN_ROWS, THIN_MOST, THIN_SHARE, MIDDLE_SHARE = 1 << 17, 1 / 4, 1 / 256, 1 / 16


def thinned(data: ml.Packed, share: float, table: Callable[[DataFrame, str], DataFrame]) -> ml.Packed:
    """The rows whose own uniform is below ``share``, as blocks of their own: rows by chance, whatever rows are equal or lie beside each other."""

    def some(batches):
        for b in batches:
            for x, y, k, u in ml.unpacked(b):
                found, run = np.flatnonzero(u < share), ml.runs_of(k, u)
                at = found if run is None else run[found]
                yield x[at], y[at], u[found]

    def run(batches):
        for block in ml.gathered(some(batches)):
            yield ml.drawn_block(*block)

    tasks = data.blocks.sparkSession.sparkContext.defaultParallelism
    return ml.written_evenly(data.blocks.mapInArrow(run, ml.DRAWN_BLOCK).repartition(4 * tasks), "thinned", table)


def fit_scaled(
    data: ml.Packed, grid: Sequence[Model], n_features: int, table: Callable[[DataFrame, str], DataFrame], classes: int = 2, steps: int = ml.STEPS,
    rate: float = ml.RATE, l2: float = ml.L2,
) -> tuple[np.ndarray, Scaling]:
    """``fit`` and the scaling it is for, over all rows, with the first look at a part of them.

    The descent over a thinned copy of many rows tells about where that over all of them goes. A pass over a larger copy brings it nearer and gives second
    derivatives. All rows then give gradients at few points of that way (``ml.corrected``), and in the first such pass their means and deviations too, so
    noise is drawn in two or three passes over all rows. A model is done when a pass finds the gradients within ``ml.NEAR_BEFORE`` of the foretold ones, or when the
    next one would within ``ml.NEAR``, if it gained as much as this one did. What isn't done after the last pass goes by ``fit``.
    """
    # a uniform has 8 bytes
    n = (data.blocks.agg(F.sum(F.length("u"))).first()[0] or 0) // 8 if _draws(grid) else 0
    share = max(THIN_ROWS / max(n, 1), THIN_SHARE)
    if share > THIN_MOST or steps <= max(ml.PASS_POINTS):
        scaled = scaling(data, grid, n_features)
        return fit(data, grid, scaled, classes, steps, rate, l2), scaled
    middle = thinned(data, max(MIDDLE_SHARE, min(4 * share, 1)), table)
    few, ways = thinned(data, share, table), {}
    scaled = scaling(few, grid, n_features)
    w = fit(few, grid, scaled, classes, steps, rate, l2, ways)
    scaled, _ = _nearer(middle, grid, scaled, ways, w, ml.NEAR_POINTS[:1], rate, l2, True)
    scaled, left = _nearer(data, grid, scaled, ways, w, ml.NEAR_POINTS, rate, l2)
    if left:
        w[left] = fit(data, [grid[i] for i in left], scaled._replace(mean=scaled.mean[left], deviation=scaled.deviation[left]), classes, steps, rate, l2)
    return w, scaled


def _nearer(data: ml.Packed, grid: Sequence[Model], near: Scaling, ways: dict[int, ml.Way], w: np.ndarray, counts: Sequence[int], rate: float, l2: float, curved: bool = False) -> tuple[Scaling, list[int]]:
    """The scaling of the rows, and the models that aren't done: ``ways`` (in the scaling ``near``) and weights ``w`` are corrected in place, in a pass for each of ``counts``."""
    scaled, before, left = near, {}, sorted(ways)
    for turn, count in enumerate(counts):
        at, weights = ml.pass_steps(len(ways[left[0]].weights) if left else 1, count)
        live = list(range(len(grid))) if turn == 0 else left
        points = [ways[i].weights[at] if i in ways else np.zeros((0, *w.shape[1:])) for i in live]
        n, first, second, sums = _point_sums(data, [grid[i] for i in live], scaled._replace(mean=scaled.mean[live], deviation=scaled.deviation[live]), points, turn == 0, curved)
        own = dict(zip(live, sums, strict=True))
        if turn == 0:
            # what the rows have as means and deviations in the scaling they were read in
            shift, size = first / n, np.sqrt(np.maximum(second / n - (first / n) ** 2, 0))
            deviation = size * near.deviation + 1e-8
            factor = deviation / near.deviation
            scaled = Scaling(n, near.mean + shift * near.deviation, deviation)
        left = []
        for i in [i for i in live if i in ways]:
            found = ml.Way(ways[i].weights[at], own[i][0] / n, own[i][1] / n if curved else ways[i].seconds[at])
            if turn == 0:
                ways[i], found = (ml.rescaled(way, shift[i], factor[i]) for way in (ways[i], found))
            if curved:
                ways[i] = ways[i]._replace(seconds=np.tensordot(weights, found.seconds, 1))
            ways[i], w[i], off = ml.corrected(ways[i], at, weights, found.gradients, n, rate, l2)
            # not a number is not close
            if not (off <= ml.NEAR_BEFORE or off * off <= ml.NEAR * before.get(i, 0)):
                left.append(i)
            before[i] = off
        if not left:
            break
    return scaled, sorted({*left, *set(range(len(grid))) - set(ways)})


def _point_sums(
    data: ml.Packed, grid: Sequence[Model], scaled: Scaling, points: ml.Points, moments: bool, curved: bool
) -> tuple[float, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray | None]]]:
    """Rows, sums and sums of squares of each model's standardised features (if ``moments``), and its gradients (and second derivatives, if ``curved``) at its points: one job."""
    d = scaled.mean.shape[1]

    def part(x, y, k, u):
        out = [np.array([k.sum()], float)]
        for i, rows, labels, times in _seen(x, y, k, u, grid, scaled):
            if moments:
                own = rows[:, :-1]
                out += [own.sum(axis=0), np.einsum("ij,ij->j", own, own)] if times is None else [times @ own, times @ (own * own)]
            if len(points[i]):
                out.append((ml.point_sums if curved else ml.point_gradients)(points[i], rows, labels, times).ravel())
        return np.concatenate(out)

    each = [len(p) * ml.sums_size(p.shape[1:]) if curved else p.size for p in points]
    ends = np.cumsum([1] + [s for e in each for s in ([d, d, e] if moments else [e])])
    parts = np.split(_summed(data, part, int(ends[-1]), own=_draws(grid)), ends[:-1])
    n, parts = parts[0][0], parts[1:]
    first, second = (np.array(parts[i::3]) if moments else np.zeros((0, d)) for i in (0, 1))
    found = parts[2::3] if moments else parts
    return n, first, second, [ml.split_sums(f, p.shape) if curved and len(p) else (f.reshape(p.shape), None) for f, p in zip(found, points, strict=True)]


def fit_private(
    data: ml.Packed, grid: Sequence[Model], scaled: Scaling, sigmas: Sequence[float | None], steps: int = PRIVATE_STEPS, sampling: float = PRIVATE_SAMPLING,
    clip: float = 1.0, rate: float = 1.0, l2: float = ml.SGD_L2, seed: int = 42,
) -> np.ndarray:
    """Noisy descent of all models, a job a step: each model takes its own rows, independently a row and step, and has its own noise."""
    w, features = np.zeros((len(grid), 1, scaled.mean.shape[1] + 1)), scaled.mean.shape[1]
    noises = [np.random.default_rng([seed, m.draws]) for m in grid]
    live = [i for i, sigma in enumerate(sigmas) if sigma is not None]
    for step in range(steps if live else 0):
        now = w

        def together(x, y, k, u):
            # all models see the same rows, so what all of them take is worked on at once
            bits, run, out = ml.step_bits(ml.row_bits(u, 0), step), ml.runs_of(k, u), np.zeros((len(grid), features + 1))  # noqa: B023
            rows, sizes = ml.places(bits, sampling, [grid[i].draws for i in live])
            out[live] = ml.taken_sums(now[live, 0], x, y, rows if run is None else run[rows], sizes, scaled.mean[0], scaled.deviation[0], clip)  # noqa: B023
            return out.ravel()

        def each(x, y, k, u):
            out, run = [], ml.runs_of(k, u)
            for i, rows, own, times in _seen(x, y, k, u, grid, scaled):
                # rows with noise stand for themselves, others for their run
                found, k_taken = ml.taken(u, k, sampling, step, grid[i].draws, run if times is not None else None)  # noqa: B023
                out.append(ml.gradient_sum(now[i], rows[found], own[found], clip, k_taken))  # noqa: B023
            return np.array(out).ravel()

        part = each if _draws(grid) else together
        total = _summed(data, part, w.size, own=True).reshape(w.shape)
        for i, sigma in enumerate(sigmas):
            if sigma is None:
                continue
            g = (total[i] + noises[i].normal(0, sigma * clip, w[i].shape)) / max(scaled.n * sampling, 1)
            g[:, :-1] += l2 * now[i][:, :-1]
            w[i] = now[i] - rate * g
    return w


def hits(data: ml.Packed, grid: Sequence[Model], scaled: Scaling, w: np.ndarray, classes: int) -> np.ndarray:
    """Test rows by model, class and guess: one job. Test rows have no noise, so one product scores them for all models: each model's scaling goes into its weights."""
    (m, c, _), centre = w.shape, scaled.mean[0]
    slopes = w[..., :-1] / scaled.deviation[:, None]
    starts = w[..., -1] - (slopes * (scaled.mean - centre)[:, None]).sum(axis=2)
    flat, offset, first = slopes.reshape(m * c, -1), starts.reshape(m * c, 1), np.arange(m)[:, None] * (classes * classes)
    step = max(256, 8 * ml.CACHED // (m * c))

    def part(x, y, k, u):
        out = np.zeros(m * classes * classes)
        for at in range(0, len(x), step):
            z = flat @ (x[at : at + step] - centre).T
            z += offset
            z = z.reshape(m, c, -1)
            place = first + y[at : at + step] * classes
            if c == 1:
                place += z[:, 0] >= 0
            else:
                best, guess = z[:, 0], np.zeros(place.shape, np.int8)
                for i in range(1, c):
                    guess[z[:, i] > best] = i
                    np.maximum(best, z[:, i], out=best)
                place += guess
            times = k[at : at + step]
            out += np.bincount(place.ravel(), None if (times == 1).all() else np.broadcast_to(times, place.shape).ravel(), len(out))
        return out

    return _summed(data, part, m * classes * classes, own=False).reshape(m, classes, classes)


def _judged(
    rows: DataFrame, features: Sequence[str], grid: Sequence[Model], trained: Callable[[ml.Packed, Callable[[DataFrame, str], DataFrame]], tuple[np.ndarray, Scaling]],
    own: bool, classes: int,
) -> np.ndarray:
    """``hits`` of the models that ``trained`` makes of rows (key or u, features, y, test). Rows are packed where they are; training rows get uniforms only where rows draw (``own``)."""
    with runtime.scratch(rows.sparkSession) as kept:
        train, test = ml.packed_parts(rows.where("test") if own else rows, features, kept.table)
        if own:
            train = ml.packed_drawn(rows.where("not test"), features, F.col("u") if "u" in rows.columns and "key" not in rows.columns else own_uniform(F.col("key")), kept.table)
        w, scaled = trained(train, kept.table)
        return hits(test, grid, scaled, w, classes)


def baseline(rows: DataFrame, features: Sequence[str], classes: int = 2, steps: int = ml.STEPS) -> DataFrame:
    """``metrics.confusion`` (y, yhat, k) of a logistic (2 classes) or softmax regression without noise, over all of rows (features, y, test)."""
    grid = [Model("none", "none", float("inf"), 0, (), 0)]
    found = _judged(rows, features, grid, lambda train, table: fit_scaled(train, grid, len(features), table, classes, steps), False, classes)[0]
    made = [(y, guess, int(k)) for (y, guess), k in np.ndenumerate(found) if k]
    return rows.sparkSession.createDataFrame(made, "y int, yhat int, k long")


def scored(counts: DataFrame, classes: int) -> DataFrame:
    """classes, n, accuracy, f1, macro_f1 of a ``baseline``."""
    found = np.zeros((classes, classes))
    for r in counts.collect():  # classes x classes rows
        found[r.y, r.yhat] = r.k
    accuracy, f1, macro_f1, _ = experiments.scored_hits(found)
    return counts.sparkSession.createDataFrame([(classes, int(found.sum()), accuracy, f1, macro_f1)], "classes int, n long, accuracy double, f1 double, macro_f1 double")


def sweep(
    rows: DataFrame, features: Sequence[str], settings: DataFrame, model: str, runs: int, classes: int = 2, steps: int = ml.STEPS,
    sampling: float = PRIVATE_SAMPLING, seed: int = 42,
) -> DataFrame:
    """``experiments.RESULT`` over all of rows (key, or their ``own_uniform`` u; features, y, test): one row a setting (setting, mechanism, epsilon, scales) and run.

    model: logistic, softmax, or private for noisy descent, whose noise keeps each setting's budget over the steps.
    """
    grid = models(settings, runs, model == "private", seed)
    sigmas = spent = [None] * len(grid)
    if model == "private":
        by = {m.epsilon: accounting.poisson_sigma(sampling, steps, m.epsilon) for m in grid}
        costs = {e: accounting.poisson_epsilon(sampling, s, steps) if s is not None else None for e, s in by.items()}
        sigmas, spent = [by[m.epsilon] for m in grid], [costs[m.epsilon] for m in grid]

    def trained(train: ml.Packed, table: Callable[[DataFrame, str], DataFrame]) -> tuple[np.ndarray, Scaling]:
        if model == "private":
            scaled = scaling(train, grid, len(features))
            return fit_private(train, grid, scaled, sigmas, steps, sampling, seed=seed), scaled
        return fit_scaled(train, grid, len(features), table, classes, steps)

    found, made = _judged(rows, features, grid, trained, model == "private" or _draws(grid), classes), []
    for m, sigma, cost, h in zip(grid, sigmas, spent, found, strict=True):
        own = [None if v is None else float(v) for v in (sigma, cost)]
        made.append((m.setting, model, m.mechanism, m.epsilon, m.run, *own, int(h.sum()), *experiments.scored_hits(h)))
    return rows.sparkSession.createDataFrame(made, experiments.RESULT)
