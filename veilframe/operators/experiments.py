"""Accuracy of models under privacy, over grids of settings and repeated runs.

An experiment works on a sample of bounded size (``SAMPLE_ROWS``), as training here costs the same for each of hundreds of
models. The sample is one row of arrays; every setting and run is a row beside it, and each of these rows is one model, trained
by numpy in the task that has the row. So a sweep is one job, as wide as its grid.

A row of settings: model (logistic, softmax, or private for noisy gradient descent), scales (the noise of each feature; empty
for none), mechanism, epsilon, run. Noise comes from a generator seeded by the seed and the row, so reruns agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe import runtime
from veilframe.functions import noise
from veilframe.operators import accounting, longform, metrics, ml, sensitivity

SAMPLE_ROWS = 20_000
#: Noisy gradient descent: rows a step on average, passes over the data, bound of a row's gradient.
BATCH, EPOCHS, CLIP = 256, 30, 1.0

RESULT = "setting string, model string, mechanism string, epsilon double, run int, sigma double, spent double, n long, accuracy double, f1 double, macro_f1 double, recalls array<double>"


def sample(df: DataFrame, features: Sequence[str], label: Column, key: Column, rows: int | None = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """key, features, y, test: at most ``rows`` rows by a keyed hash (None: all), split by class."""
    named = ml.prepared(df.withColumn("key", key), features, label).select("key", *features, "y")
    # the split reads a sample several times, so it is found once
    held = named if rows is None else runtime.materialize(ml.sampled(named, F.col("key"), rows, seed), "sampled")
    return ml.stratified_split(held, F.col("key"), seed=seed)


def block(sampled: DataFrame, features: Sequence[str]) -> DataFrame:
    """The sample as one row: x (all features of all rows), y, test. Its size is that of the sample, which is bounded."""
    row = F.struct("key", F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col("y").cast("int").alias("y"), "test")
    held = sampled.agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return held.select(F.flatten(F.transform("rows", lambda r: r.x)).alias("x"), F.transform("rows", lambda r: r.y).alias("y"), F.transform("rows", lambda r: r.test).alias("test"))


def train_long(sampled: DataFrame, features: Sequence[str]) -> DataFrame:
    """The training rows in the long layout, with y as the label."""
    return longform.unpivot(sampled.where("not test"), features, "y")


def noise_scales(long: DataFrame, weights: DataFrame, epsilons: Sequence[float], features: Sequence[str], mechanisms: Sequence[str] = noise.MECHANISMS, method: str = "clipped") -> DataFrame:
    """setting (the budget method), mechanism, epsilon, scales in the order of ``features``. weights: method, feature, weight."""
    rows = weights.join(F.broadcast(sensitivity.record_sensitivity(long, method)), "feature")
    rows = rows.withColumn("epsilon", F.explode(F.array(*[F.lit(float(e)) for e in epsilons]))).withColumn("mechanism", F.explode(F.array(*map(F.lit, mechanisms))))
    eps = F.greatest(F.col("epsilon") * F.col("weight"), F.lit(1e-6))
    scale = F.when(F.col("mechanism") == "laplace", F.col("sensitivity") / eps).otherwise(noise.gaussian_sigma(F.col("sensitivity"), eps))
    held = rows.groupBy(F.col("method").alias("setting"), "mechanism", "epsilon").agg(F.map_from_entries(F.collect_list(F.struct("feature", scale))).alias("by"))
    return held.select("setting", "mechanism", "epsilon", F.array(*[F.try_element_at("by", F.lit(f)) for f in features]).alias("scales"))


def plain(df: DataFrame, setting: str = "none") -> DataFrame:
    """One setting without noise, beside ``df``'s."""
    spark = df.sparkSession
    return spark.range(1).select(F.lit(setting).alias("setting"), F.lit("none").alias("mechanism"), F.lit(float("inf")).alias("epsilon"), F.array().cast("array<double>").alias("scales"))


def scored(y: np.ndarray, guess: np.ndarray, classes: int) -> tuple[float, float, float, list[float | None]]:
    """Accuracy, F1 of class 1, macro F1 over all classes, recall of each class (none without rows)."""
    return scored_hits(np.bincount(y * classes + guess, minlength=classes * classes).reshape(classes, classes).astype(float))


def scored_hits(hits: np.ndarray) -> tuple[float, float, float, list[float | None]]:
    """The same from the numbers of rows by class and guess."""
    classes = len(hits)
    support, found, right = hits.sum(axis=1), hits.sum(axis=0), np.diag(hits)
    f1 = np.divide(2 * right, support + found, out=np.zeros(classes), where=support + found > 0)
    return float(right.sum() / max(hits.sum(), 1)), float(f1[1]) if classes > 1 else 0.0, float(f1.mean()), [float(r / s) if s else None for r, s in zip(right, support, strict=True)]


def _fitted(x: np.ndarray, y: np.ndarray, classes: int, steps: int) -> np.ndarray:
    w = np.zeros((1 if classes == 2 else classes, x.shape[1]))
    for _ in range(steps):
        w = ml.stepped(w, ml.gradient_sum(w, x, y), len(x))
    return w


def _fitted_privately(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epsilon: float, batch: int, epochs: int) -> tuple[np.ndarray, float | None, float | None]:
    """Weights, noise and budget spent; every step takes each row with the same probability, independently."""
    n, rate = len(x), min(1.0, batch / max(len(x), 1))
    steps = epochs * max(1, n // batch)
    sigma = accounting.poisson_sigma(rate, steps, epsilon)
    w = np.zeros((1, x.shape[1]))
    if sigma is None:
        return w, None, None
    for _ in range(steps):
        take = rng.random(n) < rate
        g = (ml.gradient_sum(w, x[take], y[take], CLIP) + rng.normal(0, sigma * CLIP, w.shape)) / (rate * n)
        g[:, :-1] += ml.SGD_L2 * w[:, :-1]
        w = w - ml.SGD_RATE * g
    return w, sigma, accounting.poisson_epsilon(rate, sigma, steps)


def _trials(classes: int, steps: int, batch: int, epochs: int, seed: int):
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                y, test = np.array(r["y"], np.int64), np.array(r["test"], bool)
                x = np.array(r["x"], np.float64).reshape(len(y), -1)
                said = f"{r['setting']}|{r['model']}|{r['mechanism']}|{r['epsilon']}|{r['run']}"
                rng = np.random.default_rng([seed, zlib.crc32(said.encode())])
                train, held = x[~test], x[test]
                if len(r["scales"]):
                    scale = np.array(r["scales"], np.float64)
                    train = train + (rng.laplace(0, 1, train.shape) if r["mechanism"] == "laplace" else rng.normal(0, 1, train.shape)) * scale
                mean, deviation = train.mean(axis=0), train.std(axis=0) + 1e-8
                one = lambda m, mean=mean, deviation=deviation: np.column_stack([(m - mean) / deviation, np.ones(len(m))])
                sigma = spent = None
                if r["model"] == "private":
                    w, sigma, spent = _fitted_privately(one(train), y[~test], rng, r["epsilon"], batch, epochs)
                else:
                    w = _fitted(one(train), y[~test], classes, steps)
                z = one(held) @ w.T
                guess = (z[:, 0] >= 0).astype(np.int64) if len(w) == 1 else z.argmax(axis=1)
                values = [r[k] for k in names[:5]] + [sigma, spent, int(test.sum()), *scored(y[test], guess, classes)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, values, strict=True))], _SCHEMA)

    return run


_SCHEMA = pa.schema([
    ("setting", pa.string()), ("model", pa.string()), ("mechanism", pa.string()), ("epsilon", pa.float64()), ("run", pa.int32()), ("sigma", pa.float64()), ("spent", pa.float64()),
    ("n", pa.int64()), ("accuracy", pa.float64()), ("f1", pa.float64()), ("macro_f1", pa.float64()), ("recalls", pa.list_(pa.float64())),
])


def trials(one: DataFrame, settings: DataFrame, model: str, runs: int, classes: int = 2, steps: int = ml.STEPS, batch: int = BATCH, epochs: int = EPOCHS, seed: int = 42) -> DataFrame:
    """RESULT: one row a setting (setting, mechanism, epsilon, scales) and run. one: a ``block``."""
    grid = settings.withColumn("run", F.explode(F.sequence(F.lit(0), F.when(F.size("scales") + F.lit(int(model == "private")) > 0, F.lit(runs - 1)).otherwise(F.lit(0)))))
    rows = grid.withColumn("model", F.lit(model)).repartition(4 * one.sparkSession.sparkContext.defaultParallelism, "setting", "mechanism", "epsilon", "run")
    # one row of bounded size; the few result rows are written, as what is made of them reads them several times
    return runtime.materialize(rows.crossJoin(F.broadcast(one)).mapInArrow(_trials(classes, steps, batch, epochs, seed), RESULT), "trials")


def summarized(results: DataFrame, value: str = "accuracy") -> DataFrame:
    """setting, mechanism, epsilon, runs, accuracy and f1 (or what ``value`` names) with half a 95% interval and deviation, and the loss against the row without noise in percent."""
    by = ["setting", "mechanism", "epsilon"]
    second = "macro_f1" if value == "macro_f1" else "f1"
    half = lambda c: (1.96 * F.stddev_pop(c) / F.sqrt(F.count(c).cast("double"))).alias(f"{c}_ci")
    rows = results.groupBy(*by).agg(
        F.count("*").alias("runs"), F.avg("accuracy").alias("accuracy"), half("accuracy"), F.stddev_pop("accuracy").alias("accuracy_std"), F.avg(second).alias(second), half(second), F.stddev_pop(second).alias(f"{second}_std")
    )
    base = rows.where("mechanism = 'none'").agg(F.max("accuracy").alias("base"))
    return rows.crossJoin(F.broadcast(base)).withColumn("loss_pct", 100 * (F.col("base") - F.col("accuracy")) / F.greatest("base", F.lit(1e-8))).drop("base")  # one row


def class_recalls(results: DataFrame, names: Sequence[str]) -> DataFrame:
    """setting, mechanism, epsilon, and each class's mean recall and half a 95% interval."""
    made = []
    for i, n in enumerate(names):
        r = F.col("recalls")[i]
        made += [F.avg(r).alias(f"acc_{n}"), (1.96 * F.stddev_pop(r) / F.sqrt(F.count(r).cast("double"))).alias(f"acc_{n}_ci")]
    return results.groupBy("setting", "mechanism", "epsilon").agg(*made)


def compared(results: DataFrame, base: str = "uniform") -> DataFrame:
    """epsilon, setting, n, delta_pp, p: each setting's accuracies against those of ``base`` at the same budget and run, by signed ranks."""
    rows = results.where("mechanism <> 'none'").select("setting", "mechanism", "epsilon", "run", "accuracy")
    other = rows.where(F.col("setting") == base).select("mechanism", "epsilon", "run", F.col("accuracy").alias("base"))
    pairs = rows.where(F.col("setting") != base).join(other, ["mechanism", "epsilon", "run"])
    delta = pairs.groupBy("setting", "mechanism", "epsilon").agg(F.count("*").alias("n"), (100 * F.avg(F.col("accuracy") - F.col("base"))).alias("delta_pp"))
    tests = metrics.wilcoxon(pairs, "accuracy", "base", "run", ["setting", "mechanism", "epsilon"], ties="key").select("setting", "mechanism", "epsilon", "p")
    # without a difference there is no rank, and no evidence
    return delta.join(tests, ["setting", "mechanism", "epsilon"], "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
