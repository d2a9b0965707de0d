"""Labelled data preparation, scoring, and gradient training with and without differential privacy.

Training works on any number of rows: the rows are standardised once and written to the shared folder. Full gradient steps take a few
aggregations over them for all steps (``descended``), private ones one each; only sums of a size that the weights give reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe import runtime
from veilframe.functions import noise, scalars

STEPS, RATE, L2 = 200, 0.1, 0.01
#: Leading bytes of a hash that name a row's slice of its class.
SPLIT_BYTES = 2
SGD_RATE, SGD_L2 = 0.05, 1e-4


def prepared(df: DataFrame, features: Sequence[str], label: Column) -> DataFrame:
    """df's rows whose features all read as numbers and whose label isn't null, with y and those features as doubles."""
    rows = df.withColumns({f: scalars.number(F.col(f"`{f}`")) for f in features}).withColumn("y", label)
    return rows.dropna(subset=[*features, "y"])


def hashed(df: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """df and ``_h``, the keyed hash (16 bytes) that orders ``stratified_split``: made once where a table is written and split then."""
    return df.withColumn("_h", F.unhex(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))))


def stratified_split(df: DataFrame, key: Column | None, y: str = "y", share: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds ``test``: of each class the first share (at least one row) in the order of a keyed hash. Without a key df is ``hashed``, and its hash goes.

    No row is moved or ordered for it. Counts by the hash's first bytes (65,536 slices of a class) tell in which slice a
    class's share ends, counts by hash in that slice alone tell at which hash: one row a class, which is written and broadcast. Only where
    several rows have the hash at the end (equal keys) and not all of them are test rows, these are numbered, by their values.
    """
    rows, own = df if key is None else hashed(df, key, seed), [c for c in df.columns if c != "_h"]
    head, before = F.substring("_h", 1, SPLIT_BYTES), F.col("_upto") - F.col("_k")
    upto = lambda by: F.sum("_k").over(Window.partitionBy("_y").orderBy(by)).alias("_upto")
    ends_here = (F.col("_upto") >= F.col("_want")) & (before < F.col("_want"))
    slices = rows.groupBy(F.col(y).alias("_y"), head.alias("_s")).agg(F.count("*").alias("_k"))
    want = F.greatest(F.lit(1), F.floor(F.lit(share) * F.sum("_k").over(Window.partitionBy("_y"))))
    ends = slices.select("_y", "_s", "_k", upto("_s"), want.alias("_want")).where(ends_here).select("_y", "_s", (F.col("_want") - before).alias("_want"))
    near = rows.join(F.broadcast(ends), F.col(y).eqNullSafe(F.col("_y")) & (head == F.col("_s")))
    near = near.groupBy("_y", "_want", "_h").agg(F.count("*").alias("_k")).select("_y", "_want", "_k", F.col("_h").alias("_cut"), upto("_h"))
    cuts = runtime.materialize(near.where(ends_here).select("_y", "_cut", "_k", (F.col("_want") - before).alias("_fit")), "cuts")

    placed = rows.join(F.broadcast(cuts), F.col(y).eqNullSafe(F.col("_y")))
    at, part = F.col("_h") == F.col("_cut"), F.col("_fit") < F.col("_k")
    made = placed.select(*own, (F.col("_h") <= F.col("_cut")).alias("test"))
    if not cuts.where(part).isEmpty():
        place = F.row_number().over(Window.partitionBy("_y").orderBy(F.xxhash64(*own)))
        made = placed.where(~(at & part)).select(*own, (F.col("_h") <= F.col("_cut")).alias("test"))
        made = made.unionByName(placed.where(at & part).select(*own, (place <= F.col("_fit")).alias("test")))
    return made


def sampled(df: DataFrame, key: Column, rows: int, seed: int = 42) -> DataFrame:
    """The first ``rows`` in the order of a keyed hash: a sampling operator, so the limit is the feature."""
    return df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))).orderBy("_h").limit(rows).drop("_h")


def standardized(df: DataFrame, features: Sequence[str], train: Column | None = None) -> DataFrame:
    """Each feature minus its mean over its population deviation (plus 1e-8) on the training rows."""
    on = train if train is not None else F.lit(True)
    parts = [x for f in features for x in (F.avg(F.when(on, F.col(f))).alias(f"_m_{f}"), F.stddev_pop(F.when(on, F.col(f))).alias(f"_s_{f}"))]
    both = df.crossJoin(F.broadcast(df.agg(*parts)))  # one row
    return both.withColumns({f: (F.col(f) - F.col(f"_m_{f}")) / (F.col(f"_s_{f}") + 1e-8) for f in features}).select(*df.columns)


def clipped_gradient(gradient: Column, norm: float) -> Column:
    """An array scaled down to the given length at most."""
    length = F.sqrt(scalars.dot(gradient, gradient)) + 1e-10
    return F.transform(gradient, lambda g: g * F.least(F.lit(1.0), norm / length))


def logistic(features: Column, weights: Sequence[float], bias: float) -> Column:
    return scalars.sigmoid(scalars.dot(features, F.array(*[F.lit(float(w)) for w in weights])) + bias)


#: Rows of a packed block: few enough that what a model makes of them stays in a core's cache.
BLOCK_ROWS = 8192
#: Tasks up to which their sums go to the driver directly; beyond, Spark adds them up first.
DIRECT_TASKS = 256
#: Doubles that go to the driver in a job directly; beyond, Spark adds them up first.
DIRECT_VALUES = 1 << 20


def _packer(batches):
    """Rows (x, y, u), equal ones beside each other, to blocks of matrices, so that a step reads numbers and not rows: x and y once for each run
    of equal rows, k the number of its rows, and u of every row."""
    parts, n = [], 0

    def block():
        x, y, u = (np.concatenate(c) for c in zip(*parts, strict=True))
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(axis=1) | (y[1:] != y[:-1])))
        k = np.diff(np.append(first, len(y))).astype(np.int32)
        return pa.RecordBatch.from_pydict({"n": [len(k)], "x": [x[first].tobytes()], "y": [y[first].tobytes()], "k": [k.tobytes()], "u": [u.tobytes()]})

    for b in batches:
        if not b.num_rows:
            continue
        x = np.array(b["x"].flatten(), np.float64)
        parts.append((x.reshape(b.num_rows, len(x) // b.num_rows), np.array(b["y"], np.int32), np.array(b["u"], np.float64)))
        n += b.num_rows
        if n >= BLOCK_ROWS:
            yield block()
            parts, n = [], 0
    if parts:
        yield block()


def _batches(columns: int) -> dict[str, str]:
    """Arrow batches of rows of numbers: bounded by rows alone, as Spark takes longer to look at a batch's bytes after each row than to write it."""
    rows = max(1, min(BLOCK_ROWS, (8 << 20) // (8 * columns)))
    return {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str((1 << 31) - 1)}


class Packed(NamedTuple):
    """Blocks, the tasks that read them, and the bytes of files that one of these reads (None: as the session says)."""

    blocks: DataFrame
    tasks: int
    split: int | None = None


#: Bytes of a row group of blocks, tasks a core that read them, and bounds of what a task reads: tasks of even size, some for each core, however the rows came.
GROUP_BYTES, WAVES, LEAST_READ, MOST_READ = 4 << 20, 4, 4 << 20, 128 << 20
_GROUPS = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "4"}


def _read_by(split: int | None) -> dict[str, str]:
    return {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": str(1 << 16)} if split else {}


def written_evenly(made: DataFrame, name: str, table: Callable[[DataFrame, str], DataFrame] = runtime.materialize, **settings: str) -> Packed:
    """``made``'s blocks as a table in small groups, for tasks of even size."""
    spark = made.sparkSession
    with runtime.settings(spark, _GROUPS | settings):
        blocks = table(made, name)
    size = runtime.size(blocks)
    split = min(max(size // (WAVES * spark.sparkContext.defaultParallelism), LEAST_READ), MOST_READ)
    return Packed(blocks, size // split + 1, split)


def packed(rows: DataFrame) -> Packed:
    """The training rows as a table of blocks.

    Equal rows are brought together, so that a step reads and computes their numbers once; their draws stay their own. Ranges of
    (hash, u) are dealt, so many equal rows are shared by tasks like others.
    """
    tasks = max(rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism)
    near = rows.select("x", "y", "u", F.xxhash64("x", "y").alias("_h")).repartitionByRange(tasks, "_h", "u").sortWithinPartitions("_h", "u")
    blocks = runtime.materialize(near.select("x", "y", "u").mapInArrow(_packer, "n long, x binary, y binary, k binary, u binary"), "blocks")
    return Packed(blocks, blocks.rdd.getNumPartitions())


def _where_they_are(flat: DataFrame, columns: int, packer: Callable, schema: str, table: Callable[[DataFrame, str], DataFrame]) -> Packed:
    """The blocks that ``packer`` makes of rows of numbers, written once without moving the rows (or their blocks, where these lie in fewer parts than there are cores)."""
    spark = flat.sparkSession
    made, tasks = flat.mapInArrow(packer, schema), spark.sparkContext.defaultParallelism
    if flat.rdd.getNumPartitions() < tasks:
        made = made.repartition(tasks)
    return written_evenly(made, "blocks", table, **_batches(columns))


def drawn_block(x: np.ndarray, y: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
    """A block of rows with uniforms, each a run of its own."""
    return pa.RecordBatch.from_pydict({"n": [len(y)], "x": [x.tobytes()], "y": [y.tobytes()], "k": [np.ones(len(y), np.int32).tobytes()], "u": [u.tobytes()]})


DRAWN_BLOCK = "n long, x binary, y binary, k binary, u binary"


def gathered(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of rows joined until they have ``BLOCK_ROWS``."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[-1])
        if n >= BLOCK_ROWS:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _features_of(b: pa.RecordBatch, features: int) -> np.ndarray:
    return np.column_stack([np.empty((b.num_rows, 0)), *[np.array(b.column(j), np.float64) for j in range(features)]])


def _drawn_packer(features: int):
    """Rows (each feature, y, u) to blocks."""

    def run(batches):
        parts = ((_features_of(b, features), np.array(b["y"], np.int32), np.array(b["u"], np.float64)) for b in batches if b.num_rows)
        for block in gathered(parts):
            yield drawn_block(*block)

    return run


def packed_drawn(rows: DataFrame, features: Sequence[str], u: Column, table: Callable[[DataFrame, str], DataFrame] = runtime.materialize) -> Packed:
    """Rows (features, y) with uniforms as blocks, written where the rows are. Equal rows aren't brought together: each draws for itself, so that only
    pays where few models with few draws read many equal rows often."""
    flat = rows.select(*[F.col(f"`{f}`").cast("double").alias(f"x{j}") for j, f in enumerate(features)], F.col("y").cast("int").alias("y"), u.alias("u"))
    return _where_they_are(flat, len(features) + 2, _drawn_packer(len(features)), DRAWN_BLOCK, table)


def _parts_packer(features: int):
    """Rows (each feature, y, test) to blocks of training rows and blocks of test rows, without uniforms; each row is a run."""

    def block(test, parts):
        x, y = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.RecordBatch.from_pydict({"test": [test], "n": [len(y)], "x": [x.tobytes()], "y": [y.tobytes()], "k": [np.ones(len(y), np.int32).tobytes()]})

    def run(batches):
        held, n = {False: [], True: []}, {False: 0, True: 0}
        for b in batches:
            x = _features_of(b, features)
            y, test = np.array(b["y"], np.int32), np.array(b["test"], bool)
            for part, own in ((False, ~test), (True, test)):
                held[part].append((x[own], y[own]))
                n[part] += len(held[part][-1][1])
                if n[part] >= BLOCK_ROWS:
                    yield block(part, held[part])
                    held[part], n[part] = [], 0
        for part, parts in held.items():
            if n[part]:
                yield block(part, parts)

    return run


def packed_parts(rows: DataFrame, features: Sequence[str], table: Callable[[DataFrame, str], DataFrame] = runtime.materialize) -> tuple[Packed, Packed]:
    """Training and test rows of rows (features, y, test) as blocks for what draws nothing: written in one scan, where the rows are.

    Equal rows aren't brought together, which would move them all: in a few passes that costs more than it saves.
    """
    flat = rows.select(*[F.col(f"`{f}`").cast("double").alias(f"x{j}") for j, f in enumerate(features)], F.col("y").cast("int").alias("y"), "test")
    both = _where_they_are(flat, len(features) + 2, _parts_packer(len(features)), "test boolean, n long, x binary, y binary, k binary", table)
    train, test = (both._replace(blocks=both.blocks.where(c).drop("test")) for c in ("not test", "test"))
    return train, test


def unpacked(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """x, y, k and, where it was read, u of each block, without copies."""
    read = lambda c, i, kind: np.frombuffer(b[c][i].as_buffer(), kind)
    for i in range(b.num_rows):
        n = b["n"][i].as_py()
        yield read("x", i, np.float64).reshape(n, -1), read("y", i, np.int32), read("k", i, np.int32), read("u", i, np.float64) if "u" in b.schema.names else None


def mixed(h: np.ndarray, word: int, last: bool = True) -> np.ndarray:
    """64-bit hashes mixed with a word (the finalizer of SplitMix64), without its last shift if not ``last``."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(word & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
        t = h >> np.uint64(30)
        for shift, factor in ((27, 0xBF58476D1CE4E5B9), (31, 0x94D049BB133111EB)):
            h ^= t
            h *= np.uint64(factor)
            if last or shift != 31:
                np.right_shift(h, np.uint64(shift), out=t)
        if last:
            h ^= t
        return h


def row_bits(u: np.ndarray, seed: int) -> np.ndarray:
    """A row's own uniform as bits, set apart by a seed."""
    return (u * float(1 << 53)).astype(np.uint64) ^ (np.uint64(seed & 0xFFFFFFFF) << np.uint64(32))


def step_bits(bits: np.ndarray, step: int) -> np.ndarray:
    """Hashes of rows' bits (without a seed) and a step, which serve all seeds."""
    return mixed(bits, step + 1)


def places(bits: np.ndarray, rate: float, seeds: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the rows with these ``step_bits`` each seed takes, one seed after the other, and how many.

    A row is taken if a 64-bit number is below ``rate``: its upper half is that of the hash times an odd number that the seed gives, its lower half that of
    the hash. It is as evenly spread as the hash, so a seed's draws are independent over rows and steps, at exactly the rate. Two seeds take a row
    together as often as independent draws would; of three or more nothing is said.
    """
    if rate >= 1:
        return np.tile(np.arange(len(bits)), len(seeds)), np.full(len(seeds), len(bits))
    limit, halves, factors = math.ceil(rate * (1 << 64)), bits.view(np.uint32), mixed(np.array(seeds, np.uint64) & np.uint64(0xFFFFFFFF), 1).astype(np.uint32) | np.uint32(1)
    high, top, product, mask, found = np.ascontiguousarray(halves[1::2]), np.uint32(limit >> 32), np.empty(len(bits), np.uint32), np.empty(len(bits), bool), []
    for factor in factors:
        np.multiply(high, factor, out=product)
        np.less_equal(product, top, out=mask)
        found.append(mask.nonzero()[0])
    rows, sizes = np.concatenate(found), np.array([len(f) for f in found])
    # at the very edge the lower half tells
    edge = high.take(rows, mode="clip") * np.repeat(factors, sizes) == top
    if edge.any():
        out = edge & (halves[::2][rows] >= np.uint32(limit & 0xFFFFFFFF))
        sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[out], minlength=len(sizes))
        rows = rows[~out]
    return rows, sizes


def drawn(u: np.ndarray, rate: float, step: int, seed: int) -> np.ndarray:
    """Which rows a step takes: each with probability ``rate``, independently of other rows and of other steps.

    A row's draw comes from a hash of its own uniform and the step, and from the seed.
    """
    out = np.zeros(len(u), bool)
    out[places(step_bits(row_bits(u, 0), step), rate, [seed])[0]] = True
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """In place."""
    np.clip(z, -500, 500, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def hits(bits: np.ndarray, rate: float, step: int, seed: int) -> np.ndarray:
    """The places that ``drawn`` takes, from the rows' bits without a seed."""
    return places(step_bits(bits, step), rate, [seed])[0]


def taken_sums(w: np.ndarray, x: np.ndarray, y: np.ndarray, rows: np.ndarray, sizes: np.ndarray, mean: np.ndarray, deviation: np.ndarray, clip: float) -> np.ndarray:
    """Summed gradients (models, features + 1) of many models of two classes, each clipped to a length, over the places ``rows`` of x that each takes:
    ``sizes`` of them for each model, one model after the other."""
    out = np.zeros(w.shape)
    if not len(rows):
        return out
    seen = np.ascontiguousarray(x.T)
    seen -= mean[:, None]
    seen *= (1 / deviation)[:, None]
    norms = np.einsum("ij,ij->j", seen, seen)
    norms += 1
    np.sqrt(norms, out=norms)
    # all places are within, so how take treats others doesn't matter; clip is its fastest way
    taken = [c.take(rows, mode="clip") for c in seen]
    # minus the score, then 1 / (1 + exp) of it
    err = np.repeat(-w[:, -1], sizes)
    for slope, c in zip(w.T, taken, strict=False):
        at = np.repeat(slope, sizes)
        at *= c
        err -= at
    with np.errstate(over="ignore"):
        np.exp(err, out=err)
    err += 1
    np.reciprocal(err, out=err)
    err -= (y > 0).astype(np.float64).take(rows, mode="clip")
    least = norms.take(rows, mode="clip")
    least *= np.abs(err)
    least += 1e-10
    np.divide(clip, least, out=least)
    err *= np.minimum(least, np.ones(len(rows)), out=least)
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    for j, c in enumerate(taken):
        c *= err
        out[some, j] = np.add.reduceat(c, starts)
    out[some, -1] = np.add.reduceat(err, starts)
    return out


def clipped_sums(w: np.ndarray, x: np.ndarray, y: np.ndarray, norms: np.ndarray, times: np.ndarray, clip: float) -> np.ndarray:
    """Summed gradients (models, features + 1) of many models of two classes over rows x (with a last column of ones) of these squared lengths,
    each clipped to a length and as often as ``times`` (models, rows) says."""
    flat = np.flatnonzero(times)
    row = flat % len(y)
    err = _sigmoid((w @ x.T).ravel()[flat])
    err -= y[row] > 0
    err *= np.minimum(1, clip / (np.sqrt(err * err * norms[row]) + 1e-10))
    err *= times.ravel()[flat]
    weight = np.zeros(times.shape)
    weight.ravel()[flat] = err
    return weight @ x


def gradient_sum(w: np.ndarray, x: np.ndarray, y: np.ndarray, clip: float | None = None, k: np.ndarray | None = None) -> np.ndarray:
    """Summed gradients (1 or classes, features + 1) over rows x (with a last column of ones), each ``k`` times; each clipped to a length."""
    z = w @ x.T
    if len(w) == 1:
        err = _sigmoid(z) - (y > 0)
    else:
        p = np.exp(z - z.max(axis=0))
        err = p / p.sum(axis=0) - (np.arange(len(w))[:, None] == y)
    if clip is not None:
        err *= np.minimum(1, clip / (np.sqrt((err * err).sum(axis=0) * (x * x).sum(axis=1)) + 1e-10))
    return (err if k is None else err * k) @ x


def taken(u: np.ndarray, k: np.ndarray, rate: float, step: int, seed: int, run: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal rows of which a step takes some, and how many. run: each row's run, where rows outnumber runs."""
    rows = hits(row_bits(u, 0), rate, step, seed)
    if run is None:
        return rows, np.ones(len(rows), np.int64)
    times = np.bincount(run[rows], minlength=len(k))
    found = np.flatnonzero(times)
    return found, times[found]


def runs_of(k: np.ndarray, u: np.ndarray) -> np.ndarray | None:
    """Each row's run, or None where each row is one."""
    return None if len(k) == len(u) else np.repeat(np.arange(len(k)), k)


def _gradient_task(weights: np.ndarray, clip: float | None, rate: float, step: int, seed: int):
    """Per partition: the summed gradient over its blocks, and the number of rows."""

    def run(batches):
        total, n = np.zeros_like(weights), 0
        for b in batches:
            for x, y, k, u in unpacked(b):
                if rate < 1:
                    found, k = taken(u, k, rate, step, seed, runs_of(k, u))
                    x, y = x[found], y[found]
                total += gradient_sum(weights, np.column_stack([x, np.ones(len(x))]), y, clip, k)
                n += k.sum()
        yield pa.RecordBatch.from_pydict({"j": pa.array(range(weights.size + 1), pa.int32()), "g": np.append(total.ravel(), n)})

    return run


def _sums(data: Packed, weights: np.ndarray, clip: float | None = None, rate: float = 1.0, step: int = 0, seed: int = 0) -> tuple[np.ndarray, float]:
    """Summed gradient and row count; what reaches the driver is the size of the weights for each of at most DIRECT_TASKS tasks."""
    read = data.blocks if rate < 1 else data.blocks.drop("u")
    parts = read.mapInArrow(_gradient_task(weights, clip, rate, step, seed), "j int, g double")
    if data.tasks > DIRECT_TASKS:
        parts = parts.groupBy("j").agg(F.sum("g").alias("g"))
    found = parts.toArrow()
    total = np.zeros(weights.size + 1)
    np.add.at(total, found["j"].to_numpy(), found["g"].to_numpy())
    return total[:-1].reshape(weights.shape), total[-1]


def summed(data: Packed, part: Callable[..., np.ndarray], size: int, own: bool, direct: int = DIRECT_VALUES) -> np.ndarray:
    """The sum over all blocks of ``part(x, y, k, u)``, a vector of ``size``: one job. Only where rows draw (``own``) are their uniforms read."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            for block in unpacked(b):
                total += part(*block)
        yield pa.RecordBatch.from_pydict({"j": pa.array(range(size), pa.int32()), "g": total})

    parts = (data.blocks if own else data.blocks.drop("u")).mapInArrow(run, "j int, g double")
    if data.tasks * size > direct:
        parts = parts.groupBy("j").agg(F.sum("g").alias("g"))
    with runtime.settings(data.blocks.sparkSession, _read_by(data.split)):
        found = parts.toArrow()
    total = np.zeros(size)
    np.add.at(total, found["j"].to_numpy(), found["g"].to_numpy())
    return total


def vectors(df: DataFrame, features: Sequence[str], key: Column) -> DataFrame:
    """x array, y int, u in (0, 1): the layout of training rows, written once; ``test``, if df has it, stays."""
    rows = df.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col("y").cast("int").alias("y"), noise.keyed_uniform(0, "batch", key).alias("u"), *[c for c in df.columns if c == "test"])
    return runtime.materialize(rows, "vectors")


def train(rows: DataFrame, n_features: int, n_classes: int = 2, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> np.ndarray:
    """Weights of a logistic (2 classes) or softmax regression by full gradient steps from zero; the bias isn't penalised.

    Deterministic up to the order of sums and ``CLOSE``. Returns (1 or classes, features + 1).
    """
    data, shape = packed(rows), (1 if n_classes == 2 else n_classes, n_features + 1)

    def sums(points: Points) -> list[Sums]:
        at = points[0]
        part = lambda x, y, k, u: np.append(point_sums(at, np.column_stack([x, np.ones(len(x))]), y, k), k.sum())
        total = summed(data, part, len(at) * sums_size(shape) + 1, own=False)
        return [(*split_sums(total[:-1], at.shape), total[-1])]

    return descended(sums, 1, shape, steps, rate, l2)[0]


#: Points where passes take sums: few while the way is still far off, then two numbers in turn, so that each pass checks the one before it between its points too.
FIRST_POINTS, PASS_POINTS = (6, 9), (24, 25)
#: Doubles of an array that stays in a core's cache while all points of a pass are worked on.
CACHED = 1 << 15
#: How near a pass must come to the gradients (a row) that the one before foretold, and the passes for it. The steps are then nearer by far: errors are squared from pass to pass.
CLOSE, PASSES = 1e-7, 12

#: For each model the points (any number, classes, features + 1) where sums are wanted, and gradients, second derivatives and rows there.
Points = list[np.ndarray]
Sums = tuple[np.ndarray, np.ndarray, float]


def sums_size(shape: tuple[int, int]) -> int:
    """Numbers of a point in ``point_sums``."""
    c, d = shape
    return c * d + c * (c + 1) // 2 * (d * (d + 1) // 2)


def point_sums(points: np.ndarray, x: np.ndarray, y: np.ndarray, k: np.ndarray | None = None) -> np.ndarray:
    """Summed gradients at each point, then summed second derivatives (those on and above the diagonals), over rows x (with a last column of ones), each ``k`` times."""
    (m, c, d), one = points.shape, points.shape[1] == 1
    # over all classes both sum to zero, so those of the last class follow from the others
    free = max(c - 1, 1)
    (i, j), (a, b) = np.triu_indices(d), np.triu_indices(free)
    gradients, seconds, flat = np.zeros((m * free, d)), np.zeros((m * len(a), len(i))), points.reshape(m * c, d)
    rows = max(128, CACHED // (m * c))
    for at in range(0, len(x), rows):
        some, label, times = x[at : at + rows], y[at : at + rows], None if k is None else k[at : at + rows]
        pairs = np.empty((len(i), len(some)))
        for n, (q, r) in enumerate(zip(i, j, strict=True)):
            np.multiply(some[:, q], some[:, r], out=pairs[n])
        p = flat @ some.T
        if one:
            _sigmoid(p)
            curved = p * p
            np.subtract(p, curved, out=curved)
            p -= label > 0
        else:
            p = p.reshape(m, c, -1)
            top = p[:, 0].copy()
            for n in range(1, c):
                np.maximum(top, p[:, n], out=top)
            p -= top[:, None]
            np.exp(p, out=p)
            np.copyto(top, p[:, 0])
            for n in range(1, c):
                top += p[:, n]
            p = p[:, :free]
            p /= top[:, None]
            curved = np.empty((m, len(a), len(some)))
            for n, (q, r) in enumerate(zip(a, b, strict=True)):
                np.multiply(p[:, q], p[:, r], out=curved[:, n])
                np.subtract(p[:, q] if q == r else 0, curved[:, n], out=curved[:, n])
            p -= np.arange(free)[:, None] == label
        if times is not None:
            p *= times
            curved *= times
        gradients += p.reshape(m * free, -1) @ some
        seconds += curved.reshape(m * len(a), -1) @ pairs.T
    if one:
        return np.append(gradients, seconds)
    g, held, by = np.zeros((m, c, d)), seconds.reshape(m, len(a), len(i)), np.zeros((m, c, c, len(i)))
    g[:, :free] = gradients.reshape(m, free, d)
    g[:, free] = -g.sum(axis=1)
    by[:, a, b] = by[:, b, a] = held
    by[:, :free, free] = by[:, free, :free] = -by[:, :free].sum(axis=2)
    by[:, free, free] = -by[:, free, :free].sum(axis=1)
    return np.append(g, by[:, *np.triu_indices(c)])


def point_gradients(points: np.ndarray, x: np.ndarray, y: np.ndarray, k: np.ndarray | None = None) -> np.ndarray:
    """Summed gradients (points, classes, features + 1) alone, over rows x (with a last column of ones, column by column in memory), each ``k`` times.

    A class counts against the first one, whose own gradient follows from the others; what the labels give is summed once for all points.
    """
    (m, c, d), one = points.shape, points.shape[1] == 1
    free = max(c - 1, 1)
    # exp(-z) for two classes, exp(z_class - z_first) for more
    apart = -points[:, 0] if one else (points[:, 1:] - points[:, :1]).transpose(1, 0, 2).reshape(free * m, d)
    total, across, rows = np.zeros((free * m, d)), x.T, max(256, CACHED // (free * m))
    with np.errstate(over="ignore"):
        for at in range(0, len(x), rows):
            some = across[:, at : at + rows]
            p = apart @ some
            if one:
                np.exp(p, out=p)
                p += 1
                np.reciprocal(p, out=p)
            else:
                # the first class has a score of 0; the greatest is taken off only where it would be too large for exp
                p, top = p.reshape(free, m, -1), 0.0
                if not p.max() < 700:
                    top = np.maximum(p.max(axis=0), 0)
                    p -= top
                np.exp(p, out=p)
                whole = p[0] + np.exp(-top)
                for i in range(1, free):
                    whole += p[i]
                np.reciprocal(whole, out=whole)
                p *= whole
                p = p.reshape(free * m, -1)
            if k is not None:
                p *= k[at : at + rows]
            total += p @ some.T
    is_class = ((y > 0)[None] if one else y == np.arange(1, c)[:, None]).astype(np.float64)
    labels = (is_class if k is None else is_class * k) @ x
    g = total.reshape(free, m, d).transpose(1, 0, 2) - labels
    return g if one else np.concatenate([-g.sum(axis=1, keepdims=True), g], axis=1)


def split_sums(total: np.ndarray, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """``point_sums`` as gradients (points, classes, features + 1) and matrices of second derivatives."""
    m, c, d = shape
    (i, j), (a, b) = np.triu_indices(d), np.triu_indices(c)
    held, full = total[m * c * d :].reshape(m, len(a), len(i)), np.zeros((m, c, c, d, d))
    for n, (one, other) in enumerate(zip(a, b, strict=True)):
        block = np.zeros((m, d, d))
        block[:, i, j] = block[:, j, i] = held[:, n]
        full[:, one, other] = full[:, other, one] = block
    return total[: m * c * d].reshape(shape), full.transpose(0, 1, 3, 2, 4).reshape(m, c * d, c * d)


def pass_steps(steps: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps at which a pass takes sums, denser where the way begins, and the weights (steps, points) that carry what holds there to all steps."""
    time = np.log1p(np.arange(steps) / 10)
    nodes = time[-1] * (1 - np.cos(np.pi * np.arange(points) / (points - 1))) / 2
    at = np.unique(np.rint(10 * np.expm1(nodes)).astype(int))
    t = time[at]
    apart = (t[:, None] - t) * 4 / time[-1]
    np.fill_diagonal(apart, 1)
    gap = time[:, None] - t
    there = gap == 0
    gap[there] = 1
    weights = 1 / apart.prod(axis=1) / gap
    weights /= weights.sum(axis=1, keepdims=True)
    weights[there.any(axis=1)] = there[there.any(axis=1)]
    return at, weights


class Way(NamedTuple):
    """The weights before each step, and gradients and second derivatives of a row there (steps, ...)."""

    weights: np.ndarray
    gradients: np.ndarray
    seconds: np.ndarray


def descended(
    sums: Callable[[Points], list[Sums]], models: int, shape: tuple[int, int], steps: int, rate: float = RATE, l2: float = L2, found_ways: dict[int, Way] | None = None
) -> np.ndarray:
    """Weights (models, classes, features + 1) after full gradient steps from zero, with a few passes over the rows instead of one a step.

    A pass takes gradients and second derivatives of all models at some steps of the way as far as it is known. Between these steps they are
    interpolated, which gives the gradient near the way, and with it all steps are taken anew: Newton's method for the whole way. A model is done when
    a pass, at other steps than the one before, finds the gradients that were foretold within ``CLOSE``. What isn't done after ``PASSES`` goes step by step.
    ``found_ways`` takes the ways of the models that are done.
    """
    w, left, size = np.zeros((models, *shape)), list(range(models)), shape[0] * shape[1]
    none = np.zeros((0, *shape))
    ways = np.zeros((models, steps, *shape))
    told: dict[int, np.ndarray] = {}
    if steps > max(PASS_POINTS):
        at, weights = np.array([0]), np.ones((steps, 1))
        counts = [*FIRST_POINTS, *(PASS_POINTS * PASSES)][:PASSES]
        for turn, count in enumerate(counts):
            found, later = sums([ways[i, at] if i in left else none for i in range(models)]), []
            for i in left:
                gradients, seconds, n = found[i]
                curved = np.tensordot(weights, seconds, 1).reshape(steps, size, size)
                # not a number is not close
                done = turn > len(FIRST_POINTS) and np.abs(gradients - told[i][at]).max() <= CLOSE * max(n, 1)
                told[i], ways[i], w[i] = _way(np.tensordot(weights, gradients, 1), curved, ways[i], n, rate, l2)
                if not done:
                    later.append(i)
                elif found_ways is not None:
                    found_ways[i] = Way(ways[i], told[i] / max(n, 1), curved / max(n, 1))
            left = later
            if not left:
                return w
            at, weights = pass_steps(steps, count)
    w[left] = 0
    for _ in range(steps if left else 0):
        found = sums([w[i][None] if i in left else none for i in range(models)])
        for i in left:
            w[i] = stepped(w[i], found[i][0][0], found[i][2], rate, l2)
    return w


#: Points of the passes of ``corrected``, how near the gradients (a row) must be to the foretold ones in the end, and how near those of a last pass that is
#: corrected once more. Weights are then within some 1e-9.
NEAR_POINTS, NEAR, NEAR_BEFORE = (14, 17, 20, 23), 1e-9, 2e-8


def corrected(way: Way, at: np.ndarray, weights: np.ndarray, gradients: np.ndarray, n: float, rate: float = RATE, l2: float = L2) -> tuple[Way, np.ndarray, float]:
    """The way after a pass that found these gradients (a row) at some of its steps, the weights after the last step, and how far they were from the foretold ones.

    What a gradient differs by from the foretold one is small and smooth along the way, so few points tell it for all steps. Second derivatives stay:
    they only carry a gradient over the small distance to the way anew.
    """
    apart = gradients - way.gradients[at]
    told = way.gradients + np.tensordot(weights, apart, 1)
    made, walked, w = _way(told * n, way.seconds * n, way.weights, n, rate, l2)
    return Way(walked, made / max(n, 1), way.seconds), w, float(np.abs(apart).max())


def rescaled(way: Way, shift: np.ndarray, factor: np.ndarray) -> Way:
    """The same way where a row's features are (x - shift) / factor instead of x: its weights give the same scores there."""
    weights, (steps, c, d) = way.weights.copy(), way.weights.shape
    # scores stay, and so do sums over rows, but for the columns they are of
    weights[..., -1] += weights[..., :-1] @ shift
    weights[..., :-1] *= factor
    to = np.eye(d)
    to[:-1] /= factor[:, None]
    to[:-1, -1] = -shift / factor
    seconds = np.einsum("ij,sajbk,lk->saibl", to, way.seconds.reshape(steps, c, d, c, d), to, optimize=True)
    return Way(weights, way.gradients @ to.T, seconds.reshape(steps, c * d, c * d))


def _way(gradients: np.ndarray, seconds: np.ndarray, around: np.ndarray, n: float, rate: float, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gradient of each step, the weights before it, and those after the last, by gradients and second derivatives ``around`` each step."""
    told, way, w = np.empty_like(around), np.empty_like(around), np.zeros(around.shape[1:])
    with np.errstate(all="ignore"):
        for k in range(len(around)):
            way[k] = w
            told[k] = gradients[k] + (seconds[k] @ (w - around[k]).ravel()).reshape(w.shape)
            w = stepped(w, told[k], n, rate, l2)
    return told, way, w


def stepped(w: np.ndarray, total: np.ndarray, n: float, rate: float = RATE, l2: float = L2) -> np.ndarray:
    """Weights after one full gradient step."""
    g = total / max(n, 1)
    g[:, :-1] += l2 * w[:, :-1] / (max(n, 1) if len(w) == 1 else 1)
    return w - rate * g


def train_private(rows: DataFrame, n_features: int, sigma: float, sampling: float, steps: int, clip: float = 1.0, rate: float = SGD_RATE, l2: float = SGD_L2, seed: int | None = None) -> np.ndarray:
    """Noisy gradient descent for two classes: each step takes every row with probability ``sampling``, independently, clips
    each row's gradient and adds Gaussian noise of sigma * clip to the sum. ``accounting.poisson_epsilon`` tells the budget
    that this keeps, and ``prv.sampled_gaussian`` a tighter one, where the number of rows counts as public and ``seed`` is None or secret. Returns (1, features + 1).
    """
    secret = np.random.SeedSequence(seed)
    rng, batches = np.random.default_rng(secret), int(secret.generate_state(1, np.uint64)[0])
    expected = rows.count() * sampling
    data, w = packed(rows), np.zeros((1, n_features + 1))
    for step in range(steps):
        total, _ = _sums(data, w, clip, sampling, step, batches)
        g = (total + rng.normal(0, sigma * clip, total.shape)) / max(expected, 1)
        g[:, :-1] += l2 * w[:, :-1]
        w = w - rate * g
    return w


def predicted(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """rows and yhat: 1 where the logistic score is at least one half, or the class with the greatest score."""
    each = [scalars.dot(F.col("x"), F.array(*[F.lit(float(v)) for v in w[:-1]])) + F.lit(float(w[-1])) for w in weights]
    if len(each) == 1:
        return rows.withColumn("yhat", (scalars.sigmoid(each[0]) >= 0.5).cast("int"))
    return rows.withColumn("_z", F.array(*each)).withColumn("yhat", (F.array_position("_z", F.array_max("_z")) - 1).cast("int")).drop("_z")


def perturbed(rows: DataFrame, scales: Sequence[float], mechanism: str, seed: int) -> DataFrame:
    """x with noise of each feature's scale (Laplace scale or Gaussian deviation), by a hash of the row's uniform."""
    made = []
    for j, s in enumerate(scales):
        u1, u2 = (noise.keyed_uniform(seed, f"{k}{j}", F.format_string("%.17f", F.col("u"))) for k in "ab")
        made.append(F.col("x")[j] + (noise.laplace(u1, F.lit(float(s))) if mechanism == "laplace" else noise.gaussian(u1, u2, F.lit(float(s)))))
    return runtime.materialize(rows.withColumn("x", F.array(*made)), "perturbed")


def laplace_scales(sensitivities: Sequence[float], budgets: Sequence[float]) -> list[float]:
    return [s / max(e, 1e-6) for s, e in zip(sensitivities, budgets, strict=True)]


def gaussian_scales(sensitivities: Sequence[float], budgets: Sequence[float], delta: float = noise.DELTA) -> list[float]:
    return [math.sqrt(2 * math.log(1.25 / delta)) * s / max(e, 1e-6) for s, e in zip(sensitivities, budgets, strict=True)]
