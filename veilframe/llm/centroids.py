"""Centroid clustering (Lloyd's rounds over integers) with block-norm screening.

Vectors become integers, floor(scale * x). Each is cut into ``SEGMENTS`` segments, and the norms of its segments are
computed once and stored beside it: its compressed form. By Cauchy-Schwarz,

    |v - c|^2 >= sum over segments of (|v_s| - |c_s|)^2,

so compressed vectors and compressed centroids give a lower bound of every distance. The centroid with the least bound gets its
exact integer distance first; of the others only those whose bound doesn't exceed it do. Bounds are lowered by more
than floats can err, so nothing is excluded that could win or tie, and results are those of comparing all.

Scale: a round is one scan of the stored vectors against a broadcast of k centroids (k x dims integers, a fixed size). Each
task sums its vectors by cluster, so what is shuffled is k x dims rows a task, dealt by (cluster, component), however
many vectors a cluster has; what comes back to the driver is the new centroids. Vectors are never shuffled.

Defined results: a vector that is null, has another number of components than ``dims``, or holds null, NaN or infinite
components takes no part. A null id is an id like others, but is chosen as a first centroid only after all others; equal ids
are ordered by their vectors there, and repeated rows are vectors of their own. Fewer vectors than k give fewer clusters; an
empty table gives an empty result. Integers and distances saturate at the range of long; sums are exact. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe import runtime

K = 40
ROUNDS = 5
SEED = 2
DIMS = 64
SCALE = 256.0
SEGMENTS = 16
BLOCK = 4096
LONG_MAX = (1 << 63) - 1
#: Integers up to this are compared in 64 bits: (2 * SMALL)^2 * dims stays below 2^62 up to 2^14 components.
SMALL = 1 << 23


class Clustering(NamedTuple):
    """Rows <key>, cluster int, distance long (squared), and the final centroids by number."""

    rows: DataFrame
    centroids: list[list[int]]


def quantized(vectors: DataFrame, key: str, vector: str, dims: int, scale: float) -> DataFrame:
    """id, v array<bigint>: the vectors that take part."""
    x = F.col(f"`{vector}`")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(x.isNotNull() & (F.size(x) == dims) & fine)
    return rows.select(F.col(f"`{key}`").alias("id"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double"))).alias("v"))


def compressed(rows: np.ndarray) -> np.ndarray:
    """Norms of the segments of each row."""
    edges = np.unique(np.linspace(0, rows.shape[1], SEGMENTS + 1).astype(int))
    squares = rows.astype(np.float64) ** 2
    return np.sqrt(np.add.reduceat(squares, edges[:-1], axis=1)) if len(edges) > 1 else np.zeros((len(rows), 1))


def bounds(short: np.ndarray, short_centroids: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances from compressed forms, lowered by more than rounding takes."""
    a, b = (short**2).sum(axis=1)[:, None], (short_centroids**2).sum(axis=1)
    return a + b - 2 * (short @ short_centroids.T) - 1e-9 * (a + b)


def nearest(rows: np.ndarray, short: np.ndarray, centroids: np.ndarray, short_centroids: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray, int]:
    """The nearest centroid of each row (ties to the smaller number), its squared distance, and how many exact distances that took."""
    if max(int(np.abs(rows).max(initial=0)), int(np.abs(centroids).max(initial=0))) > SMALL or rows.min(initial=0) < -SMALL or centroids.min(initial=0) < -SMALL:
        return _nearest_large(rows, centroids)
    n, k = len(rows), len(centroids)
    low, each = bounds(short, short_centroids), np.arange(n)
    first = low.argmin(axis=1)
    distance = np.full((n, k), LONG_MAX)
    distance[each, first] = ((rows - centroids[first]) ** 2).sum(axis=1)
    alive = low <= distance[each, first][:, None]
    alive[each, first] = False
    r, c = np.nonzero(alive)
    for i in range(0, len(r), 16 * BLOCK):
        a, b = r[i : i + 16 * BLOCK], c[i : i + 16 * BLOCK]
        distance[a, b] = ((rows[a] - centroids[b]) ** 2).sum(axis=1)
    best = distance.argmin(axis=1)
    return best, distance[each, best], n + len(r)


def _nearest_large(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, list[int], int]:
    """Components so large that 64 bits could overflow: Python's integers."""
    wide, best, found = centroids.astype(object), [], []
    for row in rows.astype(object):
        distances = ((wide - row) ** 2).sum(axis=1) if wide.shape[1] else np.zeros(len(wide), object)
        best.append(int(np.argmin(distances)))
        found.append(min(distances[best[-1]], LONG_MAX))
    return np.array(best, np.int64), found, len(rows) * len(centroids)


def _matrix(lists: pa.ListArray, dims: int, kind: type) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(lists), dims)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in blocks of about ``BLOCK`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _compress(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = compressed(_matrix(b["v"], dims, np.int64))
            offsets = pa.array(np.arange(0, short.size + 1, short.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(short.ravel()))], ["id", "v", "short"])

    return run


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    """Blocks with their rows, nearest centroids and distances."""
    short_centroids = compressed(centroids)
    for t in _blocks(batches):
        rows = _matrix(t["v"].combine_chunks(), centroids.shape[1], np.int64)
        short = _matrix(t["short"].combine_chunks(), short_centroids.shape[1], np.float64)
        yield t, rows, *nearest(rows, short, centroids, short_centroids)


def _summer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        k, dims = centroids.shape
        totals, counts = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for _, rows, best, *_ in _assigned(batches, centroids):
            kind = np.int64 if np.abs(rows).max(initial=0) <= SMALL and rows.min(initial=0) >= -SMALL else object
            for c in np.unique(best):
                totals[c] += rows[best == c].astype(kind).sum(axis=0)
            counts += np.bincount(best, minlength=k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, dims), pa.int32()),
                pa.array(np.tile(np.arange(dims), len(used)), pa.int32()),
                pa.array([Decimal(int(x)) for x in totals[used].ravel()], pa.decimal128(38, 0)),
                pa.array(np.repeat(counts[used], dims), pa.int64()),
            ],
            ["cluster", "dim", "total", "n"],
        )

    return run


def _labeller(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, best, distance, _ in _assigned(batches, sent.value):
            yield pa.RecordBatch.from_arrays([t["id"].combine_chunks(), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    return run


def first_order(seed: int) -> Column:
    """Lowercase hex of sha256 of ``<seed>:<id>``."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: float = SCALE) -> Clustering:
    """Assign every vector to the nearest of k centroids after ``rounds`` rounds from the k vectors of lowest hash."""
    spark = vectors.sparkSession
    kept = quantized(vectors, key, vector, dims, scale)
    kind = kept.schema["id"].dataType
    schema = T.StructType([*kept.schema.fields, T.StructField("short", T.ArrayType(T.DoubleType()))])
    stored = runtime.materialize(kept.mapInArrow(_compress(dims), schema), "vectors")
    first = stored.orderBy(first_order(seed).asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), dims)
    if not len(centroids):
        return Clustering(stored.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [])
    for _ in range(rounds):
        sums = stored.mapInArrow(_summer(spark.sparkContext.broadcast(centroids)), "cluster int, dim int, total decimal(38,0), n long")
        for r in sums.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            centroids[r.cluster, r.dim] = int(r.total) // r.n
    labels = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    found = stored.mapInArrow(_labeller(spark.sparkContext.broadcast(centroids)), labels)
    return Clustering(found.withColumnRenamed("id", key), [[int(x) for x in c] for c in centroids])


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(made: Clustering, key: str = "vec_id") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = made.rows.sparkSession
    rows = runtime.materialize(made.rows, "clusters")
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(sums.values()), LONG_MAX)
    facts = [(c, min(s, LONG_MAX), total, centroid_digest(made.centroids[c])) for c, s in sums.items()]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
