"""Exact top-k search by inner product, with multi-resolution segment statistics.

Vectors become integers, floor(scale * x). Squared distance and inner product determine each other
where both norms are known: 2 <q, c> = |q|^2 + |c|^2 - d^2. Cut into segments of length l, with mean m
and deviation s in each,

    d^2 >= sum over segments of l * ((m_q - m_c)^2 + (s_q - s_c)^2),

and the bound tightens as segments get shorter. Each candidate block is compared with a query at the
coarsest resolution first; what that bound can't exclude goes on to the next, and exact distances
are computed for the survivors only. A pair is excluded only where its bound is strictly worse than the
query's k-th best so far, so results are exact, ties included.

Scale: the stated queries are dealt into chunks of about ``chunk`` by a hash of their id, so a chunk
has a fixed size whatever the table holds; a chunk is broadcast and every candidate partition scans its
vectors block by block against it. Candidates aren't shuffled: only k rows per query and partition
are, then ranked.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do
rows with a null id. Shorter vectors count as padded with zeros. Candidate rows with the query's own id
are the query's own; other repeated rows are candidates of their own. A repeated query id is answered
once, for its smallest vector. Integers saturate at the range of long, and so do scores. Fewer than k
candidates give fewer rows; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe import runtime

K = 5
SCALE = 256.0
CHUNK = 4096
BLOCK = 4096
#: Numbers of segments, coarse to fine.
LEVELS = (1, 4, 16)
LONG = (-(1 << 63), (1 << 63) - 1)


def quantized(vectors: DataFrame, key: str, vector: str, scale: float = SCALE) -> DataFrame:
    """id, v array<bigint>: the rows that take part."""
    x = F.col(f"`{vector}`")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col(f"`{key}`").isNotNull() & x.isNotNull() & fine)
    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double"))).alias("v"))


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of int64, padded with zeros to ``dims`` at least."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = max(dims, int(lengths.max(initial=0)))
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(l) * mean and sqrt(l) * deviation of each segment: inner products of these bound the exact one from above."""
    edges = np.linspace(0, rows.shape[1], segments + 1).astype(int)
    parts = [rows[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
    root = [np.sqrt(p.shape[1]) for p in parts]
    return np.column_stack([f for r, p in zip(root, parts, strict=True) for f in (r * p.mean(axis=1), r * p.std(axis=1))] or [np.zeros(len(rows))])


def _exact_in_floats(a: np.ndarray, b: np.ndarray) -> bool:
    top = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    return top(a) * top(b) * max(a.shape[1], 1) < 1 << 52


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class _Scan:
    """The k best candidates of one partition for each query of a chunk."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        queries, width = self.queries, max(self.queries.shape[1], rows.shape[1])
        queries, rows = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, rows))
        if not _exact_in_floats(queries, rows):
            return self._add_large(ids, queries, rows)
        q, c = queries.astype(np.float64), rows.astype(np.float64)
        bounds = [(_statistics(q, s), _statistics(c, s)) for s in LEVELS]
        slack = 1 + 1e-9 * np.sqrt((q * q).sum(axis=1, initial=0).max(initial=0) * (c * c).sum(axis=1, initial=0).max(initial=0))
        coarse = bounds[0][0] @ bounds[0][1].T
        for i in range(len(q)):
            top_ids, top = self.best[i]
            alive = np.flatnonzero(ids != self.ids[i])
            if len(top) == self.k:
                least = top[-1] - slack
                alive = alive[coarse[i, alive] >= least]
                for qs, cs in bounds[1:]:
                    alive = alive[cs[alive] @ qs[i] >= least]
            if len(alive):
                scores = (c[alive] @ q[i]).astype(np.int64)
                self.best[i] = _best(np.concatenate([top_ids, ids[alive]]), np.concatenate([top, scores]), self.k)

    def _add_large(self, ids: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> None:
        """Components so large that floats would round: Python's integers."""
        wide = rows.astype(object)
        for i, q in enumerate(queries.astype(object)):
            alive = np.flatnonzero(ids != self.ids[i])
            scores = np.array([min(max(int(x), LONG[0] + 1), LONG[1]) for x in wide[alive] @ q] if wide.shape[1] else [0] * len(alive), np.int64)
            self.best[i] = _best(np.concatenate([self.best[i][0], ids[alive]]), np.concatenate([self.best[i][1], scores]), self.k)


def _scanner(chunk, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = chunk.value
        found, held = _Scan(ids, queries, k), []

        def flush() -> None:
            t = pa.Table.from_batches(held)
            found.add(t["id"].to_numpy(), _matrix(t["v"].combine_chunks(), queries.shape[1]))
            held.clear()

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BLOCK:
                flush()
        if held:
            flush()
        n = [len(x[0]) for x in found.best]
        cat = lambda j: np.concatenate([x[j] for x in found.best]) if found.best else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(cat(0)), pa.array(cat(1))], ["query_id", "id", "score"])

    return scan


def top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = SCALE, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, <key>, score: for each row of ``queries`` its k best rows of ``vectors`` by integer inner product."""
    spark = vectors.sparkSession
    candidates = runtime.materialize(quantized(vectors, key, vector, scale), "vectors")
    asked = runtime.materialize(quantized(queries, key, vector, scale).groupBy("id").agg(F.min("v").alias("v")), "queries")
    chunks = max(1, -(-asked.count() // chunk))
    parts = []
    for i in range(chunks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == i).toArrow()
        sent = spark.sparkContext.broadcast((rows["id"].to_numpy(), _matrix(rows["v"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int64())), 0)))
        found = candidates.mapInArrow(_scanner(sent, k), "query_id long, id long, score long")
        parts.append(runtime.materialize(_ranked(found, k), "found") if chunks > 1 else _ranked(found, k))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", "rank", F.col("id").alias(key), "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def every(column: str, n: int) -> Column:
    """The stated query set: ids divisible by n."""
    return F.col(column) % n == 0
