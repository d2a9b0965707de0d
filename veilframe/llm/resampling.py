"""Importance resampling towards a target distribution over hashed n-grams.

Every feature (run of 1 to ``ngrams`` words) falls into one of ``buckets`` buckets. A bucket's gain tells how much likelier the
target has it than the source, a document's weight is the mean gain of its features, and documents are drawn without
replacement with chances that follow exp(weight / 1000): a keyed Gumbel variable, made from a hash of the document's
id, is added to the weight and the highest scores are drawn, so reruns agree.

Two passes over Arrow batches. In the first, each task counts its features by ``np.bincount`` into one vector a partition,
and ``treeReduce`` merges the vectors; in the second the gains (one vector of ``buckets`` integers) are broadcast and a
document's gains are gathered and summed by ``np.bincount`` with weights.

Scale: no text is shuffled. The tree is as deep as it takes that no task or driver merges more than ``FAN_IN`` vectors or so. The
least drawn score is found from counts by score, first in steps of 256 scores and then in one step; scores lie within about
64,000 of zero whatever the input, so both lists are short. Only rows from there up are ordered: by a range
shuffle, with a number within each part and the parts' sizes in front of it. A last key of the order is the row's
place in its task, so an id that many rows share is split too.

Defined results: a null text has no words; no features give weight 0. A null id hashes as ``<seed>:`` and comes after all others
among equal scores; repeated rows are documents of their own. An empty table of documents gives an empty result; an
empty target leaves t = T = 0. Columns that are not named aren't read, but ``draw`` returns them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe import runtime

SLICE = 4 << 20
FAN_IN = 32
#: Bytes of words stay, capitals become small, all others separate words. Bytes from 0x80 on belong to characters beyond ASCII.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Rule(NamedTuple):
    ngrams: int = 1
    buckets: int = 10000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10


def features(text: bytes, rule: Rule) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets of a text's features and the number of its words, a slice of the text at a time."""
    text = text.translate(_WORDS)
    carry: list[bytes] = []
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        new = text[at:end].split()
        words = carry + new
        found = [new] + [[b" ".join(words[i : i + k]) for i in range(max(0, len(carry) - k + 1), len(words) - k + 1)] for k in range(2, rule.ngrams + 1)]
        yield np.concatenate([np.fromiter(map(zlib.crc32, f), np.int64, len(f)) for f in found]) % rule.buckets, len(new)
        carry = words[len(words) - rule.ngrams + 1 :] if rule.ngrams > 1 else []
        at = end


def _texts(column: pa.Array, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of a batch, which row each belongs to, and words a row."""
    found, owners, words = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.zeros(len(column), np.int64)
    for i, text in enumerate(column):
        for buckets, n in features(text.as_py() or b"", rule):
            found.append(buckets)
            owners.append(np.full(len(buckets), i))
            words[i] += n
    return np.concatenate(found), np.concatenate(owners), words


def _counter(rule: Rule):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rule.buckets, np.int64)
        for b in batches:
            total += np.bincount(_texts(b.column(0), rule)[0], minlength=rule.buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    return count


def bucket_counts(docs: DataFrame, rule: Rule, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket."""
    parts = docs.select(F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(_counter(rule), "counts binary").rdd
    n = parts.getNumPartitions()
    if not n:
        return np.zeros(rule.buckets, np.int64)
    return parts.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add, depth=max(2, math.ceil(math.log(n, FAN_IN))))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What each bucket adds to a weight, with one feature more in every bucket of both."""
    all_source, all_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


NEW = ("n_words", "n_features", "weight", "place")


def _weigher(sent, rule: Rule, names: list[str]):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, place = sent.value.astype(np.float64), 0
        for b in batches:
            buckets, owners, words = _texts(b.column(b.num_columns - 1), rule)
            n = np.bincount(owners, minlength=b.num_rows)
            sums = np.bincount(owners, weights=gain[buckets], minlength=b.num_rows).astype(np.int64)
            new = (words, n, sums // np.maximum(n, 1), np.arange(place, place + b.num_rows))
            place += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(x, pa.int64()) for x in new]], [*b.schema.names[:-1], *names])

    return weigh


def gumbel(key: Column, rule: Rule) -> Column:
    """floor(-1000 ln(-ln u)) with u from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def weighed(docs: DataFrame, gain: np.ndarray, rule: Rule, names: list[str], keep: list[str], key: str, text: str) -> DataFrame:
    """Columns ``keep`` of the documents with those of ``NEW`` and ``score`` under ``names``."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias(runtime.free_name(docs, "bytes")))
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, T.LongType()) for n in names[:-1]]])
    made = rows.mapInArrow(_weigher(docs.sparkSession.sparkContext.broadcast(gain), rule, names[:-1]), schema)
    return made.withColumn(names[-1], F.col(f"`{names[2]}`") + gumbel(F.col(f"`{key}`"), rule))


class Drawn(NamedTuple):
    """key, n_words, n_features, weight, score, rank of every document; the gains; and the last drawn (score, key), if any is drawn."""

    rows: DataFrame
    gain: np.ndarray
    last: tuple | None


def _least_score(rows: DataFrame, rule: Rule) -> tuple[int, int | None]:
    """How many documents are drawn, and the least score among them."""
    fit = rows.where(F.col("n_words") >= rule.least_words)

    def descend(step: Column, within: DataFrame, want: int | None, above: int) -> tuple[int, int | None, int]:
        counts = sorted(within.groupBy(step.alias("s")).count().collect(), reverse=True)
        want = rule.percent * sum(r["count"] for r in counts) // 100 if want is None else want
        for r in counts if want else ():
            if above + r["count"] >= want:
                return want, r["s"], above
            above += r["count"]
        return 0, None, 0

    coarse = F.shiftright("score", 8)
    want, step, above = descend(coarse, fit, None, 0)
    if not want:
        return 0, None
    return want, descend(F.col("score"), fit.where(coarse == step), want, above)[1]


def resample(docs: DataFrame, target: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", target_text: str = "text") -> Drawn:
    """Weigh every document against ``target`` and rank the drawn ones (rank null: not drawn)."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, rule, text), bucket_counts(target, rule, target_text))
    thin = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = runtime.materialize(weighed(thin, gain, rule, [*NEW, "score"], ["key"], "key", "text"), "weights")
    want, least = _least_score(rows, rule)
    out = [F.col("key").alias(key), "n_words", "n_features", "weight", "score"]
    if not want:
        return Drawn(rows.select(*out, F.lit(None).cast("long").alias("rank")), gain, None)
    high = (F.col("n_words") >= rule.least_words) & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("weight"), F.asc("n_features"), F.asc("place")]
    ordered = rows.where(high).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = runtime.materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part, before, firsts = F.shiftright("at", 33), 0, []
    for r in sorted(ordered.groupBy(part.alias("part")).count().collect()):
        firsts.append((r.part, before))
        before += r["count"]
    starts = spark.createDataFrame(firsts, "part long, start long")
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ordered.join(F.broadcast(starts), part == F.col("part")).withColumn("rank", F.when(rank <= want, rank))
    rest = rows.where(~high).select(*out, F.lit(None).cast("long").alias("rank"))
    last = ranked.where(F.col("rank") == want).select("score", "key").first()
    return Drawn(ranked.select(*out, "rank").unionByName(rest), gain, tuple(last))


def draw(docs: DataFrame, target: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """The drawn documents with all their columns, without a shuffle of texts. Rows that repeat the last drawn id with an equal score are drawn with it."""
    made = resample(docs, target, rule, key, text, target_text)
    if made.last is None:
        return docs.limit(0)
    names = [runtime.free_name(docs, n) for n in (*NEW, "score")]
    score, words, (least, last) = F.col(f"`{names[-1]}`"), F.col(f"`{names[0]}`"), made.last
    ties = score >= least if last is None else (score > least) | ((score == least) & (F.col(f"`{key}`") <= F.lit(last)))
    rows = weighed(docs, made.gain, rule, names, docs.columns, key, text).where((words >= rule.least_words) & ties)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
