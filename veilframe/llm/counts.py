"""Token counts with a digest cache.

A text's count is stored under the digest of its normalised content and the digest of the tokenizer's
file. A run joins the digests of its documents to the stored counts, encodes only the distinct misses,
appends them to the cache and joins again. A new tokenizer version has another digest, so nothing
stored for an older one is used.

Normalised content: the model's own normalisation is the identity, so every other change of a text
(white space, case, Unicode form) could change its count; content is the text itself, null as empty.

Scale: digests are computed in the JVM, and the missing ones are found before any text moves. Where they are few enough to be
broadcast (``BROADCAST_ROWS``), only texts without a stored count are shuffled, by digest, behind a partial aggregation that
keeps one text a digest and task; where they are more, Spark joins and shuffles by digest. A first run has no join at all. The
other joins move digests, ids and counts; stored counts are dealt anew before the last join, so that Spark splits a digest that a
third of all rows share.
The cache is Parquet, partitioned by tokenizer digest, appended through Spark's commit protocol; a row
that a repeated run appends twice is read as one.

Defined results: null counts as the empty text (0 tokens); repeated rows each get their count; an empty
table gives an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import runtime

LIMIT = 4096
#: Digests of 32 bytes (16 MB in all) up to which they are broadcast.
BROADCAST_ROWS = 500_000
CACHE = "digest binary, n_tokens long, tokenizer string"


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def content(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(content(text), 256))


def _encoder(model: bytes, kind: str):
    """Batches of texts -> their token counts."""
    if kind == "model":
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(model)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in texts]


def _counter(sent, kind: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(sent.value, kind)
        for b in batches:
            found = [n for i in range(0, b.num_rows, 64) for n in encode(b["text"].slice(i, 64).to_pylist())]
            yield pa.RecordBatch.from_arrays([b["digest"], pa.array(found, pa.int64())], ["digest", "n_tokens"])

    return count


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """digest, n_tokens of one tokenizer version; none where the cache doesn't exist yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(cache)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def fill(docs: DataFrame, model: str, cache: str, text: str = "text") -> None:
    """Encode the distinct contents of ``docs`` that the cache lacks and append their counts."""
    spark, version = docs.sparkSession, tokenizer_digest(model)
    texts = docs.select(digest(F.col(f"`{text}`")).alias("digest"), content(F.col(f"`{text}`")).alias("text"))
    known = stored(spark, cache, version)
    if known is not None:
        missing = runtime.materialize(texts.select("digest").distinct().join(known.select("digest"), "digest", "left_anti"), "missing")
        few = missing.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        texts = texts.join(F.broadcast(missing) if few else missing, "digest", "left_semi")
    misses = texts.groupBy("digest").agg(F.first("text").alias("text"))
    sent = spark.sparkContext.broadcast(Path(model).read_bytes())
    found = misses.mapInArrow(_counter(sent, Path(model).suffix.lstrip(".")), "digest binary, n_tokens long")
    found.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)


def count_tokens(docs: DataFrame, model: str, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens: one row per document; the cache holds every content of ``docs`` afterwards."""
    fill(docs, model, cache, text)
    whole = content(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{key}`"), F.octet_length(whole).cast("long").alias("n_bytes"), digest(F.col(f"`{text}`")).alias("digest"))
    known = runtime.dealt_anew(stored(docs.sparkSession, cache, tokenizer_digest(model)), "digest")
    return rows.join(known, "digest").select(key, "n_bytes", "n_tokens")
