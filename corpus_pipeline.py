"""The corpus pipeline: documents in, token ids of a clean, deduplicated, pseudonymised mix out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared
folder and rereads it as the next stage's docs. All stages but the last return the columns of documents.

1. quality: documents that the current policy of the quality ledger rejects go.
2. near_duplicates: of each group of near duplicates (five-word shingles, similarity 0.8 or more, linked in
   chains) the document with the smallest id stays.
3. pii: personal values are replaced by format-preserving pseudonyms; n_chars follows the text.
4. mix: sources are brought to their target weights; a document is repeated as often as the mix takes it.
5. bpe: every text becomes token ids; the result has one row for each row of the mix.

Nulls, empty and repeated rows and empty tables: as the operators' docstrings define. A null text has no
words, so the first stage rejects it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import runtime
from veilframe.llm import bpe, jaccard, mixing, pii, quality

NEAR = jaccard.Rule(width=5, percent=80)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runtime.ship(spark)
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runtime.ship(spark)
    return jaccard.one_of_each(docs, NEAR)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runtime.ship(spark)
    made = pii.pseudonymise(docs, pii.EXAMPLE_KEY)
    n_chars = F.when(F.size(made.columns[-1]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return made.withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runtime.ship(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, as the query of the operator has them."""
    runtime.ship(spark)
    rows = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: The keyed permutations and the tokenizer have no SQL form; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = runtime.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
