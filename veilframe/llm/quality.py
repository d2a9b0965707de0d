"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its measurements and one failure bit a
rule. Policies are masks over those bits, so a new policy version, or an ablation that asks what each
rule alone removes, is bitwise arithmetic over the ledger and never reads a text again.

Defined results: a null text counts as empty (every count 0, so the rule on too few words fails); an
empty table gives an empty ledger; repeated rows get one ledger row each; columns of the input other
than the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe import runtime

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter", "n_shouts")

#: Rule name -> condition over the measurements under which a document fails it; the bit is the place in this list.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("stutter", "100 * n_stutter > 30 * n_words"),
    ("shouting", "4 * n_shouts > n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Policy version -> names of the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length"),
    "v2": tuple(name for name, _ in RULES),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _in_repeated_windows(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found at least twice; exact, by doubling ranks of windows."""
    n = len(words)
    if n <= size:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    width = 1
    while width < size:
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        distinct, rank = np.unique(pair, return_inverse=True)
        if len(distinct) == len(pair):
            return 0
        width *= 2
    repeated = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[: len(repeated)] += repeated
    edge[size : size + len(repeated)] -= repeated
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at x20 and x09-x0D exactly
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - len(raw) + sum(map(len, words)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _in_repeated_windows(words),
        sum(a == b for a, b in zip(words, words[1:], strict=False)),
        raw.count(b"!"),
    )


_STRUCT = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


@F.arrow_udf(_STRUCT)
def _measures(texts: pa.Array) -> pa.Array:
    rows = np.array([measure(t.as_py()) for t in texts], np.int64).reshape(-1, len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(MEASURES))], list(MEASURES))


def fail_bits(measures: str) -> Column:
    """Failure bits from a struct column of measurements."""
    bits = F.lit(0).cast("bigint")
    for name, condition in RULES:
        for m in MEASURES:
            condition = condition.replace(m, f"{measures}.{m}")
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)))
    return bits


def with_ledger(docs: DataFrame, text: str = "text", into: str = "_quality") -> DataFrame:
    """``docs`` with a struct column of measurements and ``fail_bits``; the rules run once, whatever reads the column."""
    return docs.withColumn(into, _measures.asNondeterministic()(F.col(f"`{text}`"))).withColumn(
        into, F.struct(*[F.col(f"{into}.{m}") for m in MEASURES], fail_bits(into).alias("fail_bits"))
    )


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, measurements, fail_bits: one row per document."""
    return with_ledger(docs.select(key, text), text).select(key, "_quality.*")


def kept(bits: Column, policy: str = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy))) == 0


def keep(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents that pass a policy, with the columns of the input."""
    into = runtime.free_name(docs, "quality")
    return with_ledger(docs, text, into).where(kept(F.col(f"{into}.fail_bits"), policy)).select(*[F.col(f"`{c}`") for c in docs.columns])


def ablations(ledger_rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents it fails, documents that it alone rejects, and those kept without it. One pass."""
    m = mask(policy)
    own = F.col("fail_bits").bitwiseAND(F.lit(m))
    counts = [F.count("*").alias("n_docs"), F.sum((own == 0).cast("long")).alias("n_kept")]
    for name in POLICIES[policy]:
        counts.append(F.sum((own.bitwiseAND(F.lit(BIT[name])) != 0).cast("long")).alias(f"fails_{name}"))
        counts.append(F.sum((own == BIT[name]).cast("long")).alias(f"only_{name}"))
    one = ledger_rows.agg(*counts)
    rows = [
        F.struct(
            F.lit(name).alias("rule"),
            F.coalesce(F.col(f"fails_{name}"), F.lit(0)).alias("n_failed"),
            F.coalesce(F.col(f"only_{name}"), F.lit(0)).alias("n_failed_alone"),
            F.coalesce(F.col("n_kept") + F.col(f"only_{name}"), F.lit(0)).alias("n_kept_without"),
        )
        for name in POLICIES[policy]
    ]
    return one.select(F.inline(F.array(*rows)))
