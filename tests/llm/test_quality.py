from collections import Counter

from tests.oracle import compare
from veilframe.llm import quality, queries


def brute(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(hit)


def test_query_equals_sql(spark, sf_dir):
    assert compare(spark, queries.op8_quality_ledger, queries.SQL["op8_quality_ledger"], sf_dir) > 0


def test_edges(spark):
    texts = [None, "", "a " * 30, "é b\x0bc", "x y z\nx y z\n\nq", " ".join(f"w{i % 9}" for i in range(40)), "a" * 200_000]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(5, texts[5], "z")], "doc_id long, text string, n_words string")
    got = quality.ledger(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_words, r.word_chars, r.n_repeat_words) == brute(texts[r.doc_id])
    assert quality.ledger(docs.limit(0)).count() == 0
    assert quality.keep(docs).columns == docs.columns


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "word " + "other thing " * 2, "kept"), (2, " ".join(f"w{i}" for i in range(40)), "kept")], "doc_id long, text string, quality string")
    docs = docs.selectExpr("*", "quality as _quality", "quality as quality_", "quality as fail_bits", "1 as n_words")
    (row,) = quality.keep(docs).collect()
    assert row.asDict() == {"doc_id": 2, "text": " ".join(f"w{i}" for i in range(40)), **dict.fromkeys(("quality", "_quality", "quality_", "fail_bits"), "kept"), "n_words": 1}


def test_stored_ledger_equals_sql(spark, sf_dir):
    assert compare(spark, queries.queries()["ledger_ablations"], queries.SQL["ledger_ablations"], sf_dir) == len(quality.POLICIES[quality.CURRENT])


def test_policies_and_ablations(spark, sf_dir):
    rows = quality.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).cache()
    n, kept = rows.count(), rows.where(quality.kept(rows.fail_bits)).count()
    for r in quality.ablations(rows).collect():
        without = quality.mask("v2") & ~quality.BIT[r.rule]
        assert r.n_kept_without == rows.where(rows.fail_bits.bitwiseAND(without) == 0).count()
        assert kept <= r.n_kept_without <= n
    rows.unpersist()
