import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veilframe import runtime
from veilframe.llm import counts, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    p = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return lambda text: len(p.encode(text or ""))


def test_query_equals_library(spark, sf_dir, library):
    rows = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    got = queries.queries()["op5_token_counts"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == library(rows[r.doc_id])
        assert r.n_bytes == len((rows[r.doc_id] or "").encode())
        assert r.over_limit == (r.n_tokens > 4096)


def test_hits_and_misses_of_one_cache(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fresh = counts.count_tokens(docs, MODEL, runtime.scratch_path(spark, "test-counts"))
    expected = sorted(map(tuple, fresh.collect()))
    assert sorted(map(tuple, queries.queries()["counts_from_cache"](spark, sf_dir).collect())) == expected
    monkeypatch.setattr(counts, "BROADCAST_ROWS", 0)  # and where the misses are joined, not broadcast
    assert sorted(map(tuple, queries.queries()["counts_from_cache"](spark, sf_dir).collect())) == expected


def test_edges_and_cache(spark, library):
    texts = [None, "", "a  b <s> </s> ▁x \n\t é 🙂", "same", "same", "long " * 40_000]
    docs = spark.createDataFrame([(i if i else None, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, digest int")
    cache = runtime.scratch_path(spark, "test-counts")
    for _ in range(2):
        got = {r.doc_id or 0: r.n_tokens for r in counts.count_tokens(docs, MODEL, cache).collect()}
        assert got == {i: library(x) for i, x in enumerate(texts)}
        assert spark.read.parquet(cache).count() == 4  # null and empty are one, so are the two equal texts
    more = docs.union(spark.createDataFrame([(9, "new text", 1)], docs.schema))
    assert counts.count_tokens(more, MODEL, cache).count() == 7
    assert spark.read.parquet(cache).count() == 5
    assert counts.count_tokens(docs.limit(0), MODEL, runtime.scratch_path(spark, "none")).count() == 0


def test_versions_dont_mix(spark):
    other = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "It's one text"), (2, "")], "doc_id long, text string")
    cache = runtime.scratch_path(spark, "test-counts")
    counts.count_tokens(docs, MODEL, cache).collect()
    got = {r.doc_id: r.n_tokens for r in counts.count_tokens(docs, other, cache).collect()}
    assert got == {1: len(Tokenizer.from_file(other).encode("It's one text", add_special_tokens=False).ids), 2: 0}
