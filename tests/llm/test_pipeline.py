import hashlib

import corpus_pipeline
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tests.llm.test_jaccard import brute as components
from tests.llm.test_mixing import filled
from veilframe import runtime
from veilframe.llm import mixing, pii, quality


def by_hand(rows):
    """The pipeline with plain Python: a list of (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    kept = []
    for r in rows:
        m = dict(zip(quality.MEASURES, quality.measure(r["text"]), strict=True))
        if not any(eval(condition, {}, m) for name, condition in quality.RULES if name in quality.POLICIES[quality.CURRENT]):  # noqa: S307
            kept.append(r)
    first = {k for k, _, c in components([(r["doc_id"], r["text"]) for r in kept], *corpus_pipeline.NEAR) if k == c}
    kept = [r | {"text": pii.replace(r["text"], pii.Permutation(pii.EXAMPLE_KEY))[0]} for r in kept if r["doc_id"] in first]
    names = sorted({r["source"] for r in kept})
    size = lambda r: len((r["text"] or "").encode().split())
    sizes = [sum(size(r) for r in kept if r["source"] == s) for s in names]
    out, library = [], Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for s, n, target in zip(names, sizes, filled(sizes, mixing.WEIGHTS, mixing.EPOCHS), strict=True):
        mine = [(hashlib.md5(f"{mixing.SEED}|{r['doc_id']}|{r['text']}".encode()).hexdigest(), r) for r in kept if r["source"] == s]
        whole, before = int(target / n) if n else 0, 0
        for _, r in sorted(mine, key=lambda x: x[0]):
            repeats = whole + (before + size(r) / 2 < target - whole * n)
            before += size(r)
            ids = library.encode(r["text"], add_special_tokens=False).ids
            row = (r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
            out += [row] * repeats
    return sorted(out)


def test_run_equals_brute_force(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert got and got == by_hand(rows)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = runtime.materialize(stage(spark, docs, sf_dir), name)
        assert out.dtypes == docs.dtypes, name
        docs = out
    assert docs.count() > 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3 + [(1, "", "en", "s", 0), (2, "word " * 30, "en", None, 5)]])
def test_edges(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = runtime.materialize(stage(spark, docs, str(tmp_path)), "edge")
    assert docs.count() <= 3
