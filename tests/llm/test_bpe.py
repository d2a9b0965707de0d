import hashlib

import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from veilframe.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_query_equals_library(spark, sf_dir):
    t = library()
    rows = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    got = queries.queries()["op3_bpe_roundtrip"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = t.encode(rows[r.doc_id], add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edges(spark, monkeypatch):
    t = library()
    texts = [None, "", "  \n ", "Ünïcode’s ΣΑΣ — it's <|endoftext|>x<|startoftext|><|ENDOFTEXT|>", "İ ﬁ é Å 漢字かな 🙂🙂 \x1c\x85\xa0z 3½²", "'S'T'll" * 9]
    texts += ["word " * 50_000 + "x" * 5_000, "same", "same"]
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 40)
    docs = spark.createDataFrame([(None if i == 3 else i, x, "k") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    got = {(r.doc_id if r.doc_id is not None else 3): r for r in bpe.encode(docs, PATH).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].ids == ids, i
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_settled_characters_split_alike():
    words, t = bpe.Words(open(PATH).read()), library()
    for c in bpe._SETTLED:
        for text in (f"A{c}b1{c}{c}!", f"{c}'s {c}", f"1{c}'ll"):
            want = [w for w, _ in t.pre_tokenizer[0].pre_tokenize_str(t.normalizer.normalize_str(text))]
            assert words._plain(text) == want, hex(ord(c))
