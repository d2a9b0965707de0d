import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from veilframe.llm import queries, rolling, suffix


def brute(rows, length):
    """(id, n_bytes, kept, spans) of each (id, text), window by window. Null ids are one id after all others."""
    order = lambda k: (1 << 63) - 1 if k is None else k
    first = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(order(k), first.get(w, order(k)))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < order(k):
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        n = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((str(k), len(b), kept, n))
    return sorted(out)


def got(df):
    rows = df.collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_bytes - len(r.kept)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    return sorted((str(r.doc_id), r.n_bytes, bytes(r.kept), len(r.spans)) for r in rows)


def corpus(seed, n=60):
    """Texts over a few letters with pasted stretches of earlier ones, of lengths around the limit."""
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        t = "".join(r.choices("abcdeé ", k=r.randint(0, 150)))
        for _ in range(r.randint(0, 3)):
            if texts:
                s = r.choice(texts)
                at = r.randint(0, max(0, len(s) - 1))
                t += s[at : at + r.choice([40, 49, 50, 51, 60, 100])] + "".join(r.choices("xyz", k=r.randint(0, 3)))
        texts.append(t + ("z" * r.randint(0, 130) if r.random() < 0.2 else ""))
    ids = r.sample(range(10 * n), n)
    return list(zip(ids, texts, strict=True))


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    found = {r.doc_id: r for r in queries.queries()["op6_suffix_dedup"](spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for k, n, kept, spans in brute(rows, 50):
        r = found[int(k)]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed, block, piece", [(1, 8 << 20, 1 << 20), (2, 300, 1 << 20), (3, 1000, 70), (4, 1, 7)])
def test_small_blocks_and_pieces(spark, monkeypatch, seed, block, piece):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix, "PIECE_BYTES", piece)
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, spans int")
    assert got(suffix.remove_matches(df)) == brute(rows, 50)


def test_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 200)
    long = "".join(random.Random(9).choices("abcdefgh", k=90))
    rows = [(5, long), (5, long), (5, "q" + long), (None, long), (None, long + "r"), (7, None), (8, ""), (9, long[:49]), (10, long[3:53]), (1, "zz" + long[20:80])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffix.remove_matches(df)) == brute(rows, 50)
    only = spark.createDataFrame([(None, long)] * 9, "doc_id long, text string")
    assert got(suffix.remove_matches(only)) == brute([(None, long)] * 9, 50)
    assert suffix.remove_matches(df.limit(0)).count() == 0


def test_one_id_over_several_blocks(spark):
    r = np.random.default_rng(11)  # real sizes: workers import BLOCK_BYTES anew
    texts = [r.integers(97, 117, suffix.BLOCK_BYTES // 2 + 10_000, np.uint8).tobytes().decode() for _ in range(3)]
    rows = [(5, t) for t in texts] + [(6, "".join(t[1000:9000] for t in texts)), (7, "q" + texts[0][:500])]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one task, so that other ids can follow in a block
    try:
        found = suffix.remove_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert sorted((x.doc_id, bytes(x.kept)) for x in found if x.doc_id > 5) == [(6, b""), (7, b"q")]
    assert sorted(bytes(x.kept) for x in found if x.doc_id == 5) == sorted(t.encode() for t in texts)


def test_long_text(spark):
    r = random.Random(4)
    base = "".join(r.choices("abcdefgh ", k=400_000))
    rows = [(2, base + base[:1000]), (1, base[100_000:100_300]), (3, "x" + base[7:399_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffix.remove_matches(df)) == brute(rows, 50)


def test_a_passage_of_many_documents_makes_no_bucket_large(spark):
    """At the ends of a shared passage the gram is the same and the content another in each document."""
    r = np.random.default_rng(3)
    passage = r.integers(97, 123, 200, np.uint8).tobytes()
    rows = [(i, (r.integers(97, 123, 300, np.uint8).tobytes() + passage + r.integers(97, 123, 300, np.uint8).tobytes()).decode()) for i in range(1500)]
    texts = [t.encode() for _, t in rows]
    block = suffix.Block([k for k, _ in rows], [len(t) for t in texts], b"".join(texts), suffix.LENGTH, suffix.GRAM, rolling.Powers())
    g, c, _ = suffix._entries(suffix.Units(block))
    counts = np.bincount(suffix._dealt(np.sort(suffix._joint(g, c)), 64, 64))
    assert np.unique(g, return_counts=True)[1].max() > 1000 and counts.max() < 1.5 * counts.mean()
    df = spark.createDataFrame(rows[:300], "doc_id long, text string")
    assert got(suffix.remove_matches(df)) == brute(rows[:300], 50)


def test_buckets_keep_the_order_of_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 10_000, np.uint64))
    for buckets in (1, 64, 1 << 17, 1 << 31):
        for k, bits in ((keys, 48), (keys << np.uint64(16), 64)):
            dealt = suffix._dealt(k, bits, buckets)
            assert (np.diff(dealt) >= 0).all() and 0 <= dealt.min() and dealt.max() < buckets


def test_levels_merge_geometrically():
    family = suffix.Family()
    for i in range(33):
        family.scan(np.array([2 * i, 2 * i + 1], np.uint64), i, i)
    family.scan(np.array([999], np.uint64), 99, 99)
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == 66 and len(sizes) <= 6 and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert family.known(np.array([0, 65, 66], np.uint64)).tolist() == [True, True, False]
