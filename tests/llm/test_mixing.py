import hashlib
import random
import re

import pytest

from tests.oracle import compare
from veilframe.llm import mixing, queries


def filled(sizes, weights, epochs):
    """Targets by clamping in rounds. sizes: in rank order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    capped = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = sum(sizes) - sum(epochs * sizes[i] for i in capped)
        level = left / sum(w[i] for i in free) if free else 0
        over = {i for i in free if level * w[i] > epochs * sizes[i]}
        if not over:
            return [epochs * sizes[i] if i in capped else level * w[i] for i in range(len(sizes))]
        capped |= over


def test_query_equals_sql(spark, sf_dir):
    assert compare(spark, queries.queries()["op7_mix_sources"], queries.SQL["op7_mix_sources"], sf_dir) > 0


@pytest.mark.parametrize("sizes", [[1, 1, 1, 1000], [5, 3, 9, 2, 700], [0, 10], [100], [10, 10, 10, 10], [1, 500, 2, 400, 3, 300]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = [r.target for r in mixing.targets(df, "source", "size").orderBy("source").collect()]
    assert got == pytest.approx(filled(sizes, mixing.WEIGHTS, mixing.EPOCHS))


def test_shares_come_near_their_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.takes(docs).collect()
    by = {}
    for r in rows:
        # takes has no source: its size and target tell them apart here
        s = by.setdefault((r.source_size, r.target), [0, 0])
        s[0] += r["size"] * r.repeats
        s[1] = max(s[1], r["size"])
        assert 0 <= r.repeats <= mixing.EPOCHS
    for (_, target), (taken, largest) in by.items():
        assert abs(taken - target) <= largest / 2 + 1e-6
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.takes(docs.repartition(5)).collect()))


def test_edges(spark):
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (2, None, "x", 2), (None, "one two three", None, 3), (4, "", "y", 4), (5, "w " * 100_000, "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = {(r.doc_id, r["size"]): r for r in mixing.takes(docs).collect()}
    assert {k[1] for k in got} == {2, 0, 3, 100_000}
    assert got[4, 0].target == 0 and got[4, 0].repeats == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = sum(r.repeats for r in mixing.takes(docs).collect())
    assert mixed.count() == want
    assert mixing.takes(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_words(spark):
    texts = ["a\x0bb c", "", " x ", "é\xa0b", None, "\x1ca"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.orderBy("i").select(mixing.n_words(df.t).alias("n")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def brute(rows, weights, epochs, seed):
    """(id, text, source, repeats) by ordering each source as a whole."""
    key = lambda r: hashlib.md5(f"{seed}|{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest()
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r) for r in rows if r[2] == s) for s in names]
    out = []
    for s, n, target in zip(names, sizes, filled(sizes, weights, epochs), strict=True):
        whole, start = (int(target // n) if n else 0), 0
        for r in sorted((r for r in rows if r[2] == s), key=key):
            out.append((*r, whole + (start + size(r) / 2 < target - whole * n)))
            start += size(r)
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_cuts_equal_whole_orders(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 3)
    monkeypatch.setattr(mixing, "SLICE_DIGITS", 1)
    r = random.Random(seed)
    rows = [(r.choice([None, i]), r.choice(["", None, "a", "a b c", "x " * r.randint(1, 30)]), r.choice(["p", "q", "q", None])) for i in range(150)]
    rows += [(9, "hot copy of four", "hot")] * 90 + [(10, "another", "hot")] * 5 + [(11, "only copies", "one")] * 40
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, source string, _mix_size int, _mix_cut string").repartition(4)
    want = brute(rows, (1, 2, 3), 3, 17)
    mixed = mixing.mix(df)
    made = mixed.collect()
    assert mixed.columns == df.columns and {(x[3], x[4]) for x in made} == {(1, "c")}
    assert sorted(((x[0], x[1], x[2]) for x in made), key=repr) == sorted(((a, b, c) for a, b, c, n in want for _ in range(n)), key=repr)
    got = sorted(((x.doc_id, x["size"], x.repeats) for x in mixing.takes(df).collect()), key=repr)
    assert got == sorted(((a, len((b or "").split()), n) for a, b, _, n in want), key=repr)
