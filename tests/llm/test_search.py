import math
import random

import pytest

from tests.oracle import compare
from veilframe.llm import queries, search


def brute(rows, asked, k):
    def ints(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [min(max(math.floor(256 * x), -(1 << 63)), (1 << 63) - 1) for x in v]

    known = [(i, ints(v)) for i, v in rows if i is not None and ints(v) is not None]
    mine = {}
    for i, v in known:
        if i in asked:
            mine[i] = min(v, mine.get(i, v))
    out = []
    for q, v in mine.items():
        scored = sorted((-max(min(sum(a * b for a, b in zip(v, c, strict=False)), (1 << 63) - 1), 1 - (1 << 63)), i) for i, c in known if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def got(spark, rows, asked, **more):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    out = search.top_k(df, df.where(df.vec_id.isin(list(asked))), **more)
    return sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect()))


def test_query_equals_sql(spark, sf_dir):
    assert compare(spark, queries.queries()["op2_topk_search"], queries.SQL["op2_topk_search"], sf_dir) > 0


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(search, "BLOCK", 40)
    r = random.Random(seed)
    base = [[r.gauss(0, 1) for _ in range(20)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in r.choice(base)]) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]  # equal vectors: ties
    asked = set(range(0, 300, 7))
    assert got(spark, rows, asked, chunk=10) == brute(rows, asked, 5)


def test_edges(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0]), (7, [3.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    assert got(spark, rows, {1, 2, 6, 7}) == brute(rows, {1, 2, 6, 7}, 5)
    large = [(1, [1e300, -1e300]), (2, [1e12, 1.0]), (3, [-1e300, 1.0]), (4, [1e9, 1e9])]
    assert got(spark, large, {1, 2, 4}) == brute(large, {1, 2, 4}, 5)
    assert got(spark, [(1, [1.0])], {1}) == []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(50, 37)), rng.normal(size=(60, 37))
    exact, last = a @ b.T, None
    for s in search.LEVELS:
        bound = search._statistics(a, s) @ search._statistics(b, s).T
        assert (bound >= exact - 1e-9).all() and (last is None or bound.sum() <= last)
        last = bound.sum()
