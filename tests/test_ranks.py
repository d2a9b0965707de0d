import math
import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import longform, metrics

SCHEMA = "g string, i int, x double, v long"


def test_running_sums_cut_heavy_slices(spark):
    r = random.Random(3)
    rows = [("a", i, 1 + r.random() * 2**-14, r.randint(0, 9)) for i in range(3000)] + [("b", i, r.choice([math.inf, -math.inf, 0.0, 5.5, -1e300]), 1) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    cut, sums = longform._sliced(df, ["g"], "x", "v", 40)
    assert cut.where("g = 'a'").groupBy("slice_").count().agg(F.max("count")).first()[0] <= 40
    assert sums.agg(F.sum("sum_")).first()[0] == sum(v for *_, v in rows)
    got = {(x.g, x.i): x.before for x in longform.running_sum(df, ["g"], "x", "v", "before", ["i"], rows=40).collect()}
    for g in "ab":
        before = 0
        for _, i, _, v in sorted((x for x in rows if x[0] == g), key=lambda x: (x[2], x[1])):
            assert got[g, i] == before
            before += v


def test_slices_rise_with_values(spark):
    values = [-math.inf, -1e308, -3.0, -1e-300, 0.0, 5e-324, 1.0, 1.0001, 1.9999, 2.0, 1e308, 1.7976931348623157e308, math.inf, math.nan]
    got = [x.s for x in spark.createDataFrame([(x,) for x in values], "x double").select(longform.slice_of(F.col("x")).alias("s")).collect()]
    assert got == sorted(got) and len(set(got)) == len(got) - 1  # 1.0 and 1.0001 share one; so may no others
    assert spark.createDataFrame([(None,)], "x double").select(longform.slice_of(F.col("x"))).first()[0] is None


def test_infinities(spark):
    long = spark.createDataFrame([("f", x) for x in (1.0, 2.0, math.inf, None, math.nan)], "feature string, x double")
    got = {r.share: r.value for r in longform.percentiles(long, [0.0, 0.5, 0.75, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.5: 2.0, 0.75: math.inf, 1.0: math.inf}
    wide = spark.createDataFrame([("1",), ("x",), ("Infinity",), (None,)], "a string")
    assert [r.x for r in longform.unpivot(wide, ["a"]).collect()] == [1.0, None, None, None]
    scores = spark.createDataFrame([(math.inf, 1), (-math.inf, 0), (0.0, 1), (0.0, 0), (-math.inf, 1)], "s double, y int")
    assert metrics.auc(scores, "s", F.col("y") == 1).first().auc == pytest.approx(4 / 6)


def signed_ranks(d):
    d = [x for x in d if x]
    sizes = sorted(map(abs, d))
    rank = {m: sizes.index(m) + (sizes.count(m) + 1) / 2 for m in set(sizes)}
    n, ties = len(d), sum(sizes.count(m) ** 3 - sizes.count(m) for m in set(sizes))
    plus, minus = (sum(rank[abs(x)] for x in d if x * s > 0) for s in (1, -1))
    z = (min(plus, minus) - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return n, plus, minus, z, 1.0 if n < 5 else math.erfc(abs(z) / math.sqrt(2))


def test_wilcoxon_with_ties(spark):
    r = random.Random(1)
    pairs = {g: [r.choice([-2.0, -1.0, 0.0, 1.0, 1.0, 3.0]) for _ in range(n)] for g, n in (("a", 3), ("b", 40), ("c", 400), ("d", 9))}
    pairs["e"] = [1.0] * 30
    rows = [(g, x + 7.0, 7.0) for g, ds in pairs.items() for x in ds] + [("b", None, 1.0), ("b", math.nan, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    got = {x.g: tuple(x)[1:] for x in metrics.wilcoxon(df, "a", "b", by=["g"]).collect()}
    for g, ds in pairs.items():
        assert got[g] == pytest.approx(signed_ranks(ds), abs=1e-6)
    with pytest.raises(ValueError):
        metrics.wilcoxon(df, "a", "b", ties="none")
