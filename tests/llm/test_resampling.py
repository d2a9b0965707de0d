import hashlib
import math
import random
import re
import zlib

import pytest

from tests.oracle import compare
from veilframe.llm import queries, resampling


def brute(rows, target, rule):
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def buckets(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % rule.buckets for k in range(1, rule.ngrams + 1) for i in range(len(w) - k + 1)]

    s, t = [0] * rule.buckets, [0] * rule.buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for b in buckets(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + rule.buckets) / ((a + 1) * (sum(t) + rule.buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for key, text in rows:
        found = buckets(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{rule.seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= rule.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    drawn = [(*r, i + 1) for i, r in enumerate(fit[: rule.percent * len(fit) // 100])]
    rest = list(out)
    for r in drawn:
        rest.remove(r[:5])
    return sorted(drawn + [(*r, None) for r in rest], key=repr)


def test_query_equals_sql(spark, sf_dir):
    assert compare(spark, queries.queries()["op13_resampling"], queries.SQL["op13_resampling"], sf_dir) > 0


def made(n, seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcXYZ019éß中", k=r.randint(1, 6))) for _ in range(60)]
    text = lambda: r.choice([" ", "--", "\n\t"]).join(r.choices(vocabulary, k=r.choice([0, 1, 2, 3, 30])))
    return [(r.choice([None, 7, 7, i]), r.choice([None, "", text(), text(), text()])) for i in range(n)], [text() for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("rule", [resampling.Rule(), resampling.Rule(3, 50, 1, 2, 37), resampling.Rule(2, 7, 9, 0, 100), resampling.Rule(percent=0)])
def test_against_brute_force(spark, monkeypatch, rule):
    monkeypatch.setattr(resampling, "SLICE", 16)
    rows, target = made(300, rule.ngrams)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, weight long, score string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, aim, rule)
    want = brute(rows, target, rule)
    assert sorted((tuple(r) for r in got.rows.collect()), key=repr) == want
    whole = [tuple(r) for r in resampling.draw(df, aim, rule).collect()]
    drawn = [r[0] for r in want if r[5] is not None]
    assert resampling.draw(df, aim, rule).columns == df.columns and len(whole) >= len(drawn) and {r[0] for r in whole} == set(drawn)


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b " * 30)], "doc_id long, text string")
    assert resampling.resample(df.limit(0), df).rows.count() == 0 and resampling.draw(df.limit(0), df).count() == 0
    rule = resampling.Rule(percent=100)
    assert [tuple(r) for r in resampling.resample(df, df.limit(0), rule).rows.collect()] == brute([(1, "a b " * 30)], [], rule)
