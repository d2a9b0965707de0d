import random

import pytest

from tests.oracle import compare
from veilframe import runtime
from veilframe.llm import jaccard, queries


def brute(rows, width, percent):
    """component of each (id, text) by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = min(width, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    for i, (k, _) in enumerate(rows):
        for j in range(i):
            if k is not None and k == rows[j][0] and sets[i] and sets[j]:
                parent[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted(((k, len(sets[i]), least.get(top(i))) for i, (k, _) in enumerate(rows)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, component string")


def corpus(seed):
    """Clusters of edited copies, chains, shared passages, short texts and repeated rows."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = []
    passage = r.choices(words, k=30)
    for _ in range(6):
        base = r.choices(words, k=r.choice([8, 20, 60]))
        for _ in range(r.randint(1, 8)):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t + (passage if r.random() < 0.3 else [])))
    chain = r.choices(words, k=40)
    for _ in range(12):
        chain = chain[1:] + [r.choice(words)]
        texts.append(" ".join(chain))
    texts += [" ".join(r.choices("ab", k=r.randint(0, 9))) for _ in range(25)] + texts[:4]
    r.shuffle(texts)
    ids = r.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


def got(spark, rows, rule):
    return sorted((tuple(r) for r in jaccard.near_duplicates(frame(spark, rows), rule).collect()), key=str)


def test_query_equals_sql(spark, sf_dir):
    assert compare(spark, queries.queries()["op4_jaccard_join"], queries.SQL["op4_jaccard_join"], sf_dir) > 0


@pytest.mark.parametrize("seed, rule", [(1, jaccard.Rule(2, 60)), (3, jaccard.Rule(4, 85))])
def test_all_pairs(spark, seed, rule):
    rows = corpus(seed)
    assert got(spark, rows, rule) == brute(rows, *rule)


def test_equal_prefixes(spark):
    """With few words prefixes are often equal."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choices("abc", k=14))) for i in range(80)]
    assert got(spark, rows, jaccard.Rule(2, 60)) == brute(rows, 2, 60)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 0)
    rows = corpus(6)
    assert got(spark, rows, jaccard.Rule(3, 70)) == brute(rows, 3, 70)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One Two"), (5, "one  two"), (None, "one two"), (None, "alone here"), (None, None), (7, "same " * 3), (7, "same " * 3)]
    rows += [(8, " ".join(f"w{i}" for i in range(50_000))), (9, " ".join(f"w{i}" for i in range(49_000)))]
    assert got(spark, rows, jaccard.Rule(4, 85)) == brute(rows, 4, 85)
    assert jaccard.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    kept = jaccard.one_of_each(frame(spark, rows), jaccard.Rule(4, 85))
    assert kept.columns == ["doc_id", "text", "component"]
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "2", "3", "4", "7", "8", "None", "None"]


def test_repeated_ids_with_other_texts(spark):
    """Rows with one id are rows of their own, whichever text comes first."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda t: t + " more"
    rows = [(5, a), (5, b), (7, near(b)), (3, near(a)), (9, c), (9, ""), (None, near(c)), (None, b)]
    assert got(spark, rows, jaccard.Rule(4, 85)) == brute(rows, 4, 85)
    assert {k: c for k, _, c in got(spark, rows[:1] + rows[1:3], jaccard.Rule(4, 85))} == {5: 5, 7: 5}
    kept = sorted(jaccard.one_of_each(frame(spark, rows), jaccard.Rule(4, 85)).collect(), key=str)
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(3, near(a)), (5, b), (9, c), (9, "")])


def test_clashing_names(spark):
    names = ["doc_id", "text", "doc", "content", "n", "digest", "component", "doc_number", "text_hash", "c", "d", "many"]
    rows = [(i, f"one two three four five six {'seven' * (i // 2)}", *[str(i)] * 10) for i in range(4)]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    kept = jaccard.one_of_each(docs, jaccard.Rule(4, 85))
    assert kept.columns == names and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


@pytest.mark.parametrize("seed, rule", [(2, jaccard.Rule(1, 70)), (8, jaccard.Rule(2, 75))])
def test_members_of_groups_link_where_the_first_do_not(spark, seed, rule):
    """Few different shingles in prefixes: groups are large, and links between groups are often found only by expansion."""
    r = random.Random(seed)
    core = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(150):
        t = list(core)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(40)] = r.choice("xyz")
        rows.append((i, " ".join(t)))
    assert got(spark, rows, rule) == brute(rows, *rule)


def test_two_groups_of_near_copies_are_not_all_compared(spark, monkeypatch):
    """Two groups of 3000: with all pairs of a group or between groups there would be millions."""
    compared = []
    verified = jaccard._Join.verified
    monkeypatch.setattr(jaccard._Join, "verified", lambda self, pairs: (lambda out: (compared.append(out.count()), out)[1])(verified(self, pairs)))
    core = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*core[: 100 + i % 150], f"x{i}", *core[100 + i % 150 :]])) for i in range(3000)]
    rows += [(10_000 + i, " ".join([f"y{i}", *reversed(core)])) for i in range(3000)]
    found = jaccard.near_duplicates(frame(spark, rows), jaccard.Rule(4, 85)).collect()
    assert {r.component_id for r in found if r.doc_id < 10_000} == {0} and {r.component_id for r in found if r.doc_id >= 10_000} == {10_000}
    assert sum(compared) < 60_000


@pytest.mark.parametrize("few", [0, jaccard.FEW_BYTES])
def test_components_of_a_long_chain(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW_BYTES", few)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1000, 1001), (5, 5)], "a long, b long")
    with runtime.scratch(spark) as tables:
        found = {r.node: r.component for r in jaccard.components(edges, tables).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 1000: 1000, 1001: 1000}
