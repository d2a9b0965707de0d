"""N-gram Jaccard join by grouped prefixes, and the components of its links.

A document is the set of its distinct ``width``-word shingles, sorted by their hashes. Distinct sets are nodes,
however many documents have them.

1. Sets are signed: size, digest, and the slice of the shingles with the lowest hashes. Equal digests become one node.
2. Each shingle of the slice is found in one set or in several. A node of whose slice more is found nowhere else than a link
   allows to differ has no link and is done, as are most documents. Only for the others whole sets are made.
   Their shingles are counted, too, and ordered: those found in few sets before those found in many, ties by hash.
   Under one such order two sets that overlap enough share a shingle among the first few of each: its prefix. Shingles of one set
   only lead nowhere: they keep their places in prefixes, but no row.
3. Nodes with equal size and prefix collapse into one group. Its members are compared with the first of
   them; those that don't link to it become groups of their own.
4. Prefix shingles lead to buckets of groups. A pair of groups in a bucket counts if sizes and the places
   of the shingle allow enough overlap. The first members of the groups are verified.
5. Where those don't link, other members still may: 1 - similarity is a metric, so the distances between and
   inside both groups tell which members can, and each member's distances to both first ones tell which pairs can. These are
   expanded and verified.

Pairs aren't listed bucket by bucket, nor group by group. In each round a bucket names pivots, all others are
compared with them, links join components, and pivots leave the bucket; a bucket whose groups are all in one
component is done, as more links can't change the result. Expansion takes a few members of one group against
the other group first, and more only while the two aren't in one component. A group of near copies needs about
one comparison a copy instead of one a pair, whatever its size, and every pair that could still matter is compared.

Scale: nothing but pivots and links passes between rounds, and no table is collected or broadcast beyond a checked size.
Counts are partial sums before they are shuffled. Joins on a shingle or digest that a large share of the rows have are
sort-merge joins between two shuffles (aggregates are dealt anew), which Spark splits. Sets are made again from the texts of only those nodes that are compared.
Tables of a run lie in the shared folder and are deleted when its result is written.

Defined results: documents without words, or with null text, have an empty set and link with nothing, so
their component is their own id; texts with fewer than ``width`` words are one shingle; repeated rows and
repeated ids are rows of their own that link as their texts do, and rows with words and the same id are reached from one another;
a null id never is a component's id (a component without other ids has null). An empty table gives an empty
result. Columns other than those named are not read. Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe import runtime
from veilframe.llm import rolling

#: Growth of the number of pivots a bucket and round.
_GROWTH = 16
#: Growth of the members of a group that are expanded a round, and the number of rounds before all are.
_MORE, _LEVELS = 64, 4


class Rule(NamedTuple):
    """Documents link when 100 * intersection >= percent * union, over shingles of ``width`` words."""

    width: int = 5
    percent: int = 80

    def smallest(self) -> int:
        """Two different sets need more than percent / (100 - percent) shingles in the larger, so no less in the smaller."""
        return -(-self.percent // max(1, 100 - self.percent))

    def differ(self, n: Column) -> Column:
        """How many of n shingles another set that links may lack, at most."""
        return n - F.ceil(n * self.percent / 100)

    def slice_end(self) -> int:
        """Hashes below belong to the slice: one and a half times the share that may differ."""
        return min(3 * (100 - self.percent) * (1 << 64) // 200, (1 << 64) - 1)

    def fits(self, n: Column, m: Column) -> Column:
        return F.least(n, m) * 100 >= F.greatest(n, m) * self.percent

    def reaches(self, overlap: Column, n: Column, m: Column) -> Column:
        """overlap / (n + m - overlap) is at least percent / 100."""
        return overlap * (100 + self.percent) >= (n + m) * self.percent


def _all_shingles(texts: list[str | None], width: int, powers: rolling.Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) of all shingles of the texts one after the other, and how many each text has."""
    raw = [(t or "").encode() for t in texts]
    h, at = rolling.words(np.frombuffer(b" ".join(raw), np.uint8), powers)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    n = np.diff(np.searchsorted(at, ends), prepend=0)
    size = np.minimum(n, width)
    counts = np.where(n > 0, n - size + 1, 0)
    starts = np.repeat(np.cumsum(n) - n - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    sizes = np.repeat(size, counts)
    out = sizes.astype(np.uint64)
    for i in range(width if len(h) else 0):
        out = np.where(sizes > i, rolling.mixed(out + h[np.minimum(starts + i, len(h) - 1)]), out)
    return out, counts


def _parts(batches: Iterator[pa.RecordBatch], size: int = 128) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


def _sets(b: pa.RecordBatch, width: int, powers: rolling.Powers) -> list[np.ndarray]:
    """Each text's set as sorted distinct hashes."""
    found, counts = _all_shingles(b["text"].to_pylist(), width, powers)
    return [np.unique(x) for x in np.split(found, np.cumsum(counts)[:-1])] if len(counts) else []


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


_SIGNED = "doc long, content long, n long, digest binary, tokens array<long>"


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*(s.view(np.int64) for s in sets), np.empty(0, np.int64)])))


def _signer(rule: Rule):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """tokens: the shingles of the slice."""
        powers, end = rolling.Powers(), np.uint64(rule.slice_end())
        for b in _parts(batches):
            sets = _sets(b, rule.width, powers)
            slices = [s[: int(np.searchsorted(s, end)) if len(s) >= rule.smallest() else 0] for s in sets]
            columns = [b["doc"], b["content"], pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), _lists(slices)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "content", "n", "digest", "tokens"])

    return sign


def _set_maker(rule: Rule):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = rolling.Powers()
        for b in _parts(batches):
            sets = _sets(b, rule.width, powers)
            same = pa.array([_digest(s) == d.as_py() for s, d in zip(sets, b["digest"], strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["node"], _lists(sets)], ["node", "tokens"]).filter(same)

    return make


def _verifier(rule: Rule):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whether two sets link, and their distance."""
        for b in batches:
            linked, far = [], []
            for x, y in zip(b["ha"], b["hb"], strict=True):
                x, y = (v.values.to_numpy() for v in (x, y))
                both = np.sort(np.concatenate([x, y]))
                overlap = int((both[1:] == both[:-1]).sum())
                union = len(x) + len(y) - overlap
                linked.append(100 * overlap >= rule.percent * union)
                far.append(1 - overlap / union)
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], b["na"], b["nb"], pa.array(linked, pa.bool_()), pa.array(far, pa.float64())], ["a", "b", "na", "nb", "linked", "far"])

    return verify


#: Bytes of a table of edges up to which one task contracts them.
FEW_BYTES = 2 << 20


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches]
    a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*ends, strict=True) if ends else ((), ())))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, to = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (to[a] != to[b]).any():
        low = np.minimum(to[a], to[b])
        np.minimum.at(to, to[a], low)
        np.minimum.at(to, to[b], low)
        while (to[to] != to).any():
            to = to[to]
    yield pa.RecordBatch.from_pydict({"node": nodes, "component": nodes[to]})


def components(edges: DataFrame, tables: runtime.Scratch) -> DataFrame:
    """node, component (its smallest node) for the nodes of ``edges`` (a, b: long), by contraction.

    Each node points at the smallest of itself and its neighbours, pointers are followed once more, and edges
    between different targets remain for the next turn. A node's component is where its pointers lead in the end.
    A table of up to FEW_BYTES is contracted by one task instead of a few jobs.
    """
    edges = tables.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if tables.size(edges) <= FEW_BYTES:
        return tables.table(edges.coalesce(1).mapInArrow(_contracted, "node long, component long"), "labels")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    turn = 0
    while edges.take(1):
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(edges.select(F.col("a").alias("node"), F.col("b").alias("to")))
        to = both.groupBy("node").agg(F.least("node", F.min("to")).alias("to"))
        further = runtime.dealt_anew(to.select(F.col("node").alias("to"), F.col("to").alias("next")), "to")
        to = to.join(further, "to").select("node", F.col("next").alias("to"))
        to = tables.table(to, "pointers")
        edges = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        edges = tables.table(edges.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct(), "edges")
        labels = labels.join(to.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        turn += 1
        if turn % 4 == 0:
            labels = tables.table(labels, "labels")
    return labels


#: Bytes of a table up to which it is broadcast: a few longs a row, so up to a few hundred thousand rows; beyond, Spark shuffles it.
BROADCAST_BYTES = 8 << 20


class _Join:
    """The steps of the join over docs (doc long; text string)."""

    def __init__(self, docs: DataFrame, rule: Rule, tables: runtime.Scratch):
        self.rule, self.tables = rule, tables
        self.docs = docs.select("doc", "text", F.xxhash64("text").alias("content"))
        signed = tables.table(self.docs.mapInArrow(_signer(rule), _SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")
        #: one row for each of docs
        self.signed = tables.table(signed.drop("tokens"), "rows")
        nodes = self.signed.where("n > 0").groupBy("digest").agg(F.min(F.struct("row", "doc", "content", "n")).alias("x"), F.min("doc").alias("least"))
        #: one row for each distinct set: its number, the smallest id, and which text has it
        self.nodes = tables.table(nodes.select(F.col("x.row").alias("node"), "digest", "least", "x.doc", "x.content", "x.n"), "nodes")
        self.make_sets(self.survivors(signed))
        tables.drop(signed)
        runtime.release(docs.sparkSession)

    def survivors(self, signed: DataFrame) -> DataFrame:
        """digest: of the sets of whose slice enough is found in other sets. Copies count as one, as they have one digest."""
        slices = signed.where(F.col("n") >= self.rule.smallest())
        places = slices.select("row", F.xxhash64("digest").alias("of"), F.explode("tokens").alias("token"))
        shared = places.groupBy("token").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi").select("token")
        found = places.join(runtime.dealt_anew(shared, "token"), "token").groupBy("row").agg(F.count("*").alias("shared"))
        rows = slices.select("row", "digest", "n", F.size("tokens").alias("inside")).join(found, "row", "left")
        return rows.where(F.col("inside") - F.coalesce("shared", F.lit(0)) <= self.rule.differ(F.col("n"))).select("digest")

    def small(self, table: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """``table``, or ``rows`` of it, to be broadcast where it is small."""
        rows = table if rows is None else rows
        return F.broadcast(rows) if self.tables.size(table) <= BROADCAST_BYTES else rows

    def make_sets(self, digests: DataFrame) -> None:
        """The sets with ``digests``, each from one text."""
        wanted = self.tables.table(self.nodes.select("node", "digest", F.col("doc").alias("d"), F.col("content").alias("c")).join(digests, "digest", "left_semi"), "wanted")
        rows = self.docs.join(self.small(wanted), F.col("content").eqNullSafe(F.col("c")) & F.col("doc").eqNullSafe(F.col("d"))).select("node", "digest", "text")
        rows = rows.mapInArrow(_set_maker(self.rule), "node long, tokens array<long>").groupBy("node").agg(F.first("tokens").alias("tokens"))
        self.sets = self.tables.table(rows, "sets")

    def prefixes(self) -> DataFrame:
        """node, n, pos, token: the places of each node's prefix whose shingle another set has."""
        rows = self.sets.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
        shared = runtime.dealt_anew(rows.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"), "token")
        own = Window.partitionBy("node")
        placed = rows.join(shared, "token").select("node", F.col("n").cast("long").alias("n"), "token", F.row_number().over(own.orderBy("k", "token")).alias("i"), F.count("*").over(own).alias("of"))
        placed = placed.withColumn("pos", F.col("n") - F.col("of") + F.col("i") - 1).where(F.col("pos") <= self.rule.differ(F.col("n")))
        return self.tables.table(placed.select("node", "n", "pos", "token"), "prefixes")

    def able(self, places: DataFrame) -> DataFrame:
        """The tokens that lead two of ``places`` to one another."""
        rule, left = self.rule, F.col("n") - F.col("pos")
        shared = places.groupBy("token").agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min(left).alias("left"), F.sum("n").alias("all"))
        # a bucket of two is one pair, and these are its sizes and places
        pair = rule.fits(F.col("lo"), F.col("hi")) & rule.reaches(F.col("left"), F.col("all"), F.lit(0))
        return runtime.dealt_anew(shared.where((F.col("k") > 1) & ((F.col("k") > 2) | pair)).select("token"), "token")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b: units; na, nb: a node of each) with linked and far."""
        pairs = self.tables.table(pairs.select("a", "b", "na", "nb"), "pairs")
        left, right = (self.sets.select(F.col("node").alias(f"n{x}"), F.col("tokens").alias(f"h{x}")) for x in "ab")
        # few pairs need few sets, which then are all that is shuffled
        right = runtime.dealt_anew(right.join(self.small(pairs, pairs.select("nb").distinct()), "nb", "left_semi"), "nb")
        found = self.small(pairs).join(left, "na").join(right, "nb").mapInArrow(_verifier(self.rule), "a long, b long, na long, nb long, linked boolean, far double")
        return self.tables.table(found, "verified")

    def grouped(self, places: DataFrame) -> DataFrame:
        """unit, node, far: members beyond the first (unit) of the groups of nodes with equal size and prefix."""
        keyed = places.groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("length"), F.bit_xor(F.xxhash64("pos", "token")).alias("prefix"))
        keys = ["n", "length", "prefix"]
        shared = keyed.groupBy(*keys).agg(F.min("node").alias("unit"), F.count("*").alias("k")).where("k > 1")
        pairs = keyed.join(runtime.dealt_anew(shared, "prefix"), keys).where("unit <> node").select(F.col("unit").alias("a"), F.col("node").alias("b"), F.col("unit").alias("na"), F.col("node").alias("nb"))
        return self.verified(pairs).where("linked").select(F.col("a").alias("unit"), F.col("b").alias("node"), "far")

    def joined(self, of: DataFrame, links: DataFrame) -> DataFrame:
        """``of`` (unit, component) after ``links`` (a, b: units)."""
        if not links.take(1):
            return of
        ends = links.select("a", "b").join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        new = components(ends, self.tables).toDF("component", "to")
        return self.tables.table(of.join(new, "component", "left").select("unit", F.coalesce("to", "component").alias("component")), "components")

    def linked_units(self) -> tuple[DataFrame, DataFrame]:
        """unit, component for the units that share a bucket with another; members."""
        rule, tables = self.rule, self.tables
        places = self.prefixes()
        near = places.join(self.able(places), "token", "left_semi").select("node").distinct()
        places = tables.table(places.join(near, "node", "left_semi"), "prefixes")
        members = self.grouped(places)
        reach = runtime.dealt_anew(members.groupBy("unit").agg(F.max("far").alias("reach")), "unit")
        places = places.join(members.select("node"), "node", "left_anti").withColumnRenamed("node", "unit")
        live = tables.table(places.join(self.able(places), "token", "left_semi").withColumn("component", F.col("unit")), "places")
        runtime.release(self.docs.sparkSession)
        of = tables.table(live.select("unit").distinct().withColumn("component", F.col("unit")), "components")
        loose, turn = [], 0
        while live.take(1):
            share = F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(_GROWTH**turn))
            first = F.struct(F.xxhash64("unit").alias("o"), F.col("unit").alias("p"), F.col("n").alias("pn"), F.col("pos").alias("pp"), F.col("component").alias("pc"))
            pivots = tables.table(live.groupBy("token", share.alias("share")).agg(F.min(first).alias("x")).select("token", "x.*"), "pivots")
            overlap = F.least(F.col("n") - F.col("pos"), F.col("pn") - F.col("pp"))
            found = live.join(pivots, "token").where(
                (F.col("unit") != F.col("p")) & (F.col("component") != F.col("pc")) & rule.fits(F.col("n"), F.col("pn")) & rule.reaches(overlap, F.col("n"), F.col("pn"))
            )
            pairs = found.select(F.least("unit", "p").alias("a"), F.greatest("unit", "p").alias("b")).distinct()
            checked = self.verified(pairs.withColumns({"na": F.col("a"), "nb": F.col("b")}))
            loose.append(self.open_(checked.where("not linked"), reach))
            of = self.joined(of, checked.where("linked"))
            rest = live.drop("component").join(pivots.select("token", F.col("p").alias("unit")), ["token", "unit"], "left_anti").join(of, "unit")
            open_ = rest.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
            open_ = runtime.dealt_anew(open_, "token")
            live = tables.table(rest.join(open_, "token", "left_semi"), "places")
            turn += 1
            runtime.release(self.docs.sparkSession)
        if loose:
            of = self.expanded(tables.table(functools.reduce(DataFrame.unionByName, loose).distinct(), "loose"), members, of)
        return of, members

    def open_(self, pairs: DataFrame, reach: DataFrame) -> DataFrame:
        """a, b, ra, rb (how far the members of each lie from the first) of unit pairs whose other members may link although the first don't."""
        for x in "ab":
            pairs = pairs.join(reach.select(F.col("unit").alias(x), F.col("reach").alias(f"r{x}")), x, "left")
        pairs = pairs.where("ra is not null or rb is not null").fillna(0.0, ["ra", "rb"])
        return pairs.where(F.col("far") <= self.limit() + F.col("ra") + F.col("rb")).select("a", "b", "ra", "rb")

    def limit(self) -> float:
        """The largest distance of a link, and something for rounding."""
        return 1 - self.rule.percent / 100 + 1e-9

    def expanded(self, loose: DataFrame, members: DataFrame, of: DataFrame) -> DataFrame:
        """``of`` after the links between members of ``loose`` pairs of units."""
        tables = self.tables

        def still(pairs: DataFrame) -> DataFrame:
            pairs = pairs.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b")
            return pairs.where("ca <> cb").drop("ca", "cb")

        loose = tables.table(still(loose), "loose")
        if not loose.take(1):
            return of
        sides = []
        for x, y in ("ab", "ba"):
            more = members.select(F.col("unit").alias(x), F.col("node").alias(f"n{x}"), F.col("far").alias(f"own{x}"))
            checked = self.verified(loose.join(more, x).withColumn(f"n{y}", F.col(y)))
            near = checked.join(loose, ["a", "b"]).where(F.col("far") <= self.limit() + F.col(f"r{y}")).join(more, [x, f"n{x}"])
            near = near.select("a", "b", f"n{x}", f"own{x}", F.col("far").alias(f"far{x}"))
            sides.append(tables.table(near, "side"))
            of = self.joined(of, checked.where("linked"))
        left, right = sides
        level = F.pmod(F.xxhash64("na"), F.lit(_MORE**_LEVELS))
        for turn in range(_LEVELS + 1):
            loose = tables.table(still(loose), "loose")
            if not loose.take(1):
                break
            low = _MORE ** (turn - 1) if turn else 0
            pairs = loose.select("a", "b").join(left.where(level.between(low, _MORE**turn - 1)), ["a", "b"]).join(right, ["a", "b"])
            # how far both members lie from a, and how far from b, differs by no more than they lie from one another
            pairs = pairs.where((F.abs(F.col("owna") - F.col("farb")) <= self.limit()) & (F.abs(F.col("fara") - F.col("ownb")) <= self.limit()))
            of = self.joined(of, self.verified(pairs).where("linked"))
        return of


def _classes(docs: DataFrame, rule: Rule, tables: runtime.Scratch) -> tuple[DataFrame, DataFrame]:
    """signed rows; node, digest, least (the smallest id with it), component (the smallest node reachable by links)."""
    run = _Join(docs, rule, tables)
    of, members = run.linked_units()
    nodes = run.nodes.select("digest", "node", "least").join(members.select("node", "unit"), "node", "left").withColumn("unit", F.coalesce("unit", "node"))
    nodes = nodes.join(of, "unit", "left").select("digest", "node", "least", F.coalesce("component", "unit").alias("component"))
    return run.signed.select("row", "doc", "content", "n", "digest"), tables.table(nodes, "classes")


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links): one row per document."""
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    with runtime.scratch(docs.sparkSession) as tables:
        signed, nodes = _classes(docs, rule, tables)
        rows = signed.select("doc", "n", "digest").join(nodes.select("digest", "component"), "digest", "left").select("doc", "n", "component")
        rows = tables.table(rows, "rows")
        # rows with one id are reached from one another
        spread = rows.where("doc is not null").groupBy("doc").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        ends = rows.join(runtime.dealt_anew(spread, "doc"), "doc").where("lo <> component").select(F.col("lo").alias("a"), F.col("component").alias("b")).distinct()
        same = components(ends, tables).toDF("component", "to")
        to = nodes.join(same, "component", "left").withColumn("to", F.coalesce("to", "component"))
        least = to.groupBy("to").agg(F.min("least").alias("id"))
        named = to.select("component", "to").distinct().join(least, "to").select("component", "id")
        out = rows.join(named, "component", "left").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("id")).otherwise(F.col("doc")).alias("component_id"))
        return runtime.materialize(out, "near")


def one_of_each(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component of links, that with the smallest id, with the columns of the input.

    Different texts under one id are documents of their own here. Of rows that repeat the id and text that stays, the
    smallest row stays. All rows without words stay, as they link with nothing.
    """
    # whole rows as one column, so that no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    rows = rows.select("whole", F.col(f"whole.`{key}`").cast("long").alias("doc"), F.xxhash64(F.col(f"whole.`{text}`")).alias("content"))
    with runtime.scratch(docs.sparkSession) as tables:
        signed, nodes = _classes(rows.select("doc", F.col(f"whole.`{text}`").alias("text")), rule, tables)
        # the smallest id of the component, nulls last, and of its texts the smallest set and content
        smallest = nodes.select("component", "digest", F.struct(F.col("least").isNull().alias("none"), "least", "node").alias("x"))
        best = smallest.groupBy("component").agg(F.min("x").alias("x")).select("x.node", F.col("x.least").alias("first"))
        best = nodes.select("node", "digest").join(best, "node").select("digest", "first")
        found = signed.join(best, "digest").where(F.col("doc").eqNullSafe(F.col("first")))
        found = found.groupBy("digest").agg(F.min(F.struct("content", "doc")).alias("x"), F.count("*").alias("k"))
        stays = found.select(F.col("x.content").alias("c"), F.col("x.doc").alias("d"), (F.col("k") > 1).alias("many"))
        empty = signed.where("n = 0").select(F.col("content").alias("c"), F.col("doc").alias("d")).distinct().withColumn("many", F.lit(False))
        stays = runtime.materialize(stays.unionByName(empty), "stays")

    def here(some: DataFrame) -> DataFrame:
        return rows.join(some, F.col("content").eqNullSafe(F.col("c")) & F.col("doc").eqNullSafe(F.col("d")), "left_semi")

    once, many = here(stays.where("not many")).select("whole"), stays.where("many")
    if many.take(1):
        once = once.unionByName(here(many).groupBy("doc", "content").agg(F.min("whole").alias("whole")).select("whole"))
    return once.select("whole.*")
