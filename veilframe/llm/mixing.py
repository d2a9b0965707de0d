"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sources share a budget of words in proportion to their weights. A source whose share exceeds
``epochs`` times its size is clamped there and the excess is shared anew among the others by weight,
until no share exceeds its cap. Within a source every document is then repeated the whole number of
times that fits, and a seeded choice of documents once more, so that the words taken meet the target
to within half a document.

Water level: with S the clamped sources, level(S) = (budget - sum of their caps) / (weight of the
rest). Clamping too few or too many sources only lowers it, so the level is the largest over the
prefixes of the sources ordered by cap over weight, and one window over the source table finds it.

Scale: the seeded order within a source is by an md5, and what is taken once more is a beginning of that order. So all that
a source needs is where it is cut: sums by (source, first three hexadecimal digits) tell in which of 4,096 slices, and only
the rows of that slice are looked at again, by three digits more while they are over ``SLICE_ROWS``, and in order
in the end, copies as one row. Documents are then compared with their source's cut: they are neither shuffled nor
sorted, and texts stay where they are. Only the tables with one row a source are ordered as a whole. Where the cut falls
among copies of one document, these, and no others, are numbered by one task.

Defined results: a null text has size 0; a null source is a source of its own, ranked last; sources
without words get target 0 and nothing of them is taken; repeated rows are documents of their own;
an empty table gives an empty result. Input columns other than those named are kept by ``mix`` and
not read by ``takes``; working columns take names that are free.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe import runtime

EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 17
#: Hexadecimal digits of the md5 that make a slice, and the rows of one up to which it isn't sliced further.
SLICE_DIGITS, SLICE_ROWS = 3, 1 << 20
_P = "_mix_"


def n_words(text: Column) -> Column:
    r"""Number of `[^\x20\x09-\x0D]+` in a text; null: 0. One letter a word is left, so no word becomes an object."""
    letters = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def targets(sizes: DataFrame, source: str, size: str, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row a source: source, source_size, weight, target. ``sizes`` may have any number of rows a source."""
    by_source = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col(f"{_P}rank") % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn(f"{_P}rank", rank).withColumn("weight", weight.cast("long")).withColumn(f"{_P}cap", F.col("source_size") * epochs)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col(f"{_P}cap") / F.col("weight"), f"{_P}rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(f"{_P}cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    leveled = ranked.withColumn(f"{_P}level", level).withColumn(f"{_P}level", F.max(f"{_P}level").over(everything))
    target = F.least(F.col(f"{_P}level") * F.col("weight"), F.col(f"{_P}cap").cast("double"))
    return leveled.select("source", "source_size", "weight", target.alias("target"))


def _cuts(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """source, source_size, target, whole, cut, at_cut, copies: documents of a lower order than ``cut`` are taken once more, and ``at_cut`` of the
    ``copies`` that have it. rows: source (a key), order, size. shares: source (a key), source_size, target."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    shares = shares.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    edge, digits = None, 0

    def inside() -> DataFrame:
        """The rows of the slices in which sources are cut."""
        if not digits:
            return rows.withColumns({"prefix": F.lit(""), "start": F.lit(0).cast("long")})
        return rows.withColumn("prefix", F.substring("order", 1, digits)).join(edge, ["source", "prefix"])

    while True:
        deeper = F.substring("order", 1, digits + SLICE_DIGITS)
        sums = inside().groupBy("source", "prefix", "start", deeper.alias("deeper")).agg(F.sum("size").alias("total"), F.count("*").alias("k"))
        before = F.sum("total").over(Window.partitionBy("source", "prefix").orderBy("deeper").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("start", F.col("start") + F.coalesce(before, F.lit(0))).join(shares.select("source", "rest"), "source")
        found = sums.where((F.col("start") <= F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("total")))
        edge = runtime.materialize(found.select("source", F.col("deeper").alias("prefix"), "start", "k"), "edge")
        digits += SLICE_DIGITS
        if digits > 28 or not edge.where(F.col("k") > SLICE_ROWS).take(1):
            break
        edge = edge.drop("k")
    edge = edge.drop("k")
    groups = inside().groupBy("source", "prefix", "start", "order").agg(F.max("size").alias("size"), F.count("*").alias("copies"))
    before = F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy("source", "prefix").orderBy("order").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("start", F.col("start") + F.coalesce(before, F.lit(0))).join(shares.select("source", "rest"), "source")
    # of copies one after the other, those whose middle lies before the rest's end
    fit = F.when(F.col("size") > 0, F.ceil((F.col("rest") - F.col("start")) / F.col("size") - F.lit(0.5))).when(F.col("start") < F.col("rest"), F.col("copies")).otherwise(F.lit(0))
    groups = groups.withColumn("fit", F.least(F.greatest(fit, F.lit(0)), F.col("copies")))
    first = F.min(F.when(F.col("fit") < F.col("copies"), F.struct(F.col("order").alias("cut"), F.col("fit").alias("at_cut"), "copies")))
    past = F.struct(F.concat(F.max("prefix"), F.lit("g")).alias("cut"), F.lit(0).cast("long").alias("at_cut"), F.lit(0).cast("long").alias("copies"))
    cuts = groups.groupBy("source").agg(F.coalesce(first, past).alias("c")).select("source", "c.*")
    return runtime.materialize(shares.join(cuts, "source").drop("rest"), "cuts")


def _with_takes(docs: DataFrame, key: str, text: str, source: str, weights: Sequence[int], epochs: int, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns size, source_size, target and repeats, and the names that these have."""
    c = lambda name: F.col(f"`{name}`")
    new = {x: runtime.free_name(docs, f"{_P}{x}") for x in ("source", "size", "order", "source_size", "target", "whole", "cut", "at_cut", "copies", "repeats", "place")}
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(c(key).cast("string"), F.lit("")), F.coalesce(c(text), F.lit(""))))
    thin = docs.select(c(source).alias("name"), _source_key(c(source)).alias("source"), order.alias("order"), n_words(c(text)).alias("size"))
    shares = targets(thin.groupBy("name").agg(F.sum("size").alias("size")), "name", "size", weights, epochs)
    shares = runtime.materialize(shares, "shares")  # one row a source
    cuts = _cuts(thin.drop("name"), shares.select(_source_key(F.col("source")).alias("source"), "source_size", "target"))
    rows = docs.withColumns({new["source"]: _source_key(c(source)), new["size"]: n_words(c(text)), new["order"]: order})
    placed = rows.join(cuts.select(*[F.col(x).alias(new[x]) for x in cuts.columns]), new["source"])
    repeats = lambda extra: c(new["whole"]) + extra.cast("long")
    mixed = (c(new["order"]) == c(new["cut"])) & (c(new["at_cut"]) > 0)
    if not cuts.where("at_cut > 0").take(1):
        return placed.withColumn(new["repeats"], repeats(c(new["order"]) < c(new["cut"]))), new
    plain = placed.where(~mixed).withColumn(new["repeats"], repeats(c(new["order"]) < c(new["cut"])))
    place = F.row_number().over(Window.partitionBy(new["source"]).orderBy(new["order"]))
    some = placed.where(mixed).withColumn(new["place"], place).withColumn(new["repeats"], repeats(c(new["place"]) <= c(new["at_cut"]))).drop(new["place"])
    return plain.unionByName(some), new


def takes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """key, size, source_size, target, repeats: how often the mix takes each document."""
    rows, new = _with_takes(docs.select(key, text, source), key, text, source, weights, epochs, seed)
    return rows.select(key, *[F.col(f"`{new[x]}`").alias(x) for x in ("size", "source_size", "target", "repeats")])


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of the input."""
    rows, new = _with_takes(docs, key, text, source, weights, epochs, seed)
    rows = rows.where(F.col(f"`{new['repeats']}`") > 0)
    copies = rows.withColumn(new["place"], F.explode(F.sequence(F.lit(1), F.col(f"`{new['repeats']}`").cast("int"))))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])
