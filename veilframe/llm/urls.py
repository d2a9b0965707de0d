r"""URL filters: rules by host and path, and link-graph propagation for what no rule decides.

Rules name a host (or domain) and a path prefix; the longest that fits a url decides. Hosts that rules
allow or block become seeds. Trust is a personalised PageRank that starts at the trusted seeds and
follows links; distrust starts at the blocked seeds and follows links backwards, so that who links to
blocked hosts inherits it. A url without a rule is blocked where its host's distrust exceeds
``threshold`` times its trust, and allowed otherwise. All of it is DataFrame operations.

Both walks go on until a step changes no host's score by more than ``tolerance`` of that score. So every
host that a seed reaches has been reached, however far, and scores are settled in proportion, small ones
too. That takes up to about log(tolerance) / log(damping) steps (128) beyond the longest way from a seed, and
one more than the longest way where links have no cycle. A score that would fall below FLOOR is FLOOR.

Scale: the html is read once, in the scan that yields distinct hosts a page; edges are summed by
(from, to) before they are shuffled by one host, each iteration is one join and one sum over the
edges, and its result is a table in the shared folder, so a lost executor costs one iteration; one row
tells the driver whether to go on, and the table before is deleted. The
rules are a bounded parameter (at most MAX_RULES) and part of the expression. Verdicts join the
pages by host in a sort-merge join, which Spark splits where one host holds most pages.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, is no
seed and gets the verdict of a host without links: allow. Null html has no links. Links of a page to
its own host don't count. Repeated rows each count. Empty tables give empty results. Columns other
than those named are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe import runtime

MAX_RULES = 1000
#: Steps of the SQL that the query is compared with; it can't see whether more are due.
ROUNDS = 10
#: A score is settled once a step changes it by at most this share of it.
TOLERANCE = 1e-9
#: The least score of a host that a walk reaches, so that it is never taken for one that isn't reached.
FLOOR = sys.float_info.min
DAMPING = 0.85
THRESHOLD = 1.0
LINK = r"(?i)href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null. Of two as long, the first by name."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are part of an expression")
    kind = "struct<verdict:string,rule:string>"
    chosen = F.lit(None).cast(kind)
    for r in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        chosen = F.when(_fits(r, host, path), F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("rule"))).otherwise(chosen)
    return chosen


def parsed(pages: DataFrame, key: str, url: str, rules: Sequence[Rule]) -> DataFrame:
    """key, host, path, ruled (struct or null)."""
    rows = pages.select(F.col(key), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    return rows.withColumn("ruled", longest_rule(rules, F.col("host"), F.col("path")))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, n: on how many pages of src a link leads to dst, another host."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), 1), lambda x: host(F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))))
    rows = pages.select(host(F.col(url)).alias("src"), F.explode(links).alias("dst"))
    return rows.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def seeds(rows: DataFrame) -> DataFrame:
    """host, trust, distrust: the share of its ruled pages, of all allowed and of all blocked pages."""
    found = rows.where("host <> ''").groupBy("host").agg(
        F.sum((F.col("ruled.verdict") == "allow").cast("long")).alias("n_allow"), F.sum((F.col("ruled.verdict") == "block").cast("long")).alias("n_block")
    )
    every = found.agg(F.sum("n_allow").alias("all_allow"), F.sum("n_block").alias("all_block"))
    share = lambda n, of: F.when(F.col(of) > 0, F.coalesce(F.col(n), F.lit(0)) / F.col(of)).otherwise(F.lit(0.0))
    return found.crossJoin(F.broadcast(every)).select("host", share("n_allow", "all_allow").alias("trust"), share("n_block", "all_block").alias("distrust"))


def propagate(edges: DataFrame, start: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust once both walks are settled. edges: src, dst, n; start: host, trust, distrust."""
    out = edges.join(edges.groupBy("src").agg(F.sum("n").alias("w")), "src")
    forth = out.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("w")).alias("share"))
    into = edges.join(edges.groupBy("dst").agg(F.sum("n").alias("w")), "dst")
    back = into.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("w")).alias("share"))
    steps = runtime.materialize(forth.unionByName(back), "steps")
    start = start.selectExpr("host", "stack(2, 'trust', trust, 'distrust', distrust) as (kind, score)").where("score > 0")
    start = runtime.materialize(start, "seeds")
    spark, score, place, unsettled = edges.sparkSession, start, None, True
    while unsettled:
        moved = score.join(steps, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.lit(damping) * F.col("score") * F.col("share")).alias("score"), F.lit(0.0).alias("was"))
        jumped = start.select("kind", "host", (F.lit(1 - damping) * F.col("score")).alias("score"), F.lit(0.0).alias("was"))
        before = score.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("was"))
        summed = moved.unionByName(jumped).unionByName(before).groupBy("kind", "host")
        rows = summed.agg(F.greatest(F.sum("score"), F.lit(FLOOR)).alias("score"), F.sum("was").alias("was"))
        last, place = place, runtime.scratch_path(spark, "scores")
        rows.write.parquet(place)
        score = spark.read.schema(rows.schema).parquet(place)
        if last:
            runtime.drop_path(spark, last)
        unsettled = score.agg(F.coalesce(F.max(F.abs(F.col("score") - F.col("was")) > F.lit(tolerance) * F.col("score")), F.lit(False))).first()[0]
    by = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return score.groupBy("host").agg(by("trust"), by("distrust"))


def verdicts(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
    rules: Sequence[Rule] = RULES, damping: float = DAMPING, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
) -> DataFrame:
    """key, host, path, rule, verdict, trust, distrust: one row a page."""
    rows = parsed(pages.select(key, url), key, url, rules)
    edges = runtime.materialize(host_edges(pages.select(url, html), url, html), "edges")
    scores = propagate(edges, seeds(rows), damping, tolerance)
    judged = rows.join(scores, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    own = F.when(F.col("distrust") > F.lit(threshold) * F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(key, "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce(F.col("ruled.verdict"), own).alias("verdict"), "trust", "distrust")
