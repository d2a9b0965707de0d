"""How queries bind tables to the long layout, in Spark and as SQL text for the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import longform

Query = Callable[[SparkSession, str], DataFrame]


class Binding(NamedTuple):
    table: str
    features: tuple[str, ...]
    label: str
    key: tuple[str, ...]

    def wide(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{self.table}.parquet")

    def key_column(self) -> Column:
        return F.concat_ws("|", *[F.col(k).cast("string") for k in self.key])

    def long(self, spark: SparkSession, sf_dir: str, key: bool = False, label: bool = False) -> DataFrame:
        return longform.unpivot(self.wide(spark, sf_dir), self.features, self.label if label else None, self.key_column() if key else None)

    def sql(self) -> str:
        """A ``with`` list that defines long(key, label, feature, x) and stats(feature, n, total, mean, lo, hi, sd, sdp)."""
        key = f"concat_ws('|', {', '.join(f'{k}::varchar' for k in self.key)})"
        parts = [f"select {key} as key, {self.label}::varchar as label, '{f}' as feature, {f}::double as x from {self.table}" for f in self.features]
        return (
            f"with long as ({' union all '.join(parts)}),\nstats as (select feature, count(x) as n, sum(x) as total, avg(x) as mean, min(x) as lo, max(x) as hi, "
            "stddev_samp(x) as sd, stddev_pop(x) as sdp from long group by feature)"
        )


LINEITEM = Binding("lineitem", ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "l_returnflag", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
ORDERS = Binding("orders", ("o_totalprice",), "o_orderstatus", ("o_orderkey",))
EVENTS = Binding("events", ("value",), "event_type", ("event_id",))
CUSTOMER = Binding("customer", ("c_acctbal",), "c_mktsegment", ("c_custkey",))
PART = Binding("part", ("p_size", "p_retailprice"), "p_brand", ("p_partkey",))


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded to ``digits``, or as ``own`` says by column."""
    return df.select(*[F.round(F.col(f"`{c}`"), own.get(c, digits)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def values(name: str, columns: Sequence[str], rows: Sequence[Sequence]) -> str:
    """A common table expression of literal rows."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::double" if isinstance(v, float) else str(v)
    return f"{name}({', '.join(columns)}) as (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"
