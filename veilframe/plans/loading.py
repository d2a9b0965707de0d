"""Queries over the loaders: tables written as files of each data set's form to the shared folder, loaded, and held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import runtime
from veilframe.operators import longform
from veilframe.plans.bindings import EVENTS, LINEITEM, Query, rounded, values
from veilframe.sources import tables

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _written(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = f"{runtime.scratch_folder(spark, 'files')}/{name}"
    tables.write_csv(df, path)
    return path


@query("csv_round_trip", "select event_id::bigint as event_id, user_id::bigint as user_id, event_type, round(value, 6) as value from events")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """CSV sink and scan."""
    path = _written(spark, EVENTS.wide(spark, d).select("event_id", "user_id", "event_type", "value"), "events.csv")
    back = tables.read_csv(spark, path)
    return rounded(back.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "event_type", F.col("value").cast("double").alias("value")))


_FLOW_LABEL = "case event_type when 'view' then 'normal' when 'click' then 'neptune' when 'error' then 'satan' else 'perl' end"


@query("load_flows", f"select round(value, 6) as value, (user_id % 97)::double as src_bytes, {_FLOW_LABEL} as klass from events")
def load_flows(spark: SparkSession, d: str) -> DataFrame:
    """A table whose label column is found by its content, with an index, a text column and one that seldom holds numbers to leave out."""
    rows = EVENTS.wide(spark, d).selectExpr("event_id as index", "value", "user_id % 97 as src_bytes", "concat('t', user_id % 3) as protocol", "case when user_id % 2 = 0 then '7' else 'x' end as mixed", f"{_FLOW_LABEL} as klass")
    got = tables.load(spark, _written(spark, rows, "KDDTrain.csv"))
    return rounded(got.rows.select("value", "src_bytes", got.label))


@query("headerless_text", f"select {_FLOW_LABEL} as label, count(*) as n, round(sum(value), 4) as src_bytes from events group by 1")
def headerless_text(spark: SparkSession, d: str) -> DataFrame:
    """Records without a header to CSV under their column names, and that loaded."""
    columns = {"duration": "0", "protocol_type": "'tcp'", "service": "'http'", "flag": "'SF'", "src_bytes": "value", "label": _FLOW_LABEL, "difficulty": "21"}
    rows = EVENTS.wide(spark, d).selectExpr(*[f"{columns.get(c, '1')} as {c}" for c in tables.NSL_COLUMNS])
    folder = runtime.scratch_folder(spark, "files")
    rows.write.option("header", False).csv(f"{folder}/records.txt")
    tables.text_to_csv(spark, f"{folder}/records.txt", f"{folder}/KDDTrain.csv")
    got = tables.load(spark, f"{folder}/KDDTrain.csv")
    return rounded(got.rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("src_bytes").alias("src_bytes")), 4)


_CATEGORY = "case user_id % 5 when 0 then ' DoS ' when 1 then '' when 2 then 'nan' when 3 then 'Worms' end"


@query("load_unsw", f"""with e as (select value, {_CATEGORY} as c, case when user_id % 11 = 0 then 0 else 1 end as label from events),
n as (select value, case when label = 0 or trim(coalesce(c, '')) in ('', 'nan') then 'Normal' else trim(c) end as label_str from e)
select label_str, label_str as category, count(*) as n, round(sum(value), 4) as dur from n group by all""")
def load_unsw(spark: SparkSession, d: str) -> DataFrame:
    rows = EVENTS.wide(spark, d).selectExpr("event_id as id", "value as dur", "'tcp' as proto", f"{_CATEGORY} as attack_cat", "case when user_id % 11 = 0 then 0 else 1 end as label")
    got = tables.load(spark, _written(spark, rows, "UNSW_NB15.csv"))
    named = tables.with_category(got, tables.UNSW)
    return rounded(named.groupBy("label_str", "category").agg(F.count("*").alias("n"), F.sum("dur").alias("dur")), 4)


_CIC_LABEL = "case user_id % 4 when 0 then 'BENIGN' when 1 then 'DDoS' when 2 then 'DoS Hulk' else 'PortScan' end"


@query("load_cic", f"""select {_CIC_LABEL} as "Label", case user_id % 4 when 0 then 'Normal' when 1 then 'DDoS' when 2 then 'DoS' else 'PortScan' end as category, count(*) as n,
  round(sum(value), 4) as flow_bytes, sum(user_id)::double as packets, count(case when event_id % 2 = 1 and user_id % 13 <> 0 then 1 end) as n_rate from events group by all""")
def load_cic(spark: SparkSession, d: str) -> DataFrame:
    """Two files whose columns differ in order and number: united by name. Infinities become null."""
    e = EVENTS.wide(spark, d)
    rate = "case when user_id % 13 = 0 then 'Infinity' else '2.5' end as ` Flow Rate`"
    one = e.where("event_id % 2 = 0").selectExpr("'f' as `Flow ID`", "value as ` Flow Bytes`", "user_id as ` Packets`", f"{_CIC_LABEL} as ` Label`")
    two = e.where("event_id % 2 = 1").selectExpr(f"{_CIC_LABEL} as ` Label`", rate, "user_id as ` Packets`", "value as ` Flow Bytes`")
    folder = f"{runtime.scratch_folder(spark, 'files')}/MachineLearningCVE"
    tables.write_csv(one, f"{folder}/monday")
    tables.write_csv(two, f"{folder}/tuesday")
    got = tables.load_cic(spark, f"{folder}/*")
    sums = tables.with_category(got, tables.CIC).groupBy("Label", "category").agg(F.count("*").alias("n"), F.sum("Flow Bytes").alias("flow_bytes"), F.sum("Packets").alias("packets"), F.count("Flow Rate").alias("n_rate"))
    return rounded(sums, 4)


_PATHS = (("/d/KDDTrain+.csv", tables.NSL), ("/d/UNSW_NB15_training-set.csv", tables.UNSW), ("/d/MachineLearningCVE/", tables.CIC), ("x/Friday.pcap_ISCX.csv", tables.CIC), ("/d/dataset.csv", tables.UNKNOWN))


@query("dataset_detection", f"with {values('p', ('path', 'kind'), _PATHS)} select path, kind from p")
def dataset_detection(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(p, tables.detect(p)) for p, _ in _PATHS], "path string, kind string")


@query("numeric_columns", "select column_name as \"column\" from (describe lineitem) where column_type in ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT', 'TINYINT') or column_type like 'DECIMAL%'")
def numeric_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that are numbers by type."""
    return spark.createDataFrame([(c,) for c in longform.numeric_columns(LINEITEM.wide(spark, d))], "column string")


@query("finite_values", """select event_id, case when event_id % 7 in (0, 1, 2) then null else round(value, 6) end as x from events""")
def finite_values(spark: SparkSession, d: str) -> DataFrame:
    """NaN and both infinities become null."""
    from veilframe.functions import scalars

    odd = F.when(F.col("event_id") % 7 == 0, float("inf")).when(F.col("event_id") % 7 == 1, float("-inf")).when(F.col("event_id") % 7 == 2, float("nan")).otherwise(F.col("value"))
    return rounded(EVENTS.wide(spark, d).select("event_id", scalars.finite(odd).alias("x")))


@query("synthetic_table", f"with {values('c', ('attack_cat', 'n'), list(tables.SYNTHETIC_CLASSES.items()))} select attack_cat, (attack_cat <> 'Normal')::int as label, n::bigint as n, {sum(tables.SYNTHETIC_CLASSES.values())}::bigint as n_ids, true as within from c")
def synthetic_table(spark: SparkSession, d: str) -> DataFrame:
    """Classes of the synthetic table, and whether all values keep to their bounds."""
    rows = tables.synthetic_flows(spark)
    bounds = F.lit(True)
    for feature, by in tables.SYNTHETIC_SPECS.items():
        low, high = (tables._by_class(by, i) for i in (2, 3))
        bounds = bounds & F.col(feature).between(low, high)
    one = rows.groupBy("attack_cat", "label").agg(F.count("*").alias("n"), F.min(bounds.cast("int")).alias("within"))
    ids = rows.agg(F.count_distinct("id").alias("n_ids"))
    return one.crossJoin(F.broadcast(ids)).select("attack_cat", "label", "n", "n_ids", (F.col("within") == 1).alias("within"))  # one row
