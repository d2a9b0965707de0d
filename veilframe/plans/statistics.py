"""Queries over column statistics, sensitivities, importance and budgets, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import scalars
from veilframe.operators import budget, longform, ml, sensitivity
from veilframe.plans.bindings import CUSTOMER, EVENTS, LINEITEM, ORDERS, PART, Query, rounded, values

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
L = LINEITEM
SHARES = (0.5, 0.9, 0.95, 0.99, 0.995)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("feature_stats", L.sql() + " select feature, n, round(total, 2) as total, round(mean, 6) as mean, lo, hi, round(sd, 4) as sd, round(sdp, 4) as sdp from stats")
def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    s = longform.stats(L.long(spark, d))
    return s.select("feature", "n", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), "lo", "hi", F.round(F.sqrt("var_samp"), 4).alias("sd"), F.round(F.sqrt("var_pop"), 4).alias("sdp"))


@query("percentiles", L.sql() + f""", p as (select unnest([{', '.join(map(str, SHARES))}]::double[]) as share)
select feature, share, round(quantile_cont(x, 0.5) filter (share = 0.5), 6) as value from long, p where false group by all
union all {' union all '.join(f"select feature, {s}::double, round(quantile_cont(x, {s}), 6) from long group by feature" for s in SHARES)}""")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(longform.percentiles(L.long(spark, d), SHARES))


def _far_text():
    """A column of text with both infinities, NaN, null and what is no number among its values."""
    return F.expr("case event_id % 50 when 0 then 'Infinity' when 1 then '-Infinity' when 2 then 'NaN' when 3 then 'n/a' when 4 then null else cast(value as string) end")


_FAR = "case event_id % 50 when 0 then 'Infinity' when 1 then '-Infinity' when 2 then 'NaN' when 3 then 'n/a' when 4 then null else value::varchar end"


@query("percentiles_infinite", f"""with e as (select event_type, {_FAR} as v from events),
x as (select event_type, case when v = 'n/a' then null when v = 'NaN' then null else v::double end as x from e),
n as (select *, count(x) over w as n, row_number() over (partition by event_type order by x nulls last) - 1 as i from x window w as (partition by event_type)),
s as (select * from (select unnest([0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]::double[]) as share)),
a as (select event_type, share, max(case when i = floor(share * (n - 1)) then x end) as lo, max(case when i = ceil(share * (n - 1)) then x end) as hi, any_value(share * (n - 1) - floor(share * (n - 1))) as part
  from n, s where x is not null group by all)
select event_type as feature, share, round(case when part = 0 or lo = hi then lo else lo + (hi - lo) * part end, 6) as value from a""")
def percentiles_infinite(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of a column of text with both infinities, NaN, null and what is no number."""
    long = EVENTS.wide(spark, d).select(F.col("event_type").alias("feature"), _far_text().try_cast("double").alias("x"))
    return rounded(longform.percentiles(long, [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]))


@query("feature_stats_text", f"""with x as (select case when {_FAR} in ('n/a', 'NaN', 'Infinity', '-Infinity') then null else ({_FAR})::double end as x from events)
select 'v' as feature, count(x) as n, count(*) as n_rows, round(sum(x), 4) as total, min(x) as lo, max(x) as hi from x""")
def feature_stats_text(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the same text column as a feature: what is no finite number counts as missing."""
    return rounded(longform.stats(longform.unpivot(EVENTS.wide(spark, d).select(_far_text().alias("v")), ["v"])).select("feature", "n", "n_rows", "total", "lo", "hi"), 4)


@query("approx_percentiles", f"select feature, share, true as near from (values {', '.join(f"('{f}')" for f in L.features)}) f(feature), (select unnest([{', '.join(map(str, SHARES))}]::double[]) as share)")
def approx_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Whether each approximate percentile has its rank within the accuracy: the shares of values below it and up to it enclose the wanted one."""
    long, accuracy = L.long(spark, d), 10_000
    found = longform.approx_percentiles(long, SHARES, accuracy)
    rows = longform.present(long).join(F.broadcast(found), "feature").groupBy("feature", "share").agg(F.avg((F.col("x") < F.col("value")).cast("double")).alias("low"), F.avg((F.col("x") <= F.col("value")).cast("double")).alias("high"), F.count("*").alias("n"))
    off = F.lit(1 / accuracy) + 1 / F.col("n")  # and one row, as ranks are whole
    return rows.select("feature", "share", ((F.col("low") <= F.col("share") + off) & (F.col("high") >= F.col("share") - off)).alias("near"))


@query("label_distribution", "select event_type, count(*) as n, round(count(*) / (select count(*) from events), 6) as share from events group by event_type")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = EVENTS.wide(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rounded(rows.crossJoin(F.broadcast(total)).select("event_type", "n", (F.col("n") / F.col("total")).alias("share")))


_PROFILED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("numeric_profile", "select * from (" + " union all ".join(
    f"select '{c}' as \"column\", round(avg((try_cast({c}::varchar as double) is not null)::int::double), 6) as share, avg((try_cast({c}::varchar as double) is not null)::int::double) > 0.95 as numeric from orders"
    for c in _PROFILED) + ")")
def numeric_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(longform.numeric_profile(ORDERS.wide(spark, d).select(*_PROFILED)))


@query("distinct_labels", "select distinct l_returnflag, l_linestatus from lineitem")
def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    return L.wide(spark, d).select("l_returnflag", "l_linestatus").distinct()


@query("bins", L.sql() + f""" select feature, case when hi > lo then least({longform.BINS - 1}, floor((x - lo) / ((hi - lo) / {longform.BINS})))::int else 0 end as bin, label, count(*) as k
from long join stats using (feature) where x is not null and label is not null group by all""")
def bins(spark: SparkSession, d: str) -> DataFrame:
    return longform.joint_counts(L.long(spark, d, label=True)).select("feature", "bin", "label", "k")


_MI = f"""joint as (select feature, case when hi > lo then least({longform.BINS - 1}, floor((x - lo) / ((hi - lo) / {longform.BINS})))::int else 0 end as bin, label, count(*)::double as k
from long join stats using (feature) where x is not null and label is not null group by all),
terms as (select feature, k / sum(k) over (partition by feature) * ln(k * sum(k) over (partition by feature) / (sum(k) over (partition by feature, bin) * sum(k) over (partition by feature, label))) as t from joint),
mi as (select feature, greatest(0, sum(t)) as mi from terms group by feature)"""


@query("mutual_information", L.sql() + f", {_MI} select feature, round(mi, 9) as mi from mi")
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return rounded(longform.mutual_information(L.long(spark, d, label=True)), 9)


@query("importance_variance", L.sql() + " select feature, round(sd, 4) as sd from stats")
def importance_variance(spark: SparkSession, d: str) -> DataFrame:
    s = budget.scores(L.long(spark, d, label=True), ["variance"])
    return s.select("feature", F.round(F.sqrt("score"), 4).alias("sd"))


@query("importance_snr", L.sql() + " select feature, round(case when n >= 2 then sd / ((hi - lo) / n + 1e-10) else 0 end, 4) as snr from stats")
def importance_snr(spark: SparkSession, d: str) -> DataFrame:
    s = budget.scores(L.long(spark, d, label=True), ["snr"])
    return s.select("feature", F.round("score", 4).alias("snr"))


_WEIGHTS = f"""{_MI},
scores as (select 'mi' as method, feature, mi as score from mi union all select 'variance', feature, sd * sd from stats
  union all select 'snr', feature, case when n >= 2 then sd / ((hi - lo) / n + 1e-10) else 0 end from stats union all select 'uniform', feature, 1 from stats),
floored as (select method, feature, greatest(case when sum(score) over w > 0 then score / sum(score) over w else 1.0 / count(*) over w end, 1.0 / (100 * count(*) over w)) as f
  from scores window w as (partition by method)),
weights as (select method, feature, f / sum(f) over (partition by method) as weight from floored),
eps(eps_total) as (select unnest([{', '.join(map(str, budget.EPSILONS))}]::double[])),
allocated as (select method, feature, weight, eps_total, eps_total * weight as eps from weights, eps)"""


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return budget.weights(budget.scores(L.long(spark, d, label=True)))


@query("budget_weights", L.sql() + f", {_WEIGHTS} select method, feature, round(weight, 9) as weight from weights")
def budget_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_weights(spark, d).select("method", "feature", "weight"), 9)


@query("budget_allocation", L.sql() + f", {_WEIGHTS} select method, feature, round(weight, 9) as weight, eps_total, round(eps, 9) as eps from allocated")
def budget_allocation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(budget.allocate(_weights(spark, d)), 9)


@query("budget_summary", L.sql() + f""", {_WEIGHTS},
ranked as (select *, row_number() over (partition by method, eps_total order by eps desc, feature) as r from allocated)
select method, eps_total, count(*) as n_features, string_agg(printf('%s=%.4f', feature, eps), ' | ' order by r) filter (r <= 3) as top_features,
  round(min(eps), 9) as min_eps, round(max(eps), 9) as max_eps, round(max(eps) / min(eps), 6) as ratio from ranked group by method, eps_total""")
def budget_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(budget.summary(budget.allocate(_weights(spark, d))), 9, ratio=6)


@query("budget_report", L.sql() + f""", {_WEIGHTS}
select feature, round((hi - lo) / n, 9) as sensitivity, {', '.join(f"round(max(weight) filter (method = '{m}'), 9) as {m}_weight, round(max(eps) filter (method = '{m}'), 9) as {m}_eps, round((hi - lo) / n / max(eps) filter (method = '{m}'), 6) as {m}_scale" for m in budget.METHODS)}
from allocated join stats using (feature) where eps_total = 1 group by feature, hi, lo, n""")
def budget_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(budget.report(L.long(spark, d, label=True)), 9, **{f"{m}_scale": 6 for m in budget.METHODS})


_GS = """select feature, n, unnest([{'query': 'mean', 'sensitivity': (hi - lo) / n}, {'query': 'sum', 'sensitivity': hi - lo}, {'query': 'count', 'sensitivity': 1.0},
  {'query': 'variance', 'sensitivity': case when n > 1 then (hi - lo) * (hi - lo) * (n - 1) / (n::double * n) else 0 end}], recursive := true) from stats"""


@query("global_sensitivity", L.sql() + f", g as ({_GS}) select feature, n, query, round(sensitivity, 6) as sensitivity from g")
def global_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sensitivity.global_sensitivity(L.long(spark, d)).select("feature", "n", "query", "sensitivity"))


@query("local_sensitivity", CUSTOMER.sql() + """ select feature, n, 'mean' as query, round(greatest(hi - mean, mean - lo) / n, 6) as sensitivity from stats
union all select feature, n, 'sum', round(greatest(abs(lo), abs(hi)), 6) from stats""")
def local_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sensitivity.local_sensitivity(CUSTOMER.long(spark, d), ["mean", "sum"]).select("feature", "n", "query", "sensitivity"))


_SMOOTH = f"""smooth as (select feature, greatest(any_value(greatest(hi - mean, mean - lo) / n), max(exp(-{sensitivity.BETA} * k) * least((hi - lo) / n, (hi - lo) * k / (n - k)))) as ss
from stats, range(1, {sensitivity.K_MAX + 1}) r(k) where k <= floor(n / 2) group by feature)"""


@query("smooth_sensitivity", EVENTS.sql() + f", {_SMOOTH} select feature, n, round(ss, 9) as sensitivity from smooth join stats using (feature)")
def smooth_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sensitivity.smooth_sensitivity(EVENTS.long(spark, d)), 9)


def _clipped_sql(shares) -> str:
    taus = " union all ".join(f"select feature, {s}::double as share, quantile_cont(x, {s}) as q from long group by feature" for s in shares)
    return f"""taus as ({taus}),
edges as (select feature, share, n, mean, lo, hi, greatest(q, lo + {sensitivity.FLOOR}) as tau from taus join stats using (feature)),
above as (select feature, share, avg((x > tau)::int::double) as frac_above from long join edges using (feature) where x is not null group by all),
clipped as (select *, (hi - lo) / n as gs_raw, greatest((tau - lo) / n, {sensitivity.FLOOR}) as gs_clipped, frac_above * greatest(hi - tau, 0) as bias_bound from edges join above using (feature, share))"""


_CLIPPED = """select feature, share, n, round(tau, 6) as tau, round(gs_raw, 9) as gs_raw, round(gs_clipped, 9) as gs_clipped, round(frac_above, 9) as frac_above,
  round(bias_bound, 6) as bias_bound, round(case when abs(mean) > 0 then 100 * (bias_bound / abs(mean)) end, 6) as relative_bias_pct,
  round(case when hi > lo then gs_raw / gs_clipped end, 6) as noise_reduction from clipped"""


@query("clipped_sensitivity", L.sql() + f", {_clipped_sql(sensitivity.CLIP_SHARES)} {_CLIPPED}")
def clipped_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sensitivity.clipped_sensitivity(L.long(spark, d)), 6, gs_raw=9, gs_clipped=9, frac_above=9)


@query("clip_summary", L.sql() + f""", {_clipped_sql(sensitivity.CLIP_SHARES)},
r as (select share, gs_raw / gs_clipped as red from clipped where hi > lo)
select share, count(*) as n_features, round(min(red), 6) as min_reduction, round(median(red), 6) as median_reduction, round(max(red), 6) as max_reduction,
  count(*) filter (red > 1.5) as n_strong, count(*) filter (abs(red - 1) <= 0.01) as n_none from r group by share""")
def clip_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = sensitivity.clipped_sensitivity(L.long(spark, d)).where("noise_reduction > 0")
    r = F.col("noise_reduction")
    return rounded(rows.groupBy("share").agg(
        F.count("*").alias("n_features"), F.min(r).alias("min_reduction"), F.median(r).alias("median_reduction"), F.max(r).alias("max_reduction"),
        F.count_if(r > 1.5).alias("n_strong"), F.count_if(F.abs(r - 1) <= 0.01).alias("n_none"),
    ))


@query("clip_top", L.sql() + f""", {_clipped_sql(sensitivity.CLIP_SHARES)},
r as (select share, feature, gs_raw / gs_clipped as red, row_number() over (partition by share order by round(gs_raw / gs_clipped, 9) desc, feature) as rank from clipped where hi > lo)
select share, feature, rank::int as rank, round(red, 6) as noise_reduction from r where rank <= 5""")
def clip_top(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = sensitivity.clipped_sensitivity(L.long(spark, d)).where(F.col("noise_reduction").isNotNull())
    rank = F.row_number().over(Window.partitionBy("share").orderBy(F.desc(F.round("noise_reduction", 9)), "feature"))
    return rounded(rows.withColumn("rank", rank).where("rank <= 5").select("share", "feature", "rank", "noise_reduction"))


@query("sensitivity_report", EVENTS.sql() + f""", {_SMOOTH}, {_clipped_sql([0.99])}
select feature, s.n, round((s.hi - s.lo) / s.n, 9) as gs, round(greatest(s.hi - s.mean, s.mean - s.lo) / s.n, 9) as ls, round(ss, 9) as ss,
  round(greatest(s.hi - s.mean, s.mean - s.lo) / (s.hi - s.lo), 6) as ls_to_gs, round(tau, 6) as tau, round(gs_clipped, 9) as gs_clipped, round(gs_raw / gs_clipped, 6) as noise_reduction
from stats s join smooth using (feature) join clipped c using (feature)""")
def sensitivity_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sensitivity.report(EVENTS.long(spark, d)), 6, gs=9, ls=9, ss=9, gs_clipped=9)


@query("record_sensitivity", PART.sql() + f""", {_clipped_sql([0.99])}
select feature, 'range' as method, round(greatest(hi - lo, 1e-8), 6) as sensitivity from stats
union all select feature, 'clipped', round(greatest(tau - lo, 1e-8), 6) from clipped
union all select feature, 'std', round(greatest(2 * sdp, 1e-8), 6) from stats""")
def record_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    long = PART.long(spark, d)
    parts = [sensitivity.record_sensitivity(long, m).select("feature", F.lit(m).alias("method"), "sensitivity") for m in ("range", "clipped", "std")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("clipped_mean", EVENTS.sql() + """, t as (select feature, quantile_cont(x, 0.95) as tau from long group by feature)
select feature, round(avg(least(x, tau)), 6) as clipped_mean from long join t using (feature) group by feature""")
def clipped_mean(spark: SparkSession, d: str) -> DataFrame:
    long = EVENTS.long(spark, d)
    return rounded(sensitivity.clipped_mean(long, sensitivity.thresholds(long, [0.95])))


@query("clip_records", EVENTS.sql() + """, t as (select feature, quantile_cont(x, 0.99) as tau, min(x) as lo from long group by feature)
select key, feature, round(greatest(lo, least(x, tau)), 6) as x from long join t using (feature)""")
def clip_records(spark: SparkSession, d: str) -> DataFrame:
    long = EVENTS.long(spark, d, key=True)
    edges = longform.stats(long).select("feature", "lo").join(sensitivity.thresholds(long, [0.99]).select("feature", "tau"), "feature")
    rows = long.join(F.broadcast(edges), "feature")
    return rounded(rows.select("key", "feature", scalars.clip(F.col("x"), F.col("lo"), F.col("tau")).alias("x")))


@query("encode_binary", "select event_type, (lower(event_type) <> 'error')::int as y, count(*) as n from events group by event_type")
def encode_binary(spark: SparkSession, d: str) -> DataFrame:
    rows = EVENTS.wide(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    return rows.select("event_type", scalars.encode_binary(F.col("event_type"), "error").alias("y"), "n")


_CLASSES = [(name, i) for i, c in enumerate(scalars.CLASS_NAMES) for name in scalars.LABELS_BY_CLASS[c]]
_PLACES = [name for name, _ in _CLASSES] + ["Normal", "unheard_of"]


@query("encode_multiclass", f"""with {values('c', ['label', 'y'], _CLASSES)}, names as (select {_PLACES} as l),
e as (select event_id, l[1 + event_id % {len(_PLACES)}] as label from events, names)
select e.label, coalesce(c.y, {scalars.UNKNOWN_CLASS})::int as y, count(*) as n from e left join c on c.label = e.label group by all""")
def encode_multiclass(spark: SparkSession, d: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, _PLACES)), (1 + F.col("event_id") % len(_PLACES)).cast("int"))
    rows = EVENTS.wide(spark, d).groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return rows.select("label", scalars.encode_multiclass(F.col("label")).alias("y"), "n")


@query("standardize", """select p_partkey, round((p_size - avg(p_size) over ()) / (stddev_pop(p_size) over () + 1e-8), 6) as p_size,
  round((p_retailprice - avg(p_retailprice) over ()) / (stddev_pop(p_retailprice) over () + 1e-8), 6) as p_retailprice from part""")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    df = PART.wide(spark, d).select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rounded(ml.standardized(df, ["p_size", "p_retailprice"]))


@query("norm_cdf", f"""with z as (select event_id, (value - 50) / 25 as z from events),
t as (select event_id, z / sqrt(2.0) as w, 1 / (1 + {scalars.ERF_P} * abs(z / sqrt(2.0))) as t from z)
select event_id, round(0.5 * (1 + sign(w) * (1 - ({' + '.join(f"{a} * pow(t, {i + 1})" for i, a in enumerate(scalars.ERF_A))}) * exp(-w * w))), 6) as p from t""")
def norm_cdf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(EVENTS.wide(spark, d).select("event_id", scalars.norm_cdf((F.col("value") - 50) / 25).alias("p")))


@query("wide_importance", """with e as (select vec_id, label::varchar as label, unnest(embedding)::double as x, 'f' || (generate_subscripts(embedding, 1) - 1) as feature from embeddings),
s as (select feature, count(x) as n, min(x) as lo, max(x) as hi, stddev_samp(x) as sd from e group by feature)
select feature, n, round(sd, 6) as sd, round(case when n >= 2 then sd / ((hi - lo) / n + 1e-10) else 0 end, 4) as snr from s""")
def wide_importance(spark: SparkSession, d: str) -> DataFrame:
    long = longform.from_array(spark.read.parquet(f"{d}/embeddings.parquet"), "embedding", "label")
    rows = budget.scores(long, ["snr"]).select("feature", F.round("score", 4).alias("snr"))
    stats = longform.stats(long).select("feature", "n", F.round(F.sqrt("var_samp"), 6).alias("sd"))
    return stats.join(rows, "feature").select("feature", "n", "sd", "snr")
