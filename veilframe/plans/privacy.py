"""Queries over privacy accounting, with their DuckDB equivalents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import noise
from veilframe.operators import accounting, longform, prv, release, sensitivity
from veilframe.plans.bindings import EVENTS, LINEITEM, Query, rounded

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
EPSILONS = (0.1, 0.3, 0.5, 1.0, 2.0, 5.0)
NOMINAL = (0.1, 0.3, 0.5)
KS = (1, 5, 10, 20, 50, 100, 200)
RATES = (0.01, 0.05, 0.1, 0.2, 0.5)
#: ln(1 / delta) and the factor of the Gaussian deviation, as SQL.
LN, GAUSS = f"({math.log(1 / noise.DELTA)}::double)", f"({math.sqrt(2 * math.log(1.25 / noise.DELTA))}::double)"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def unnest(name: str, values) -> str:
    kind = "double" if isinstance(values[0], float) else "integer"
    return f"(select unnest([{', '.join(map(str, values))}]::{kind}[]) as {name})"


def laplace_rdp(a: str, e: str) -> str:
    inner = f"{a} / (2 * {a} - 1) * exp(({a} - 1) * {e}) + ({a} - 1) / (2 * {a} - 1) * exp(-{a} * {e})"
    return f"case when ({a} - 1) * {e} > {accounting.OVERFLOW} then (({a} - 1) * {e} + ln({a} / (2 * {a} - 1))) / ({a} - 1) else ln({inner}) / ({a} - 1) end"


def gaussian_rdp(a: str, sensitivity_: str, sigma: str) -> str:
    return f"{a} * {sensitivity_} * {sensitivity_} / (2 * {sigma} * {sigma})"


@query("rdp_composition", f"""with g as (select * from (values ('laplace'), ('gaussian')) m(mechanism), {unnest('e', NOMINAL)}, {unnest('k', KS)}, {unnest('a', accounting.ALPHAS)}),
c as (select *, k * case when mechanism = 'laplace' then {laplace_rdp('a', 'e')} else {gaussian_rdp('a', '1', f'({GAUSS} / e)')} end + {LN} / (a - 1) as eps from g),
b as (select mechanism, e, k, min(eps) as rdp, arg_min(a, eps) as alpha from c group by all),
r as (select *, e * k as basic, e * sqrt(2 * k * {LN}) + k * e * (exp(e) - 1) as advanced from b)
select mechanism, e as nominal_epsilon, k as n_queries, round(basic, 6) as basic, round(advanced, 6) as advanced, round(rdp, 6) as rdp, alpha as best_alpha,
  round(basic / rdp, 6) as rdp_vs_basic, round(basic / advanced, 6) as advanced_vs_basic from r""")
def rdp_composition(spark: SparkSession, d: str) -> DataFrame:
    return rounded(accounting.composition(spark, NOMINAL, KS))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """A query log made from the events: each user's events are queries with budgets by type."""
    e = EVENTS.wide(spark, d)
    return e.select(
        (F.col("user_id") % 10).alias("analyst"), "event_id",
        F.when(F.col("event_id") % 3 == 0, "gaussian").otherwise("laplace").alias("mechanism"),
        (0.001 * (1 + F.length("event_type"))).alias("epsilon"), F.lit(1.0).alias("sensitivity"), F.lit(200.0).alias("sigma"),
        F.when(F.col("event_id") % 5 == 0, 0.1).otherwise(1.0).alias("sampling_rate"),
    )


_LOG_SQL = """log as (select user_id % 10 as analyst, event_id, case when event_id % 3 = 0 then 'gaussian' else 'laplace' end as mechanism, 0.001::double * (1 + length(event_type)) as epsilon,
  200.0::double as sigma, case when event_id % 5 = 0 then 0.1::double else 1.0::double end as q from events)"""
_AMPLIFIED = "(case when q < 1 then ln(1 + q * (exp(epsilon) - 1)) else epsilon end)"


@query("accountant_log", f"""with {_LOG_SQL},
c as (select analyst, a, sum(case when mechanism = 'laplace' then {laplace_rdp('a', _AMPLIFIED)} else {gaussian_rdp('a', '1', 'sigma')} end) as rdp from log, {unnest('a', accounting.ALPHAS)} group by all),
b as (select analyst, min(rdp + {LN} / (a - 1)) as eps, arg_min(a, rdp + {LN} / (a - 1)) as alpha from c group by analyst),
t as (select analyst, count(*) as n_queries, sum(epsilon) as basic, sqrt(2 * {LN} * sum(epsilon * epsilon)) + sum(epsilon * (exp(epsilon) - 1)) as advanced from log group by analyst)
select analyst, n_queries, round(basic, 6) as basic, round(advanced, 6) as advanced, round(least(basic, eps), 6) as rdp, alpha from t join b using (analyst)""")
def accountant_log(spark: SparkSession, d: str) -> DataFrame:
    return rounded(accounting.spent(_log(spark, d), by=["analyst"]))


@query("accountant_running", f"""with {_LOG_SQL},
c as (select analyst, event_id, a, sum(case when mechanism = 'laplace' then {laplace_rdp('a', _AMPLIFIED)} else {gaussian_rdp('a', '1', 'sigma')} end)
  over (partition by analyst, a order by event_id rows unbounded preceding) as rdp from log, {unnest('a', accounting.ALPHAS)})
select analyst, event_id, round(min(rdp + {LN} / (a - 1)), 6) as epsilon from c group by all""")
def accountant_running(spark: SparkSession, d: str) -> DataFrame:
    return rounded(accounting.running(_log(spark, d), "event_id", by=["analyst"]))


@query("amplification", f"""with g as (select * from (values ('laplace'), ('gaussian')) m(mechanism), {unnest('epsilon', EPSILONS)}, {unnest('sampling_rate', RATES)}),
a as (select *, ln(1 + sampling_rate * (exp(epsilon) - 1)) as a from g)
select mechanism, epsilon, sampling_rate, round(a, 9) as amplified_epsilon, round(sampling_rate * 1e5 * {noise.DELTA}, 9) as amplified_delta_e5, round(epsilon / a, 6) as ratio from a""")
def amplification(spark: SparkSession, d: str) -> DataFrame:
    rows = release.amplification(spark, EPSILONS, RATES)
    return rounded(rows.withColumn("amplified_delta_e5", F.col("amplified_delta") * 1e5).drop("amplified_delta"), 9, ratio=6)


@query("noise_variance", LINEITEM.sql() + f""", g as (select * from stats, (values ('laplace'), ('gaussian')) m(mechanism), {unnest('epsilon', EPSILONS)})
select feature, mechanism, epsilon, round(case when mechanism = 'laplace' then 2 * pow((hi - lo) / n / epsilon, 2) else pow({GAUSS} * ((hi - lo) / n) / epsilon, 2) end, 6) as variance from g""")
def noise_variance(spark: SparkSession, d: str) -> DataFrame:
    rows = sensitivity.global_sensitivity(LINEITEM.long(spark, d), ["mean"])
    rows = rows.withColumn("mechanism", F.explode(F.array(F.lit("laplace"), F.lit("gaussian")))).withColumn("epsilon", F.explode(F.array(*map(F.lit, EPSILONS))))
    return rounded(rows.select("feature", "mechanism", "epsilon", noise.noise_variance(F.col("mechanism"), F.col("sensitivity"), F.col("epsilon")).alias("variance")))


@query("expected_error", f"""with g as (select * from (values ('laplace'), ('gaussian')) m(mechanism), {unnest('sensitivity', (0.5, 1.0, 2.0))}, {unnest('epsilon', EPSILONS)})
select mechanism, sensitivity, epsilon, round(case when mechanism = 'laplace' then sensitivity / epsilon else {GAUSS} * sensitivity / epsilon * sqrt(2 / pi()) end, 6) as error from g""")
def expected_error(spark: SparkSession, d: str) -> DataFrame:
    rows = accounting.grid(spark, mechanism=noise.MECHANISMS, sensitivity=[0.5, 1.0, 2.0], epsilon=list(EPSILONS))
    return rounded(rows.withColumn("error", accounting.expected_error(F.col("mechanism"), F.col("sensitivity"), F.col("epsilon"))))


SIGMAS = (0.8, 1.0, 1.5, 3.63, 7.441, 12.197)
N, BATCH, EPOCHS = 14001, 256, 30


@query("dpsgd_accounting", f"""with g as (select {N} as n, {BATCH} as batch, {EPOCHS} as epochs, * from {unnest('sigma', SIGMAS)}, {unnest('a', accounting.SGD_ALPHAS)}),
c as (select *, floor(epochs * n / batch)::bigint as steps from g),
e as (select n, batch, epochs, sigma, steps, a, steps * (pow(batch / n, 2) * a / (2 * sigma * sigma)) + {LN} / (a - 1) as eps from c)
select n, batch, epochs, sigma, steps, round(min(eps), 6) as epsilon, arg_min(a, eps) as alpha from e group by all""")
def dpsgd_accounting(spark: SparkSession, d: str) -> DataFrame:
    rows = accounting.grid(spark, n=[N], batch=[BATCH], epochs=[EPOCHS], sigma=list(SIGMAS))
    return rounded(accounting.sgd_spent(rows))


@query("dpsgd_sigma", f"""with g as (select {N} as n, {BATCH} as batch, {EPOCHS} as epochs, * from {unnest('epsilon', EPSILONS)}, {unnest('a', accounting.SGD_ALPHAS)})
select n, batch, epochs, epsilon, round(min(case when epsilon > {LN} / (a - 1) then sqrt(floor(epochs * n / batch) * (pow(batch / n, 2) * a / 2) / (epsilon - {LN} / (a - 1))) end), 6) as sigma from g group by all""")
def dpsgd_sigma(spark: SparkSession, d: str) -> DataFrame:
    return rounded(accounting.sigma_for(accounting.grid(spark, n=[N], batch=[BATCH], epochs=[EPOCHS], epsilon=list(EPSILONS))))


@query("dpsgd_rates", f"""with g as (select * from {unnest('q', (0.05, 0.2, 0.5))}, {unnest('sigma', (0.7, 2.0))}, {unnest('a', (1.5, 2.0, 4.0, 8.0))})
select q, sigma, a as alpha, round(case when q <= 0.1 or a * (a - 1) / (2 * sigma * sigma) >= {accounting.OVERFLOW} then q * q * a / (2 * sigma * sigma)
  else ln(pow(1 - q, a) + q * pow(1 - q, a - 1) * exp((a - 1) / (sigma * sigma)) + q * q * exp(a * (a - 1) / (2 * sigma * sigma))) / (a - 1) end, 6) as rdp from g""")
def dpsgd_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = accounting.grid(spark, q=[0.05, 0.2, 0.5], sigma=[0.7, 2.0], alpha=[1.5, 2.0, 4.0, 8.0])
    return rounded(rows.withColumn("rdp", accounting.rdp_gaussian_subsampled(F.col("alpha"), F.col("q"), F.col("sigma"))))


@query("dpsgd_bound", f"""with g as (select * from {unnest('q', (0.01, 0.05, 0.2))}, {unnest('sigma', (0.8, 2.0, 7.441))}, {unnest('a', accounting.WHOLE_ALPHAS)}),
t as (select q, sigma, a, k, lgamma(a + 1) - case when k = 0 then 0 else lgamma(k + 1) end - case when k = a then 0 else lgamma(a - k + 1) end
  + (a - k) * ln(1 - q) + k * ln(q) + (k * k - k) / (2 * sigma * sigma) as t from (select *, unnest(range(0, a + 1))::double as k from g)),
m as (select *, max(t) over (partition by q, sigma, a) as m from t)
select q, sigma, a as alpha, round((any_value(m) + ln(sum(exp(t - m)))) / (a - 1), 6) as rdp from m group by q, sigma, a""")
def dpsgd_bound(spark: SparkSession, d: str) -> DataFrame:
    """The proven bound of a step that takes each row with probability q."""
    rows = accounting.grid(spark, q=[0.01, 0.05, 0.2], sigma=[0.8, 2.0, 7.441], alpha=list(accounting.WHOLE_ALPHAS))
    return rounded(rows.withColumn("rdp", accounting.rdp_gaussian_poisson(F.col("alpha"), F.col("q"), F.col("sigma"))))


@query("prv_hockey_stick", f"""select e0 as epsilon0, e as epsilon, round(greatest(0, 1 - exp((e - e0) / 2)), 9) as delta from {unnest('e0', EPSILONS)}, {unnest('e', (0.0, 0.05, 0.2, 0.4, 1.0, 3.0))}""")
def prv_hockey_stick(spark: SparkSession, d: str) -> DataFrame:
    rows = accounting.grid(spark, epsilon0=list(EPSILONS), epsilon=[0.0, 0.05, 0.2, 0.4, 1.0, 3.0])
    return rounded(rows.withColumn("delta", accounting.hockey_stick_laplace(F.col("epsilon0"), F.col("epsilon"))), 9)


@query("prv_composition")
def prv_composition(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prv.composition(spark, NOMINAL, [1, 10, 50, 100]))


@query("prv_one_release", f"""select e as epsilon, round(greatest(0, e + 2 * ln(1 - {noise.DELTA})), 6) as exact, true as above, true as near from {unnest('e', NOMINAL)}""")
def prv_one_release(spark: SparkSession, d: str) -> DataFrame:
    """The bound by loss distributions of one Laplace release against its closed form: never below, and within a hundredth."""
    rows = prv.composition(spark, NOMINAL, [1], ["laplace"])
    exact = F.greatest(F.lit(0.0), F.col("nominal_epsilon") + 2 * F.log1p(F.lit(-noise.DELTA)))
    return rounded(rows.select(F.col("nominal_epsilon").alias("epsilon"), exact.alias("exact"), (F.col("prv") >= exact - 1e-9).alias("above"), (F.col("prv") <= 1.01 * exact).alias("near")))


@query("prv_profile")
def prv_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prv.profile(spark, "laplace", 0.1, 10, [0.0, 0.1, 0.2, 0.4, 0.8, 1.0]), 9)


@query("prv_log")
def prv_log(spark: SparkSession, d: str) -> DataFrame:
    """Budget by analyst over the whole log of both mechanisms, sampled and not, beside the Renyi bound."""
    made = prv.spent(_log(spark, d), by=["analyst"])
    return rounded(prv.joined(made, accounting.spent(_log(spark, d), by=["analyst"]).select("analyst", "basic", "rdp"), ["analyst"]))


@query("prv_log_curve")
def prv_log_curve(spark: SparkSession, d: str) -> DataFrame:
    """The privacy curve of each analyst's log."""
    return rounded(prv.curves(_log(spark, d), [0.0, 0.5, 1.0, 2.0, 4.0], by=["analyst"]), 9)


#: Nodes of the midpoint rule of the exact curve of Gaussian releases, over so many deviations.
_NODES, _SPAN = 4000, 12.0


def _gaussian_delta(m: Column, e: Column) -> Column:
    """Delta of a sum of Gaussian losses, which is one with squared ratio m^2: the integral of phi(x) (1 - exp(e - m x - m^2 / 2)) from e / m - m / 2 up."""
    start, h = e / m - m / 2, _SPAN / _NODES
    x = lambda i: start + (i + 0.5) * F.lit(h)
    term = lambda i: F.exp(-x(i) * x(i) / 2) * (1 - F.exp(e - m * x(i) - m * m / 2))
    return F.aggregate(F.sequence(F.lit(0), F.lit(_NODES - 1)), F.lit(0.0), lambda s, i: s + term(i)) * F.lit(h / math.sqrt(2 * math.pi))


@query("prv_log_gaussian", f"""with {_LOG_SQL},
g as (select analyst, count(*) as n_queries, sqrt(count(*) / (200.0::double * 200.0::double)) as m from log where mechanism = 'gaussian' and q = 1 group by analyst),
x as (select *, e / m - m / 2 + (i + 0.5) * {_SPAN / _NODES}::double as x from g, {unnest('e', (0.05, 0.2))}, range({_NODES}) r(i))
select analyst, n_queries, e as epsilon, round(sum(exp(-x * x / 2) * (1 - exp(e - m * x - m * m / 2))) * {_SPAN / _NODES / math.sqrt(2 * math.pi)}::double, 8) as exact, true as above, true as near from x group by all""")
def prv_log_gaussian(spark: SparkSession, d: str) -> DataFrame:
    """The curve of each analyst's Gaussian releases of all rows against the exact one: never below, and within two hundredths and 1e-8."""
    log = _log(spark, d).where("mechanism = 'gaussian' and sampling_rate = 1")
    rows = prv.curves(log, [0.05, 0.2], by=["analyst"], delta=1e-6)
    n = log.groupBy("analyst").agg(F.count("*").alias("n_queries"), F.sqrt(F.sum(F.pow(F.col("sensitivity") / F.col("sigma"), F.lit(2.0)))).alias("m"))
    rows = prv.joined(rows, n, ["analyst"]).withColumn("exact", _gaussian_delta(F.col("m"), F.col("epsilon")))
    above, near = F.col("delta") >= F.col("exact") - 1e-12, F.col("delta") <= 1.02 * F.col("exact") + 1e-8
    return rounded(rows.select("analyst", "n_queries", "epsilon", "exact", above.alias("above"), near.alias("near")), 8)


def _types(spark: SparkSession, d: str) -> DataFrame:
    """A setting for each type of event: rows, its share of all, a budget and a range of values."""
    e = EVENTS.wide(spark, d)
    all_ = e.agg(F.count("*").alias("n_all"))
    one = e.groupBy("event_type").agg(F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("spread"))
    return one.crossJoin(F.broadcast(all_)).select(  # one row
        "event_type", "n", "spread", (F.col("n") / F.col("n_all")).alias("q"), (0.25 * F.length("event_type")).alias("e0")
    )


_TYPES_SQL = "types as (select event_type, count(*) as n, max(value) - min(value) as spread, count(*) / sum(count(*)) over () as q, 0.25::double * length(event_type) as e0 from events group by event_type)"


@query("prv_log_sampled", f"""with {_TYPES_SQL}
select event_type, round(ln(1 + q * (exp(e0 + 2 * ln(1 - {noise.DELTA} / q)) - 1)), 6) as exact, true as above, true as near from types""")
def prv_log_sampled(spark: SparkSession, d: str) -> DataFrame:
    """One Laplace release over a sample of each type's size against its closed form: never below, and within a hundredth."""
    t = _types(spark, d)
    log = t.select("event_type", F.lit("laplace").alias("mechanism"), F.col("e0").alias("epsilon"), F.lit(1.0).alias("sensitivity"), F.lit(None).cast("double").alias("sigma"), F.col("q").alias("sampling_rate"))
    exact = F.log1p(F.col("q") * F.expm1(F.col("e0") + 2 * F.log1p(-F.lit(noise.DELTA) / F.col("q"))))
    rows = prv.spent(log, by=["event_type"]).join(t, "event_type").withColumn("exact", exact)
    return rounded(rows.select("event_type", "exact", (F.col("prv") >= F.col("exact") - 1e-9).alias("above"), (F.col("prv") <= 1.01 * F.col("exact")).alias("near")))


@query("amplification_by_type", f"""with {_TYPES_SQL}
select event_type, n, e0 as epsilon, round(q, 9) as q, round(ln(1 + q * (exp(e0) - 1)), 9) as amplified, round(e0 / ln(1 + q * (exp(e0) - 1)), 6) as ratio from types""")
def amplification_by_type(spark: SparkSession, d: str) -> DataFrame:
    """What a budget is worth where a release sees a sample of each type's share."""
    rows = _types(spark, d).withColumn("amplified", accounting.amplified(F.col("e0"), F.col("q")))
    return rounded(rows.select("event_type", "n", F.col("e0").alias("epsilon"), "q", "amplified", (F.col("e0") / F.col("amplified")).alias("ratio")), 9, ratio=6)


@query("hockey_stick_by_type", f"""with {_TYPES_SQL}
select event_type, e as epsilon, round(greatest(0, 1 - exp((e - e0) / 2)), 9) as delta from types, {unnest('e', (0.0, 0.5, 1.0, 2.0))}""")
def hockey_stick_by_type(spark: SparkSession, d: str) -> DataFrame:
    rows = _types(spark, d).withColumn("epsilon", F.explode(F.array(*map(F.lit, (0.0, 0.5, 1.0, 2.0)))))
    return rounded(rows.select("event_type", "epsilon", accounting.hockey_stick_laplace(F.col("e0"), F.col("epsilon")).alias("delta")), 9)


@query("expected_error_by_type", f"""with {_TYPES_SQL}
select event_type, mechanism, round(case when mechanism = 'laplace' then spread / n / e0 else {GAUSS} * (spread / n) / e0 * sqrt(2 / pi()) end, 9) as error, round(exp(e0) / (1 + exp(e0)), 9) as max_accuracy
from types, (values ('laplace'), ('gaussian')) m(mechanism)""")
def expected_error_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Expected errors of the means of each type's values, and how well an attack on a pure release can do."""
    rows = _types(spark, d).withColumn("mechanism", F.explode(F.array(*map(F.lit, noise.MECHANISMS))))
    error, top = accounting.expected_error(F.col("mechanism"), F.col("spread") / F.col("n"), F.col("e0")), release.mia_bound(F.col("e0"))[0]
    return rounded(rows.select("event_type", "mechanism", error.alias("error"), top.alias("max_accuracy")), 9)


_DESCENT = (1.0, 3.63, 12.197)
_DESCENT_SQL = f"{_TYPES_SQL}, g as (select event_type, n, 16 as batch, 5 as epochs, floor(5 * n / 16)::bigint as steps, 16 / n as rate, * from types, {unnest('sigma', _DESCENT)})"


def _descent(spark: SparkSession, d: str) -> DataFrame:
    """Noisy descent over the rows of each type."""
    rows = _types(spark, d).select("event_type", "n", F.lit(16).alias("batch"), F.lit(5).alias("epochs"))
    return rows.withColumn("sigma", F.explode(F.array(*map(F.lit, _DESCENT))))


@query("descent_first_order_by_type", f"""with {_DESCENT_SQL},
e as (select event_type, n, sigma, g.steps, a, g.steps * (case when rate <= 0.1 or a * (a - 1) / (2 * sigma * sigma) >= {accounting.OVERFLOW} then rate * rate * a / (2 * sigma * sigma)
  else ln(pow(1 - rate, a) + rate * pow(1 - rate, a - 1) * exp((a - 1) / (sigma * sigma)) + rate * rate * exp(a * (a - 1) / (2 * sigma * sigma))) / (a - 1) end) + {LN} / (a - 1) as eps from g, {unnest('a', accounting.SGD_ALPHAS)})
select event_type, n, sigma, steps, round(min(eps), 6) as epsilon, arg_min(a, eps) as alpha from e group by all""")
def descent_first_order_by_type(spark: SparkSession, d: str) -> DataFrame:
    return rounded(accounting.sgd_spent(_descent(spark, d)).drop("batch", "epochs"))


@query("descent_sigma_by_type", f"""with {_TYPES_SQL}, g as (select event_type, n, e, 16 / n as rate, floor(5 * n / 16) as steps from types, {unnest('e', (0.5, 1.0, 5.0))})
select event_type, n, e as epsilon, round(min(case when e > {LN} / (a - 1) and rate <= 0.1 then sqrt(steps * (rate * rate * a / 2) / (e - {LN} / (a - 1))) end), 6) as sigma from g, {unnest('a', accounting.SGD_ALPHAS)} group by all""")
def descent_sigma_by_type(spark: SparkSession, d: str) -> DataFrame:
    rows = _types(spark, d).select("event_type", "n", F.lit(16).alias("batch"), F.lit(5).alias("epochs")).withColumn("epsilon", F.explode(F.array(*map(F.lit, (0.5, 1.0, 5.0)))))
    return rounded(accounting.sigma_for(rows).drop("batch", "epochs"))


@query("descent_bound_by_type", f"""with {_DESCENT_SQL},
t as (select event_type, sigma, g.steps, a, lgamma(a + 1) - case when k = 0 then 0 else lgamma(k + 1) end - case when k = a then 0 else lgamma(a - k + 1) end
  + (a - k) * ln(1 - rate) + k * ln(rate) + (k * k - k) / (2 * sigma * sigma) as t from (select *, unnest(range(0, a + 1))::double as k from g, {unnest('a', accounting.WHOLE_ALPHAS)}) g),
m as (select *, max(t) over (partition by event_type, sigma, a) as m from t),
b as (select event_type, sigma, a, any_value(steps) * (any_value(m) + ln(sum(exp(t - m)))) / (a - 1) + {LN} / (a - 1) as eps from m group by event_type, sigma, a)
select event_type, sigma, round(min(eps), 6) as renyi, true as tighter from b group by all""")
def descent_bound_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The proven Renyi bound of noisy descent over the rows of each type, and whether loss distributions are tighter."""
    rows = _descent(spark, d).withColumns({"q": F.col("batch") / F.col("n"), "steps": F.floor(F.col("epochs") * F.col("n") / F.col("batch")).cast("long")})
    curves = rows.withColumn("alpha", F.explode(F.array(*map(F.lit, accounting.WHOLE_ALPHAS))))
    curves = curves.withColumn("rdp", F.col("steps") * accounting.rdp_gaussian_poisson(F.col("alpha"), F.col("q"), F.col("sigma")))
    renyi = accounting.best(curves, ["event_type", "sigma"]).select("event_type", "sigma", F.col("epsilon").alias("renyi"))
    log = rows.select("event_type", F.col("sigma").alias("s"), "steps", F.lit("gaussian").alias("mechanism"), F.lit(None).cast("double").alias("epsilon"), F.lit(1.0).alias("sensitivity"), "sigma", F.col("q").alias("sampling_rate"))
    losses = prv.spent(log, by=["event_type", "s"], count="steps").withColumnRenamed("s", "sigma")
    return rounded(prv.joined(renyi, losses, ["event_type", "sigma"]).select("event_type", "sigma", "renyi", (F.col("prv") < F.col("renyi")).alias("tighter")))


@query("mia_bound", f"select epsilon, round(exp(epsilon) / (1 + exp(epsilon)), 9) as max_accuracy, round((exp(epsilon) - 1) / (exp(epsilon) + 1), 9) as max_advantage from {unnest('epsilon', EPSILONS)}")
def mia_bound(spark: SparkSession, d: str) -> DataFrame:
    top, gap = release.mia_bound(F.col("epsilon"))
    return rounded(accounting.grid(spark, epsilon=list(EPSILONS)).select("epsilon", top.alias("max_accuracy"), gap.alias("max_advantage")), 9)


@query("ldp_theory", EVENTS.sql() + f""", g as (select feature, n, hi - lo as r, mechanism, epsilon from stats, (values ('laplace'), ('duchi'), ('piecewise')) m(mechanism), {unnest('epsilon', EPSILONS)})
select feature, mechanism, epsilon, round(case mechanism when 'laplace' then 2 * pow(r / epsilon, 2) / n when 'duchi' then pow((exp(epsilon) + 1) / (exp(epsilon) - 1) * r / 2, 2) / n
  else pow((exp(epsilon / 2) + 1) / (exp(epsilon / 2) - 1) * r / 2, 2) / n end, 4) as mse from g""")
def ldp_theory(spark: SparkSession, d: str) -> DataFrame:
    s = longform.stats(EVENTS.long(spark, d)).select("feature", F.col("n").cast("double").alias("n"), (F.col("hi") - F.col("lo")).alias("r"))
    rows = s.withColumn("mechanism", F.explode(F.array(*map(F.lit, release.LOCAL)))).withColumn("epsilon", F.explode(F.array(*map(F.lit, EPSILONS))))
    return rounded(rows.select("feature", "mechanism", "epsilon", noise.ldp_mse(F.col("mechanism"), F.col("r"), F.col("epsilon"), F.col("n")).alias("mse")), 4)
