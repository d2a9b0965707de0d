"""Queries over noisy releases, with keyed uniforms so that both engines draw the same noise."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import noise, scalars
from veilframe.operators import budget, longform, private, prv, release, sensitivity
from veilframe.plans import pipeline
from veilframe.plans.bindings import CUSTOMER, EVENTS, LINEITEM, ORDERS, Query, rounded, values
from veilframe.plans.privacy import GAUSS, unnest
from veilframe.plans.statistics import _WEIGHTS, _clipped_sql

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = 42


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def uniform(stream: str, key: str, seed: int = SEED) -> str:
    return f"((('0x' || substr(md5('{seed}|{stream}|' || {key}), 1, 12))::bigint + 0.5) / 281474976710656.0::double)"


def laplace(u: str, scale: str) -> str:
    return f"(-({scale}) * sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)))"


def gaussian(u1: str, u2: str, sigma: str) -> str:
    return f"(({sigma}) * sqrt(-2 * ln({u1})) * cos({2 * math.pi} * {u2}))"


_DRAWN = f"drawn as (select *, {uniform('u1', 'k')} as u1, {uniform('u2', 'k')} as u2, {uniform('u3', 'k')} as u3, {uniform('u4', 'k')} as u4 from keyed)"


@query("laplace_mean", ORDERS.sql() + f""", keyed as (select *, feature || '|' || e::varchar as k from stats, {unnest('e', (1, 2, 5))}), {_DRAWN}
select feature, e as epsilon, round(mean, 6) as mean, round(mean + {laplace('u1', '(hi - lo) / n / e')}, 6) as released from drawn""")
def laplace_mean(spark: SparkSession, d: str) -> DataFrame:
    return _noisy_mean(spark, d, "laplace")


@query("gaussian_mean", ORDERS.sql() + f""", keyed as (select *, feature || '|' || e::varchar as k from stats, {unnest('e', (1, 2, 5))}), {_DRAWN}
select feature, e as epsilon, round(mean, 6) as mean, round(mean + {gaussian('u1', 'u2', f'{GAUSS} * ((hi - lo) / n) / e')}, 6) as released from drawn""")
def gaussian_mean(spark: SparkSession, d: str) -> DataFrame:
    return _noisy_mean(spark, d, "gaussian")


def _noisy_mean(spark: SparkSession, d: str, mechanism: str) -> DataFrame:
    s = longform.stats(ORDERS.long(spark, d)).withColumn("epsilon", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))))
    rows = release.uniforms(s, F.concat_ws("|", "feature", F.col("epsilon").cast("string")), ["u1", "u2"], SEED)
    gs = sensitivity.global_of("mean", F.col("n"), F.col("lo"), F.col("hi"))
    out = F.col("mean") + noise.dp_noise(mechanism, gs, F.col("epsilon"), F.col("u1"), F.col("u2"))
    return rounded(rows.select("feature", "epsilon", "mean", out.alias("released")))


@query("exponential_mechanism", f"""with c as (select event_type, user_id % 20 as bucket, count(*) as n from events group by all),
s as (select bucket, event_type, 0.05::double * n / 2 - ln(-ln({uniform('u', "bucket::varchar || '|' || event_type")})) as s from c)
select bucket, arg_max(event_type, s) as event_type from s group by bucket""")
def exponential_mechanism(spark: SparkSession, d: str) -> DataFrame:
    """For each group of users a frequent event type, with little budget."""
    counts = EVENTS.wide(spark, d).groupBy("event_type", (F.col("user_id") % 20).alias("bucket")).agg(F.count("*").alias("n"))
    return release.choose(counts, "bucket", "event_type", F.col("n"), 1.0, 0.05, SEED)


@query("perturb_uniform", CUSTOMER.sql() + f""", {_clipped_sql([0.99])},
s as (select feature, c.tau, c.lo, 1.0 / (select count(distinct feature) from long) as eps from clipped c),
keyed as (select long.key, feature, x, tau, greatest(greatest(tau - lo, {sensitivity.FLOOR}), 1e-8) as sens, eps, feature || '|' || long.key as k from long join s using (feature)), {_DRAWN}
select key, feature, round(x, 6) as x, round(least(x, tau) + {laplace('u1', 'sens / eps')}, 6) as released from drawn""")
def perturb_uniform(spark: SparkSession, d: str) -> DataFrame:
    long = CUSTOMER.long(spark, d, key=True)
    return rounded(release.perturb(long, release.uniform_settings(long, 1.0), "laplace", SEED))


_ALLOCATED = "s as (select feature, eps, n, lo, hi, {tau} as tau from allocated join stats using (feature) {join} where method = '{method}' and eps_total = 1)"


@query("perturb_weighted", LINEITEM.sql() + f""", {_WEIGHTS}, {_ALLOCATED.format(tau='0', join='', method='mi')},
keyed as (select long.key, feature, x, hi - lo as sens, eps, feature || '|' || long.key as k from long join s using (feature)), {_DRAWN}
select feature, count(*) as n, round(avg(abs({gaussian('u1', 'u2', f'{GAUSS} * greatest(sens, 1e-8) / eps')})), 3) as mean_abs_error from drawn group by feature""")
def perturb_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian noise on every record, budgets by mutual information, sensitivities of the whole ranges."""
    long = LINEITEM.long(spark, d, key=True, label=True)
    eps = budget.allocate(budget.weights(budget.scores(long, ["mi"])), [1.0])
    got = release.perturb(long, release.weighted_settings(long, eps, "range"), "gaussian", SEED)
    return rounded(release.errors(got).select("feature", "n", "mean_abs_error"), 3)


@query("perturb_weighted_clipped", LINEITEM.sql() + f""", {_WEIGHTS}, {_clipped_sql([0.99])},
s as (select feature, eps, tau, c.lo from allocated join clipped c using (feature) where method = 'variance' and eps_total = 1),
keyed as (select long.key, feature, x, tau, tau - lo as sens, eps, feature || '|' || long.key as k from long join s using (feature)), {_DRAWN}
select feature, count(*) as n, round(avg(least(x, tau) + {laplace('u1', 'greatest(sens, 1e-8) / greatest(eps, 1e-6)')}), 3) as released_mean from drawn group by feature""")
def perturb_weighted_clipped(spark: SparkSession, d: str) -> DataFrame:
    """Laplace noise on clipped records, budgets by variance."""
    long = LINEITEM.long(spark, d, key=True, label=True)
    eps = budget.allocate(budget.weights(budget.scores(long, ["variance"])), [1.0])
    got = release.perturb(long, release.weighted_settings(long, eps), "laplace", SEED)
    return rounded(got.groupBy("feature").agg(F.count("*").alias("n"), F.avg("released").alias("released_mean")), 3)


_PARTS = ", ".join(f"(('0x' || substr(g, {10 * i + 1}, 10))::bigint + 0.5) / 1099511627776.0::double as u{i + 1}" for i in range(3))
_LOCAL_DRAWN = f"drawn as (select *, {_PARTS} from (select *, md5('{SEED}|local|' || k) as g from keyed))"
_EVENTS_KEYED = f"keyed as (select long.key, feature, x, lo, hi, n, mean, feature || '|' || long.key as k from long join stats using (feature)), {_LOCAL_DRAWN}, eps as (select * from {unnest('e', (0.5, 1.0, 4.0))})"
_DUCHI = "(case when u1 < (1 + (2 * (x - lo) / (hi - lo) - 1) * (exp(e) - 1) / (exp(e) + 1)) / 2 then 1 else -1 end * (exp(e) + 1) / (exp(e) - 1) + 1) / 2 * (hi - lo) + lo"
_PIECEWISE = """(case when u1 < exp(e / 2) / (exp(e / 2) + 1) then l + u3 * (c - 1) when u2 * (l + c + (c - (l + c - 1))) < l + c then -c + u3 * (l + c)
  else l + c - 1 + u3 * (c - (l + c - 1)) end + 1) / 2 * (hi - lo) + lo"""
_C = "(exp(e / 2) + 1) / (exp(e / 2) - 1)"


def _local(name: str, released: str, tables: str = "drawn, eps") -> str:
    return EVENTS.sql() + f", {_EVENTS_KEYED}, p as (select *, {_C} as c, ({_C} + 1) / 2 * (2 * (x - lo) / (hi - lo) - 1) - ({_C} - 1) / 2 as l from {tables}) " + (
        f"select key, e as epsilon, round({released}, 4) as released from p"
    )


def _reports(spark: SparkSession, d: str, mechanism: str) -> DataFrame:
    rows = release.local_reports(EVENTS.long(spark, d, key=True), (0.5, 1.0, 4.0), SEED, [mechanism])
    return rounded(rows.select("key", "epsilon", "released"), 4)


@query("ldp_laplace", _local("laplace", f"x + {laplace('u1', '(hi - lo) / e')}"))
def ldp_laplace(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d, "laplace")


@query("ldp_duchi", _local("duchi", _DUCHI))
def ldp_duchi(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d, "duchi")


@query("ldp_piecewise", _local("piecewise", _PIECEWISE))
def ldp_piecewise(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d, "piecewise")


_RUNS = release.RUNS


@query("ldp_experiment", EVENTS.sql() + f""", keyed as (select long.key, feature, x, lo, hi, n, mean, run, feature || '|' || long.key || '|' || run::varchar as k from long join stats using (feature), range({_RUNS}) r(run)), {_LOCAL_DRAWN},
eps as (select * from {unnest('e', (0.5, 1.0, 4.0))}),
p as (select *, {_C} as c, ({_C} + 1) / 2 * (2 * (x - lo) / (hi - lo) - 1) - ({_C} - 1) / 2 as l from drawn, eps),
r as (select feature, 'laplace' as mechanism, e, run, n, mean, hi - lo as r, x + {laplace('u1', '(hi - lo) / e')} as y from p
  union all select feature, 'duchi', e, run, n, mean, hi - lo, {_DUCHI} from p union all select feature, 'piecewise', e, run, n, mean, hi - lo, {_PIECEWISE} from p),
one as (select feature, mechanism, e, run, n::double as n, mean, r, avg(y) as estimate from r group by all),
g as (select feature, mechanism, e, n, mean, r, avg(estimate) as estimate, avg(abs(estimate - mean)) as abs_error, stddev_pop(abs(estimate - mean)) as std_error,
  case mechanism when 'laplace' then 2 * pow(r / e, 2) / n when 'duchi' then pow((exp(e) + 1) / (exp(e) - 1) * r / 2, 2) / n
  else pow({_C} * r / 2, 2) / n end as mse, 2 * pow(r / n / e, 2) as central from one group by all),
ck as (select feature, (hi - lo) / n as gs, e, feature || '|laplace|' || round(e * 1000)::bigint::varchar || '|' || run::varchar as k from stats, eps, range({_RUNS}) r(run)),
c as (select feature, e, avg(abs({laplace(uniform('u1', 'k'), 'gs / e')})) as central_error from ck group by all)
select feature, mechanism, e as epsilon, n::bigint as n, round(mean, 4) as mean, round(estimate, 4) as estimate, round(abs_error, 4) as abs_error, round(std_error, 4) as std_error, round(central_error, 4) as central_error,
  round(sqrt(mse), 4) as theoretical_rmse, round(sqrt(central), 4) as central_rmse, round(mse / central, 2) as penalty from g join c using (feature, e)""")
def ldp_experiment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(release.local_experiment(EVENTS.long(spark, d, key=True), (0.5, 1.0, 4.0), SEED), 4, penalty=2)


@query("randomized_response", f"""with e as (select event_id, (user_id % 7)::int as v, {uniform('u1', 'event_id::varchar')} as u1, {uniform('u2', 'event_id::varchar')} as u2 from events),
r as (select v, case when u1 < exp(1.0) / (exp(1.0) + 6) then v else (v + 1 + least(5, floor(u2 * 6))::int) % 7 end as r from e)
select v, r::int as reported, count(*) as n from r group by all""")
def randomized_response(spark: SparkSession, d: str) -> DataFrame:
    e = EVENTS.wide(spark, d).select("event_id", (F.col("user_id") % 7).cast("int").alias("v"))
    rows = release.uniforms(e, F.col("event_id"), ["u1", "u2"], SEED)
    reported = noise.randomized_response(F.col("v"), 7, F.lit(1.0), F.col("u1"), F.col("u2"))
    return rows.select("v", reported.alias("reported")).groupBy("v", "reported").agg(F.count("*").alias("n"))


@query("dp_aggregates", LINEITEM.sql() + f""", g as (select *, (hi - lo) / n as gs from stats, (values ('laplace'), ('gaussian')) m(mechanism), {unnest('e', (0.5, 1.0, 5.0))}, range(20) r(run)),
keyed as (select *, feature || '|' || mechanism || '|' || round(e * 1000)::bigint::varchar || '|' || run::varchar as k from g), {_DRAWN},
r as (select *, abs(case when mechanism = 'laplace' then {laplace('u1', 'gs / e')} else {gaussian('u1', 'u2', f'{GAUSS} * gs / e')} end) as post,
  abs((total + case when mechanism = 'laplace' then {laplace('u3', '(hi - lo) / e')} else {gaussian('u3', 'u4', f'{GAUSS} * (hi - lo) / e')} end) / n - mean) as agg from drawn)
select feature, mechanism, e as epsilon, round(gs, 9) as sensitivity, round(avg(post), 6) as post_mean_error, round(stddev_pop(post), 6) as post_std_error,
  round(avg(agg), 5) as agg_mean_error, round(stddev_pop(agg), 5) as agg_std_error, round(case when mechanism = 'laplace' then 2 * pow(gs / e, 2) else pow({GAUSS} * gs / e, 2) end, 6) as noise_variance
from r group by feature, mechanism, e, gs""")
def dp_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(release.aggregates(LINEITEM.long(spark, d), (0.5, 1.0, 5.0), 20, SEED), 6, sensitivity=9, agg_mean_error=5, agg_std_error=5)


@query("shuffled_mean", ORDERS.sql() + f""", keyed as (select long.key, feature, x, hi - lo as r, feature || '|' || long.key as k from long join stats using (feature)), {_DRAWN}
select feature, count(*) as n, round(avg(x), 4) as mean, round(avg(x + {laplace('u1', 'r')}), 4) as released_mean from drawn group by feature""")
def shuffled_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(release.shuffled_mean(ORDERS.long(spark, d, key=True), 1.0, SEED), 4)


#: Trials with and as many without the target.
_TRIALS = 800
_MIA = f"""g as (select feature, mean, (hi - lo) / n as s, mechanism, e, member, trial from stats, (values ('laplace'), ('gaussian')) m(mechanism), {unnest('e', (0.5, 1.0, 4.0))}, range(2) b(member), range({_TRIALS}) t(trial)),
keyed as (select *, feature || '|' || mechanism || '|' || round(e * 1000)::bigint::varchar || '|' || member::varchar || '|' || trial::varchar as k from g), {_DRAWN},
y as (select *, case when mechanism = 'laplace' then s / e else {GAUSS} * s / e end as b, case when member = 1 then mean else mean - s end
  + case when mechanism = 'laplace' then {laplace('u1', 's / e')} else {gaussian('u1', 'u2', f'{GAUSS} * s / e')} end as y from drawn),
l as (select *, round(case when mechanism = 'laplace' then -abs((y - mean) / b) + abs((y - (mean - s)) / b) else -pow((y - mean) / b, 2) / 2 + pow((y - (mean - s)) / b, 2) / 2 end, 9) as llr from y)"""


@query("llr", EVENTS.sql() + f", {_MIA} select mechanism, e as epsilon, member::int as member, trial::int as trial, round(llr, 6) as llr from l")
def llr(spark: SparkSession, d: str) -> DataFrame:
    """The log-likelihood ratio of every trial of the audit."""
    s = longform.stats(EVENTS.long(spark, d)).select("feature", "mean", sensitivity.global_of("mean", F.col("n"), F.col("lo"), F.col("hi")).alias("s"))
    rows = s
    for name, column in (("mechanism", F.array(F.lit("laplace"), F.lit("gaussian"))), ("epsilon", F.array(*map(F.lit, (0.5, 1.0, 4.0)))), ("member", F.array(F.lit(0), F.lit(1))), ("trial", F.sequence(F.lit(0), F.lit(_TRIALS - 1)))):
        rows = rows.withColumn(name, F.explode(column))
    key = F.concat_ws("|", "feature", "mechanism", F.round(F.col("epsilon") * 1000).cast("long").cast("string"), F.col("member").cast("string"), F.col("trial").cast("string"))
    rows = release.uniforms(rows, key, ["u1", "u2"], SEED)
    m, e, sens = F.col("mechanism"), F.col("epsilon"), F.col("s")
    scale = F.when(m == "laplace", sens / e).otherwise(noise.gaussian_sigma(sens, e))
    drawn = F.when(m == "laplace", noise.laplace(F.col("u1"), sens / e)).otherwise(noise.gaussian(F.col("u1"), F.col("u2"), noise.gaussian_sigma(sens, e)))
    out = F.col("mean") - sens
    seen = F.when(F.col("member") == 1, F.col("mean")).otherwise(out) + drawn
    ratio = release.log_density(m, seen, F.col("mean"), scale) - release.log_density(m, seen, out, scale)
    return rounded(rows.select("mechanism", "epsilon", "member", "trial", F.round(ratio, 9).alias("llr")))


_AUC = """c as (select mechanism, e, llr, count(*) filter (member = 1) as p, count(*) filter (member = 0) as q from l group by all),
w as (select mechanism, e, p * (coalesce(sum(q) over (partition by mechanism, e order by llr rows between unbounded preceding and 1 preceding), 0) + q / 2.0) as won, p, q from c),
a as (select mechanism, e, sum(won) / (sum(p)::double * sum(q)) as auc from w group by all),
h as (select feature, mechanism, e, avg(((llr > 0) = (member = 1))::int::double) as acc from l group by all)"""


@query("mia", EVENTS.sql() + f""", {_MIA}, {_AUC}
select feature, mechanism, e as epsilon, round(acc, 6) as accuracy, round(2 * acc - 1, 6) as advantage, round(auc, 6) as auc, round(exp(e) / (1 + exp(e)), 6) as max_accuracy,
  round((exp(e) - 1) / (exp(e) + 1), 6) as max_advantage, round(exp(e) / (1 + exp(e)) - acc, 6) as margin from h join a using (mechanism, e)""")
def mia(spark: SparkSession, d: str) -> DataFrame:
    s = longform.stats(EVENTS.long(spark, d))
    means = s.select("feature", "mean", sensitivity.global_of("mean", F.col("n"), F.col("lo"), F.col("hi")).alias("sensitivity"))
    return rounded(release.mia(means, (0.5, 1.0, 4.0), _TRIALS, SEED))


_TAIL = "list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)) for i in range(h, n + 1)])"


@query("mia_judged", EVENTS.sql() + f""", {_MIA}, {_AUC},
t as (select feature, mechanism, e, round(acc * {2 * _TRIALS})::bigint as hits from h),
ends as (select feature, mechanism, e, side, case side when 1 then hits else {2 * _TRIALS} - hits end as h, {2 * _TRIALS}::bigint as n from t, (values (1), (-1)) s(side)),
b as (with recursive b as (select *, 0.0::double as lo, h / n as hi, 0 as step from ends union all
  select feature, mechanism, e, side, h, n, case when low then p else lo end, case when low then hi else p end, step + 1
  from (select *, {_TAIL} < 0.025 as low from (select *, (lo + hi) / 2 as p from b where step < 40))) select * from b where step = 40),
x as (select feature, mechanism, e, max(case when side = 1 then lo end) as low, max(case when side = -1 then 1 - lo end) as high from b group by all),
m as (select *, (exp(e) + case when mechanism = 'gaussian' then {noise.DELTA} else 0 end) / (1 + exp(e)) as budget_bound, e / {GAUSS} / 2 / sqrt(2.0) as w from x),
z as (select *, 1 / (1 + {scalars.ERF_P} * w) as k from m)
select feature, mechanism, e as epsilon, hits, round(budget_bound, 6) as budget_bound,
  round(case when mechanism = 'gaussian' then 0.5 * (2 - ({" + ".join(f"{a} * pow(k, {i + 1})" for i, a in enumerate(scalars.ERF_A))}) * exp(-w * w)) else 1 - exp(-e / 2) / 2 end, 6) as mechanism_bound,
  round(low, 6) as low, round(high, 6) as high, case when low > budget_bound then 'VIOLATED' else 'VALID' end as status from z join t using (feature, mechanism, e)""")
def mia_judged(spark: SparkSession, d: str) -> DataFrame:
    """The audit with exact intervals, judged by the bounds of pure and of approximate budgets."""
    s = longform.stats(EVENTS.long(spark, d))
    means = s.select("feature", "mean", sensitivity.global_of("mean", F.col("n"), F.col("lo"), F.col("hi")).alias("sensitivity"))
    rows = release.judged(release.mia(means, (0.5, 1.0, 4.0), _TRIALS, SEED), _TRIALS)
    return rounded(rows.select("feature", "mechanism", "epsilon", "hits", "budget_bound", "mechanism_bound", "low", "high", "status"))


def _pipeline_sql(method: str) -> str:
    return LINEITEM.sql() + f""", {_WEIGHTS}, {_clipped_sql([0.99])},
s as (select feature, weight, eps, tau, c.lo from allocated join clipped c using (feature) where method = '{method}' and eps_total = 1),
keyed as (select long.key, feature, x, tau, greatest(greatest(tau - lo, {sensitivity.FLOOR}), 1e-8) as sens, eps, weight, feature || '|' || long.key as k from long join s using (feature)), {_DRAWN},
r as (select *, least(x, tau) + {laplace('u1', 'sens / greatest(eps, 1e-6)')} as y from drawn)
select feature, count(*) as n, round(any_value(weight), 9) as weight, round(any_value(eps), 9) as eps, round(any_value(tau), 6) as tau, round(avg(y), 3) as released_mean, round(avg(abs(y - x)), 3) as mean_abs_error from r group by feature"""


def _pipeline(method: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        made = pipeline.release_table(LINEITEM.wide(spark, d), LINEITEM.label, list(LINEITEM.features), 1.0, method, key=LINEITEM.key_column(), seed=SEED)
        return rounded(pipeline.checked(made), 9, tau=6, released_mean=3, mean_abs_error=3)

    return run


for _method in budget.METHODS:
    query(f"pipeline_{_method}", _pipeline_sql(_method))(_pipeline(_method))


#: Public bounds of a line item's values, and its labels.
_DOMAIN = (("l_discount", 0.0, 0.2), ("l_extendedprice", 0.0, 150000.0), ("l_quantity", 0.0, 64.0), ("l_tax", 0.0, 0.1))
_LABELS = ("A", "N", "R")
_BIN = "case when high > low then least({0} - 1, floor((x - low) / ((high - low) / {0}::double))) else 0 end"


def _private_sql(eps: float = 1.0, cells: int = private.CELLS, bins: int = longform.BINS) -> str:
    d = len(_DOMAIN)
    return LINEITEM.sql() + f""", {values('domain', ('feature', 'low', 'high'), _DOMAIN)},
v as (select key, label, feature, low, high, x as raw, least(greatest(x, low), high) as x from long join domain using (feature)),
pc as (select feature, {_BIN.format(cells)} as cell, count(*) as k from v group by all),
pe as (select feature, low, high, cell, coalesce(k, 0) as k from (select * from domain, range({cells}) r(cell)) left join pc using (feature, cell)),
pr as (select *, sum(k) over (partition by feature order by cell) as below, sum(k) over (partition by feature) as n from pe),
taus as (select feature, arg_max(low + (cell + 1) * (high - low) / {cells}, {0.1 * eps / d} * -abs(below - 0.99::double * n) / 2 - ln(-ln({uniform('u', "feature || '|990000|' || cell::varchar")}))) as tau from pr group by feature),
jc as (select feature, {_BIN.format(bins)} as bin, label, count(*) as n from v group by all),
jn as (select feature, low, high, bin, label, greatest(coalesce(n, 0) + {laplace(uniform('u', "feature || '|' || bin::varchar || '|' || label"), str(d / (0.1 * eps)))}, 0) as k
  from (select * from domain, range({bins}) r(bin), (values ('A'), ('N'), ('R')) l(label)) left join jc using (feature, bin, label)),
jm as (select feature, greatest(0, sum(case when k > 0 then k / n * ln(k * n / (nb * nl)) else 0 end)) as score
  from (select *, sum(k) over (partition by feature) as n, sum(k) over (partition by feature, bin) as nb, sum(k) over (partition by feature, label) as nl from jn) group by feature),
wf as (select feature, greatest(case when sum(score) over () > 0 then score / sum(score) over () else 1 / {d} end, 1 / (100 * {d}::double)) as w from jm),
wn as (select feature, w / sum(w) over () as weight from wf)"""


@query("pipeline_private", _private_sql() + f""",
keyed as (select v.key, feature, raw, v.low, v.x, tau, weight, {0.8}::double * weight as eps, greatest(tau - v.low, 1e-8) as sens, feature || '|' || v.key as k from v join taus using (feature) join wn using (feature)), {_DRAWN},
r as (select *, least(greatest(raw, low), tau) + {laplace('u1', 'sens / greatest(eps, 1e-6)')} as y from drawn)
select feature, count(*) as n, round(any_value(weight), 6) as weight, round(any_value(eps), 6) as eps, round(any_value(tau), 6) as tau, round(avg(y), 3) as released_mean, round(avg(abs(y - raw)), 3) as mean_abs_error from r group by feature""")
def pipeline_private(spark: SparkSession, d: str) -> DataFrame:
    """The release with thresholds and weights at a budget: nothing of the data comes for free."""
    return rounded(pipeline.checked(_private(spark, d)), 6, released_mean=3, mean_abs_error=3)


def _private(spark: SparkSession, d: str, mechanism: str = "laplace") -> pipeline.Release:
    domain = spark.createDataFrame(list(_DOMAIN), "feature string, low double, high double")
    return pipeline.release_private(LINEITEM.wide(spark, d), LINEITEM.label, domain, _LABELS, 1.0, "mi", mechanism, key=LINEITEM.key_column(), seed=SEED)


@query("pipeline_private_spent", f"select count(distinct f) * 3 as n_queries, 1.0::double as basic, true as within from (values {', '.join(f"('{f}')" for f, *_ in _DOMAIN)}) v(f), (select 1 from lineitem limit 1)")
def pipeline_private_spent(spark: SparkSession, d: str) -> DataFrame:
    """What that release spends, by basic composition and by loss distributions."""
    made = _private(spark, d)
    basic = made.log.agg(F.count("*").alias("n_queries"), F.sum("epsilon").alias("basic"))
    rows = basic.crossJoin(prv.spent(made.log).select("prv"))  # one row each
    return rounded(rows.select("n_queries", "basic", (F.col("prv") <= F.col("basic") + 1e-9).alias("within")))


_SWEEP = (0.1, 1.0, 5.0)


@query("pipeline_sweep", LINEITEM.sql() + f""", {_WEIGHTS},
r as (select *, row_number() over (partition by method, eps_total order by eps desc, feature) as r from allocated where eps_total in (0.1, 1.0, 5.0))
select method, eps_total, count(*) as n_features, string_agg(printf('%s=%.4f', feature, eps), ' | ' order by r) filter (r <= 3) as top_features, round(min(eps), 9) as min_eps, round(max(eps), 9) as max_eps,
  round(max(eps) / min(eps), 6) as ratio from r group by method, eps_total""")
def pipeline_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pipeline.sweep(LINEITEM.wide(spark, d), LINEITEM.label, list(LINEITEM.features), _SWEEP), 9, ratio=6)
