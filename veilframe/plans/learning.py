"""Queries over labelled data: splits, scores, metrics, tests, and training."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import runtime
from veilframe.functions import noise, scalars
from veilframe.operators import accounting, budget, experiments, grids, metrics, ml, prv, sensitivity
from veilframe.plans import privacy, statistics
from veilframe.plans.bindings import EVENTS, LINEITEM, PART, Query, rounded

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = 42
_KEY_SQL = f"concat_ws('|', {', '.join(f'{k}::varchar' for k in LINEITEM.key)})"
WEIGHTS = [round(math.sin(j + 1), 6) for j in range(64)]


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("stratified_split", f"""with r as (select event_id, event_type as y, row_number() over (partition by event_type order by md5('{SEED}|' || event_id)) as r, count(*) over (partition by event_type) as n from events)
select event_id, y, r <= greatest(1, floor(0.3 * n)) as test from r""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    rows = EVENTS.wide(spark, d).select("event_id", F.col("event_type").alias("y"))
    return ml.stratified_split(rows, F.col("event_id"), seed=SEED)


_SCORED = "s as (select user_id % 3 as model, (event_type = 'error')::int as y, (value > 60)::int as yhat, value from events)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    e = EVENTS.wide(spark, d)
    return e.select((F.col("user_id") % 3).alias("model"), (F.col("event_type") == "error").cast("int").alias("y"), (F.col("value") > 60).cast("int").alias("yhat"), "value")


@query("classification_metrics", f"""with {_SCORED},
c as (select model, count(*) as n, sum((y = yhat)::int)::double as hit, sum((y = 1 and yhat = 1)::int)::double as tp, sum((y = 0 and yhat = 1)::int)::double as fp, sum((y = 1 and yhat = 0)::int)::double as fn from s group by model)
select model, n, round(hit / n, 9) as accuracy, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 9) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 9) as recall,
  round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 9) as f1 from c""")
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.binary(metrics.confusion(_scored(spark, d), "y", "yhat", ["model"]), ["model"]), 9)


_CLASSED = "s as (select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as y, least(2, floor(l_quantity / 17))::int as yhat, l_linestatus as model from lineitem)"
_BY_CLASS = f"""with {_CLASSED}, g as (select distinct model, c::int as class from s, range(5) r(c)),
k as (select g.model, g.class, sum((y = class and yhat = class)::int)::double as tp, sum((y <> class and yhat = class)::int)::double as fp, sum((y = class and yhat <> class)::int)::double as fn
  from g join s on s.model = g.model group by g.model, g.class),
f as (select model, class, (tp + fn)::bigint as support, case when tp + fn > 0 then tp / (tp + fn) end as recall, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1 from k)"""


def _classed(spark: SparkSession, d: str) -> DataFrame:
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = LINEITEM.wide(spark, d).select(y.alias("y"), F.least(F.lit(2), F.floor(F.col("l_quantity") / 17)).cast("int").alias("yhat"), F.col("l_linestatus").alias("model"))
    return metrics.confusion(rows, "y", "yhat", ["model"])


@query("per_class_metrics", _BY_CLASS + " select model, class, support, round(recall, 9) as recall, round(f1, 9) as f1 from f")
def per_class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.per_class(_classed(spark, d), range(5), ["model"]), 9)


@query("macro_f1", _BY_CLASS + " select model, round(avg(f1), 9) as macro_f1 from f group by model")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.macro_f1(_classed(spark, d), range(5), ["model"]), 9)


@query("auc", f"""with {_SCORED}, r as (select model, y, rank() over (partition by model order by value) + (count(*) over (partition by model, value) - 1) / 2.0 as r from s),
c as (select model, count(*) filter (y = 1) as n_positive, count(*) filter (y = 0) as n_negative, sum(r) filter (y = 1) as ranks from r group by model)
select model, n_positive, n_negative, round((ranks - n_positive * (n_positive + 1) / 2.0) / (n_positive::double * n_negative), 9) as auc from c""")
def auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auc(_scored(spark, d), "value", F.col("y") == 1, ["model"]), 9)


@query("ci95", """select event_type, count(value) as n, round(avg(value), 6) as mean, round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) as sample_half, round(1.96 * stddev_pop(value) / sqrt(count(value)), 6) as population_half
from events group by event_type""")
def ci95(spark: SparkSession, d: str) -> DataFrame:
    e = EVENTS.wide(spark, d)
    a = metrics.ci95(e, "value", ["event_type"]).withColumnRenamed("half_width", "sample_half")
    b = metrics.ci95(e, "value", ["event_type"], sample=False).select("event_type", F.col("half_width").alias("population_half"))
    return rounded(a.join(b, "event_type"))


_ERF = " + ".join(f"{a} * pow(t, {i + 1})" for i, a in enumerate(scalars.ERF_A))


@query("wilcoxon", f"""with d as (select p_brand, p_partkey, p_retailprice - (1000 + 10 * p_size) as d from part),
r as (select p_brand, d, row_number() over (partition by p_brand order by abs(d), p_partkey)::double as r from d where d <> 0),
s as (select p_brand, count(*) as n, coalesce(sum(r) filter (d > 0), 0) as w_plus, coalesce(sum(r) filter (d < 0), 0) as w_minus from r group by p_brand),
z as (select *, (least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0) as z from s),
t as (select *, -abs(z) / sqrt(2.0) as w, 1 / (1 + {scalars.ERF_P} * abs(-abs(z) / sqrt(2.0))) as t from z)
select p_brand, n, w_plus, w_minus, round(z, 6) as z, round(case when n < 5 then 1 else least(1, 2 * 0.5 * (1 + sign(w) * (1 - ({_ERF}) * exp(-w * w)))) end, 6) as p from t""")
def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    rows = PART.wide(spark, d).withColumn("b", (1000 + 10 * F.col("p_size")).cast("double"))
    return rounded(metrics.wilcoxon(rows, "p_retailprice", "b", "p_partkey", ["p_brand"], ties="key"))


@query("wilcoxon_ties", f"""with d as (select l_returnflag, l_quantity - 25 as d from lineitem),
r as (select l_returnflag, d, rank() over (partition by l_returnflag order by abs(d)) + (count(*) over (partition by l_returnflag, abs(d)) - 1) / 2.0::double as r,
  count(*) over (partition by l_returnflag, abs(d))::double as t from d where d <> 0),
s as (select l_returnflag, count(*) as n, coalesce(sum(r) filter (d > 0), 0) as w_plus, coalesce(sum(r) filter (d < 0), 0) as w_minus, sum(t * t - 1) as ties from r group by l_returnflag),
z as (select *, (least(w_plus, w_minus) - n::double * (n + 1) / 4.0) / sqrt((n::double * (n + 1) * (2 * n + 1) - ties / 2) / 24.0) as z from s),
t as (select *, -abs(z) / sqrt(2.0) as w, 1 / (1 + {scalars.ERF_P} * abs(-abs(z) / sqrt(2.0))) as t from z)
select l_returnflag, n, w_plus, w_minus, round(z, 6) as z, round(least(1, 2 * 0.5 * (1 + sign(w) * (1 - ({_ERF}) * exp(-w * w)))), 6) as p from t""")
def wilcoxon_ties(spark: SparkSession, d: str) -> DataFrame:
    """Average ranks where nearly all magnitudes are equal to others: 50 different quantities."""
    rows = LINEITEM.wide(spark, d).withColumn("b", F.lit(25.0))
    return rounded(metrics.wilcoxon(rows, "l_quantity", "b", by=["l_returnflag"]))


@query("decibels", "select event_type, round(10 * log10(max(value) / avg(value)), 6) as db from events group by event_type")
def decibels(spark: SparkSession, d: str) -> DataFrame:
    rows = EVENTS.wide(spark, d).groupBy("event_type").agg(F.max("value").alias("a"), F.avg("value").alias("b"))
    return rounded(rows.select("event_type", metrics.decibels(F.col("a"), F.col("b")).alias("db")))


@query("score_linear", f"select vec_id, round(1 / (1 + exp(-greatest(-500, least(500, list_inner_product(embedding::double[], {WEIGHTS}::double[]) + 0.1)))), 6) as p from embeddings")
def score_linear(spark: SparkSession, d: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return rounded(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", ml.logistic(x, WEIGHTS, 0.1).alias("p")))


@query("softmax", """with e as (select vec_id, [x::double for x in embedding] as s from embeddings), m as (select *, list_max(s) as m, list_sum([exp(x - list_max(s)) for x in s]) as t from e)
select vec_id, i::int - 1 as class, round(exp(s[i] - m) / t, 6) as p from (select *, unnest(range(1, len(s) + 1)) as i from m)""")
def softmax(spark: SparkSession, d: str) -> DataFrame:
    s = F.transform("embedding", lambda v: v.cast("double"))
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode(scalars.softmax(s)).alias("class", "p"))
    return rounded(rows)


@query("gradient_clip", """with e as (select vec_id, [x::double for x in embedding] as g from embeddings), n as (select *, sqrt(list_sum([x * x for x in g])) + 1e-10 as n from e)
select vec_id, i::int - 1 as place, round(n, 5) as norm, round(g[i] * least(1, 0.5 / n), 5) + 0 as clipped from (select *, unnest(range(1, len(g) + 1)) as i from n)""")
def gradient_clip(spark: SparkSession, d: str) -> DataFrame:
    g = F.transform("embedding", lambda v: v.cast("double"))
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", g.alias("g"))
    length = F.sqrt(scalars.dot(F.col("g"), F.col("g")))
    return rounded(rows.select("vec_id", length.alias("norm"), F.posexplode(ml.clipped_gradient(F.col("g"), 0.5)).alias("place", "clipped")), 5)


def _flag(classes: int) -> Column:
    return F.when(F.col("l_returnflag") == "R", 1).otherwise(0) if classes == 2 else F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)


def _training(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Training and test rows of the line items, standardised on the training rows."""
    features = list(LINEITEM.features)
    # written once: the means and both parts read it
    split = runtime.materialize(experiments.sample(LINEITEM.wide(spark, d), features, _flag(2), LINEITEM.key_column(), None, SEED), "split")
    both = ml.vectors(ml.standardized(split, features, ~F.col("test")), features, F.col("key"))
    return both.where("not test").drop("test"), both.where("test").drop("test"), features


def _baselines(spark: SparkSession, d: str, labels: dict[int, Column]) -> dict[int, DataFrame]:
    """Confusion of the model without noise over all line items for each label, by its number of classes.

    For several labels rows and their keys' hashes are written once; for one, hashing again took less time than writing.
    """
    features, names = list(LINEITEM.features), {c: f"y{c}" for c in labels}
    rows = ml.prepared(LINEITEM.wide(spark, d).withColumns({names[c]: y for c, y in labels.items()}), features, F.lit(0))
    with runtime.scratch(spark) as kept:
        held = ml.hashed(rows, LINEITEM.key_column(), SEED).select(*features, *names.values(), "_h")
        held = kept.table(held, "hashed") if len(labels) > 1 else held
        split = lambda y: ml.stratified_split(held.select(*features, F.col(y).alias("y"), "_h").dropna(subset=["y"]), None)
        return {c: grids.baseline(split(y), features, c) for c, y in names.items()}


def _evaluated(counts: DataFrame, name: str) -> DataFrame:
    return metrics.binary(counts).select(F.lit(name).alias("model"), "n", "accuracy", "f1")


#: The experiments' sample as SQL.
_SAMPLE_SQL = f"(select * from lineitem order by md5('{SEED}|' || {_KEY_SQL}) limit {experiments.SAMPLE_ROWS})"


def _recursive(classes: int, source: str = "lineitem", label: str | None = None) -> str:
    """The data and 200 full gradient steps as SQL: w(step, w) with the weights of all classes one after the other."""
    features = LINEITEM.features
    y = label or ("(l_returnflag = 'R')::int" if classes == 2 else "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end")
    key = f"concat_ws('|', {', '.join(f'{k}::varchar' for k in LINEITEM.key)})"
    d, models = len(features) + 1, 1 if classes == 2 else classes
    scaled = ", ".join(f"({f} - avg({f}) filter (not test) over ()) / (stddev_pop({f}) filter (not test) over () + 1e-8) as x{j}" for j, f in enumerate(features))
    z = [" + ".join(f"w[{c * d + j + 1}] * x{j}" for j in range(d)) for c in range(models)]
    errors = ["1 / (1 + exp(-greatest(-500, least(500, z0)))) - y"] if classes == 2 else [f"exp(z{c} - m) / t - (y = {c})::int" for c in range(models)]
    penalty = lambda c, j: "" if j == d - 1 else f" + {ml.L2} * w[{c * d + j + 1}]" + (" / n" if classes == 2 else "")
    new = ", ".join(f"w[{c * d + j + 1}] - {ml.RATE} * (g[{c * d + j + 1}] / n{penalty(c, j)})" for c in range(models) for j in range(d))
    shift = "" if classes == 2 else f", greatest({', '.join(f'z{c}' for c in range(models))}) as m"
    total = "" if classes == 2 else ", " + " + ".join(f"exp(z{c} - m)" for c in range(models)) + " as t"
    return f"""with recursive r as (select {key} as key, {y} as y, {', '.join(f'{f}::double as {f}' for f in features)} from {source}),
o as (select *, row_number() over (partition by y order by md5('{SEED}|' || key)) as o, count(*) over (partition by y) as n from r),
s as (select *, o <= greatest(1, floor(0.3 * n)) as test from o),
data as materialized (select y, test, {scaled}, 1.0::double as x{d - 1} from s),
w(step, w) as (select 0, [{', '.join(['0.0::double'] * d * models)}] union all
  select step + 1, [{new}] from (
    select any_value(step) as step, any_value(w) as w, count(*)::double as n, [{', '.join(f'sum(e{c} * x{j})' for c in range(models) for j in range(d))}] as g from (
      select *, {', '.join(f'{e} as e{c}' for c, e in enumerate(errors))} from (select *{total} from (select *{shift} from (
        select w.step, w.w, data.*, {', '.join(f'{x} as z{c}' for c, x in enumerate(z))} from w, data where step < {ml.STEPS} and not test)))) having count(*) > 0)),
p as (select y, {', '.join(f'{x} as z{c}' for c, x in enumerate(z))} from data, (select w from w where step = {ml.STEPS}) where test)"""


@query("train_logistic", _recursive(2) + """, c as (select count(*) as n, sum((y = (z0 >= 0)::int)::int)::double as hit, sum((y = 1 and z0 >= 0)::int)::double as tp, sum((y = 0 and z0 >= 0)::int)::double as fp, sum((y = 1 and z0 < 0)::int)::double as fn from p)
select 'logistic' as model, n, round(hit / n, 6) as accuracy, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from c""")
def train_logistic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_evaluated(_baselines(spark, d, {2: _flag(2)})[2], "logistic"))


@query("train_softmax", _recursive(3) + """, g as (select y, case when z0 >= z1 and z0 >= z2 then 0 when z1 >= z2 then 1 else 2 end as yhat from p),
c as (select class::int as class, sum((y = class and yhat = class)::int)::double as tp, sum((y <> class and yhat = class)::int)::double as fp, sum((y = class and yhat <> class)::int)::double as fn from g, range(3) k(class) group by class)
select class, (tp + fn)::bigint as support, round(case when tp + fn > 0 then tp / (tp + fn) end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from c""")
def train_softmax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.per_class(_baselines(spark, d, {3: _flag(3)})[3], range(3)))


@query("train_private")
def train_private(spark: SparkSession, d: str) -> DataFrame:
    """Noisy gradient descent whose noise keeps its steps within a budget of 1 by a proven bound, and what it costs. Seeded, so that reruns agree."""
    train, test, features = _training(spark, d)
    steps, rate = ml.STEPS, 0.05
    sigma = accounting.poisson_sigma(rate, steps, 1.0)
    w = ml.train_private(train, len(features), sigma, rate, steps, rate=1.0, seed=SEED)
    counts = metrics.confusion(ml.predicted(test, w), "y", "yhat")
    return rounded(_evaluated(counts, "private").withColumn("sigma", F.lit(sigma)).withColumns({"epsilon": F.lit(accounting.poisson_epsilon(rate, sigma, steps)), "epsilon_by_losses": F.lit(prv.sampled_gaussian(rate, sigma, steps))}))


BUDGETS = (0.1, 0.5, 1.0, 5.0)
#: Runs a setting of each experiment.
RUNS, CLASS_RUNS, SGD_RUNS = 30, 10, 5


def _sample(spark: SparkSession, d: str, classes: int = 2) -> DataFrame:
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0) if classes == 2 else F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return runtime.materialize(experiments.sample(LINEITEM.wide(spark, d), list(LINEITEM.features), y, LINEITEM.key_column(), seed=SEED), "sample")


def _swept(spark: SparkSession, d: str, methods, mechanisms, runs: int, classes: int = 2) -> DataFrame:
    """Models on records with noise, by budget method, mechanism, total and run, beside the model without noise."""
    rows, features = _sample(spark, d, classes), list(LINEITEM.features)
    long = experiments.train_long(rows, features)
    weights = budget.weights(budget.scores(long, list(methods)))
    settings = experiments.noise_scales(long, weights, BUDGETS, features, mechanisms)
    settings = settings.unionByName(experiments.plain(rows))
    return experiments.trials(experiments.block(rows, features), settings, "logistic" if classes == 2 else "softmax", runs, classes, seed=SEED)


@query("sample_rows", f"""with o as (select {_KEY_SQL} as key, l_returnflag from lineitem order by md5('{SEED}|' || {_KEY_SQL}) limit {experiments.SAMPLE_ROWS}),
r as (select (l_returnflag = 'R')::int as y, row_number() over (partition by l_returnflag = 'R' order by md5('{SEED}|' || key)) as r, count(*) over (partition by l_returnflag = 'R') as n from o)
select y, r <= greatest(1, floor(0.3 * n)) as test, count(*) as n from r group by all""")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the experiments' sample by class and part."""
    return _sample(spark, d).groupBy("y", "test").agg(F.count("*").alias("n"))


def _baseline_sql(classes: int, source: str = _SAMPLE_SQL, label: str | None = None) -> str:
    guess = "(z0 >= 0)::int" if classes == 2 else "case when z0 >= z1 and z0 >= z2 then 0 when z1 >= z2 then 1 else 2 end"
    return _recursive(classes, source, label) + f""", g as (select y, {guess} as yhat from p),
c as (select class, sum((y = class and yhat = class)::int)::double as tp, sum((y <> class and yhat = class)::int)::double as fp, sum((y = class and yhat <> class)::int)::double as fn from g, range({classes}) k(class) group by class),
f as (select class, tp, fn, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1 from c)
select {classes}::int as classes, sum(tp + fn)::bigint as n, round(sum(tp) / sum(tp + fn), 6) as accuracy, round(max(f1) filter (class = 1), 6) as f1, round(avg(f1), 6) as macro_f1 from f"""


@query("dpml_baselines", f"select * from ({_baseline_sql(2)}) union all select * from ({_baseline_sql(3)})")
def dpml_baselines(spark: SparkSession, d: str) -> DataFrame:
    """The rows without noise of the sweeps: two and three classes."""
    out = []
    for classes in (2, 3):
        rows = _sample(spark, d, classes)
        got = experiments.trials(experiments.block(rows, list(LINEITEM.features)), experiments.plain(rows), "logistic" if classes == 2 else "softmax", 1, classes, seed=SEED)
        out.append(got.select(F.lit(classes).alias("classes"), "n", "accuracy", "f1", "macro_f1"))
    return rounded(out[0].unionByName(out[1]))


_TRAIN_SQL = f"""with o as (select *, (l_returnflag = 'R')::int as y from {_SAMPLE_SQL}),
r as (select *, row_number() over (partition by y order by md5('{SEED}|' || {_KEY_SQL})) as r, count(*) over (partition by y) as n from o),
train as (select * from r where r > greatest(1, floor(0.3 * n))), """


def _train_stats_sql() -> str:
    """The statistics of the training rows under the names that the SQL of weights and thresholds uses, with y as the label."""
    return _TRAIN_SQL + LINEITEM.sql().removeprefix("with ").replace("from lineitem", "from train").replace(f"{LINEITEM.label}::varchar as label", "y::varchar as label")


@query("dpml_scales", _train_stats_sql() + f""", {statistics._WEIGHTS}, {statistics._clipped_sql([0.99])},
t as (select a.method, m.mechanism, a.eps_total, a.feature, greatest(greatest(tau - c.lo, {sensitivity.FLOOR}), 1e-8) / greatest(a.eps, 1e-6) as b
  from (select method, feature, e as eps_total, e * weight as eps from weights, (select unnest({list(BUDGETS)}::double[]) as e)) a join clipped c using (feature), (values ('laplace'), ('gaussian')) m(mechanism))
select method as setting, mechanism, eps_total as epsilon, {", ".join(f"round(max(b * case when mechanism = 'gaussian' then {privacy.GAUSS} else 1 end) filter (feature = '{f}'), 4) as {f}" for f in LINEITEM.features)} from t group by all""")
def dpml_scales(spark: SparkSession, d: str) -> DataFrame:
    """The noise of each feature in the sweeps' grid, for all budget methods."""
    features = list(LINEITEM.features)
    long = runtime.materialize(experiments.train_long(_sample(spark, d), features), "long")
    rows = experiments.noise_scales(long, budget.weights(budget.scores(long)), BUDGETS, features)
    return rounded(rows.select("setting", "mechanism", "epsilon", *[F.col("scales")[i].alias(f) for i, f in enumerate(features)]), 4)


@query("dpsgd_settings", _TRAIN_SQL + f"""n as (select count(*) as n from train)
select e as epsilon, n as n_train, round(least(1, {experiments.BATCH} / n), 9) as rate, ({experiments.EPOCHS} * greatest(1, n // {experiments.BATCH}))::bigint as steps, true as kept, true as near, true as tighter
from n, (select unnest({list(BUDGETS)}::double[]) as e) where e > {math.log(1 / noise.DELTA) / (accounting.WHOLE_ALPHAS[-1] - 1)}""")
def dpsgd_settings(spark: SparkSession, d: str) -> DataFrame:
    """Steps and rate of noisy descent on the sample's training rows, and whether its noise keeps each budget: kept and by less than a
    thousandth missed by the Renyi bound, and less by loss distributions. Budgets that no noise keeps under that bound have no row."""
    n = _sample(spark, d).where("not test").count()
    rate, steps = min(1.0, experiments.BATCH / n), experiments.EPOCHS * max(1, n // experiments.BATCH)
    rows = []
    for e in BUDGETS:
        if sigma := accounting.poisson_sigma(rate, steps, e):
            spent = accounting.poisson_epsilon(rate, sigma, steps)
            spent = float(spent)
            rows.append((e, n, round(rate, 9), steps, spent <= e, spent >= 0.999 * e, prv.sampled_gaussian(rate, sigma, steps) < spent))
    return spark.createDataFrame(rows, "epsilon double, n_train long, rate double, steps long, kept boolean, near boolean, tighter boolean")


@query("dpml_sweep")
def dpml_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and F1 after input perturbation, by budget method, mechanism and total."""
    return rounded(experiments.summarized(_swept(spark, d, ("uniform", "mi"), noise.MECHANISMS, RUNS)))


@query("dpml_multiclass")
def dpml_multiclass(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, macro F1 and each class's recall of three classes."""
    results = _swept(spark, d, ("mi", "uniform"), ("laplace",), CLASS_RUNS, 3)
    return rounded(experiments.summarized(results, "macro_f1").join(experiments.class_recalls(results, ("A", "N", "R")), ["setting", "mechanism", "epsilon"]))


@query("dpml_budget_comparison")
def dpml_budget_comparison(spark: SparkSession, d: str) -> DataFrame:
    """All four budget methods at equal totals, and each one's signed-rank test against the uniform one."""
    results = _swept(spark, d, budget.METHODS, ("laplace",), CLASS_RUNS)
    rows = experiments.summarized(results)
    return rounded(rows.join(experiments.compared(results).select("setting", "mechanism", "epsilon", "delta_pp", "p"), ["setting", "mechanism", "epsilon"], "left"))


def _sgd(spark: SparkSession, d: str) -> DataFrame:
    rows, features = _sample(spark, d), list(LINEITEM.features)
    one = experiments.block(rows, features)
    settings = accounting.grid(spark, setting=["sgd"], mechanism=["gaussian"], epsilon=list(BUDGETS)).withColumn("scales", F.array().cast("array<double>"))
    return experiments.trials(one, settings, "private", SGD_RUNS, seed=SEED).unionByName(experiments.trials(one, experiments.plain(rows), "logistic", 1, seed=SEED))


@query("dpsgd_experiment")
def dpsgd_experiment(spark: SparkSession, d: str) -> DataFrame:
    """Noisy gradient descent by total budget: noise, budget spent, accuracy and F1 beside the plain model."""
    results = _sgd(spark, d)
    spent = results.groupBy("setting", "mechanism", "epsilon").agg(F.max("sigma").alias("sigma"), F.max("spent").alias("spent"))
    return rounded(experiments.summarized(results).join(spent, ["setting", "mechanism", "epsilon"]))


# Grids over all rows: every step is one job for all models. The label is the revenue of a line item, high or not, or in three
# classes, which the features tell in part.

#: Runs a setting where all rows are trained on.
ALL_RUNS = 3
_HIGH, _PER_CLASS = 35_000.0, 25_000.0
_REVENUE_SQL = "(l_extendedprice::double * (1 - l_discount::double))"
_REVENUE_LABELS = {2: f"({_REVENUE_SQL} > {_HIGH})::int", 3: f"least(2, floor({_REVENUE_SQL} / {_PER_CLASS}))::int"}


def _revenue(classes: int) -> Column:
    revenue = F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))
    return (revenue > _HIGH).cast("int") if classes == 2 else F.least(F.lit(2), F.floor(revenue / _PER_CLASS)).cast("int")


def _all_rows(spark: SparkSession, d: str, classes: int = 2) -> DataFrame:
    """Features, y, the rows' own uniforms (u) and test: keys are read and hashed once, and what the hashes tell is written instead of them."""
    rows = ml.prepared(LINEITEM.wide(spark, d).withColumn("key", LINEITEM.key_column()), list(LINEITEM.features), _revenue(classes))
    held = ml.hashed(rows, F.col("key"), SEED).select(*LINEITEM.features, F.col("y").cast("int").alias("y"), grids.own_uniform(F.col("key")).alias("u"), "_h")
    return ml.stratified_split(runtime.materialize(held, "rows"), None)


def _swept_all(spark: SparkSession, d: str, methods, mechanisms, runs: int, classes: int = 2) -> DataFrame:
    """``_swept`` on all rows instead of the sample."""
    rows, features = _all_rows(spark, d, classes), list(LINEITEM.features)
    long = experiments.train_long(rows, features)
    settings = experiments.noise_scales(long, budget.weights(budget.scores(long, list(methods))), BUDGETS, features, mechanisms).unionByName(experiments.plain(rows))
    return grids.sweep(rows, features, settings, "logistic" if classes == 2 else "softmax", runs, classes, seed=SEED)


@query("grid_baselines", " union all ".join(f"select * from ({_baseline_sql(c, 'lineitem', label)})" for c, label in _REVENUE_LABELS.items()))
def grid_baselines(spark: SparkSession, d: str) -> DataFrame:
    """The rows without noise of grids over all rows: two and three classes."""
    out = [grids.scored(counts, c) for c, counts in _baselines(spark, d, {c: _revenue(c) for c in (2, 3)}).items()]
    return rounded(out[0].unionByName(out[1]))


@query("grid_sweep")
def grid_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and F1 after input perturbation of all rows, by budget method, mechanism and total."""
    return rounded(experiments.summarized(_swept_all(spark, d, ("uniform", "mi"), noise.MECHANISMS, ALL_RUNS)))


@query("grid_multiclass")
def grid_multiclass(spark: SparkSession, d: str) -> DataFrame:
    """The same for three classes and all budget methods, with each class's recall."""
    return rounded(classes_table(_swept_all(spark, d, budget.METHODS, ("laplace",), ALL_RUNS, 3), ("low", "middle", "high")))


@query("grid_descent")
def grid_descent(spark: SparkSession, d: str) -> DataFrame:
    """Noisy descent on all rows by total budget: noise, budget spent, accuracy and F1."""
    rows = _all_rows(spark, d)
    settings = accounting.grid(spark, setting=["sgd"], mechanism=["gaussian"], epsilon=list(BUDGETS)).withColumn("scales", F.array().cast("array<double>"))
    results = grids.sweep(rows, list(LINEITEM.features), settings, "private", SGD_RUNS, seed=SEED)
    return rounded(results.groupBy("epsilon").agg(
        F.count("*").alias("runs"), F.max("n").alias("n"), F.max("sigma").alias("sigma"), F.max("spent").alias("spent"), F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("accuracy_std"), F.avg("f1").alias("f1")
    ))


_METHOD_NAMES = {"uniform": "Input-Uniform", "mi": "Input-MI-Weighted", "sgd": "DP-SGD"}


def summary_table(results: DataFrame) -> DataFrame:
    """epsilon, method, accuracy and F1 with intervals, loss against a perfect model, and the signed-rank test against the uniform budget."""
    rows = results.where(F.col("mechanism").isin("laplace", "gaussian") & F.col("setting").isin(*_METHOD_NAMES))
    # input perturbation counts by its Laplace runs; noisy descent has one mechanism
    rows = rows.where((F.col("setting") == "sgd") | (F.col("mechanism") == "laplace")).withColumn("mechanism", F.lit("any"))
    means = experiments.summarized(rows.unionByName(results.where("mechanism = 'none'"))).where("mechanism <> 'none'")
    tests = experiments.compared(rows).select("setting", "epsilon", "p")
    method = F.element_at(F.create_map(*[F.lit(x) for pair in _METHOD_NAMES.items() for x in pair]), F.col("setting"))
    return means.join(tests, ["setting", "epsilon"], "left").select(
        "epsilon", method.alias("method"), F.col("accuracy").alias("accuracy_mean"), F.col("accuracy_ci").alias("accuracy_ci95"), F.col("f1").alias("f1_mean"), F.col("f1_ci").alias("f1_ci95"),
        (100 * (1 - F.col("accuracy"))).alias("accuracy_loss_pct"), F.col("p").alias("wilcoxon_p_vs_uniform"),
    )


@query("mart_dpml_summary")
def mart_dpml_summary(spark: SparkSession, d: str) -> DataFrame:
    """Input perturbation and noisy gradient descent side by side."""
    swept = _swept(spark, d, ("uniform", "mi"), ("laplace",), RUNS)
    return rounded(summary_table(swept.unionByName(_sgd(spark, d).where("mechanism <> 'none'"))), 4)


def significance_table(results: DataFrame) -> DataFrame:
    """A row a budget: each method's accuracy, its test against the uniform one, and the difference in points."""
    means = results.where("mechanism <> 'none'").groupBy("epsilon", "setting").agg(F.avg("accuracy").alias("accuracy"))
    rows = means.join(experiments.compared(results).select("epsilon", "setting", "p", "delta_pp"), ["epsilon", "setting"], "left")
    pick = lambda m, c: F.max(F.when(F.col("setting") == m, F.col(c)))
    made = [pick("uniform", "accuracy").alias("uniform_accuracy")]
    for m in (m for m in budget.METHODS if m != "uniform"):
        made += [pick(m, "accuracy").alias(f"{m}_accuracy"), pick(m, "p").alias(f"{m}_vs_uniform_p"), pick(m, "delta_pp").alias(f"{m}_delta_accuracy_pp")]
    return rows.groupBy("epsilon").agg(*made)


def classes_table(results: DataFrame, names: Sequence[str]) -> DataFrame:
    """Overall accuracy, macro F1, loss and each class's recall by budget."""
    rows = experiments.summarized(results, "macro_f1").join(experiments.class_recalls(results, names), ["setting", "mechanism", "epsilon"])
    return rows.select("epsilon", F.col("setting").alias("budget_method"), F.col("accuracy").alias("overall_accuracy"), "macro_f1", F.col("loss_pct").alias("acc_loss_pct"), *[f"acc_{n}" for n in names])


@query("mart_budget_significance")
def mart_budget_significance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(significance_table(_swept(spark, d, budget.METHODS, ("laplace",), CLASS_RUNS)), 4)


@query("mart_multiclass")
def mart_multiclass(spark: SparkSession, d: str) -> DataFrame:
    return rounded(classes_table(_swept(spark, d, ("mi", "uniform"), ("laplace",), CLASS_RUNS, 3), ("A", "N", "R")), 4)


# The same marts over a table of results that SQL can make too: shares of the line items stand for accuracies.


def _given(spark: SparkSession, d: str) -> DataFrame:
    """Results by setting, mechanism, budget and run, from sums of whole hundredths."""
    rows = LINEITEM.wide(spark, d).where("l_linenumber <= 6").select(
        F.element_at(F.array(*map(F.lit, (*budget.METHODS, "sgd"))), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("setting"),
        F.element_at(F.array(*map(F.lit, (0.5, 1.0, 5.0))), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("epsilon"), (F.col("l_partkey") % 12).cast("int").alias("run"),
        F.round(F.col("l_discount") * 100).cast("long").alias("a"), F.round(F.col("l_tax") * 100).cast("long").alias("b"), F.col("l_quantity").cast("long").alias("c"),
    )
    mean = lambda c: F.sum(c).cast("double") / F.count("*")
    some = rows.groupBy("setting", "epsilon", "run").agg(F.count("*").alias("n"), (0.5 + mean("a") / 25).alias("accuracy"), (0.3 + mean("b") / 20).alias("f1"), (mean("c") / 60).alias("macro_f1"))
    some = some.withColumn("recalls", F.array(F.col("accuracy") / 2, F.when(F.col("run") % 4 > 0, F.col("f1"))))
    none = spark.range(1).select(F.lit("none").alias("setting"), F.lit(math.inf).alias("epsilon"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("n"), F.lit(0.95).alias("accuracy"), F.lit(0.94).alias("f1"), F.lit(0.93).alias("macro_f1"), F.array(F.lit(0.9), F.lit(0.8)).alias("recalls"))
    mechanism = F.when(F.col("setting") == "none", "none").when(F.col("setting") == "sgd", "gaussian").otherwise("laplace")
    return some.unionByName(none).select("setting", F.lit("logistic").alias("model"), mechanism.alias("mechanism"), "epsilon", "run", F.lit(None).cast("double").alias("sigma"), F.lit(None).cast("double").alias("spent"), "n", "accuracy", "f1", "macro_f1", "recalls")


_GIVEN_SQL = f"""i as (select ({list((*budget.METHODS, "sgd"))})[l_suppkey % 5 + 1] as setting, ([0.5, 1.0, 5.0]::double[])[l_linenumber % 3 + 1] as epsilon, l_partkey % 12 as run,
  round(l_discount * 100)::bigint as a, round(l_tax * 100)::bigint as b, l_quantity::bigint as c from lineitem where l_linenumber <= 6),
given as (select setting, case setting when 'sgd' then 'gaussian' else 'laplace' end as mechanism, epsilon, run, 0.5 + sum(a)::double / count(*) / 25 as accuracy, 0.3 + sum(b)::double / count(*) / 20 as f1, sum(c)::double / count(*) / 60 as macro_f1
  from i group by setting, epsilon, run),
pairs as (select g.setting, g.mechanism, g.epsilon, g.run, g.accuracy - u.accuracy as d from given g join given u on u.setting = 'uniform' and u.epsilon = g.epsilon and u.run = g.run where g.setting <> 'uniform'),
ranks as (select setting, epsilon, d, row_number() over (partition by setting, epsilon order by abs(d), run)::double as r from pairs where d <> 0),
sums as (select setting, epsilon, count(*) as n, coalesce(sum(r) filter (d > 0), 0) as plus, coalesce(sum(r) filter (d < 0), 0) as minus from ranks group by all),
zs as (select *, -abs((least(plus, minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0)) / sqrt(2.0) as w from sums),
ts as (select *, 1 / (1 + {scalars.ERF_P} * abs(w)) as t from zs),
tests as (select setting, epsilon, case when n < 5 then 1 else least(1, 2 * 0.5 * (1 + sign(w) * (1 - ({_ERF}) * exp(-w * w)))) end as p from ts),
delta as (select setting, epsilon, 100 * avg(d) as delta_pp from pairs where mechanism = 'laplace' group by all)"""
_NAMES_SQL = " ".join(f"when '{m}' then '{n}'" for m, n in _METHOD_NAMES.items())


@query("given_dpml_summary", f"""with {_GIVEN_SQL},
m as (select epsilon, setting, case setting {_NAMES_SQL} end as method, avg(accuracy) as a, 1.96 * stddev_pop(accuracy) / sqrt(count(*)) as ac, avg(f1) as f, 1.96 * stddev_pop(f1) / sqrt(count(*)) as fc from given where setting in {tuple(_METHOD_NAMES)} group by all)
select m.epsilon, method, round(a, 4) as accuracy_mean, round(ac, 4) as accuracy_ci95, round(f, 4) as f1_mean, round(fc, 4) as f1_ci95, round(100 * (1 - a), 4) as accuracy_loss_pct,
  case when m.setting <> 'uniform' then round(coalesce(p, 1), 4) end as wilcoxon_p_vs_uniform from m left join tests t on t.setting = m.setting and t.epsilon = m.epsilon""")
def given_dpml_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary_table(_given(spark, d)), 4)


@query("given_budget_significance", f"""with {_GIVEN_SQL}
select g.epsilon, round(avg(accuracy) filter (g.setting = 'uniform'), 4) as uniform_accuracy,
  {", ".join(f"round(avg(accuracy) filter (g.setting = '{m}'), 4) as {m}_accuracy, round(coalesce(max(p) filter (g.setting = '{m}'), 1), 4) as {m}_vs_uniform_p, round(max(delta_pp) filter (g.setting = '{m}'), 4) as {m}_delta_accuracy_pp" for m in budget.METHODS if m != 'uniform')}
from given g left join tests t on t.setting = g.setting and t.epsilon = g.epsilon left join delta x on x.setting = g.setting and x.epsilon = g.epsilon where g.setting <> 'sgd' group by g.epsilon""")
def given_budget_significance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(significance_table(_given(spark, d).where("setting <> 'sgd'")), 4)


@query("given_multiclass", f"""with {_GIVEN_SQL}, every as (select setting, epsilon, run, accuracy, macro_f1, accuracy / 2 as r0, case when run % 4 > 0 then f1 end as r1 from given union all select 'none', 'Infinity'::double, 0, 0.95, 0.93, 0.9, 0.8)
select epsilon, setting as budget_method, round(avg(accuracy), 4) as overall_accuracy, round(avg(macro_f1), 4) as macro_f1, round(100 * (0.95 - avg(accuracy)) / 0.95, 4) as acc_loss_pct, round(avg(r0), 4) as acc_a, round(avg(r1), 4) as acc_b from every group by setting, epsilon""")
def given_multiclass(spark: SparkSession, d: str) -> DataFrame:
    return rounded(classes_table(_given(spark, d), ("a", "b")), 4)
