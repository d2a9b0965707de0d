"""Marts over experiments, from made-up results with figures by hand."""

import json
import math

import numpy as np
import pytest

from veilframe.operators import experiments
from veilframe.plans import learning, marts
from veilframe.plans.bindings import rounded

ACCURACY = {"uniform": [0.50, 0.52, 0.51, 0.49, 0.53, 0.50], "mi": [0.60, 0.61, 0.59, 0.62, 0.63, 0.64], "sgd": [0.9, 0.9, 0.9, 0.9, 0.9, 0.9]}


@pytest.fixture()
def results(spark):
    rows = [("none", "logistic", "none", math.inf, 0, None, None, 10, 0.95, 0.94, 0.94, [0.9, 1.0])]
    for eps in (1.0, 5.0):
        for setting, values in ACCURACY.items():
            mechanism = "gaussian" if setting == "sgd" else "laplace"
            rows += [(setting, "logistic", mechanism, eps, i, None, None, 10, v + eps / 100, v - 0.1, v, [v, None]) for i, v in enumerate(values)]
        rows.append(("uniform", "logistic", "gaussian", eps, 0, None, None, 10, 0.3, 0.2, 0.2, [0.1, 0.2]))
    return spark.createDataFrame(rows, experiments.RESULT)


def test_summary_table(results):
    got = {(r.epsilon, r.method): r for r in learning.summary_table(results).collect()}
    assert set(got) == {(e, m) for e in (1.0, 5.0) for m in ("Input-Uniform", "Input-MI-Weighted", "DP-SGD")}
    for (eps, method), r in got.items():
        v = np.array(ACCURACY[{n: s for s, n in learning._METHOD_NAMES.items()}[method]])
        assert r.accuracy_mean == pytest.approx(v.mean() + eps / 100) and r.f1_mean == pytest.approx(v.mean() - 0.1)
        assert r.accuracy_ci95 == pytest.approx(1.96 * v.std() / math.sqrt(6)) and r.accuracy_loss_pct == pytest.approx(100 * (1 - v.mean() - eps / 100))
        if method == "Input-Uniform":
            assert r.wilcoxon_p_vs_uniform is None
        else:  # all six differences are positive: the smaller rank sum is 0
            z = -(6 * 7 / 4) / math.sqrt(6 * 7 * 13 / 24)
            assert r.wilcoxon_p_vs_uniform == pytest.approx(math.erfc(-z / math.sqrt(2)), abs=1e-6)


def test_summaries_and_recalls(results):
    means = {(r.setting, r.mechanism, r.epsilon): r for r in experiments.summarized(results).collect()}
    assert means["none", "none", math.inf].loss_pct == 0
    assert means["mi", "laplace", 1.0].loss_pct == pytest.approx(100 * (0.95 - 0.625) / 0.95)
    recalls = {(r.setting, r.epsilon): r for r in experiments.class_recalls(results, ("a", "b")).collect() if r.mechanism == "laplace"}
    assert recalls["mi", 5.0].acc_a == pytest.approx(0.615) and recalls["mi", 5.0].acc_b is None


def test_budget_accuracy_and_sections(results):
    one = marts.budget_accuracy(experiments.summarized(results))
    (r,) = one.collect()
    assert (r.max_eps, r.no_dp) == (5.0, 0.95) and r.uniform_max_eps == pytest.approx(np.mean(ACCURACY["uniform"]) + 0.05) and r.mi_max_eps == pytest.approx(0.665)
    nested = marts.nested(results.where("setting = 'mi' and run < 2"), "epsilon", ["run", "f1"], "runs")
    sections = {x.section: json.loads(x.body) for x in marts.json_sections({"budget": one, "runs": nested}).collect()}
    assert sections["budget"][0]["no_dp"] == 0.95
    assert [s["epsilon"] for s in sections["runs"]] == [1.0, 5.0] and [x["run"] for x in sections["runs"][0]["runs"]] == [0, 1]


def test_loose_results_have_no_test(spark, results):
    same = results.where("setting = 'uniform' and mechanism = 'laplace' and epsilon = 1.0")
    both = same.unionByName(same.selectExpr("'mi' as setting", *[c for c in results.columns if c != "setting"]))
    (r,) = experiments.compared(both).collect()
    assert (r.setting, r.n, r.delta_pp, r.p) == ("mi", 6, 0.0, 1.0)


def test_penalties_over_errors_rounded_to_nothing(spark):
    local = spark.createDataFrame([("v", 0.5, 0.6469), ("v", 4.0, 0.0809), ("w", 4.0, 0.0), ("w", 1.0, None)], "feature string, epsilon double, local_error double")
    central = spark.createDataFrame([("v", 0.5, 0.0003), ("v", 4.0, 0.0), ("w", 4.0, 0.0), ("w", 1.0, 0.0)], "feature string, epsilon double, central_error double")
    got = {(r.feature, r.epsilon): (r.penalty, r.penalty_db) for r in rounded(marts.penalties(local, central), 4, penalty=2, penalty_db=3).collect()}
    assert got["v", 0.5] == (2156.33, 33.337) and got["v", 4.0] == (math.inf, math.inf) and got["w", 1.0] == (None, None)
    assert math.isnan(got["w", 4.0][0]) and math.isnan(got["w", 4.0][1])
