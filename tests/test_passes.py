"""Queries over the panel make it once: lines are dealt by security a single time, and pairs are not listed row by row."""

import builtins
import dis
import importlib
import math
import pkgutil
import types
from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidepanel
from tidepanel.operators import audit, features, returns, runs
from tidepanel.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["m01_sample_rows", "a11_correlations", "j23_long_horizons", "a36_common_cohort", "a41_quintiles", "a42_yearly_high_minus_low", "a43_overheat_grid", "a09_a10_feature_profiles", "a13_label_direction", "j19_a53_rule_star"])
def test_one_deal_of_the_lines(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().withCachedData().toString()
    assert plan.count("RepartitionByExpression") <= 1


def test_functions_know_the_names_they_use():
    """A query is made only when it is asked for; a name that its module lost is an error only then."""

    def read(code):
        yield from (i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL")
        for inner in code.co_consts:
            if isinstance(inner, types.CodeType):
                yield from read(inner)

    for m in pkgutil.walk_packages(tidepanel.__path__, "tidepanel."):
        module = importlib.import_module(m.name)
        with open(module.__file__) as f:
            unknown = {n for n in read(compile(f.read(), module.__file__, "exec")) if not hasattr(module, n) and not hasattr(builtins, n)}
        assert not unknown, (m.name, unknown)


def test_eligible_days_are_those_with_a_label(spark):
    got = {r["label"]: (r["n"], r["mean"]) for r in QUERIES["f16_horizon_eligibility"](spark, SF).collect()}
    days = [r for r in QUERIES["w23_forward_return_10"](spark, SF).collect() if r["label"]]
    assert got.keys() == {r["label"] for r in days} and len(got) == 3
    for kind, (n, mean) in got.items():
        own = [r["adjusted"] for r in days if r["label"] == kind]
        assert n == len(own) and mean == pytest.approx(sum(own) / n, abs=2e-6)


def test_pairs_of_features_are_not_rows(spark):
    plan = QUERIES["a11_correlations"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # the panel's days


def test_correlations_of_odd_numbers(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(1e6, 1.0, 900)
    rows = [(float(x), float(2 * x + rng.normal(0, 1e-3)), 0.1, None if i % 7 == 0 else float(-x), (math.inf, -math.inf, math.nan, float(x))[i % 4], float(x) if i < 50 else None) for i, x in enumerate(base)]
    names = list("abcdef")
    got = {(r["left"], r["right"]): r for r in audit.correlations(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5), names).collect()}
    want = {}
    x = np.array([[math.nan if v is None or not math.isfinite(v) else v for v in row] for row in rows])
    for i, j in combinations(range(6), 2):
        both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
        a, b = x[both, i], x[both, j]
        if both.sum() >= 100 and np.ptp(a) > 0 and np.ptp(b) > 0 and abs(np.corrcoef(a, b)[0, 1]) >= 0.995:
            want[names[i], names[j]] = (np.corrcoef(a, b)[0, 1], both.sum(), np.mean(np.abs(a - b) <= 1e-12))
    assert got.keys() == want.keys() and ("a", "e") in got and not any("c" in k or "f" in k for k in got)
    for k, (corr, n, equal) in want.items():
        assert (got[k]["corr"], got[k]["equal"]) == (pytest.approx(corr, abs=1e-9), equal) and got[k]["n"] == n
    assert audit.correlations(spark.createDataFrame([], "a double, b double"), ["a", "b"]).collect() == []


def test_listed_actions_are_resolved_as_rows_are(spark):
    days = [
        [("dividend", 95.0)], [("dividend", 95.0), ("split", 95.0)], [("dividend", 90.0), ("split", 50.0)], [("dividend", None)], [("dividend", 0.0), ("split", 7.0)],
        [("other", 4.0), (None, 4.0)], [("split", math.nan), ("dividend", 3.0)], [("dividend", -1.0)],
    ]
    stored = [("1", date(2024, 1, 1) + timedelta(i), [{"action_type": t, "reference_price": p} for t, p in a]) for i, a in enumerate(days)]
    listed = spark.createDataFrame([*stored, ("2", date(2024, 1, 1), None)], "stock_id string, date date, a array<struct<action_type string, reference_price double>>")
    rows = listed.select("stock_id", "date", F.explode("a").alias("x")).select("stock_id", "date", "x.*")
    of = lambda df: {(r["stock_id"], r["date"]): (str(r["reference"]), r["action_types"], r["conflict"]) for r in df.collect()}
    got = of(listed.withColumns(returns.resolved_list(F.col("a"))))
    assert got.pop(("2", date(2024, 1, 1))) == ("None", None, None)
    assert got == of(returns.resolved_actions(rows))


def test_median_and_zero_run_of_a_frame(spark):
    values = [0.0, None, 0.0, 5.0, math.nan, 0.0, 0.0, 2.0, math.inf, math.inf, -1.0, 0.0, None, None, None, None]
    df = spark.createDataFrame([("1", i, v) for i, v in enumerate(values)], "stock_id string, idx long, v double")
    w = features.trailing(4)
    got = df.select(features.trailing_median("v", 4).alias("m"), F.percentile("v", F.lit(0.5)).over(w).alias("p"), features.longest_zero_run("v", 4).alias("z")).orderBy("idx").collect()
    assert [str(r["m"]) for r in got] == [str(r["p"]) for r in got]
    assert [r["z"] for r in got] == [1, 1, 2, 2, 1, 1, 2, 2, 2, 1, 0, 1, 1, 1, 1, 0]


def test_a_high_day_ahead_is_a_row_of_the_runs(spark):
    scores = spark.createDataFrame([("1", i, 80.0 if i in (0, 1, 20, 22) else 10.0) for i in range(30)], "stock_id string, idx long, pct double")
    got = runs.runs(scores, "pct", 70).withColumn("ahead", runs.score_days_ahead("pct", 20)).where("ahead is not null").collect()
    assert [r["idx"] for r in got] == [0]
