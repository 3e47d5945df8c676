"""Golden vectors and invariants of the panel operators."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidepanel.functions import parsing
from tidepanel.operators import costs, features, lifecycle, models, notify, panel, ranking, returns, runs
from tidepanel.sources import payloads

DAY0 = datetime.date(2024, 1, 1)
PANEL = "stock_id string, date date, idx long, present boolean, open double, high double, low double, close double, volume double, money double, foreign_net double, trust_net double, dealer_net double, total_net double"
ACTIONS = "stock_id string, date date, action_type string, reference_price double"


def day(i):
    return DAY0 + datetime.timedelta(days=i)


def prices(spark, pairs, stock="1101", net=None):
    rows = [(stock, day(i), i, o is not None, o, c, o, c, 1.0 if o else 0.0, 1.0 if o else 0.0, 0.0, 0.0, 0.0, float(net[i]) if net else 0.0) for i, (o, c) in enumerate(pairs)]
    return spark.createDataFrame(rows, PANEL)


def first(df):
    return df.orderBy("date").first()


def test_adjusted_return_golden(spark):
    p = prices(spark, [(1.0, 1.0), (100.0, 102.0), (97.0, 98.0), (98.5, 99.0)])
    a = spark.createDataFrame([("1101", day(2), "dividend", 97.0)], ACTIONS)
    got = first(returns.forward_returns(p, a, 3))
    assert got["raw"] == pytest.approx(-0.01) and got["adjusted"] == pytest.approx((102 / 100) * (98 / 97) * (99 / 98) - 1)
    assert got["action_types"] == '["dividend"]'


def test_forty_day_outcome(spark):
    p = prices(spark, [(100.0 + i, 100.0 + i) for i in range(45)])
    got = first(returns.forward_returns(p, spark.createDataFrame([], ACTIONS), 40))
    assert got["status"] == "ok" and got["label"] == "UP" and got["adjusted"] == pytest.approx(140 / 101 - 1)


def test_statuses_in_order(spark):
    p = prices(spark, [(10.0, 10.0), (None, None), (10.0, 10.0), (None, None), (10.0, 10.0), (10.0, 10.0), (10.0, 10.0)])
    a = spark.createDataFrame([("1101", day(5), "split", -1.0)], ACTIONS)
    got = {r["date"]: r["status"] for r in returns.forward_returns(p, a, 2).collect()}
    assert [got[day(i)] for i in (0, 2, 4, 5, 6)] == ["unavailable_entry_price", "unavailable_entry_price", "ok", "insufficient_future_data", "insufficient_future_data"]
    conflict = spark.createDataFrame([("1101", day(6), "split", 5.0), ("1101", day(6), "dividend", 9.0)], ACTIONS)
    assert {r["date"]: r["status"] for r in returns.forward_returns(p, conflict, 2).collect()}[day(4)] == "invalid_data"
    gone = spark.createDataFrame([("1101", day(6))], "stock_id string, last_date date")
    assert {r["date"]: r["status"] for r in returns.forward_returns(p, a, 2, gone).collect()}[day(4)] == "delisted_before_target"


def test_label_rounding(spark):
    x = spark.createDataFrame([(v,) for v in (0.04999999996, -0.04999999996, 0.04999999994, -0.04999999994)], "v double")
    assert [r[0] for r in x.select(returns.label(F.col("v"))).collect()] == ["UP", "DOWN", "FLAT", "FLAT"]


def test_no_feature_looks_ahead(spark):
    rng = np.random.default_rng(3)
    net = rng.integers(-5, 6, 40).tolist()
    base = prices(spark, [(10.0, 10.0)] * 40, net=net)
    later = prices(spark, [(10.0, 10.0)] * 30 + [(99.0, 1.0)] * 10, net=net[:30] + [500] * 10)
    cols = ["date", features.flow_share("total_net", 20).alias("a"), features.buy_day_ratio("total_net", 5).alias("b"), features.longest_zero_run("volume", 20).alias("c"), features.acceleration().alias("d")]
    a, b = ([tuple(r) for r in p.select(*cols).where("idx < 30").orderBy("date").collect()] for p in (base, later))
    assert a == b


def test_streak_and_zero_run(spark):
    p = prices(spark, [(1.0, 1.0)] * 8, net=[1, 2, 0, -1, -2, -3, 4, 0])
    assert [r["streak"] for r in features.signed_streak(p, "total_net").orderBy("idx").collect()] == [1, 2, 0, -1, -2, -3, 1, 0]
    z = prices(spark, [(1.0, 1.0), (None, None), (None, None), (None, None), (1.0, 1.0), (None, None)])
    assert [r[0] for r in z.select(features.longest_zero_run("volume", 4).alias("r"), "idx").orderBy("idx").collect()] == [0, 1, 2, 3, 3, 2]


def test_cost_band_golden(spark):
    rows = [("1", day(i), 11.0, 9.0, 10.0, 100.0 if i == 0 else 0.0) for i in range(19)] + [("1", day(19), 22.0, 18.0, 20.0, 300.0)]
    c = spark.createDataFrame(rows, "stock_id string, date date, high double, low double, close double, net double")
    got = c.withColumns(costs.cost_band("net", 20)).orderBy(F.desc("date")).first()
    assert (got["cost_low"], got["cost_mid"], got["cost_high"], got["buy_days"]) == (15.75, 17.5, 19.25, 2)
    assert got["deviation"] == pytest.approx(100 * (20 / 17.5 - 1))


def test_runs_break_on_missing_days(spark):
    s = spark.createDataFrame([("1", i, 95.0) for i in (1, 2, 4, 5, 6)] + [("2", i, 95.0) for i in (1, 3, 4)], "stock_id string, idx long, score double")
    got = runs.runs(s, "score", 90).orderBy("stock_id", "idx").collect()
    assert [r["run_length"] for r in got] == [1, 2, 1, 2, 3, 1, 1, 2]


def test_cooldowns(spark):
    e = spark.createDataFrame([("1", i, i) for i in (1, 5, 12)] + [("2", 2, 2)], "stock_id string, idx long, episode_end long")
    kept = lambda days, end: sorted((r["stock_id"], r["idx"]) for r in runs.cooled(e, days, end).collect())
    assert kept(10, False) == [("1", 1), ("1", 12), ("2", 2)] and kept(0, False) == [("1", 1), ("1", 5), ("1", 12), ("2", 2)]
    long = spark.createDataFrame([("1", 1, 8), ("1", 12, 12), ("1", 20, 20)], "stock_id string, idx long, episode_end long")
    assert sorted(r["idx"] for r in runs.cooled(long, 10, True).collect()) == [1, 20]


def test_percentiles_under_ties(spark):
    s = spark.createDataFrame([("d", str(i), v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 4.0])] + [("e", "0", 1.0)], "date string, stock_id string, v double")
    got = s.select("date", "stock_id", ranking.percentile_share("v").alias("a"), ranking.percentile_span("v").alias("b"), ranking.percentile_first("v").alias("c")).orderBy("date", "stock_id").collect()
    assert [round(r["a"], 6) for r in got] == [20, 40, 60, 90, 90, 100]
    assert [r["b"] for r in got] == [0, 25, 50, 87.5, 87.5, 50] and [r["c"] for r in got] == [0, 25, 50, 75, 100, 100]


def test_daily_spread_golden(spark):
    rows = [(d, str(i), 10.0 * (i + 1), 0.02 * i - 0.08) for d in ("a", "b") for i in range(10)]
    s = spark.createDataFrame(rows, "date string, stock_id string, p double, r double")
    assert [round(r["spread"], 9) for r in ranking.daily_spread(s, "p", "r", 20).collect()] == [0.16, 0.16]


def test_lifecycle_golden(spark):
    track = lifecycle.steps(lifecycle.track_day, lifecycle.State(), dict.fromkeys(range(45), 95.0), range(45))
    assert track == [(2, "TWSE_TRACK_CONFIRMED", 2), (42, "TWSE_DAY40_END", 2)]
    days = {i: 95.0 for i in range(70)}
    assert lifecycle.steps(lifecycle.layout_day, lifecycle.State(), days, range(70)) == [(0, "NEW_CANDIDATE", 0), (4, "LAYOUT_CONFIRMED", 0), (20, "DAY20_EXTEND_STRONG", 0), (40, "DAY40_END", 0), (61, "LAYOUT_CONFIRMED_DIRECT", 61)]
    steady = {i: 85.0 for i in range(30)}
    assert [k for _, k, _ in lifecycle.steps(lifecycle.layout_day, lifecycle.State(), steady, range(30))] == ["LAYOUT_CONFIRMED_DIRECT", "DAY20_EXTEND"]
    late = {0: 95.0} | {i: 85.0 for i in range(16, 30)}
    assert [k for _, k, _ in lifecycle.steps(lifecycle.layout_day_merged, lifecycle.State(), late, range(21))] == ["NEW_CANDIDATE", lifecycle.MERGED]
    none = lifecycle.steps(lifecycle.layout_day, lifecycle.State(), {0: 95.0}, range(25))
    assert none == [(0, "NEW_CANDIDATE", 0), (20, "DAY20_END_NO_SCORE", 0)]


def test_dispatch_limit(spark):
    rows = [("u", True, 1, True, "NEW_CANDIDATE", 2, 95.0, "tpex", "1", 5, "NEW_CANDIDATE", "k1"), ("u", True, 1, True, "HIGH_PRIORITY_NEW", 3, 0.0, "twse", "2", 5, "T", "k2"), ("u", True, 1, True, "STATE_UPDATE", 1, None, "tpex", "3", 5, "X", "k3"), ("v", False, 1, True, "NEW_CANDIDATE", 2, 95.0, "tpex", "1", 5, "N", "k4")]
    plan = spark.createDataFrame(rows, "user_id string, enabled boolean, max_new int, wants_updates boolean, class string, priority int, percentile double, market string, stock_id string, idx long, type string, state_key string")
    sent = spark.createDataFrame([("k9",)], "state_key string")
    assert [r["state_key"] for r in notify.dispatch(plan, sent).orderBy("position").collect()] == ["k2", "k3"]
    assert [r["state_key"] for r in notify.dispatch(plan, spark.createDataFrame([("k2",)], "state_key string")).orderBy("position").collect()] == ["k1", "k3"]


def test_ridge_and_platt_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = x @ [0.5, -1.0, 0.2] + 0.3 + rng.normal(size=400) * 0.1
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    w, b = models.ridge(rows, {n: F.col(n) for n in "abc"}, "y", 2.0)
    z = np.c_[x, np.ones(400)]
    want = np.linalg.solve(z.T @ z + np.diag([2.0, 2.0, 2.0, 0.0]), z.T @ y)
    assert np.allclose([*w, b], want)
    up = (rng.random(400) < 1 / (1 + np.exp(-(0.7 * x[:, 0] - 0.4)))).astype(int)
    slope, shift = models.platt(spark.createDataFrame([(float(a), int(u)) for a, u in zip(x[:, 0], up, strict=True)], "z double, y int"), "z", "y")
    p = 1 / (1 + np.exp(-(slope * x[:, 0] + shift)))
    assert abs((p - up).sum()) < 1e-3 and abs(((p - up) * x[:, 0]).sum()) < 1e-3


def test_bootstrap_is_deterministic_and_brackets(spark):
    s = spark.createDataFrame([("k", f"{i:02d}", float(i % 5)) for i in range(36)], "k string, m string, v double")
    a, b = (models.block_bootstrap(s.repartition(n), "k", "m", "v").first() for n in (1, 3))
    assert a == b and a["low"] < a["mean"] < a["high"]


def test_parsers(spark):
    texts = ["20240229", "1130229", "113/2/29", "2023-02-29", "2024-02-29 10:00", "x", "", None]
    t = spark.createDataFrame([(v,) for v in texts], "t string")
    leap = datetime.date(2024, 2, 29)
    assert [r[0] for r in t.select(parsing.market_date(F.col("t"))).collect()] == [leap, leap, leap, None, leap, None, None, None]
    n = spark.createDataFrame([(v,) for v in ("1,234.5", "+7", "--", "", None)], "t string")
    assert [r[0] for r in n.select(parsing.number(F.col("t"))).collect()] == [1234.5, 7.0, 0.0, 0.0, 0.0]
    h = spark.createDataFrame([("<td a='1'> x &amp; <b>y</b>\n z </td>",)], "t string")
    assert h.select(parsing.html_text(F.col("t"))).first()[0] == "x & y z"


def test_failed_payloads_have_no_rows(spark):
    p = spark.createDataFrame([("a", '{"stat": "no data", "fields": ["Code"], "data": [["1"]]}'), ("b", '{"fields": ["Code"], "data": [["2"]]}'), ("c", "junk"), ("d", None)], "id string, payload string")
    assert [tuple(r) for r in payloads.shredded(p, {"code": ["Code"]}).collect()] == [("b", "2")]


def test_panel_of_no_cells(spark):
    cells = spark.createDataFrame([], "stock_id string, date date, volume double, money double, open double, high double, low double, close double, foreign_net double, trust_net double, dealer_net double")
    assert panel.dense_panel(cells, panel.market_calendar(cells)).count() == 0


def test_panel_of_odd_cells(spark):
    cells = spark.createDataFrame([("b", day(2), 1.0), ("b", day(4), 2.0), ("a", day(1), 3.0), ("a", day(1), 4.0), ("c", None, 5.0), (None, day(3), 6.0)], "stock_id string, date date, close double")
    cells = cells.withColumns({c: F.col("close") for c in ("open", "high", "low", "volume", "money", "foreign_net", "trust_net", "dealer_net")})
    cal = panel.market_calendar(spark.createDataFrame([(day(i),) for i in range(1, 6)], "date date"))
    got = panel.dense_panel(cells, cal)
    assert sorted((r["stock_id"], r["idx"], r["close"]) for r in got.where("present").collect()) == [("a", 0, 3.0), ("a", 0, 4.0), ("b", 1, 1.0), ("b", 3, 2.0)]
    assert sorted((r["stock_id"] or "", r["idx"]) for r in got.where("not present and close is null and volume = 0 and total_net = 0").collect()) == [("", 2), ("", 3), ("", 4), *(("a", i) for i in range(1, 5)), ("b", 2), ("b", 4)]
    dealt = panel.dense_panel(cells.repartition("stock_id"), cal).withColumn("n", F.count("*").over(features.by_date()))
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(stock_id") == 1  # no join of the cells with a grid


def test_average_rank_counts_equal_values(spark):
    rows = spark.createDataFrame([(1, v) for v in (0.0, -0.0, None, None, 2.0, float("nan"), float("nan"))], "date int, x double")
    got = rows.withColumn("r", ranking.average_rank("x", ["date"]))
    assert sorted((str(r["x"]), r["r"]) for r in got.collect()) == [("-0.0", 3.5), ("0.0", 3.5), ("2.0", 5.0), ("None", 1.5), ("None", 1.5), ("nan", 6.5), ("nan", 6.5)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1  # one sort for both
