"""What intake refuses, gates decide and sample rows are written as."""

import pytest
from pyspark.sql import functions as F
from tidepanel.operators import gates as G
from tidepanel.operators import intake as I
from tidepanel.operators import samples as S


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def test_merge_day(spark):
    q, f = "date string, stock_id string, close double", "date string, stock_id string, net double"
    universe = frame(spark, [("1101",), ("2330",)], "stock_id string")
    quotes = frame(spark, [("2024-01-02", "1101", 1.0), ("2024-01-02", "2330", 2.0), ("2024-01-02", "00878", 3.0), ("2024-01-02", "9999", 4.0)], q)
    flows = frame(spark, [(None, "1101", 5.0), (None, "9999", 6.0)], f)
    assert [tuple(r) for r in I.merge_day(quotes, flows, universe).collect()] == [("2024-01-02", "1101", 1.0, 5.0)]
    with pytest.raises(ValueError, match="no rows"):
        I.merge_day(quotes, flows.limit(0), universe)
    with pytest.raises(ValueError, match="both"):
        I.merge_day(quotes, frame(spark, [("2024-01-03", "1101", 5.0)], f), universe)
    with pytest.raises(Exception, match="quotes repeat 2024-01-02 1101"):
        I.merge_day(quotes.unionByName(quotes), flows, universe).collect()
    one = frame(spark, [("2024-01-02",)], "date string")
    assert [tuple(r) for r in I.two_sided(one, one.union(one)).collect()] == [("2024-01-02", 1, 2)]
    with pytest.raises(Exception, match="only one side has rows on 2024-01-02"):
        I.two_sided(one, one.limit(0)).collect()


def plan(spark, **changed):
    row = dict.fromkeys(I.PLAN_COLUMNS, "") | {"user_id": "u", "stock_id": "1101", "signal_date": "2024-01-02", "event_id": "e", "notification_type": "NEW_CANDIDATE", "eligible_for_future_github": "1.0", "ready_to_send": "TRUE", "trade_action": "TRACK_ONLY", "plan_valid_until": "2024-01-09"} | changed
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))


def test_read_plan(spark):
    day = lambda d: F.lit(d).cast("date")
    assert I.read_plan(plan(spark), day("2024-01-09")).count() == 1
    assert I.read_plan(plan(spark), day("2024-01-10")).count() == 0
    assert I.read_plan(plan(spark, ready_to_send="no", trade_action="BUY"), day("2024-01-09")).count() == 0
    for bad, said in ((plan(spark, trade_action="BUY"), "only track"), (plan(spark).union(plan(spark)), "plan rows repeat u e"), (plan(spark, plan_valid_until="soon"), "CAST_INVALID")):
        with pytest.raises(Exception, match=said):
            I.read_plan(bad, day("2024-01-09")).collect()
    with pytest.raises(ValueError, match="event_id"):
        I.read_plan(plan(spark).drop("event_id"), day("2024-01-09"))
    both = plan(spark, event_id="a", percentile="99").unionByName(plan(spark, event_id="b", percentile="1", notification_type="TWSE_TRACK_CONFIRMED"))
    assert {r["event_id"]: r["position"] for r in I.read_plan(both, day("2024-01-09")).collect()} == {"b": 1, "a": 2}


def test_markets_and_end_dates(spark):
    assert I.require_markets(frame(spark, [("twse",), ("tpex",), ("tpex",)], "market string")) == {"twse": 1, "tpex": 2}
    with pytest.raises(ValueError, match="tpex"):
        I.require_markets(frame(spark, [("twse",)], "market string"))
    status = frame(spark, [("*", "complete", "2024-09-09"), ("1101", "complete", "2024-02-02"), ("1102", "failed", "2024-03-03")], "stock_id string, status string, requested_end string")
    assert [I.frozen_end(a, s, t, "now") for a, s, t in (("a", "s", status), (None, "s", status), (None, None, status), (None, None, status.limit(0)))] == ["a", "s", "2024-02-02", "now"]


def test_gates(spark):
    rows = [(3, 2, 0.1, 0.1, 0.01), (2, 2, 0.1, 0.1, 0.01), (5, 2, 0.1, 0.1, 0.01), (3, 3, 0.1, 0.1, None), (3, 3, 0.1, -0.1, 0.01)]
    got = G.return_gate(frame(spark, rows, "years int, positive_years int, spread double, rank_correlation double, low double")).collect()
    assert [r["passed"] for r in got] == [True, False, False, False, False]
    events = [(rule, f"s{i % 40}", f"{year}-01-{i % 28 + 1:02d}", year, 0.02 if rule == "good" else -0.01) for rule in ("good", "bad", "unsure") for year in (2019, 2020, 2021, 2022, 2023) for i in range(40)]
    e = frame(spark, events, "rule string, stock_id string, date string, year int, excess double")
    low = frame(spark, [("good", 0.01), ("bad", 0.01)], "rule string, low double")
    got = {r["rule"]: (r["status"], r["events"], r["years"]) for r in G.rule_candidates(e, low, 2020).collect()}
    assert got == {"good": ("strong_candidate", 120, 3), "bad": ("not_selected", 120, 3), "unsure": ("not_selected", 120, 3)}


def test_names_and_specs():
    assert len(S.feature_names()) == len(set(S.feature_names())) == 40
    assert len(S.market_spec("tpex")["features"]) == 22 and S.market_spec("tpex")["features"][0] == "foreign_flow_pct_1d"
    with pytest.raises(ValueError, match="nasdaq"):
        S.market_spec("nasdaq")


def test_training_rows_are_written_by_market_and_year(spark, tmp_path):
    from tidepanel.sources.tables import write_partitioned

    rows = frame(spark, [("1101", 2020, True, 1.0), ("1101", 2021, False, 2.0), ("1102", 2021, True, 3.0)], "stock_id string, year int, eligible_10d boolean, x double").withColumn("market", F.lit("tpex"))
    for _ in range(2):  # a rerun replaces what it has made
        write_partitioned(S.training_rows(rows), f"{tmp_path}/t", ["market", "year"])
    assert sorted((r["stock_id"], r["year"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("1101", 2020), ("1102", 2021)]
