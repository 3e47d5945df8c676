"""Queries of costs and entry risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import costs as X
from tidepanel.operators.panel import dense_panel
from tidepanel.operators.quantiles import exact_quantiles
from tidepanel.plans.adapter import CTES, calendar, cells, with_ctes
from tidepanel.plans.core import query
from tidepanel.plans.feature_queries import r, rq
from tidepanel.plans.ranking_queries import ranked

_W = "(PARTITION BY stock_id ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _cost(net: str, price: str, n: int) -> str:
    w = _W.format(n - 1)
    return f"CASE WHEN count(*) OVER {w} = {n} AND sum(greatest({net}, 0)) OVER {w} > 0 THEN sum(greatest({net}, 0) * ({price})) OVER {w} / sum(greatest({net}, 0)) OVER {w} END"


CTES["band"] = (
    ("cells",),
    f"""SELECT *, CASE WHEN cost_mid > 0 THEN (close / cost_mid - 1) * 100 END AS deviation FROM (SELECT *, foreign_net + trust_net + dealer_net AS total_net,
  {_cost('foreign_net + trust_net + dealer_net', 'low', 20)} AS cost_low, {_cost('foreign_net + trust_net + dealer_net', '(high + low + close) / 3', 20)} AS cost_mid, {_cost('foreign_net + trust_net + dealer_net', 'high', 20)} AS cost_high,
  sum((foreign_net + trust_net + dealer_net > 0)::INTEGER) OVER {_W.format(19)}::BIGINT AS buy_days FROM cells)""",
)


def band(spark, d):
    c = cells(spark, d).withColumn("total_net", F.col("foreign_net") + F.col("trust_net") + F.col("dealer_net"))
    return c.withColumns(X.cost_band("total_net", 20))


@query("w21_m19_cost_band", with_ctes(("band",), f"SELECT stock_id, date, {rq('cost_low', 'cost_low')}, {rq('cost_mid', 'cost_mid')}, {rq('cost_high', 'cost_high')}, buy_days, {rq('deviation', 'deviation')} FROM band"))
def w21(spark, d):
    return band(spark, d).select("stock_id", "date", *[r(F.col(c), c) for c in ("cost_low", "cost_mid", "cost_high")], "buy_days", r(F.col("deviation"), "deviation"))


@query("w20_range_position", with_ctes(("cells",), f"SELECT stock_id, date, {rq(f'CASE WHEN count(*) OVER {_W.format(19)} = 20 AND max(high) OVER {_W.format(19)} > min(low) OVER {_W.format(19)} THEN (close - min(low) OVER {_W.format(19)}) / (max(high) OVER {_W.format(19)} - min(low) OVER {_W.format(19)}) END', 'position')} FROM cells"))
def w20(spark, d):
    return cells(spark, d).select("stock_id", "date", r(X.range_position(20), "position"))


@query("w19_next_open_and_change", with_ctes(("cells",), f"SELECT stock_id, date, lead(date) OVER w AS next_date, {rq('lead(open) OVER w', 'next_open')}, {rq('close / lag(close, 5) OVER w - 1', 'change_5')}, {rq('close / lag(close, 20) OVER w - 1', 'change_20')} FROM cells WINDOW w AS (PARTITION BY stock_id ORDER BY date)"))
def w19(spark, d):
    return cells(spark, d).select("stock_id", "date", F.lead("date").over(X.own_rows()).alias("next_date"), r(F.lead("open").over(X.own_rows()), "next_open"), r(X.row_change(5), "change_5"), r(X.row_change(20), "change_20"))


def costed(spark, d, more: dict | None = None):
    """The ranked days with the deviation and ``more`` features of the security's own rows, which the panel carries along: nothing is joined."""
    b = band(spark, d).withColumns(more or {})
    names = ("deviation", *(more or {}))
    return ranked(spark, d, {c: F.col(c) for c in names}, dense_panel(b, calendar(spark, d), names))


CTES["risky"] = (("band", "ranked"), "SELECT s.stock_id, s.date, s.year, s.ret, s.pct, deviation FROM ranked s JOIN band b ON b.stock_id = s.stock_id AND b.date = s.date WHERE pct > 60")


def risky(spark, d):
    """Days of high scores with the deviation from the cost band (J20: the features joined to the event)."""
    return costed(spark, d).where("pct > 60").select("stock_id", "date", "year", "ret", "pct", "deviation")


@query("j20_event_costs", with_ctes(("risky",), f"SELECT stock_id, date, {rq('ret', 'ret')}, {rq('deviation', 'deviation')} FROM risky"))
def j20(spark, d):
    return risky(spark, d).select("stock_id", "date", r(F.col("ret"), "ret"), r(F.col("deviation"), "deviation"))


@query("a41_deviation_buckets", with_ctes(("risky",), f"SELECT CASE WHEN deviation < -10 THEN 'under_-10' WHEN deviation < 0 THEN '-10_0' WHEN deviation < 10 THEN '0_10' WHEN deviation < 25 THEN '10_25' WHEN deviation >= 25 THEN 'over_25' END AS bucket, count(*) AS n, {rq('avg(ret)', 'mean')} FROM risky GROUP BY 1"))
def a41(spark, d):
    return risky(spark, d).groupBy(X.deviation_bucket(F.col("deviation")).alias("bucket")).agg(F.count("*").alias("n"), r(F.avg("ret"), "mean"))


_FIFTHS = [i / 5 for i in range(6)]
_Q = "list_sort(list_distinct(quantile_cont(deviation, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])))"


@query("a41_quintiles", with_ctes(("risky",), f", e AS (SELECT {_Q} AS q FROM risky) SELECT (len(list_filter(q[2:len(q) - 1], lambda x: x < deviation)) + 1)::INTEGER AS quintile, count(*) AS n, {rq('avg(ret)', 'mean')} FROM risky, e WHERE deviation IS NOT NULL GROUP BY 1"))
def a41q(spark, d):
    s = risky(spark, d).where("deviation is not null").select("ret", "deviation").persist()  # two numbers a row, read three times
    edges = exact_quantiles(s, "deviation", _FIFTHS).select(F.array_sort(F.array_distinct("q")).alias("q"))
    return s.crossJoin(F.broadcast(edges)).groupBy(X.quantile_groups(F.col("deviation"), F.col("q")).alias("quintile")).agg(F.count("*").alias("n"), r(F.avg("ret"), "mean"))


@query("a42_yearly_high_minus_low", with_ctes(("risky",), f", e AS (SELECT year, {_Q} AS q FROM risky WHERE deviation IS NOT NULL GROUP BY 1) SELECT year, {rq('avg(ret) FILTER (WHERE g = 5) - avg(ret) FILTER (WHERE g = 1)', 'high_minus_low')} FROM (SELECT r.year, ret, len(list_filter(q[2:len(q) - 1], lambda x: x < deviation)) + 1 AS g FROM risky r JOIN e ON e.year = r.year WHERE deviation IS NOT NULL) GROUP BY 1"))
def a42(spark, d):
    s = risky(spark, d).where("deviation is not null").select("year", "ret", "deviation").persist()  # read three times
    edges = exact_quantiles(s, "deviation", _FIFTHS, ("year",)).select("year", F.array_sort(F.array_distinct("q")).alias("q"))
    g = s.join(F.broadcast(edges), "year").withColumn("g", X.quantile_groups(F.col("deviation"), F.col("q")))  # a row per year
    return g.groupBy("year").agg(r(F.avg(F.when(F.col("g") == 5, F.col("ret"))) - F.avg(F.when(F.col("g") == 1, F.col("ret"))), "high_minus_low"))


CTES["heat"] = (("risky", "cells"), f"""SELECT r.year, r.ret, r.deviation / 100 AS deviation, c.back, c.place FROM risky r JOIN (SELECT stock_id, date, close / lag(close, 5) OVER (PARTITION BY stock_id ORDER BY date) - 1 AS back,
  CASE WHEN count(*) OVER {_W.format(19)} = 20 AND max(high) OVER {_W.format(19)} > min(low) OVER {_W.format(19)} THEN (close - min(low) OVER {_W.format(19)}) / (max(high) OVER {_W.format(19)} - min(low) OVER {_W.format(19)}) END AS place FROM cells) c ON c.stock_id = r.stock_id AND c.date = r.date""")


@query("a43_overheat_grid", with_ctes(("heat",), f"""SELECT period, a AS least_deviation, b AS least_return, c AS least_place, count(*) AS n, count(*) FILTER (WHERE hot) AS hot, {rq('avg(ret) FILTER (WHERE hot)', 'hot_mean')}, {rq('avg(ret) FILTER (WHERE NOT hot)', 'normal_mean')}, {rq('avg(ret) FILTER (WHERE hot) - avg(ret) FILTER (WHERE NOT hot)', 'difference')}
FROM (SELECT *, deviation >= a AND (back >= b OR place >= c) AS hot FROM heat, (VALUES ('all'), ('late')) p(period), (VALUES (0.05::DOUBLE), (0.10::DOUBLE), (0.15::DOUBLE)) x(a), (VALUES (0.05::DOUBLE), (0.10::DOUBLE), (0.15::DOUBLE)) y(b), (VALUES (0.8::DOUBLE), (0.9::DOUBLE)) z(c)
WHERE deviation IS NOT NULL AND back IS NOT NULL AND place IS NOT NULL AND (period = 'all' OR year > 1996)) GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (WHERE hot) >= 20 AND count(*) FILTER (WHERE NOT hot) >= 20"""))
def a43(spark, d):
    """Far above cost and risen fast or high in its range, against the rest; at least 20 rows on both sides."""
    # one frame by security and date serves the cost band, the change and the range
    s = costed(spark, d, {"back": X.row_change(5), "range": X.range_position(20)}).where("pct > 60")
    s = s.select("year", "ret", (F.col("deviation") / 100).alias("deviation"), "back", F.col("range").alias("place"))
    return X.overheat_grid(s, F.array(F.lit("all"), F.when(F.col("year") > 1996, "late")), "ret").select("period", "least_deviation", "least_return", "least_place", "n", "hot", *[r(F.col(k), k) for k in ("hot_mean", "normal_mean", "difference")])


_P = [(n, w) for n in ("foreign_net", "trust_net", "dealer_net") for w in (5, 10, 20)]


@query("a40_cost_proxies", with_ctes(("cells",), "SELECT proxy, count(*) AS n, count(cost) AS known, round(avg(close / cost - 1), 6) + 0.0::DOUBLE AS mean_deviation FROM (" + " UNION ALL ".join(f"SELECT '{n}_{w}' AS proxy, close, {_cost(n, '(high + low + close) / 3', w)} AS cost FROM cells" for n, w in _P) + ") GROUP BY 1"))
def a40(spark, d):
    mid = (F.col("high") + F.col("low") + F.col("close")) / 3
    wide = cells(spark, d).select("close", *[X.weighted_cost(n, mid, w).alias(f"{n}_{w}") for n, w in _P])
    long = wide.unpivot(["close"], [f"{n}_{w}" for n, w in _P], "proxy", "cost")
    return long.groupBy("proxy").agg(F.count("*").alias("n"), F.count("cost").alias("known"), r(F.avg(F.col("close") / F.col("cost") - 1), "mean_deviation"))
