"""Further queries: classifications, cohorts, stars, gates and state (A32, A35, A36, A49, A52, A53, C09, C12, C15, C17, C18, F07, F11, F14, F16, F17, J03, J04, J17, J19, J23, J24, J27, K12, M17, T04, T05, W12)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.operators import features as X
from tidepanel.operators import gates as G
from tidepanel.operators.quantiles import exact_quantiles
from tidepanel.operators.ranking import ceiled_group, daily_rank
from tidepanel.operators.returns import with_returns
from tidepanel.operators.runs import score_days_ahead
from tidepanel.plans.adapter import actions, calendar, cells, eventful, panel, table, with_ctes
from tidepanel.plans.core import query
from tidepanel.plans.cost_queries import band
from tidepanel.plans.feature_queries import MONEY, r, rq
from tidepanel.plans.ranking_queries import ranked, scores
from tidepanel.plans.return_queries import horizons
from tidepanel.plans.run_queries import entries, runs
from tidepanel.sources import sinks as K


@query("a35_daily_deciles", with_ctes(("ranked",), f"SELECT date, greatest(1, least(10, ceil(round(pct, 9) / 10)))::INTEGER AS decile, count(*) AS n, {rq('avg(ret)', 'mean')} FROM ranked GROUP BY 1, 2"))
def a35(spark, d):
    return ranked(spark, d).groupBy("date", ceiled_group(F.round("pct", 9), 10).alias("decile")).agg(F.count("*").alias("n"), r(F.avg("ret"), "mean"))


@query("a32_row_weighted_means", with_ctes(("ranked",), f"SELECT {rq('sum(n * m) / sum(n)', 'weighted')}, {rq('avg(m)', 'plain')} FROM (SELECT year, count(*) AS n, avg(ret) AS m FROM ranked GROUP BY 1)"))
def a32(spark, d):
    y = ranked(spark, d).groupBy("year").agg(F.count("*").alias("n"), F.avg("ret").alias("m"))
    return y.agg(r(F.sum(F.col("n") * F.col("m")) / F.sum("n"), "weighted"), r(F.avg("m"), "plain"))


_LABEL = "CASE WHEN round(adjusted, 10) >= 0.05 THEN 'UP' WHEN round(adjusted, 10) <= -0.05 THEN 'DOWN' WHEN adjusted IS NOT NULL THEN 'FLAT' END"


@query("a36_common_cohort", with_ctes(("returns5", "returns10", "returns40"), f"SELECT a.label AS label_5, b.label AS label_40, count(*) AS n FROM (SELECT stock_id, date, {_LABEL} AS label FROM returns5 WHERE status = 'ok') a JOIN (SELECT stock_id, date FROM returns10 WHERE status = 'ok') m USING (stock_id, date) JOIN (SELECT stock_id, date, {_LABEL} AS label FROM returns40 WHERE status = 'ok') b USING (stock_id, date) GROUP BY 1, 2"))
def a36(spark, d):
    ok = horizons(spark, d, 5, 10, 40).where("status_5d = 'ok' and status_10d = 'ok' and status_40d = 'ok'")
    return ok.groupBy(F.col("label_5d").alias("label_5"), F.col("label_40d").alias("label_40")).agg(F.count("*").alias("n"))


@query("j23_long_horizons", with_ctes(("returns5", "returns40", "entries"), f"SELECT e.stock_id, e.date, {rq('a.adjusted', 'after_5')}, {rq('b.adjusted', 'after_40')} FROM entries e LEFT JOIN returns5 a ON a.stock_id = e.stock_id AND a.date = e.date LEFT JOIN returns40 b ON b.stock_id = e.stock_id AND b.date = e.date"))
def j23(spark, d):
    after = {f"after_{h}": F.col(f"adjusted_{h}d") for h in (5, 40)}
    # an entry carries its returns along from the panel that its score is made of
    e = entries(spark, d, after, with_returns(eventful(spark, d), (5, 40)))
    return e.select("stock_id", "date", *[r(F.col(c), c) for c in after])


@query("j03_quotes_and_flows", with_ctes(("cells",), "SELECT q.stock_id, q.date, close, net FROM (SELECT stock_id, date, close FROM cells WHERE close > 0) q JOIN (SELECT stock_id, date, foreign_net + trust_net AS net FROM cells WHERE foreign_net <> 0) f ON f.stock_id = q.stock_id AND f.date = q.date"))
def j03(spark, d):
    c = cells(spark, d)
    return c.where("close > 0").select("stock_id", "date", "close").join(c.where("foreign_net <> 0").select("stock_id", "date", (F.col("foreign_net") + F.col("trust_net")).alias("net")), ["stock_id", "date"])


@query("j04_qualified_signals", with_ctes(("cells", "cal"), "SELECT stock_id, count(*) AS signals FROM cells JOIN cal USING (date) WHERE close > 0 AND foreign_net <> 0 AND idx < (SELECT max(idx) FROM cal) GROUP BY 1"))
def j04(spark, d):
    cal = calendar(spark, d)
    open_days = cal.crossJoin(F.broadcast(cal.agg(F.max("idx").alias("last")))).where("idx < last").select("date")
    return cells(spark, d).where("close > 0 and foreign_net <> 0").join(F.broadcast(open_days), "date", "left_semi").groupBy("stock_id").agg(F.count("*").alias("signals"))


@query("j24_score_enrichment", with_ctes(("ranked", "liquid"), f"SELECT s.stock_id, s.date, {rq('s.pct', 'pct')}, {rq('median_money', 'median_money', 4)}, median_money >= 20000 AS pass_20, median_money >= 50000 AS pass_50 FROM ranked s JOIN liquid l ON l.stock_id = s.stock_id AND l.date = s.date"))
def j24(spark, d):
    liq = X.liquidity(panel(spark, d), MONEY).select("stock_id", "date", "median_money")
    return ranked(spark, d).select("stock_id", "date", "pct").join(liq, ["stock_id", "date"]).select("stock_id", "date", r(F.col("pct"), "pct"), r(F.col("median_money"), "median_money", 4), (F.col("median_money") >= 20000).alias("pass_20"), (F.col("median_money") >= 50000).alias("pass_50"))


@query("j27_event_contributions", with_ctes(("entries", "cells"), "SELECT e.stock_id, e.date, foreign_net, trust_net, dealer_net FROM entries e LEFT JOIN cells c ON c.stock_id = e.stock_id AND c.date = e.date"))
def j27(spark, d):
    return entries(spark, d).select("stock_id", "date").join(cells(spark, d).select("stock_id", "date", "foreign_net", "trust_net", "dealer_net"), ["stock_id", "date"], "left")


@query("w12_daily_rank", with_ctes(("ranked",), "SELECT date, stock_id, row_number() OVER (PARTITION BY date ORDER BY round(score, 9) DESC, stock_id) AS place FROM ranked"))
def w12(spark, d):
    return ranked(spark, d).withColumn("s", F.round("score", 9)).select("date", "stock_id", daily_rank("s").cast("long").alias("place"))


@query("f07_live_liquidity", with_ctes(("liquid",), "SELECT stock_id, date, liquid AS pass FROM liquid WHERE idx = (SELECT max(idx) FROM liquid)"))
def f07(spark, d):
    p = X.liquidity(panel(spark, d), MONEY)
    last = calendar(spark, d).agg(F.max("idx").alias("last"))
    return p.crossJoin(F.broadcast(last)).where("idx = last").select("stock_id", "date", F.col("liquid").alias("pass"))


@query("f11_signal_exclusions", with_ctes(("panel",), "SELECT CASE WHEN NOT present THEN 'missing_price' WHEN NOT (open > 0 AND close > 0 AND volume > 0 AND money > 0) THEN 'invalid_price' ELSE 'kept' END AS reason, count(*) AS n FROM panel GROUP BY 1"))
def f11(spark, d):
    return panel(spark, d).groupBy(F.when(~F.col("present"), "missing_price").when(~X.valid_signal(), "invalid_price").otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


@query("f16_horizon_eligibility", with_ctes(("returns10",), f"SELECT {_LABEL} AS label, count(*) AS n, {rq('avg(adjusted)', 'mean')} FROM returns10 WHERE {_LABEL} IN ('UP', 'DOWN', 'FLAT') GROUP BY 1"))
def f16(spark, d):
    eligible = horizons(spark, d, 10).where(F.col("label_10d").isin("UP", "DOWN", "FLAT"))
    return eligible.groupBy(F.col("label_10d").alias("label")).agg(F.count("*").alias("n"), r(F.avg("adjusted_10d"), "mean"))


@query("f17_download_complete", "SELECT user_id, bool_and(done) AS complete FROM (SELECT user_id, event_type, min(ts) <= TIMESTAMP '2024-01-10' AND max(ts) >= TIMESTAMP '2024-01-20' AS done FROM events GROUP BY 1, 2) GROUP BY 1")
def f17(spark, d):
    at = lambda t: F.lit(t).cast("timestamp")
    one = table(spark, d, "events").groupBy("user_id", "event_type").agg(((F.min("ts") <= at("2024-01-10")) & (F.max("ts") >= at("2024-01-20"))).alias("done"))
    return one.groupBy("user_id").agg(F.bool_and("done").alias("complete"))


@query("c12_sigmoid", "SELECT event_id, round(1 / (1 + exp(-greatest(-40, least(40, value / 10 - 5)))), 9) AS p FROM events")
def c12(spark, d):
    z = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("value") / 10 - 5))
    return table(spark, d, "events").select("event_id", F.round(1 / (1 + F.exp(-z)), 9).alias("p"))


@query("c15_first_positive_price", with_ctes(("actions",), f"SELECT stock_id, date, action_type, {rq('CASE WHEN reference_price > 3000 THEN reference_price WHEN reference_price * 2 > 0 THEN reference_price * 2 END', 'price')} FROM actions"))
def c15(spark, d):
    price = F.col("reference_price")
    return actions(spark, d).select("stock_id", "date", "action_type", r(F.coalesce(F.when(price > 3000, price), F.when(price * 2 > 0, price * 2)), "price"))


@query("c17_duplicate_cleanup", "SELECT event_id FROM (SELECT event_id, ts, sound, count(*) FILTER (WHERE sound) OVER w AS good, max(CASE WHEN sound THEN ts END) OVER w AS hit FROM (SELECT *, value > 95 AS sound FROM events) WINDOW w AS (PARTITION BY user_id, event_type)) WHERE good = 1 AND NOT sound AND abs(date_diff('day', ts::DATE, hit::DATE)) <= 10")
def c17(spark, d):
    """Rows to drop: beside exactly one sound row of their group, not sound themselves and within ten days of it."""
    e = table(spark, d, "events").withColumn("sound", F.col("value") > 95)
    g = e.groupBy("user_id", "event_type").agg(F.count_if("sound").alias("good"), F.max(F.when(F.col("sound"), F.col("ts"))).alias("at")).where("good = 1")
    return e.where("not sound").join(g, ["user_id", "event_type"]).where(F.abs(F.datediff("ts", "at")) <= 10).select("event_id")


@query("c18_display_text", "SELECT o_orderkey AS id, printf('%.2f', round(o_totalprice, 2)) AS price, printf('%+.1f%%', (o_orderkey % 41) - 20.0) AS change FROM orders")
def c18(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.format_string("%.2f", F.round("o_totalprice", 2)).alias("price"), F.format_string("%+.1f%%", (F.col("o_orderkey") % 41).cast("double") - 20.0).alias("change"))


@query("j19_a53_rule_star", with_ctes(("runs", "ranked"), f""", e AS (SELECT run_length AS rule, year, stock_id, idx, ret FROM runs WHERE run_length IN (1, 2, 3)), y AS (SELECT rule, count(*) AS years, sum((m > 0)::INTEGER)::BIGINT AS good_years FROM (SELECT rule, year, avg(ret) AS m FROM e GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT rule, count(*) FILTER (WHERE b.pct >= 70) AS extended FROM e LEFT JOIN ranked b ON b.stock_id = e.stock_id AND b.idx = e.idx + 20 GROUP BY 1)
SELECT e.rule, count(*) AS events, {rq('avg(ret)', 'mean')}, any_value(years) AS years, any_value(good_years) AS good_years, any_value(extended) AS extended FROM e JOIN y ON y.rule = e.rule JOIN x ON x.rule = e.rule GROUP BY 1"""))
def j19(spark, d):
    # a run's rows are the high days, so the day 20 ahead is high if it is among them; a year of a rule holds all that the star needs
    e = runs(spark, d).withColumn("ahead", score_days_ahead("pct", 20)).where("run_length in (1, 2, 3)")
    y = e.groupBy(F.col("run_length").alias("rule"), "year").agg(F.count("*").alias("n"), F.count("ret").alias("k"), F.sum("ret").alias("s"), F.avg("ret").alias("m"), F.count("ahead").alias("hits"))
    return y.groupBy("rule").agg(F.sum("n").alias("events"), r(F.try_divide(F.sum("s"), F.sum("k")), "mean"), F.count("*").alias("years"), F.count_if(F.col("m") > 0).alias("good_years"), F.sum("hits").alias("extended"))


@query("t04_best_candidate", with_ctes(("runs",), "SELECT year, rule FROM (SELECT year, run_length AS rule, row_number() OVER (PARTITION BY year ORDER BY round(avg(ret), 9) DESC, run_length) AS n FROM runs WHERE run_length <= 5 GROUP BY 1, 2) WHERE n = 1"))
def t04(spark, d):
    m = runs(spark, d).where("run_length <= 5").groupBy("year", F.col("run_length").alias("rule")).agg(F.round(F.avg("ret"), 9).alias("m"))
    return m.groupBy("year").agg(F.min_by("rule", F.struct((-F.col("m")).alias("m"), "rule")).alias("rule"))


@query("m17_a49_gates", with_ctes(("ranked", "spearman"), """, s AS (SELECT year(date)::INTEGER AS year, avg(ret) FILTER (WHERE pct > 80) - avg(ret) FILTER (WHERE pct <= 20) AS spread FROM ranked GROUP BY date), y AS (SELECT year, avg(spread) AS m FROM s GROUP BY 1)
SELECT unnest(['years', 'positive_years', 'spread', 'rank_correlation']) AS gate, unnest([(SELECT count(*) >= 3 FROM y), (SELECT count(*) FILTER (WHERE m > 0) >= greatest(2, ceil(0.6 * count(*))) FROM y), (SELECT avg(spread) > 0 FROM s), (SELECT avg(rho) > 0 FROM spearman)]) AS passed"""))
def m17(spark, d):
    return G.ranking_gates(ranked(spark, d), "pct", "score", "ret")


@query("a52_progress_rows", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, CASE WHEN count(DISTINCT event_type) = 5 THEN 'complete' ELSE 'partial' END AS status FROM events GROUP BY 1")
def a52(spark, d):
    hit = lambda k: F.count_if(F.col("event_type") == k).alias(k)
    return table(spark, d, "events").groupBy("user_id").agg(hit("view"), hit("click"), hit("purchase"), F.when(F.count_distinct("event_type") == 5, "complete").otherwise("partial").alias("status"))


@query("k12_sent_keys", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20")
def k12(spark, d):
    return K.newest_keys(table(spark, d, "events"), "user_id", "event_id", 20).select("user_id", "event_id")


@query("j10_price_path", with_ctes(("panel",), "SELECT stock_id, date, len(list_filter(p, lambda x: x > 0))::INTEGER AS priced, round(list_max(p), 6) AS top FROM (SELECT stock_id, date, list(close) OVER (PARTITION BY stock_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS p, count(*) OVER (PARTITION BY stock_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS n FROM panel) WHERE n = 10"))
def j10(spark, d):
    w = X.by_date().rowsBetween(1, 10)
    p = panel(spark, d).select("stock_id", "date", F.count("*").over(w).alias("n"), F.count(F.when(F.col("close") > 0, 1)).over(w).cast("int").alias("priced"), F.round(F.max("close").over(w), 6).alias("top"))
    return p.where("n = 10").drop("n")


@query("j17_users_by_notices", with_ctes(("users", "entries"), "SELECT user_id, count(*) AS notices FROM users CROSS JOIN entries WHERE enabled GROUP BY 1"))
def j17(spark, d):
    """Every enabled user with the number of notices; the product itself is not listed for its count."""
    from tidepanel.plans.lifecycle_queries import users

    n = entries(spark, d).agg(F.count("*").alias("notices"))
    return users(spark, d).where("enabled").select("user_id").crossJoin(F.broadcast(n)).where("notices > 0")  # one row


@query("m19_latest_costs", with_ctes(("band",), f"SELECT stock_id, date, {rq('cost_mid', 'cost_mid')}, buy_days FROM band WHERE (stock_id, date) IN (SELECT stock_id, max(date) FROM band GROUP BY 1)"))
def m19(spark, d):
    b = band(spark, d).groupBy("stock_id").agg(F.max_by(F.struct("date", "cost_mid", "buy_days"), "date").alias("b")).select("stock_id", "b.*")
    return b.select("stock_id", "date", r(F.col("cost_mid"), "cost_mid"), "buy_days")


@query("a13_label_direction", with_ctes(("feats", "returns10"), f"SELECT {_LABEL} AS label, count(*) AS n, {rq('avg(total_net_20)', 'mean')}, {rq('median(total_net_20)', 'median')}, {rq('stddev_pop(total_net_20)', 'std')} FROM returns10 x JOIN feats f ON f.stock_id = x.stock_id AND f.date = x.date WHERE status = 'ok' GROUP BY 1"))
def a13(spark, d):
    x = horizons(spark, d, 10, more={"total_net_20": X.flow_share("total_net", 20)}).where("status_10d = 'ok'")
    x = x.select(F.col("label_10d").alias("label"), "total_net_20").persist()  # a label and a number a row, read three times
    middle = exact_quantiles(x, "total_net_20", [0.5], ("label",)).select("label", r(F.get("q", F.lit(0)), "median"))  # a row per label
    return x.groupBy("label").agg(F.count("*").alias("n"), r(F.avg("total_net_20"), "mean"), r(F.stddev_pop("total_net_20"), "std")).join(F.broadcast(middle), "label", "left")


@query("a29_average_precision", with_ctes(("scores",), f"SELECT year, {rq('avg(up / place)', 'precision')} FROM (SELECT year, y, sum(y) OVER w AS up, row_number() OVER w AS place FROM (SELECT year, date, stock_id, (ret > 0)::INTEGER AS y, round(score, 9) AS s FROM scores) WINDOW w AS (PARTITION BY year, date ORDER BY s DESC, stock_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE y = 1 GROUP BY 1"))
def a29(spark, d):
    """Mean over a year's hits of the precision within their day, in descending score order."""
    w = Window.partitionBy("year", "date").orderBy(F.desc("s"), "stock_id").rowsBetween(Window.unboundedPreceding, 0)
    s = scores(spark, d).select("year", "date", "stock_id", (F.col("ret") > 0).cast("int").alias("y"), F.round("score", 9).alias("s"))
    hits = s.select("year", "y", (F.sum("y").over(w) / F.row_number().over(w)).alias("p")).where("y = 1")
    return hits.groupBy("year").agg(r(F.avg("p"), "precision"))
