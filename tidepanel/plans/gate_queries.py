"""Queries of gates and guards (M17: returns over a horizon, entry rules, confirmation years; F25: classes by fold; C20: notification modes)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.operators import gates as G
from tidepanel.operators import models as M
from tidepanel.operators.lifecycle import CLASSES
from tidepanel.operators.ranking import daily_spearman
from tidepanel.plans.adapter import CTES, table, with_ctes
from tidepanel.plans.audit_queries import probs
from tidepanel.plans.core import query
from tidepanel.plans.feature_queries import r, rq
from tidepanel.plans.model_queries import training
from tidepanel.plans.ranking_queries import ranked
from tidepanel.plans.run_queries import runs


def lower_end(value: str):
    """The lower end of a mean's normal 95 % interval."""
    return F.avg(value) - 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))


_LOW = "avg({0}) - 1.96::DOUBLE * stddev_samp({0}) / sqrt(count({0}))"


@query("m17_return_gate", with_ctes(("ranked", "spearman"), f""", s AS (SELECT CASE WHEN stock_id::INTEGER % 2 = 0 THEN 'even' ELSE 'odd' END AS market, date, year(date)::INTEGER AS year, avg(ret) FILTER (WHERE pct > 80) - avg(ret) FILTER (WHERE pct <= 20) AS spread FROM ranked GROUP BY 1, 2, 3),
y AS (SELECT market, year, avg(spread) AS m FROM s GROUP BY 1, 2 HAVING count(spread) > 0),
t AS (SELECT market, count(*)::INTEGER AS years, count(*) FILTER (WHERE m > 0)::INTEGER AS positive_years FROM y GROUP BY 1), l AS (SELECT market, avg(spread) AS spread, {_LOW.format('spread')} AS low FROM s GROUP BY 1)
SELECT t.market, years, positive_years, greatest(2, ceil(years * 0.6))::INTEGER AS required_positive_years, {rq('spread', 'spread')}, {rq('rho', 'rank_correlation')}, {rq('low', 'low')}, coalesce(years >= 3 AND positive_years >= greatest(2, ceil(years * 0.6)) AND spread > 0 AND rho > 0 AND low > 0, false) AS passed
FROM t JOIN l USING (market), (SELECT avg(rho) AS rho FROM spearman)"""))
def m17_returns(spark, d):
    """Whether each market's spread between the day's best and worst fifth holds over years, by rank correlation and interval."""
    rows = ranked(spark, d).withColumn("market", F.when(F.col("stock_id").cast("int") % 2 == 0, "even").otherwise("odd"))
    side = lambda condition: F.avg(F.when(condition, F.col("ret")))
    s = rows.groupBy("market", "date", F.year("date").alias("year")).agg((side(F.col("pct") > 80) - side(F.col("pct") <= 20)).alias("spread"))
    y = s.groupBy("market", "year").agg(F.avg("spread").alias("m")).where("m is not null")
    t = y.groupBy("market").agg(F.count("*").cast("int").alias("years"), F.count_if(F.col("m") > 0).cast("int").alias("positive_years"))
    low = s.groupBy("market").agg(F.avg("spread").alias("spread"), lower_end("spread").alias("low"))
    rho = daily_spearman(ranked(spark, d), "score", "ret").agg(F.avg("spearman").alias("rank_correlation"))
    judged = G.return_gate(t.join(low, "market").crossJoin(F.broadcast(rho)))  # one row
    return judged.select("market", "years", "positive_years", F.col("required_positive_years").cast("int").alias("required_positive_years"), *[r(F.col(c), c) for c in ("spread", "rank_correlation", "low")], "passed")


CTES["rule_events"] = (("runs",), "SELECT 'run' || run_length AS rule, stock_id, date, year, ret AS excess FROM runs WHERE run_length <= 4")


@query("m17_rule_candidates", with_ctes(("rule_events",), f""", f AS (SELECT * FROM rule_events WHERE year >= 1993 AND year < (SELECT max(year) FROM rule_events)), c AS (SELECT rule, count(*) AS events, count(DISTINCT stock_id) AS stocks FROM f GROUP BY 1),
d AS (SELECT rule, year, date, avg(excess) AS m FROM f GROUP BY 1, 2, 3), y AS (SELECT rule, year, avg(m) AS y, sum(m) AS s, count(m) AS n FROM d GROUP BY 1, 2),
t AS (SELECT rule, count(*) AS years, count(*) FILTER (WHERE y > 0) AS positive_years, sum(s) / sum(n) AS excess FROM y GROUP BY 1),
l AS (SELECT rule, {_LOW.format('m')} AS low FROM (SELECT rule, date, avg(excess) AS m FROM rule_events GROUP BY 1, 2) GROUP BY 1)
SELECT c.rule, events, stocks, years, positive_years, {rq('excess', 'excess')}, {rq('low', 'low')}, CASE WHEN events >= 20 AND stocks >= 5 AND years >= 3 AND positive_years >= greatest(2, ceil(years * 0.6)) AND excess > 0 AND low > 0 THEN 'strong_candidate' ELSE 'not_selected' END AS status FROM c JOIN t USING (rule) LEFT JOIN l USING (rule)"""))
def m17_rules(spark, d):
    """Entry on the first to fourth day of a run, judged by events, securities, years and the interval of daily means."""
    e = runs(spark, d).where("run_length <= 4").select(F.concat(F.lit("run"), F.col("run_length").cast("string")).alias("rule"), "stock_id", "date", "year", F.col("ret").alias("excess"))
    low = e.groupBy("rule", "date").agg(F.avg("excess").alias("m")).groupBy("rule").agg(lower_end("m").alias("low"))
    got = G.rule_candidates(e, low, 1993, events_least=20, stocks_least=5)
    return got.select("rule", "events", "stocks", "years", "positive_years", r(F.col("excess"), "excess"), r(F.col("low"), "low"), "status")


@query("f25_fold_classes", with_ctes(("training",), """, f AS (SELECT * FROM (VALUES (1996, 1997, 1998), (1997, 1998, 1999), (1998, 1999, 2000)) v(train, cal, test_year)),
p AS (SELECT test_year, CASE WHEN year <= train AND year(target_date) < cal THEN 'train' WHEN year = cal AND year(target_date) < test_year THEN 'calibrate' WHEN year = test_year THEN 'test' END AS part, CASE WHEN ret >= 0.3 THEN 'UP' WHEN ret <= -0.3 THEN 'DOWN' ELSE 'FLAT' END AS label FROM training, f)
SELECT test_year, part, count(*) AS n, array_to_string(list_filter(['DOWN', 'FLAT', 'UP'], lambda x: NOT list_contains(list(label), x)), ',') AS missing FROM p WHERE part IS NOT NULL GROUP BY 1, 2"""))
def f25(spark, d):
    """The classes that each part of each fold lacks; ``models.require_classes`` makes an error of them."""
    label = F.when(F.col("ret") >= 0.3, "UP").when(F.col("ret") <= -0.3, "DOWN").otherwise("FLAT")
    folds = M.rolling_folds([1995, 1996, 1997, 1998, 1999, 2000], 2)
    return M.missing_classes(M.fold_rows(training(spark, d).withColumn("label", label), folds), "label", ["DOWN", "FLAT", "UP"])


_TYPES = ["NEW_CANDIDATE", "LAYOUT_CONFIRMED", "DAY20_EXTEND", "TWSE_TRACK_CONFIRMED", "DAY40_END", "other"]


@query("c20_notify_modes", f"SELECT mode, count(*) AS n FROM (SELECT CASE WHEN t IN ('LAYOUT_CONFIRMED_DIRECT', 'TWSE_TRACK_CONFIRMED') THEN 'HIGH_PRIORITY_NEW' WHEN t = 'NEW_CANDIDATE' THEN 'NEW_CANDIDATE' WHEN t IN ('LAYOUT_CONFIRMED', 'LAYOUT_CONFIRMED_AND_EXTENDED', 'DAY20_EXTEND', 'DAY20_EXTEND_STRONG', 'TWSE_DAY40_END') THEN 'STATE_UPDATE' ELSE 'SILENT_STATE' END AS mode FROM (SELECT list_extract({_TYPES}, (o_orderkey % 6)::INTEGER + 1) AS t FROM orders)) GROUP BY 1")
def c20(spark, d):
    modes = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    kind = F.get(F.array(*map(F.lit, _TYPES)), (F.col("o_orderkey") % 6).cast("int"))
    return table(spark, d, "orders").groupBy(F.coalesce(F.try_element_at(modes, kind), F.lit("SILENT_STATE")).alias("mode")).agg(F.count("*").alias("n"))


_LOSS = "-avg(y * ln(greatest(1e-12, p)) + (1 - y) * ln(greatest(1e-12, 1 - p)))"
_FIELDS = ("weighted_spread", "median_spread", "model_loss", "history_loss", "model_ece", "history_ece")
CTES["confirmed"] = (("probs", "ranked"), f"""SELECT b.market, b.year, b.n AS test_rows, s.spread, b.loss AS model_loss, e.ece AS model_ece, -(m * ln(greatest(1e-12, base)) + (1 - m) * ln(greatest(1e-12, 1 - base))) AS history_loss, abs(base - m) AS history_ece
FROM (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS base FROM (SELECT CASE WHEN stock_id::INTEGER % 2 = 0 THEN 'even' ELSE 'odd' END AS market, year(date)::INTEGER AS year, count(*) AS n, avg(y) AS m, {_LOSS} AS loss FROM probs GROUP BY 1, 2) WINDOW w AS (PARTITION BY market ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) b
JOIN (SELECT market, year, sum(abs(sp - sy)) / sum(n) AS ece FROM (SELECT CASE WHEN stock_id::INTEGER % 2 = 0 THEN 'even' ELSE 'odd' END AS market, year(date)::INTEGER AS year, least(9, floor(p * 10)) AS bin, sum(p) AS sp, sum(y) AS sy, count(*) AS n FROM probs GROUP BY 1, 2, 3) GROUP BY 1, 2) e USING (market, year)
JOIN (SELECT market, year, avg(spread) AS spread FROM (SELECT CASE WHEN stock_id::INTEGER % 2 = 0 THEN 'even' ELSE 'odd' END AS market, year(date)::INTEGER AS year, avg(ret) FILTER (WHERE pct > 80) - avg(ret) FILTER (WHERE pct <= 20) AS spread FROM ranked GROUP BY 1, 2, date) GROUP BY 1, 2) s USING (market, year) WHERE base IS NOT NULL""")


@query("m17_confirmation", with_ctes(("confirmed",), f""", a AS (SELECT market, count(*) AS years, sum(test_rows)::BIGINT AS test_rows, count(*) FILTER (WHERE spread > 0) AS positive_years, sum(spread * test_rows) / sum(test_rows) AS weighted_spread, median(spread) AS median_spread, {', '.join(f'sum({c} * test_rows) / sum(test_rows) AS {c}' for c in _FIELDS[2:])} FROM confirmed GROUP BY 1),
j AS (SELECT m.market, a.* EXCLUDE (market), coalesce(positive_years >= greatest(1, ceil(years * 0.75)) AND weighted_spread > 0 AND median_spread > 0, false) AS ranking, coalesce(model_loss < history_loss AND model_ece <= history_ece + 0.005, false) AS probability FROM (VALUES ('even'), ('none'), ('odd')) m(market) LEFT JOIN a USING (market))
SELECT market, years, test_rows, positive_years, {', '.join(rq(c, c, 9) for c in _FIELDS)}, ranking, probability, CASE WHEN years IS NULL THEN 'INCOMPLETE' WHEN ranking AND probability THEN 'PROBABILITY_AND_RANKING' WHEN ranking THEN 'RANKING_ONLY' ELSE 'REJECT' END AS decision FROM j"""))
def m17_confirmation(spark, d):
    """Whether each market's ranking and probabilities hold in the years after its first, against the share of all years before."""
    market = F.when(F.col("stock_id").cast("int") % 2 == 0, "even").otherwise("odd")
    x = probs(spark, d).select(market.alias("market"), F.year("date").alias("year"), "y", "p")
    least = F.lit(1e-12)
    log_loss = lambda y, p: -(y * F.ln(F.greatest(least, p)) + (1 - y) * F.ln(F.greatest(least, 1 - p)))
    b = x.groupBy("market", "year").agg(F.count("*").alias("test_rows"), F.avg("y").alias("m"), F.avg(log_loss(F.col("y"), F.col("p"))).alias("model_loss"))
    past = Window.partitionBy("market").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)  # a row a year
    b = b.withColumn("base", F.sum(F.col("test_rows") * F.col("m")).over(past) / F.sum("test_rows").over(past)).where("base is not null")
    bins = x.groupBy("market", "year", F.least(F.lit(9), F.floor(F.col("p") * 10)).alias("bin")).agg(F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    e = bins.groupBy("market", "year").agg((F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("model_ece"))
    side = lambda condition: F.avg(F.when(condition, F.col("ret")))
    daily = ranked(spark, d).groupBy(market.alias("market"), F.year("date").alias("year"), "date").agg((side(F.col("pct") > 80) - side(F.col("pct") <= 20)).alias("spread"))
    s = daily.groupBy("market", "year").agg(F.avg("spread").alias("spread"))
    folds = b.join(e, ["market", "year"]).join(s, ["market", "year"]).withColumns({"history_loss": log_loss(F.col("m"), F.col("base")), "history_ece": F.abs(F.col("base") - F.col("m"))})
    names = spark.createDataFrame([("even",), ("none",), ("odd",)], "market string")
    return G.confirmation(folds, names).select("market", "years", "test_rows", "positive_years", *[r(F.col(c), c, 9) for c in _FIELDS], "ranking", "probability", "decision")
