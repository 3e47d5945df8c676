"""Queries of the cross-section: percentiles, groups, spreads, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.operators import ranking as R
from tidepanel.operators.features import by_date, flow_share
from tidepanel.plans.adapter import CTES, panel, with_ctes
from tidepanel.plans.core import query
from tidepanel.plans.feature_queries import r, rq, share_sql

LEAST = 5

CTES["scores"] = (
    ("panel",),
    f"""SELECT *, year(date)::INTEGER AS year FROM (SELECT stock_id, date, idx, money, present, {share_sql('total_net', 20)} AS score,
  CASE WHEN lead(open, 1) OVER w > 0 AND lead(close, 10) OVER w > 0 THEN lead(close, 10) OVER w / lead(open, 1) OVER w - 1 END AS ret FROM panel WINDOW w AS (PARTITION BY stock_id ORDER BY idx))
WHERE present AND ret IS NOT NULL""",
)
CTES["ranked"] = (
    ("scores",),
    """SELECT *, CASE WHEN n = 1 THEN 50.0::DOUBLE ELSE 100 * (ar - 1) / nullif(n - 1, 0) END AS pct, ar / n * 100 AS share_pct, CASE WHEN n <= 1 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * (fr - 1) / nullif(n - 1, 0) END AS first_pct,
 n AS n_stocks FROM (
SELECT *, count(*) OVER (PARTITION BY date) AS n, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0::DOUBLE AS ar,
  row_number() OVER (PARTITION BY date ORDER BY score, stock_id) AS fr, row_number() OVER (PARTITION BY date ORDER BY score DESC, stock_id) AS place FROM scores) WHERE n >= 5""",
)


def scores(spark, d, more: dict | None = None, days: DataFrame | None = None) -> DataFrame:
    """(stock_id, date, idx, money, score, ret, year): 20-week net flow share and the ten-week return from the next open; and ``more`` features of the panel (of ``days``, where that is a panel with more columns)."""
    entry, exit_ = F.lead("open", 1).over(by_date()), F.lead("close", 10).over(by_date())
    out = (panel(spark, d) if days is None else days).select("stock_id", "date", "idx", "money", "present", flow_share("total_net", 20).alias("score"), F.when((entry > 0) & (exit_ > 0), exit_ / entry - 1).alias("ret"), *[c.alias(n) for n, c in (more or {}).items()])
    return out.where("present and ret is not null").withColumn("year", F.year("date"))


def ranked(spark, d, more: dict | None = None, days: DataFrame | None = None) -> DataFrame:
    s = R.whole_days(scores(spark, d, more, days), LEAST)
    return s.withColumns({"pct": R.percentile_span("score"), "share_pct": R.percentile_share("score"), "first_pct": R.percentile_first("score"), "place": R.daily_rank("score").cast("long")})


@query("w09_w11_percentiles", with_ctes(("ranked",), f"SELECT stock_id, date, {rq('pct', 'span')}, {rq('share_pct', 'share')}, {rq('first_pct', 'first')}, place FROM ranked"))
def w09(spark, d):
    return ranked(spark, d).select("stock_id", "date", r(F.col("pct"), "span"), r(F.col("share_pct"), "share"), r(F.col("first_pct"), "first"), "place")


@query("w10_w11_groups", with_ctes(("ranked",), "SELECT stock_id, date, greatest(1, least(10, ceil(round(pct, 9) / 10)))::INTEGER AS decile, greatest(1, least(5, ceil(round(pct, 9) / 20)))::INTEGER AS quintile, least(10, floor(round(first_pct, 9) / 10) + 1)::INTEGER AS first_decile FROM ranked"))
def w10(spark, d):
    p, q = F.round("pct", 9), F.round("first_pct", 9)
    return ranked(spark, d).select("stock_id", "date", R.ceiled_group(p, 10).alias("decile"), R.ceiled_group(p, 5).alias("quintile"), R.floored_group(q, 10).alias("first_decile"))


@query("w13_daily_excess", with_ctes(("ranked",), f"SELECT stock_id, date, {rq('ret - avg(ret) OVER (PARTITION BY date)', 'excess')} FROM ranked"))
def w13(spark, d):
    return ranked(spark, d).select("stock_id", "date", r(R.excess("ret"), "excess"))


@query("t02_top_flow_share", with_ctes(("ranked",), f"SELECT date, stock_id, {rq('score', 'score')}, place FROM ranked WHERE pct > 90"))
def t02(spark, d):
    return ranked(spark, d).where("pct > 90").select("date", "stock_id", r(F.col("score"), "score"), "place")


@query("f09_whole_days", with_ctes(("scores",), "SELECT date, count(*) AS n_stocks FROM scores GROUP BY 1 HAVING count(*) >= 5"))
def f09(spark, d):
    return R.whole_days(scores(spark, d), LEAST).select("date", "n_stocks").distinct()


@query("j22_daily_spread", with_ctes(("ranked",), f"SELECT date, {rq('t', 'top')}, {rq('b', 'bottom')}, {rq('t - b', 'spread')} FROM (SELECT date, avg(ret) FILTER (WHERE pct > 80) AS t, avg(ret) FILTER (WHERE pct <= 20) AS b FROM ranked GROUP BY 1) WHERE t IS NOT NULL AND b IS NOT NULL"))
def j22(spark, d):
    return R.daily_spread(ranked(spark, d), "pct", "ret", 20).select("date", *[r(F.col(c), c) for c in ("top", "bottom", "spread")])


@query("a16_group_report", with_ctes(("ranked",), f"""SELECT date, greatest(1, least(5, ceil(round(pct, 9) / 20)))::INTEGER AS grp, count(*) AS n, count(DISTINCT stock_id) AS stocks, {rq('avg(ret)', 'mean')}, {rq('median(ret)', 'median')},
  {rq('quantile_cont(ret, 0.1)', 'p10')}, {rq('quantile_cont(ret, 0.9)', 'p90')}, {rq('avg((ret > 0)::INTEGER)', 'positive')} FROM ranked GROUP BY 1, 2"""))
def a16(spark, d):
    s = ranked(spark, d).withColumn("grp", R.ceiled_group(F.round("pct", 9), 5))
    return s.groupBy("date", "grp").agg(F.count("*").alias("n"), F.count_distinct("stock_id").alias("stocks"), r(F.avg("ret"), "mean"), r(F.median("ret"), "median"), r(F.percentile("ret", F.lit(0.1)), "p10"), r(F.percentile("ret", F.lit(0.9)), "p90"), r(F.avg((F.col("ret") > 0).cast("int")), "positive"))


@query("a17_horizon_behaviour", with_ctes(("ranked",), f"SELECT grp, count(*) AS days, {rq('avg(m)', 'mean_of_days')}, {rq('median(m)', 'median_of_days')}, sum(n)::BIGINT AS n, {rq('sum(t) / sum(n)', 'pooled')} FROM (SELECT greatest(1, least(10, ceil(round(pct, 9) / 10)))::INTEGER AS grp, date, avg(ret) AS m, count(*) AS n, sum(ret) AS t FROM ranked GROUP BY 1, 2) GROUP BY 1"))
def a17(spark, d):
    s = ranked(spark, d).withColumn("grp", R.ceiled_group(F.round("pct", 9), 10)).groupBy("grp", "date").agg(F.avg("ret").alias("m"), F.count("*").alias("n"), F.sum("ret").alias("t"))
    return s.groupBy("grp").agg(F.count("*").alias("days"), r(F.avg("m"), "mean_of_days"), r(F.median("m"), "median_of_days"), F.sum("n").alias("n"), r(F.sum("t") / F.sum("n"), "pooled"))


@query("a18_stability_by_year", with_ctes(("ranked",), f""", g AS (SELECT year, decile, avg(m) AS mean FROM (SELECT year, date, greatest(1, least(10, ceil(round(pct, 9) / 10)))::INTEGER AS decile, avg(ret) AS m FROM ranked GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT year, count(*) AS groups, sum((mean < prev)::INTEGER)::BIGINT AS violations, {rq('max(mean) FILTER (WHERE decile = 10) - max(mean) FILTER (WHERE decile = 1)', 'spread')}, {rq('corr(decile, mean)', 'decile_corr')}
FROM (SELECT *, lag(mean) OVER (PARTITION BY year ORDER BY decile) AS prev FROM g) GROUP BY 1"""))
def a18(spark, d):
    g = ranked(spark, d).withColumn("decile", R.ceiled_group(F.round("pct", 9), 10)).groupBy("year", "date", "decile").agg(F.avg("ret").alias("m")).groupBy("year", "decile").agg(F.avg("m").alias("mean"))
    g = g.withColumn("prev", F.lag("mean").over(Window.partitionBy("year").orderBy("decile")))
    at = lambda k: F.max(F.when(F.col("decile") == k, F.col("mean")))
    return g.groupBy("year").agg(F.count("*").alias("groups"), F.sum((F.col("mean") < F.col("prev")).cast("long")).alias("violations"), r(at(10) - at(1), "spread"), r(F.corr("decile", "mean"), "decile_corr"))


@query("a20_top_n_excess", with_ctes(("ranked",), f"SELECT k, {rq('avg(e)', 'mean_excess')}, count(*) AS days FROM (SELECT k, date, avg(ret) FILTER (WHERE place <= k) - avg(ret) AS e FROM ranked, (VALUES (5), (10), (20)) v(k) GROUP BY 1, 2) GROUP BY 1"))
def a20(spark, d):
    means = ranked(spark, d).groupBy("date").agg(F.avg("ret").alias("all"), *[F.avg(F.when(F.col("place") <= k, F.col("ret"))).alias(f"k{k}") for k in (5, 10, 20)])
    long = means.select("date", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"k{k}") - F.col("all")).alias("e")) for k in (5, 10, 20)])).alias("x")).select("x.*")
    return long.groupBy("k").agg(r(F.avg("e"), "mean_excess"), F.count("*").alias("days"))


@query("a22_concentration", with_ctes(("ranked",), f""", c AS (SELECT stock_id, count(*) AS n FROM ranked WHERE pct > 80 GROUP BY 1), s AS (SELECT n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, stock_id) AS k FROM c)
SELECT count(*) AS stocks, {rq('max(share)', 'top1')}, {rq('sum(share) FILTER (WHERE k <= 5)', 'top5')}, {rq('sum(share) FILTER (WHERE k <= 10)', 'top10')}, {rq('sum(share * share)', 'hhi')} FROM s"""))
def a22(spark, d):
    c = ranked(spark, d).where("pct > 80").groupBy("stock_id").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    top = lambda k: F.aggregate(F.slice("tops", 1, k), F.lit(0).cast("long"), lambda a, x: a + x) / F.col("total")
    tops = c.orderBy(F.desc("n"), "stock_id").limit(10).agg(F.reverse(F.array_sort(F.collect_list("n"))).alias("tops"))
    whole = c.crossJoin(F.broadcast(total)).agg(F.count("*").alias("stocks"), F.sum((F.col("n") / F.col("total")) ** 2).alias("hhi"), F.max("total").alias("total"))
    return whole.crossJoin(F.broadcast(tops)).select("stocks", r(top(1), "top1"), r(top(5), "top5"), r(top(10), "top10"), r(F.col("hhi"), "hhi"))


@query("a23_decile_table", with_ctes(("ranked",), f"SELECT year, bucket, count(*) AS n, {rq('avg(ret)', 'mean')} FROM (SELECT *, ntile(10) OVER (PARTITION BY year ORDER BY score, stock_id, date)::INTEGER AS bucket FROM ranked) GROUP BY 1, 2"))
def a23(spark, d):
    bucket = F.ntile(10).over(Window.partitionBy("year").orderBy("score", "stock_id", "date"))
    return ranked(spark, d).withColumn("bucket", bucket).groupBy("year", "bucket").agg(F.count("*").alias("n"), r(F.avg("ret"), "mean"))


CTES["spearman"] = (("ranked",), """SELECT date, year(date)::INTEGER AS year, CASE WHEN count(*) >= 3 AND stddev_pop(ar) > 1e-12 AND stddev_pop(rr) > 1e-12 THEN (avg(ar * rr) - avg(ar) * avg(rr)) / nullif(stddev_pop(ar) * stddev_pop(rr), 0) END AS rho
FROM (SELECT *, rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0::DOUBLE AS rr FROM ranked) GROUP BY 1, 2""")


@query("a34_daily_spearman", with_ctes(("spearman",), f"SELECT date, {rq('rho', 'spearman')} FROM spearman"))
def a34(spark, d):
    return R.daily_spearman(ranked(spark, d), "score", "ret").select("date", r(F.col("spearman"), "spearman"))


@query("a33_yearly_ranking", with_ctes(("ranked", "spearman"), f""", sp AS (SELECT year(date)::INTEGER AS year, t - b AS spread FROM (SELECT date, avg(ret) FILTER (WHERE pct > 80) AS t, avg(ret) FILTER (WHERE pct <= 20) AS b FROM ranked GROUP BY 1) WHERE t IS NOT NULL AND b IS NOT NULL)
SELECT a.year, days, spread, positive_days, rho_mean, rho_median FROM (SELECT year, count(*) AS days, {rq('avg(spread)', 'spread')}, {rq('avg((spread > 0)::INTEGER)', 'positive_days')} FROM sp GROUP BY 1) a JOIN (SELECT year, {rq('avg(rho)', 'rho_mean')}, {rq('median(rho)', 'rho_median')} FROM spearman GROUP BY 1) b USING (year)"""))
def a33(spark, d):
    s = ranked(spark, d)
    spread = R.daily_spread(s, "pct", "ret", 20).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("days"), r(F.avg("spread"), "spread"), r(F.avg((F.col("spread") > 0).cast("int")), "positive_days"))
    rho = R.daily_spearman(s, "score", "ret").groupBy(F.year("date").alias("year")).agg(r(F.avg("spearman"), "rho_mean"), r(F.median("spearman"), "rho_median"))
    return spread.join(rho, "year")


@query("a37_return_metrics", with_ctes(("ranked",), f"""SELECT year, sum(n)::BIGINT AS n, count(*) AS days, {rq('avg(m)', 'daily_mean')}, {rq('sum(t) / sum(n)', 'mean')}, {rq('sum(u) / sum(n)', 'positive')}, {rq('sum(h) / sum(n)', 'up5')}, {rq('sum(l) / sum(n)', 'down5')}
FROM (SELECT year, date, avg(ret) AS m, count(*) AS n, sum(ret) AS t, count(*) FILTER (WHERE ret > 0) AS u, count(*) FILTER (WHERE ret >= 0.05) AS h, count(*) FILTER (WHERE ret <= -0.05) AS l FROM ranked GROUP BY 1, 2) GROUP BY 1"""))
def a37(spark, d):
    m = R.return_metrics(ranked(spark, d), "ret", ["year"])
    return m.select("year", "n", "days", *[r(F.col(c), c) for c in ("daily_mean", "mean", "positive", "up5", "down5")])


@query("a19_liquidity_sensitivity", with_ctes(("scores",), f""", e AS (SELECT *, count(*) OVER w AS n, rank() OVER (PARTITION BY t, date ORDER BY score) + (count(*) OVER (PARTITION BY t, date, score) - 1) / 2.0::DOUBLE AS ar FROM scores, (VALUES (20000.0::DOUBLE), (50000.0::DOUBLE), (100000.0::DOUBLE)) v(t) WHERE money >= t WINDOW w AS (PARTITION BY t, date)),
x AS (SELECT t, date, avg(ret) FILTER (WHERE p > 80) - avg(ret) FILTER (WHERE p <= 20) AS spread FROM (SELECT *, 100 * (ar - 1) / (n - 1) AS p FROM e WHERE n >= 5) GROUP BY 1, 2)
SELECT t AS threshold, count(spread) AS days, {rq('avg(spread)', 'spread')} FROM x GROUP BY 1"""))
def a19(spark, d):
    s = scores(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (2e4, 5e4, 1e5)]))).where("money >= threshold")
    n = F.count("*").over(Window.partitionBy("threshold", "date"))
    s = s.withColumn("n", n).withColumn("ar", R.average_rank("score", ["threshold", "date"])).where("n >= 5").withColumn("p", 100 * (F.col("ar") - 1) / (F.col("n") - 1))
    x = s.groupBy("threshold", "date").agg((F.avg(F.when(F.col("p") > 80, F.col("ret"))) - F.avg(F.when(F.col("p") <= 20, F.col("ret")))).alias("spread"))
    return x.groupBy("threshold").agg(F.count("spread").alias("days"), r(F.avg("spread"), "spread"))


@query("f15_period_slices", with_ctes(("ranked",), f"SELECT p AS period, count(*) AS n, {rq('avg(ret)', 'mean')} FROM (SELECT ret, unnest(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN year <= 1998 THEN 'development' END, CASE WHEN year > 1998 THEN 'confirmation' END, CASE WHEN year > 1998 AND year < (SELECT max(year) FROM ranked) THEN 'confirmation_ex_latest' END], lambda x: x IS NOT NULL)) AS p FROM ranked) GROUP BY 1"))
def f15(spark, d):
    s = ranked(spark, d)
    latest = s.agg(F.max("year").alias("latest"))
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("year") <= 1998, "development"), F.when(F.col("year") > 1998, "confirmation"), F.when((F.col("year") > 1998) & (F.col("year") < F.col("latest")), "confirmation_ex_latest")))
    return s.crossJoin(F.broadcast(latest)).select("ret", F.explode(names).alias("period")).groupBy("period").agg(F.count("*").alias("n"), r(F.avg("ret"), "mean"))


@query("m16_rank_target", with_ctes(("ranked",), f"SELECT stock_id, date, {rq('(rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0::DOUBLE) / n', 'target')} FROM ranked"))
def m16(spark, d):
    return ranked(spark, d).select("stock_id", "date", r(R.average_rank("ret", ["date"]) / F.col("n_stocks"), "target"))
