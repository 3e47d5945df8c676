"""Queries of runs, entries, cooldowns and breakdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import runs as X
from tidepanel.plans.adapter import CTES, with_ctes
from tidepanel.plans.core import query
from tidepanel.plans.feature_queries import r, rq
from tidepanel.plans.ranking_queries import ranked

CTES["runs"] = (
    ("ranked",),
    """SELECT *, row_number() OVER (PARTITION BY stock_id, island ORDER BY idx) AS run_length, min(idx) OVER (PARTITION BY stock_id, island) AS episode_start, max(idx) OVER (PARTITION BY stock_id, island) AS episode_end, count(*) OVER (PARTITION BY stock_id, island) AS episode_length
FROM (SELECT stock_id, date, year, idx, pct, ret, idx - row_number() OVER (PARTITION BY stock_id ORDER BY idx) AS island FROM ranked WHERE pct >= 70)""",
)
CTES["entries"] = (("runs",), "SELECT * FROM runs WHERE run_length = 2")


def runs(spark, d, more: dict | None = None, days=None):
    return X.runs(ranked(spark, d, more, days).select("stock_id", "date", "year", "idx", "pct", "ret", *(more or {})), "pct", 70)


def entries(spark, d, more: dict | None = None, days=None):
    return runs(spark, d, more, days).where("run_length = 2")


@query("w15_w16_runs", with_ctes(("runs",), "SELECT stock_id, idx, run_length, episode_start, episode_end, episode_length FROM runs"))
def w15(spark, d):
    return runs(spark, d).select("stock_id", "idx", "run_length", "episode_start", "episode_end", "episode_length")


@query("w18_entry_events", with_ctes(("runs",), "SELECT stock_id, idx, 'top30_confirm' || run_length || 'd' AS rule FROM runs WHERE run_length IN (1, 2, 3, 5)"))
def w18(spark, d):
    return runs(spark, d).where(F.col("run_length").isin(1, 2, 3, 5)).select("stock_id", "idx", F.format_string("top30_confirm%dd", "run_length").alias("rule"))


def _greedy(until: str, source: str) -> str:
    return f""", RECURSIVE_EVENTS AS (SELECT stock_id, idx, {until} AS until FROM {source})
SELECT k.stock_id, k.idx FROM (
WITH RECURSIVE kept(stock_id, idx, until) AS (
  SELECT stock_id, min(idx), arg_min(until, idx) FROM RECURSIVE_EVENTS GROUP BY 1
 UNION ALL
  SELECT k.stock_id, min(e.idx), arg_min(e.until, e.idx) FROM kept k JOIN RECURSIVE_EVENTS e ON e.stock_id = k.stock_id AND e.idx > k.until + 10 GROUP BY k.stock_id, k.idx)
SELECT * FROM kept) k"""


@query("w17_cooldown_after_end", with_ctes(("entries",), _greedy("episode_end", "entries")))
def w17a(spark, d):
    return X.cooled(entries(spark, d), 10, after_end=True).select("stock_id", "idx")


@query("w17_cooldown_after_event", with_ctes(("entries",), _greedy("idx", "entries")))
def w17b(spark, d):
    return X.cooled(entries(spark, d), 10, after_end=False).select("stock_id", "idx")


_BUCKET = "CASE WHEN m IS NULL THEN 'missing' WHEN m < -20 THEN 'falling' WHEN m < 0 THEN 'slightly_falling' WHEN m < 20 THEN 'slightly_rising' ELSE 'rising' END"


@query("j13_momentum_days_ago", with_ctes(("ranked",), f"SELECT bucket, count(*) AS n, {rq('avg(ret)', 'mean')} FROM (SELECT ret, {_BUCKET} AS bucket FROM (SELECT a.ret, a.pct - b.pct AS m FROM ranked a LEFT JOIN ranked b ON b.stock_id = a.stock_id AND b.idx = a.idx - 5)) GROUP BY 1"))
def j13(spark, d):
    m = F.col("m")
    bucket = F.when(m.isNull(), "missing").when(m < -20, "falling").when(m < 0, "slightly_falling").when(m < 20, "slightly_rising").otherwise("rising")
    s = ranked(spark, d).withColumn("m", F.col("pct") - X.score_days_ago("pct", 5))
    return s.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), r(F.avg("ret"), "mean"))


@query("j14_extension_states", with_ctes(("entries", "ranked"), f"SELECT state, count(*) AS n, {rq('avg(ret)', 'mean')} FROM (SELECT e.ret, CASE WHEN b.pct IS NULL THEN 'no_score' WHEN b.pct >= 90 THEN 'strong' WHEN b.pct >= 70 THEN 'extended' ELSE 'weakened' END AS state FROM entries e LEFT JOIN ranked b ON b.stock_id = e.stock_id AND b.idx = e.idx + 20) GROUP BY 1"))
def j14(spark, d):
    ahead = ranked(spark, d).select("stock_id", "date", "idx", X.score_days_ahead("pct", 20).alias("ahead"))
    state = F.when(F.col("ahead").isNull(), "no_score").when(F.col("ahead") >= 90, "strong").when(F.col("ahead") >= 70, "extended").otherwise("weakened")
    return entries(spark, d).join(ahead.select("stock_id", "idx", "ahead"), ["stock_id", "idx"]).groupBy(state.alias("state")).agg(F.count("*").alias("n"), r(F.avg("ret"), "mean"))


@query("j15_breakdowns", with_ctes(("entries", "ranked"), "SELECT e.stock_id, e.idx, count(b.pct) AS seen, min(b.idx - e.idx) FILTER (WHERE b.pct < 50)::INTEGER AS first_below FROM entries e LEFT JOIN ranked b ON b.stock_id = e.stock_id AND b.idx BETWEEN e.idx + 1 AND e.idx + 20 GROUP BY 1, 2"))
def j15(spark, d):
    return X.breakdowns(entries(spark, d), ranked(spark, d), "pct", 50, 20).select("stock_id", "idx", "seen", "first_below")


@query("a39_signal_age", with_ctes(("runs",), f"SELECT CASE WHEN run_length = 1 THEN '1' WHEN run_length <= 3 THEN '2-3' WHEN run_length <= 5 THEN '4-5' WHEN run_length <= 10 THEN '6-10' ELSE '11+' END AS age, count(*) AS n, {rq('avg(ret)', 'mean')} FROM runs GROUP BY 1"))
def a39(spark, d):
    n = F.col("run_length")
    age = F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 5, "4-5").when(n <= 10, "6-10").otherwise("11+")
    return runs(spark, d).groupBy(age.alias("age")).agg(F.count("*").alias("n"), r(F.avg("ret"), "mean"))


@query("a38_entry_rules", with_ctes(("runs",), f"SELECT run_length AS confirmation, year, count(*) AS events, count(DISTINCT stock_id) AS stocks, {rq('avg(ret)', 'mean')}, {rq('avg((ret > 0)::INTEGER)', 'positive')} FROM runs WHERE run_length IN (1, 2, 3, 5) GROUP BY 1, 2"))
def a38(spark, d):
    return runs(spark, d).where(F.col("run_length").isin(1, 2, 3, 5)).groupBy(F.col("run_length").alias("confirmation"), "year").agg(F.count("*").alias("events"), F.count_distinct("stock_id").alias("stocks"), r(F.avg("ret"), "mean"), r(F.avg((F.col("ret") > 0).cast("int")), "positive"))
