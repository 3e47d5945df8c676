"""Queries of stored samples (S13, S16, S19, O10): research frames, the latest whole cross-section, event outcomes, repairs that are open."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.plans.adapter import CTES, actions, stock_key, table, with_ctes
from tidepanel.plans.core import query
from tidepanel.plans.feature_queries import r, rq
from tidepanel.plans.model_queries import training
from tidepanel.sources import results as K
from tidepanel.sources import shards as S



def shard_rows(spark, d):
    """The training rows as stored samples: two markets, some rows with short features or too little trading."""
    k = F.col("stock_id").cast("long")
    t = training(spark, d)
    return t.select(F.when(k % 2 == 0, "even").otherwise("odd").alias("market"), "year", "date", "stock_id", F.when((k + F.dayofyear("date")) % 9 == 0, "short").otherwise("ok").alias("feature_status"), ((k + F.month("date")) % 5 != 0).alias("liquid"), "foreign_net_20", "ret")


CTES["shard_rows"] = (("training",), "SELECT CASE WHEN stock_id::BIGINT % 2 = 0 THEN 'even' ELSE 'odd' END AS market, year, date, stock_id, CASE WHEN (stock_id::BIGINT + dayofyear(date)) % 9 = 0 THEN 'short' ELSE 'ok' END AS feature_status, (stock_id::BIGINT + month(date)) % 5 <> 0 AS liquid, foreign_net_20, ret FROM training")


@query("s16_latest_cross_section", with_ctes(("shard_rows",), f""", live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, stock_id ORDER BY date DESC) AS n FROM shard_rows WHERE feature_status = 'ok') WHERE n <= 90 AND liquid),
d AS (SELECT market, max(date) AS date FROM (SELECT market, date FROM live GROUP BY 1, 2 HAVING count(DISTINCT stock_id) >= (SELECT max(n) / 2 FROM (SELECT count(DISTINCT stock_id) AS n FROM live GROUP BY market, date))) GROUP BY 1)
SELECT market, date, stock_id, {rq('foreign_net_20', 'foreign_net_20')} FROM live JOIN d USING (market, date)"""))
def s16(spark, d):
    """Each market's last date with half as many securities as its fullest one, and the usable rows of it."""
    rows = shard_rows(spark, d)
    live = rows.where("feature_status = 'ok'").withColumn("n", F.row_number().over(S.Window.partitionBy("market", "stock_id").orderBy(F.desc("date")))).where("n <= 90 and liquid")
    most = live.groupBy("market", "date").agg(F.count_distinct("stock_id").alias("n")).agg(F.max("n")).first()[0] or 0
    return S.latest_cross_section(rows, most / 2).select("market", "date", "stock_id", r(F.col("foreign_net_20"), "foreign_net_20"))


@query("s13_research_frame", with_ctes(("shard_rows",), "SELECT market, year, count(*) AS n, count(DISTINCT stock_id) AS stocks, " + rq("avg(ret)", "mean_return") + " FROM shard_rows WHERE feature_status = 'ok' AND liquid GROUP BY 1, 2"))
def s13(spark, d):
    usable = shard_rows(spark, d).where(S.usable())
    return usable.groupBy("market", "year").agg(F.count("*").alias("n"), F.count_distinct("stock_id").alias("stocks"), r(F.avg("ret"), "mean_return"))



@query("o10_open_repairs", "SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS stock_id FROM supplier WHERE NOT (s_suppkey % 2 = 1 AND s_suppkey % 3 <> 0)")
def o10(spark, d):
    """Suppliers without a complete marker of the present signature: odd ones have one unless their repair failed, each third did."""
    k = F.col("s_suppkey")
    suppliers = table(spark, d, "supplier").select(k, stock_key("s_suppkey").alias("stock_id"))
    markers = suppliers.select("stock_id", F.when(k % 2 == 1, "now").otherwise("old").alias("signature"), F.lit("v1").alias("version"), F.when(k % 3 == 0, "failed").otherwise("complete").alias("status"))
    return K.not_done(suppliers.select("stock_id"), markers, "stock_id", "now", "v1")


@query("s19_event_outcomes", with_ctes(("shard_rows", "actions"), f"SELECT stock_id, date, {rq('ret', 'ret')} FROM shard_rows s WHERE EXISTS (SELECT 1 FROM actions a WHERE a.stock_id = s.stock_id AND a.date = s.date)"))
def s19(spark, d):
    """The outcomes of the weeks with a corporate action."""
    events = actions(spark, d).select("stock_id", "date").distinct()
    return S.no_repeats(shard_rows(spark, d).join(events, ["stock_id", "date"], "left_semi"), ["stock_id", "date"]).select("stock_id", "date", r(F.col("ret"), "ret"))
