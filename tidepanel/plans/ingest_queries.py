"""Queries of resumable downloads (X09, X12): what is pending, the end state of several rounds, their history and what may follow.

Suppliers are the securities, their weeks the stored rows; the outcomes of rounds are read off the suppliers' numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.plans.adapter import CTES, calendar, cells, stock_key, table, with_ctes
from tidepanel.plans.core import query
from tidepanel.streaming import ingest as N

DATASETS = {"flows": "exchange", "prices": "exchange"}


def _target(spark, d) -> str:
    return str(calendar(spark, d).agg(F.max("date")).first()[0])


def universe(spark, d):
    """Every supplier; each seventh was listed in the last year."""
    listed = F.when(F.col("s_suppkey") % 7 == 0, F.date_sub(F.lit(_target(spark, d)).cast("date"), (F.col("s_suppkey") % 200).cast("int")))
    return table(spark, d, "supplier").select(stock_key("s_suppkey").alias("stock_id"), listed.alias("listing_date"))


def latest(spark, d):
    """The last week of each supplier's prices and of its flows; each eleventh has none."""
    c = cells(spark, d).where("cast(stock_id as long) % 11 <> 0")
    prices = c.groupBy("stock_id").agg(F.max("date").alias("latest")).withColumn("dataset", F.lit("prices"))
    return prices.unionByName(c.where("foreign_net + trust_net + dealer_net <> 0").groupBy("stock_id").agg(F.max("date").alias("latest")).withColumn("dataset", F.lit("flows")))


def outcomes(spark, d):
    """Two rounds: in the first a tenth fails and a fifth is refused or put off, in the second half of these succeed; each thirteenth was never asked."""
    k = F.col("s_suppkey")
    asked = table(spark, d, "supplier").where(k % 13 != 0).select(k, stock_key("s_suppkey").alias("stock_id"), F.explode(F.array(F.lit("flows"), F.lit("prices"))).alias("dataset"))
    fate = (k * 7 + F.length("dataset")) % 10
    first = asked.withColumn("status", F.when(fate == 0, "failed").when(fate == 1, "quota_exceeded").when(fate == 2, "deferred").otherwise("complete")).withColumn("round", F.lit(1))
    second = first.where("status <> 'complete'").withColumn("status", F.when(k % 2 == 0, "complete").otherwise("failed")).withColumn("round", F.lit(2))
    return first.unionByName(second).select("stock_id", "dataset", "status", "round", F.floor(k / 25).alias("batch"), F.lit(_target(spark, d)).cast("date").alias("end"))


CTES["target"] = (("cal",), "SELECT max(date) AS goal FROM cal")
CTES["universe"] = (("target",), "SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS stock_id, s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN goal - (s_suppkey % 200)::INTEGER END AS listing_date, dataset, goal FROM supplier, target, (VALUES ('flows'), ('prices')) v(dataset)")
CTES["latest"] = (("cells",), "SELECT 'prices' AS dataset, stock_id, max(date) AS latest FROM cells WHERE stock_id::BIGINT % 11 <> 0 GROUP BY 2 UNION ALL SELECT 'flows', stock_id, max(date) FROM cells WHERE stock_id::BIGINT % 11 <> 0 AND foreign_net + trust_net + dealer_net <> 0 GROUP BY 2")
CTES["round1"] = (("universe",), "SELECT stock_id, dataset, k, 1 AS round, CASE (k * 7 + length(dataset)) % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'quota_exceeded' WHEN 2 THEN 'deferred' ELSE 'complete' END AS status FROM universe WHERE k % 13 <> 0")
CTES["outcomes"] = (("round1",), "SELECT * FROM round1 UNION ALL SELECT stock_id, dataset, k, 2, CASE WHEN k % 2 = 0 THEN 'complete' ELSE 'failed' END FROM round1 WHERE status <> 'complete'")
CTES["report"] = (("universe", "latest", "outcomes"), """SELECT u.dataset, u.stock_id, coalesce(o.status, 'pending') AS status, o.round, l.latest, coalesce(l.latest >= u.goal, false) AS reached
FROM universe u LEFT JOIN (SELECT dataset, stock_id, arg_max(status, round) AS status, max(round) AS round FROM outcomes GROUP BY 1, 2) o USING (dataset, stock_id) LEFT JOIN latest l USING (dataset, stock_id)""")


@query("x09_pending_requests", with_ctes(("universe", "latest", "outcomes"), """SELECT u.dataset, u.stock_id, coalesce(l.latest + 1, greatest(goal - 180, coalesce(listing_date, goal - 180))) AS start, goal AS "end", l.latest
FROM universe u LEFT JOIN latest l USING (dataset, stock_id) WHERE NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.dataset = u.dataset AND o.stock_id = u.stock_id AND status = 'complete')"""))
def x09_pending(spark, d):
    """What a third round would ask for."""
    return N.pending_requests(universe(spark, d), latest(spark, d), outcomes(spark, d), DATASETS, _target(spark, d), 180).drop("service")


@query("x12_status_report", with_ctes(("report",), "SELECT * FROM report"))
def x12_report(spark, d):
    """The end state of every request after two rounds."""
    return N.status_report(universe(spark, d), DATASETS, outcomes(spark, d), latest(spark, d), _target(spark, d))


@query("x12_batch_history", with_ctes(("outcomes",), """SELECT *, sum(completed) OVER (ORDER BY round, batch)::BIGINT AS completed_after FROM (SELECT round, k // 25 AS batch, count(DISTINCT stock_id) AS stocks, count(*) FILTER (WHERE status = 'complete') AS completed,
  count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'deferred') AS deferred, count(*) FILTER (WHERE status = 'quota_exceeded') > 0 AS quota_exhausted, count(*) FILTER (WHERE status <> 'deferred') AS asked FROM outcomes GROUP BY 1, 2)"""))
def x12_history(spark, d):
    return N.batch_history(outcomes(spark, d))


@query("x12_pipeline_status", with_ctes(("report",), "SELECT count(*) AS expected, count(*) FILTER (WHERE status = 'complete') AS completed, count(*) FILTER (WHERE status IN ('failed', 'quota_exceeded')) AS failed, count(*) FILTER (WHERE reached) AS reached, round(count(*) FILTER (WHERE reached) / count(*), 9) AS share, CASE WHEN count(*) FILTER (WHERE status = 'complete') < count(*) THEN 'INCOMPLETE_DOWNLOAD' WHEN count(*) FILTER (WHERE reached) / count(*) < 0.98 THEN 'BLOCKED_SOURCE_COVERAGE' ELSE 'READY' END AS status FROM report"))
def x12_status(spark, d):
    return N.pipeline_status(x12_report(spark, d), 0.98).withColumn("share", F.round("share", 9))
