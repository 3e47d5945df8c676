"""Queries of interval coverage and event histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import event_history as E
from tidepanel.operators import intervals as I
from tidepanel.plans.adapter import actions, cells, table, with_ctes
from tidepanel.plans.core import query


@query(
    "o01_open_intervals",
    """WITH c AS (SELECT o_custkey AS k, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 90)::INTEGER AS b FROM orders WHERE o_orderkey % 5 <> 0),
q AS (SELECT DISTINCT o_custkey AS k, year(o_orderdate)::INTEGER AS year FROM orders),
d AS (SELECT k, year, unnest(generate_series(make_date(year, 1, 1), make_date(year, 12, 31), INTERVAL 1 DAY))::DATE AS day FROM q),
h AS (SELECT DISTINCT k, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM c),
o AS (SELECT k, year, day, day - row_number() OVER (PARTITION BY k, year ORDER BY day)::INTEGER AS run FROM d ANTI JOIN h USING (k, day))
SELECT k AS custkey, year, min(day) AS start, max(day) AS "end" FROM o GROUP BY k, year, run""",
)
def o01(spark, d):
    """What each customer's years still lack after their orders' intervals, four fifths of which are complete."""
    day = F.to_date("o_orderdate")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), day.alias("start"), F.date_add(day, (F.col("o_orderkey") % 90).cast("int")).alias("end"), (F.col("o_orderkey") % 5 != 0).alias("complete"))
    asked = orders.select("custkey", F.year("start").alias("year")).distinct().select("custkey", "year", F.make_date("year", F.lit(1), F.lit(1)).alias("start"), F.make_date("year", F.lit(12), F.lit(31)).alias("end"))
    return I.still_open(asked, orders.where("complete").select("custkey", "start", "end"), ["custkey"])


@query(
    "s20_event_history",
    with_ctes(("cells", "actions"), "SELECT c.stock_id, a.date AS event_date, c.date, (c.date - a.date)::INTEGER AS days, c.close, c.volume FROM (SELECT DISTINCT stock_id, date FROM actions) a JOIN cells c ON c.stock_id = a.stock_id AND c.date BETWEEN a.date - 60 AND a.date + 10 WHERE open > 0 AND high > 0 AND low > 0 AND close > 0"),
)
def s20(spark, d):
    """The weeks around each corporate action, from sixty days ahead to ten days past it."""
    events = actions(spark, d).select("stock_id", F.col("date").alias("event_date")).distinct()
    return E.event_history(events, cells(spark, d)).select("stock_id", "event_date", "date", "days", "close", "volume")
