"""Queries of updates, tiers and checks of frames (C11, F13, J28, O03, S22, X08, and of X09 the open securities and the coverage gate)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import parsing as C
from tidepanel.operators import ranking as R
from tidepanel.operators import updates as U
from tidepanel.plans.adapter import calendar, cells, table, with_ctes
from tidepanel.plans.core import query
from tidepanel.plans.feature_queries import r, rq
from tidepanel.plans.ranking_queries import ranked

_TIERS = {"50": 50_000.0, "100": 100_000.0}


def _tier_sql(name: str, money: float) -> str:
    w = f"PARTITION BY date, money >= {money}"
    pct = f"CASE WHEN count(*) OVER ({w}) = 1 THEN 50 ELSE 100 * (rank() OVER ({w} ORDER BY score) + (count(*) OVER ({w}, score) - 1) / 2.0::DOUBLE - 1) / nullif(count(*) OVER ({w}) - 1, 0) END"
    return f"CASE WHEN money >= {money} THEN row_number() OVER ({w} ORDER BY score DESC, stock_id) END AS rank_{name}, CASE WHEN money >= {money} THEN count(*) OVER ({w}) END AS count_{name}, {rq(f'CASE WHEN money >= {money} THEN {pct} END', f'percentile_{name}')}"


@query("j28_liquidity_tiers", with_ctes(("ranked",), f"SELECT stock_id, date, {', '.join(_tier_sql(k, v) for k, v in _TIERS.items())}, CASE WHEN money >= 100000 THEN '100' WHEN money >= 50000 THEN '50' ELSE 'base' END AS tier FROM ranked"))
def j28(spark, d):
    t = R.tier_ranks(ranked(spark, d), "money", "score", _TIERS)
    return t.select("stock_id", "date", *[c for k in _TIERS for c in (F.col(f"rank_{k}").cast("long").alias(f"rank_{k}"), f"count_{k}", r(F.col(f"percentile_{k}"), f"percentile_{k}"))], "tier")


_PREFIXES = ("foreign_", "investment_trust_", "dealer_self_", "selected_total_", "agreement_", "foreignness_")
_NAME = f"list_extract({list(_PREFIXES)}, (p_partkey % 6 + 1)::INTEGER) || p_size"


@query("c11_feature_groups", f"""SELECT production, research, count(*) AS n FROM (SELECT CASE WHEN n LIKE 'foreign\\_%' ESCAPE '\\' THEN 'foreign' WHEN n LIKE 'investment\\_trust\\_%' ESCAPE '\\' THEN 'investment_trust' WHEN n LIKE 'dealer\\_self\\_%' ESCAPE '\\' THEN 'dealer_self' WHEN n LIKE 'selected\\_total\\_%' ESCAPE '\\' THEN 'selected_total' ELSE 'consensus' END AS production,
CASE WHEN n LIKE 'foreign\\_%' ESCAPE '\\' THEN 'foreign' WHEN n LIKE 'investment\\_trust\\_%' ESCAPE '\\' THEN 'investment_trust' WHEN n LIKE 'dealer\\_self\\_%' ESCAPE '\\' THEN 'dealer_self' ELSE 'consensus' END AS research FROM (SELECT {_NAME} AS n FROM part)) GROUP BY 1, 2""")
def c11(spark, d):
    name = F.concat(F.get(F.array(*map(F.lit, _PREFIXES)), (F.col("p_partkey") % 6).cast("int")), F.col("p_size").cast("string"))
    return table(spark, d, "part").groupBy(C.feature_group(name, True).alias("production"), C.feature_group(name, False).alias("research")).agg(F.count("*").alias("n"))


@query("s22_live_price", f"SELECT l_linenumber, count(*) AS n, {rq('avg(CASE WHEN coalesce(a, 0) <> 0 THEN a WHEN coalesce(b, 0) <> 0 THEN b ELSE c END)', 'price')} FROM (SELECT l_linenumber, CASE l_orderkey % 3 WHEN 0 THEN l_extendedprice WHEN 1 THEN 0 END AS a, CASE l_partkey % 2 WHEN 0 THEN l_quantity ELSE 0 END AS b, l_tax AS c FROM lineitem) GROUP BY 1")
def s22(spark, d):
    three, two = F.col("l_orderkey") % 3, F.col("l_partkey") % 2
    price = C.first_nonzero(F.when(three == 0, F.col("l_extendedprice")).when(three == 1, 0.0), F.when(two == 0, F.col("l_quantity")).otherwise(0.0), F.col("l_tax"))
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"), r(F.avg(price), "price"))


@query("f13_o03_frame_checks", with_ctes(("ranked",), """, f AS (SELECT CASE WHEN idx % 11 = 0 THEN NULL ELSE pct * 1.02::DOUBLE END AS s, stock_id, date FROM ranked UNION ALL SELECT pct, stock_id, date FROM ranked WHERE idx % 7 = 0),
k AS (SELECT date, sum(n - 1) AS repeated, count(*) AS stocks FROM (SELECT date, stock_id, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1)
SELECT 'no_key' AS issue, 0::BIGINT AS violations UNION ALL SELECT 'not_finite', count(*) FILTER (WHERE s IS NULL) FROM f UNION ALL SELECT 'outside', count(*) FILTER (WHERE s NOT BETWEEN 0 AND 100) FROM f
UNION ALL SELECT 'repeated', sum(repeated)::BIGINT FROM k UNION ALL SELECT 'thin_days', count(*) FILTER (WHERE stocks < 8) FROM k"""))
def f13(spark, d):
    s = ranked(spark, d)
    frame = s.select(F.when(F.col("idx") % 11 != 0, F.col("pct") * 1.02).alias("s"), "stock_id", "date").unionByName(s.where("idx % 7 = 0").select(F.col("pct").alias("s"), "stock_id", "date"))
    return R.frame_issues(frame, "s", 8)


@query("x08_target_dates", with_ctes(("cal",), """, a AS (SELECT o_orderkey AS id, o_orderdate::DATE + to_hours((o_orderkey % 24)::INTEGER) AS now, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE - (o_orderkey % 9 - 1)::INTEGER END AS as_of,
  CASE WHEN o_orderkey % 10 = 1 THEN o_orderdate::DATE - 7 WHEN o_orderkey % 10 = 2 THEN date_trunc('week', o_orderdate - INTERVAL 14 DAY)::DATE END AS explicit, CASE WHEN o_orderkey % 5 <> 0 THEN '14:30' END AS cutoff FROM orders),
b AS (SELECT *, coalesce(as_of, now::DATE) AS day, coalesce(as_of, now::DATE) < now::DATE OR (coalesce(as_of, now::DATE) = now::DATE AND coalesce(strftime(now, '%H:%M') >= cutoff, false)) AS included FROM a),
c AS (SELECT b.*, cal.date AS latest FROM b ASOF LEFT JOIN cal ON (CASE WHEN included THEN day ELSE day - 1 END) >= cal.date),
s AS (SELECT id, explicit, latest, CASE WHEN day > now::DATE THEN 'as_of_after_today' WHEN explicit > day THEN 'explicit_after_as_of' WHEN explicit IS NOT NULL AND explicit NOT IN (SELECT date FROM cal) THEN 'explicit_not_a_market_date' WHEN explicit IS NOT NULL THEN 'explicit'
  WHEN latest IS NULL THEN 'no_market_date' WHEN included THEN 'at_or_before_as_of' ELSE 'before_as_of' END AS source FROM c)
SELECT id, source, CASE WHEN source = 'explicit' THEN explicit WHEN source IN ('at_or_before_as_of', 'before_as_of') THEN latest END AS target FROM s"""))
def x08(spark, d):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    week = F.date_trunc("week", F.date_sub(day, 14)).cast("date")
    asks = table(spark, d, "orders").select(
        k.alias("id"), F.timestamp_add("HOUR", (k % 24).cast("int"), day.cast("timestamp")).alias("now"), F.when(k % 4 != 0, F.date_sub(day, (k % 9 - 1).cast("int"))).alias("as_of"),
        F.when(k % 10 == 1, F.date_sub(day, 7)).when(k % 10 == 2, week).alias("explicit"), F.when(k % 5 != 0, "14:30").alias("cutoff"),
    )
    return U.target_dates(asks, calendar(spark, d)).select("id", "source", "target")


_TARGET = "(SELECT max(date) FROM cal)"


def _last(spark, d) -> str:
    return str(calendar(spark, d).agg(F.max("date")).first()[0])


@query("x09_open_securities", with_ctes(("cells", "cal"), f"SELECT stock_id, latest, greatest(DATE '1992-01-01', coalesce(latest - 180, DATE '1992-01-01')) AS start FROM (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS stock_id, max(date) AS latest FROM supplier LEFT JOIN cells ON stock_id = lpad(s_suppkey::VARCHAR, 6, '0') WHERE s_suppkey % 5 <> 0 GROUP BY 1) WHERE latest IS NULL OR latest < {_TARGET}"))
def x09(spark, d):
    """Suppliers without a row on the newest date; each fifth was tried for it already."""
    key = F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("stock_id")
    s, last = table(spark, d, "supplier"), _last(spark, d)
    tried = s.where("s_suppkey % 5 = 0").select(key, F.lit(last).cast("date").alias("target"))
    return U.pending_updates(s.select(key), cells(spark, d), tried, last, "1992-01-01", 180)


@query("x09_coverage_gate", with_ctes(("cells", "cal"), f"SELECT count(*) AS stocks, count(c.stock_id) AS covered, round(count(c.stock_id) / count(*), 6) AS share, count(c.stock_id) / count(*) >= 0.98 AS passed FROM supplier LEFT JOIN (SELECT stock_id FROM cells WHERE date = {_TARGET}) c ON c.stock_id = lpad(s_suppkey::VARCHAR, 6, '0')"))
def x09_gate(spark, d):
    key = F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("stock_id")
    return U.coverage_gate(table(spark, d, "supplier").select(key), cells(spark, d), _last(spark, d), 0.98).withColumn("share", F.round("share", 6))
