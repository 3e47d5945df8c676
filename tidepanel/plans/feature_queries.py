"""Queries of the trailing features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.operators import features as X
from tidepanel.plans.adapter import CTES, calendar, cells, panel, with_ctes
from tidepanel.plans.core import query

MONEY = 50_000.0
W = "PARTITION BY stock_id ORDER BY idx ROWS BETWEEN {} PRECEDING AND CURRENT ROW"


def frame(n: int) -> str:
    return f"({W.format(n - 1)})"


def share_sql(net: str, n: int) -> str:
    return f"CASE WHEN sum(volume) OVER {frame(n)} > 0 THEN 100 * sum({net}) OVER {frame(n)} / sum(volume) OVER {frame(n)} ELSE 0.0::DOUBLE END"


def r(c, name: str, digits: int = 6):
    return (F.round(c, digits) + F.lit(0.0)).alias(name)


def rq(text: str, name: str, digits: int = 6) -> str:
    return f"round({text}, {digits}) + 0.0::DOUBLE AS {name}"


@query("j01_dense_panel", with_ctes(("panel",), "SELECT stock_id, date, idx, present, volume, money, total_net FROM panel"))
def j01(spark, d):
    return panel(spark, d).select("stock_id", "date", "idx", "present", "volume", "money", "total_net")


_SHARES = [(net, n) for net in X.NETS for n in (1, 3, 5, 10, 20)]


@query("w01_flow_share", with_ctes(("panel",), "SELECT stock_id, date, " + ", ".join(rq(share_sql(net, n), f"{net}_{n}") for net, n in _SHARES) + " FROM panel"))
def w01(spark, d):
    return panel(spark, d).select("stock_id", "date", *[r(X.flow_share(net, n), f"{net}_{n}") for net, n in _SHARES])


@query("w02_buy_day_ratio", with_ctes(("panel",), "SELECT stock_id, date, " + ", ".join(f"sum(({net} > 0)::INTEGER) OVER {frame(n)} / {n}.0::DOUBLE AS {net}_{n}" for net, n in _SHARES if n >= 5) + " FROM panel"))
def w02(spark, d):
    return panel(spark, d).select("stock_id", "date", *[X.buy_day_ratio(net, n).alias(f"{net}_{n}") for net, n in _SHARES if n >= 5])


@query(
    "w03_signed_streak",
    with_ctes(
        ("panel",),
        """, s AS (SELECT stock_id, idx, date, sign(total_net)::INTEGER AS sg FROM panel),
i AS (SELECT *, sum(st) OVER (PARTITION BY stock_id ORDER BY idx) AS island FROM (SELECT *, CASE WHEN sg = lag(sg) OVER (PARTITION BY stock_id ORDER BY idx) THEN 0 ELSE 1 END AS st FROM s))
SELECT stock_id, date, (row_number() OVER (PARTITION BY stock_id, island ORDER BY idx) * sg)::BIGINT AS streak FROM i""",
    ),
)
def w03(spark, d):
    return X.signed_streak(panel(spark, d), "total_net").select("stock_id", "date", "streak")


@query("w04_rolling_median", with_ctes(("panel",), f"SELECT stock_id, date, {rq(f'quantile_cont(money, 0.5) OVER {frame(20)}', 'median_money', 4)}, {rq(f'quantile_cont(volume, 0.5) OVER {frame(20)}', 'median_volume', 4)} FROM panel"))
def w04(spark, d):
    half = F.lit(0.5)
    return panel(spark, d).select("stock_id", "date", r(F.percentile("money", half).over(X.trailing(20)), "median_money", 4), r(F.percentile("volume", half).over(X.trailing(20)), "median_volume", 4))


_ZERO = f"list_max(list_transform(string_split(string_agg(CASE WHEN volume = 0 THEN 'z' ELSE '.' END, '') OVER {frame(20)}, '.'), lambda x: length(x)))::BIGINT"


@query("w05_longest_zero_run", with_ctes(("panel",), f"SELECT stock_id, date, {_ZERO} AS zero_run FROM panel"))
def w05(spark, d):
    return panel(spark, d).select("stock_id", "date", X.longest_zero_run("volume", 20).alias("zero_run"))


def _agree(n: int) -> str:
    return "(" + " + ".join(f"sign(sum({net}) OVER {frame(n)})" for net in X.NETS[:3]) + ") / 3.0::DOUBLE"


@query("w06_agreement", with_ctes(("panel",), "SELECT stock_id, date, " + ", ".join(rq(_agree(n), f"agreement_{n}") for n in (1, 5, 20)) + " FROM panel"))
def w06(spark, d):
    return panel(spark, d).select("stock_id", "date", *[r(X.agreement(n), f"agreement_{n}") for n in (1, 5, 20)])


@query("w07_acceleration", with_ctes(("panel",), f"SELECT stock_id, date, {rq(share_sql('total_net', 5) + ' - ' + share_sql('total_net', 20), 'acceleration')} FROM panel"))
def w07(spark, d):
    return panel(spark, d).select("stock_id", "date", r(X.acceleration(), "acceleration"))


_VALID = "(coalesce(open > 0, false) AND coalesce(close > 0, false) AND volume > 0 AND money > 0)"


@query("w08_trailing_counts", with_ctes(("panel",), f"SELECT stock_id, date, sum({_VALID}::INTEGER) OVER {frame(20)}::BIGINT AS normal_days, sum((total_net <> 0)::INTEGER) OVER {frame(20)}::BIGINT AS flow_days FROM panel"))
def w08(spark, d):
    w = X.trailing(20)
    return panel(spark, d).select("stock_id", "date", F.sum(X.valid_signal().cast("long")).over(w).alias("normal_days"), F.sum((F.col("total_net") != 0).cast("long")).over(w).alias("flow_days"))


@query("f01_f03_price_validity", with_ctes(("panel",), f"SELECT count(*) FILTER (WHERE {_VALID}) AS signal_ok, count(*) FILTER (WHERE coalesce(open, 0) > 0 AND coalesce(close, 0) > 0 AND volume > 0) AS entry_ok, count(*) FILTER (WHERE coalesce(close, 0) > 0) AS close_ok, count(*) AS days FROM panel"))
def f01(spark, d):
    ok = lambda c: F.coalesce(F.col(c), F.lit(0.0)) > 0
    return panel(spark, d).agg(F.count_if(X.valid_signal()).alias("signal_ok"), F.count_if(ok("open") & ok("close") & (F.col("volume") > 0)).alias("entry_ok"), F.count_if(ok("close")).alias("close_ok"), F.count("*").alias("days"))


CTES["liquid"] = (
    ("panel",),
    f"""SELECT *, history = 20 AND normal_days >= 18 AND median_money >= {MONEY} AND zero_run < 3 AS liquid FROM (
SELECT *, count(*) OVER {frame(20)} AS history, sum({_VALID}::INTEGER) OVER {frame(20)}::BIGINT AS normal_days, quantile_cont(money, 0.5) OVER {frame(20)} AS median_money,
  {_ZERO} AS zero_run, coalesce(lead(open) OVER (PARTITION BY stock_id ORDER BY idx) > 0, false) AS entry_ready FROM panel)""",
)
_REASON = f"CASE WHEN history < 20 THEN 'short_history' WHEN normal_days < 18 THEN 'few_normal_days' WHEN zero_run >= 3 THEN 'zero_volume_run' WHEN median_money < {MONEY} THEN 'low_money' WHEN NOT entry_ready THEN 'no_entry_price' ELSE 'eligible' END"


@query("f06_liquidity_screen", with_ctes(("liquid",), "SELECT stock_id, date, normal_days, zero_run, liquid, liquid AND entry_ready AS sample FROM liquid"))
def f06(spark, d):
    return X.liquidity(panel(spark, d), MONEY).select("stock_id", "date", F.col("normal_days").cast("long"), "zero_run", "liquid", (F.col("liquid") & F.col("entry_ready")).alias("sample"))


@query("f10_exclusion_reasons", with_ctes(("liquid",), f"SELECT {_REASON} AS reason, count(*) AS days FROM liquid GROUP BY 1"))
def f10(spark, d):
    return X.liquidity(panel(spark, d), MONEY).groupBy(X.exclusion(None, MONEY).alias("reason")).agg(F.count("*").alias("days"))


@query("f08_scoring_eligibility", with_ctes(("liquid",), f"""SELECT stock_id, date, market, n_stocks FROM (SELECT *, count(*) OVER (PARTITION BY market, date) AS n_stocks FROM (SELECT *, CASE WHEN stock_id::BIGINT % 2 = 0 THEN 'tpex' ELSE 'twse' END AS market, quantile_cont(volume, 0.5) OVER {frame(20)} / 10 AS lots FROM liquid)
WHERE normal_days >= 18 AND zero_run < 3 AND CASE market WHEN 'tpex' THEN median_money >= 50000 ELSE median_money >= 60000 AND lots >= 5 END) WHERE n_stocks >= 3"""))
def f08(spark, d):
    market = F.when(F.col("stock_id").cast("long") % 2 == 0, "tpex").otherwise("twse")
    return X.scoring_ready(panel(spark, d), market, {"tpex": (MONEY, 0.0), "twse": (60_000.0, 5.0)}, 3, lot=10.0).select("stock_id", "date", "market", "n_stocks")


@query("a07_liquidity_thresholds", with_ctes(("liquid",), "SELECT t AS threshold, count(*) FILTER (WHERE history = 20 AND normal_days >= 18 AND zero_run < 3 AND median_money >= t) AS samples FROM liquid, (VALUES (10000.0::DOUBLE), (50000.0::DOUBLE), (100000.0::DOUBLE), (200000.0::DOUBLE)) v(t) GROUP BY 1"))
def a07(spark, d):
    at = F.explode(F.array(*[F.lit(t) for t in (1e4, 5e4, 1e5, 2e5)]))
    rows = X.liquidity(panel(spark, d), MONEY).select("history", "normal_days", "zero_run", "median_money", at.alias("threshold"))
    return rows.groupBy("threshold").agg(F.count_if(F.expr("history = 20 and normal_days >= 18 and zero_run < 3 and median_money >= threshold")).alias("samples"))


@query("a08_price_summary", with_ctes(("panel",), """SELECT stock_id, min(date) FILTER (WHERE present) AS first_date, max(date) FILTER (WHERE present) AS last_date, count(*) FILTER (WHERE present) AS n_days,
  round(quantile_cont(money, 0.5) FILTER (WHERE place <= 20), 4) AS last_median_money FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY idx DESC) AS place FROM panel) GROUP BY 1"""))
def a08(spark, d):
    place = F.row_number().over(Window.partitionBy("stock_id").orderBy(F.desc("idx")))
    p = panel(spark, d).withColumn("place", place)
    here = lambda c: F.when(F.col("present"), F.col(c))
    return p.groupBy("stock_id").agg(F.min(here("date")).alias("first_date"), F.max(here("date")).alias("last_date"), F.count_if("present").alias("n_days"), F.round(F.percentile(F.when(F.col("place") <= 20, F.col("money")), 0.5), 4).alias("last_median_money"))


@query("w14_market_day_index", with_ctes(("cells", "cal"), "SELECT stock_id, date, idx FROM cells JOIN cal USING (date)"))
def w14(spark, d):
    return cells(spark, d).select("stock_id", "date").join(F.broadcast(calendar(spark, d)), "date").select("stock_id", "date", "idx")


@query("w24_last_market_dates", with_ctes(("cells", "cal"), "SELECT stock_id, date, volume FROM cells JOIN cal USING (date) WHERE idx > (SELECT max(idx) FROM cal) - 100"))
def w24(spark, d):
    last = calendar(spark, d).orderBy(F.desc("idx")).limit(100).select("date")
    return cells(spark, d).join(F.broadcast(last), "date", "left_semi").select("stock_id", "date", "volume")


@query("t03_last_rows_per_stock", with_ctes(("cells",), "SELECT stock_id, date, close FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) AS n FROM cells) WHERE n <= 20"))
def t03(spark, d):
    n = F.row_number().over(Window.partitionBy("stock_id").orderBy(F.desc("date")))
    return cells(spark, d).withColumn("n", n).where("n <= 20").select("stock_id", "date", "close")
