"""Queries of forward returns and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import returns as X
from tidepanel.plans.adapter import CTES, actions, calendar, cells, eventful, with_ctes
from tidepanel.plans.core import query
from tidepanel.plans.feature_queries import r, rq

CTES["resolved"] = (
    ("actions",),
    """SELECT stock_id, date, arg_max(reference_price, (CASE action_type WHEN 'split' THEN 3 ELSE 1 END, reference_price)) FILTER (WHERE reference_price > 0) AS reference, list_sort(list(DISTINCT action_type)) AS action_types,
  coalesce(greatest(max(reference_price) - arg_max(reference_price, (CASE action_type WHEN 'split' THEN 3 ELSE 1 END, reference_price)), arg_max(reference_price, (CASE action_type WHEN 'split' THEN 3 ELSE 1 END, reference_price)) - min(reference_price)) > 0.01 * arg_max(reference_price, (CASE action_type WHEN 'split' THEN 3 ELSE 1 END, reference_price)), true) AS conflict
FROM actions GROUP BY 1, 2""",
)


def _returns(h: int) -> tuple[tuple[str, ...], str]:
    """A product is a sum of logarithms here; the fold of the operator differs in the last digits only."""
    w = f"(PARTITION BY stock_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return (
        ("panel", "resolved", "gone"),
        f"""SELECT stock_id, date, status, CASE WHEN status = 'ok' THEN target / entry - 1 END AS raw, CASE WHEN status = 'ok' THEN list_aggregate(fs, 'product') - 1 END AS adjusted,
  CASE WHEN status = 'ok' THEN list_max(list_transform(range(1, len(fs) + 1), lambda i: list_aggregate(fs[1:i], 'product'))) - 1 END AS highest,
  CASE WHEN status = 'ok' THEN list_min(list_transform(range(1, len(fs) + 1), lambda i: list_aggregate(fs[1:i], 'product'))) - 1 END AS lowest, acts
FROM (SELECT *, CASE WHEN n < {h} THEN 'insufficient_future_data' WHEN d1 >= last_date THEN 'delisted_before_entry' WHEN dh >= last_date THEN 'delisted_before_target' WHEN NOT coalesce(entry > 0 AND c1 > 0, false) THEN 'unavailable_entry_price'
    WHEN NOT coalesce(target > 0, false) THEN 'unavailable_target_price' WHEN bad THEN 'invalid_data' ELSE 'ok' END AS status,
    list_transform(ps, lambda x, i: x.close / CASE WHEN i = 1 THEN entry ELSE coalesce(x.reference, ps[i - 1].close) END) AS fs
  FROM (SELECT p.*, last_date, list_filter(path, lambda x: x.close > 0) AS ps, coalesce(len(path), 0) AS n, path[1].date AS d1, path[{h}].date AS dh, path[1].open AS entry, path[1].close AS c1, path[{h}].close AS target,
      len(list_filter(path[2:], lambda x: x.acts IS NOT NULL AND (x.close IS NULL OR x.conflict))) > 0 AS bad,
      flatten(list_transform(list_filter(path[2:], lambda x: x.acts IS NOT NULL), lambda x: x.acts)) AS acts
    FROM (SELECT stock_id, date, idx, present, list({{'date': date, 'open': open, 'close': close, 'reference': reference, 'acts': action_types, 'conflict': conflict}}) OVER {w} AS path
      FROM panel LEFT JOIN resolved USING (stock_id, date)) p LEFT JOIN gone USING (stock_id) WHERE present))""",
    )


CTES["gone"] = (("cells",), "SELECT stock_id, max(date) AS last_date FROM cells WHERE stock_id::BIGINT % 3 = 0 GROUP BY 1")
for _h in (5, 10, 40):
    CTES[f"returns{_h}"] = _returns(_h)


def horizons(spark, d, *hs: int, more: dict | None = None):
    """Days with a price, their facts of all horizons, and ``more`` features of the panel, from one pass over it."""
    p = eventful(spark, d)
    return X.with_returns(p.withColumns(more) if more else p, hs).where("present")


def returns(spark, d, h: int):
    return horizons(spark, d, h).select("stock_id", "date", *[F.col(f"{c}_{h}d").alias(c) for c in X.FACTS])


_LABEL = "CASE WHEN round(adjusted, 10) >= 0.05 THEN 'UP' WHEN round(adjusted, 10) <= -0.05 THEN 'DOWN' WHEN adjusted IS NOT NULL THEN 'FLAT' END"


def _both(h: int) -> None:
    cols = ("raw", "adjusted", "highest", "lowest")

    @query(f"w23_forward_return_{h}", with_ctes((f"returns{h}",), f"SELECT stock_id, date, status, {', '.join(rq(c, c) for c in cols)}, {_LABEL} AS label FROM returns{h}"))
    def w23(spark, d):
        return returns(spark, d, h).select("stock_id", "date", "status", *[r(F.col(c), c) for c in cols], "label")


for _h in (5, 10, 40):
    _both(_h)


@query("m02_label_statuses", with_ctes(("returns5", "returns10", "returns40"), "SELECT h AS horizon, status, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT {h} AS h, status FROM returns{h}" for h in (5, 10, 40)) + ") GROUP BY 1, 2"))
def m02(spark, d):
    made = horizons(spark, d, 5, 10, 40)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"status_{h}d").alias("status")) for h in (5, 10, 40)]))
    return made.select(each.alias("s")).groupBy("s.horizon", "s.status").agg(F.count("*").alias("n"))


@query("a06_label_distribution", with_ctes(("returns10",), f"SELECT year(date)::INTEGER AS year, {_LABEL} AS label, count(*) AS n FROM returns10 WHERE status = 'ok' GROUP BY 1, 2"))
def a06(spark, d):
    return returns(spark, d, 10).where("status = 'ok'").groupBy(F.year("date").alias("year"), "label").agg(F.count("*").alias("n"))


@query("a04_status_counters", with_ctes(("returns10",), "SELECT stock_id, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("ok", "insufficient_future_data", "invalid_data", "unavailable_entry_price", "unavailable_target_price")) + " FROM returns10 GROUP BY 1"))
def a04(spark, d):
    names = ("ok", "insufficient_future_data", "invalid_data", "unavailable_entry_price", "unavailable_target_price")
    return returns(spark, d, 10).groupBy("stock_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in names])


@query("c16_reference_prices", with_ctes(("resolved",), f"SELECT stock_id, date, {rq('reference', 'reference')}, array_to_string(action_types, ',') AS action_types, conflict FROM resolved"))
def c16(spark, d):
    return X.resolved_actions(actions(spark, d)).select("stock_id", "date", r(F.col("reference"), "reference"), F.array_join("action_types", ",").alias("action_types"), "conflict")


@query("j09_actions_in_holding_period", with_ctes(("cells", "cal", "actions"), """SELECT s.stock_id, s.date, count(*) AS actions FROM (SELECT stock_id, c.date, e.date AS entry, t.date AS target FROM cells c JOIN cal USING (date) JOIN cal e ON e.idx = cal.idx + 1 JOIN cal t ON t.idx = cal.idx + 10) s
JOIN actions a ON a.stock_id = s.stock_id AND a.date > entry AND a.date <= target GROUP BY 1, 2"""))
def j09(spark, d):
    cal = calendar(spark, d)
    at = lambda k, name: F.broadcast(cal.select((F.col("idx") - k).alias("idx"), F.col("date").alias(name)))
    spans = cells(spark, d).select("stock_id", "date").join(F.broadcast(cal), "date").join(at(1, "entry"), "idx").join(at(10, "target"), "idx")
    a = actions(spark, d).select(F.col("stock_id").alias("s"), F.col("date").alias("on"))
    return spans.join(a, (F.col("stock_id") == F.col("s")) & (F.col("on") > F.col("entry")) & (F.col("on") <= F.col("target"))).groupBy("stock_id", "date").agg(F.count("*").alias("actions"))


@query("j08_next_market_date", with_ctes(("cal",), "SELECT order_date, orders, (SELECT min(date) FROM cal WHERE date > order_date) AS entry_date FROM (SELECT o_orderdate::DATE AS order_date, count(*) AS orders FROM orders GROUP BY 1)"))
def j08(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("order_date")).agg(F.count("*").alias("orders"))
    # market dates cut time into spans; a date in a span has its end as the next market date
    days = calendar(spark, d)
    cal = days.join(days.select((F.col("idx") - 1).alias("idx"), F.col("date").alias("until")), "idx", "left").select("date", "until")
    spans = F.broadcast(cal)  # one row per market date
    first = calendar(spark, d).agg(F.min("date").alias("first"))
    inside = orders.join(spans, (F.col("order_date") >= F.col("date")) & (F.col("order_date") < F.coalesce("until", F.lit("9999-12-31").cast("date"))), "left")
    return inside.crossJoin(F.broadcast(first)).select("order_date", "orders", F.when(F.col("date").isNull(), F.col("first")).otherwise(F.col("until")).alias("entry_date"))
