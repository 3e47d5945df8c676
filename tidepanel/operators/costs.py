"""Flow-weighted cost bands and price position over a security's own rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def own_rows():
    return Window.partitionBy("stock_id").orderBy("date")


def last_rows(n: int):
    return own_rows().rowsBetween(-(n - 1), 0)


def weighted_cost(net: str, price: Column, n: int) -> Column:
    """Mean price of the last n own rows weighted by net buying; null with fewer rows or without buying."""
    w, bought = last_rows(n), F.greatest(F.coalesce(net, F.lit(0.0)), F.lit(0.0))
    total = F.sum(bought).over(w)
    return F.when((F.count("*").over(w) == n) & (total > 0), F.sum(bought * price).over(w) / total)


def cost_band(net: str, n: int) -> dict[str, Column]:
    """low, mid and high of the band, days with buying, and the close's deviation from mid in percent."""
    mid = weighted_cost(net, (F.col("high") + F.col("low") + F.col("close")) / 3, n)
    return {
        "cost_low": weighted_cost(net, F.col("low"), n),
        "cost_mid": mid,
        "cost_high": weighted_cost(net, F.col("high"), n),
        "buy_days": F.sum((F.col(net) > 0).cast("long")).over(last_rows(n)),
        "deviation": F.when(mid > 0, (F.col("close") / mid - 1) * 100),
    }


def range_position(n: int) -> Column:
    """Where the close stands between the lowest low and the highest high; null if these agree or rows are few."""
    low, high = F.min("low").over(last_rows(n)), F.max("high").over(last_rows(n))
    return F.when((F.count("*").over(last_rows(n)) == n) & (high > low), (F.col("close") - low) / (high - low))


def row_change(n: int) -> Column:
    return F.col("close") / F.lag("close", n).over(own_rows()) - 1


def deviation_bucket(x: Column) -> Column:
    return F.when(x < -10, "under_-10").when(x < 0, "-10_0").when(x < 10, "0_10").when(x < 25, "10_25").when(x >= 25, "over_25")


def quantile_groups(value: Column, edges: Column) -> Column:
    """Right-closed bins between distinct edges, the lowest value included, numbered from 1."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return (F.size(F.filter(inner, lambda e: e < value)) + 1).cast("int")


# Fixed values of the overheat grid.
LEAST_DEVIATIONS = (0.05, 0.10, 0.15)
LEAST_RETURNS = (0.05, 0.10, 0.15)
LEAST_PLACES = (0.80, 0.90)


def overheat_grid(events: DataFrame, periods: Column, value: str, least: int = 20) -> DataFrame:
    """(period, least_deviation, least_return, least_place, n, hot, hot_mean, normal_mean, difference).

    Events with deviation, back (the return before) and place (in the range) are hot if far above
    cost and either risen fast or high in the range. ``periods`` are the periods an event counts in,
    nulls left out. One aggregation: events are first summed by how far they reach, at most 4 * 4 * 3
    cells a period, and the 18 rules are then put together from the cells.
    """
    reach = lambda c, bounds: sum((F.when(F.col(c) >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    known = events.where(" and ".join(f"{c} is not null and not isnan({c})" for c in ("deviation", "back", "place")))
    e = known.select(F.explode(F.array_compact(periods)).alias("period"), F.col(value).alias("_v"), reach("deviation", LEAST_DEVIATIONS).alias("_a"), reach("back", LEAST_RETURNS).alias("_b"), reach("place", LEAST_PLACES).alias("_c"))
    cells = e.groupBy("period", "_a", "_b", "_c").agg(F.count("*").alias("_n"), F.count("_v").alias("_k"), F.sum("_v").alias("_s"))
    rules = F.explode(F.array(*[F.struct(F.lit(a).alias("least_deviation"), F.lit(b).alias("least_return"), F.lit(c).alias("least_place"), ((F.col("_a") > i) & ((F.col("_b") > j) | (F.col("_c") > k))).alias("_hot")) for i, a in enumerate(LEAST_DEVIATIONS) for j, b in enumerate(LEAST_RETURNS) for k, c in enumerate(LEAST_PLACES)]))
    x = cells.select("period", "_n", "_k", "_s", rules.alias("_r")).select("period", "_n", "_k", "_s", "_r.*")
    part = lambda c, hot: F.sum(F.when(F.col("_hot") == hot, F.col(c)))
    g = x.groupBy("period", "least_deviation", "least_return", "least_place").agg(F.sum("_n").alias("n"), F.coalesce(part("_n", True), F.lit(0)).alias("hot"), F.try_divide(part("_s", True), part("_k", True)).alias("hot_mean"), F.try_divide(part("_s", False), part("_k", False)).alias("normal_mean"))
    return g.where((F.col("hot") >= least) & (F.col("n") - F.col("hot") >= least)).withColumn("difference", F.col("hot_mean") - F.col("normal_mean"))
