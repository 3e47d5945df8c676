"""Trailing features of the dense panel. All frames share one partitioning and order, so one sort serves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NETS = ("foreign_net", "trust_net", "dealer_net", "total_net")
def by_date():
    return Window.partitionBy("stock_id").orderBy("idx")


def trailing(n: int):
    return by_date().rowsBetween(-(n - 1), 0)


def flow_share(net: str, n: int) -> Column:
    """Net flow of the last n market days in percent of their volume; 0 without volume."""
    w = trailing(n)
    return F.when(F.sum("volume").over(w) > 0, 100 * F.sum(net).over(w) / F.sum("volume").over(w)).otherwise(0.0)


def buy_day_ratio(net: str, n: int) -> Column:
    return F.sum((F.col(net) > 0).cast("int")).over(trailing(n)) / F.lit(float(n))


def signed_streak(panel: DataFrame, net: str) -> DataFrame:
    """The panel with ``streak``: +n on the nth consecutive day of buying, -n of selling, 0 else."""
    sign = F.signum(net).cast("int")
    starts = F.when(sign == F.lag(sign).over(by_date()), 0).otherwise(1)
    island = panel.withColumn("_sign", sign).withColumn("_starts", starts)
    island = island.withColumn("_island", F.sum("_starts").over(by_date().rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("stock_id", "_island").orderBy("idx"))
    return island.withColumn("streak", (place * F.col("_sign")).cast("long")).drop("_sign", "_starts", "_island")


def longest_zero_run(column: str, n: int) -> Column:
    """The longest run of zeros within the last n days; runs are clipped at the frame's edge."""
    flags = F.collect_list(F.when(F.col(column) == 0, "0").when(F.col(column).isNotNull(), "1")).over(trailing(n))
    return F.array_max(F.transform(F.split(F.concat_ws("", flags), "1"), lambda zeros: F.length(zeros))).cast("long")


def trailing_median(column: str, n: int) -> Column:
    """The median of the last n days, as ``percentile`` interpolates it; a sorted list of the frame is cheaper than its map of counts."""
    middle = lambda s: 0.5 * F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + 0.5 * F.get(s, F.floor(F.size(s) / 2).cast("int"))
    return F.get(F.transform(F.array(F.sort_array(F.collect_list(column).over(trailing(n)))), middle), F.lit(0))


def agreement(n: int) -> Column:
    """Mean sign of the three actors' net flow over n days: -1 to 1."""
    return sum((F.signum(F.sum(net).over(trailing(n))) for net in NETS[1:3]), F.signum(F.sum(NETS[0]).over(trailing(n)))) / 3.0


def acceleration() -> Column:
    return flow_share("total_net", 5) - flow_share("total_net", 20)


def valid_signal() -> Column:
    return F.coalesce(F.col("open") > 0, F.lit(False)) & F.coalesce(F.col("close") > 0, F.lit(False)) & (F.col("volume") > 0) & (F.col("money") > 0)


def liquidity(panel: DataFrame, least_money: float, days: int = 20, least_normal: int = 18, most_zeros: int = 3) -> DataFrame:
    """normal_days, median_money, zero_run, liquid and entry_ready: whether a day passes the liquidity screen."""
    w = trailing(days)
    return (
        panel.withColumn("history", F.count("*").over(w))
        .withColumn("normal_days", F.sum(F.when(valid_signal(), 1).otherwise(0)).over(w))
        .withColumn("median_money", trailing_median("money", days))
        .withColumn("zero_run", longest_zero_run("volume", days))
        .withColumn("entry_ready", F.coalesce(F.lead("open").over(by_date()) > 0, F.lit(False)))
        .withColumn("liquid", (F.col("history") == days) & (F.col("normal_days") >= least_normal) & (F.col("median_money") >= least_money) & (F.col("zero_run") < most_zeros))
    )


def exclusion(liquid: DataFrame, least_money: float, days: int = 20, least_normal: int = 18, most_zeros: int = 3) -> Column:
    """The first reason that applies, in a fixed order."""
    return (
        F.when(F.col("history") < days, "short_history")
        .when(F.col("normal_days") < least_normal, "few_normal_days")
        .when(F.col("zero_run") >= most_zeros, "zero_volume_run")
        .when(F.col("median_money") < least_money, "low_money")
        .when(~F.col("entry_ready"), "no_entry_price")
        .otherwise("eligible")
    )


def scoring_ready(panel: DataFrame, market: Column, bounds: dict[str, tuple[float, float]], least_stocks: int, lot: float = 1000.0, days: int = 20) -> DataFrame:
    """Days that may be scored, with n_stocks: each market has its least median money and median lots (0: any).

    Beyond the normal days and zero runs of the liquidity screen; a market's day counts if at least
    ``least_stocks`` securities are left. A market without bounds is not scored.
    """
    x = liquidity(panel, 0.0, days).withColumn("market", market).withColumn("median_lots", trailing_median("volume", days) / lot)
    enough = F.lit(False)
    for name, (money, lots) in bounds.items():
        enough = enough | ((F.col("market") == name) & (F.col("median_money") >= money) & ((F.lit(lots) <= 0) | (F.col("median_lots") >= lots)))
    ready = x.where((F.col("normal_days") >= 18) & (F.col("zero_run") < 3) & enough)
    return ready.withColumn("n_stocks", F.count("*").over(Window.partitionBy("market", "date"))).where(F.col("n_stocks") >= least_stocks)
