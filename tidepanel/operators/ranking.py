"""Same-day percentiles, groups, bands and the statistics made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def same_day():
    return Window.partitionBy("date")


def average_rank(value: str, by: list[str]) -> Column:
    """The mean rank of equal values, as statistics packages rank by default."""
    order = Window.partitionBy(*by).orderBy(value)
    equal = F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow))  # ranks and counts share one sort
    return F.rank().over(order) + (equal - 1) / F.lit(2.0)


def day_size(*order: str) -> Column:
    """The day's count, over the sort that the ranks have."""
    return F.count("*").over(same_day().orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def percentile_share(value: str) -> Column:
    """Average rank over the day's count times 100: (0, 100]."""
    return average_rank(value, ["date"]) / day_size(value) * 100


def percentile_span(value: str) -> Column:
    """100 * (average rank - 1) / (n - 1); 50 where the day has one."""
    n = day_size(value)
    return F.when(n == 1, 50.0).otherwise(100 * (average_rank(value, ["date"]) - 1) / F.nullif(n - 1, F.lit(0)))


def percentile_first(value: str) -> Column:
    """As the span, but equal values are ranked by stock_id; 100 where the day has one."""
    n, place = day_size(value, "stock_id"), F.row_number().over(same_day().orderBy(value, "stock_id"))
    return F.when(n <= 1, 100.0).otherwise(100.0 * (place - 1) / F.nullif(n - 1, F.lit(0)))


def ceiled_group(p: Column, groups: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(groups), F.ceil(p / F.lit(100.0 / groups)))).cast("int")


def floored_group(p: Column, groups: int) -> Column:
    return F.least(F.lit(groups), F.floor(p / F.lit(100.0 / groups)) + 1).cast("int")


def daily_rank(value: str) -> Column:
    """1 is the highest; equal values by stock_id."""
    return F.row_number().over(same_day().orderBy(F.desc(value), "stock_id"))


def whole_days(scores: DataFrame, least: int) -> DataFrame:
    """Rows of dates that have ``least`` rows at least."""
    return scores.withColumn("n_stocks", F.count("*").over(same_day())).where(F.col("n_stocks") >= least)


def excess(value: str) -> Column:
    return F.col(value) - F.avg(value).over(same_day())


def daily_spread(scores: DataFrame, p: str, value: str, band: float) -> DataFrame:
    """(date, top, bottom, spread): mean of the top band less that of the bottom one, on days with both."""
    means = scores.groupBy("date").agg(F.avg(F.when(F.col(p) > 100 - band, F.col(value))).alias("top"), F.avg(F.when(F.col(p) <= band, F.col(value))).alias("bottom"))
    return means.where("top is not null and bottom is not null").withColumn("spread", F.col("top") - F.col("bottom"))


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation; null with fewer than three pairs or a constant side."""
    sure = (F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) >= 3) & (F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12)
    return F.when(sure, (F.avg(F.col(x) * F.col(y)) - F.avg(x) * F.avg(y)) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def daily_spearman(scores: DataFrame, x: str, y: str) -> DataFrame:
    """(date, spearman): correlation of the day's average ranks."""
    ranked = scores.select("date", average_rank(x, ["date"]).alias("rx"), average_rank(y, ["date"]).alias("ry"))
    return ranked.groupBy("date").agg(guarded_corr("rx", "ry").alias("spearman"))


def return_metrics(scores: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Equal-day and pooled statistics of a return by group."""
    daily = scores.where(F.col(value).isNotNull()).groupBy(*by, "date").agg(F.avg(value).alias("day_mean"), F.count("*").alias("n"), F.sum(value).alias("total"), *[F.count_if(c).alias(k) for k, c in (("up", F.col(value) > 0), ("high", F.col(value) >= 0.05), ("low", F.col(value) <= -0.05))])
    n = F.sum("n")
    return daily.groupBy(*by).agg(n.alias("n"), F.count("*").alias("days"), F.avg("day_mean").alias("daily_mean"), (F.sum("total") / n).alias("mean"), (F.sum("up") / n).alias("positive"), (F.sum("high") / n).alias("up5"), (F.sum("low") / n).alias("down5"))


def tier_ranks(rows: DataFrame, amount: str, score: str, least: dict[str, float]) -> DataFrame:
    """The rows with each liquidity tier's rank, count and percentile among the day's rows of at least its amount.

    A row below a tier has none there; the name of the highest tier that it reaches is in ``tier``.
    Each tier is a window by day and membership, so the rows are not joined with themselves.
    """
    out = rows
    for name, money in least.items():
        member = F.coalesce(F.col(amount) >= money, F.lit(False))
        out = out.withColumn("_in", member)
        among = Window.partitionBy("date", "_in")
        n = F.count("*").over(among)
        ranks = {f"rank_{name}": F.row_number().over(among.orderBy(F.desc(score), "stock_id")), f"count_{name}": n, f"percentile_{name}": F.when(n == 1, 50.0).otherwise(100 * (average_rank(score, ["date", "_in"]) - 1) / F.nullif(n - 1, F.lit(0)))}
        out = out.withColumns({k: F.when(F.col("_in"), v) for k, v in ranks.items()}).drop("_in")
    tier = F.coalesce(*[F.when(F.col(amount) >= money, name) for name, money in sorted(least.items(), key=lambda x: -x[1])], F.lit("base"))
    return out.withColumn("tier", tier)


def frame_issues(frame: DataFrame, score: str, least: int) -> DataFrame:
    """(issue, violations) of a frame of scores: nulls, scores that aren't finite or outside 0 to 100, repeated keys, thin days."""
    s = F.col(score)
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    one = frame.agg(F.count_if(F.col("stock_id").isNull() | F.col("date").isNull()).alias("no_key"), F.count_if(~finite).alias("not_finite"), F.count_if(finite & ~s.between(0, 100)).alias("outside"))
    keys = frame.groupBy("date", "stock_id").agg(F.count("*").alias("n"))  # repeats and days from one aggregation by key
    days = keys.groupBy("date").agg(F.sum(F.col("n") - 1).alias("repeated"), F.count("*").alias("stocks")).agg(F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated"), F.count_if(F.col("stocks") < least).alias("thin_days"))
    names = ["no_key", "not_finite", "outside", "repeated", "thin_days"]
    return one.crossJoin(F.broadcast(days)).unpivot([], names, "issue", "violations")
