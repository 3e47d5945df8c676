"""Which market date an update aims at, and which securities still need it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.quantiles import count_up_to


#: Market dates that a calendar may have: some 4,000 years of them.
MOST_DAYS = 1 << 20


def last_up_to(days: Column, date: Column) -> Column:
    """The last of the sorted days that is no later than the date, by bisection; null before the first."""
    return F.get(days, count_up_to(days, date, MOST_DAYS) - 1)


def target_dates(asks: DataFrame, calendar: DataFrame) -> DataFrame:
    """The asks (now, as_of, explicit, cutoff) with target and source.

    The as-of day itself counts if it is over or its publishing cutoff (HH:mm) has passed. An
    explicit date is taken if it is a market date up to the as-of day. Otherwise target is null and
    source says why: as_of_after_today, explicit_after_as_of, explicit_not_a_market_date, no_market_date.
    The calendar is one row a market date and travels as one sorted array.
    """
    days = calendar.agg(F.array_sort(F.collect_set("date")).alias("days"))
    today, clock = F.to_date("now"), F.date_format("now", "HH:mm")
    a = asks.crossJoin(F.broadcast(days)).withColumn("day", F.coalesce("as_of", today))
    included = (F.col("day") < today) | ((F.col("day") == today) & F.coalesce(clock >= F.col("cutoff"), F.lit(False)))
    a = a.withColumn("included", included)
    until = F.when(F.col("included"), F.col("day")).otherwise(F.date_sub("day", 1))
    latest = last_up_to(F.col("days"), until)
    listed = F.coalesce(last_up_to(F.col("days"), F.col("explicit")) == F.col("explicit"), F.lit(False))
    source = (
        F.when(F.col("day") > today, "as_of_after_today")
        .when(F.col("explicit") > F.col("day"), "explicit_after_as_of")
        .when(F.col("explicit").isNotNull() & ~listed, "explicit_not_a_market_date")
        .when(F.col("explicit").isNotNull(), "explicit")
        .when(latest.isNull(), "no_market_date")
        .when(F.col("included"), "at_or_before_as_of")
        .otherwise("before_as_of")
    )
    a = a.withColumn("source", source)
    target = F.when(F.col("source") == "explicit", F.col("explicit")).when(F.col("source").isin("at_or_before_as_of", "before_as_of"), latest)
    return a.withColumn("target", target).drop("days", "day", "included")


def pending_updates(universe: DataFrame, rows: DataFrame, attempted: DataFrame, target: str, first: str, warm_up: int) -> DataFrame:
    """(stock_id, latest, start): securities that lack the target date and were not tried for it, with the day to read from.

    A security is read from ``warm_up`` days before its latest row, or from ``first`` where it has none.
    """
    goal, begin = F.lit(target).cast("date"), F.lit(first).cast("date")
    latest = rows.groupBy("stock_id").agg(F.max("date").alias("latest"))
    open_ = universe.select("stock_id").distinct().join(latest, "stock_id", "left").where(F.col("latest").isNull() | (F.col("latest") < goal))
    tried = attempted.where(F.col("target") == goal).select("stock_id").distinct()
    return open_.join(tried, "stock_id", "left_anti").withColumn("start", F.greatest(begin, F.coalesce(F.date_sub("latest", warm_up), begin)))


def coverage_gate(universe: DataFrame, rows: DataFrame, target: str, least: float) -> DataFrame:
    """One row: securities, those with the target date, their share, and whether it reaches ``least``."""
    have = rows.where(F.col("date") == F.lit(target).cast("date")).select("stock_id", F.lit(1).alias("have")).distinct()
    c = universe.select("stock_id").distinct().join(have, "stock_id", "left").agg(F.count("*").alias("stocks"), F.count("have").alias("covered"))
    share = F.coalesce(F.try_divide("covered", "stocks"), F.lit(0.0))
    return c.select("stocks", "covered", share.alias("share"), (share >= least).alias("passed"))
