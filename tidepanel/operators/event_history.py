"""The bars around events, by a range join on day bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(date: Column, width: int) -> Column:
    return F.floor(F.unix_date(date) / width)


def event_history(events: DataFrame, bars: DataFrame, before: int = 60, after: int = 10) -> DataFrame:
    """Each event's columns (stock_id, event_date and others) with the bars from ``before`` days ahead of it to ``after`` days past it.

    Days are cut into bins as wide as an event's span, so an event has two bins at most and a bar
    one: security and bin are an equi-join, and the dates are compared within it. Bars need positive
    prices; a security without bars leaves its events out.
    """
    width = before + after + 1
    low, high = F.date_sub("event_date", before), F.date_add("event_date", after)
    asked = events.withColumn("_bin", F.explode(F.sequence(_bin(low, width), _bin(high, width))))
    whole = bars.where(" and ".join(f"{c} > 0" for c in ("open", "high", "low", "close"))).withColumn("_bin", _bin(F.col("date"), width))
    return asked.join(whole, ["stock_id", "_bin"]).where(F.col("date").between(low, high)).drop("_bin").withColumn("days", F.datediff("date", "event_date"))
