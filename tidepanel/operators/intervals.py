"""Closed date intervals by key: their union, and what of requested intervals it leaves open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIRST_DAY, LAST_DAY = "0001-01-01", "9999-12-31"


def covered(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): the fewest intervals that hold the same days; intervals that touch become one.

    Gaps and islands: of intervals with one start the longest is kept before anything is shuffled,
    and an interval opens an island if it starts after all earlier ones' ends. Null or inverted
    intervals hold no day.
    """
    longest = intervals.where("start <= end").groupBy(*keys, "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy(*keys).orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = longest.withColumn("_open", (reach.isNull() | (F.col("start") > F.date_add(reach, 1))).cast("int"))
    return opened.withColumn("_island", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def still_open(requests: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """The requests' rows with start and end narrowed to what ``intervals`` don't hold, a row for each gap; whole covered requests go.

    The gaps between a key's islands, and those before and after them, meet its requests by an
    equi-join on the key. A key without intervals has one gap. Null or inverted requests ask nothing.
    """
    # a day before all others gives every requested key an island, so that each has its gaps
    before = requests.select(*keys, F.lit(FIRST_DAY).cast("date").alias("start"), F.lit(FIRST_DAY).cast("date").alias("end")).distinct()
    islands = covered(intervals.select(*keys, "start", "end").unionByName(before), keys)
    following = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    gaps = islands.select(*keys, F.date_add("end", 1).alias("_from"), F.coalesce(F.date_sub(following, 1), F.lit(LAST_DAY).cast("date")).alias("_to"))
    met = requests.where("start <= end").join(gaps, keys).where("_from <= end and _to >= start")
    return met.withColumns({"start": F.greatest("start", "_from"), "end": F.least("end", "_to")}).select(*requests.columns)
