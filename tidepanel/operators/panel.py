"""The dense security-by-date panel and its calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NETS = ("foreign_net", "trust_net", "dealer_net")


def market_calendar(dates: DataFrame) -> DataFrame:
    """(date, idx): distinct dates numbered from 0.

    The only window without a partition in the library: its input is one row per market date,
    thousands at most after the map-side distinct, however many securities there are.
    """
    return dates.select("date").where("date is not null").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("idx"))


def dense_panel(cells: DataFrame, calendar: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per security and market date from the security's first date on; absent days are zero and flagged.

    A cell makes its own day and the absent ones up to the security's next cell, so the rows stay
    with their security and nothing is joined but the calendar. Cells off the calendar take no part.
    ``more`` are further columns of the cells, null on absent days.
    """
    days = calendar.select("date", "idx")  # a few thousand rows
    end = days.agg(F.max("idx").alias("_end"))
    placed = cells.join(F.broadcast(days.withColumnRenamed("idx", "_at")), "date").drop("date").crossJoin(F.broadcast(end))
    until = F.coalesce(F.lead("_at").over(Window.partitionBy("stock_id").orderBy("_at")) - 1, F.col("_end"))
    rows = placed.withColumn("_until", until).withColumn("idx", F.explode(F.sequence("_at", F.greatest("_at", "_until"))))  # a repeated cell makes its own day only
    here = (F.col("idx") == F.col("_at")) & F.col("stock_id").isNotNull()
    own = lambda c: F.when(here, F.col(c))
    nets = [F.coalesce(own(n), F.lit(0.0)).alias(n) for n in NETS]
    total = F.coalesce(F.when(here, sum((F.col(n) for n in NETS[1:]), F.col(NETS[0]))), F.lit(0.0))
    return rows.join(F.broadcast(days), "idx").select(
        "stock_id", "date", "idx", here.alias("present"), *[own(c).alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce(own("volume"), F.lit(0.0)).alias("volume"), F.coalesce(own("money"), F.lit(0.0)).alias("money"), *nets, total.alias("total_net"), *[own(c).alias(c) for c in more],
    )
