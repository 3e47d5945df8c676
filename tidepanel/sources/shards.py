"""Sample rows as a table by market and year: pruned scans, the latest whole cross-section, event outcomes over changing schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.sources.tables import write_partitioned

PARTITIONS = ["market", "year"]


def usable() -> Column:
    return (F.col("feature_status") == "ok") & F.col("liquid")


def write_shards(rows: DataFrame, path: str) -> None:
    """Rows (market, year, date, stock_id, feature_status, liquid, ...) by market and year, and beside them how many usable securities each date has."""
    write_partitioned(rows, f"{path}/rows", PARTITIONS)
    days = rows.groupBy(*PARTITIONS, "date").agg(F.count_distinct(F.when(usable(), F.col("stock_id"))).alias("stocks"))
    write_partitioned(days, f"{path}/days", PARTITIONS)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def research_frame(spark: SparkSession, path: str, market: str, years: tuple[int, int], outcomes: DataFrame) -> DataFrame:
    """The market's usable rows of these years with their outcomes (stock_id, date, ...); partitions are pruned, the other conditions pushed down."""
    rows = read_shards(spark, path).where((F.col("market") == market) & F.col("year").between(*years)).where("feature_status = 'ok'").where("liquid")
    return rows.join(outcomes, ["stock_id", "date"])


def latest_days(days: DataFrame, least: int, requested: str | None = None) -> DataFrame:
    """(market, year, date): each market's last date, or the requested one, that has ``least`` usable securities. Having none is an error of the read."""
    asked = days if requested is None else days.where(F.col("date") == F.lit(requested).cast("date"))
    best = asked.groupBy("market").agg(F.max(F.when(F.col("stocks") >= least, F.col("date"))).alias("date"), F.max("stocks").alias("most"))
    said = F.concat(F.lit(f"no date of {requested or 'the table'} has {least} usable securities in market "), "market", F.lit(", the most are "), F.col("most").cast("string"))
    date = F.when(F.col("date").isNull(), F.raise_error(said)).otherwise(F.col("date"))
    # without a comparison on this side the optimizer expects no use of pruning by it
    return best.select("market", date.cast("date").alias("date")).withColumn("year", F.year("date")).where("year > 0")


def stored_cross_section(spark: SparkSession, path: str, least: int, requested: str | None = None) -> DataFrame:
    """The usable rows of each market's latest whole date.

    The dates come from the table of counts, a row a date, so they are few; they prune the partitions of the rows while the query runs.
    """
    days = latest_days(spark.read.parquet(f"{path}/days"), least, requested)
    return no_repeats(read_shards(spark, path).join(F.broadcast(days), [*PARTITIONS, "date"]).where(usable()), ["stock_id", "date"])


def latest_cross_section(rows: DataFrame, least: int, keep: int = 90, requested: str | None = None) -> DataFrame:
    """The same of any rows (market, stock_id, date, feature_status, liquid): only each security's last ``keep`` ok rows count towards a date."""
    recent = F.row_number().over(Window.partitionBy("market", "stock_id").orderBy(F.desc("date")))
    ok = rows.where("feature_status = 'ok'")
    live = ok.withColumn("_n", recent).where(F.col("_n") <= keep).drop("_n").where("liquid")
    days = live.groupBy("market", "date").agg(F.count_distinct("stock_id").alias("stocks"))
    return no_repeats(live.join(F.broadcast(latest_days(days, least, requested).drop("year")), ["market", "date"]), ["stock_id", "date"])


def no_repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; a key that occurs twice is an error of the read."""
    n = F.count("*").over(Window.partitionBy(*keys))
    said = F.concat(F.lit("rows repeat "), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]))
    return rows.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(said).cast("boolean")).otherwise(True)).drop("_n")


def event_outcomes(spark: SparkSession, path: str, events: DataFrame, needed: list[str], optional: dict[str, str], more: DataFrame | None = None) -> DataFrame:
    """(stock_id, date, needed, optional) of the events (stock_id, date) that the table's files hold.

    Files may have been written before an optional column was known: schemas are merged, and a column that no
    file has is null. ``more`` (stock_id, date, optional columns) fills what is null. The events' years prune
    partitions; their keys filter the rest. A key that occurs twice is an error of the read.
    """
    rows = spark.read.option("mergeSchema", True).parquet(path)
    have = set(rows.columns)
    lacking = [n for n in needed if n not in have]
    if lacking:
        raise ValueError(f"no file of {path} has {', '.join(lacking)}")
    asked = events.select("stock_id", "date").distinct().withColumn("year", F.year("date"))
    keys = ["year", "stock_id", "date"]
    met = rows.join(asked, keys, "left_semi").select("stock_id", "date", *needed, *[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in optional.items()])
    once = no_repeats(met, ["stock_id", "date"])
    if more is None:
        return once
    others = more.select("stock_id", "date", *[F.col(n).cast(t).alias(f"_{n}") for n, t in optional.items() if n in more.columns])
    filled = once.join(others, ["stock_id", "date"], "left")
    return filled.select("stock_id", "date", *needed, *[F.coalesce(n, f"_{n}").alias(n) if n in more.columns else F.col(n) for n in optional])
