"""Runs of high scores on the market calendar, their entries, cooldowns and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def by_idx():
    return Window.partitionBy("stock_id").orderBy("idx")


def runs(scores: DataFrame, score: str, threshold: float) -> DataFrame:
    """Rows at or above the threshold with run_length so far, and episode_start, episode_end, episode_length.

    Rows of one run have consecutive market-day numbers; a missing day ends it.
    """
    high = scores.where(F.col(score) >= threshold).withColumn("_island", F.col("idx") - F.row_number().over(by_idx()))
    island = Window.partitionBy("stock_id", "_island")
    return high.withColumns(
        {
            "run_length": F.row_number().over(island.orderBy("idx")).cast("long"),
            "episode_start": F.min("idx").over(island),
            "episode_end": F.max("idx").over(island),
            "episode_length": F.count("*").over(island),
        }
    ).drop("_island")


def score_days_ago(score: str, days: int) -> Column:
    """The score just so many market days ago, null if that day is missing: days, not rows."""
    return F.first(score).over(by_idx().rangeBetween(-days, -days))


def score_days_ahead(score: str, days: int) -> Column:
    return F.first(score).over(by_idx().rangeBetween(days, days))


def cooled(events: DataFrame, days: int, after_end: bool) -> DataFrame:
    """Events that are not too soon after the last kept one of their security.

    ``after_end``: an event must start more than ``days`` after the kept one's episode_end;
    otherwise more than ``days`` after its own idx. With 0 days or less and not after_end all stay.
    The choice is sequential per security, a fold over its events, which are few beside its rows.
    """
    point = F.struct("idx", (F.col("episode_end") if after_end else F.col("idx")).alias("until"))
    ordered = F.array_sort(F.collect_list(point))
    empty = F.array().cast("array<bigint>")
    start = F.struct(F.lit(None).cast("long").alias("last"), empty.alias("kept"))

    def step(s, e):
        keep = s["last"].isNull() | (e["idx"] > s["last"] + days) | F.lit(days <= 0 and not after_end)
        return F.struct(F.when(keep, e["until"]).otherwise(s["last"]).alias("last"), F.when(keep, F.concat(s["kept"], F.array(e["idx"]))).otherwise(s["kept"]).alias("kept"))

    kept = events.groupBy("stock_id").agg(ordered.alias("_e")).select("stock_id", F.explode(F.aggregate("_e", start, step, lambda s: s["kept"])).alias("idx"))
    return events.join(kept, ["stock_id", "idx"], "left_semi")


def breakdowns(events: DataFrame, scores: DataFrame, score: str, threshold: float, days: int) -> DataFrame:
    """(stock_id, idx, seen, first_below): of each event the scored days ahead and the first offset below the threshold."""
    s = scores.select("stock_id", F.col("idx").alias("day"), F.col(score).alias("later"))
    # offsets become equality keys: an event probes its ``days`` days instead of a range
    probes = events.select("stock_id", "idx", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("offset")).withColumn("day", F.col("idx") + F.col("offset"))
    met = probes.join(s, ["stock_id", "day"], "left")
    return met.groupBy("stock_id", "idx").agg(F.count("later").alias("seen"), F.min(F.when(F.col("later") < threshold, F.col("offset"))).alias("first_below"))
