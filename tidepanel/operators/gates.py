"""Acceptance gates over a ranking's yearly and daily statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.ranking import daily_spearman, daily_spread


def ranking_gates(scores: DataFrame, p: str, score: str, value: str) -> DataFrame:
    """(gate, passed): years, positive years, mean spread and mean rank correlation."""
    spread = daily_spread(scores, p, value, 20).groupBy("date", F.year("date").alias("year")).agg(F.first("spread").alias("s"))
    yearly = spread.groupBy("year").agg(F.avg("s").alias("m"), F.sum("s").alias("t"), F.count("*").alias("n"))
    y = yearly.agg(F.count("*").alias("years"), F.count_if(F.col("m") > 0).alias("good"), (F.sum("t") / F.sum("n")).alias("mean"))
    rho = daily_spearman(scores, score, value).agg(F.avg("spearman").alias("rho"))
    row = y.crossJoin(rho)  # one row each
    gates = {"years": F.col("years") >= 3, "positive_years": F.col("good") >= F.greatest(F.lit(2), F.ceil(0.6 * F.col("years"))), "spread": F.col("mean") > 0, "rank_correlation": F.col("rho") > 0}
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), c.alias("passed")) for k, c in gates.items()])).alias("g")).select("g.*")


def interval_gate(events: int, securities: int, years: int, positive_years: int, excess: float, low: float) -> dict[str, bool]:
    """The lifecycle gate on collected scalars: enough events, securities and years, and an interval above zero."""
    return {"events": events >= 100, "securities": securities >= 30, "years": years >= 3, "positive_years": positive_years >= 0.6 * years, "excess": excess > 0, "interval": low > 0}


def selected_candidates(folds: DataFrame, losses: list[str], baseline: str) -> DataFrame:
    """The candidate of each market: folds are (market, candidate_id, test_rows, spread, losses, baseline), one a year.

    A candidate is supported if three quarters of its years, one at least, have a positive spread and
    the median and weighted spreads are positive. Supported ones come first, then by positive years,
    median and weighted spread, gain over the baseline, and name. ``variant`` is the least weighted
    loss by name. A candidate's folds are its years.
    """
    weighted = lambda c: F.sum(F.col(c) * F.col("test_rows")) / F.sum("test_rows")
    a = folds.groupBy("market", "candidate_id").agg(
        F.count_if(F.col("spread") > 0).alias("positive_years"), F.count("*").alias("years"), F.median("spread").alias("median_spread"), weighted("spread").alias("weighted_spread"),
        *[weighted(c).alias(f"_l_{c}") for c in losses], weighted(baseline).alias("_base"),
    )
    supported = (F.col("positive_years") >= F.greatest(F.lit(1), F.ceil(F.col("years") * 0.75))) & (F.col("median_spread") > 0) & (F.col("weighted_spread") > 0)
    variant = F.array_min(F.array(*[F.struct(F.col(f"_l_{c}").alias("loss"), F.lit(c).alias("name")) for c in losses]))["name"]
    a = a.withColumn("supported", supported).withColumn("variant", variant)
    order = F.struct(F.when(F.col("supported"), 0).otherwise(1), -F.col("positive_years"), *[-F.round(c, 9) for c in ("median_spread", "weighted_spread")], -F.round(F.col("_base") - F.col(f"_l_{losses[0]}"), 9), "candidate_id")
    return a.groupBy("market").agg(F.min_by(F.struct("candidate_id", "supported", "positive_years", "years", "median_spread", "weighted_spread", "variant"), order).alias("c")).select("market", "c.*")


def return_gate(summary: DataFrame) -> DataFrame:
    """``passed`` for rows of (years, positive_years, spread, rank_correlation, low), low the interval's lower end."""
    need = F.greatest(F.lit(2), F.ceil(F.col("years") * 0.6))
    ok = (F.col("years") >= 3) & (F.col("positive_years") >= need) & (F.col("spread") > 0) & (F.col("rank_correlation") > 0) & (F.col("low") > 0)
    return summary.withColumn("required_positive_years", need).withColumn("passed", F.coalesce(ok, F.lit(False)))


def rule_candidates(events: DataFrame, intervals: DataFrame, first_year: int, events_least: int = 100, stocks_least: int = 30) -> DataFrame:
    """Entry rules by their events (rule, stock_id, date, year, excess): strong_candidate or not_selected.

    Counted from ``first_year`` to the year before the last; an excess is the mean of daily means.
    ``intervals`` (rule, low) hold the lower ends of the rules' intervals; a rule without one is not selected.
    """
    last = F.broadcast(events.agg(F.max("year").alias("_last")))
    e = events.crossJoin(last).where((F.col("year") >= first_year) & (F.col("year") < F.col("_last")))
    counts = e.groupBy("rule").agg(F.count("*").alias("events"), F.count_distinct("stock_id").alias("stocks"))
    days = e.groupBy("rule", "year", "date").agg(F.avg("excess").alias("m"))
    years = days.groupBy("rule", "year").agg(F.avg("m").alias("y"), F.sum("m").alias("s"), F.count("m").alias("n")).groupBy("rule").agg(F.count("*").alias("years"), F.count_if(F.col("y") > 0).alias("positive_years"), F.try_divide(F.sum("s"), F.sum("n")).alias("excess"))
    t = counts.join(years, "rule").join(intervals, "rule", "left")
    strong = (F.col("events") >= events_least) & (F.col("stocks") >= stocks_least) & (F.col("years") >= 3) & (F.col("positive_years") >= F.greatest(F.lit(2), F.ceil(F.col("years") * 0.6))) & (F.col("excess") > 0) & (F.col("low") > 0)
    return t.withColumn("status", F.when(F.coalesce(strong, F.lit(False)), "strong_candidate").otherwise("not_selected"))


def confirmation(folds: DataFrame, markets: DataFrame) -> DataFrame:
    """A row for each of ``markets`` (market) with what its confirmation years decide.

    ``folds`` are (market, test_rows, spread, model_loss, history_loss, model_ece, history_ece), one a year. The
    ranking holds if three quarters of the years, one at least, have a positive spread and the mean by rows and
    the median are positive too. Probabilities hold if their loss is below that of the history's share and
    their calibration error is at most half a percent above it. A market without a year is INCOMPLETE.
    """
    weighted = lambda c: F.sum(F.col(c) * F.col("test_rows")) / F.sum("test_rows")
    a = folds.groupBy("market").agg(
        F.count("*").alias("years"), F.sum("test_rows").alias("test_rows"), F.count_if(F.col("spread") > 0).alias("positive_years"), weighted("spread").alias("weighted_spread"), F.median("spread").alias("median_spread"),
        *[weighted(c).alias(c) for c in ("model_loss", "history_loss", "model_ece", "history_ece")],
    )
    ranking = (F.col("positive_years") >= F.greatest(F.lit(1), F.ceil(F.col("years") * 0.75))) & (F.col("weighted_spread") > 0) & (F.col("median_spread") > 0)
    probability = (F.col("model_loss") < F.col("history_loss")) & (F.col("model_ece") <= F.col("history_ece") + 0.005)
    j = markets.select("market").distinct().join(a, "market", "left").withColumns({"ranking": F.coalesce(ranking, F.lit(False)), "probability": F.coalesce(probability, F.lit(False))})
    decision = F.when(F.col("years").isNull(), "INCOMPLETE").when(F.col("ranking") & F.col("probability"), "PROBABILITY_AND_RANKING").when(F.col("ranking"), "RANKING_ONLY").otherwise("REJECT")
    return j.withColumn("decision", decision)
