"""Corporate-action-adjusted forward returns over the market calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.operators.features import by_date

#: Which action's reference price wins on a day with several, and how far others may differ.
PRIORITY = {"par_value_change": 4, "split": 3, "capital_reduction": 2, "dividend": 1}
TOLERANCE = 0.01
THRESHOLD = 0.05


def resolved_actions(actions: DataFrame) -> DataFrame:
    """(stock_id, date, reference, action_types, conflict): one row per security and day with actions.

    The positive reference price of the highest-priority type wins. A day conflicts if no price is
    positive or one is more than TOLERANCE away from the winner.
    """
    rank = F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    positive = F.when(F.col("reference_price") > 0, F.col("reference_price"))
    rated = actions.withColumn("_rank", F.coalesce(rank[F.col("action_type")], F.lit(0))).withColumn("_price", positive)
    by = rated.groupBy("stock_id", "date").agg(
        F.max_by("_price", F.when(F.col("_price").isNotNull(), F.struct("_rank", "_price"))).alias("reference"),
        F.min("_price").alias("_low"),
        F.max("_price").alias("_high"),
        F.array_sort(F.collect_set("action_type")).alias("action_types"),
    )
    far = F.greatest(F.col("_high") - F.col("reference"), F.col("reference") - F.col("_low")) > TOLERANCE * F.col("reference")
    return by.select("stock_id", "date", "reference", "action_types", F.coalesce(far, F.lit(True)).alias("conflict"))


def resolved_list(actions: Column) -> dict[str, Column]:
    """reference, action_types and conflict, as ``resolved_actions`` has them, of one security and day's array of (action_type, reference_price); null without one."""
    rank = F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    rated = F.transform(actions, lambda a: F.struct(F.coalesce(rank[a["action_type"]], F.lit(0)).alias("rank"), F.when(a["reference_price"] > 0, a["reference_price"]).alias("price")))
    sound = F.filter(rated, lambda x: x["price"].isNotNull())
    prices = F.transform(sound, lambda x: x["price"])
    reference = F.array_max(sound)["price"]
    far = F.greatest(F.array_max(prices) - reference, reference - F.array_min(prices)) > TOLERANCE * reference
    types = F.array_sort(F.array_distinct(F.array_compact(F.transform(actions, lambda a: a["action_type"]))))
    return {"reference": reference, "action_types": types, "conflict": F.when(actions.isNotNull(), F.coalesce(far, F.lit(True)))}


def with_events(panel: DataFrame, actions: DataFrame, last_dates: DataFrame | None = None) -> DataFrame:
    """The panel with reference, action_types and conflict of the day's actions, and last_date, from which on a security is not traded any more (of ``last_dates``)."""
    days = panel.join(resolved_actions(actions), ["stock_id", "date"], "left")
    return days.join(last_dates, "stock_id", "left") if last_dates is not None else days.withColumn("last_date", F.lit(None).cast("date"))


def label(value: Column) -> Column:
    """UP, DOWN or FLAT by the return rounded to ten digits."""
    x = F.round(value, 10)
    return F.when(x >= THRESHOLD, "UP").when(x <= -THRESHOLD, "DOWN").when(x.isNotNull(), "FLAT")


FACTS = ("status", "raw", "adjusted", "highest", "lowest", "label", "action_types")


def with_returns(events: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """The panel ``with_events`` and FACTS with _<horizon>d behind each.

    Entry is the next market day's open, the target is ``horizon`` market days after the signal.
    The path multiplies each priced day's close over the previous priced close, or over the
    resolved reference price on days with actions; an entry day's own action doesn't count. So from
    the entry's close on a day's factor is the same for every signal, and a path is a difference of
    running sums of their logarithms; faults on the way are a difference of running counts. All
    horizons are windows of numbers over one sort, and only types, highs and lows look into a frame.
    """
    order = by_date()
    ahead = lambda c, n: F.lead(c, n).over(order)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    own = events.columns
    closed = F.when(F.col("close") > 0, F.col("close"))
    days = events.withColumn("_close", closed)
    days = days.withColumn("_before", F.coalesce("reference", F.last("_close", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))))
    factor = F.when(F.col("_close").isNotNull() & F.col("_before").isNotNull(), F.ln(F.col("_close") / F.col("_before"))).otherwise(0.0)
    wrong = F.when(F.col("action_types").isNotNull() & (F.col("_close").isNull() | F.col("conflict")), 1)
    days = days.withColumns({"_path": F.sum(factor).over(so_far), "_wrong": F.count(wrong).over(so_far)})
    made: dict[str, Column] = {"_open_1": ahead("open", 1), "_close_1": ahead("_close", 1), "_date_1": ahead("date", 1), "_path_1": ahead("_path", 1), "_wrong_1": ahead("_wrong", 1)}
    for h in horizons:
        frame = order.rowsBetween(1, h)
        made |= {f"_idx_{h}d": ahead("idx", h), f"_date_{h}d": ahead("date", h), f"_close_{h}d": ahead("_close", h), f"_path_{h}d": ahead("_path", h), f"_wrong_{h}d": ahead("_wrong", h), f"_top_{h}d": F.max("_path").over(frame), f"_low_{h}d": F.min("_path").over(frame)}
        made[f"_types_{h}d"] = F.collect_list("action_types").over(order.rowsBetween(2, h)) if h > 1 else F.array().cast("array<array<string>>")
    out = days.withColumns(made)
    for h in horizons:
        status = (
            F.when(F.col(f"_idx_{h}d").isNull(), "insufficient_future_data")
            .when(F.col("_date_1") >= F.col("last_date"), "delisted_before_entry")
            .when(F.col(f"_date_{h}d") >= F.col("last_date"), "delisted_before_target")
            .when(~F.coalesce((F.col("_open_1") > 0) & F.col("_close_1").isNotNull(), F.lit(False)), "unavailable_entry_price")
            .when(F.col(f"_close_{h}d").isNull(), "unavailable_target_price")
            .when(F.col(f"_wrong_{h}d") > F.col("_wrong_1"), "invalid_data")
            .otherwise("ok")
        )
        ok = F.col(f"status_{h}d") == "ok"
        at = lambda c, ok=ok: F.when(ok, F.col("_close_1") / F.col("_open_1") * F.exp(F.col(c) - F.col("_path_1")) - 1)
        out = out.withColumn(f"status_{h}d", status).withColumns({
            f"raw_{h}d": F.when(ok, F.col(f"_close_{h}d") / F.col("_open_1") - 1),
            f"adjusted_{h}d": at(f"_path_{h}d"), f"highest_{h}d": at(f"_top_{h}d"), f"lowest_{h}d": at(f"_low_{h}d"),
            f"action_types_{h}d": F.to_json(F.array_distinct(F.flatten(f"_types_{h}d"))),
        }).withColumn(f"label_{h}d", label(F.col(f"adjusted_{h}d")))
    return out.select(*own, *[f"{c}_{h}d" for h in horizons for c in FACTS])


def returns_by_horizon(panel: DataFrame, actions: DataFrame, horizons: tuple[int, ...], last_dates: DataFrame | None = None) -> DataFrame:
    """(stock_id, date, and FACTS with _<horizon>d behind each) for days with a price; see ``with_events`` and ``with_returns``."""
    done = with_returns(with_events(panel, actions, last_dates), horizons).where("present")
    return done.select("stock_id", "date", *[f"{c}_{h}d" for h in horizons for c in FACTS])


def forward_returns(panel: DataFrame, actions: DataFrame, horizon: int, last_dates: DataFrame | None = None) -> DataFrame:
    """(stock_id, date, FACTS) of one horizon; see ``returns_by_horizon``."""
    made = returns_by_horizon(panel, actions, (horizon,), last_dates)
    return made.select("stock_id", "date", *[F.col(f"{c}_{horizon}d").alias(c) for c in FACTS])
