"""What comes in: a day's quotes and flows, seeds, plans and masters, checked as they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The columns a notification plan must have, what its flags say for yes, the
#: types' priority, and the types of entry rules.
PLAN_COLUMNS = ("user_id", "stock_id", "signal_date", "event_id", "notification_type", "notify_mode", "eligible_for_future_github", "ready_to_send", "trade_action")
YES = ("1", "1.0", "true", "yes", "y")
TYPE_PRIORITY = {"LAYOUT_CONFIRMED_DIRECT": 50, "TWSE_TRACK_CONFIRMED": 50, "NEW_CANDIDATE": 40, "LAYOUT_CONFIRMED_AND_EXTENDED": 35, "LAYOUT_CONFIRMED": 30, "DAY20_EXTEND": 20, "DAY20_EXTEND_STRONG": 20, "TWSE_DAY40_END": 10}
EVENT_TYPES = {"top10_confirm1d": "NEW_CANDIDATE", "top20_confirm5d": "LAYOUT_CONFIRMED_DIRECT"}


def once(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows; reading them fails if a key occurs twice."""
    n = F.count("*").over(Window.partitionBy(*keys))
    fail = F.raise_error(F.concat_ws(" ", F.lit(f"{what} repeat"), *[F.col(k).cast("string") for k in keys])).cast("boolean")
    return rows.withColumn("_once", n).where(F.when(F.col("_once") == 1, True).otherwise(fail)).drop("_once")


def require_columns(rows: DataFrame, names) -> DataFrame:
    missing = sorted(set(names) - set(rows.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return rows


def merge_day(quotes: DataFrame, flows: DataFrame, universe: DataFrame) -> DataFrame:
    """Quotes and flows of the universe's four-digit codes by day and security.

    Where one side has a single date and the other none, it is taken for both. A repeated key on
    either side, a side without rows and an empty result are errors.
    """
    dates = [[r["date"] for r in side.where("date is not null").select("date").distinct().limit(2).collect()] for side in (quotes, flows)]
    if quotes.isEmpty() or flows.isEmpty():
        raise ValueError("quotes or flows have no rows")
    sides = []
    for side, own, other, name in ((quotes, *dates, "quotes"), (flows, dates[1], dates[0], "flows")):
        dated = side.withColumn("date", F.lit(other[0])) if not own and len(other) == 1 else side
        known = dated.where(F.col("stock_id").rlike("^[0-9]{4}$")).join(universe.select("stock_id").distinct(), "stock_id", "left_semi")
        sides.append(once(known, ["date", "stock_id"], name))
    merged = sides[0].join(sides[1], ["date", "stock_id"])
    if merged.isEmpty():
        raise ValueError("no security has both quotes and flows")
    return merged


def two_sided(quotes: DataFrame, flows: DataFrame) -> DataFrame:
    """(date, quotes, flows): rows a day on both sides; reading it fails on a day that only one side has."""
    n = lambda side, name: side.groupBy("date").agg(F.count("*").alias(name))
    days = n(quotes, "quotes").join(n(flows, "flows"), "date", "full_outer").fillna(0, ["quotes", "flows"])
    fail = F.raise_error(F.concat_ws(" ", F.lit("only one side has rows on"), F.col("date").cast("string"))).cast("boolean")
    return days.where(F.when((F.col("quotes") > 0) & (F.col("flows") > 0), True).otherwise(fail))


def seed(rows: DataFrame, least: Column, days: int) -> DataFrame:
    """The rows of the last ``days`` dates on which at least ``least`` securities have one; few dates, so they are broadcast."""
    whole = rows.groupBy("date").agg(F.count_distinct("stock_id").alias("n")).where(F.col("n") >= least).orderBy(F.desc("date")).limit(days)
    return rows.join(F.broadcast(whole.select("date")), "date", "left_semi")


def read_plan(plan: DataFrame, today: Column) -> DataFrame:
    """A notification plan's rows that may be sent, with ``position`` in each user's order.

    Rows not eligible, not ready or expired go. Of the rest a trade action other than TRACK_ONLY, an
    unreadable date and a repeated user, event, type and day are errors, and a missing column is one at once.
    """
    p = require_columns(plan, PLAN_COLUMNS)
    for c in ("percentile", "plan_valid_until"):
        if c not in p.columns:
            p = p.withColumn(c, F.lit(None).cast("string"))
    yes = lambda c: F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).isin(*YES), F.lit(False))
    until = F.nullif(F.trim(F.col("plan_valid_until").cast("string")), F.lit("")).cast("date")
    p = p.where(yes("eligible_for_future_github") & yes("ready_to_send")).where(until.isNull() | (until >= today))
    fail = F.raise_error(F.concat_ws(" ", F.lit("a plan may only track:"), "event_id", "trade_action")).cast("boolean")
    p = once(p.where(F.when(F.col("trade_action") == "TRACK_ONLY", True).otherwise(fail)), ["user_id", "event_id", "notification_type", "signal_date"], "plan rows")
    rank = F.coalesce(F.create_map(*[x for k, v in TYPE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])[F.col("notification_type")], F.lit(0))
    value = F.coalesce(F.nullif(F.expr("try_cast(percentile AS double)"), F.lit(0.0)), F.lit(-1.0))
    order = Window.partitionBy("user_id").orderBy(rank.desc(), value.desc(), "stock_id", "event_id", "notification_type", "signal_date")
    return p.withColumn("position", F.row_number().over(order))


def typed_events(events: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """Events of the wanted entry rules with their notification type."""
    kinds = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])
    return events.where(F.col("entry_rule").isin(*rules)).withColumn("event_type", F.coalesce(kinds[F.col("entry_rule")], F.lit("OTHER")))


def compared(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two lists has."""
    l, r = (side.select(key).distinct() for side in (left, right))
    return l.join(r, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(r.join(l, key, "left_anti").withColumn("side", F.lit("right_only")))


def require_markets(master: DataFrame, markets=("twse", "tpex")) -> dict[str, int]:
    """Rows of each market in the company master; a market without any is an error."""
    n = {r["market"]: r["n"] for r in master.where(F.col("market").isin(*markets)).groupBy("market").agg(F.count("*").alias("n")).collect()}
    missing = [m for m in markets if not n.get(m)]
    if missing:
        raise ValueError(f"the company master lacks {missing}: {n}")
    return n


def frozen_end(asked: str | None, stored: str | None, status: DataFrame, today: str) -> str:
    """The end date that a resumed download keeps: asked for, stored before, the last one completed, or today."""
    done = status.where("stock_id <> '*' and status = 'complete'").agg(F.max("requested_end")).first()[0]
    return asked or stored or (str(done) if done else today)
