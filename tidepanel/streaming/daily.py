"""Structured Streaming: daily micro-batches into a bounded state table, and lifecycles with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidepanel.operators.lifecycle import State, layout_day_merged, steps

ROW = "date date, stock_id string, volume double, money double, open double, high double, low double, close double, foreign_net double, trust_net double, dealer_net double, seq long"


def apply_day(state: DataFrame | None, batch: DataFrame, keep_dates: int, least_stocks: int) -> DataFrame:
    """The state after a batch: complete dates only, last version of each key, newest dates only.

    A date counts as complete if ``least_stocks`` securities have it. Applying a batch twice gives
    the same state. All of it is bounded by ``keep_dates`` dates.
    """
    full = batch.groupBy("date").agg(F.count_distinct("stock_id").alias("_n")).where(F.col("_n") >= least_stocks).select("date")
    rows = batch.join(full, "date", "left_semi")
    both = rows if state is None else state.unionByName(rows)
    names = [c for c in both.columns if c not in ("date", "stock_id")]
    last = both.groupBy("date", "stock_id").agg(F.max_by(F.struct(*names), "seq").alias("_r")).select("date", "stock_id", "_r.*")
    dates = last.select("date").distinct().orderBy(F.desc("date")).limit(keep_dates)
    return last.join(F.broadcast(dates), "date", "left_semi").select(*both.columns)


def run_updates(spark: SparkSession, source: str, state_path: str, checkpoint: str, keep_dates: int = 100, least_stocks: int = 1) -> None:
    """Take in all new files of ``source`` and stop. Each batch writes a version of its own, named by
    the batch, from the version before it; a replayed batch writes the same version again."""

    def version(n: int) -> str:
        return f"{state_path}/version={n}"

    def take(batch: DataFrame, n: int) -> None:
        before = spark.read.schema(ROW).parquet(version(n - 1)) if n > 0 else None
        apply_day(before, batch, keep_dates, least_stocks).write.mode("overwrite").parquet(version(n))

    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest_state(spark: SparkSession, state_path: str) -> DataFrame:
    versions = spark.read.schema(ROW + ", version long").option("basePath", state_path).parquet(state_path)
    last = versions.agg(F.max("version").alias("version"))
    return versions.join(F.broadcast(last), "version", "left_semi").drop("version")


def freshness_guard(today: str, newest: str | None, seed: str) -> str:
    """What an update may do: an error for impossible or too old states, ALREADY_CURRENT, or UPDATE."""
    day = pd.Timestamp(today)
    if pd.Timestamp(seed) > day:
        return "SEED_IN_FUTURE"
    if (day - pd.Timestamp(seed)).days > 31:
        return "GAP_TOO_LONG"
    if newest is not None and pd.Timestamp(newest) <= pd.Timestamp(seed):
        return "ALREADY_CURRENT" if (day - pd.Timestamp(seed)).days <= 7 else "STALE"
    return "UPDATE"


def run_guarded_updates(spark: SparkSession, source: str, state_path: str, checkpoint: str, today: Callable[[], str], keep_dates: int = 100, least_stocks: int = 1, longest_gap: int = 31, oldest: int = 7) -> None:
    """Take in new files of ``source`` over a seeded state (version=-1 of ``state_path``), or fail as late data demand.

    A seed dated after today and a gap of more than ``longest_gap`` days between it and today are
    errors. The stream drops repeats of a row and rows that come later than its watermark of
    ``longest_gap`` days. A batch that brings no newer date is ALREADY_CURRENT: the state stays and
    nothing is ready to send. After a batch with newer dates the newest may be ``oldest`` days
    old at most. A batch that fails isn't committed and comes again.
    """

    def version(n: int) -> str:
        return f"{state_path}/version={n}"

    def newest(rows: DataFrame) -> pd.Timestamp | None:
        day = rows.agg(F.max("date")).first()[0]
        return None if day is None else pd.Timestamp(day)

    def take(batch: DataFrame, n: int) -> None:
        before = spark.read.schema(ROW).parquet(version(n - 1))
        if batch.isEmpty():  # the watermark moved on, nothing came
            before.write.mode("overwrite").parquet(version(n))
            return
        held, day = newest(before), pd.Timestamp(today())
        if held > day:
            raise ValueError(f"the state's newest date {held.date()} is after {day.date()}")
        if (day - held).days > longest_gap:
            raise ValueError(f"{(day - held).days} days between the state and {day.date()}, {longest_gap} are allowed; seed it anew")
        after = apply_day(before, batch.select(*before.columns), keep_dates, least_stocks)
        found = newest(after)
        fresh = found > held
        if fresh and (day - found).days > oldest:
            raise ValueError(f"the newest date {found.date()} is more than {oldest} days before {day.date()}")
        (after if fresh else before).write.mode("overwrite").parquet(version(n))
        status = [("UPDATED" if fresh else "ALREADY_CURRENT", found.date() if fresh else held.date(), fresh)]
        spark.createDataFrame(status, "status string, newest date, ready_to_send boolean").coalesce(1).write.mode("overwrite").parquet(f"{state_path}_status/batch={n}")

    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)
    timed = stream.withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", f"{longest_gap} days").dropDuplicatesWithinWatermark(["stock_id", "date", "seq"]).drop("at")
    timed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def seed_state(rows: DataFrame, state_path: str) -> None:
    """Write the state that updates start from."""
    rows.write.mode("overwrite").parquet(f"{state_path}/version=-1")


def batch_statuses(spark: SparkSession, state_path: str) -> DataFrame:
    return spark.read.parquet(f"{state_path}_status")


def lifecycle_stream(scores: DataFrame, machine=layout_day_merged) -> DataFrame:
    """Notifications of a stream of (stock_id, idx, score), the state machine kept per security.

    A row without score is a market day on which the security has none; days between rows age it too.
    """
    names = ("run", "seen", "score", "start", "confirmed", "blocked_until")

    def advance(key, frames: Iterator[pd.DataFrame], held: GroupState):
        state, day = (State(), None) if not held.exists else (State(**dict(zip(names, held.get[:-1], strict=True))), held.get[-1])
        rows = sorted((int(i), None if s is None or s != s else float(s)) for f in frames for i, s in zip(f["idx"].tolist(), f["score"].tolist(), strict=True))
        scored = {i: s for i, s in rows if s is not None and (day is None or i > day)}
        last = max([i for i, _ in rows], default=day)
        if last is not None and (day is None or last > day):
            first = min(scored, default=last) if day is None else day + 1
            found = steps(machine, state, scored, range(first, last + 1))
            held.update((*(getattr(state, n) for n in names), last))
            if found:
                yield pd.DataFrame({"stock_id": [key[0]] * len(found), "idx": [f[0] for f in found], "start_idx": [f[2] for f in found], "type": [f[1] for f in found]})

    return scores.groupBy("stock_id").applyInPandasWithState(
        advance,
        "stock_id string, idx long, start_idx long, type string",
        "run int, seen long, score double, start long, confirmed boolean, blocked_until long, day long",
        "append",
        GroupStateTimeout.NoTimeout,
    )
