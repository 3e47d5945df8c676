"""Resumable download: pending requests are a stream of plan files, answered on the executors, each once.

A round's plan is written as one file for each batch of securities. Structured Streaming takes up a
file a micro-batch; its checkpoint is the durable record of what was attempted, so a stopped run
goes on with the next file. A batch's outcomes are one committed write, and a batch that is replayed
after its write asks nothing again. When the service refuses for lack of quota, the rest of the
round is put off without being asked, and a later round plans whatever isn't complete.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.sources.rest import Quota, fetch
from tidepanel.sources.tables import path_exists, upsert

REQUEST = "service string, dataset string, stock_id string, start date, end date, latest date"
OUTCOME = f"{REQUEST}, status string, payload string, error string"
KEY = ["dataset", "stock_id"]
DONE = ("complete", "already_current")
READY, INCOMPLETE, BLOCKED = "READY", "INCOMPLETE_DOWNLOAD", "BLOCKED_SOURCE_COVERAGE"


def pending_requests(universe: DataFrame, latest: DataFrame, outcomes: DataFrame, datasets: dict[str, str], target: str, warm_up: int) -> DataFrame:
    """The requests (REQUEST) for what isn't complete up to ``target``, one a security and dataset.

    ``universe`` has (stock_id, listing_date), ``latest`` (dataset, stock_id, latest), ``datasets``
    the service of each dataset. A security is asked for from the day after its latest row, without
    one from ``warm_up`` days before the target or its listing, whichever is later. A start past the
    target is a request that needs no asking.
    """
    goal = F.lit(target).cast("date")
    named = F.explode(F.array(*[F.struct(F.lit(s).alias("service"), F.lit(d).alias("dataset")) for d, s in datasets.items()]))
    wanted = universe.groupBy("stock_id").agg(F.max("listing_date").alias("listing_date")).select("stock_id", "listing_date", named.alias("d")).select("stock_id", "listing_date", "d.*")
    known = latest.where(F.col("latest") <= goal).groupBy(*KEY).agg(F.max("latest").alias("latest"))
    done = outcomes.where((F.col("end") == goal) & F.col("status").isin(*DONE)).select(*KEY).distinct()
    first = F.date_sub(goal, warm_up)
    start = F.coalesce(F.date_add("latest", 1), F.greatest(first, F.coalesce("listing_date", first)))
    return wanted.join(done, KEY, "left_anti").join(known, KEY, "left").select("service", "dataset", "stock_id", start.alias("start"), goal.alias("end"), "latest")


def write_plan(requests: DataFrame, path: str, stocks: int) -> int:
    """Write a round's requests, about ``stocks`` securities a file, all datasets of one together; how many securities there are."""
    held = requests.persist()
    n = held.select("stock_id").distinct().count()
    if n:
        held.repartitionByRange(-(-n // stocks), "stock_id").write.mode("overwrite").parquet(path)
    held.unpersist()
    return n


def answered(requests: DataFrame, url: str, pause: float, wait: float, open_: bool = True) -> DataFrame:
    """The requests with status, payload and error. A service's requests are one task's, so its rate is kept; ``open_`` False puts all off.

    ``url`` holds {dataset}, {stock_id}, {start} and {end}. Statuses: complete, already_current (start past
    the end), failed, quota_exceeded, and deferred for what follows a refusal.
    """
    names = [f.split()[0] for f in OUTCOME.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refused, asked = (set() if open_ else None), 0
        for batch in batches:
            for r in batch.to_pylist():
                status, payload, error = "deferred", None, None
                if r["start"] > r["end"]:
                    status = "already_current"
                elif refused is not None and r["service"] not in refused:
                    if asked:
                        time.sleep(pause)
                    asked += 1
                    try:
                        status, payload = "complete", fetch(url.format(**r), wait=wait)
                    except Quota as e:
                        status, error = "quota_exceeded", str(e)
                        refused.add(r["service"])
                    except Exception as e:  # noqa: BLE001  whatever a request meets is its outcome
                        status, error = "failed", f"{type(e).__name__}: {e}"
                values = [*(r[n] for n in names[:-3]), status, payload, error]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES, strict=True)], names=names)

    return requests.repartition("service").sortWithinPartitions("service", "stock_id", "dataset").mapInArrow(run, OUTCOME)


_TYPES = [pa.string(), pa.string(), pa.string(), pa.date32(), pa.date32(), pa.date32(), pa.string(), pa.string(), pa.string()]


def read_outcomes(spark: SparkSession, state: str) -> DataFrame:
    """All outcomes with their round and batch; none yet is an empty table."""
    schema = f"{OUTCOME}, round int, batch long"
    return spark.read.schema(schema).option("basePath", f"{state}/outcomes").parquet(f"{state}/outcomes") if path_exists(spark, f"{state}/outcomes") else spark.createDataFrame([], schema)


def run_round(spark: SparkSession, state: str, number: int, url: str, pause: float = 0.25, wait: float = 1.0, before_batch: Callable[[int], None] | None = None) -> None:
    """Answer what the round's plan still holds, a file a batch, and stop."""
    plan, mine = f"{state}/plan/round={number}", f"{state}/outcomes/round={number}"

    def take(batch: DataFrame, n: int) -> None:
        if path_exists(spark, f"{mine}/batch={n}/_SUCCESS"):
            return  # replayed after its outcomes were committed
        if before_batch:
            before_batch(n)
        open_ = not path_exists(spark, mine) or read_outcomes(spark, state).where((F.col("round") == number) & (F.col("status") == "quota_exceeded")).isEmpty()
        answered(batch, url, pause, wait, open_).write.mode("overwrite").parquet(f"{mine}/batch={n}")

    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(plan)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{state}/checkpoints/round={number}").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([(number,)], "round int").coalesce(1).write.mode("overwrite").parquet(f"{state}/finished/round={number}")


def store_rows(spark: SparkSession, state: str, number: int, dataset: str, schema: str) -> DataFrame:
    """Write the dataset's table as it is after the round: version ``number`` from the one before, so that doing it again gives the same.

    Payloads are JSON lists of rows of ``schema``, which has stock_id and date; the newest round's row of a key counts.
    """
    place = f"{state}/store/{dataset}"
    got = read_outcomes(spark, state).where((F.col("round") == number) & (F.col("dataset") == dataset) & (F.col("status") == "complete"))
    rows = got.select(F.explode(F.from_json("payload", f"array<struct<{schema}>>")).alias("r")).select("r.*", F.lit(number).alias("seq")).dropDuplicates(["stock_id", "date"])
    old = stored(spark, state, dataset, schema, number - 1)
    upsert(old, rows.select(*old.columns), ["stock_id", "date"], "seq").write.mode("overwrite").parquet(f"{place}/version={number}")
    return stored(spark, state, dataset, schema, number)


def stored(spark: SparkSession, state: str, dataset: str, schema: str, number: int) -> DataFrame:
    place = f"{state}/store/{dataset}/version={number}"
    full = ", ".join(part.replace(":", " ", 1) for part in schema.split(", ")) + ", seq int"
    return spark.read.schema(full).parquet(place) if path_exists(spark, place) else spark.createDataFrame([], full)


def status_report(universe: DataFrame, datasets: dict[str, str], outcomes: DataFrame, latest: DataFrame, target: str) -> DataFrame:
    """(dataset, stock_id, status, round, latest, reached): each request's last outcome towards ``target``, pending where there is none."""
    goal = F.lit(target).cast("date")
    every = universe.select("stock_id").distinct().select("stock_id", F.explode(F.array(*map(F.lit, datasets))).alias("dataset"))
    last = outcomes.where(F.col("end") == goal).groupBy(*KEY).agg(F.max(F.struct("round", "batch", "status")).alias("l")).select(*KEY, "l.status", "l.round")
    known = latest.where(F.col("latest") <= goal).groupBy(*KEY).agg(F.max("latest").alias("latest"))
    return every.join(last, KEY, "left").join(known, KEY, "left").select(*KEY, F.coalesce("status", F.lit("pending")).alias("status"), "round", "latest", F.coalesce(F.col("latest") >= goal, F.lit(False)).alias("reached"))


def batch_history(outcomes: DataFrame) -> DataFrame:
    """A row for each round and batch: its securities, requests by outcome, and how many requests are complete by then."""
    count = lambda *names: F.count_if(F.col("status").isin(*names))
    by = outcomes.groupBy("round", "batch").agg(F.count_distinct("stock_id").alias("stocks"), count(*DONE).alias("completed"), count("failed").alias("failed"), count("deferred").alias("deferred"), (count("quota_exceeded") > 0).alias("quota_exhausted"), count("complete", "failed", "quota_exceeded").alias("asked"))
    return by.withColumn("completed_after", F.sum("completed").over(Window.orderBy("round", "batch")))  # a row a batch


def pipeline_status(report: DataFrame, least: float) -> DataFrame:
    """One row: requests, completed and failed ones, the share that reached the target, and what may follow."""
    one = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    totals = report.agg(F.count("*").alias("expected"), one(F.col("status").isin(*DONE)).alias("completed"), one(F.col("status").isin("failed", "quota_exceeded")).alias("failed"), one(F.col("reached")).alias("reached"))
    share = F.coalesce(F.try_divide("reached", "expected"), F.lit(0.0))
    status = F.when((F.col("completed") < F.col("expected")) | (F.col("failed") > 0), INCOMPLETE).when(share < least, BLOCKED).otherwise(READY)
    return totals.withColumn("share", share).withColumn("status", status)


def publish(spark: SparkSession, state: str, number: int, status: str) -> None:
    """Append a pointer to the version; readers take the newest that is READY."""
    spark.createDataFrame([(number, status)], "version int, status string").coalesce(1).write.mode("append").parquet(f"{state}/pointers")


def published_version(spark: SparkSession, state: str) -> int | None:
    """The newest version that was published as READY; without one the reader falls back to what it had before."""
    if not path_exists(spark, f"{state}/pointers"):
        return None
    return spark.read.schema("version int, status string").parquet(f"{state}/pointers").where(F.col("status") == READY).agg(F.max("version")).first()[0]


def download(
    spark: SparkSession, state: str, universe: DataFrame, datasets: dict[str, str], schemas: dict[str, str], target: str, url: str, *,
    warm_up: int = 180, stocks: int = 100, least: float = 0.98, pause: float = 0.25, wait: float = 1.0, rounds: int = 1, on_quota: Callable[[], None] = lambda: None, before_batch: Callable[[int], None] | None = None,
) -> str:
    """Bring all datasets up to ``target`` as far as the quota goes, and publish them if complete and covered; the status.

    A round that an earlier call left unfinished goes on first. A round that met the quota is followed,
    after ``on_quota`` has waited, by one with all that isn't complete; other failures are tried
    once a call. A stored version holds the rows of all rounds up to it.
    """

    def latest(number: int) -> DataFrame:
        of = [stored(spark, state, d, schemas[d], number).groupBy("stock_id").agg(F.max("date").alias("latest")).withColumn("dataset", F.lit(d)) for d in datasets]
        out = of[0]
        for more in of[1:]:
            out = out.unionByName(more)
        return out

    for turn in range(rounds):
        number = _last_round(spark, state)
        if not number or path_exists(spark, f"{state}/finished/round={number}"):
            pending = pending_requests(universe, latest(number), read_outcomes(spark, state), datasets, target, warm_up)
            if not write_plan(pending, f"{state}/plan/round={number + 1}", stocks):
                break
            number += 1
        run_round(spark, state, number, url, pause, wait, before_batch)
        for d in datasets:
            store_rows(spark, state, number, d, schemas[d])
        if read_outcomes(spark, state).where((F.col("round") == number) & F.col("status").isin("quota_exceeded", "deferred")).isEmpty():
            break
        if turn + 1 < rounds:
            on_quota()
    number = _last_round(spark, state)
    report = status_report(universe, datasets, read_outcomes(spark, state), latest(number), target)
    status = pipeline_status(report, least).first()["status"]
    if status == READY and published_version(spark, state) != number:
        publish(spark, state, number, status)
    return status


def _last_round(spark: SparkSession, state: str) -> int:
    """The highest round with a whole plan; 0 if there is none."""
    number = 0
    while path_exists(spark, f"{state}/plan/round={number + 1}/_SUCCESS"):
        number += 1
    return number
