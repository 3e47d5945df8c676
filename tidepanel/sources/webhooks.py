"""Notifications posted from the executors, each key once: what was sent is written after each wave and skipped on replay."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.sources.tables import path_exists

SENT = "user_id string, event_key string, batch long, wave int, sent boolean, error string"


def post_json(url: str, body: str, attempts: int = 3, wait: float = 1.0, timeout: float = 30.0) -> None:
    """Post; told to wait (429) or refused by the server (5xx) it is tried again, other refusals are final."""
    for n in range(attempts):
        try:
            asked = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(asked, timeout=timeout):
                return
        except urllib.error.HTTPError as e:
            if n + 1 == attempts or not (e.code == 429 or e.code >= 500):
                raise
            time.sleep(max(float(e.headers.get("Retry-After") or 0), wait * 2**n))


def embed(title: Column, description: Column, fields: dict[str, Column], footer: str, timestamp: Column | None = None) -> Column:
    """A message of one embed as JSON; fields without a value are left out."""
    cells = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("name"), v.cast("string").alias("value"), F.lit(True).alias("inline"))) for k, v in fields.items()]
    parts = [title.alias("title"), description.alias("description"), F.array_compact(F.array(*cells)).alias("fields"), F.struct(F.lit(footer).alias("text")).alias("footer")]
    return F.to_json(F.struct(F.array(F.struct(*parts, *([timestamp.alias("timestamp")] if timestamp is not None else []))).alias("embeds")))


def profit_message(holdings: DataFrame) -> DataFrame:
    """The holdings (symbol, name, price, average_cost, profit_pct, new_thresholds, analyzed_at) with ``body``, where a threshold is newly crossed."""
    crossed = F.array_join(F.transform("new_thresholds", lambda t: F.format_string("+%.0f%%", t)), ", ")
    fields = {"Price": F.col("price"), "Average cost": F.col("average_cost"), "Profit": F.format_string("%+.1f%%", F.col("profit_pct"))}
    body = embed(F.concat_ws(" ", "symbol", "name"), F.concat(F.lit("Crossed for the first time: "), crossed), fields, "A reminder of cost and profit, no advice", F.col("analyzed_at").cast("string"))
    return holdings.where(F.size("new_thresholds") > 0).withColumn("body", body)


def candidate_message(notes: DataFrame, titles: dict[str, str]) -> DataFrame:
    """The notes (type, stock_id, stock_name, percentile, cost_low, cost_high, close, reason) with ``body``; ``titles`` gives each type's words."""
    words = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv])
    cost = F.when(F.col("cost_low").isNotNull(), F.format_string("%.2f to %.2f", F.col("cost_low"), F.col("cost_high")))
    fields = {"Percentile of the day": F.format_string("%.1f", F.col("percentile")), "Estimated cost": cost, "Close": F.col("close")}
    title = F.concat_ws(" ", F.coalesce(F.try_element_at(words, F.col("type")), F.col("type")), "stock_id", "stock_name")
    return notes.withColumn("body", embed(title, F.coalesce("reason", F.lit("")), fields, "A relative order within one day; no advice"))


def webhook_sink(state: str, post: Callable[[str, str], None] = post_json) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for rows (user_id, url, event_key, position, body).

    A batch is written down first, without keys that were sent before, each key once a user. Then it goes out
    in waves: a user's first message in the first, the second in the next, each wave dealt by user over the
    executors and its keys committed before the next starts. So there are as many waves as one user has
    messages, and a run that dies has at most one wave whose keys are unknown. After a failure a user's
    later messages wait, and the batch fails once all others are out, so that its replay tries what is left.
    """

    def send(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        keys, waiting = f"{state}/keys", f"{state}/waiting/batch={n}"

        def known() -> DataFrame:
            return spark.read.schema(SENT).parquet(keys) if path_exists(spark, keys) else spark.createDataFrame([], SENT)

        mine = ["user_id", "event_key"]
        fresh = batch.select("user_id", "url", "event_key", "position", "body").dropDuplicates(mine).join(known().where("sent").select(*mine), mine, "left_anti")
        wave = F.row_number().over(Window.partitionBy("user_id").orderBy("position", "event_key"))
        fresh.withColumn("wave", wave).write.mode("overwrite").parquet(waiting)
        todo = spark.read.parquet(waiting)
        stopped: DataFrame | None = None
        for w in range(1, (todo.agg(F.max("wave")).first()[0] or 0) + 1):
            now = todo.where(F.col("wave") == w)
            if stopped is not None:
                now = now.join(stopped, "user_id", "left_anti")
            place = f"{state}/tries/batch={n}/wave={w}"
            _posted(now, post, n).write.mode("overwrite").parquet(place)
            tried = spark.read.schema(SENT).parquet(place)
            tried.write.mode("append").parquet(keys)
            failed = tried.where("not sent").select("user_id")
            stopped = failed if stopped is None else stopped.unionByName(failed)
        if stopped is not None and not stopped.isEmpty():
            raise RuntimeError(f"batch {n}: messages of {stopped.distinct().count()} users were not taken")

    return send


def _posted(rows: DataFrame, post: Callable[[str, str], None], batch: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for r in part.to_pylist():
                error = None
                try:
                    post(r["url"], r["body"])
                except Exception as e:  # noqa: BLE001  whatever a post meets is its outcome
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{"user_id": r["user_id"], "event_key": r["event_key"], "batch": batch, "wave": r["wave"], "sent": error is None, "error": error}], schema=_SCHEMA)

    return rows.repartition("user_id").mapInArrow(run, SENT)


_SCHEMA = pa.schema([("user_id", pa.string()), ("event_key", pa.string()), ("batch", pa.int64()), ("wave", pa.int32()), ("sent", pa.bool_()), ("error", pa.string())])


def addresses(mapping: str | None, default: str | None, key: Column) -> Column:
    """Each user's address from a JSON object of them by key, or else the default; what isn't JSON is an error."""
    named = json.loads(mapping) if mapping else {}
    if not named:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.coalesce(key, F.lit("default"))), F.lit(default))
