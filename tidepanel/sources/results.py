"""Results kept by what they were made of: a digest of inputs and settings names an entry, one atomic marker publishes it."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.sources.tables import path_exists


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of a folder's file names, sizes and times; no file is opened."""
    place, store = _place(spark, path)
    files, found = store.listFiles(place, True), []
    root = store.makeQualified(place).toString()
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString().removeprefix(root), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


def digest(settings: dict, inputs: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps([settings, inputs], sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, root: str, settings: dict, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives for these input paths and settings, built once.

    Data go to a folder of their own; then a marker that names it is moved into place, which either
    happens or doesn't. Without a marker there is no entry, so what a stopped run has written is
    never used; of two runs at once the first to publish counts.
    """
    entry = f"{root}/{digest(settings, {p: fingerprint(spark, p) for p in inputs})}"
    if not path_exists(spark, f"{entry}/complete.json"):
        data = f"data-{uuid.uuid4().hex}"
        build().write.parquet(f"{entry}/{data}")
        _publish(spark, entry, {"data": data, "settings": settings})
    return spark.read.parquet(f"{entry}/{_marker(spark, entry)['data']}")


def _publish(spark: SparkSession, entry: str, content: dict) -> None:
    waiting, store = _place(spark, f"{entry}/.{uuid.uuid4().hex}")
    out = store.create(waiting, False)
    out.write(bytearray(json.dumps(content, default=str).encode()))
    out.close()
    if not store.rename(waiting, _place(spark, f"{entry}/complete.json")[0]):
        store.delete(waiting, False)


def _marker(spark: SparkSession, entry: str) -> dict:
    place, store = _place(spark, f"{entry}/complete.json")
    stream = store.open(place)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def not_done(keys: DataFrame, markers: DataFrame, key: str, signature: str, version: str) -> DataFrame:
    """The keys without a complete marker (key, signature, version, status) of this signature and version; failures are tried again."""
    mine = markers.where((F.col("signature") == signature) & (F.col("version") == version) & (F.col("status") == "complete"))
    return keys.join(mine.select(key).distinct(), key, "left_anti")


def repaired(spark: SparkSession, root: str, keys: DataFrame, key: str, signature: str, version: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Do ``work`` for the keys that aren't done, append its rows and then the keys' markers; all rows of keys that are done.

    ``work`` gives rows with the key, and (key, error) rows where it failed, told by a column error.
    Rows are written before their markers, run by run; rows of a run without markers are not read.
    """
    schema = f"{key} string, signature string, version string, status string, error string, run string"
    place = f"{root}/markers"
    markers = spark.read.schema(schema).parquet(place) if path_exists(spark, place) else spark.createDataFrame([], schema)
    run = uuid.uuid4().hex
    work(not_done(keys, markers, key, signature, version)).withColumns({"run": F.lit(run), "signature": F.lit(signature), "version": F.lit(version)}).write.mode("append").partitionBy("run").parquet(f"{root}/rows")
    made = spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows").where(F.col("run") == run) if path_exists(spark, f"{root}/rows/run={run}") else None
    if made is not None:
        done = made.groupBy(F.col(key).cast("string").alias(key)).agg(F.max("error").alias("error"))
        done.select(key, F.lit(signature).alias("signature"), F.lit(version).alias("version"), F.when(F.col("error").isNull(), "complete").otherwise("failed").alias("status"), "error", F.lit(run).alias("run")).write.mode("append").parquet(place)
    if not path_exists(spark, place):
        return keys.limit(0)
    whole = spark.read.schema(schema).parquet(place).where((F.col("signature") == signature) & (F.col("version") == version) & (F.col("status") == "complete")).select(key, "run")
    return spark.read.parquet(f"{root}/rows").join(whole, [key, "run"], "left_semi").where("error is null").drop("error", "run", "signature", "version")
