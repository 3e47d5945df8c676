"""Sinks: report bundles, models with checksums, and sent-key state; webhooks are in ``webhooks``."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    """Each frame as gzip CSV with a header in a folder of its name; Spark's committer makes each one whole or absent."""
    for name, frame in reports.items():
        frame.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{path}/{name}")


def save_model(spark: SparkSession, model: dict, path: str) -> str:
    """A model of plain numbers as one JSON row beside its checksum, by Spark's writer so that any store will do."""
    text = json.dumps(model, sort_keys=True)
    sha = hashlib.sha256(text.encode()).hexdigest()
    spark.createDataFrame([(text, sha)], "model string, sha256 string").coalesce(1).write.mode("overwrite").json(path)
    return sha


def load_model(spark: SparkSession, path: str) -> dict:
    row = spark.read.schema("model string, sha256 string").json(path).first()
    if row is None or hashlib.sha256(row["model"].encode()).hexdigest() != row["sha256"]:
        raise ValueError(f"the model in {path} is missing or not what was saved")
    return json.loads(row["model"])


def newest_keys(sent: DataFrame, user: str, sequence: str, most: int = 5000) -> DataFrame:
    """The last ``most`` sent keys of each user."""
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(sequence)))
    return sent.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")
