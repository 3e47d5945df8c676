"""Linear models applied while a CSV file is read: only the needed columns are parsed, and its rows are counted on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators.models import linear_score
from tidepanel.sources.tables import path_exists


def model_of(weights: dict[str, float], intercept: float) -> dict:
    """A model of plain numbers, as ``sinks.save_model`` takes it."""
    return {"features": sorted(weights), "weights": [float(weights[f]) for f in sorted(weights)], "intercept": float(intercept)}


def score_of(model: dict) -> Column:
    return linear_score({f: F.col(f).cast("double") for f in model["features"]}, model["weights"], model["intercept"])


def score_csv(spark: SparkSession, path: str, models: dict[int, dict], keys: list[str], year: str = "year") -> tuple[DataFrame, Observation]:
    """(keys, year, score) of the rows whose year has a model, and the count of all rows read, known when the frame has been written.

    The header names the columns; others than the keys, the year and the models' features aren't parsed.
    Scoring stays in the scan's stage. A row with a missing or unreadable feature has a null score.
    """
    rows = spark.read.option("header", True).csv(path)
    features = sorted({f for m in models.values() for f in m["features"]})
    lacking = [c for c in (*keys, year, *features) if c not in rows.columns]
    if lacking:
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    seen = Observation("source rows")
    slim = rows.select(*keys, F.col(year).try_cast("int").alias("year"), *[F.col(f).try_cast("double").alias(f) for f in features if f not in keys]).observe(seen, F.count(F.lit(1)).alias("rows"))
    score = None
    for y, model in sorted(models.items()):
        score = F.when(F.col("year") == y, score_of(model)) if score is None else score.when(F.col("year") == y, score_of(model))
    return slim.where(F.col("year").isin(*models)).select(*keys, "year", score.alias("score")), seen


def write_scores(scored: DataFrame, seen: Observation, path: str, expected_rows: int | None = None) -> int:
    """Write the scores, unless the source has other than ``expected_rows``: then nothing is left at ``path`` and it is an error. The rows read."""
    spark = scored.sparkSession
    if path_exists(spark, path):
        raise ValueError(f"{path} is there already")
    waiting = f"{path}.unchecked"
    scored.write.mode("overwrite").parquet(waiting)
    rows = seen.get["rows"]
    here = spark._jvm.org.apache.hadoop.fs.Path(waiting)
    store = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if expected_rows is not None and rows != expected_rows:
        store.delete(here, True)
        raise ValueError(f"the source has {rows} rows, not {expected_rows}")
    store.rename(here, spark._jvm.org.apache.hadoop.fs.Path(path))
    return rows
