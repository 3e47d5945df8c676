"""Readers that check what they read: rolling state, listed symbols, deployed models, a service's quota."""

from __future__ import annotations

import json
import math
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.operators.models import linear_score, standardised
from tidepanel.sources.sinks import load_model
from tidepanel.sources.tables import path_exists

ROLLING = "date date, stock_id string, stock_name string, trading_volume double, trading_money double, open double, high double, low double, close double, foreign_net double, investment_trust_net double, dealer_self_net double, selected_total_net double"
UNIVERSE = "stock_id string, stock_name string, listing_date date"


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file's columns of the schema, found by the header's names in any order; others aren't parsed, missing ones are an error."""
    if not path_exists(spark, path):
        raise ValueError(f"{path} is missing")
    rows = spark.read.option("header", True).csv(path)
    plain = {c.strip().lstrip("﻿"): c for c in rows.columns}
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    lacking = [name for name, _ in fields if name not in plain]
    if lacking:
        raise ValueError(f"{path} lacks the columns {', '.join(lacking)}")
    return rows.select(*[(F.col(f"`{plain[name]}`") if kind == "string" else F.col(f"`{plain[name]}`").try_cast(kind)).alias(name) for name, kind in fields])


def rolling_state(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, str]:
    """(rolling rows, universe, newest date) of a state folder; a rolling table without a date or a universe without a security is an error.

    A date that can't be read is null and takes no part; of rows that repeat a security and date the last of the file's order isn't
    known, so repeats are an error of the read.
    """
    rolling = csv_rows(spark, f"{folder}/rolling_market_data.csv.gz", ROLLING).where("date is not null and stock_id is not null")
    universe = csv_rows(spark, f"{folder}/universe.csv", UNIVERSE).where("stock_id is not null")
    newest = rolling.agg(F.max("date").cast("string")).first()[0]
    if newest is None:
        raise ValueError(f"{folder} has no market date")
    if universe.isEmpty():
        raise ValueError(f"{folder} has no security")
    return _once(rolling, ["stock_id", "date"]), _once(universe, ["stock_id"]), newest


def _once(rows: DataFrame, keys: list[str]) -> DataFrame:
    said = F.concat(F.lit("rows repeat "), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]))
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(said).cast("boolean")).otherwise(True)).drop("_n")


def listed(spark: SparkSession, path: str, columns: tuple[str, ...], key: str = "stock_id") -> DataFrame:
    """The trimmed text columns of a list of symbols; missing columns are an error, and so are blank or repeated symbols when it is read."""
    rows = csv_rows(spark, path, ", ".join(f"{c} string" for c in columns)).select(*[F.trim(c).alias(c) for c in columns])
    named = rows.withColumn(key, F.when(F.coalesce(F.col(key), F.lit("")) == "", F.raise_error(F.lit(f"{path} has a row without {key}")).cast("string")).otherwise(F.col(key)))
    return _once(named, [key])


def deployed_model(spark: SparkSession, path: str) -> dict:
    """A saved model (features, low, high, mean, std, weights, intercept), if its checksum, lengths and numbers are sound."""
    model = load_model(spark, path)
    lists = ("low", "high", "mean", "std", "weights")
    lacking = [k for k in ("features", *lists, "intercept") if k not in model]
    if lacking:
        raise ValueError(f"the model in {path} lacks {', '.join(lacking)}")
    features = model["features"]
    if {len(model[k]) for k in lists} != {len(features)} or len(set(features)) < len(features):
        raise ValueError(f"the model in {path} has other than one number a feature")
    if not all(math.isfinite(x) for k in lists for x in model[k]) or not math.isfinite(model["intercept"]):
        raise ValueError(f"the model in {path} has a number that is not finite")
    if min(model["std"], default=1.0) <= 0 or any(a > b for a, b in zip(model["low"], model["high"], strict=True)):
        raise ValueError(f"the model in {path} has a deviation of zero or less, or bounds that cross")
    return model


def deployed_score(model: dict) -> Column:
    """The model's score: clipped, standardised, weighted."""
    fitted = zip(model["low"], model["high"], model["mean"], model["std"], strict=True)
    return linear_score({f: standardised(f, v) for f, v in zip(model["features"], fitted, strict=True)}, model["weights"], model["intercept"])


def quota_left(url: str, timeout: float = 10.0) -> dict[str, int | None] | None:
    """(used, limit, remaining) by a service's usage page, remaining zero at least; None for whatever goes wrong, as a probe must stop nothing."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            told = json.load(answer)
        used, limit = (None if told.get(k) in (None, "") else int(told[k]) for k in ("user_count", "api_request_limit"))
    except (OSError, ValueError, TypeError, AttributeError):
        return None
    if used is None and limit is None:
        return None
    return {"used": used, "limit": limit, "remaining": None if used is None or limit is None else max(0, limit - used)}
