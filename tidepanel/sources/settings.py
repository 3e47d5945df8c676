"""User settings from YAML or JSON files, checked strictly, and small maps of reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The keys that a settings file may have.
ALLOWED = {"": ("user", "institutional_candidates", "stocks"), "user": ("id", "enabled", "discord_webhook_key"), "institutional_candidates": ("enabled", "max_new_candidates", "include_state_updates")}
STOCK_KEYS = ("symbol", "average_cost", "profit_alerts")
MOST_NEW = 6


def _as_json(text: str) -> str | None:
    """The text's object as JSON; null if it is none. YAML is read where its parser is installed."""
    try:
        import yaml
    except ImportError:
        yaml = None
    try:
        value = yaml.safe_load(text) if yaml else json.loads(text)
        return json.dumps(value, default=str) if isinstance(value, dict) else None
    except (ValueError, *((yaml.YAMLError,) if yaml else ())):
        return None


def settings_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, settings): each file's object as JSON text, parsed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, text = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_pydict({"name": name, "settings": pa.array([_as_json(t) for t in text], pa.string())})

    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").mapInArrow(run, "name string, settings string")


def faults(settings: Column) -> Column:
    """What is wrong with a settings object, in words; none is an empty array."""
    at = lambda path: F.get_json_object(settings, f"$.{path}")
    said: list[Column] = [F.when(settings.isNull(), "not an object")]

    def unknown(part: Column, allowed: tuple[str, ...], where: str) -> Column:
        extra = F.array_sort(F.array_except(F.json_object_keys(part), F.array(*map(F.lit, allowed))))
        return F.when(F.size(extra) > 0, F.concat(F.lit(f"{where} has unknown keys "), F.array_join(extra, ", ")))

    for where, allowed in ALLOWED.items():
        said.append(unknown(at(where) if where else settings, allowed, where or "the root"))
    said.append(F.when(F.coalesce(F.trim(at("user.id")), F.lit("")) == "", "user.id is missing"))
    part = at("institutional_candidates")
    said.append(F.when(part.isNotNull() & F.json_object_keys(part).isNull(), "institutional_candidates is no object"))
    for flag in ("enabled", "include_state_updates"):
        value = at(f"institutional_candidates.{flag}")
        said.append(F.when(value.isNotNull() & ~value.isin("true", "false"), f"institutional_candidates.{flag} is neither true nor false"))
    most = at("institutional_candidates.max_new_candidates")
    said.append(F.when(most.isNotNull() & ~most.rlike("^[1-9][0-9]*$"), "institutional_candidates.max_new_candidates is no positive integer"))
    stocks = F.from_json(at("stocks"), "array<string>")
    said.append(F.when(F.coalesce(F.size(stocks), F.lit(0)) < 1, "stocks are missing"))
    symbols = F.transform(stocks, lambda s: F.trim(F.get_json_object(s, "$.symbol")))
    said.append(F.when(F.size(F.array_distinct(symbols)) < F.size(symbols), "a symbol is repeated"))

    def stock(s: Column, i: Column) -> Column:
        where = F.concat(F.lit("stocks["), i.cast("string"), F.lit("]"))
        cost, alerts = F.get_json_object(s, "$.average_cost"), F.get_json_object(s, "$.profit_alerts")
        numbers = F.from_json(alerts, "array<string>")
        sound = lambda x: x.rlike(r"^[0-9.eE+-]+$") & (x.try_cast("double") > 0)
        values = F.transform(numbers, lambda x: x.try_cast("double"))
        extra = F.array_sort(F.array_except(F.json_object_keys(s), F.array(*map(F.lit, STOCK_KEYS))))
        return F.array_compact(F.array(
            F.when(F.size(extra) > 0, F.concat(where, F.lit(" has unknown keys "), F.array_join(extra, ", "))),
            F.when(F.coalesce(F.trim(F.get_json_object(s, "$.symbol")), F.lit("")) == "", F.concat(where, F.lit(".symbol is missing"))),
            F.when(~F.coalesce(sound(cost), F.lit(False)), F.concat(where, F.lit(".average_cost is no positive number"))),
            F.when(F.coalesce(F.size(numbers), F.lit(0)) < 1, F.concat(where, F.lit(".profit_alerts are missing"))),
            F.when(F.exists(numbers, lambda x: ~F.coalesce(sound(x), F.lit(False))), F.concat(where, F.lit(".profit_alerts hold other than positive numbers"))),
            F.when((F.size(F.array_distinct(values)) < F.size(values)) | (F.array_sort(values) != values), F.concat(where, F.lit(".profit_alerts do not rise"))),
        ))

    return F.concat(F.array_compact(F.array(*said)), F.coalesce(F.flatten(F.transform(stocks, stock)), F.array().cast("array<string>")))


def user_settings(spark: SparkSession, path: str) -> DataFrame:
    """(name, user_id, webhook_key, enabled, max_new, wants_updates, stocks) of the enabled users' files.

    A fault of an enabled user's file is an error of the read, and so is a folder without one.
    """
    files = settings_files(spark, path)
    s = F.col("settings")
    at = lambda p: F.get_json_object(s, f"$.{p}")
    open_ = files.where(s.isNull() | F.coalesce(at("user.enabled") == "true", F.lit(True)))
    wrong = faults(s)
    checked = open_.withColumn("settings", F.when(F.size(wrong) > 0, F.raise_error(F.concat("name", F.lit(": "), F.array_join(wrong, "; "))).cast("string")).otherwise(s))
    on = lambda key: F.coalesce(at(f"institutional_candidates.{key}") == "true", F.lit(True))
    found = checked.select(
        "name", at("user.id").alias("user_id"), at("user.discord_webhook_key").alias("webhook_key"), on("enabled").alias("enabled"),
        F.coalesce(at("institutional_candidates.max_new_candidates").cast("int"), F.lit(MOST_NEW)).alias("max_new"), on("include_state_updates").alias("wants_updates"),
        F.from_json(at("stocks"), "array<struct<symbol: string, average_cost: double, profit_alerts: array<double>>>").alias("stocks"),
    )
    if found.isEmpty():
        raise ValueError(f"no enabled user in {path}")
    return found


def metric_map(report: DataFrame, key: str = "metric", value: str = "value") -> dict[str, str]:
    """A report of metrics, a row each, as a map; a metric that occurs twice is an error."""
    rows = report.select(F.col(key).cast("string"), F.col(value).cast("string")).collect()  # a report's rows are few by what it is
    out = dict(rows)
    if len(out) < len(rows):
        raise ValueError("a metric occurs twice")
    return out


def require(report: DataFrame, wanted: dict[str, str]) -> None:
    """Raise unless the report's metrics have these values."""
    have = metric_map(report)
    wrong = {k: have.get(k) for k, v in wanted.items() if have.get(k) != v}
    if wrong:
        raise ValueError(f"not ready: {wrong}")


def quote_of(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """The quote of a symbol in a JSON file {stocks: {symbol: {quote: {...}}}}; without one it is an error of the read."""
    quotes = spark.read.text(path, wholetext=True).select(F.from_json("value", "stocks map<string, struct<quote: struct<symbol: string, name: string, price: double, previous_close: double, as_of: string>>>").alias("v"))
    q = F.try_element_at("v.stocks", F.lit(symbol))["quote"]
    return quotes.select(F.when(q.isNull(), F.raise_error(F.lit(f"no quote of {symbol}")).cast("string")).otherwise(q["symbol"]).alias("symbol"), q["name"].alias("name"), q["price"].alias("price"), q["previous_close"].alias("previous_close"), q["as_of"].alias("as_of"))


def checked(settings: dict, rules: dict[str, tuple[Callable[..., bool], str]]) -> dict:
    """The settings, if each rule (a test of the named settings, and what to say) holds; all that fail are told at once."""
    said = [words for names, (test, words) in rules.items() if not test(*[settings[n] for n in names.split(",")])]
    if said:
        raise ValueError("; ".join(said))
    return settings


def rising(values) -> bool:
    """Whether values are sorted and differ."""
    return all(a < b for a, b in zip(values, values[1:], strict=False))


#: What the fold models' settings must be.
FOLD_RULES = {
    "minimum_training_years": (lambda n: n >= 2, "training needs two years at least"),
    "calibration_years": (lambda n: n >= 1, "calibration needs a year at least"),
    "clip_low,clip_high": (lambda a, b: 0 <= a < b <= 1, "clipping needs 0 <= low < high <= 1"),
    "penalties": (lambda p: len(p) > 0 and min(p) >= 0 and rising(p), "penalties are zero or more, and rise"),
    "horizons": (lambda h: len(h) > 0 and min(h) > 0 and rising(h), "horizons are positive and rise"),
}
