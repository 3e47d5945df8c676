"""One wide row per security and day: features, quality and labels; its dictionary, models' reports and label repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.operators import features as X
from tidepanel.operators.returns import with_returns

# The feature names' parts, their panel columns and windows, and each market's model.
ACTORS = {"foreign": "foreign_net", "investment_trust": "trust_net", "dealer_self": "dealer_net", "selected_total": "total_net"}
FLOW_WINDOWS = (1, 3, 5, 10, 20)
BUY_DAY_WINDOWS = (5, 10, 20)
AGREEMENT_WINDOWS = (1, 5, 20)
HORIZONS = (5, 10, 40)
ACCELERATION = "selected_total_acceleration_5d_vs_20d"
CORE_ACTORS = ("foreign", "investment_trust", "dealer_self")
CORE_WINDOWS = {"flow": (1, 5, 20), "buy_day": (5, 20)}
MARKET_MODELS = {"tpex": ("core22_l2_1e-3", "core", 0.001), "twse": ("full40_l2_1e-3", "full", 0.001)}


def feature_names(actors=tuple(ACTORS), flows=FLOW_WINDOWS, buy_days=BUY_DAY_WINDOWS) -> list[str]:
    own = [n for a in actors for n in (*(f"{a}_flow_pct_{w}d" for w in flows), *(f"{a}_buy_day_ratio_{w}d" for w in buy_days), f"{a}_streak")]
    return [*own, *(f"institutional_agreement_{w}d" for w in AGREEMENT_WINDOWS), ACCELERATION]


def market_spec(market: str) -> dict:
    """The model of a market: candidate, features and penalty; an unknown market is an error."""
    if market.lower() not in MARKET_MODELS:
        raise ValueError(f"no model for market {market!r}")
    candidate, kind, penalty = MARKET_MODELS[market.lower()]
    names = feature_names() if kind == "full" else [n for n in feature_names() if n in _core()]
    return {"market": market.lower(), "candidate_id": candidate, "features": names, "l2_penalty": penalty}


def _core() -> set[str]:
    return set(feature_names(CORE_ACTORS, CORE_WINDOWS["flow"], CORE_WINDOWS["buy_day"]))


def with_features(panel: DataFrame) -> DataFrame:
    """The panel with all forty features; every frame is by security and day, so one shuffle and sort serve them."""
    flags = {f"_s_{a}": F.when(F.signum(net) == F.lag(F.signum(net)).over(X.by_date()), None).otherwise(F.col("idx")) for a, net in ACTORS.items()}
    since = X.by_date().rowsBetween(Window.unboundedPreceding, 0)
    # a frame's sum is asked for by several features and made once
    total = lambda c, w: F.col(f"_{c}_{w}")
    sums = {f"_{c}_{w}": F.sum(c).over(X.trailing(w)) for c in ("volume", *ACTORS.values()) for w in FLOW_WINDOWS}
    share = lambda net, w: F.when(total("volume", w) > 0, 100 * total(net, w) / total("volume", w)).otherwise(0.0)
    made: dict[str, Column] = {}
    for a, net in ACTORS.items():
        made |= {f"{a}_flow_pct_{w}d": share(net, w) for w in FLOW_WINDOWS}
        made |= {f"{a}_buy_day_ratio_{w}d": X.buy_day_ratio(net, w) for w in BUY_DAY_WINDOWS}
        made[f"{a}_streak"] = ((F.col("idx") - F.max(f"_s_{a}").over(since) + 1) * F.signum(net)).cast("double")
    made |= {f"institutional_agreement_{w}d": sum((F.signum(total(net, w)) for net in X.NETS[1:3]), F.signum(total(X.NETS[0], w))) / 3.0 for w in AGREEMENT_WINDOWS}
    made[ACCELERATION] = share("total_net", 5) - share("total_net", 20)
    return panel.withColumns(flags | sums).withColumns(made).drop(*flags, *sums)


def sample_rows(events: DataFrame, least_money: float, horizons=HORIZONS) -> DataFrame:
    """Days with a price of a panel ``with_events``: features, the liquidity screen, the first exclusion reason, and per horizon status, returns and eligibility."""
    rows = with_features(X.liquidity(events, least_money)).withColumn("exclusion", X.exclusion(None, least_money))
    kept = [f"{c}_{h}d" for h in horizons for c in ("status", "raw", "adjusted", "highest", "lowest")] + (["label_10d"] if 10 in horizons else [])
    rows = with_returns(rows, tuple(horizons)).where("present")  # features and labels from one sort
    rows = rows.select("stock_id", "date", F.year("date").alias("year"), *feature_names(), "history", "normal_days", "median_money", "zero_run", "liquid", "entry_ready", "exclusion", *kept)
    for h in horizons:
        rows = rows.withColumn(f"eligible_{h}d", F.col("liquid") & F.col("entry_ready") & (F.col(f"status_{h}d") == "ok"))
    return rows


def training_rows(samples: DataFrame) -> DataFrame:
    """The rows a model is fitted on. Written by market and year (sources.tables.write_partitioned) a rerun replaces what it has made."""
    return samples.where("eligible_10d")


def dictionary(spark) -> DataFrame:
    """(column, role, model_input): the sample rows' columns and what they are for."""
    roles = [(c, "metadata") for c in ("stock_id", "date", "year")] + [(c, "feature") for c in feature_names()]
    roles += [(c, "filter") for c in ("history", "normal_days", "median_money", "zero_run", "liquid", "entry_ready")] + [("exclusion", "quality")]
    roles += [(f"{c}_{h}d", "label") for h in HORIZONS for c in ("status", "raw", "adjusted", "highest", "lowest", "eligible")] + [("label_10d", "label")]
    return spark.createDataFrame([(c, role, role == "feature") for c, role in roles], "column string, role string, model_input boolean")


def coefficient_report(models: DataFrame) -> DataFrame:
    """(market, year, class, feature, value) of models (market, year, classes, features, intercepts, weights by class).

    Each class has its intercept and weights, and UP_MINUS_DOWN their difference.
    """
    names = F.concat(F.array(F.lit("(intercept)")), "features")
    at = lambda k: (F.array_position("classes", k) - 1).cast("int")
    values = lambda i: F.concat(F.array(F.get("intercepts", i)), F.get("weights", i))
    own = F.transform("classes", lambda c, i: F.struct(c.alias("class"), values(i).alias("values")))
    both = F.struct(F.lit("UP_MINUS_DOWN").alias("class"), F.zip_with(values(at("UP")), values(at("DOWN")), lambda u, d: u - d).alias("values"))
    row = lambda c: F.zip_with(names, c["values"], lambda n, v: F.struct(c["class"].alias("class"), n.alias("feature"), v.alias("value")))
    return models.select("market", "year", F.explode(F.flatten(F.transform(F.concat(own, F.array(both)), row))).alias("v")).select("market", "year", "v.*")


def models_from_report(report: DataFrame) -> DataFrame:
    """(market, year, class, intercept, weights): the report read back, weights as a map by feature."""
    plain = report.where("class <> 'UP_MINUS_DOWN'")
    own = F.when(F.col("feature") != "(intercept)", F.struct("feature", "value"))
    return plain.groupBy("market", "year", "class").agg(F.max(F.when(F.col("feature") == "(intercept)", F.col("value"))).alias("intercept"), F.map_from_entries(F.array_sort(F.collect_list(own))).alias("weights"))


def repaired_labels(rows: DataFrame, label: str, right: Column) -> DataFrame:
    """The rows with the right label and ``changed``, whether it was another or none."""
    return rows.withColumn("changed", ~F.col(label).eqNullSafe(right)).withColumn(label, right)
