"""Linear rank models, preprocessing, calibration and folds, fitted with aggregates over all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.quantiles import exact_quantiles


def standardiser(rows: DataFrame, names: list[str], low: float = 0.005, high: float = 0.995) -> dict[str, tuple[float, float, float, float]]:
    """name -> (low bound, high bound, mean, std) after clipping to exact quantiles; a constant gets std 1.

    A few aggregations of all rows, which are made once for them; one row of numbers per feature comes back.
    """
    rows = rows.select(*names).persist()  # lost blocks are made anew
    q = exact_quantiles(rows.unpivot([], names, "feature", "value"), "value", [low, high], ("feature",)).collect()
    bounds = {n: (x[0], x[1]) for n, x in q}
    clipped = {n: F.greatest(F.least(F.col(n), F.lit(b)), F.lit(a)) for n, (a, b) in bounds.items()}
    m = rows.agg(*[F.avg(c).alias(f"m_{n}") for n, c in clipped.items()], *[F.stddev_pop(c).alias(f"s_{n}") for n, c in clipped.items()]).first()
    rows.unpersist()
    return {n: (*bounds[n], m[f"m_{n}"], m[f"s_{n}"] if m[f"s_{n}"] >= 1e-8 else 1.0) for n in names}


def standardised(name: str, fitted: tuple[float, float, float, float]) -> Column:
    low, high, mean, std = (F.lit(float(x)) for x in fitted)
    return (F.greatest(F.least(F.col(name), high), low) - mean) / std


def ridge(rows: DataFrame, features: dict[str, Column], target: str, penalty: float) -> tuple[np.ndarray, float]:
    """(weights, intercept) of least squares with a penalty on the sum scale and a free intercept.

    The Gram matrix is one aggregation of all rows; only it, as large as the features squared,
    reaches the driver, which solves the normal equations.
    """
    names = list(features)
    k = len(names)
    z = rows.select(*[c.alias(f"z{i}") for i, c in enumerate(features.values())], F.col(target).cast("double").alias("y")).where("y is not null")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = z.agg(F.count("*").alias("n"), F.sum("y").alias("sy"), *[F.sum(f"z{i}").alias(f"s{i}") for i in range(k)], *[F.sum(F.col(f"z{i}") * F.col("y")).alias(f"t{i}") for i in range(k)], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"g{i}_{j}") for i, j in pairs]).first()
    a, b = np.zeros((k + 1, k + 1)), np.zeros(k + 1)
    for i, j in pairs:
        a[i, j] = a[j, i] = row[f"g{i}_{j}"]
    for i in range(k):
        a[i, k] = a[k, i] = row[f"s{i}"]
        a[i, i] += penalty
        b[i] = row[f"t{i}"]
    a[k, k], b[k] = row["n"], row["sy"]
    w = np.linalg.solve(a, b)
    return w[:k], float(w[k])


def linear_score(features: dict[str, Column], weights, intercept: float) -> Column:
    """The model as one column expression, so that scoring stays in generated code."""
    total = F.lit(float(intercept))
    for c, w in zip(features.values(), weights, strict=True):
        total = total + c * F.lit(float(w))
    return total


def contributions(features: dict[str, Column], weights) -> dict[str, Column]:
    return {n: c * F.lit(float(w)) for (n, c), w in zip(features.items(), weights, strict=True)}


def rolling_folds(years: list[int], least_training: int = 2) -> list[tuple[int, int, int]]:
    """(last training year, calibration year, test year), the training part expanding."""
    years = sorted(years)
    return [(years[i - 2], years[i - 1], years[i]) for i in range(least_training + 1, len(years))]


def fold_rows(rows: DataFrame, folds: list[tuple[int, int, int]], year: str = "year", target_date: str = "target_date") -> DataFrame:
    """Rows with test_year and part (train, calibrate, test), purged: no row whose target lies in a later part."""
    parts = F.array(*[F.struct(F.lit(test).alias("test_year"), F.lit(train).alias("train"), F.lit(cal).alias("cal")) for train, cal, test in folds])
    x = rows.withColumn("_f", F.explode(parts)).select(*rows.columns, "_f.*")
    y, end = F.col(year), F.year(F.col(target_date))
    part = F.when((y <= F.col("train")) & (end < F.col("cal")), "train").when((y == F.col("cal")) & (end < F.col("test_year")), "calibrate").when(y == F.col("test_year"), "test")
    return x.withColumn("part", part).where("part is not null").drop("train", "cal")


def missing_classes(parts: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """(test_year, part, n, missing): rows of each part and the classes it lacks, comma-joined."""
    have = parts.groupBy("test_year", "part").agg(F.count("*").alias("n"), F.collect_set(label).alias("have"))
    return have.select("test_year", "part", "n", F.array_join(F.array_except(F.array(*map(F.lit, classes)), "have"), ",").alias("missing"))


def require_classes(parts: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """The parts; a fold's part that lacks a class is an error of the read."""
    said = F.concat(F.lit("fold "), F.col("test_year").cast("string"), F.lit(" "), "part", F.lit(" lacks "), "missing")
    whole = missing_classes(parts, label, classes).select("test_year", "part", F.when(F.col("missing") != "", F.raise_error(said).cast("boolean")).otherwise(True).alias("_whole"))
    return parts.join(F.broadcast(whole), ["test_year", "part"]).where("_whole").drop("_whole")  # three rows a fold


def temperature(rows: DataFrame, logit: str, y: str, candidates: int = 73) -> DataFrame:
    """(temperature, loss): the best of a logarithmic grid from 1/4 to 4 by log-loss, 1 included, in one pass."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in np.exp(np.linspace(np.log(0.25), np.log(4), candidates))]))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col(logit) / F.col("temperature")))))
    least = F.lit(1e-12)
    loss = -F.avg(F.col(y) * F.ln(F.greatest(p, least)) + (1 - F.col(y)) * F.ln(F.greatest(1 - p, least)))
    by = rows.select(logit, y, grid.alias("temperature")).groupBy("temperature").agg(loss.alias("loss"))
    return by.agg(F.min(F.struct("loss", "temperature")).alias("b")).select("b.temperature", "b.loss")


def platt(rows: DataFrame, logit: str, y: str, steps: int = 25) -> tuple[float, float]:
    """(slope, intercept) by damped Newton steps; each step is one aggregation, with a ridge towards slope 1."""
    slope, shift = 1.0, 0.0
    rows = rows.select(logit, y).persist()  # two numbers a row, read once a step; lost blocks are computed anew
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(F.col(logit) * slope + shift)))
        v = p * (1 - p)
        g = rows.agg(F.sum((p - F.col(y)) * F.col(logit)).alias("gs"), F.sum(p - F.col(y)).alias("gi"), F.sum(v * F.col(logit) ** 2).alias("ss"), F.sum(v * F.col(logit)).alias("si"), F.sum(v).alias("ii")).first()
        if g["ii"] is None:
            break
        h = np.array([[g["ss"] + 1e-6, g["si"]], [g["si"], g["ii"] + 1e-6]])
        step = np.linalg.solve(h, np.array([g["gs"] + 1e-6 * (slope - 1), g["gi"]]))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        slope, shift = max(0.01, slope - step[0]), shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    rows.unpersist()
    return float(slope), float(shift)


def logistic(rows: DataFrame, features: dict[str, Column], label: str, penalty: float = 1e-3, family: str = "auto"):
    """A logistic model of all rows by Spark's distributed optimiser; labels are 0, 1, ... as doubles."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    z = rows.select(*[c.alias(f"z{i}") for i, c in enumerate(features.values())], F.col(label).cast("double").alias("label")).dropna()
    wide = VectorAssembler(inputCols=[f"z{i}" for i in range(len(features))], outputCol="features").transform(z)
    return LogisticRegression(regParam=penalty, maxIter=60, family=family, standardization=False).fit(wide.select("features", "label"))


def stable_seed(base: int, *parts: str) -> int:
    import hashlib

    return (base + int.from_bytes(hashlib.sha256("|".join(parts).encode()).digest()[:4], "big")) % (2**32 - 1)


def block_bootstrap(series: DataFrame, key: str, order: str, value: str, iterations: int = 1000, block: int = 3, seed: int = 42) -> DataFrame:
    """(key, n, mean, low, high): circular moving-block bootstrap of each key's mean, 95 % interval.

    A group is a series of monthly means, a few hundred numbers.
    """
    import pyarrow as pa

    def one(group: pa.Table) -> pa.Table:
        name = group["k"][0].as_py()
        x = np.array([v for _, v in sorted(zip(group["o"].to_pylist(), group["v"].to_pylist(), strict=True)) if v is not None])
        low = high = None
        if len(x):
            random = np.random.default_rng(stable_seed(seed, str(name)))
            need = -(-len(x) // block)
            starts = random.integers(0, len(x), (iterations, need))
            at = (starts[:, :, None] + np.arange(block)) % len(x)
            means = x[at.reshape(iterations, -1)[:, : len(x)]].mean(1)
            low, high = (float(v) for v in np.quantile(means, (0.025, 0.975)))
        return pa.table({"key": pa.array([name], pa.string()), "n": pa.array([len(x)], pa.int64()), "mean": pa.array([float(x.mean()) if len(x) else None], pa.float64()), "low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64())})

    slim = series.select(F.col(key).cast("string").alias("k"), F.col(order).cast("string").alias("o"), F.col(value).cast("double").alias("v"))
    return slim.groupBy("k").applyInArrow(one, "key string, n long, mean double, low double, high double")
