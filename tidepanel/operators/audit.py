"""Profiles, duplicate and order checks, correlations and drift of wide feature tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.operators.quantiles import exact_quantiles


def long_form(features: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return features.unpivot(keys, names, "feature", "value")


def profiles(features: DataFrame, names: list[str]) -> DataFrame:
    """A row per feature: counts, moments, extremes, exact quantiles, distinct values and the commonest value's share.

    Nulls, NaN and infinities take no part in the numbers. Values are counted by feature and value
    first, so that neither the distinct values nor a quantile gathers a feature in one task.
    """
    v = F.col("value")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    x, infinite = F.when(ok, v), F.lit(float("inf"))
    long = long_form(features.select(*names).persist(), [], names)  # the features are read four times, only their numbers are kept
    by = long.groupBy("feature").agg(
        F.count("*").alias("rows"), F.count(x).alias("valid"), F.count_if(v.isNull() | F.isnan(v)).alias("missing"), F.count_if(v == infinite).alias("above_all"), F.count_if(v == -infinite).alias("below_all"), F.count_if(x == 0).alias("zeros"),
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"), F.count_if(F.abs(x) > 100).alias("over_100"), F.count_if(F.abs(x) > 1000).alias("over_1000"),
    )
    fine = long.where(ok)
    values = fine.groupBy("feature", "value").agg(F.count("*").alias("c")).groupBy("feature").agg(F.count("*").alias("distinct"), F.max("c").alias("top"))
    q = exact_quantiles(fine, "value", [0.01, 0.5, 0.99], ("feature",)).select("feature", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p01", "p50", "p99"))])
    out = by.join(F.broadcast(values), "feature", "left").join(F.broadcast(q), "feature", "left")  # a row per feature
    return out.withColumn("distinct", F.coalesce("distinct", F.lit(0))).withColumn("top_share", F.try_divide("top", "valid")).drop("top")


class _Moments:
    """Counts, means, squares and products about the means, and equal values of all pairs of columns; entry (i, j) is of i where j is known too."""

    def __init__(self, k: int):
        self.n, self.mean, self.square, self.product, self.equal = (np.zeros((k, k)) for _ in range(5))

    def add(self, x: np.ndarray) -> None:
        """Rows with NaN where unknown. A constant column has no spread at all, whatever its digits."""
        fine = np.isfinite(x)
        x = np.where(fine, x, np.nan)
        known = fine.astype(float)
        low, high = np.where(fine, x, np.inf).min(axis=0), np.where(fine, x, -np.inf).max(axis=0)
        centre = np.where(low < high, np.where(fine, x, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1), np.where(low == high, low, 0.0))
        z = np.where(fine, x - centre, 0.0)
        n, total = known.T @ known, z.T @ known
        off = total / np.maximum(n, 1)
        square, product = (z * z).T @ known - off * total, z.T @ z - off * total.T
        for i in range(x.shape[1]):
            self.equal[i] += (np.abs(x - x[:, i : i + 1]) <= 1e-12).sum(axis=0)
        both = np.maximum(self.n + n, 1)
        apart = np.where(n > 0, np.where(self.n > 0, centre[:, None] + off - self.mean, 0.0), 0.0)
        self.mean = np.where(self.n > 0, self.mean + apart * n / both, centre[:, None] + off)
        self.square += square + apart * apart * self.n * n / both
        self.product += product + apart * apart.T * self.n * n / both
        self.n += n


def correlations(features: DataFrame, names: list[str], least: float = 0.995, rows: int = 100) -> DataFrame:
    """(left, right, corr, n, equal): pairs of features whose correlation is ``least`` or more either way.

    Over the rows where both are finite, at least ``rows`` of them; equal is the share of rows whose
    values agree. A task sums all pairs up from batches of rows by products of matrices, and only
    its row of each pair is shuffled.
    """
    pairs = list(combinations(range(len(names)), 2))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _Moments(len(names))
        with np.errstate(all="ignore"):
            for batch in batches:
                if batch.num_rows:
                    m.add(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        met = [(i, j) for i, j in pairs if m.n[i, j]]
        at = lambda a, turn=False: [float(a[j, i] if turn else a[i, j]) for i, j in met]
        yield pa.RecordBatch.from_pydict({"left": pa.array([names[i] for i, _ in met], pa.string()), "right": pa.array([names[j] for _, j in met], pa.string()), **{c: pa.array(v, pa.float64()) for c, v in {"n": at(m.n), "a": at(m.mean), "b": at(m.mean, True), "aa": at(m.square), "bb": at(m.square, True), "ab": at(m.product), "same": at(m.equal)}.items()}})

    numbers = features.select(*[F.col(n).cast("double").alias(n) for n in names])
    parts = numbers.mapInArrow(summed, "left string, right string, n double, a double, b double, aa double, bb double, ab double, same double")
    # means as distances from the pair's least, so that equal means are no distance apart
    pair = Window.partitionBy("left", "right")
    parts = parts.withColumns({c: F.col(c) - F.min(c).over(pair) for c in ("a", "b")})
    n, s = F.sum("n"), lambda e: F.sum(F.expr(e))
    t = parts.groupBy("left", "right").agg(
        n.alias("n"), (s("same") / n).alias("equal"), (s("aa + n * a * a") - s("n * a") * s("n * a") / n).alias("aa"), (s("bb + n * b * b") - s("n * b") * s("n * b") / n).alias("bb"), (s("ab + n * a * b") - s("n * a") * s("n * b") / n).alias("ab")
    )
    t = t.select("left", "right", F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("corr"), F.col("n").cast("long").alias("n"), "equal")
    return t.where((F.abs("corr") >= least) & (F.col("n") >= rows))


def issues(profile: DataFrame, correlated: DataFrame, drift: DataFrame) -> DataFrame:
    """(severity, issue, subject, value): what profiles, correlations and yearly drifts give reason to look at."""

    def issue(severity, name, value, when):
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("issue"), value.cast("double").alias("value")))

    c, name = F.col, F.col("feature")
    bad = [issue("ERROR", label, c(k), c(k) > 0) for label, k in (("missing_count", "missing"), ("positive_infinity_count", "above_all"), ("negative_infinity_count", "below_all"))]
    ranges = [issue("ERROR", label, F.lit(1), name.contains(word) & ((c("least") < low) | (c("most") > 1))) for label, word, low in (("ratio_out_of_range", "buy_day_ratio", 0), ("agreement_out_of_range", "institutional_agreement", -1))]
    flat = [issue("WARN", "constant_feature", c("distinct"), c("distinct") <= 1), issue("WARN", "near_constant_feature", c("top_share"), (c("distinct") > 1) & (c("top_share") >= 0.995))]
    wide = issue("WARN", "extreme_flow_pct_gt_1000", c("over_1000"), name.contains("flow_pct") & (c("over_1000") >= 0.0001 * F.greatest(c("valid"), F.lit(1))))
    own = profile.select(name.alias("subject"), F.explode(F.array_compact(F.array(*bad, *ranges, *flat, wide))).alias("i")).select("i.severity", "i.issue", "subject", "i.value")
    alike = correlated.select(F.lit("WARN").alias("severity"), F.lit("high_feature_correlation").alias("issue"), F.concat_ws("|", "left", "right").alias("subject"), F.abs("corr").alias("value"))
    moved = drift.where("n >= 1000 and abs(drift) >= 2").select(F.lit("WARN").alias("severity"), F.lit("yearly_mean_shift_ge_2std").alias("issue"), F.concat_ws("|", F.col("year").cast("string"), "feature").alias("subject"), F.col("drift").alias("value"))
    return own.unionByName(alike).unionByName(moved)


def yearly_drift(features: DataFrame, names: list[str]) -> DataFrame:
    """(feature, year, n, drift): the year's mean less the whole mean, in whole standard deviations."""
    long = long_form(features, ["year"], names)
    whole = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return long.groupBy("feature", "year").agg(F.count("value").alias("n"), F.avg("value").alias("y")).join(F.broadcast(whole), "feature").select("feature", "year", "n", F.when(F.col("s") > 1e-12, (F.col("y") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).alias("drift"))


def key_audit(rows: DataFrame, keys: list[str], order: str, within: str) -> DataFrame:
    """One row: rows, distinct keys, repeats and order violations of the sequence ``order`` within a group."""
    w = Window.partitionBy(within).orderBy(order)
    late = rows.withColumn("_d", F.col(keys[-1]) < F.lag(keys[-1]).over(w))
    return late.agg(F.count("*").alias("rows"), F.count_distinct(*keys).alias("keys"), (F.count("*") - F.count_distinct(*keys)).alias("repeats"), F.count_if("_d").alias("out_of_order"))


def invalid_counts(rows: DataFrame, checks: dict) -> DataFrame:
    """(check, violations) for named conditions, one pass."""
    one = rows.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    return one.unpivot([], list(checks), "check", "violations")


def metric_table(row: DataFrame) -> DataFrame:
    """One row of scalars as (metric, value) text."""
    return row.select(*[F.col(c).cast("string").alias(c) for c in row.columns]).unpivot([], row.columns, "metric", "value")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
