"""Exact quantiles of large groups without a group's values in one task's memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Items of the sketch that brackets each quantile, and the share of rows that a bracket keeps on either side.
ACCURACY = 10_000
MARGIN = 5e-4


def count_up_to(edges: Column, value: Column, most: int) -> Column:
    """How many of the sorted ``edges``, ``most`` at most, are no higher than ``value``: a bisection, one comparison for each power of two."""
    steps = F.array(*[F.lit(1 << i) for i in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= F.size(edges)) & (F.get(edges, low + step - 1) <= value), low + step).otherwise(low))


def exact_quantiles(rows: DataFrame, value: str, probs: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, q): the interpolated quantiles of each group, as an array in the order of ``probs``.

    A sketch of bounded size brackets each quantile. The brackets' ends part the values into ranges
    and single points; a row finds its own by one bisection, is counted there, and only values
    inside a bracket, some thousandth of all for each quantile, are told apart and put in order by a
    window, which spills. Should a bracket miss its rank the query fails rather than tell a wrong
    number. Nulls and NaN take no part; a group without values has no row, and without ``by`` the one row
    is an empty array then. The brackets, a row per group, are broadcast: groups are features, labels
    or years.
    """
    v = F.col(value).cast("double")
    x = rows.where(v.isNotNull() & ~F.isnan(v)).select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], v.alias("_v"))
    keys = [f"_b{i}" for i in range(len(by))]
    sketched = [min(1.0, max(0.0, p + s)) for p in probs for s in (-MARGIN, MARGIN)]
    sketch = x.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", sketched, ACCURACY).alias("_e"))
    pairs = F.array(*[F.struct(F.get("_e", F.lit(2 * i)).alias("low"), F.get("_e", F.lit(2 * i + 1)).alias("high")) for i in range(len(probs))])
    ends = sketch.select(*[F.col(k).alias(f"{k}_") for k in keys], "_n", F.array_sort(F.array_distinct("_e")).alias("_ends"), pairs.alias("_pairs"))
    between = lambda j: F.exists("_pairs", lambda b: (b["low"] <= F.get("_ends", j - 1)) & (b["high"] >= F.get("_ends", j)))
    ends = ends.withColumn("_inside", F.transform(F.sequence(F.lit(0), F.size("_ends")), lambda j: F.coalesce(between(j), F.lit(False)))).drop("_pairs")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    met = x.join(F.broadcast(ends), same) if keys else x.crossJoin(F.broadcast(ends))
    placed = met.withColumn("_low", count_up_to(F.col("_ends"), F.col("_v"), len(sketched)))
    # even numbers are the ranges between ends, odd ones the ends themselves
    point = F.coalesce(F.get("_ends", F.col("_low") - 1) == F.col("_v"), F.lit(False))
    placed = placed.withColumn("_range", 2 * F.col("_low") - F.when(point, 1).otherwise(0)).withColumn("_at", F.when(~point & F.get("_inside", F.col("_low")), F.col("_v")))
    cells = placed.groupBy(*keys, "_n", "_range", "_at").agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    cells = cells.withColumn("_end", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_range", "_at").rowsBetween(Window.unboundedPreceding, 0)))
    asked = F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]), lambda t: F.struct(t["i"].alias("i"), (t["p"] * (F.col("_n") - 1)).alias("place")))
    here = lambda k: (k >= F.col("_end") - F.col("_c")) & (k < F.col("_end"))
    hit = cells.select(*keys, "_range", "_at", "_c", "_least", "_most", "_end", F.explode(F.filter(asked, lambda t: here(F.floor(t["place"])) | here(F.ceil(t["place"])))).alias("_t"))

    def ranked(k: Column) -> Column:
        alone = F.col("_at").isNotNull() | (F.col("_least") == F.col("_most"))
        known = F.when(alone | (k == F.col("_end") - F.col("_c")), F.col("_least")).when(k == F.col("_end") - 1, F.col("_most")).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")))
        return F.max(F.when(here(k), known))

    place = F.col("_t.place")
    found = hit.groupBy(*keys, F.col("_t.i").alias("_i"), place.alias("_place")).agg(ranked(F.floor(place)).alias("_a"), ranked(F.ceil(place)).alias("_z"))
    q = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_place") - F.floor("_place"))
    whole = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", q.alias("_q")))).alias("_all"))
    return whole.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], F.col("_all._q").alias("q"))
