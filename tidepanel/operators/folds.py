"""Ridge models by fold from moments: the rows are read once, whatever the number of folds and candidates.

The moments of (1, features, target) by year are sums, so an expanding training window is a running
sum of them, standardisation is algebra on them, and so are the errors of a linear model on any
part. A grid cell is one market, candidate and fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.sources.tables import path_exists

PARTS = ("train", "calibrate", "test")
CELL = ["market", "candidate", "test_year"]
_MEASURES = "struct<rows: bigint, r2: double, correlation: double>"
RESULT = f"market string, candidate string, test_year int, weights map<string, double>, intercept double, {', '.join(f'{p} {_MEASURES}' for p in PARTS)}, error string"


def moments(rows: DataFrame, names: list[str], target: str = "target") -> DataFrame:
    """(market, year, target_year, place, value): sums of products of (1, features, target), by the year of a row and of its target.

    Each task adds up its own rows by matrix products; what is shuffled is a matrix per task and
    pair of years. Rows with a null or not a number among these columns don't count.
    """
    size = len(names) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            market, year, ends = (batch.column(i).to_pylist() for i in range(3))
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(3, batch.num_columns))])
            keys = list(zip(market, year, ends, strict=True))
            whole = np.isfinite(x).all(1)
            for key in {k for k, ok in zip(keys, whole, strict=True) if ok}:
                mine = x[[i for i, k in enumerate(keys) if k == key and whole[i]]]
                sums[key] = sums.get(key, 0) + mine.T @ mine
        for (market, year, end), m in sums.items():
            yield pa.RecordBatch.from_pydict({"market": pa.array([market] * size * size, pa.string()), "year": pa.array([year] * size * size, pa.int32()), "target_year": pa.array([end] * size * size, pa.int32()), "place": pa.array(np.arange(size * size), pa.int32()), "value": m.ravel()})

    slim = rows.select(F.col("market").cast("string"), F.col("year").cast("int"), F.year("target_date").alias("target_year"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate([*names, target])]).where("year is not null and target_year is not null")
    parts = slim.mapInArrow(run, "market string, year int, target_year int, place int, value double")
    return parts.groupBy("market", "year", "target_year", "place").agg(F.sum("value").alias("value"))


def fold_moments(by_year: DataFrame, least_training: int = 2) -> DataFrame:
    """(market, test_year, train, calibrate, test): each fold's parts as sums, purged: no row counts whose target ends in a later part.

    A fold needs ``least_training`` years of rows before its calibration year. The training part is
    a running sum over the years in which targets end. A group is one market's moments: a matrix for each pair
    of years, however many rows there are.
    """

    def one(group: pa.Table) -> pa.Table:
        pairs: dict[tuple[int, int], np.ndarray] = {}
        size = max(group["place"].to_pylist()) + 1
        for year, end, place, value in zip(*(group[c].to_pylist() for c in ("year", "target_year", "place", "value")), strict=True):
            pairs.setdefault((year, end), np.zeros(size))[place] = value
        years, ends = sorted({y for y, _ in pairs}), sorted({e for _, e in pairs})
        running = np.cumsum([sum(m for (_, e), m in pairs.items() if e == end) for end in ends], 0)
        out = []
        for cal, test in list(zip(years, years[1:], strict=False))[least_training:]:
            before = [i for i, end in enumerate(ends) if end < cal]
            of = {"train": running[before[-1]] if before else None, "calibrate": [m for (y, e), m in pairs.items() if y == cal and e < test], "test": [m for (y, _), m in pairs.items() if y == test]}
            out.append({"market": group["market"][0].as_py(), "test_year": test, "train": None if of["train"] is None else of["train"].tolist(), **{p: sum(of[p]).tolist() if of[p] else None for p in PARTS[1:]}})
        return pa.Table.from_pylist(out, schema=pa.schema([("market", pa.string()), ("test_year", pa.int32()), *((p, pa.list_(pa.float64())) for p in PARTS)]))

    return by_year.groupBy("market").applyInArrow(one, f"market string, test_year int, {', '.join(f'{p} array<double>' for p in PARTS)}")


def solved(m: np.ndarray, used: list[int], penalty: float) -> tuple[np.ndarray, float]:
    """(weights, intercept) on the features' own scale: ridge on standardised features, the intercept free."""
    n, mean = m[0, 0], m[0] / m[0, 0]
    if n < len(used) + 1:
        raise ValueError(f"{int(n)} rows for {len(used)} features")
    centred = m - n * np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(centred)[used] / n, 0))
    std = np.where(std >= 1e-8, std, 1.0)
    gram = centred[np.ix_(used, used)] / np.outer(std, std) + penalty * np.eye(len(used))
    w = np.linalg.solve(gram, centred[used, -1] / std) / std
    return w, float(mean[-1] - w @ mean[used])


def measured(m: np.ndarray | None, used: list[int], w: np.ndarray, b: float) -> dict | None:
    """Rows, r2 and correlation of the linear scores in a part, from its moments alone."""
    if m is None or m[0, 0] < 1:
        return None
    n, v = m[0, 0], np.r_[b, w]
    at = [0, *used]
    xx, xy, yy, sy = m[np.ix_(at, at)], m[at, -1], m[-1, -1], m[0, -1]
    total = yy - sy * sy / n
    error = yy - 2 * v @ xy + v @ xx @ v
    sp = v @ m[at, 0]
    spread = v @ xx @ v - sp * sp / n
    return {"rows": int(n), "r2": 1 - error / total if total > 0 else None, "correlation": float((v @ xy - sp * sy / n) / np.sqrt(spread * total)) if spread > 0 and total > 0 else None}


def grid(by_fold: DataFrame, candidates: DataFrame, names: list[str], done: DataFrame | None = None) -> DataFrame:
    """The cells' results: weights by feature, intercept, measures by part, or the error that a cell met.

    ``candidates`` are (candidate, features, penalty). Cells that ``done`` holds are left out. A cell is a
    row of three small matrices, and cells are dealt out over the tasks.
    """
    cells = by_fold.crossJoin(F.broadcast(candidates.select("candidate", "features", F.col("penalty").cast("double").alias("penalty"))))
    if done is not None:
        cells = cells.join(done.select(*CELL).distinct(), CELL, "left_anti")

    def solve(cell: dict) -> dict:
        row = {k: cell[k] for k in CELL} | {"weights": None, "intercept": None, "error": None} | dict.fromkeys(PARTS)
        try:
            parts = {p: None if cell[p] is None else np.array(cell[p]).reshape(len(names) + 2, -1) for p in PARTS}
            if parts["train"] is None:
                raise ValueError("no training rows")
            used = [names.index(f) + 1 for f in cell["features"]]
            w, b = solved(parts["train"], used, cell["penalty"])
            row |= {"weights": list(zip(cell["features"], w.tolist(), strict=True)), "intercept": b}
            row |= {p: measured(parts[p], used, w, b) for p in PARTS}
        except (ValueError, np.linalg.LinAlgError) as e:
            row["error"] = str(e)
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([solve(batch.slice(i, 1).to_pylist()[0])], schema=_SCHEMA)

    return cells.repartition(*CELL).mapInArrow(run, RESULT)


_PART = pa.struct([("rows", pa.int64()), ("r2", pa.float64()), ("correlation", pa.float64())])
_SCHEMA = pa.schema([("market", pa.string()), ("candidate", pa.string()), ("test_year", pa.int32()), ("weights", pa.map_(pa.string(), pa.float64())), ("intercept", pa.float64()), *((p, _PART) for p in PARTS), ("error", pa.string())])


def final_models(by_year: DataFrame, candidates: DataFrame, names: list[str]) -> DataFrame:
    """(market, candidate, weights, intercept, rows, r2, correlation, error) of fits on all years' rows."""
    summed = by_year.groupBy("market", "place").agg(F.sum("value").alias("value"))
    whole = summed.groupBy("market").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda p: p["value"]).alias("train"))
    as_fold = whole.select("market", F.lit(0).alias("test_year"), "train", *[F.lit(None).cast("array<double>").alias(p) for p in PARTS[1:]])
    return grid(as_fold, candidates, names).select("market", "candidate", "weights", "intercept", "train.*", "error")


def run_grid(by_fold: DataFrame, candidates: DataFrame, names: list[str], store: str, again: bool = False) -> DataFrame:
    """Solve what ``store`` (Parquet) doesn't hold yet, append it and give all; ``again`` takes up cells that had met an error.

    Appending is one commit, so a run that is stopped leaves the cells of finished runs only. Of a
    cell that was solved twice the newest result counts.
    """
    spark = by_fold.sparkSession
    held = spark.read.schema(f"{RESULT}, run long").parquet(store) if path_exists(spark, store) else None
    last = _newest(held) if held is not None else None
    done = None if last is None else last.where("error is null") if again else last
    run = 1 if held is None else held.agg(F.coalesce(F.max("run"), F.lit(0)).alias("run")).first()["run"] + 1
    grid(by_fold, candidates, names, done).withColumn("run", F.lit(run).cast("long")).write.mode("append").parquet(store)
    return _newest(spark.read.schema(f"{RESULT}, run long").parquet(store))


def _newest(held: DataFrame) -> DataFrame:
    """A cell's last result; maps can't be compared, so the runs' numbers decide."""
    return held.join(held.groupBy(*CELL).agg(F.max("run").alias("run")), [*CELL, "run"], "left_semi").drop("run")
