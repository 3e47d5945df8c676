"""The fold grid against refits of every fold, intervals against days, event histories' plan."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F
from tidepanel.operators import event_history, folds, intervals

NAMES = ["x", "y", "z"]
ROWS = "market string, year int, target_date date, x double, y double, z double, target double"


def samples(seed=1, n=1500):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        day = dt.date(rng.randint(2010, 2016), 1, 1) + dt.timedelta(days=rng.randrange(365))
        v = [rng.gauss(5, 3), rng.gauss(0, 1), rng.gauss(-100, 20)]
        out.append((rng.choice("ab"), day.year, day + dt.timedelta(days=70), *v, 0.2 * v[0] - v[1] + 0.01 * v[2] + rng.gauss(0, 1)))
    return out + [("a", 2012, dt.date(2012, 5, 5), None, 1.0, 1.0, 1.0), ("a", 2012, dt.date(2012, 5, 5), float("nan"), 1.0, 1.0, 1.0), ("a", 2012, None, 1.0, 1.0, 1.0, 1.0)]


def refit(rows, used, penalty):
    x = np.array([[r[3 + NAMES.index(u)] for u in used] for r in rows])
    y = np.array([r[6] for r in rows])
    mean, std = x.mean(0), x.std(0)
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z + penalty * np.eye(len(used)), z.T @ (y - y.mean())) / std
    return w, y.mean() - w @ mean


def score(rows, used, w, b):
    x = np.array([[r[3 + NAMES.index(u)] for u in used] for r in rows])
    y = np.array([r[6] for r in rows])
    p = x @ w + b
    return len(rows), 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), np.corrcoef(y, p)[0, 1]


def candidates(spark, *more):
    return spark.createDataFrame([("all", NAMES, 3.0), ("one", ["y"], 0.5), *more], "candidate string, features array<string>, penalty double")


def test_grid_equals_refits(spark):
    rows = samples()
    by_year = folds.moments(spark.createDataFrame(rows, ROWS).repartition(7), NAMES)
    got = {(r["market"], r["candidate"], r["test_year"]): r for r in folds.grid(folds.fold_moments(by_year), candidates(spark), NAMES).collect()}
    assert {k[2] for k in got} == {2013, 2014, 2015, 2016} and len(got) == 16
    whole = [r for r in rows if r[2] and all(v is not None and v == v for v in r[3:])]
    for (market, name, test), r in got.items():
        used = NAMES if name == "all" else ["y"]
        mine = [x for x in whole if x[0] == market]
        train = [x for x in mine if x[1] <= test - 2 and x[2].year < test - 1]
        w, b = refit(train, used, 3.0 if name == "all" else 0.5)
        assert r["error"] is None and np.allclose([r["weights"][u] for u in used], w) and np.isclose(r["intercept"], b) and r["train"]["rows"] == len(train)
        for part, of in (("calibrate", [x for x in mine if x[1] == test - 1 and x[2].year < test]), ("test", [x for x in mine if x[1] == test])):
            assert np.allclose([r[part]["rows"], r[part]["r2"], r[part]["correlation"]], score(of, used, w, b))


def test_grid_reads_the_rows_once(spark, tmp_path):
    place = str(tmp_path / "rows")
    spark.createDataFrame(samples(), ROWS).write.parquet(place)
    df = folds.grid(folds.fold_moments(folds.moments(spark.read.parquet(place), NAMES)), candidates(spark), NAMES)
    assert df.count() == 16
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan") == 1


def test_grid_resumes_and_keeps_errors(spark, tmp_path, monkeypatch):
    place, store = str(tmp_path / "rows"), str(tmp_path / "grid")
    spark.createDataFrame(samples(2, 400), ROWS).write.parquet(place)
    by_fold = folds.fold_moments(folds.moments(spark.read.parquet(place), NAMES))
    first = folds.run_grid(by_fold, candidates(spark, ("bad", ["absent"], 1.0)), NAMES, store).collect()
    assert {r["candidate"] for r in first if r["error"]} == {"bad"} and all("absent" in r["error"] for r in first if r["error"])
    done = spark.read.schema(f"{folds.RESULT}, run long").parquet(store)
    assert folds.grid(by_fold, candidates(spark, ("bad", ["absent"], 1.0)), NAMES, done).count() == 0
    again = folds.run_grid(by_fold, candidates(spark, ("bad", ["z"], 1.0), ("new", ["x"], 1.0)), NAMES, store, again=True).collect()
    assert len(again) == len(first) // 3 * 4 and not any(r["error"] for r in again)
    assert spark.read.parquet(store).where("run = 2").select("candidate").distinct().count() == 2


def test_final_models(spark):
    rows = [r for r in samples(3, 300) if r[2] and all(v is not None and v == v for v in r[3:])]
    made = {r["market"]: r for r in folds.final_models(folds.moments(spark.createDataFrame(rows, ROWS), NAMES), candidates(spark).where("candidate = 'all'"), NAMES).collect()}
    for market, r in made.items():
        w, b = refit([x for x in rows if x[0] == market], NAMES, 3.0)
        assert np.allclose([r["weights"][u] for u in NAMES], w) and np.isclose(r["intercept"], b)


def test_intervals_equal_days(spark):
    rng, base = random.Random(4), dt.date(2020, 1, 1)
    span = lambda: (lambda a: (base + dt.timedelta(a), base + dt.timedelta(a + rng.randint(-2, 25))))(rng.randint(0, 120))
    have = [(k, *span()) for k in "abc" for _ in range(12)] * 2 + [("a", None, base)]
    asked = [(i, rng.choice("abcd"), *span()) for i in range(40)] + [(99, "a", None, base)]
    schema = "key string, start date, end date"
    days = lambda a, b: {a + dt.timedelta(i) for i in range((b - a).days + 1)}
    covered = {k: set().union(*(days(a, b) for q, a, b in have if q == k and a)) for k in "abcd"}
    frame = spark.createDataFrame(have, schema).repartition(3)
    islands = intervals.covered(frame, ["key"]).collect()
    for k in "abc":
        mine = sorted((r["start"], r["end"]) for r in islands if r["key"] == k)
        assert set().union(*(days(*m) for m in mine)) == covered[k] and all((b[0] - a[1]).days > 1 for a, b in zip(mine, mine[1:], strict=False))
    left = intervals.still_open(spark.createDataFrame(asked, "id long, key string, start date, end date"), frame, ["key"])
    assert left.columns == ["id", "key", "start", "end"]
    got = left.collect()
    for i, k, a, b in asked:
        parts = [days(r["start"], r["end"]) for r in got if r["id"] == i]
        assert set().union(*parts) == (days(a, b) - covered[k] if a else set()) and sum(map(len, parts)) == len(set().union(*parts))
    assert intervals.still_open(spark.createDataFrame([], "key string, start date, end date"), frame, ["key"]).count() == 0


def test_event_history_by_bins(spark):
    rng, base = random.Random(5), dt.date(2021, 1, 1)
    bars = [(s, base + dt.timedelta(i), *(rng.choice([0.0, 1.0, 2.0]) for _ in range(4))) for s in ("1", "2") for i in range(0, 300, 3)]
    events = [(rng.choice(["1", "2", "3"]), base + dt.timedelta(rng.randint(-30, 330))) for _ in range(60)]
    b = spark.createDataFrame(bars, "stock_id string, date date, open double, high double, low double, close double")
    got = event_history.event_history(spark.createDataFrame(events, "stock_id string, event_date date"), b)
    want = sorted((s, e, d, (d - e).days) for s, e in events for q, d, *p in bars if q == s and min(p) > 0 and -60 <= (d - e).days <= 10)
    assert sorted(map(tuple, got.select("stock_id", "event_date", "date", "days").collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "_bin" in plan
