"""Pruned scans, cross-sections, changing schemas, kept results, and scoring at the read."""

import datetime as dt
import gzip
import random

import pytest
from pyspark.sql import functions as F
from tidepanel.operators import folds
from tidepanel.sources import results, scoring, shards, sinks

ROWS = "market string, year int, date date, stock_id string, feature_status string, liquid boolean, x double"


def sample(spark, extra=()):
    rows = []
    for market in ("a", "b"):
        for year in range(2015, 2024):
            for week in range(0, 50, 5):
                day = dt.date(year, 1, 1) + dt.timedelta(7 * week)
                n = 2 if (market, year) == ("a", 2023) and week > 20 else 6
                rows += [(market, year, day, f"{market}{i}", "ok" if i != 4 else "short", i != 5, float(i + week)) for i in range(n)]
    return spark.createDataFrame([*rows, *extra], ROWS)


def files_read(df):
    """How many files the scans of an executed plan have opened."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return {s.relation().location().rootPaths().head().getName(): s.metrics().apply("numFiles").value() for s in scans if "Scan parquet" in s.nodeName()}


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_cross_section_reads_two_partitions(spark, tmp_path, plain_plans):
    place = str(tmp_path / "t")
    shards.write_shards(sample(spark).repartition(1), place)
    df = shards.stored_cross_section(spark, place, 4)
    got = df.collect()
    dates = {m: max(r["date"] for r in got if r["market"] == m) for m in "ab"}
    assert dates == {"a": dt.date(2023, 5, 21), "b": dt.date(2023, 11, 12)} and len(got) == 8
    assert files_read(df)["rows"] == 2  # of eighteen
    with pytest.raises(Exception, match="no date of the table has 7 usable securities in market"):
        shards.stored_cross_section(spark, place, 7).collect()
    asked = shards.stored_cross_section(spark, place, 4, "2016-01-01").collect()
    assert {r["date"] for r in asked} == {dt.date(2016, 1, 1)}
    frame = shards.research_frame(spark, place, "a", (2016, 2017), sample(spark).select("stock_id", "date", F.lit(1.0).alias("outcome")).distinct())
    assert frame.count() == 2 * 10 * 4
    counted = frame.where("outcome > 0")
    counted.collect()
    assert files_read(counted)["rows"] == 2


def test_cross_section_of_frames(spark):
    got = shards.latest_cross_section(sample(spark), 4).collect()
    assert {(r["market"], r["date"]) for r in got} == {("a", dt.date(2023, 5, 21)), ("b", dt.date(2023, 11, 12))}
    twice = sample(spark, [("b", 2023, dt.date(2023, 11, 12), "b0", "ok", True, 1.0)])
    with pytest.raises(Exception, match="rows repeat b0 2023-11-12"):
        shards.latest_cross_section(twice, 4).collect()
    with pytest.raises(Exception, match="no date of the table"):
        shards.latest_cross_section(sample(spark).where("market = 'a'"), 4, keep=3).collect()


def test_outcomes_over_changing_schemas(spark, tmp_path, plain_plans):
    place = str(tmp_path / "t")
    old = spark.createDataFrame([("1", dt.date(2019, 1, 1), 0.5), ("2", dt.date(2019, 1, 1), 0.6)], "stock_id string, date date, low double")
    new = spark.createDataFrame([("1", dt.date(2021, 1, 1), 0.7, 9.0, "x")], "stock_id string, date date, low double, high40 double, noise string")
    for rows, year in ((old, 2019), (new, 2021), (old, 2020)):
        rows.withColumn("date", F.make_date(F.lit(year), F.lit(1), F.lit(1))).write.parquet(f"{place}/year={year}")
    events = spark.createDataFrame([("1", dt.date(2019, 1, 1)), ("1", dt.date(2021, 1, 1)), ("3", dt.date(2021, 1, 1)), ("1", dt.date(2019, 1, 1))], "stock_id string, date date")
    df = shards.event_outcomes(spark, place, events, ["low"], {"high40": "double", "low40": "double"})
    assert df.columns == ["stock_id", "date", "low", "high40", "low40"]
    assert sorted(map(tuple, df.collect())) == [("1", dt.date(2019, 1, 1), 0.5, None, None), ("1", dt.date(2021, 1, 1), 0.7, 9.0, None)]
    more = spark.createDataFrame([("1", dt.date(2019, 1, 1), 3.0), ("1", dt.date(2021, 1, 1), 4.0)], "stock_id string, date date, high40 double")
    assert sorted(r["high40"] for r in shards.event_outcomes(spark, place, events, ["low"], {"high40": "double"}, more).collect()) == [3.0, 9.0]
    with pytest.raises(ValueError, match="no file of .* has open"):
        shards.event_outcomes(spark, place, events, ["open"], {})
    old.withColumn("date", F.make_date(F.lit(2019), F.lit(1), F.lit(1))).write.mode("append").parquet(f"{place}/year=2019")
    with pytest.raises(Exception, match="rows repeat 1 2019-01-01"):
        shards.event_outcomes(spark, place, events, ["low"], {}).collect()


def test_kept_results(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path / "kept")
    spark.range(5).write.parquet(source)
    built = []

    def build(fail=False):
        built.append(1)
        df = spark.read.parquet(source)
        return df.select(F.when(F.lit(fail), F.raise_error(F.lit("stopped"))).otherwise(F.col("id")).cast("long").alias("id"))

    settings = {"penalty": 0.1, "names": ["a"]}
    with pytest.raises(Exception, match="stopped"):
        results.cached(spark, root, settings, [source], lambda: build(True))
    assert results.cached(spark, root, settings, [source], build).count() == 5 and len(built) == 2
    assert results.cached(spark, root, settings, [source], build).count() == 5 and len(built) == 2
    assert results.cached(spark, root, settings | {"penalty": 0.2}, [source], build).count() == 5 and len(built) == 3
    spark.range(5, 7).write.mode("append").parquet(source)
    assert results.cached(spark, root, settings, [source], build).count() == 7 and len(built) == 4


def test_repairs_resume_by_markers(spark, tmp_path):
    root, seen = str(tmp_path / "r"), []

    def work(keys, broken=()):
        seen.append(sorted(r["stock_id"] for r in keys.collect()))
        return keys.select("stock_id", F.length("stock_id").alias("n"), F.when(F.col("stock_id").isin(*broken), "no file").alias("error"))

    keys = spark.createDataFrame([("1",), ("22",), ("333",)], "stock_id string")
    done = results.repaired(spark, root, keys, "stock_id", "s1", "v1", lambda k: work(k, ("22",)))
    assert sorted(map(tuple, done.select("stock_id", "n").collect())) == [("1", 1), ("333", 3)]
    done = results.repaired(spark, root, keys, "stock_id", "s1", "v1", work)
    assert sorted(r["n"] for r in done.collect()) == [1, 2, 3]
    assert results.repaired(spark, root, keys, "stock_id", "s1", "v1", work).count() == 3
    assert results.repaired(spark, root, keys, "stock_id", "s2", "v1", work).count() == 3
    assert seen == [["1", "22", "333"], ["22"], [], ["1", "22", "333"]]


def test_saved_model_scores_a_file_as_it_is_read(spark, tmp_path):
    rng = random.Random(3)
    rows = [("m", 2020 + i % 2, dt.date(2021, 6, 1), rng.random(), rng.random(), rng.random()) for i in range(200)]
    frame = spark.createDataFrame(rows, "market string, year int, target_date date, x double, y double, target double")
    pick = spark.createDataFrame([("all", ["x", "y"], 1.0)], "candidate string, features array<string>, penalty double")
    fitted = folds.final_models(folds.moments(frame, ["x", "y"]), pick, ["x", "y"]).first()
    sinks.save_model(spark, scoring.model_of(fitted["weights"], fitted["intercept"]), str(tmp_path / "model"))
    model = sinks.load_model(spark, str(tmp_path / "model"))
    source = str(tmp_path / "rows.csv.gz")
    with gzip.open(source, "wt") as f:
        f.write("stock_id,noise,year,x,more,y\n")
        f.writelines(f"{i},text{i},{2019 + i % 3},{i / 10},{i},{'' if i == 7 else i / 7}\n" for i in range(90))
    scored, seen = scoring.score_csv(spark, source, {2020: model, 2021: model}, ["stock_id"])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "noise" not in plan.split("ReadSchema")[1] and "more" not in plan.split("ReadSchema")[1]
    with pytest.raises(ValueError, match="90 rows, not 91"):
        scoring.write_scores(scored, seen, str(tmp_path / "bad"), 91)
    assert not (tmp_path / "bad").exists()
    scored, seen = scoring.score_csv(spark, source, {2020: model, 2021: model}, ["stock_id"])
    assert scoring.write_scores(scored, seen, str(tmp_path / "out"), 90) == 90
    got = {int(r["stock_id"]): r["score"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {i for i in range(90) if i % 3}
    for i, s in got.items():
        assert s is None if i == 7 else abs(s - (fitted["intercept"] + fitted["weights"]["x"] * i / 10 + fitted["weights"]["y"] * i / 7)) < 1e-9
    with pytest.raises(ValueError, match="no column z"):
        scoring.score_csv(spark, source, {2020: {"features": ["z"], "weights": [1.0], "intercept": 0.0}}, ["stock_id"])
