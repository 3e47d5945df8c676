"""Queries of models: preprocessing, ridge, scoring, folds, calibration, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import models as M
from tidepanel.operators.features import flow_share
from tidepanel.operators.ranking import average_rank, daily_spread, day_size
from tidepanel.plans.adapter import CTES, with_ctes
from tidepanel.plans.audit_queries import feats, probs
from tidepanel.plans.core import query
from tidepanel.plans.feature_queries import r, rq
from tidepanel.plans.ranking_queries import ranked, scores

NAMES = ["foreign_net_20", "trust_net_20", "total_net_20"]
#: Weights of a fixed model for scoring queries.
FIXED = {"foreign_net_20": (-50.0, 50.0, 1.5, 20.0, 0.3), "trust_net_20": (-40.0, 60.0, -2.0, 25.0, -0.2), "total_net_20": (-80.0, 80.0, 0.5, 40.0, 0.7)}


def training(spark, d):
    """Features with the rank target in (0, 1]."""
    more = {n: flow_share(n.rpartition("_")[0], int(n.rpartition("_")[2])) for n in NAMES}
    return scores(spark, d, more).select("stock_id", "date", "year", F.date_add("date", 70).alias("target_date"), (average_rank("ret", ["date"]) / day_size("ret")).alias("target"), "ret", *NAMES)


CTES["training"] = (("scores", "feats"), "SELECT s.stock_id, s.date, s.year, s.date + 70 AS target_date, (rank() OVER (PARTITION BY s.date ORDER BY ret) + (count(*) OVER (PARTITION BY s.date, ret) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY s.date) AS target, ret, " + ", ".join(f"f.{n}" for n in NAMES) + " FROM scores s JOIN feats f ON f.stock_id = s.stock_id AND f.date = s.date")


@query("m03_standardiser", with_ctes(("training",), " UNION ALL ".join(f"SELECT '{n}' AS feature, {rq('a', 'low')}, {rq('b', 'high')}, {rq('avg(greatest(a, least(b, ' + n + ')))', 'mean')}, {rq('stddev_pop(greatest(a, least(b, ' + n + ')))', 'std')} FROM training, (SELECT quantile_cont({n}, 0.005) AS a, quantile_cont({n}, 0.995) AS b FROM training) GROUP BY a, b" for n in NAMES)))
def m03(spark, d):
    fitted = M.standardiser(training(spark, d), NAMES)
    return spark.createDataFrame([(n, *map(float, v)) for n, v in fitted.items()], "feature string, low double, high double, mean double, std double").select("feature", *[r(F.col(c), c) for c in ("low", "high", "mean", "std")])


def _z(n: str) -> str:
    low, high, mean, std, _ = FIXED[n]
    return f"((greatest({low}::DOUBLE, least({high}::DOUBLE, {n})) - ({mean}::DOUBLE)) / {std}::DOUBLE)"


_SCORE = "0.5::DOUBLE + " + " + ".join(f"{_z(n)} * ({FIXED[n][4]}::DOUBLE)" for n in NAMES)


def fixed_columns():
    return {n: M.standardised(n, v[:4]) for n, v in FIXED.items()}


@query("m13_linear_scores", with_ctes(("feats",), f"SELECT stock_id, date, {rq(_SCORE, "score", 12)}, " + ", ".join(rq(f"{_z(n)} * ({FIXED[n][4]}::DOUBLE)", f"by_{n}", 12) for n in NAMES) + " FROM feats"))
def m13(spark, d):
    cols, w = fixed_columns(), [v[4] for v in FIXED.values()]
    return feats(spark, d).select("stock_id", "date", r(M.linear_score(cols, w, 0.5), "score", 12), *[r(c, f"by_{n}", 12) for n, c in M.contributions(cols, w).items()])


@query("m14_softmax_index", with_ctes(("feats",), f", s AS (SELECT stock_id, date, {_SCORE} AS u FROM feats) SELECT stock_id, date, {rq('100 * (exp(u - greatest(u, 0.0)) - exp(-u - greatest(u, 0.0))) / (exp(u - greatest(u, 0.0)) + exp(-greatest(u, 0.0)) + exp(-u - greatest(u, 0.0)))', 'score')} FROM s"))
def m14(spark, d):
    u = M.linear_score(fixed_columns(), [v[4] for v in FIXED.values()], 0.5)
    top = F.greatest(F.col("u"), F.lit(0.0))
    e = [F.exp(x - top) for x in (F.col("u"), F.lit(0.0), -F.col("u"))]
    return feats(spark, d).withColumn("u", u).select("stock_id", "date", r(100 * (e[0] - e[2]) / (e[0] + e[1] + e[2]), "score"))


@query("a48_contribution_means", with_ctes(("feats",), f"SELECT year, " + ", ".join(rq(f"avg({_z(n)} * ({FIXED[n][4]}::DOUBLE))", f"by_{n}") for n in NAMES) + " FROM feats GROUP BY 1"))
def a48(spark, d):
    c = M.contributions(fixed_columns(), [v[4] for v in FIXED.values()])
    return feats(spark, d).groupBy("year").agg(*[r(F.avg(x), f"by_{n}") for n, x in c.items()])


@query("m10_m11_purged_folds", with_ctes(("training",), """, f AS (SELECT * FROM (VALUES (1996, 1997, 1998), (1997, 1998, 1999), (1998, 1999, 2000)) v(train, cal, test_year))
SELECT test_year, part, count(*) AS n FROM (SELECT test_year, CASE WHEN year <= train AND year(target_date) < cal THEN 'train' WHEN year = cal AND year(target_date) < test_year THEN 'calibrate' WHEN year = test_year THEN 'test' END AS part FROM training, f) WHERE part IS NOT NULL GROUP BY 1, 2"""))
def m10(spark, d):
    folds = M.rolling_folds([1995, 1996, 1997, 1998, 1999, 2000], 2)
    return M.fold_rows(training(spark, d), folds).groupBy("test_year", "part").agg(F.count("*").alias("n"))


@query("m07_temperature", with_ctes(("probs",), f", t AS (SELECT exp(ln(0.25) + i * (ln(4) - ln(0.25)) / 72) AS t FROM range(0, 73) x(i)), z AS (SELECT y, ln(p / (1 - p)) AS z FROM probs), l AS (SELECT t, round(-avg(y * ln(greatest(1e-12, 1 / (1 + exp(-greatest(-40, least(40, z / t)))))) + (1 - y) * ln(greatest(1e-12, 1 - 1 / (1 + exp(-greatest(-40, least(40, z / t))))))), 9) AS loss FROM z, t GROUP BY 1) SELECT {rq('t', 'temperature')}, {rq('loss', 'loss')} FROM l ORDER BY loss, t LIMIT 1"))
def m07(spark, d):
    z = probs(spark, d).select("y", F.ln(F.col("p") / (1 - F.col("p"))).alias("z"))
    return M.temperature(z, "z", "y").select(r(F.col("temperature"), "temperature"), r(F.col("loss"), "loss"))


@query("m06_ridge_weights")
def m06(spark, d):
    """Weights of the ridge model; a linear system isn't SQL, the tests solve it with numpy."""
    rows = training(spark, d).select("target", *NAMES).persist()  # read three times; lost blocks are made anew
    fitted = M.standardiser(rows, NAMES)
    w, b = M.ridge(rows, {n: M.standardised(n, v) for n, v in fitted.items()}, "target", 1e-3)
    rows.unpersist()
    return spark.createDataFrame([*((n, round(float(x), 9)) for n, x in zip(NAMES, w, strict=True)), ("intercept", round(b, 9))], "feature string, weight double")


@query("m08_platt")
def m08(spark, d):
    """Slope and intercept of the calibration; tested against a plain Newton fit."""
    z = probs(spark, d).select("y", F.ln(F.col("p") / (1 - F.col("p"))).alias("z"))
    slope, shift = M.platt(z, "z", "y")
    return spark.createDataFrame([(round(slope, 9), round(shift, 9))], "slope double, intercept double")


@query("m04_m05_logistic")
def m04(spark, d):
    """Accuracy of a three-way and a two-way logistic model on all rows."""
    rows = training(spark, d).withColumn("direction", F.when(F.col("ret") >= 0.05, 2).when(F.col("ret") <= -0.05, 0).otherwise(1)).withColumn("up", (F.col("ret") > 0).cast("int")).select("direction", "up", *NAMES).persist()
    fitted = M.standardiser(rows, NAMES)
    cols = {n: M.standardised(n, v) for n, v in fitted.items()}
    out = []
    for name, label, family in (("direction", "direction", "multinomial"), ("up", "up", "binomial")):
        model = M.logistic(rows, cols, label, family=family)
        out.append((name, model.numClasses, float(model.summary.accuracy)))
    rows.unpersist()
    return spark.createDataFrame(out, "model string, classes int, accuracy double")


@query("a54_fit_diagnostics", with_ctes(("training",), f", s AS (SELECT target AS y, {_SCORE} AS p FROM training) SELECT {rq('1 - sum((y - p) ** 2) / sum((y - m) ** 2)', 'r2')}, {rq('corr(y, p)', 'correlation')} FROM s, (SELECT avg(y) AS m FROM s)"))
def a54(spark, d):
    s = training(spark, d).select(F.col("target").alias("y"), M.linear_score(fixed_columns(), [v[4] for v in FIXED.values()], 0.5).alias("p"))
    sst = F.var_pop("y") * F.count("*")
    return s.agg(r(1 - F.sum((F.col("y") - F.col("p")) ** 2) / sst, "r2"), r(F.corr("y", "p"), "correlation"))


@query("a21_block_bootstrap")
def a21(spark, d):
    """Intervals of yearly mean spreads from monthly means; numpy's random stream has no SQL counterpart."""
    spread = daily_spread(ranked(spark, d), "pct", "ret", 20)
    monthly = spread.groupBy(F.year("date").alias("year"), F.date_format("date", "yyyy-MM").alias("month")).agg(F.avg("spread").alias("v"))
    return M.block_bootstrap(monthly, "year", "month", "v")


CTES["yearly"] = (("training",), "SELECT year, " + ", ".join(f"corr({n}, target) AS {n}" for n in NAMES) + " FROM training GROUP BY 1")


@query("a31_coefficient_stability", with_ctes(("yearly",), " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) AS years, round(greatest(avg(({n} > 0)::INTEGER), 1 - avg(({n} > 0)::INTEGER)), 6) AS same_sign, {rq(f'min({n})', 'least')}, {rq(f'max({n})', 'most')} FROM yearly" for n in NAMES)))
def a31(spark, d):
    long = training(spark, d).unpivot(["year", "target"], NAMES, "feature", "value").groupBy("feature", "year").agg(F.corr("value", "target").alias("c"))
    up = F.avg((F.col("c") > 0).cast("int"))
    return long.groupBy("feature").agg(F.count("*").alias("years"), F.round(F.greatest(up, 1 - up), 6).alias("same_sign"), r(F.min("c"), "least"), r(F.max("c"), "most"))


@query("a50_incremental_return", with_ctes(("panel",), f"SELECT {rq('avg(m)', 'daily_mean')}, sum(n)::BIGINT AS n FROM (SELECT date, avg((1 + b) / (1 + a) - 1) AS m, count(*) AS n FROM (SELECT date, present, lead(close, 5) OVER w / lead(open, 1) OVER w - 1 AS a, lead(close, 20) OVER w / lead(open, 1) OVER w - 1 AS b FROM panel WINDOW w AS (PARTITION BY stock_id ORDER BY idx)) WHERE present AND a IS NOT NULL AND b IS NOT NULL GROUP BY 1)"))
def a50(spark, d):
    from tidepanel.operators.features import by_date
    from tidepanel.plans.adapter import panel

    at = lambda k: F.lead("close", k).over(by_date()) / F.lead("open", 1).over(by_date()) - 1
    x = panel(spark, d).select("date", "present", at(5).alias("a"), at(20).alias("b")).where("present and a is not null and b is not null")
    m = x.groupBy("date").agg(F.avg((1 + F.col("b")) / (1 + F.col("a")) - 1).alias("m"), F.count("*").alias("n"))
    return m.agg(r(F.avg("m"), "daily_mean"), F.sum("n").alias("n"))
