"""Queries of the fold grid and the final models (M12, O04, M24): ridge models of single features and pairs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tidepanel.operators import folds as G
from tidepanel.plans.adapter import CTES, with_ctes
from tidepanel.plans.core import query
from tidepanel.plans.feature_queries import r, rq
from tidepanel.plans.model_queries import NAMES, training

PENALTY = 5.0
CANDIDATES = [*((n, [n]) for n in NAMES), *(("+".join(p), list(p)) for p in combinations(NAMES, 2))]


def candidates(spark):
    return spark.createDataFrame([(name, used, PENALTY) for name, used in CANDIDATES], "candidate string, features array<string>, penalty double")


def by_year(spark, d):
    """The training rows' moments; a security's market is told by its number."""
    market = F.when(F.col("stock_id").cast("int") % 2 == 0, "even").otherwise("odd")
    return G.moments(training(spark, d).withColumn("market", market), NAMES)


def _fit(name: str, used: list[str], rows: str, by: str) -> str:
    """The ridge solution of one or two standardised features in closed form: weights on the features' scale, and the intercept."""
    a, b = used[0], used[-1]
    moments = f"SELECT {by}, count(*)::DOUBLE AS n, avg({a}) AS ma, avg({b}) AS mb, avg(target) AS mt, stddev_pop({a}) AS sa, stddev_pop({b}) AS sb, corr({a}, {b}) AS r, covar_pop({a}, target) / stddev_pop({a}) AS ca, covar_pop({b}, target) / stddev_pop({b}) AS cb FROM {rows} GROUP BY {by}"
    if len(used) == 1:
        solved = f"SELECT *, n * ca / (n + {PENALTY}) / sa AS wa, 0.0::DOUBLE AS wb FROM ({moments})"
    else:
        det = f"((n + {PENALTY}) ** 2 - (n * r) ** 2)"
        solved = f"SELECT *, (n * ca * (n + {PENALTY}) - n * cb * n * r) / {det} / sa AS wa, (n * cb * (n + {PENALTY}) - n * ca * n * r) / {det} / sb AS wb FROM ({moments})"
    return f"SELECT '{name}' AS candidate, '{a}' AS a, '{b}' AS b, {by}, wa, wb, mt - wa * ma - wb * mb AS intercept FROM ({solved})"


CTES["marked"] = (("training",), "SELECT *, CASE WHEN stock_id::INTEGER % 2 = 0 THEN 'even' ELSE 'odd' END AS market FROM training")
CTES["folds"] = (("marked",), "SELECT * FROM (SELECT market, year AS train, lead(year, 1) OVER w AS cal, lead(year, 2) OVER w AS test_year, row_number() OVER w AS k FROM (SELECT DISTINCT market, year FROM marked) WINDOW w AS (PARTITION BY market ORDER BY year)) WHERE k >= 2 AND test_year IS NOT NULL")
CTES["trained"] = (("marked", "folds"), "SELECT m.*, f.test_year FROM marked m JOIN folds f ON f.market = m.market AND m.year <= f.train AND year(m.target_date) < f.cal")
CTES["judged"] = (("marked", "folds"), "SELECT m.*, f.test_year, 'calibrate' AS part FROM marked m JOIN folds f ON f.market = m.market AND m.year = f.cal AND year(m.target_date) < f.test_year UNION ALL SELECT m.*, f.test_year, 'test' FROM marked m JOIN folds f ON f.market = m.market AND m.year = f.test_year")
CTES["fitted"] = (("trained",), " UNION ALL ".join(_fit(n, u, "trained", "market, test_year") for n, u in CANDIDATES))
_FEATURE = lambda side: "CASE " + " ".join(f"WHEN f.{side} = '{n}' THEN j.{n}" for n in NAMES) + " END"


@query(
    "m12_o04_fold_grid",
    with_ctes(("fitted", "judged", "trained"), f""", p AS (SELECT f.market, f.candidate, f.test_year, f.intercept, f.wa, f.wb, j.part, j.target AS y, f.intercept + f.wa * {_FEATURE('a')} + f.wb * {_FEATURE('b')} AS s
  FROM fitted f JOIN judged j ON j.market = f.market AND j.test_year = f.test_year),
m AS (SELECT market, candidate, test_year, part, count(*) AS n, 1 - sum((y - s) ** 2) / (var_pop(y) * count(*)) AS r2, corr(y, s) AS c FROM p GROUP BY 1, 2, 3, 4),
t AS (SELECT market, test_year, count(*) AS n FROM trained GROUP BY 1, 2)
SELECT f.market, f.candidate, f.test_year, t.n AS train_rows, c.n AS calibrate_rows, e.n AS test_rows, {rq('f.intercept', 'intercept', 9)}, {rq('f.wa', 'first_weight', 9)}, {rq('c.r2', 'calibrate_r2', 9)}, {rq('e.r2', 'test_r2', 9)}, {rq('e.c', 'test_correlation', 9)}
FROM fitted f JOIN t USING (market, test_year) LEFT JOIN m c ON c.part = 'calibrate' AND c.market = f.market AND c.candidate = f.candidate AND c.test_year = f.test_year LEFT JOIN m e ON e.part = 'test' AND e.market = f.market AND e.candidate = f.candidate AND e.test_year = f.test_year"""),
)
def m12(spark, d):
    """Each market's candidates over expanding, purged folds, from one pass over the training rows."""
    done = G.grid(G.fold_moments(by_year(spark, d)), candidates(spark), NAMES)
    first = F.element_at("weights", F.split("candidate", r"\+")[0])
    return done.select(
        "market", "candidate", "test_year", F.col("train.rows").alias("train_rows"), F.col("calibrate.rows").alias("calibrate_rows"), F.col("test.rows").alias("test_rows"),
        r(F.col("intercept"), "intercept", 9), r(first, "first_weight", 9), r(F.col("calibrate.r2"), "calibrate_r2", 9), r(F.col("test.r2"), "test_r2", 9), r(F.col("test.correlation"), "test_correlation", 9),
    )


_FINAL = " UNION ALL ".join(_fit(n, u, "marked", "market") for n, u in CANDIDATES)


@query("m24_final_models", with_ctes(("marked",), f"""SELECT market, candidate, feature, {rq('weight', 'weight', 9)}, {rq('intercept', 'intercept', 9)} FROM (SELECT market, candidate, a AS feature, wa AS weight, intercept FROM ({_FINAL}) UNION ALL SELECT market, candidate, b, wb, intercept FROM ({_FINAL}) WHERE a <> b)"""))
def m24(spark, d):
    """Weights of each market's candidates fitted on all years."""
    made = G.final_models(by_year(spark, d), candidates(spark), NAMES)
    return made.select("market", "candidate", F.explode("weights").alias("feature", "weight"), "intercept").select("market", "candidate", "feature", r(F.col("weight"), "weight", 9), r(F.col("intercept"), "intercept", 9))
