"""Queries of sample rows, model reports, intake checks and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import gates as G
from tidepanel.operators import intake as I
from tidepanel.operators import samples as S
from tidepanel.plans.adapter import CTES, cells, eventful, panel, stock_key, table, with_ctes
from tidepanel.plans.core import query
from tidepanel.plans.feature_queries import _REASON, MONEY, _agree, frame, r, rq, share_sql
from tidepanel.plans.ranking_queries import ranked
from tidepanel.plans.return_queries import _LABEL, returns
from tidepanel.plans.run_queries import runs

_BY = "PARTITION BY stock_id ORDER BY idx"
_SIGNS = ", ".join(f"CASE WHEN sign({net}) = lag(sign({net})) OVER ({_BY}) THEN NULL ELSE idx END AS since_{a}" for a, net in S.ACTORS.items())


def _feature_sql() -> dict[str, str]:
    made: dict[str, str] = {}
    for a, net in S.ACTORS.items():
        made |= {f"{a}_flow_pct_{w}d": share_sql(net, w) for w in (1, 3, 5, 10, 20)}
        made |= {f"{a}_buy_day_ratio_{w}d": f"sum(({net} > 0)::INTEGER) OVER {frame(w)} / {w}.0::DOUBLE" for w in (5, 10, 20)}
        made[f"{a}_streak"] = f"((idx - max(since_{a}) OVER ({_BY} ROWS UNBOUNDED PRECEDING) + 1) * sign({net}))::DOUBLE"
    made |= {f"institutional_agreement_{w}d": _agree(w) for w in (1, 5, 20)}
    return made | {"selected_total_acceleration_5d_vs_20d": share_sql("total_net", 5) + " - " + share_sql("total_net", 20)}


_FEATURES = _feature_sql()
CTES["wide"] = (("liquid",), f"SELECT * FROM (SELECT stock_id, date, present, liquid, entry_ready, {_REASON} AS exclusion, " + ", ".join(f"{e} AS {n}" for n, e in _FEATURES.items()) + f" FROM (SELECT *, {_SIGNS} FROM liquid)) WHERE present")


@query("m01_sample_rows", with_ctes(("wide", "returns5", "returns10", "returns40"), f"SELECT w.stock_id, w.date, exclusion, {', '.join(rq(n, n) for n in _FEATURES)}, " + ", ".join(f"r{h}.status AS status_{h}d, {rq(f'r{h}.adjusted', f'adjusted_{h}d')}, {rq(f'r{h}.lowest', f'lowest_{h}d')}, liquid AND entry_ready AND r{h}.status = 'ok' AS eligible_{h}d" for h in (5, 10, 40)) + f", {_LABEL.replace('adjusted', 'r10.adjusted')} AS label_10d FROM wide w " + " ".join(f"LEFT JOIN returns{h} r{h} ON r{h}.stock_id = w.stock_id AND r{h}.date = w.date" for h in (5, 10, 40))))
def m01(spark, d):
    """Every security and day with a price: all features, the first reason against it and three horizons' labels."""
    s = S.sample_rows(eventful(spark, d), MONEY)
    tail = [c for h in S.HORIZONS for c in (F.col(f"status_{h}d"), r(F.col(f"adjusted_{h}d"), f"adjusted_{h}d"), r(F.col(f"lowest_{h}d"), f"lowest_{h}d"), F.col(f"eligible_{h}d"))]
    return s.select("stock_id", "date", "exclusion", *[r(F.col(n), n) for n in S.feature_names()], *tail, "label_10d")


_ROLES = [("'" + n + "'", "feature") for n in _FEATURES] + [(f"'{n}'", "metadata") for n in ("stock_id", "date", "year")] + [(f"'{n}'", "filter") for n in ("history", "normal_days", "median_money", "zero_run", "liquid", "entry_ready")] + [("'exclusion'", "quality"), ("'label_10d'", "label")]


@query("f22_feature_dictionary", "SELECT c AS \"column\", role, role = 'feature' AS model_input FROM (VALUES " + ", ".join(f"({c}, '{k}')" for c, k in _ROLES) + ") v(c, role) UNION ALL SELECT c || '_' || h || 'd', 'label', false FROM (VALUES ('status'), ('raw'), ('adjusted'), ('highest'), ('lowest'), ('eligible')) x(c), (VALUES (5), (10), (40)) y(h)")
def f22(spark, d):
    return S.dictionary(spark)


@query("m22_market_specs", "SELECT * FROM (VALUES ('tpex', 'core22_l2_1e-3', 22, 0.001::DOUBLE), ('twse', 'full40_l2_1e-3', 40, 0.001::DOUBLE)) v(market, candidate_id, features, l2_penalty)")
def m22(spark, d):
    specs = [S.market_spec(m) for m in ("tpex", "TWSE")]
    return spark.createDataFrame([(s["market"], s["candidate_id"], len(s["features"]), s["l2_penalty"]) for s in specs], "market string, candidate_id string, features int, l2_penalty double")


# Fold summaries of three rules on two markets a year, for the choice of a candidate.
_FOLD = "SELECT CASE WHEN stock_id::BIGINT % 2 = 0 THEN 'tpex' ELSE 'twse' END AS market, 'rule_' || (idx % 3) AS candidate_id, year, count(*) AS test_rows, round(avg(ret) FILTER (WHERE pct > 60) - avg(ret) FILTER (WHERE pct <= 40), 9) AS spread, round(avg(abs(ret)), 9) AS raw, round(avg(abs(ret - 0.01)), 9) AS temperature, round(avg(abs(ret + 0.01)), 9) AS prior_blend, round(avg(abs(ret - 0.005)), 9) AS history FROM ranked GROUP BY 1, 2, 3 HAVING spread IS NOT NULL"
CTES["folds"] = (("ranked",), _FOLD)


def folds(spark, d):
    s = ranked(spark, d).withColumn("market", F.when(F.col("stock_id").cast("long") % 2 == 0, "tpex").otherwise("twse")).withColumn("candidate_id", F.concat(F.lit("rule_"), (F.col("idx") % 3).cast("string")))
    loss = lambda by, name: F.round(F.avg(F.abs(F.col("ret") + by)), 9).alias(name)
    spread = F.round(F.avg(F.when(F.col("pct") > 60, F.col("ret"))) - F.avg(F.when(F.col("pct") <= 40, F.col("ret"))), 9)
    return s.groupBy("market", "candidate_id", "year").agg(F.count("*").alias("test_rows"), spread.alias("spread"), loss(0.0, "raw"), loss(-0.01, "temperature"), loss(0.01, "prior_blend"), loss(-0.005, "history")).where("spread is not null")


@query("m20_selected_candidates", with_ctes(("folds",), f""", a AS (SELECT market, candidate_id, count(*) FILTER (WHERE spread > 0) AS positive_years, count(*) AS years, median(spread) AS middle, sum(spread * test_rows) / sum(test_rows) AS weighted,
  sum(raw * test_rows) / sum(test_rows) AS raw, sum(temperature * test_rows) / sum(test_rows) AS temperature, sum(prior_blend * test_rows) / sum(test_rows) AS prior_blend, sum(history * test_rows) / sum(test_rows) AS history FROM folds GROUP BY 1, 2),
b AS (SELECT *, positive_years >= greatest(1, ceil(years * 0.75)) AND middle > 0 AND weighted > 0 AS supported, CASE WHEN prior_blend <= least(raw, temperature) THEN 'prior_blend' WHEN raw <= temperature THEN 'raw' ELSE 'temperature' END AS variant FROM a)
SELECT market, candidate_id, supported, positive_years, {rq('middle', 'median_spread')}, {rq('weighted', 'weighted_spread')}, variant FROM b QUALIFY row_number() OVER (PARTITION BY market ORDER BY supported DESC, positive_years DESC, round(middle, 9) DESC, round(weighted, 9) DESC, round(history - raw, 9) DESC, candidate_id) = 1"""))
def m20(spark, d):
    c = G.selected_candidates(folds(spark, d), ["raw", "temperature", "prior_blend"], "history")
    return c.select("market", "candidate_id", "supported", "positive_years", r(F.col("median_spread"), "median_spread"), r(F.col("weighted_spread"), "weighted_spread"), "variant")


_CLASSES = ("DOWN", "FLAT", "UP")


def _models(spark, d):
    """A three-way model of four features for each year and customer segment, its numbers made of counts of orders."""
    o = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("market")).agg(F.count("*").alias("n"))
    w = lambda i: F.array(*[F.round(F.sin(F.col("n") + i * 5 + j), 9) for j in range(4)])
    return o.select("market", "year", F.array(*map(F.lit, _CLASSES)).alias("classes"), F.array(*map(F.lit, S.feature_names()[:4])).alias("features"), F.array(*[F.round(F.cos(F.col("n") + i), 9) for i in range(3)]).alias("intercepts"), F.array(*[w(i) for i in range(3)]).alias("weights"))


_NAMES = "['(intercept)', 'foreign_flow_pct_1d', 'foreign_flow_pct_3d', 'foreign_flow_pct_5d', 'foreign_flow_pct_10d']"
CTES["coefficients"] = ((), f"SELECT o_orderstatus AS market, year(o_orderdate)::INTEGER AS year, ['DOWN', 'FLAT', 'UP'][i + 1] AS class, {_NAMES}[j + 1] AS feature, CASE j WHEN 0 THEN round(cos(count(*) + i), 9) ELSE round(sin(count(*) + i * 5 + j - 1), 9) END AS value FROM orders, range(3) x(i), range(5) y(j) GROUP BY 1, 2, i, j")


@query("m21_coefficient_report", with_ctes(("coefficients",), f"SELECT market, year, class, feature, {rq('value', 'value')} FROM coefficients UNION ALL SELECT market, year, 'UP_MINUS_DOWN', feature, {rq('u.value - d.value', 'value')} FROM (FROM coefficients WHERE class = 'UP') u JOIN (FROM coefficients WHERE class = 'DOWN') d USING (market, year, feature)"))
def m21(spark, d):
    return S.coefficient_report(_models(spark, d)).select("market", "year", "class", "feature", r(F.col("value"), "value"))


@query("s26_models_from_report", with_ctes(("coefficients",), f"SELECT market, year, class, {rq('''max(value) FILTER (WHERE feature = '(intercept)')''', 'intercept')}, {rq('''sum(value) FILTER (WHERE feature <> '(intercept)')''', 'total')}, count(*) FILTER (WHERE feature <> '(intercept)') AS features FROM coefficients GROUP BY 1, 2, 3"))
def s26(spark, d):
    m = S.models_from_report(S.coefficient_report(_models(spark, d)))
    values = F.map_values("weights")
    return m.select("market", "year", "class", r(F.col("intercept"), "intercept"), r(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), "total"), F.size(values).cast("long").alias("features"))


@query("x13_label_repair", with_ctes(("returns10",), f"SELECT stock_id, year(date)::INTEGER AS year, {_LABEL} AS label, count(*) AS n, count(*) FILTER (WHERE (CASE WHEN adjusted >= 0.04 THEN 'UP' WHEN adjusted <= -0.05 THEN 'DOWN' WHEN adjusted IS NOT NULL THEN 'FLAT' END) IS DISTINCT FROM {_LABEL}) AS changed FROM returns10 GROUP BY 1, 2, 3"))
def x13(spark, d):
    """Labels made with a bound of 0.04 instead of 0.05, put right, and what that changed."""
    a = F.col("adjusted")
    old = returns(spark, d, 10).select("stock_id", F.year("date").alias("year"), "adjusted", F.col("label").alias("right"), F.when(a >= 0.04, "UP").when(a <= -0.05, "DOWN").when(a.isNotNull(), "FLAT").alias("label"))
    return S.repaired_labels(old, "label", F.col("right")).groupBy("stock_id", "year", "label").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


_CODE = "CASE WHEN stock_id::BIGINT < 10000 THEN lpad((stock_id::BIGINT)::VARCHAR, 4, '0') ELSE stock_id END"


@query("f19_daily_merge", with_ctes(("cells",), f"SELECT {_CODE} AS stock_id, date, volume, total_net FROM (SELECT *, foreign_net + trust_net + dealer_net AS total_net FROM cells) WHERE stock_id::BIGINT < 10000 AND stock_id::BIGINT % 5 <> 0 AND stock_id::BIGINT % 7 <> 0"))
def f19(spark, d):
    """Every week's quotes and flows; one in seven securities has no flows, one in five is not in the universe."""
    k = F.col("stock_id").cast("long")
    code = lambda n, longer: F.when(n < 10000, F.lpad(n.cast("string"), 4, "0")).otherwise(longer)  # noqa: E731  lpad cuts longer keys
    c = cells(spark, d).withColumn("k", k).withColumn("stock_id", code(k, F.col("stock_id")))
    universe = table(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(code(F.col("s_suppkey"), stock_key("s_suppkey")).alias("stock_id"))
    flows = c.where("k % 7 <> 0").select("stock_id", "date", (F.col("foreign_net") + F.col("trust_net") + F.col("dealer_net")).alias("total_net"))
    return I.merge_day(c.select("stock_id", "date", "volume"), flows, universe)


@query("s06_two_sided_days", with_ctes(("cells",), "SELECT date, count(*) AS quotes, count(*) FILTER (WHERE stock_id::BIGINT % 7 <> 0) AS flows FROM cells GROUP BY 1"))
def s06(spark, d):
    c = cells(spark, d).select("stock_id", "date")
    return I.two_sided(c, c.where(F.col("stock_id").cast("long") % 7 != 0))


@query("s14_seed_rows", with_ctes(("cells",), "SELECT stock_id, date, close FROM cells WHERE date IN (SELECT date FROM cells GROUP BY 1 HAVING count(DISTINCT stock_id) >= 5 ORDER BY date DESC LIMIT 60)"))
def s14(spark, d):
    return I.seed(cells(spark, d).select("stock_id", "date", "close"), F.lit(5), 60)


_TYPE = "list_extract(['LAYOUT_CONFIRMED_DIRECT', 'NEW_CANDIDATE', 'DAY20_EXTEND', 'SOMETHING_ELSE'], (event_id % 4 + 1)::INTEGER)"


@query("s24_read_plan", f"""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_id % 4 WHEN 0 THEN 50 WHEN 1 THEN 40 WHEN 2 THEN 20 ELSE 0 END DESC, CASE WHEN event_id % 11 = 0 OR coalesce(round(value, 2), 0) = 0 THEN -1 ELSE round(value, 2) END DESC, lpad((event_id % 97)::VARCHAR, 4, '0'), event_id::VARCHAR) AS position
FROM events WHERE event_id % 5 <> 0 AND event_id % 3 <> 1 AND (event_id % 6 >= 2 OR ts::DATE + 7 >= DATE '2024-01-15')""")
def s24(spark, d):
    """The events as a plan: some not eligible, not ready or expired, some without a percentile."""
    e, k = table(spark, d, "events"), F.col("event_id")
    types = F.array(*map(F.lit, ("LAYOUT_CONFIRMED_DIRECT", "NEW_CANDIDATE", "DAY20_EXTEND", "SOMETHING_ELSE")))
    plan = e.select(
        "user_id", F.lpad((k % 97).cast("string"), 4, "0").alias("stock_id"), F.to_date("ts").cast("string").alias("signal_date"), k.cast("string").alias("event_id"), F.get(types, (k % 4).cast("int")).alias("notification_type"), F.lit("").alias("notify_mode"),
        F.when(k % 5 != 0, " True ").otherwise("0").alias("eligible_for_future_github"), F.when(k % 3 == 0, "1").when(k % 3 == 2, "yes").alias("ready_to_send"), F.when((k % 5 != 0) & (k % 3 != 1), "TRACK_ONLY").otherwise("BUY").alias("trade_action"),
        F.when(k % 11 != 0, F.round("value", 2).cast("string")).otherwise("").alias("percentile"), F.when(k % 6 < 2, F.date_add(F.to_date("ts"), 7).cast("string")).otherwise("").alias("plan_valid_until"),
    )
    return I.read_plan(plan, F.lit("2024-01-15").cast("date")).select("user_id", F.col("event_id").cast("long").alias("event_id"), F.col("position").cast("long").alias("position"))


@query("s27_compared_lists", "SELECT c_custkey AS custkey, 'left_only' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT DISTINCT o_custkey, 'right_only' FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer)")
def s27(spark, d):
    return I.compared(table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey")), "custkey")


_RULE = "'top' || ((idx % 3 + 1) * 10) || '_confirm' || run_length || 'd'"


@query("f14_typed_events", with_ctes(("runs",), f"SELECT stock_id, idx, rule, CASE rule WHEN 'top10_confirm1d' THEN 'NEW_CANDIDATE' WHEN 'top20_confirm5d' THEN 'LAYOUT_CONFIRMED_DIRECT' ELSE 'OTHER' END AS event_type FROM (SELECT stock_id, idx, {_RULE} AS rule FROM runs) WHERE rule IN ('top10_confirm1d', 'top20_confirm5d', 'top30_confirm3d')"))
def f14(spark, d):
    e = runs(spark, d).select("stock_id", "idx", F.format_string("top%d_confirm%dd", ((F.col("idx") % 3 + 1) * 10).cast("int"), "run_length").alias("entry_rule"))
    return I.typed_events(e, ("top10_confirm1d", "top20_confirm5d", "top30_confirm3d")).withColumnRenamed("entry_rule", "rule")
