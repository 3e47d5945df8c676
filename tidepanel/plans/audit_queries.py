"""Queries of audits and shared aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.operators import audit as X
from tidepanel.operators import features as P
from tidepanel.operators.quantiles import count_up_to, exact_quantiles
from tidepanel.plans.adapter import CTES, cells, panel, table, with_ctes
from tidepanel.plans.core import query
from tidepanel.plans.feature_queries import r, rq, share_sql
from tidepanel.plans.ranking_queries import ranked, scores

_N = ["foreign_net_5", "foreign_net_20", "trust_net_20", "total_net_5", "total_net_20"]
CTES["feats"] = (("panel",), "SELECT stock_id, date, year(date)::INTEGER AS year, " + ", ".join(f"{share_sql(n.rpartition('_')[0], int(n.rpartition('_')[2]))} AS {n}" for n in _N) + " FROM panel")


def feats(spark, d):
    return panel(spark, d).select("stock_id", "date", F.year("date").alias("year"), *[P.flow_share(n.rpartition("_")[0], int(n.rpartition("_")[2])).alias(n) for n in _N])


_LONG = "(" + " UNION ALL ".join(f"SELECT '{n}' AS feature, year, {n} AS value FROM feats" for n in _N) + ")"


@query("a09_a10_feature_profiles", with_ctes(("feats",), f"""SELECT feature, count(*) AS "rows", count(value) AS valid, count(*) FILTER (WHERE value IS NULL) AS missing, count(*) FILTER (WHERE value = 0) AS zeros, {rq('avg(value)', 'mean')}, {rq('stddev_pop(value)', 'std')}, {rq('min(value)', 'least')}, {rq('max(value)', 'most')},
  count(*) FILTER (WHERE abs(value) > 100) AS over_100, count(DISTINCT round(value, 9)) AS "distinct", {rq('quantile_cont(value, 0.01)', 'p01')}, {rq('quantile_cont(value, 0.5)', 'p50')}, {rq('quantile_cont(value, 0.99)', 'p99')} FROM {_LONG} GROUP BY 1"""))
def a09(spark, d):
    p = X.profiles(feats(spark, d).select(*[F.round(n, 9).alias(n) for n in _N]), _N)
    return p.select("feature", "rows", "valid", "missing", "zeros", *[r(F.col(c), c) for c in ("mean", "std", "least", "most")], "over_100", "distinct", *[r(F.col(c), c) for c in ("p01", "p50", "p99")])


# The features with copies and faults beside them, for the checks that look for these.
_FAULTS = {
    "total_flow_pct_20": "total_net_20",
    "total_flow_pct_copy": "round(total_net_20, 3)",
    "opposite_flow_pct": "-total_net_20",
    "wide_flow_pct": "foreign_net_20 * 100",
    "buy_day_ratio_20": "CASE WHEN foreign_net_20 > 0 THEN 1.5 ELSE 0.5 END",
    "institutional_agreement_20": "sign(total_net_20)",
    "always_one": "1.0",
    "nearly_zero": "CASE WHEN stock_id = '000001' AND dayofyear(date) <= 7 THEN 1.0 ELSE 0.0 END",
    "with_gaps": "CASE WHEN year <> 1995 THEN total_net_5 END",
    "endless": "CASE WHEN year = 1996 THEN CAST('Infinity' AS DOUBLE) WHEN year = 1997 AND stock_id = '000001' THEN CAST('-Infinity' AS DOUBLE) ELSE foreign_net_5 END",
    "moving": "CASE WHEN year = 1998 THEN 10.0 ELSE 0.0 END",
}
CTES["faults"] = (("feats",), "SELECT year, " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in _FAULTS.items()) + " FROM feats")


def faults(spark, d):
    return feats(spark, d).select("year", *[F.expr(e).cast("double").alias(n) for n, e in _FAULTS.items()])


def _fine(n: str) -> str:
    return f"CASE WHEN abs({n}) < 'Infinity'::DOUBLE THEN {n} END"


CTES["alike"] = (("faults",), "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr(a, b) AS corr, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n, count(*) FILTER (WHERE abs(a - b) <= 1e-12) / count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS equal FROM (SELECT {_fine(a)} AS a, {_fine(b)} AS b FROM faults)"
    for i, a in enumerate(_FAULTS) for b in list(_FAULTS)[i + 1 :]) + ") WHERE abs(corr) >= 0.995 AND NOT isnan(corr) AND n >= 100")


@query("a11_correlations", with_ctes(("alike",), f'SELECT "left", "right", {rq("corr", "corr")}, n, {rq("equal", "equal")} FROM alike'))
def a11(spark, d):
    return X.correlations(faults(spark, d), list(_FAULTS)).select("left", "right", r(F.col("corr"), "corr"), "n", r(F.col("equal"), "equal"))


@query("a12_yearly_drift", with_ctes(("feats",), f"SELECT feature, year, count(value) AS n, {rq('(avg(value) - any_value(m)) / any_value(s)', 'drift')} FROM {_LONG} JOIN (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM {_LONG} GROUP BY 1) USING (feature) GROUP BY 1, 2"))
def a12(spark, d):
    return X.yearly_drift(feats(spark, d), _N).select("feature", "year", "n", r(F.col("drift"), "drift"))


@query("a14_w25_key_audit", "SELECT count(*) AS \"rows\", count(DISTINCT (l_orderkey, l_linenumber)) AS keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeats, count(*) FILTER (WHERE l_linenumber < p) AS out_of_order FROM (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS p FROM lineitem)")
def a14(spark, d):
    rows = table(spark, d, "lineitem").withColumn("at", F.struct("l_shipdate", "l_linenumber", "l_partkey"))
    return X.key_audit(rows, ["l_orderkey", "l_linenumber"], "at", "l_orderkey")


@query("f12_invalid_counts", "SELECT * FROM (SELECT unnest(['negative_zero_or_less_discount', 'no_quantity', 'shipped_before_1996']) AS \"check\", unnest([count(*) FILTER (WHERE l_discount <= 0), count(*) FILTER (WHERE coalesce(l_quantity, 0) <= 0), count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1996-01-01')]) AS violations FROM lineitem)")
def f12(spark, d):
    return X.invalid_counts(table(spark, d, "lineitem"), {"negative_zero_or_less_discount": F.col("l_discount") <= 0, "no_quantity": F.coalesce("l_quantity", F.lit(0.0)) <= 0, "shipped_before_1996": F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")})


@query("a02_complete_dates", with_ctes(("cells", "listed"), "SELECT date, count(DISTINCT stock_id) AS stocks FROM cells GROUP BY 1 HAVING count(DISTINCT stock_id) >= (SELECT greatest(5, floor(0.7 * count(*))) FROM listed)"))
def a02(spark, d):
    c = cells(spark, d).select("stock_id", "date")
    need = c.agg(F.greatest(F.lit(5), F.floor(F.lit(0.7) * F.count_distinct("stock_id"))).alias("need"))
    return c.groupBy("date").agg(F.count_distinct("stock_id").alias("stocks")).crossJoin(F.broadcast(need)).where("stocks >= need").drop("need")


@query("a03_required_coverage", with_ctes(("cells",), ", n AS (SELECT date, count(DISTINCT stock_id) AS stocks FROM cells GROUP BY 1 ORDER BY date DESC LIMIT 20) SELECT greatest(5, floor(median(stocks) * 0.85))::BIGINT AS required, max(date) AS last_date FROM n"))
def a03(spark, d):
    last = cells(spark, d).groupBy("date").agg(F.count_distinct("stock_id").alias("stocks")).orderBy(F.desc("date")).limit(20)
    return last.agg(F.greatest(F.lit(5), F.floor(F.median("stocks") * 0.85)).cast("long").alias("required"), F.max("date").alias("last_date"))


@query("a05_first_last_dates", "SELECT o_custkey AS custkey, min(o_orderdate)::DATE AS first_date, max(o_orderdate)::DATE AS last_date, count(*) AS orders FROM orders GROUP BY 1")
def a05(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.to_date(F.min("o_orderdate")).alias("first_date"), F.to_date(F.max("o_orderdate")).alias("last_date"), F.count("*").alias("orders"))


@query("a44_daily_type_counts", "SELECT ts::DATE AS date, coalesce(event_type, 'ALL') AS event_type, count(*) AS n FROM events GROUP BY GROUPING SETS ((ts::DATE, event_type), (ts::DATE))")
def a44(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("date"), "event_type")
    return e.groupingSets([["date", "event_type"], ["date"]], "date", "event_type").agg(F.count("*").alias("n")).select("date", F.coalesce("event_type", F.lit("ALL")).alias("event_type"), "n")


@query("a46_daily_coverage", with_ctes(("scores",), "SELECT min(n) AS least, median(n) AS middle, max(n) AS most, count(*) AS days FROM (SELECT date, count(*) AS n FROM scores WHERE money >= 50000 GROUP BY 1)"))
def a46(spark, d):
    n = scores(spark, d).where("money >= 50000").groupBy("date").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.median("n").alias("middle"), F.max("n").alias("most"), F.count("*").alias("days"))


@query("a47_recent_date_diagnostics", with_ctes(("panel",), "SELECT date, count(DISTINCT stock_id) AS listed, count(DISTINCT stock_id) FILTER (WHERE present) AS present, count(DISTINCT stock_id) FILTER (WHERE money >= 50000) AS liquid, count(DISTINCT stock_id) FILTER (WHERE total_net > 0) AS bought FROM panel WHERE idx > (SELECT max(idx) FROM panel) - 30 GROUP BY 1"))
def a47(spark, d):
    p = panel(spark, d)
    last = p.agg(F.max("idx").alias("last"))
    some = lambda c: F.count_distinct(F.when(c, F.col("stock_id")))
    return p.crossJoin(F.broadcast(last)).where("idx > last - 30").groupBy("date").agg(F.count_distinct("stock_id").alias("listed"), some(F.col("present")).alias("present"), some(F.col("money") >= 50000).alias("liquid"), some(F.col("total_net") > 0).alias("bought"))


@query("a51_metric_table", "SELECT unnest(['rows', 'first', 'last', 'suppliers']) AS metric, unnest([count(*)::VARCHAR, min(l_shipdate)::DATE::VARCHAR, max(l_shipdate)::DATE::VARCHAR, count(DISTINCT l_suppkey)::VARCHAR]) AS value FROM lineitem")
def a51(spark, d):
    return X.metric_table(table(spark, d, "lineitem").agg(F.count("*").alias("rows"), F.to_date(F.min("l_shipdate")).alias("first"), F.to_date(F.max("l_shipdate")).alias("last"), F.count_distinct("l_suppkey").alias("suppliers")))


_OWN = "SELECT feature, x.* FROM (SELECT feature, unnest(list_filter([{}], lambda x: x IS NOT NULL)) AS x FROM p)".format(", ".join(
    f"CASE WHEN {when} THEN {{'severity': '{severity}', 'issue': '{name}', 'value': ({value})::DOUBLE}} END"
    for severity, name, value, when in (
        ("ERROR", "missing_count", "missing", "missing > 0"),
        ("ERROR", "positive_infinity_count", "above_all", "above_all > 0"),
        ("ERROR", "negative_infinity_count", "below_all", "below_all > 0"),
        ("ERROR", "ratio_out_of_range", "1", "contains(feature, 'buy_day_ratio') AND (least < 0 OR most > 1)"),
        ("ERROR", "agreement_out_of_range", "1", "contains(feature, 'institutional_agreement') AND (least < -1 OR most > 1)"),
        ("WARN", "constant_feature", "different", "different <= 1"),
        ("WARN", "near_constant_feature", "top / valid", "different > 1 AND top / valid >= 0.995"),
        ("WARN", "extreme_flow_pct_gt_1000", "over_1000", "contains(feature, 'flow_pct') AND over_1000 / greatest(valid, 1) >= 0.0001"),
    )
))


@query("a15_audit_issues", with_ctes(("faults", "alike"), f""", l AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, year, {n} AS value FROM faults" for n in _FAULTS)}),
v AS (SELECT feature, value, count(*) AS c FROM l WHERE {_fine('value')} IS NOT NULL GROUP BY 1, 2),
p AS (SELECT * FROM (SELECT feature, count({_fine('value')}) AS valid, count(*) FILTER (WHERE value IS NULL) AS missing, count(*) FILTER (WHERE value = 'Infinity'::DOUBLE) AS above_all, count(*) FILTER (WHERE value = '-Infinity'::DOUBLE) AS below_all, min({_fine('value')}) AS least, max({_fine('value')}) AS most, count(*) FILTER (WHERE abs({_fine('value')}) > 1000) AS over_1000 FROM l GROUP BY 1)
  JOIN (SELECT feature, count(*) AS different, max(c) AS top FROM v GROUP BY 1) USING (feature)),
d AS (SELECT feature, year, count({_fine('value')}) AS n, (avg({_fine('value')}) - any_value(m)) / nullif(any_value(s), 0) AS z FROM l JOIN (SELECT feature, avg({_fine('value')}) AS m, stddev_pop({_fine('value')}) AS s FROM l GROUP BY 1) USING (feature) GROUP BY 1, 2)
SELECT severity, issue, feature AS subject, {rq('value', 'value')} FROM ({_OWN}) UNION ALL SELECT 'WARN', 'high_feature_correlation', "left" || '|' || "right", {rq('abs(corr)', 'value')} FROM alike
UNION ALL SELECT 'WARN', 'yearly_mean_shift_ge_2std', year || '|' || feature, {rq('z', 'value')} FROM d WHERE n >= 1000 AND abs(z) >= 2"""))
def a15(spark, d):
    f, names = faults(spark, d), list(_FAULTS)
    drift = X.yearly_drift(f.select("year", *[F.when(F.abs(n) < float("inf"), F.col(n)).alias(n) for n in names]), names)
    return X.issues(X.profiles(f, names), X.correlations(f, names), drift).select("severity", "issue", "subject", r(F.col("value"), "value"))


@query("w22_keep_last", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def w22(spark, d):
    # max_by combines map-side, where a window would gather every event of a user
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("e"))
    return e.select("user_id", "event_type", "e.event_id", "e.value")


# A score becomes a probability, and a positive ten-week return the outcome.
CTES["probs"] = (("ranked",), "SELECT stock_id, date, (ret > 0)::INTEGER AS y, 1 / (1 + exp(-greatest(-40, least(40, score / 25)))) AS p FROM ranked")


def probs(spark, d):
    z = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("score") / 25))
    return ranked(spark, d).select("stock_id", "date", (F.col("ret") > 0).cast("int").alias("y"), (1 / (1 + F.exp(-z))).alias("p"))


@query("a27_log_loss_brier", with_ctes(("probs",), f"SELECT count(*) AS n, {rq('avg(y)', 'base_rate')}, {rq('avg((p - y) ** 2)', 'brier')}, {rq('-avg(y * ln(greatest(1e-12, p)) + (1 - y) * ln(greatest(1e-12, 1 - p)))', 'log_loss')} FROM probs"))
def a27(spark, d):
    y, p = F.col("y"), F.col("p")
    least = F.lit(1e-12)
    return probs(spark, d).agg(F.count("*").alias("n"), r(F.avg("y"), "base_rate"), r(F.avg((p - y) * (p - y)), "brier"), r(-F.avg(y * F.ln(F.greatest(least, p)) + (1 - y) * F.ln(F.greatest(least, 1 - p))), "log_loss"))


@query("a25_calibration_error", with_ctes(("probs",), f"SELECT {rq('sum(gap * n) / sum(n)', 'ece')}, count(*) AS bins FROM (SELECT count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM probs GROUP BY least(floor(p * 10), 9))"))
def a25(spark, d):
    b = probs(spark, d).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return b.agg(r(F.sum(F.col("gap") * F.col("n")) / F.sum("n"), "ece"), F.count("*").alias("bins"))


@query("a26_calibration_table", with_ctes(("probs",), f"SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, {rq('avg(p)', 'mean_p')}, {rq('avg(y)', 'rate')} FROM probs GROUP BY 1"))
def a26(spark, d):
    return probs(spark, d).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"), r(F.avg("p"), "mean_p"), r(F.avg("y"), "rate"))


@query("a24_confusion_metrics", with_ctes(("probs",), f", c AS (SELECT count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn FROM probs) SELECT tp, fp, fn, tn, {rq('(tp + tn) / (tp + fp + fn + tn)', 'accuracy')}, {rq('(tp / (tp + fn) + tn / (tn + fp)) / 2', 'balanced')}, {rq('(2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2', 'macro_f1')} FROM c"))
def a24(spark, d):
    up, yes = F.col("y") == 1, F.col("p") >= 0.5
    c = probs(spark, d).agg(F.count_if(up & yes).alias("tp"), F.count_if(~up & yes).alias("fp"), F.count_if(up & ~yes).alias("fn"), F.count_if(~up & ~yes).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.try_divide(a, b)
    return c.select("*", r(share(tp + tn, tp + fp + fn + tn), "accuracy"), r((share(tp, tp + fn) + share(tn, tn + fp)) / 2, "balanced"), r((share(2 * tp, 2 * tp + fp + fn) + share(2 * tn, 2 * tn + fp + fn)) / 2, "macro_f1"))


@query("a28_roc_auc", with_ctes(("probs",), f"SELECT {rq('(sum(ar) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))', 'auc')} FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS ar FROM (SELECT y, round(p, 9) AS p FROM probs))"))
def a28(spark, d):
    # scores are counted by value first, so the running count only orders distinct scores, by coarse bins and within them
    by = probs(spark, d).groupBy(F.round("p", 9).alias("p")).agg(F.count("*").alias("n"), F.sum("y").alias("up")).withColumn("bin", F.floor(F.col("p") * 1000))
    bins = by.groupBy("bin").agg(F.sum("n").alias("bn"))
    before = bins.alias("a").join(F.broadcast(bins.select(F.col("bin").alias("o"), F.col("bn").alias("on"))), F.col("o") < F.col("bin"), "left").groupBy("bin").agg(F.coalesce(F.sum("on"), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("bin").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = by.join(F.broadcast(before), "bin").withColumn("ar", F.col("before") + inside + (F.col("n") + 1) / 2.0)
    t = rank.agg(F.sum(F.col("ar") * F.col("up")).alias("s"), F.sum("up").alias("u"), (F.sum("n") - F.sum("up")).alias("d"))
    return t.select(r((F.col("s") - F.col("u") * (F.col("u") + 1) / 2) / (F.col("u") * F.col("d")), "auc"))


@query("a30_threshold_search", with_ctes(("probs",), f", q AS (SELECT y, round(p, 9) AS p FROM probs), t AS (SELECT DISTINCT round(t, 9) AS t FROM (SELECT unnest(quantile_cont(p, [{', '.join(str(i / 100) for i in range(1, 100))}])) AS t FROM q UNION ALL SELECT 0.5)), c AS (SELECT t, count(*) FILTER (WHERE y = 1 AND p >= t) AS tp, count(*) FILTER (WHERE y = 0 AND p >= t) AS fp, count(*) FILTER (WHERE y = 1 AND p < t) AS fn, count(*) FILTER (WHERE y = 0 AND p < t) AS tn FROM q, t GROUP BY 1), m AS (SELECT t, round((tp / greatest(tp + fn, 1) + tn / greatest(tn + fp, 1)) / 2, 9) AS ba, round(2 * tp / greatest(2 * tp + fp + fn, 1), 9) AS f1 FROM c) SELECT {rq('t', 'threshold')}, {rq('ba', 'balanced')}, {rq('f1', 'f1')} FROM m ORDER BY m.ba DESC, m.f1 DESC, m.t DESC LIMIT 1"))
def a30(spark, d):
    """The best of the 99 percentiles and 0.5 by balanced accuracy, F1 and threshold."""
    p = probs(spark, d).select("y", F.round("p", 9).alias("p"))
    cuts = exact_quantiles(p, "p", [i / 100 for i in range(1, 100)])
    t = cuts.select(F.array_sort(F.array_distinct(F.transform(F.concat("q", F.array(F.lit(0.5))), lambda x: F.round(x, 9)))).alias("ts"))  # one row of a hundred
    # a row finds by bisection how many thresholds it reaches; those are a hundred bins to sum over
    bins = p.crossJoin(F.broadcast(t)).groupBy(count_up_to(F.col("ts"), F.col("p"), 100).alias("bin")).agg(F.count_if(F.col("y") == 1).alias("up"), F.count_if(F.col("y") != 1).alias("down"))
    reached = F.col("bin") > F.col("at")
    total = lambda n, when: F.coalesce(F.sum(F.when(when, F.col(n))), F.lit(0))
    c = t.select(F.posexplode("ts").alias("at", "t")).crossJoin(F.broadcast(bins)).groupBy("t").agg(total("up", reached).alias("tp"), total("down", reached).alias("fp"), total("up", ~reached).alias("fn"), total("down", ~reached).alias("tn"))
    least = lambda e: F.greatest(F.expr(e), F.lit(1))
    m = c.select("t", F.round((F.col("tp") / least("tp + fn") + F.col("tn") / least("tn + fp")) / 2, 9).alias("ba"), F.round(2 * F.col("tp") / least("2 * tp + fp + fn"), 9).alias("f1"))
    return m.agg(F.max(F.struct("ba", "f1", "t")).alias("b")).select(r(F.col("b.t"), "threshold"), r(F.col("b.ba"), "balanced"), r(F.col("b.f1"), "f1"))


@query("m09_prior_blend", with_ctes(("probs",), f", a AS (SELECT i / 20.0::DOUBLE AS a FROM range(0, 21) x(i)), l AS (SELECT a, round(-avg(y * ln(greatest(1e-12, a * p + (1 - a) * b)) + (1 - y) * ln(greatest(1e-12, 1 - a * p - (1 - a) * b))), 9) AS loss FROM probs, a, (SELECT avg(y) AS b FROM probs) GROUP BY 1) SELECT a AS alpha, {rq('loss', 'loss')} FROM l ORDER BY loss, a LIMIT 1"))
def m09(spark, d):
    s = probs(spark, d)
    base = s.agg(F.avg("y").alias("b"))
    q = F.col("a") * F.col("p") + (1 - F.col("a")) * F.col("b")
    least = F.lit(1e-12)
    loss = -F.avg(F.col("y") * F.ln(F.greatest(least, q)) + (1 - F.col("y")) * F.ln(F.greatest(least, 1 - q)))
    m = s.crossJoin(F.broadcast(base)).withColumn("a", F.explode(F.array(*[F.lit(i / 20) for i in range(21)]))).groupBy("a").agg(F.round(loss, 9).alias("loss"))
    return m.agg(F.min(F.struct("loss", "a")).alias("b")).select(F.col("b.a").alias("alpha"), r(F.col("b.loss"), "loss"))
