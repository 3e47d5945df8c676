"""Queries of parsers, payloads, sinks, joins, set operations and orderings (C01-C07, C13, C18, F04, F05, F20, S07-S10, K01-K04, J02-J06, J11, J12, J16, J18, J25, J26, J29, T01, T06, T07, U01-U04, A01)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.functions import parsing as C
from tidepanel.plans.adapter import cells, stock_key, table, with_ctes
from tidepanel.plans.core import query
from tidepanel.plans.feature_queries import r, rq
from tidepanel.operators.ranking import ceiled_group
from tidepanel.plans.ranking_queries import ranked
from tidepanel.sources import payloads as S
from tidepanel.sources import tables as K

_FORMS = ["strftime(d, '%Y%m%d')", "lpad((year(d) - 1911)::VARCHAR, 3, '0') || strftime(d, '%m%d')", "lpad((year(d) - 1911)::VARCHAR, 3, '0') || strftime(d, '/%m/%d')", "strftime(d, '%Y-%m-%d 00:00')", "'99/99'"]


@query("c01_market_dates", "SELECT form, count(*) AS n, count(d) FILTER (WHERE form < 4) AS parsed, min(CASE WHEN form < 4 THEN d END) AS first, max(CASE WHEN form < 4 THEN d END) AS last FROM (SELECT o_orderdate::DATE AS d, (o_orderkey % 5)::INTEGER AS form FROM orders) GROUP BY 1")
def c01(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d"), (F.col("o_orderkey") % 5).cast("int").alias("form"))
    roc = F.lpad((F.year("d") - 1911).cast("string"), 3, "0")
    text = F.when(F.col("form") == 0, F.date_format("d", "yyyyMMdd")).when(F.col("form") == 1, F.concat(roc, F.date_format("d", "MMdd"))).when(F.col("form") == 2, F.concat(roc, F.date_format("d", "/MM/dd"))).when(F.col("form") == 3, F.date_format("d", "yyyy-MM-dd 00:00")).otherwise("99/99")
    p = o.withColumn("p", C.market_date(text))
    return p.groupBy("form").agg(F.count("*").alias("n"), F.count("p").alias("parsed"), F.min("p").alias("first"), F.max("p").alias("last"))


@query("c02_c03_registry_dates", "SELECT o_orderkey AS id, o_orderdate::DATE AS cjk, o_orderdate::DATE AS dotted, strftime(o_orderdate, '%Y-%m-%d') AS lead FROM orders")
def c02(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    cjk = F.concat(F.lpad((F.year("d") - 1911).cast("string"), 3, "0"), F.date_format("d", "年MM月dd日"))
    return o.select(F.col("o_orderkey").alias("id"), C.registry_date(cjk).alias("cjk"), C.registry_date(F.date_format("d", "yyyy.MM.dd")).alias("dotted"), C.leading_date(F.concat(F.date_format("d", " yyyy/MM/dd"), F.lit(" 10:00"))).alias("lead"))


@query("c04_numbers", "SELECT o_orderkey AS id, round(o_totalprice, 2) AS value, 0.0::DOUBLE AS bad FROM orders")
def c04(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), C.number(F.concat(F.lit(" +"), F.format_number("o_totalprice", 2))).alias("value"), C.number(F.col("o_orderpriority")).alias("bad"))


@query("c05_first_present", "SELECT event_id, value AS found FROM events")
def c05(spark, d):
    e = table(spark, d, "events").select("event_id", "value", F.create_map(F.lit("Net Buy (shares)"), F.col("value").cast("string"), F.lit("other"), F.lit("1")).alias("m"))
    return e.select("event_id", C.first_present(F.col("m"), ["missing", "netbuyshares"]).cast("double").alias("found"))


# the entities that the pages' titles hold are named here; the tests hold the others against Python
_TITLE = "trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', ' ', 'g'), '&quot;', '\"', 'g'), '&amp;', '&'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query("c07_s09_html_cells", f"SELECT page_id, len(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1))::INTEGER AS items, regexp_replace({_TITLE}, '&amp$', '&') AS title FROM pages")
def c07(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(C.html_cells(F.col("html"), "li")).alias("items"), F.coalesce(F.get(C.html_cells(F.col("html"), "title"), F.lit(0)), F.lit("")).alias("title"))


@query("c13_signatures", "SELECT c_custkey AS id, sha256('{\"key\":' || c_custkey || '}') AS signature FROM customer")
def c13(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.sha2(F.to_json(F.struct(F.col("c_custkey").alias("key"))), 256).alias("signature"))


_KINDS = ("半導體", "ETF", "富邦ETF基金", "特別股", "認購權證", "權證概念", "受益證券", "存託憑證", "Index", "TDR", "金融")


@query("f04_common_stock", f"""SELECT market, coalesce(kind, '') AS kind, count(*) AS n, count(*) FILTER (WHERE lower(market) IN ('twse', 'tpex') AND regexp_matches(code, '^[0-9]{{4}}$') AND code NOT LIKE '00%' AND coalesce(kind, '') IN ('', '半導體', '金融')) AS common
FROM (SELECT lpad((c_custkey * 37 % 20000)::VARCHAR, 4, '0') AS code, list_extract(['TWSE', 'tpex', 'emerging'], (c_custkey % 3 + 1)::INTEGER) AS market, list_extract({list(_KINDS)}, (c_custkey // 3 % 12 + 1)::INTEGER) AS kind FROM customer) GROUP BY 1, 2""")
def f04(spark, d):
    k = F.col("c_custkey")
    code, market, kind = F.substring(F.lpad((k * 37 % 20000).cast("string"), 5, "0"), 2, 4), F.get(F.array(*map(F.lit, ("TWSE", "tpex", "emerging"))), (k % 3).cast("int")), F.get(F.array(*map(F.lit, _KINDS)), (F.floor(k / 3) % 12).cast("int"))
    code = F.when(k * 37 % 20000 > 9999, (k * 37 % 20000).cast("string").substr(1, 4)).otherwise(code)
    c = table(spark, d, "customer").select(code.alias("code"), market.alias("market"), kind.alias("kind"))
    return c.groupBy("market", F.coalesce("kind", F.lit("")).alias("kind")).agg(F.count("*").alias("n"), F.count_if(C.common_stock(F.col("code"), F.col("kind"), F.col("market"))).alias("common"))


@query("f05_effective_window", "SELECT custkey, greatest(DATE '1996-01-01', f) AS first_date, least(DATE '2000-12-31', l - 1) AS last_date FROM (SELECT o_custkey AS custkey, min(o_orderdate)::DATE AS f, max(o_orderdate)::DATE AS l FROM orders GROUP BY 1) WHERE greatest(DATE '1996-01-01', f) <= least(DATE '2000-12-31', l - 1)")
def f05(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.to_date(F.min("o_orderdate")).alias("f"), F.to_date(F.max("o_orderdate")).alias("l"))
    w = o.select("custkey", F.greatest(F.lit("1996-01-01").cast("date"), "f").alias("first_date"), F.least(F.lit("2000-12-31").cast("date"), F.date_sub("l", 1)).alias("last_date"))
    return w.where("first_date <= last_date")


@query("f20_selection_bands", with_ctes(("ranked",), "SELECT CASE WHEN p > 90 THEN 'top10' WHEN p > 80 THEN 'top20' WHEN p <= 10 THEN 'bottom10' WHEN p <= 20 THEN 'bottom20' ELSE 'middle' END AS band, count(*) AS n FROM (SELECT round(pct, 9) AS p FROM ranked) GROUP BY 1"))
def f20(spark, d):
    p = F.round("pct", 9)
    return ranked(spark, d).groupBy(F.when(p > 90, "top10").when(p > 80, "top20").when(p <= 10, "bottom10").when(p <= 20, "bottom20").otherwise("middle").alias("band")).agg(F.count("*").alias("n"))


def _payloads(spark, d):
    """One payload of fields and data, and one of positional rows, per order date."""
    key = F.col("o_custkey").cast("string")
    code = F.when(F.length(key) > 4, key).otherwise(F.lpad(key, 4, "0"))  # lpad cuts longer keys
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").cast("string").alias("id"), code.alias("code"), "o_orderkey", F.format_number("o_totalprice", 2).alias("price"))
    row = F.array("code", F.col("o_orderkey").cast("string"), "price")
    fields = F.array(F.lit("Code "), F.lit("Name"), F.lit("Closing Price"))
    pos = F.concat(F.array("code", F.col("o_orderkey").cast("string"), "price"), F.array_repeat(F.col("price"), 15))
    return o.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.array_sort(F.collect_list(pos)).alias("wide")).select("id", F.to_json(F.struct(F.lit("OK").alias("stat"), F.array(F.struct(fields.alias("fields"), F.col("rows").alias("data"))).alias("tables"))).alias("payload"), F.to_json(F.struct(F.col("wide").alias("aaData"))).alias("flat"))


@query("s07_s10_named_payloads", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS id, lpad(o_custkey::VARCHAR, greatest(4, length(o_custkey::VARCHAR))::INTEGER, '0') AS code, o_orderkey::VARCHAR AS name, round(o_totalprice, 2) AS close FROM orders")
def s07(spark, d):
    rows = S.shredded(_payloads(spark, d), {"code": ["Code", "SecuritiesCompanyCode"], "name": ["CompanyName", "Name"], "close": ["Close", "Closing Price"]})
    return rows.select("id", "code", "name", C.number(F.col("close")).alias("close"))


@query("s07_s08_positional_payloads", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS id, lpad(o_custkey::VARCHAR, greatest(4, length(o_custkey::VARCHAR))::INTEGER, '0') AS code, round(o_totalprice, 2) AS close, round(o_totalprice, 2) AS trust_net FROM orders WHERE length(o_custkey::VARCHAR) <= 6")
def s08(spark, d):
    p = _payloads(spark, d).select("id", F.col("flat").alias("payload"))
    q = S.positional_quotes(p).select("id", "code", "name", "close").withColumn("n", F.row_number().over(Window.partitionBy("id", "code").orderBy("close")))
    f = S.positional_flows(p).select("id", "code", "trust_net").withColumn("n", F.row_number().over(Window.partitionBy("id", "code").orderBy("trust_net")))
    return q.join(f, ["id", "code", "n"]).select("id", "code", "close", "trust_net")


_OLD, _NEW = "event_id % 3 <> 0", "(event_id % 3 = 0 OR event_id % 2 = 0)"  # every event is on one side, some on both


@query("k01_upsert", "SELECT k, arg_max(value, (ts, event_id)) AS value FROM (SELECT event_id % 400 AS k, ts, event_id, value FROM events) GROUP BY 1")
def k01(spark, d):
    side = lambda c: table(spark, d, "events").where(c).select((F.col("event_id") % 400).alias("k"), F.struct("ts", "event_id").alias("at"), "value")
    return K.upsert(side(_OLD), side(_NEW), ["k"], "at").select("k", "value")


@query("k02_insert_or_ignore", f"SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events WHERE {_OLD} UNION ALL SELECT DISTINCT user_id, event_type FROM events WHERE {_NEW} AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE {_OLD})) GROUP BY 1")
def k02(spark, d):
    side = lambda c: table(spark, d, "events").where(c).select("user_id", "event_type").distinct()
    return K.insert_or_ignore(side(_OLD), side(_NEW), ["user_id", "event_type"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("k03_k04_range_replace", "SELECT status, count(*) AS n FROM (SELECT o_orderstatus AS status, o_orderdate::DATE AS date FROM orders WHERE NOT (o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND o_orderpriority = '1-URGENT') UNION ALL SELECT 'new', o_orderdate::DATE FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-03-31') GROUP BY 1")
def k03(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("source"))
    new = o.where(F.col("date").between("1996-01-01", "1996-03-31")).withColumn("status", F.lit("new"))
    return K.replace_range(o, new, "date", "1996-01-01", "1997-06-30", "1-URGENT").groupBy("status").agg(F.count("*").alias("n"))


@query("a01_pivot_net_flows", "SELECT lpad(l_suppkey::VARCHAR, 6, '0') AS stock_id, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r FROM lineitem GROUP BY 1")
def a01(spark, d):
    p = table(spark, d, "lineitem").groupBy(stock_key("l_suppkey").alias("stock_id")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return p.select("stock_id", *[F.coalesce(c, F.lit(0.0)).alias(c.lower()) for c in ("A", "N", "R")])


@query("j02_panel_join", with_ctes(("cells",), "SELECT stock_id, date, s_nationkey::BIGINT AS nation, coalesce(n, 0) AS events FROM cells JOIN supplier ON lpad(s_suppkey::VARCHAR, 6, '0') = stock_id LEFT JOIN (SELECT date_trunc('week', ts)::DATE AS w, count(*) AS n FROM events GROUP BY 1) e ON e.w = date"))
def j02(spark, d):
    e = table(spark, d, "events").groupBy(F.date_trunc("week", "ts").cast("date").alias("date")).agg(F.count("*").alias("n"))
    s = table(spark, d, "supplier").select(stock_key("s_suppkey").alias("stock_id"), F.col("s_nationkey").cast("long").alias("nation"))
    return cells(spark, d).select("stock_id", "date").join(s, "stock_id").join(e, "date", "left").select("stock_id", "date", "nation", F.coalesce("n", F.lit(0)).cast("long").alias("events"))


@query("j05_audit_classification", "SELECT class, count(*) AS n FROM (SELECT CASE WHEN o_orderkey IS NULL THEN 'no_order' WHEN c_custkey IS NULL THEN 'no_customer' WHEN l_shipdate::DATE < o_orderdate::DATE THEN 'before_order' ELSE 'sound' END AS class FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey) GROUP BY 1")
def j05(spark, d):
    li, o, c = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(c.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    kind = F.when(F.col("o_orderkey").isNull(), "no_order").when(F.col("c_custkey").isNull(), "no_customer").when(F.to_date("l_shipdate") < F.to_date("o_orderdate"), "before_order").otherwise("sound")
    return j.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("j06_universe_build", "SELECT key, source FROM (SELECT s_suppkey AS key, 'current' AS source FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT DISTINCT l_suppkey, 'gone' FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0))")
def j06(spark, d):
    now = table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("key"))
    gone = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key")).distinct().join(now, "key", "left_anti")
    return now.withColumn("source", F.lit("current")).unionByName(gone.withColumn("source", F.lit("gone")))


@query("j11_never_completed", "SELECT c_custkey AS custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j11(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderstatus")
    return c.join(o, "custkey", "left_semi").join(o.where("o_orderstatus = 'F'"), "custkey", "left_anti")


@query("j12_semi_join", "SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 10 = 3)")
def j12(spark, d):
    p = table(spark, d, "part").where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(p, "l_partkey", "left_semi").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


_STAR = {
    "orders": "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1",
    "finished": "SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "items": "SELECT o_custkey AS k, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "suppliers": "SELECT o_custkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "events": "SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1",
    "purchases": "SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1",
    "active_days": "SELECT user_id AS k, count(DISTINCT ts::DATE) AS n FROM events GROUP BY 1",
}


@query("j16_summary_star", f"SELECT c_custkey AS custkey, {', '.join(f'coalesce({n}.n, 0) AS {n}' for n in _STAR)} FROM customer " + " ".join(f"LEFT JOIN ({q}) {n} ON {n}.k = c_custkey" for n, q in _STAR.items()))
def j16(spark, d):
    """Seven counts beside each customer. Those of one table are made in one aggregation, so that three joins do."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("custkey"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(o, "o_orderkey")
    e = table(spark, d, "events").select(F.col("user_id").alias("custkey"), "event_type", F.to_date("ts").alias("day"))
    counts = [
        o.groupBy("custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished")),
        items.groupBy("custkey").agg(F.count("*").alias("items"), F.count_distinct("l_suppkey").alias("suppliers")),
        e.groupBy("custkey").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_distinct("day").alias("active_days")),
    ]
    star = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"))
    for c in counts:
        star = star.join(c, "custkey", "left")
    return star.fillna(0)


@query("j18_historical_behaviour", with_ctes(("ranked",), f", g AS (SELECT *, greatest(1, least(10, ceil(round(pct, 9) / 10)))::INTEGER AS decile FROM ranked), h AS (SELECT decile, {rq('avg(ret) FILTER (WHERE year <= 1998)', 'early')}, {rq('avg(ret) FILTER (WHERE year > 1998)', 'late')} FROM g GROUP BY 1) SELECT stock_id, date, decile, early, late FROM g JOIN h USING (decile)"))
def j18(spark, d):
    g = ranked(spark, d).withColumn("decile", ceiled_group(F.round("pct", 9), 10))
    when = lambda c: F.avg(F.when(c, F.col("ret")))
    h = g.groupBy("decile").agg(r(when(F.col("year") <= 1998), "early"), r(when(F.col("year") > 1998), "late"))
    return g.join(F.broadcast(h), "decile").select("stock_id", "date", "decile", "early", "late")  # ten rows


@query("j21_newest_cache", "SELECT user_id, value FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, ts DESC, event_id) AS n FROM events) WHERE n = 1")
def j21(spark, d):
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("value", F.struct(rank, -F.unix_micros(F.col("ts").cast("timestamp_ltz")), "event_id")).alias("value"))


@query("j25_coverage", with_ctes(("cells",), "SELECT year(date)::INTEGER AS year, count(DISTINCT stock_id) AS priced, count(DISTINCT stock_id) FILTER (WHERE foreign_net <> 0) AS with_flow, count(DISTINCT date) AS dates FROM cells GROUP BY 1"))
def j25(spark, d):
    return cells(spark, d).groupBy(F.year("date").alias("year")).agg(F.count_distinct("stock_id").alias("priced"), F.count_distinct(F.when(F.col("foreign_net") != 0, F.col("stock_id"))).alias("with_flow"), F.count_distinct("date").alias("dates"))


@query("j26_pending_requests", "SELECT user_id, kind FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (VALUES ('view'), ('click'), ('purchase'), ('refund')) v(kind) WHERE (user_id, kind) NOT IN (SELECT user_id, event_type FROM events WHERE event_id % 3 <> 0)")
def j26(spark, d):
    e = table(spark, d, "events")
    want = e.select("user_id").distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in ("view", "click", "purchase", "refund")])))
    return want.join(e.where("event_id % 3 <> 0").select("user_id", F.col("event_type").alias("kind")).distinct(), ["user_id", "kind"], "left_anti")


@query("j29_key_inventory", "SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def j29(spark, d):
    return table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("u01_u04_set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT s_nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer) UNION ALL SELECT 'intersect', count(*) FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer) UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'distinct', count(*) FROM (SELECT DISTINCT event_type FROM events)")
def u01(spark, d):
    s, c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    one = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return one(s.unionAll(c), "union").unionAll(one(s.intersect(c), "intersect")).unionAll(one(c.exceptAll(s), "except")).unionAll(one(table(spark, d, "events").select("event_type").distinct(), "distinct"))


@query("t01_top_contributions", with_ctes(("cells",), "SELECT stock_id, date, array_to_string(list_transform(list_filter(list_sort([{'v': -round(foreign_net / 7, 4), 'n': 'a'}, {'v': -round(trust_net / 7, 4), 'n': 'b'}, {'v': -round(dealer_net / 7, 4), 'n': 'c'}]), lambda x: x.v < 0)[1:2], lambda x: printf('%s(%+.4f)', x.n, -x.v)), '；') AS factors FROM cells"))
def t01(spark, d):
    return cells(spark, d).select("stock_id", "date", C.top_contributions(["a", "b", "c"], [F.col(n) / 7 for n in ("foreign_net", "trust_net", "dealer_net")], 2).alias("factors"))


@query("t07_candidate_order", "SELECT s_suppkey AS key, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END, s_suppkey) AS place FROM supplier")
def t07(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy(F.when(F.col("s_suppkey") % 2 == 0, 0).otherwise(1), "s_suppkey")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.row_number().over(w).cast("long").alias("place"))


@query("t06_hash_sample")
def t06(spark, d):
    """A deterministic sample by hash (the hash is Spark's own, so there is no SQL counterpart)."""
    h = F.xxhash64("o_orderkey", F.lit(42))
    return table(spark, d, "orders").withColumn("h", h).where(F.col("h") <= -(2**62)).orderBy("h").limit(100).select("o_orderkey", "h")
