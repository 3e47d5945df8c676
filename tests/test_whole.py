"""Queries over whole tables: that they leave nothing out, and what SQL cannot express."""

import html
import re

from tidepanel.plans.registry import QUERIES

SOURCE = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{SOURCE}/{name}.parquet").collect()


def test_titles_are_decoded_on_every_page(spark, tmp_path):
    pages = [(p["page_id"], p["html"]) for p in rows(spark, "pages")]
    pages += [(10**6 + i, f"<title>{t}</title><ul><li>x</li><li>&lt;b&gt;</li></ul>") for i, t in enumerate(("A &amp; B", "&quot;x&quot;&nbsp;&#39;y&#39;", "&amp;lt; 3", " a <i>b</i>&gt;c "))]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")

    def title(text):
        found = re.search(r"(?s)<title[^>]*>(.*?)</title>", text)
        plain = html.unescape(re.sub(r"(?s)<[^>]*>", " ", found[1])).replace("\xa0", " ") if found else ""
        return re.sub(r"[ \t\n\r\f]+", " ", plain).strip(" ")

    got = {r["page_id"]: (r["items"], r["title"]) for r in QUERIES["c07_s09_html_cells"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(re.findall(r"(?s)<li[^>]*>(.*?)</li>", t)), title(t)) for i, t in pages}


def test_nothing_is_left_out(spark):
    orders = len(rows(spark, "orders"))
    assert QUERIES["s07_s10_named_payloads"](spark, SOURCE).count() == orders
    assert QUERIES["s07_s08_positional_payloads"](spark, SOURCE).count() == orders
    pairs = {(e["user_id"], e["event_type"]) for e in rows(spark, "events")}
    assert sum(r["n"] for r in QUERIES["k02_insert_or_ignore"](spark, SOURCE).collect()) == len(pairs)


def test_dispatch_in_one_order_equals_dispatch_by_user(spark):
    from pyspark.sql import functions as F
    from tidepanel.operators import notify as N
    from tidepanel.plans.lifecycle_queries import notices, percentiles, users

    notes, scores, who = notices(spark, SOURCE).where("idx % 9 = 0"), percentiles(spark, SOURCE), users(spark, SOURCE)
    plain = N.dispatch(N.notification_plan(notes, who, scores), spark.createDataFrame([], "state_key string"))
    key = lambda df: sorted(tuple(r) for r in df.select("user_id", "state_key", "position").collect())
    want = key(plain)
    assert key(N.dispatch_unsent(notes, who, scores)) == want and len(want) > 0
    assert N.dispatch_unsent(notes, who.where(F.lit(False)), scores).count() == 0


def test_dispatch_deals_its_product_to_many_tasks(spark):
    from pyspark.sql import functions as F
    from tidepanel.operators import notify as N

    notes = spark.range(300).selectExpr("'tpex' AS market", "lpad(id, 6, '0') AS stock_id", "id AS idx", "id AS start_idx", "'DAY20_EXTEND' AS type", "'STATE_UPDATE' AS class", "80 + id % 20 / 1.0D AS percentile")
    who = spark.range(0, 200, 1, 1).selectExpr("id AS user_id", "true AS enabled", "1 AS max_new", "true AS wants_updates")
    sent = N.dispatch_unsent(notes, who)
    by_task = [r["count"] for r in sent.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(by_task) == 300 * 200 and len(by_task) >= 4 and max(by_task) <= sum(by_task) / 2
    assert sent.groupBy("user_id").agg(F.count_distinct("position").alias("n"), F.max("position").alias("last")).where("n <> 300 OR last <> 300").count() == 0


def test_dealt_product_is_cut_by_rows_and_keeps_pairs(spark, monkeypatch):
    from tidepanel.operators import notify as N

    left, right = spark.range(50).selectExpr("id AS a"), spark.range(40).selectExpr("id AS b")
    monkeypatch.setattr(N, "TASK_ROWS", 100)
    got = N.dealt_product(left, right, "b", (50, 40))
    assert got.rdd.getNumPartitions() >= 2000 / 100
    assert sorted(tuple(r) for r in got.collect()) == [(a, b) for a in range(50) for b in range(40)]
    for none in (left.where("a < 0"), right.where("b < 0")):
        sides = (none, right, "b", (0, 40)) if "a" in none.columns else (left, none, "b", (50, 0))
        assert N.dealt_product(*sides).count() == 0


def test_dealt_product_goes_round_few_right_rows(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F
    from tidepanel.operators import notify as N

    left, right = spark.range(120).selectExpr("id AS a"), spark.range(0, 26_000, 1, 1).selectExpr("id * 7 AS b")
    monkeypatch.setattr(N, "TASK_ROWS", 120_000)
    got = N.dealt_product(left, right, "b", (120, 26_000))
    rounds = got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_distinct("b").alias("right")).collect()
    assert sum(r["n"] for r in rounds) == 120 * 26_000 and max(r["right"] for r in rounds) <= 1.5 * N.PART_ROWS
    got.write.parquet(f"{tmp_path}/product")
    files = [pq.ParquetFile(f).metadata for f in tmp_path.glob("product/*.parquet")]
    stored = sum(m.row_group(g).column(1).total_compressed_size for m in files for g in range(m.num_row_groups))
    assert stored < 0.8 * 120 * 26_000  # bytes for b, of which a row's number takes ten bits


def test_target_dates_follow_the_cutoff(spark):
    from tidepanel.operators.updates import target_dates

    cal = spark.createDataFrame([("2024-05-02",), ("2024-05-03",), ("2024-05-06",)], "date string").selectExpr("date::date AS date")
    asks = [("2024-05-06 14:00:00", None, None, "14:30"), ("2024-05-06 14:30:00", None, None, "14:30"), ("2024-05-06 20:00:00", None, None, None), ("2024-05-06 09:00:00", "2024-05-04", None, None), ("2024-05-06 09:00:00", "2024-05-07", None, None), ("2024-05-06 09:00:00", None, "2024-05-04", None), ("2024-05-06 09:00:00", None, "2024-05-02", None), ("2024-05-01 09:00:00", None, None, None)]
    a = spark.createDataFrame(asks, "now string, as_of string, explicit string, cutoff string").selectExpr("now::timestamp AS now", "as_of::date AS as_of", "explicit::date AS explicit", "cutoff")
    got = [(str(r["target"]) if r["target"] else None, r["source"]) for r in target_dates(a.coalesce(1), cal).collect()]
    assert got == [("2024-05-03", "before_as_of"), ("2024-05-06", "at_or_before_as_of"), ("2024-05-03", "before_as_of"), ("2024-05-03", "at_or_before_as_of"), (None, "as_of_after_today"), (None, "explicit_not_a_market_date"), ("2024-05-02", "explicit"), (None, "no_market_date")]


def test_hash_sample_is_the_same_however_the_rows_lie(spark):
    from pyspark.sql import functions as F

    got = [tuple(r) for r in QUERIES["t06_hash_sample"](spark, SOURCE).collect()]
    every = spark.read.parquet(f"{SOURCE}/orders.parquet").repartition(7).select("o_orderkey", F.xxhash64("o_orderkey", F.lit(42)).alias("h")).collect()
    want = sorted((r["h"], r["o_orderkey"]) for r in every if r["h"] <= -(2**62))[:100]
    assert got == [(k, h) for h, k in want] and got


def test_freshness_has_all_statuses(spark):
    from tidepanel.operators.notify import freshness

    cal = spark.createDataFrame([("2024-05-02",), ("2024-05-03",), ("2024-05-06",), ("2024-05-07",)], "date string").selectExpr("date::date AS date")
    want = [  # as_of, explicit, signal, raw, price, flow
        (("2024-05-07", None, "2024-05-07", "2024-05-07", "2024-05-07", "2024-05-07"), "FRESH", 0),
        (("2024-05-07", None, "2024-05-06", "2024-05-06", "2024-05-07", "2024-05-06"), "FRESH", 1),
        (("2024-05-07", None, "2024-05-08", "2024-05-08", None, None), "INVALID_FUTURE_SIGNAL_DATE", None),
        (("2024-04-01", None, "2024-03-29", "2024-03-29", None, None), "UNKNOWN_NO_MARKET_CALENDAR", None),
        (("2024-05-07", None, "2024-05-06", "2024-05-06", "2024-05-07", "2024-05-07"), "PHASE3_NOT_UPDATED_TO_LATEST_SOURCE", 1),
        (("2024-06-07", None, "2024-05-07", "2024-05-07", None, None), "STALE_MARKET_CALENDAR", 0),
        (("2024-05-07", None, "2024-05-06", "2024-05-07", None, None), "INCOMPLETE_LATEST_CROSS_SECTION", 1),
        (("2024-05-11", None, "2024-05-10", "2024-05-10", None, None), "UNKNOWN_TRADING_DAY_LAG", None),
        (("2024-05-07", None, "2024-05-03", "2024-05-03", None, None), "STALE_SELECTION_DATE", 2),
        (("2024-05-14", None, "2024-05-06", "2024-05-06", None, None), "STALE_CALENDAR_AGE", 1),
        (("2024-06-07", "2024-05-07", "2024-05-06", "2024-05-06", None, None), "FRESH", 1),
        (("2024-06-07", "2024-06-06", "2024-06-04", "2024-06-04", None, None), "STALE_SELECTION_DATE", 2),
        (("2024-05-07", "2024-05-08", "2024-05-07", "2024-05-07", None, None), "INVALID_REFERENCE_DATE", 0),
    ]
    names = ("as_of", "explicit", "signal_date", "raw_date", "price_date", "flow_date")
    asks = spark.createDataFrame([a for a, _, _ in want], ", ".join(f"{n} string" for n in names)).selectExpr(*[f"{n}::date AS {n}" for n in names])
    assert [(r["status"], r["lag"]) for r in freshness(asks.coalesce(1), cal).collect()] == [(s, lag) for _, s, lag in want]


def test_plan_totals_equal_the_plan_summed_up(spark):
    from pyspark.sql import functions as F
    from tidepanel.operators import notify as N

    notes = spark.createDataFrame(
        [("tpex", "000001", 3, 3, "NEW_CANDIDATE", "NEW_CANDIDATE", 91.5), ("twse", "000002", 40, 9, "TWSE_DAY40_END", "STATE_UPDATE", None), ("tpex", "000010", 5, 5, "NEW_CANDIDATE", "NEW_CANDIDATE", 90.25), ("tpex", "000003", 7, 2, "DAY40_END", "SILENT_STATE", 1.0)],
        "market string, stock_id string, idx long, start_idx long, type string, class string, percentile double",
    )
    who = spark.createDataFrame([(1, True), (20, False), (3, True), (3, True)], "user_id long, enabled boolean")
    plan = N.notification_plan(notes, who).groupBy("user_id", "class", "priority").agg(F.count("*").alias("n"), F.sum("percentile").alias("p"), F.avg("percentile").alias("m"), F.min("state_key").alias("first_key"), F.max("state_key").alias("last_key"))
    got = N.plan_totals(notes, who, {"n": F.count("*"), "p": F.sum("percentile")}, {"m": F.avg("percentile")})
    key = lambda df: sorted(str(tuple(r)) for r in df.select("user_id", "class", "priority", "n", "p", "m", "first_key", "last_key").collect())
    assert key(got) == key(plan) and got.where("user_id = 3 and class = 'NEW_CANDIDATE'").first()["n"] == 4


def test_told_plan_makes_no_row_for_each_user_and_note(spark, monkeypatch):
    from tidepanel.operators import notify as N

    monkeypatch.setattr(N, "notification_plan", None)
    users = len(rows(spark, "customer"))
    assert QUERIES["m23_notification_plan"](spark, SOURCE).select("user_id").distinct().count() == users


def test_notice_product_makes_no_row_for_each_user_and_note(spark, monkeypatch):
    from tidepanel.operators import notify as N

    monkeypatch.setattr(N, "notification_plan", None)
    users = sum(u["c_custkey"] % 7 != 0 for u in rows(spark, "customer"))
    assert QUERIES["j17_notice_product"](spark, SOURCE).select("user_id").distinct().count() == users


def test_titles_cut_off_in_an_entity(spark, tmp_path):
    titles = [(1, "a &amp"), (2, "&&&amp \n"), (3, "&amp"), (4, "&ampx"), (5, "x &amp;"), (6, "x &am")]
    spark.createDataFrame([(i, f"<title>{t}</title>") for i, t in titles], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["title"] for r in QUERIES["c07_s09_html_cells"](spark, str(tmp_path)).collect()}
    assert got == {1: "a &", 2: "&&&", 3: "&", 4: "&ampx", 5: "x &", 6: "x &am"}


def test_daily_merge_keeps_codes_of_five_digits_apart(spark, tmp_path):
    """12301 begins with 1230, which is not in the universe, and does not put it there."""
    line = spark.read.parquet(f"{SOURCE}/lineitem.parquet").limit(1)
    keys = spark.createDataFrame([(k,) for k in (1230, 1231, 12301, 1236, 12361, 1235)], "k long")
    line.drop("l_suppkey").crossJoin(keys.withColumnRenamed("k", "l_suppkey")).select(line.columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in (1230, 1231, 12301, 1236, 12361)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(r["stock_id"] for r in QUERIES["f19_daily_merge"](spark, str(tmp_path)).collect()) == ["1231", "1236"]


def test_shredded_rows_do_not_carry_their_table(spark):
    from tidepanel.sources.payloads import shredded

    table = '{"fields": ["Code ", "Close"], "data": [["1101", "5"], ["2330"]]}'
    texts = [(1, f'{{"stat": "ok", "tables": [{table}, {table}]}}'), (2, table), (3, f'{{"stat": "no", "tables": [{table}]}}'), (4, None), (5, "x"), (6, '{"data": [["1"]]}')]
    got = shredded(spark.createDataFrame(texts, "id long, payload string"), {"code": ["SecuritiesCompanyCode", "Code"], "close": ["Close"], "name": ["Name"]})
    want = [("1101", "5", None), ("2330", None, None)]
    assert sorted(map(str, got.collect())) == sorted(f"Row(id={i}, code={r[0]!r}, close={r[1]!r}, name={r[2]!r})" for i, n in ((1, 2), (2, 1)) for r in want * n)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    rows = next(line for line in plan.splitlines() if "Generate explode(data" in line)
    assert "explode(data" in rows and ", []," not in rows  # the table is not among the columns that go on
