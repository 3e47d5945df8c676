"""Masters in any encoding, webhooks that send once, and late data in the daily stream."""

import datetime as dt
import http.server
import json
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tidepanel.functions.parsing import market_date
from tidepanel.sources import masters, webhooks
from tidepanel.streaming import daily

HEADER = '公司代號,公司簡稱,"上市日期",出表日期\r\n'


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-8", "big5", "cp950"])
def test_masters(spark, tmp_path, encoding):
    (tmp_path / "twse.json").write_text(json.dumps([{"公司代號 ": " 2330 ", "公司簡稱": "台積電", "上市日期": "0830905", "出表日期": "1130105"}, {"公司代號": ""}, 5], ensure_ascii=False), "utf-8")
    (tmp_path / "twse.csv").write_bytes((HEADER + "9999,不用,1990/01/01,\r\n").encode(encoding))
    (tmp_path / "tpex.json").write_text('{"error": "none"}')
    (tmp_path / "tpex.csv").write_bytes((HEADER + '6488,"環球,晶",104/9/25,113年1月5日\r\n,空,,\r\n6547,高端,20180412,\r\n').encode(encoding))
    got = sorted(map(tuple, masters.company_master(spark, str(tmp_path)).select("market", "stock_id", "stock_name", "listing_date", "report_date", "transport").collect()))
    day = dt.date
    assert got == [("tpex", "6488", "環球,晶", day(2015, 9, 25), day(2024, 1, 5), "csv_fallback"), ("tpex", "6547", "高端", day(2018, 4, 12), None, "csv_fallback"), ("twse", "2330", "台積電", day(1994, 9, 5), day(2024, 1, 5), "json")]
    (tmp_path / "tpex.csv").write_bytes(HEADER.encode(encoding))
    with pytest.raises(Exception, match="no company of market tpex"):
        masters.company_master(spark, str(tmp_path)).collect()


def test_delisted(spark, tmp_path):
    (tmp_path / "list.csv").write_bytes("終止上市日期,公司名稱,上市編號\n109/05/06,甲,1234\n,乙,2345\n2021-01-02,丙,\n".encode("big5"))
    assert [tuple(r)[:3] for r in masters.delisted(spark, str(tmp_path)).collect()] == [("1234", "甲", dt.date(2020, 5, 6))]


def test_market_dates(spark):
    cases = {"20240105": dt.date(2024, 1, 5), " 1130105 ": dt.date(2024, 1, 5), "113/1/5": dt.date(2024, 1, 5), "2024-01-05 10:00": dt.date(2024, 1, 5), "2024/13/01": None, "2024--01": None, "24/1/5": None, "202401": None, "": None, "2024/001/05": None, "20240105x": None, "2024/1/5/9": dt.date(2024, 1, 5), "x": None, None: None, "20240230": None, "2024/1/": None, "123456789": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", market_date(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == cases


class Hook(http.server.BaseHTTPRequestHandler):
    got: Counter = Counter()
    order: list = []
    refuse: set = set()
    busy: set = set()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        key = (self.path, body["embeds"][0]["title"])
        code = 400 if key in self.refuse else 204
        if key in self.busy:
            self.busy.discard(key)
            code = 503
        if code == 204:
            self.got[key] += 1
            self.order.append(key)
        self.send_response(code)
        self.end_headers()

    def log_message(self, *_):
        pass


@pytest.fixture
def hook():
    Hook.got, Hook.order, Hook.refuse, Hook.busy = Counter(), [], set(), set()
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Hook)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def messages(spark, base):
    rows = [(u, f"{base}/{u}", f"k{i}", i, f"m{i}") for u in ("u1", "u2", "u3") for i in range(3)] + [("u1", f"{base}/u1", "k0", 9, "m0")]
    df = spark.createDataFrame(rows, "user_id string, url string, event_key string, position long, title string")
    return df.withColumn("body", webhooks.embed(F.col("title"), F.lit("d"), {"a": F.lit(None).cast("string"), "b": F.lit(1.5)}, "f")).drop("title")


def test_a_half_sent_batch_is_not_sent_twice(spark, tmp_path, hook):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    df = messages(spark, hook)
    df.coalesce(1).write.parquet(source)
    Hook.refuse, Hook.busy = {("/u2", "m1")}, {("/u3", "m0")}
    quick = lambda url, body: webhooks.post_json(url, body, wait=0.001)

    def run():
        stream = spark.readStream.schema(df.schema).parquet(source)
        stream.writeStream.foreachBatch(webhooks.webhook_sink(state, quick)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="messages of 1 users were not taken"):
        run()
    assert sorted(Hook.got) == [("/u1", "m0"), ("/u1", "m1"), ("/u1", "m2"), ("/u2", "m0"), ("/u3", "m0"), ("/u3", "m1"), ("/u3", "m2")]
    Hook.refuse = set()
    run()
    run()
    assert len(Hook.got) == 9 and set(Hook.got.values()) == {1}
    for u in ("/u1", "/u2", "/u3"):
        assert [k[1] for k in Hook.order if k[0] == u] == ["m0", "m1", "m2"]
    df.where("user_id = 'u1'").unionByName(df.where("user_id = 'u3'").withColumn("event_key", F.lit("new"))).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sum(Hook.got.values()) == 10


def test_bodies(spark):
    holdings = spark.createDataFrame([("2330", "T", 110.0, 100.0, 10.0, [5.0, 10.0], "2024-01-05T10:00"), ("1", "U", 1.0, 1.0, 0.0, [], "x")], "symbol string, name string, price double, average_cost double, profit_pct double, new_thresholds array<double>, analyzed_at string")
    (row,) = webhooks.profit_message(holdings).collect()
    e = json.loads(row["body"])["embeds"][0]
    assert e["title"] == "2330 T" and e["description"].endswith("+5%, +10%") and e["fields"][2] == {"name": "Profit", "value": "+10.0%", "inline": True} and e["timestamp"] == "2024-01-05T10:00"
    notes = spark.createDataFrame([("NEW_CANDIDATE", "2330", "T", 97.25, None, None, 110.0, None), ("X", "1", "U", 90.0, 1.0, 2.0, 1.5, "why")], "type string, stock_id string, stock_name string, percentile double, cost_low double, cost_high double, close double, reason string")
    got = [json.loads(r["body"])["embeds"][0] for r in webhooks.candidate_message(notes, {"NEW_CANDIDATE": "New:"}).collect()]
    assert got[0]["title"] == "New: 2330 T" and [f["name"] for f in got[0]["fields"]] == ["Percentile of the day", "Close"]
    assert got[1]["title"] == "X 1 U" and got[1]["fields"][1]["value"] == "1.00 to 2.00" and got[1]["description"] == "why"
    users = spark.createDataFrame([("a",), (None,), ("z",)], "key string")
    assert [r[0] for r in users.select(webhooks.addresses('{"a": "A", "default": "D"}', "E", F.col("key"))).collect()] == ["A", "D", "E"]


def days(spark, *numbers, seq=0):
    rows = [(dt.date(2024, 1, n), f"{s:04d}", float(n), seq) for n in numbers for s in range(3)]
    whole = spark.createDataFrame(rows, "date date, stock_id string, close double, seq long")
    for c in ("volume", "money", "open", "high", "low", "foreign_net", "trust_net", "dealer_net"):
        whole = whole.withColumn(c, F.lit(1.0))
    return whole.select(*[f.split()[0] for f in daily.ROW.split(", ")]).coalesce(1)


def test_late_data(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    daily.seed_state(days(spark, 2, 3), state)

    def run(today):
        daily.run_guarded_updates(spark, source, state, str(tmp_path / "c"), lambda: today, keep_dates=3, least_stocks=2)

    statuses = lambda: [(r["status"], r["newest"].day, r["ready_to_send"]) for r in daily.batch_statuses(spark, state).orderBy("batch").collect()]
    days(spark, 4).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="is after 2024-01-01"):
        run("2024-01-01")
    with pytest.raises(Exception, match="33 days between"):
        run("2024-02-05")
    with pytest.raises(Exception, match="more than 7 days before"):
        run("2024-01-15")
    run("2024-01-05")
    assert statuses() == [("UPDATED", 4, True)]
    days(spark, 4, seq=1).write.mode("append").parquet(source)  # the same date again, another version
    run("2024-01-05")
    assert statuses()[1] == ("ALREADY_CURRENT", 4, False)
    days(spark, 5, 8).write.mode("append").parquet(source)
    run("2024-01-09")
    assert statuses()[2] == ("UPDATED", 8, True)
    assert sorted({r["date"].day for r in daily.newest_state(spark, state).collect()}) == [4, 5, 8]
