"""Downloads that stop and go on: each key is asked once, quota puts off the rest, coverage holds publishing back."""

import datetime as dt
import http.server
import json
import threading
import urllib.parse
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tidepanel.streaming import ingest

TARGET = "2024-03-08"
DATASETS = {"prices": "service", "flows": "service"}
SCHEMAS = {"prices": "stock_id: string, date: date, close: double", "flows": "stock_id: string, date: date, net: double"}


class Service(http.server.BaseHTTPRequestHandler):
    asked: Counter = Counter()
    quota, broken, short = 10**9, set(), set()

    def do_GET(self):
        q = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
        key = (q["dataset"], q["stock_id"])
        code = 402 if sum(self.asked.values()) >= Service.quota else 404 if key in self.broken else 200
        if code != 402:
            self.asked[key] += 1
        self.send_response(code)
        self.end_headers()
        last = dt.date.fromisoformat(q["end"]) - dt.timedelta(key[1] in self.short)
        days = (last - dt.date.fromisoformat(q["start"])).days + 1
        name = {"prices": "close", "flows": "net"}[q["dataset"]]
        self.wfile.write(json.dumps([{"stock_id": q["stock_id"], "date": str(last - dt.timedelta(i)), name: float(i)} for i in range(days)]).encode() if code == 200 else b"")

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    Service.asked, Service.quota, Service.broken, Service.short = Counter(), 10**9, set(), set()
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/?dataset={{dataset}}&stock_id={{stock_id}}&start={{start}}&end={{end}}"
    s.shutdown()


def run(spark, state, url, n=6, **more):
    universe = spark.createDataFrame([(f"{i:04d}", "2024-03-05" if i == 0 else "2020-01-01") for i in range(n)], "stock_id string, listing_date string").withColumn("listing_date", F.to_date("listing_date"))
    return ingest.download(spark, state, universe, DATASETS, SCHEMAS, TARGET, url, **{"warm_up": 7, "stocks": 2, "pause": 0.0, "wait": 0.001} | more)


def test_stopped_between_batches(spark, tmp_path, service):
    state = str(tmp_path / "s")

    def stop(n):
        if n == 2:
            raise RuntimeError("machine gone")

    with pytest.raises(Exception, match="machine gone"):
        run(spark, state, service, before_batch=stop)
    assert 0 < len(Service.asked) < 12 and ingest.published_version(spark, state) is None
    assert run(spark, state, service) == ingest.READY
    assert set(Service.asked.values()) == {1} and len(Service.asked) == 12
    assert ingest.published_version(spark, state) == 1
    prices = ingest.stored(spark, state, "prices", SCHEMAS["prices"], 1)
    assert prices.where("stock_id = '0000'").count() == 4 and prices.where("stock_id = '0001'").count() == 8
    assert run(spark, state, service) == ingest.READY and sum(Service.asked.values()) == 12
    history = ingest.batch_history(ingest.read_outcomes(spark, state)).orderBy("round", "batch").collect()
    assert [r["completed_after"] for r in history][-1] == 12 and sum(r["asked"] for r in history) == 12


def test_quota_stops_and_a_later_round_goes_on(spark, tmp_path, service):
    state = str(tmp_path / "s")
    Service.quota = 5
    assert run(spark, state, service) == ingest.INCOMPLETE
    assert sum(Service.asked.values()) == 5 and ingest.published_version(spark, state) is None
    statuses = Counter(r["status"] for r in ingest.read_outcomes(spark, state).collect())
    assert statuses == {"complete": 5, "quota_exceeded": 1, "deferred": 6}

    def more():
        Service.quota += 5

    more()
    assert run(spark, state, service, rounds=5, on_quota=more) == ingest.READY
    assert set(Service.asked.values()) == {1} and len(Service.asked) == 12
    assert ingest.published_version(spark, state) == 3


def test_failures_are_kept_and_tried_again_later(spark, tmp_path, service):
    state = str(tmp_path / "s")
    Service.broken = {("flows", "0003")}
    assert run(spark, state, service, rounds=3) == ingest.INCOMPLETE
    failed = ingest.read_outcomes(spark, state).where("status = 'failed'").collect()
    assert [(r["dataset"], r["stock_id"]) for r in failed] == [("flows", "0003")] and "404" in failed[0]["error"]
    Service.broken = set()
    assert run(spark, state, service) == ingest.READY
    assert all(n == 1 for k, n in Service.asked.items() if k != ("flows", "0003"))


def test_coverage_holds_publishing_back(spark, tmp_path, service):
    state = str(tmp_path / "s")
    Service.short = {"0001", "0002"}
    assert run(spark, state, service) == ingest.BLOCKED and ingest.published_version(spark, state) is None
    assert run(spark, state, service, least=0.6) == ingest.READY and ingest.published_version(spark, state) == 1
