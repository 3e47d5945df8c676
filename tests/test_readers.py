"""Readers refuse what isn't sound, and the look-ahead probe finds what looks ahead."""

import gzip
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F
from tidepanel.operators import leakage
from tidepanel.operators.samples import feature_names
from tidepanel.sources import readers as R
from tidepanel.sources import sinks

HEAD = [f.strip().split(" ")[0] for f in R.ROLLING.split(",")]


def rolling(folder, rows, head=HEAD):
    with gzip.open(folder / "rolling_market_data.csv.gz", "wt") as f:
        f.write(",".join(head) + "\n" + "\n".join(",".join(map(str, r)) for r in rows) + "\n")


def test_rolling_state(spark, tmp_path):
    with pytest.raises(ValueError, match="is missing"):
        R.rolling_state(spark, str(tmp_path))
    row = lambda day, stock: [day, stock, "n", *[1.5] * 10]
    rolling(tmp_path, [row("2024-01-02", "0050"), row("2024-01-03", "0050"), row("soon", "0051")], HEAD[:2] + HEAD[2:])
    (tmp_path / "universe.csv").write_text("﻿listing_date,noise,stock_id,stock_name\n2001-01-01,x,0050,a\n,y,0051,b\n", "utf-8")
    rows, universe, newest = R.rolling_state(spark, str(tmp_path))
    assert newest == "2024-01-03" and rows.count() == 2 and rows.first()["stock_id"] == "0050"
    assert [r["listing_date"] is None for r in universe.orderBy("stock_id").collect()] == [False, True]
    rolling(tmp_path, [row("2024-01-02", "0050")] * 2)
    with pytest.raises(Exception, match="rows repeat 0050 2024-01-02"):
        R.rolling_state(spark, str(tmp_path))[0].collect()
    rolling(tmp_path, [row("x", "0050")])
    with pytest.raises(ValueError, match="no market date"):
        R.rolling_state(spark, str(tmp_path))
    rolling(tmp_path, [row("2024-01-02", "0050")[:-1]], HEAD[:-1])
    with pytest.raises(ValueError, match="lacks the columns selected_total_net"):
        R.rolling_state(spark, str(tmp_path))


def test_lists(spark, tmp_path):
    place = tmp_path / "l.csv"
    place.write_text("why,stock_id\nbig, 2330 \nold,0050\n")
    assert sorted(map(tuple, R.listed(spark, str(place), ("stock_id", "why")).collect())) == [("0050", "old"), ("2330", "big")]
    place.write_text("why,stock_id\nbig,2330\nold, 2330\n")
    with pytest.raises(Exception, match="rows repeat 2330"):
        R.listed(spark, str(place), ("stock_id", "why")).collect()
    place.write_text("why,stock_id\nbig,  \n")
    with pytest.raises(Exception, match="a row without stock_id"):
        R.listed(spark, str(place), ("stock_id",)).collect()
    with pytest.raises(ValueError, match="lacks the columns market"):
        R.listed(spark, str(place), ("stock_id", "market"))


def test_deployed_models(spark, tmp_path):
    good = {"features": ["a", "b"], "low": [0.0, -1.0], "high": [10.0, 1.0], "mean": [1.0, 0.0], "std": [2.0, 1.0], "weights": [0.5, -1.0], "intercept": 0.25}
    place = str(tmp_path / "m")

    def load(**changed):
        sinks.save_model(spark, good | changed, place)
        return R.deployed_model(spark, place)

    score = spark.createDataFrame([(100.0, -5.0)], "a double, b double").select(R.deployed_score(load())).first()[0]
    assert score == pytest.approx(0.25 + 0.5 * (10 - 1) / 2 + 1.0)
    for changed, said in (({"std": [0.0, 1.0]}, "deviation"), ({"mean": [1.0]}, "one number a feature"), ({"weights": [float("inf"), 1.0]}, "not finite"), ({"low": [11.0, 0.0]}, "bounds that cross"), ({"features": ["a", "a"]}, "one number a feature")):
        with pytest.raises(ValueError, match=said):
            load(**changed)
    sinks.save_model(spark, {"features": []}, place)
    with pytest.raises(ValueError, match="lacks low, high"):
        R.deployed_model(spark, place)


def test_quota():
    told = {}

    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(told["code"])
            self.end_headers()
            self.wfile.write(told["body"].encode())

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_port}/"
    for code, body, want in ((200, json.dumps({"user_count": 5, "api_request_limit": "600"}), 595), (200, json.dumps({"user_count": 700, "api_request_limit": 600}), 0), (200, json.dumps({"user_count": 7}), None)):
        told.update(code=code, body=body)
        assert R.quota_left(url)["remaining"] == want
    for code, body in ((500, ""), (200, "x"), (200, "[]"), (200, "{}"), (200, json.dumps({"user_count": "many"}))):
        told.update(code=code, body=body)
        assert R.quota_left(url) is None
    s.shutdown()
    s.server_close()
    assert R.quota_left(url, timeout=0.5) is None


def test_names_of_features():
    assert leakage.name_issues(feature_names(), 40) == []
    assert leakage.name_issues(["a_flow_pct_40d", "b", "b", "future_x", "dealer_hedging_1d"], 4) == ["future_x holds future", "dealer_hedging_1d holds hedging", "b is repeated", "a_flow_pct_40d looks back 40 days", "5 features, not 4"]


def test_look_ahead(spark):
    from tidepanel.operators.features import by_date

    panel = spark.createDataFrame([(s, i, float(i + 1)) for s in "ab" for i in range(10)], "stock_id string, idx long, v double")
    made = lambda p: p.withColumns({"back": F.sum("v").over(by_date().rowsBetween(-3, 0)), "ahead": F.lead("v", 2).over(by_date())})
    assert {r["feature"]: r["rows"] for r in leakage.look_ahead(panel, made, ["back", "ahead"], 4, ["v"]).collect()} == {"back": 0, "ahead": 4}
