"""Data source, sinks and table maintenance."""

import http.server
import json
import threading

import pytest
from tidepanel.sources import rest, sinks, tables


class Answers(http.server.BaseHTTPRequestHandler):
    seen: dict[str, int] = {}

    def do_GET(self):
        self.seen[self.path] = n = self.seen.get(self.path, 0) + 1
        code = 402 if self.path == "/quota" else 500 if self.path == "/flaky" and n == 1 else 200
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps({"path": self.path}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_payload_source(spark, server):
    spark.dataSource.register(rest.PayloadSource)
    got = spark.read.format("payloads").options(url=server + "/{key}", keys=json.dumps(["a", "flaky", "b"]), pause="0", wait="0.01", batch="2").load()
    assert sorted((r["id"], json.loads(r["payload"])["path"]) for r in got.collect()) == [("a", "/a"), ("b", "/b"), ("flaky", "/flaky")]
    alone = spark.read.format("payloads").options(url=server + "/{key}", keys=json.dumps(["a", "b", "c"]), pause="0").load()
    assert alone.rdd.getNumPartitions() == 1 and alone.count() == 3
    with pytest.raises(rest.Quota):
        rest.fetch(server + "/quota", wait=0.01)
    assert Answers.seen["/quota"] == 1


def test_decoding():
    assert rest.decoded("﻿a".encode()) == "a" and rest.decoded("台".encode("big5")) == "台" and rest.decoded(None) is None


def test_models_and_reports(spark, tmp_path):
    sinks.save_model(spark, {"w": [1.5, -2.0]}, str(tmp_path / "m"))
    assert sinks.load_model(spark, str(tmp_path / "m")) == {"w": [1.5, -2.0]}
    sinks.write_reports({"r": spark.range(3)}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/r")).count() == 3


def test_table_maintenance(spark, tmp_path):
    schema = "k long, v string, seq long, source string"
    old = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 5, "x"), (2, "old", 4, "x")], schema)
    new = spark.createDataFrame([(2, "c", 5, "y"), (3, "d", 1, "y"), (3, "d", 1, "y")], schema)
    assert sorted((r["k"], r["v"]) for r in tables.upsert(old, new, ["k"], "seq").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(r["v"] for r in tables.insert_or_ignore(old, new, ["k"]).collect()) == ["a", "b", "d", "old"]
    assert sorted(r["v"] for r in tables.replace_range(old, new.limit(1), "seq", 4, 5, "x").collect()) == ["a", "c"]
    path = str(tmp_path / "t")
    tables.write_partitioned(old, path, ["k"])
    tables.write_partitioned(old.where("k = 2 and v = 'b'"), path, ["k"])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == ["a", "b"]
