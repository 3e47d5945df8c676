"""Strict settings, guards of folds, report maps, quotes, and the logistic fit against a plain one."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidepanel.operators import models as M
from tidepanel.sources import settings as S

GOOD = {"user": {"id": "u1", "enabled": True, "discord_webhook_key": "k"}, "institutional_candidates": {"max_new_candidates": 2, "include_state_updates": False}, "stocks": [{"symbol": "2330", "average_cost": 100.5, "profit_alerts": [5, 10.5]}]}


def changed(**parts):
    out = json.loads(json.dumps(GOOD))
    for path, value in parts.items():
        *way, last = path.split("__")
        here = out
        for w in way:
            here = here[int(w)] if w.isdigit() else here[w]
        here[last] = value
    return out


def test_good_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("user:\n  id: u2\nstocks:\n  - symbol: '0050'\n    average_cost: 90\n    profit_alerts: [1, 2, 30]\n")
    (tmp_path / "b.yaml").write_text(json.dumps(GOOD))
    (tmp_path / "c.yaml").write_text(json.dumps(changed(user__enabled=False, stocks=[])))
    got = {r["user_id"]: r for r in S.user_settings(spark, str(tmp_path)).collect()}
    assert set(got) == {"u1", "u2"} and got["u1"]["max_new"] == 2 and not got["u1"]["wants_updates"] and got["u2"]["max_new"] == 6 and got["u2"]["enabled"]
    assert got["u2"]["stocks"][0].asDict() == {"symbol": "0050", "average_cost": 90.0, "profit_alerts": [1.0, 2.0, 30.0]} and got["u1"]["webhook_key"] == "k"


def test_faults(spark):
    stock = GOOD["stocks"][0]
    cases = [
        (GOOD, []),
        (changed(more=1), ["the root has unknown keys more"]),
        (changed(user__name="x", user__id=" "), ["user has unknown keys name", "user.id is missing"]),
        (changed(institutional_candidates=3), ["institutional_candidates is no object"]),
        (changed(institutional_candidates__enabled="yes", institutional_candidates__max_new_candidates=0), ["institutional_candidates.enabled is neither true nor false", "institutional_candidates.max_new_candidates is no positive integer"]),
        (changed(stocks=[]), ["stocks are missing"]),
        (changed(stocks=[stock, stock]), ["a symbol is repeated"]),
        (changed(stocks__0__average_cost=-1, stocks__0__profit_alerts=[]), ["stocks[0].average_cost is no positive number", "stocks[0].profit_alerts are missing"]),
        (changed(stocks__0__profit_alerts=[5, 5]), ["stocks[0].profit_alerts do not rise"]),
        (changed(stocks__0__profit_alerts=[5, -6], stocks__0__note=1), ["stocks[0] has unknown keys note", "stocks[0].profit_alerts hold other than positive numbers", "stocks[0].profit_alerts do not rise"]),
        (changed(stocks__0__average_cost=True), ["stocks[0].average_cost is no positive number"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, None)], "i int, s string")
    got = {r["i"]: r["f"] for r in df.select("i", S.faults(F.col("s")).alias("f")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, i
    assert got[99][0] == "not an object"


def test_faulty_folders(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(json.dumps(changed(more=1)))
    with pytest.raises(Exception, match="a.yaml: the root has unknown keys more"):
        S.user_settings(spark, str(tmp_path)).collect()
    (tmp_path / "a.yaml").write_text(json.dumps(changed(user__enabled=False)))
    with pytest.raises(ValueError, match="no enabled user"):
        S.user_settings(spark, str(tmp_path))


def test_reports_quotes_and_rules(spark, tmp_path):
    report = spark.createDataFrame([("status", "PASS"), ("ready", "1")], "metric string, value string")
    assert S.metric_map(report) == {"status": "PASS", "ready": "1"}
    S.require(report, {"status": "PASS"})
    with pytest.raises(ValueError, match="not ready: {'ready': '1'}"):
        S.require(report, {"ready": "2"})
    with pytest.raises(ValueError, match="twice"):
        S.metric_map(report.union(report))
    (tmp_path / "q.json").write_text(json.dumps({"stocks": {"2330": {"quote": {"symbol": "2330", "name": "T", "price": 5.5, "previous_close": 5.0, "as_of": "x", "raw": {}}}, "1": {}}}))
    assert S.quote_of(spark, str(tmp_path / "q.json"), "2330").first()["price"] == 5.5
    for missing in ("1", "9"):
        with pytest.raises(Exception, match=f"no quote of {missing}"):
            S.quote_of(spark, str(tmp_path / "q.json"), missing).collect()
    fold = {"minimum_training_years": 2, "calibration_years": 1, "clip_low": 0.005, "clip_high": 0.995, "penalties": (0.1, 1.0), "horizons": (5, 10)}
    assert S.checked(fold, S.FOLD_RULES) is fold
    with pytest.raises(ValueError, match="two years at least; clipping needs.*; horizons are positive"):
        S.checked(fold | {"minimum_training_years": 1, "clip_low": 0.999, "horizons": (10, 10)}, S.FOLD_RULES)


def test_folds_need_all_classes(spark):
    rows = [(1998, part, label) for part in ("train", "test") for label in ("UP", "DOWN")] + [(1998, "train", "FLAT")]
    parts = spark.createDataFrame(rows, "test_year int, part string, label string")
    assert M.require_classes(parts.where("part = 'train'"), "label", ["UP", "FLAT", "DOWN"]).count() == 3
    with pytest.raises(Exception, match="fold 1998 test lacks FLAT"):
        M.require_classes(parts, "label", ["UP", "FLAT", "DOWN"]).collect()


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_fit_is_the_minimum(spark, classes):
    """No step from Spark's weights lowers the penalised loss; a plain descent from zero ends at the same loss."""
    rng = np.random.default_rng(classes)
    x = rng.normal(size=(400, 2))
    y = np.array([rng.choice(classes, p=p / p.sum()) for p in np.exp(x @ rng.normal(size=(2, classes)) * 1.5)])
    rows = spark.createDataFrame([(float(a), float(b), int(k)) for (a, b), k in zip(x, y, strict=True)], "a double, b double, y int")
    model = M.logistic(rows, {"a": F.col("a"), "b": F.col("b")}, "y", penalty=0.01, family="multinomial")

    def loss(v):
        w = v.reshape(classes, 3)
        z = x @ w[:, :2].T + w[:, 2]
        z = z - z.max(1, keepdims=True)
        return -(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))).mean() + 0.005 * (w[:, :2] ** 2).sum()

    mine = np.column_stack([model.coefficientMatrix.toArray(), model.interceptVector.toArray()]).ravel()
    plain = np.zeros(classes * 3)
    for _ in range(1500):
        plain -= 1.0 * np.array([(loss(plain + e) - loss(plain - e)) / 2e-6 for e in np.eye(len(plain)) * 1e-6])
    assert abs(loss(mine) - loss(plain)) < 1e-5
    assert model.summary.accuracy > 1.2 / classes
