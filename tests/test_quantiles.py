"""Exact quantiles against numpy, over sizes, ties, nulls and extreme values."""

import numpy as np
import pytest
from tidepanel.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.005, 0.2, 0.5, 0.99, 1.0]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 1000, 60_000])
def test_equal_to_numpy(spark, n):
    random = np.random.default_rng(n)
    groups = {"wide": random.standard_cauchy(n) * 1e6, "ties": random.integers(0, 3, n).astype(float), "same": np.full(n, 2.5)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("wide", None), ("ties", float("nan")), ("none", None)]
    got = {r["g"]: r["q"] for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(6), "v", PROBS, ("g",)).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert np.allclose(got[g], np.quantile(x, PROBS), rtol=1e-12, atol=0)


def test_without_groups_and_with_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "g int, v double")
    assert exact_quantiles(df, "v", [0.5]).first()["q"] == [3.0]
    assert {r["g"]: r["q"] for r in exact_quantiles(df, "v", [0.25], ("g",)).collect()} == {None: [1.5], 1: [5.0]}
    assert exact_quantiles(df.where("v > 9"), "v", [0.5], ("g",)).collect() == []
    assert exact_quantiles(df.where("v > 9"), "v", [0.5]).first()["q"] == []
