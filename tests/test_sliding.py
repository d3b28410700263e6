"""Least squares of series far from 0, in all rows and in windows, against numpy's."""

import numpy as np
import pytest
from test_operators import DAYS

from meridia.operators import factors


@pytest.mark.parametrize("level", [0.0, 1e6])
@pytest.mark.parametrize("window", [7, 30])
def test_windows_keep_their_digits(spark, level, window):
    rng = np.random.default_rng(window)
    rows, data = [], {}
    for key in "pq":
        n = 100 if key == "p" else 64
        x = rng.normal(level, 1, (n, 2))
        y = 0.5 + (x - level) @ [1.2, -0.7] + rng.normal(0, 0.3, n)
        data[key] = x, y
        rows += [(DAYS[i], key, float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(n)]
    frame = spark.createDataFrame(rows, "date date, symbol string, a double, b double, y double").repartition(5)
    got = factors.rolling_regression(frame, "symbol", x=["a", "b"], window=window).collect()
    assert len(got) == sum(len(y) - window for _, y in data.values())
    for r in got:
        x, y = data[r.symbol]
        i = DAYS.index(r.date)
        near = x[i - window : i]
        want = np.linalg.lstsq(np.column_stack([np.ones(window), near - near.mean(axis=0)]), y[i - window : i], rcond=None)[0]
        assert (r.beta_a, r.beta_b) == pytest.approx(tuple(want[1:]), abs=1e-8)
    whole = {r.symbol: r for r in factors.regression(frame, "symbol", x=["a", "b"]).collect()}
    for key, (x, y) in data.items():
        want = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x - x.mean(axis=0)]), y, rcond=None)[0]
        assert (whole[key].beta_a, whole[key].beta_b) == pytest.approx(tuple(want[1:]), abs=1e-8)
        assert whole[key].n == len(y) and 0 < whole[key].r2 < 1


def test_dependent_and_constant_factors(spark):
    rows = [(DAYS[i], "s", float(i % 7), 2.0 * (i % 7) + 1, 5.0, float(i)) for i in range(40)]
    frame = spark.createDataFrame(rows, "date date, symbol string, a double, b double, c double, y double")
    for x in (["a", "b"], ["a", "c"]):
        assert factors.rolling_regression(frame, "symbol", x=x, window=10).count() == 0
        row = factors.regression(frame, "symbol", x=x).first()
        assert row.n == 40 and row.alpha is None
    assert factors.rolling_regression(frame, "symbol", x=["a"], window=10).count() == 30
    assert factors.rolling_regression(frame.limit(0), "symbol", x=["a"], window=10).count() == 0
    assert factors.regression(frame.limit(0), "symbol", x=["a"]).count() == 0
