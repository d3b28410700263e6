"""Exact quantiles, split sampling, shrinkage in resampling, least shortfall and quadratic programs, against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DAYS, panel

from meridia.functions import quantiles, solvers
from meridia.functions.quantiles import exact_quantiles
from meridia.operators import oos, optimize, planning, recommend, shortfall, strategies
from meridia.plans.panel import with_returns

PROBS = [0.0, 0.01, 0.05, 0.5, 0.95, 1.0]


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(0)
    n = 60_000
    return {
        "normal": rng.normal(size=n),
        "ties": rng.integers(0, 4, n).astype(float),
        "wide": np.exp(rng.normal(size=n) * 30),
        "sorted": np.arange(n, dtype=float),
        "half": np.r_[np.zeros(n // 2), rng.normal(size=n // 2) * 1e-9],
        "const": np.full(n, -7.0),
        "one": np.array([3.0]),
        "two": np.array([1.0, 2.0]),
    }


def frame_of(spark, sets):
    import pandas as pd

    rows = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "x": v}) for k, v in sets.items()])).repartition(8)
    return rows.union(spark.createDataFrame([("one", None), ("none", None)], "k string, x double"))


def test_exact_quantiles(spark, sets):
    rows = frame_of(spark, sets)
    got = {r.k: r for r in exact_quantiles(rows, ["k"], "x", PROBS).collect()}
    assert set(got) == set(sets)
    for k, values in sets.items():
        assert got[k].n == len(values)
        assert [got[k][f"q{i}"] for i in range(len(PROBS))] == pytest.approx(np.quantile(values, PROBS), rel=1e-12, abs=0)
    tails = {r.k: r for r in exact_quantiles(rows, ["k"], "x", PROBS, tails=True).collect()}
    for k, values in sets.items():
        want = [values[values <= np.quantile(values, p)].mean() for p in PROBS]
        assert [tails[k][f"q{i}_mean"] for i in range(len(PROBS))] == pytest.approx(want, rel=1e-9)
    everything = np.concatenate(list(sets.values()))
    assert exact_quantiles(rows, [], "x", [0.25]).first().q0 == pytest.approx(np.quantile(everything, 0.25))
    assert exact_quantiles(rows.filter("k = 'none'"), [], "x", [0.5]).first() == (None, None)
    assert exact_quantiles(rows, ["k"], "x", [0.5], interpolate=False).filter("k = 'two'").first().q0 == 1.0


def test_a_quantile_orders_few_rows(spark, sets):
    """Of a key of 60,000 values at most 1 % are ordered by the task of the key, and rows below are one group each."""
    rows = frame_of(spark, sets).filter("x IS NOT NULL")
    found = quantiles.inside(rows, quantiles.brackets(rows, ["k"], "x", [0.05, 0.95]), ["k"], "x", [0.05, 0.95]).groupBy("k").count()
    counts = {r.k: r["count"] for r in found.collect()}
    assert all(counts[k] <= 600 for k in ("normal", "wide", "sorted", "ties", "half", "const"))


@pytest.mark.parametrize("blocks", [2, 6, 16])
def test_all_splits_once(spark, blocks):
    masks = [r.split for r in oos.split_masks(spark, blocks).collect()]
    assert sorted(masks) == [m for m in range(2**blocks) if m.bit_count() == blocks // 2]


def test_sampled_splits(spark):
    masks = [r.split for r in oos.split_masks(spark, 20, 500, seed=3).collect()]
    assert len(set(masks)) == len(masks) == 500 and all(m.bit_count() == 10 for m in masks)
    assert masks == [r.split for r in oos.split_masks(spark, 20, 500, seed=3).collect()]
    assert len({r.split for r in oos.split_masks(spark, 32, 100).collect()}) == 100
    for blocks in (0, 5, 34):
        with pytest.raises(ValueError):
            oos.split_masks(spark, blocks)


@pytest.mark.parametrize(("blocks", "most"), [(6, 20_000), (8, 20_000), (20, 300)])
def test_splits_against_brute_force(spark, blocks, most):
    rng = np.random.default_rng(blocks)
    t = blocks * 6 + 3
    values = rng.normal(0.5, 0.01, (t, 3))  # far from 0: sums of squares would lose digits
    rows = spark.createDataFrame([(i, "abc"[j], float(values[i, j])) for i in range(t) for j in range(3)], "t long, config string, ret double")
    got = oos.cscv_splits(rows, blocks=blocks, most=most).collect()
    assert len(got) == 3 * min(math.comb(blocks, blocks // 2), most)
    size = t // blocks
    for r in got[:: max(1, len(got) // 200)]:
        inside = np.array([bool(r.split >> b & 1) for b in range(blocks)]).repeat(size)
        x = values[: size * blocks, "abc".index(r.config)]
        for part, value in ((x[inside], r.is_sharpe), (x[~inside], r.oos_sharpe)):
            assert value == pytest.approx(part.mean() / part.std(ddof=1) * math.sqrt(252), rel=1e-9)


def ledoit_wolf(x):
    """Intensity and covariance a period, date by date."""
    n, k = x.shape
    c = x - x.mean(axis=0)
    s = c.T @ c / n
    sd = np.sqrt(np.diag(s))
    rbar = (s / np.outer(sd, sd))[~np.eye(k, dtype=bool)].mean()
    f = rbar * np.outer(sd, sd)
    np.fill_diagonal(f, np.diag(s))
    pi = sum((np.outer(r, r) - s) ** 2 for r in c) / n
    rho = np.trace(pi)
    for i, j in itertools.permutations(range(k), 2):
        ti = sum((r[i] ** 2 - s[i, i]) * (r[i] * r[j] - s[i, j]) for r in c) / n
        tj = sum((r[j] ** 2 - s[j, j]) * (r[i] * r[j] - s[i, j]) for r in c) / n
        rho += rbar / 2 * (sd[j] / sd[i] * ti + sd[i] / sd[j] * tj)
    delta = min(max((pi.sum() - rho) / ((f - s) ** 2).sum() / n, 0), 1)
    return delta, delta * f + (1 - delta) * s


@pytest.mark.parametrize(("days", "symbols"), [(60, "ABC"), (150, "ABCDE"), (40, "ABCD")])
def test_each_resampling_is_shrunk_by_itself(spark, days, symbols):
    import hashlib

    returns = with_returns(panel(spark, days, symbols))
    rows = returns.filter("ret IS NOT NULL").orderBy("date", "symbol").collect()
    dates = sorted({r.date for r in rows})
    x = np.array([r.ret for r in rows]).reshape(len(dates), len(symbols))
    got = {r.sample: r for r in optimize.bootstrap_shrinkage(returns, samples=6, seed=5).collect()}
    weights = []
    for sample in range(1, 7):
        u = [int(hashlib.md5(f"5:{sample}:{d}".encode()).hexdigest()[:13], 16) / 2**52 for d in dates]
        times = [sum(v > p for p in optimize.POISSON) for v in u]
        drawn = x.repeat(times, axis=0)
        delta, cov = ledoit_wolf(drawn)
        assert got[sample].n == len(drawn) and got[sample].delta == pytest.approx(delta, abs=1e-9)
        weights.append(solvers.min_variance(cov * 252))
    shrunk = {r.symbol: r.weight for r in optimize.bootstrapped(returns, samples=6, seed=5).collect()}
    assert list(dict(sorted(shrunk.items())).values()) == pytest.approx(np.mean(weights, axis=0), abs=1e-9)
    plain = {r.symbol: r.weight for r in optimize.bootstrapped(returns, samples=6, seed=5, estimator="sample").collect()}
    assert sum(plain.values()) == pytest.approx(1) and max(abs(plain[s] - shrunk[s]) for s in symbols) > 1e-6


def test_too_few_dates_to_resample(spark):
    returns = with_returns(panel(spark, 4, "ABCD"))
    initial = spark.createDataFrame([("A", 3.0), ("B", 1.0), ("Z", 9.0)], "symbol string, weight double")
    assert {r.symbol: r.weight for r in optimize.bootstrapped(returns, initial=initial).collect()} == {"A": 0.75, "B": 0.25}
    assert {r.weight for r in optimize.bootstrapped(returns).collect()} == {0.25}


def least_by_corners(returns, confidence, cap=1.0):
    """The least shortfall over all corners: dates that change places, and limits."""
    t, n = returns.shape
    most = math.floor((t - 1) * (1 - confidence)) + 1
    planes = [(returns[a] - returns[b], 0.0) for a in range(t) for b in range(a)] + [(e, x) for e in np.eye(n) for x in (0.0, cap)]
    corners = []
    for chosen in itertools.combinations(planes, n - 1):
        a, b = np.array([p for p, _ in chosen] + [np.ones(n)]), np.array([v for _, v in chosen] + [1.0])
        if abs(np.linalg.det(a)) > 1e-14:
            w = np.linalg.solve(a, b)
            if w.min() > -1e-12 and w.max() < cap + 1e-12:
                corners.append(w)
    values = -np.sort(returns @ np.array(corners).T, axis=0)[:most].mean(axis=0)
    return values.min()


@pytest.mark.parametrize(("t", "n", "confidence", "cap"), [(60, 2, 0.95, 1.0), (17, 3, 0.8, 1.0), (17, 3, 0.8, 0.45)])
def test_least_shortfall(spark, t, n, confidence, cap):
    rng = np.random.default_rng(t)
    returns = rng.normal(0.001, 0.02, (t, n)) @ rng.normal(size=(n, n))
    want = least_by_corners(returns, confidence, cap)
    here = shortfall.least(shortfall.tails_of(returns, confidence), solvers.Limits(n, high=cap))
    assert here.value == pytest.approx(want, abs=1e-8) and here.bound <= want + 1e-9 and here.weights.max() <= cap + 1e-9
    rows = spark.createDataFrame([(DAYS[i], "ABC"[j], float(returns[i, j])) for i in range(t) for j in range(n)], "date date, symbol string, ret double").repartition(3)
    found = shortfall.min_shortfall(rows, confidence=confidence, limiter=lambda s: solvers.Limits(len(s), high=cap)).collect()
    assert found[0].shortfall == pytest.approx(want, abs=1e-8) and sum(r.weight for r in found) == pytest.approx(1)


def test_shortfall_with_equal_dates_and_none(spark):
    returns = np.repeat([[0.01, -0.02], [-0.03, 0.01], [0.0, 0.0]], 10, axis=0)
    assert shortfall.least(shortfall.tails_of(returns, 0.9), solvers.Limits(2)).value == pytest.approx(least_by_corners(returns[::3], 0.9), abs=1e-9)
    assert shortfall.min_shortfall(spark.createDataFrame([], "date date, symbol string, ret double")).count() == 0


def test_quadratic_programs_meet_their_conditions():
    """Gradients are equal where a weight is between its limits, and point outwards at them."""
    rng = np.random.default_rng(4)
    for n in (2, 5, 30):
        a = rng.normal(size=(n, n + 3))
        cov, mu = a @ a.T / 100, rng.normal(size=n) / 10
        w = solvers.solve_qp(cov, -mu, solvers.Limits(n, high=0.6))
        g = cov @ w - mu
        free = (w > 1e-8) & (w < 0.6 - 1e-8)
        level = g[free].mean() if free.any() else np.median(g)
        assert w.sum() == pytest.approx(1) and abs(g[free] - level).max(initial=0) < 1e-8
        assert (g[w <= 1e-8] >= level - 1e-8).all() and (g[w >= 0.6 - 1e-8] <= level + 1e-8).all()
    with pytest.raises(ValueError):
        solvers.solve_qp(np.eye(3), np.zeros(3), solvers.Limits(3, high=0.2))


def test_overlay_of_a_schedule(spark):
    """One row a date and symbol, those of the weights in force; a base without a symbol gives it nothing."""
    prices = panel(spark, 120)
    schedule = spark.createDataFrame([(DAYS[30], "A", 1.0), (DAYS[60], "A", 0.5), (DAYS[60], "B", 0.5)], "eff_date date, symbol string, weight double")
    rows = strategies.vol_overlay(lambda p: schedule, lookback=10)(prices).collect()
    assert len({(r.eff_date, r.symbol) for r in rows}) == len(rows) == 3 * 90 and min(r.eff_date for r in rows) == DAYS[30]
    weight = {(r.eff_date, r.symbol): r.weight for r in rows}
    assert all(weight[d, "A"] == pytest.approx(1) for d in DAYS[30:60])
    assert all(0 < weight[d, "A"] < 1 and weight[d, "C"] == 0 for d in DAYS[60:120])
    static = strategies.vol_overlay(strategies.fixed({"A": 0.5, "B": 0.5}), lookback=10)(prices).collect()
    after = {(r.eff_date, r.symbol): r.weight for r in static}
    assert all(weight[d, "A"] == pytest.approx(after[d, "A"]) for d in DAYS[60:120])


def test_objectives(spark):
    prices = panel(spark, 200)
    variance = recommend.recommend(prices, method="optimize", objective=optimize.variance)
    named = {r.symbol: r.weight for r in recommend.recommend_weights(prices, method="min_variance").collect()}
    assert {r.symbol: r.weight for r in variance.weights.collect()} == pytest.approx(named, abs=1e-5)
    assert variance.evidence["objective"] == "variance" and variance.evidence["uses_return_forecast"] and "Sharpe" in variance.evidence["rationale"]
    default = recommend.recommend(prices, method="optimize", estimator="ledoit_wolf")
    assert 0 <= default.evidence["shrinkage"] <= 1 and "shrunk" in default.evidence["rationale"]
    profile = planning.Profile(max_weight=0.5)
    tails = recommend.recommend(prices, method="cvar", profile=profile)
    assert max(r.weight for r in tails.weights.collect()) <= 0.5 + 1e-9 and "worst 5%" in tails.evidence["rationale"]


@pytest.mark.parametrize("method", ["min_variance", "cvar"])
def test_validation_uses_what_the_advice_uses(spark, method):
    prices = panel(spark, 300)
    current = spark.createDataFrame([("A", 1.0)], "symbol string, weight double")
    options = {"train_days": 120, "step_days": 60, "current": current}
    plain = recommend.walk_forward(prices, method, **options).first()
    alone = recommend.walk_forward(prices, "equal_weight", train_days=120, step_days=60).first()
    assert plain.windows == alone.windows >= 3 and plain.baseline_sharpe is not None and alone.baseline_sharpe is None
    if method == "min_variance":
        shrunk = recommend.walk_forward(prices, method, estimator="ledoit_wolf", **options).first()
        assert shrunk.oos_sharpe != plain.oos_sharpe and shrunk.baseline_sharpe == pytest.approx(plain.baseline_sharpe)


def test_tracking(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.01, (80, 3))
    bench = x @ [0.2, 0.5, 0.3] + rng.normal(0, 1e-4, 80)
    returns = spark.createDataFrame([(DAYS[i], "ABC"[j], float(x[i, j])) for i in range(80) for j in range(3) if (i, j) != (5, 1)], "date date, symbol string, ret double")
    marks = spark.createDataFrame([(DAYS[i], float(bench[i])) for i in range(79)], "date date, bench double")
    got = optimize.tracking(returns, marks).collect()
    kept = [i for i in range(79) if i != 5]
    w = np.array([r.weight for r in sorted(got, key=lambda r: r.symbol)])
    assert w == pytest.approx([0.2, 0.5, 0.3], abs=0.02) and w.sum() == pytest.approx(1)
    assert got[0].tracking_error == pytest.approx((x[kept] @ w - bench[kept]).std(ddof=1) * math.sqrt(252), rel=1e-9)
    for v in rng.dirichlet(np.ones(3), 500):
        assert (x[kept] @ v - bench[kept]).std() >= (x[kept] @ w - bench[kept]).std() - 1e-12
    capped = optimize.tracking(returns, marks, limiter=lambda s: solvers.Limits(len(s), high=0.4)).collect()
    assert max(r.weight for r in capped) == pytest.approx(0.4)


def test_books_without_a_sum_and_weights_over_time(spark):
    from meridia.operators import engine

    prices = panel(spark, 50)
    short = spark.createDataFrame([("s", "A", 1.0), ("s", "B", -1.0)], "strategy string, symbol string, weight double")
    with pytest.raises(Exception, match="more than 0: s"):
        engine.simulate(prices, short)[0].collect()
    schedule = spark.createDataFrame([("s", DAYS[10], "A", 0.5), ("s", DAYS[10], "B", 0.5), ("s", DAYS[30], "A", 1.0)], "strategy string, eff_date date, symbol string, weight double")
    rows = engine.weight_history(prices, schedule).collect()
    weight = {(r.date, r.symbol): r.weight for r in rows}
    price = {(r.date, r.symbol): r.price for r in prices.collect()}
    for d in DAYS[10:30]:
        a, b = (0.5 * price[d, s] / price[DAYS[10], s] for s in "AB")
        assert weight[d, "A"] == pytest.approx(a / (a + b)) and weight[d, "A"] + weight[d, "B"] == pytest.approx(1)
    assert weight[DAYS[30], "A"] == 1 == pytest.approx(weight[DAYS[49], "A"]) and min(d for d, _ in weight) == DAYS[10]
    wealth, blotter = engine.simulate(prices, schedule, commission_bps=5.0)
    row = engine.summary(wealth, blotter).first()
    values = [r.value for r in wealth.orderBy("date").collect()]
    assert row.terminal_wealth == pytest.approx(values[-1]) and row.rebalances == 2
    assert row.max_drawdown == pytest.approx(min(v / max(values[: i + 1]) - 1 for i, v in enumerate(values)))
