import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridia.functions import metrics, solvers
from meridia.operators import engine, oos, planning, report, series, signals, simulate
from meridia.plans.panel import with_returns
from meridia.sources import providers

DAYS = [d.date() for d in pd.bdate_range("2021-01-01", periods=300)]


def panel(spark, n=300, symbols="ABC", seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k, s in enumerate(symbols):
        price = 100 * np.exp(np.cumsum(rng.normal(0.0003 + 0.0001 * k, 0.01 + 0.002 * k, n)))
        rows += [(DAYS[i], s, float(price[i])) for i in range(n)]
    return spark.createDataFrame(rows, "date date, symbol string, price double")


def wide(frame, value):
    return frame.toPandas().pivot(index="date", columns="symbol", values=value)


def test_drawdown_goldens(spark):
    values = [1.0, 1.1, 0.99, 1.05, 1.21, 1.0]
    frame = spark.createDataFrame([(DAYS[i], "s", v) for i, v in enumerate(values)], "date date, strategy string, value double")
    curve = series.drawdown_curve(frame, "strategy")
    assert curve.agg(F.min("dd")).first()[0] == pytest.approx(-0.1735537, abs=1e-6)
    episodes = series.drawdown_episodes(curve, "strategy").orderBy("episode").collect()
    assert [(r.peak_date, r.trough_date, r.recovery_date) for r in episodes] == [(DAYS[1], DAYS[2], DAYS[4]), (DAYS[4], DAYS[5], None)]


def test_metric_goldens(spark):
    frame = spark.createDataFrame([(DAYS[i], "a", 0.01) for i in range(252)] + [(DAYS[0], "b", 1.0), (DAYS[1], "b", -0.5), (DAYS[0], "c", -0.05), (DAYS[1], "c", 0.021)], "date date, symbol string, ret double")
    rows = {r.symbol: r for r in metrics.summary_metrics(frame, "symbol").collect()}
    assert rows["a"].cagr == pytest.approx(1.01**252 - 1)
    assert rows["b"].max_drawdown == pytest.approx(-0.5)
    assert rows["c"].max_drawdown == pytest.approx(-0.05)
    assert rows["a"].sharpe is None or abs(rows["a"].sharpe) > 1e6  # no spread at all


def test_turnover_and_costs(spark):
    before = spark.createDataFrame([("s", "A", 0.5), ("s", "B", 0.5)], "strategy string, symbol string, weight double")
    after = spark.createDataFrame([("s", "A", 0.7), ("s", "B", 0.3)], before.schema)
    row = engine.turnover(before, after).first()
    assert (row.one_way, row.buys, row.sells) == pytest.approx((0.2, 0.2, 0.2))
    one = spark.createDataFrame([("s", "A", 1.0)], before.schema)
    assert engine.turnover(one, before).first().one_way == pytest.approx(0.5)
    cost = spark.range(1).select(engine.trade_cost(F.lit(0.4), 10.0, 20.0)).first()[0]
    assert cost == pytest.approx(0.0008)


def loop(prices, weights, flags, rate, drag):
    value, held, out = 1.0, None, []
    for i in range(len(prices)):
        if i:
            r = prices[i] / prices[i - 1] - 1
            value *= (1 + held @ r) * (1 - drag / 252)
            held = held * (1 + r) / (held @ (1 + r))
        if flags[i]:
            now = np.zeros(len(weights)) if held is None else held
            value *= 1 - rate * abs(weights - now).sum()
            held = weights.copy()
        out.append(value)
    return out


@pytest.mark.parametrize(("mode", "weights"), [("M", (0.5, 0.3, 0.2)), (7, (0.6, 0.3, 0.2)), (None, (0.2, 0.3, 0.5))])
def test_wealth_equals_day_loop(spark, mode, weights):
    frame = panel(spark, 120)
    target = spark.createDataFrame([("x", s, w) for s, w in zip("ABC", weights, strict=True)], "strategy string, symbol string, weight double")
    wealth, blotter = engine.simulate(frame, target, mode=mode, commission_bps=10, spread_bps=20, cash_drag=0.02)
    got = [r.value for r in wealth.orderBy("date").collect()]
    prices = wide(frame, "price").to_numpy()
    months = [d.month for d in DAYS[:120]]
    flags = [i == 0 or (mode == "M" and months[i] != months[i - 1]) or (isinstance(mode, int) and i % mode == 0) for i in range(120)]
    assert got == pytest.approx(loop(prices, np.array(weights), flags, 0.002, 0.02), rel=1e-12)
    assert blotter.orderBy("date").first().turnover == pytest.approx(sum(weights) / 2)
    with pytest.raises(ValueError):
        engine.simulate(frame, target, mode="W")


def test_schedule_starts_with_its_first_date(spark):
    frame = panel(spark, 60, "AB")
    schedule = spark.createDataFrame([("x", DAYS[10], "A", 1.0), ("x", DAYS[30], "B", 1.0)], "strategy string, eff_date date, symbol string, weight double")
    wealth = engine.simulate(frame, schedule)[0].orderBy("date").collect()
    prices = wide(frame, "price").to_numpy()
    assert len(wealth) == 50
    assert wealth[-1].value == pytest.approx(prices[30, 0] / prices[10, 0] * prices[59, 1] / prices[30, 1])


def test_volatility_golden_and_ewma(spark):
    rets = [0.01, -0.01, 0.02, -0.02, 0.01]
    frame = spark.createDataFrame([(DAYS[i], "A", r) for i, r in enumerate(rets)], "date date, symbol string, ret double")
    rows = signals.trailing_volatility(frame, lookback=3, method="simple", annualize=False).orderBy("date").collect()
    assert [rows[0].vol, rows[1].vol] == [None, None] and rows[2].vol == pytest.approx(0.0152752523)
    frame = with_returns(panel(spark, 300, "A"))
    got = signals.trailing_volatility(frame, lookback=3, annualize=False).orderBy("date").toPandas()
    want = got["ret"].ewm(span=3, adjust=False, min_periods=3).std(bias=False)
    assert np.allclose(got["vol"].to_numpy(float), want, equal_nan=True, rtol=1e-9)
    with pytest.raises(ValueError):
        signals.trailing_volatility(frame, method="other")


@pytest.mark.parametrize("build", [lambda p: signals.momentum_signal(p, lookback=20, skip=3), lambda p: signals.crossover_signal(p, fast=5, slow=20), lambda p: signals.reversion_signal(p), lambda p: signals.momentum_score(p, lookback=20, skip=3)])
def test_signals_do_not_look_ahead(spark, build):
    frame = panel(spark, 80)
    cut = DAYS[60]
    other = frame.withColumn("price", F.when(F.col("date") > F.lit(cut), F.col("price") * 3 - 50).otherwise(F.col("price")))
    value = build(frame).columns[-1]
    before = lambda x: wide(build(x).filter(F.col("date") <= F.lit(cut)), value)
    pd.testing.assert_frame_equal(before(frame), before(other))
    assert before(frame).notna().to_numpy().any()


def test_normal_cdf(spark):
    zs = [-8.0, -5.5, -3.0, -1.0, 0.0, 0.5, 2.0, 4.9, 6.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(oos.normal_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-z / math.sqrt(2)) for z in zs], abs=1e-8)


def test_overfitting_goldens(spark):
    row = spark.range(1).select(oos.overfitting_score(F.lit(2.0), F.lit(1.0)), oos.overfitting_score(F.lit(1.0), F.lit(2.0))).first()
    assert tuple(row) == (0.5, 0.0)
    rng = np.random.default_rng(3)
    rows = [(t, f"c{c}", float(rng.normal(0.01 if c == 2 else 0.0, 0.01))) for t in range(160) for c in range(5)]
    frame = spark.createDataFrame(rows, "t long, config string, ret double")
    assert oos.overfitting_probability(oos.cscv_splits(frame)).first().splits == 12_870  # 16 blocks unless others are asked for
    splits = oos.cscv_splits(frame, blocks=8)
    result = oos.overfitting_probability(splits).first()
    assert result.splits == 70 and result.pbo < 0.05
    with pytest.raises(ValueError):
        oos.cscv_splits(splits, blocks=5)


def random_cov(n, seed):
    a = np.random.default_rng(seed).normal(size=(n, n))
    return a @ a.T + 0.01 * np.eye(n)


@pytest.mark.parametrize("seed", range(6))
def test_solvers(seed):
    n = 2 + seed
    cov = random_cov(n, seed)
    w = solvers.min_variance(cov)
    assert w.sum() == pytest.approx(1) and w.min() > -1e-8
    slope = cov @ w
    held = w > 1e-6
    assert np.allclose(slope[held], slope[held].mean(), rtol=1e-5) and (slope[~held] >= slope[held].mean() - 1e-6).all()
    rp = solvers.risk_budget(cov)
    assert solvers.risk_shares(rp, cov) == pytest.approx(np.full(n, 1 / n), abs=1e-8)
    hrp = solvers.hierarchical_risk_parity(cov)
    assert hrp.sum() == pytest.approx(1) and hrp.min() >= 0
    sd = np.sqrt(np.diag(cov))
    md = solvers.max_diversification(cov)
    ratio = lambda x: x @ sd / np.sqrt(x @ cov @ x)
    assert md.sum() == pytest.approx(1) and ratio(md) >= ratio(np.full(n, 1 / n)) - 1e-9
    mu = np.random.default_rng(seed + 50).normal(0.1, 0.05, n)
    ms = solvers.max_sharpe(mu, cov)
    sharpe = lambda x: (x @ mu - 0.02) / np.sqrt(x @ cov @ x)
    assert ms.min() > -1e-7 and sharpe(ms) >= max(sharpe(e) for e in np.eye(n)) - 1e-6


def test_covariance_checks():
    for bad in ([[1, np.nan], [np.nan, 1]], [[1, 0.5], [0.1, 1]], [[1, 2], [2, 1]]):
        with pytest.raises(ValueError):
            solvers.check_covariance(np.array(bad, float))
    prior, cov = np.array([0.1, 0.2]), np.array([[0.04, 0.01], [0.01, 0.09]])
    mean, spread = solvers.black_litterman(prior, cov, np.zeros((0, 2)), np.zeros(0), np.zeros(0))
    assert mean == pytest.approx(prior) and spread == pytest.approx(1.05 * cov)
    moved, _ = solvers.black_litterman(prior, cov, np.array([[1.0, 0.0]]), np.array([0.3]), np.array([1.0]))
    assert prior[0] < moved[0] < 0.3


def test_simulation_repeats(spark):
    one = simulate.paths(spark, 0.1, 0.2, sims=20, days=10).orderBy("sim_id", "day").collect()
    two = simulate.paths(spark, 0.1, 0.2, sims=20, days=10).repartition(3).orderBy("sim_id", "day").collect()
    assert one == two and len(one) == 20 * 11
    ends = simulate.terminal_returns(simulate.paths(spark, 0.08, 0.16, sims=2000, days=252))
    log = ends.agg(F.avg(F.ln(1 + F.col("ret"))), F.stddev(F.ln(1 + F.col("ret")))).first()
    assert log[0] == pytest.approx(0.08 - 0.0128, abs=0.015) and log[1] == pytest.approx(0.16, abs=0.01)


def test_profiles():
    assert planning.Profile("conservative").max_weight == 0.25
    assert planning.combined_tolerance("aggressive", "moderate") == "moderate"
    with pytest.raises(ValueError):
        planning.Profile("bold")
    with pytest.raises(ValueError):
        planning.bounds(planning.Profile("conservative"), ["A", "B"])


def test_providers_and_report(spark, tmp_path):
    frame = panel(spark, 20, "AB")
    frame.write.parquet(str(tmp_path / "px"))
    provider = providers.FileProvider(spark, str(tmp_path / "px"))
    assert provider.prices(["A"], DAYS[2], DAYS[5]).count() == 4
    assert providers.rate_or_default(provider) == (0.02, True)
    assert isinstance(provider, providers.Provider)
    (tmp_path / "f.csv").write_text("made up\n\n,Mkt-RF,RF\n20210104, 1.00, 0.01\n20210105,-99.99,0.01\n202102, 2.0,0.02\n\nend\n")
    rows = providers.factor_table(spark, str(tmp_path / "f.csv")).orderBy("date").collect()
    assert [(r.date, r["Mkt-RF"]) for r in rows] == [(datetime.date(2021, 1, 4), 0.01), (datetime.date(2021, 2, 1), 0.02)]
    text = report.page("a <b>", [("x", report.table(frame.limit(2))), ("x", "twice"), ("y", report.line_chart({"s": [1.0, 2.0, None]}))])
    assert "a &lt;b&gt;" in text and "twice" not in text and "<polyline" in text
