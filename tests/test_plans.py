import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DAYS, panel

from meridia.operators import factors, planning, recommend, strategies
from meridia.plans.context import Context
from meridia.plans.panel import with_returns
from meridia.sources.providers import FrameProvider


def test_context(spark):
    prices = panel(spark, 200, "ABM")
    context = Context.from_prices(
        prices, {"A": 0.5, "B": 0.3, "GONE": 0.2}, "M", DAYS[0], DAYS[99], as_of=DAYS[150], provider=FrameProvider(prices), names={"A": "Alpha"}, sectors={"A": "x"}
    )
    assert context.notes.any and context.notes.dropped == ("GONE",) and context.notes.default_rate and context.rate == 0.02
    assert context.weights == pytest.approx({"Alpha": 0.625, "B": 0.375}) and context.sectors == {"Alpha": "x"}
    assert context.train.agg(F.max("date")).first()[0] == DAYS[99]
    assert context.test.agg(F.min("date"), F.max("date")).first() == (DAYS[100], DAYS[149])
    with pytest.raises(ValueError):
        Context.from_prices(prices, {"A": 1.0}, "NONE", DAYS[0], DAYS[99], as_of=DAYS[150])
    with pytest.raises(ValueError):
        Context.from_prices(prices, {"X": 1.0}, "M", DAYS[0], DAYS[99], as_of=datetime.date(2021, 6, 1))


def test_backtest_of_many(spark):
    prices = panel(spark, 200)
    result = strategies.backtest(
        {
            "fixed": strategies.fixed({"A": 0.5, "B": 0.5}),
            "minvar": strategies.solved("min_variance"),
            "trend": strategies.trend_following(momentum=(20, 3), average=(5, 20), vol_lookback=10),
            "overlay": strategies.vol_overlay(strategies.fixed({"A": 0.5, "B": 0.3, "C": 0.2}), lookback=10),
        },
        prices,
        commission_bps=1.0,
        spread_bps=5.0,
    )
    rows = {r.strategy: r for r in result.metrics().collect()}
    assert set(rows) == {"fixed", "minvar", "trend", "overlay"} and rows["fixed"].n_obs == 199
    assert rows["trend"].n_obs < 199
    stats = result.statistics().collect()
    assert all(0 <= r.dsr <= r.psr <= 1 for r in stats)
    with pytest.raises(ValueError):
        strategies.backtest({}, prices)
    with pytest.raises(ValueError):
        strategies.solved("magic")


def test_recommendation(spark, tmp_path):
    prices = panel(spark, 300)
    current = spark.createDataFrame([("A", 0.6), ("Z", 0.4)], "symbol string, weight double")
    sectors = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "symbol string, sector string")
    profile = planning.Profile("conservative", max_weight=0.5, liquidity_floor=0.1, sector_caps={"x": 0.45}, target_return=5.0, max_drawdown=0.9)
    results = with_returns(prices).filter("ret IS NOT NULL").withColumnRenamed("symbol", "strategy")
    betas = spark.createDataFrame([("mkt", 1.4), ("smb", 0.1)], "factor string, beta double")
    for method in ("max_sharpe", "risk_parity", "hrp"):
        found = recommend.recommend(prices, method=method, profile=profile, current=current, sectors=sectors, results=results, betas=betas, max_beta=1.0, threshold=0.2)
        parts = found.to_dict()
        weights = {r["symbol"]: r["weight"] for r in parts["weights"]}
        assert sum(weights.values()) == pytest.approx(0.9) and max(weights.values()) <= 0.5 + 1e-7
        assert weights["A"] + weights["B"] <= 0.45 + 1e-7
        checks = {r["check"]: r for r in parts["suitability"]}
        assert all(checks[c]["passed"] for c in ("concentration", "exclusions", "liquidity", "sector x"))
        assert checks["target return"]["passed"] is False and not checks["target return"]["hard"]
        assert {"volatility", "drawdown"} <= set(checks)
    assert planning.is_suitable(found.suitability).first()[0] == all(r["passed"] for r in checks.values() if r["hard"])
    assert {r["symbol"]: r["action"] for r in parts["trades"]}["Z"] == "sell"
    moves = {r["symbol"]: r["delta"] for r in parts["trades"]}
    plan = parts["plan"][0]
    assert plan["turnover"] == pytest.approx(sum(map(abs, moves.values())) / 2)
    assert plan["cost"] == pytest.approx(3.5e-4 * sum(abs(d) for d in moves.values() if abs(d) >= 0.2))
    assert [r["subject"] for r in parts["alerts"] if r["kind"] == "factor"] == ["mkt"]
    assert sum(r["winner"] for r in parts["comparison"]) == 1
    found.to_html(str(tmp_path / "r.html"))
    assert "suitability" in found.to_text() and "Recommendation: trades" in (tmp_path / "r.html").read_text()


def test_limits_without_room_are_errors(spark):
    prices = panel(spark, 60)
    sectors = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "x")], "symbol string, sector string")
    with pytest.raises(ValueError):
        recommend.recommend_weights(prices, profile=planning.Profile("conservative"))  # 3 times 25 %
    with pytest.raises(ValueError):
        recommend.recommend_weights(prices, profile=planning.Profile(sector_caps={"x": 0.5}), sectors=sectors)
    with pytest.raises(ValueError):
        recommend.recommend_weights(prices, estimator="magic")
    assert planning.build_profile(ability="aggressive", willingness="conservative").risk_tolerance == "conservative"


@pytest.mark.parametrize("estimator", ["sample", "ledoit_wolf", "denoise"])
def test_estimators(spark, estimator):
    weights = recommend.recommend_weights(panel(spark, 200), method="min_variance", estimator=estimator).collect()
    assert sum(r.weight for r in weights) == pytest.approx(1) and all(r.weight >= -1e-9 for r in weights)


def test_walk_forward(spark):
    row = recommend.walk_forward(panel(spark, 300), "min_variance", train_days=120, step_days=60).first()
    assert row.windows >= 3 and row.verdict in ("holds up", "fragile")
    capped = recommend.walk_forward(panel(spark, 300), "min_variance", train_days=120, step_days=60, profile=planning.Profile(max_weight=0.4)).first()
    assert capped.windows == row.windows and capped.is_sharpe != row.is_sharpe


def test_regression_recovers_betas(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        a, b = rng.normal(0, 0.01, 2)
        rows.append((DAYS[i], "s", float(a), float(b), float(0.001 + 1.2 * a - 0.5 * b)))
    frame = spark.createDataFrame(rows, "date date, symbol string, a double, b double, y double")
    row = factors.regression(frame, "symbol", x=["a", "b"]).first()
    assert (row.alpha, row.beta_a, row.beta_b, row.r2) == pytest.approx((0.001, 1.2, -0.5, 1.0), abs=1e-9)
    rolled = factors.rolling_regression(frame, "symbol", x=["a", "b"], window=50).collect()
    assert len(rolled) == 150 and all(r.beta_a == pytest.approx(1.2, abs=1e-6) for r in rolled)
    assert factors.neutralized(frame, "symbol", x=["a", "b"]).agg(F.max(F.abs("residual"))).first()[0] < 1e-9
    assert with_returns(panel(spark, 3, "A")).filter("ret IS NULL").count() == 1
