"""Reports and what they are made of, by content."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DAYS, panel

import meridia
from meridia.functions import solvers
from meridia.operators import assemblers, assets, engine, factors, moments, oos, optimize, plotdata, report, strategies, validation
from meridia.plans.context import Context
from meridia.plans.panel import with_returns
from meridia.sources import providers


@pytest.fixture(scope="module")
def context(spark):
    views = [({"A": 1.0}, 0.10, 0.6), ({"B": 1.0, "C": -1.0}, 0.02, 0.5)]
    return Context.from_prices(
        panel(spark, 300, "ABCM"), {"A": 0.5, "B": 0.3, "C": 0.1, "GONE": 0.1}, "M", DAYS[0], DAYS[199], as_of=DAYS[299], sectors={"A": "x", "B": "x", "C": "y"}, sector_caps={"x": 0.7}, sector_mins={"y": 0.1}, views=views
    )


@pytest.fixture(scope="module")
def analysis(context):
    return assemblers.Analysis(context, "M")


def headings(sections):
    return [h for h, _ in sections]


def test_analysis(analysis):
    rows = analysis.returns.orderBy("date").collect()
    growth = np.prod([1 + r.ret for r in rows])
    assert analysis.terminal().first().total_return == pytest.approx(growth - 1)
    assert analysis.drawdown.agg(F.min("dd")).first()[0] == pytest.approx(analysis.metrics.first().max_drawdown)
    mu, cov = analysis.context.train_moments()
    weights = analysis.context.weights
    want = sum(weights[r.symbol] * r.mu for r in mu.collect())
    assert analysis.model_stats.first().ret == pytest.approx(want)
    var = sum(weights[r.i] * weights[r.j] * r["cov"] for r in cov.collect())
    assert analysis.model_stats.first().vol == pytest.approx(math.sqrt(var))
    sets = analysis.context.constraint_sets()
    w = solvers.min_variance(np.diag([0.01, 0.02, 0.03]), sets["sectors"](["A", "B", "C"]))
    assert w[0] + w[1] <= 0.7 + 1e-7 and w[2] >= 0.1 - 1e-7 and solvers.min_variance(np.diag([0.001, 1, 1]), sets["balanced"](["A", "B", "C"])).max() <= 0.4 + 1e-7


def test_portfolio_sections(analysis):
    found = dict(assemblers.portfolio(analysis))
    assert len(found) == 12 and all("no data" not in b for b in found.values())
    assert "%" in found["Portfolio metrics"] and found["Growth"].count("<polyline") == 2 and "hsla" in found["Correlation in the train period"]


def test_factor_sections(spark, analysis):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(d, float(rng.normal(0, 0.01)), float(rng.normal(0, 0.01)), 0.0001) for d in DAYS], "date date, mkt double, smb double, rf double")
    found = dict(assemblers.factor(analysis, table, ["mkt", "smb"], window=60))
    assert len(found) == 10 and "Total" in found["Attribution by sector"] and found["Rolling exposures"].count("<polyline") == 2
    assert "mkt" in found["Factor loadings"]


def test_optimization_sections(spark, analysis):
    caps = spark.createDataFrame([("A", 3.0), ("B", 1.0), ("C", None)], "symbol string, cap double")
    found = dict(assemblers.optimization(analysis, caps=caps))
    assert len(found) == 17 and all(m in found["Optimised portfolios"] for m in optimize.METHODS)
    assert len(assemblers.optimization(analysis)) == 14
    assert found["Optimised portfolios"].count("<figure") == len(optimize.METHODS) + 1 == found["Sectors of the portfolios"].count("<figure")
    assert found["Risk contributions"].count("<rect") >= 2 * len(optimize.METHODS) and found["Risk by sector"].count("<rect") >= len(optimize.METHODS)
    assert found["Efficient frontier"].count("<circle") == 2500 and found["Efficient frontier"].count("<polyline") == 1 and found["Efficient frontier"].count("&#9670;") == len(optimize.METHODS) + 1
    assert found["Monthly returns by method"].count("<h3") == len(optimize.METHODS) + 1 and found["Returns by the views"].count("<rect") == 6
    weights = {}
    for r in analysis.context.standard_portfolios().collect():
        weights.setdefault(r.strategy, {})[r.symbol] = r.weight
    assert set(weights) == {"equal", "min_vol", "max_sharpe", "balanced", "sector"} and max(weights["balanced"].values()) <= 0.4 + 1e-8
    assert all(sum(w.values()) == pytest.approx(1) for w in weights.values()) and weights["sector"]["A"] + weights["sector"]["B"] <= 0.7 + 1e-8


def test_charts(spark):
    frame = spark.createDataFrame([(d, s, v) for d in range(3) for s, v in (("a", 0.5), ("b<", 0.5), ("c", -0.1))], "date int, s string, v double")
    assert report.stacked_areas(frame, "s", "v").count("<polygon") == 3 and "b&lt;" in report.stacked_areas(frame, "s", "v")
    assert report.stacked_bars(frame, "date", "s", "v").count("<rect") == 9 and 'opacity="0.4"' in report.stacked_bars(frame, "date", "s", "v")
    assert report.pies(frame, "date", "s", "v").count("<path") == 6  # what is below 0 has no slice
    assert report.pies(frame.filter("s = 'a'"), "date", "s", "v").count("<circle") == 3
    for chart in (report.stacked_areas(frame.limit(0), "s", "v"), report.stacked_bars(frame.limit(0), "date", "s", "v"), report.pies(frame.limit(0), "date", "s", "v"), report.scatter(frame.limit(0).selectExpr("v", "v AS w", "v AS c"), "v", "w", "c"), report.fan([], ("a", "b"), ("a", "b"), "a")):
        assert chart == "<p>no data</p>"
    assert "5 of 9 rows shown" in report.table(frame, most=5) and "rows shown" not in report.table(frame, most=9)
    assert "4 of 9 rows shown" in report.lines(frame, "s", "v", most=4)


def test_validation_sections(analysis):
    found = dict(assemblers.validated(analysis, train_days=120, step_days=60))
    assert list(found) == ["Train and test", "Overfitting", "Rolling windows", "Growth outside the sample", "Drawdown outside the sample"]
    assert found["Train and test"].count("<tr>") == 9 and found["Growth outside the sample"].count("<polyline") == 4


def test_simulation_sections(analysis):
    tables = assemblers.monte_carlo_tables(analysis, sims=400, days=60)
    assert tables["targets"].count() == 4 and tables["stress"].count() == 2
    shocks = {r.shock: r.recovered for r in tables["stress"].collect()}
    assert shocks[-0.10] >= shocks[-0.20]
    probs = [r.prob for r in tables["survival"].orderBy("threshold").collect()]
    assert len(probs) == 100 and probs == sorted(probs, reverse=True) and probs[-1] == 0 and probs[0] == pytest.approx(399 / 400)
    assert len(assemblers.monte_carlo(analysis, sims=200, days=30)) == 7


def test_backtest_sections(spark, tmp_path):
    result = strategies.backtest({"a": strategies.fixed({"A": 0.5, "B": 0.5}), "b": strategies.solved("min_variance")}, panel(spark, 200), commission_bps=1.0)
    sections = assemblers.backtest(result)
    assert headings(sections)[-1] == "Comparison of strategies" and dict(sections)["Wealth"].count("<polyline") == 2
    assert dict(sections)["Weights over time"].count("<polygon") == 5 and dict(sections)["Summary"].count("<tr>") == 3
    assemblers.write(str(tmp_path / "b.html"), "Backtest <1>", sections + sections)
    page = (tmp_path / "b.html").read_text()
    assert page.count("<h2") == len(sections) and "Backtest &lt;1&gt;" in page


def test_combined(analysis, monkeypatch):
    monkeypatch.setattr(assemblers, "optimization", lambda *a, **k: 1 / 0)
    monkeypatch.setattr(assemblers, "validated", lambda *a, **k: [])
    found = assemblers.combined(analysis, sims=100, days=20)
    assert headings(found)[:2] == ["Data quality", "Executive summary"] and "GONE" in found[0][1]
    assert "ZeroDivisionError" in dict(found)["Optimisation"] and "Simulated paths" in headings(found)
    with pytest.raises(ZeroDivisionError):
        assemblers.combined(analysis, sims=100, days=20, strict=True)


def test_overfitting_assessment(spark):
    rng = np.random.default_rng(6)
    noise = rng.normal(0, 0.01, (320, 6))
    skilled = noise.copy()
    skilled[:, 2] += 0.004
    for matrix, want in ((noise, ("likely_overfit", "caution")), (skilled, ("robust",))):
        rows = spark.createDataFrame([(DAYS[i % 300] if i < 300 else None, f"c{k}", float(matrix[i, k])) for i in range(300) for k in range(6)], "date date, config string, ret double")
        made = validation.report_of(validation.assessed(rows, blocks=8))
        assert made.to_dict()["verdict"] in want and "pbo" in made.to_text()
        assert made.to_dict()["best"] == f"c{int(np.argmax(matrix[:300].mean(0) / matrix[:300].std(0, ddof=1)))}"
    one = validation.report_of(validation.assessed(rows.filter("config = 'c2'"))).to_dict()
    assert one["pbo"] is None and one["verdict"] == "robust"


def test_assets(spark):
    rows = with_returns(panel(spark, 120, "AB")).filter("ret IS NOT NULL").withColumn("bench", F.col("ret") * 0.5)
    known = spark.createDataFrame([("A", "Alpha", 10.0)], "symbol string, name string, market_cap double")
    weights = spark.createDataFrame([("A", 0.4), ("B", 0.6)], "symbol string, weight double")
    factor_rows = rows.select("date", "symbol", F.col("ret").alias("y"), F.col("bench").alias("mkt"))

    def narrate(row):
        return {"A": "own words", "B": " "}[row["symbol"]]

    plain = {r.symbol: r for r in assets.info(rows, weights, known=known, factor_rows=factor_rows, x=["mkt"]).collect()}
    assert plain["A"].name == "Alpha" and plain["B"].name is None and plain["B"].pe_ratio is None
    assert plain["A"].beta_mkt == pytest.approx(2.0) and "more volatile than the benchmark (beta 2.00)" in plain["A"].narration
    assert -1 <= plain["A"].portfolio_corr <= 1
    hooked = {r.symbol: r.narration for r in assets.info(rows, weights, known=known, narrate=narrate).collect()}
    assert hooked["A"] == "own words" and hooked["B"].startswith("B returned ")
    caps = {r.symbol: r.cap for r in assets.market_caps(weights, spark.createDataFrame([("A", 4.0)], "symbol string, cap double")).collect()}
    assert caps == {"A": 4.0, "B": 4.0}
    with pytest.raises(ValueError):
        assets.market_caps(weights, None)


def test_objectives():
    rng = np.random.default_rng(7)
    returns = rng.normal(0, [0.01, 0.02, 0.03], (500, 3))
    w = solvers.min_tracking_error(returns, returns @ np.array([0.2, 0.5, 0.3]))
    assert w == pytest.approx([0.2, 0.5, 0.3], abs=1e-6) and solvers.tracking_error(w, returns, returns @ w) == pytest.approx(0, abs=1e-12)
    best = solvers.min_shortfall(returns)
    assert solvers.shortfall(best, returns) <= min(solvers.shortfall(x, returns) for x in np.eye(3)) + 1e-9
    assert solvers.mean_squared_error([1, 2], [1, 4]) == 2 and solvers.mean_absolute_error([1, 2], [1, 4]) == 1
    assert solvers.tracking_error(w, returns[:1], np.zeros(1)) == 0


def test_regression_inference(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (80, 2))
    y = 0.3 + x @ [1.0, 0.0] + rng.normal(0, 0.5, 80)
    rows = spark.createDataFrame([(DAYS[i], "s", float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], "date date, symbol string, a double, b double, y double")
    row = factors.regression(rows, "symbol", x=["a", "b"]).first()
    design = np.column_stack([np.ones(80), x])
    coefficients = np.linalg.lstsq(design, y, rcond=None)[0]
    left = y - design @ coefficients
    se = np.sqrt(left @ left / 77 * np.diag(np.linalg.inv(design.T @ design)))
    assert (row.t_alpha, row.t_a, row.t_b) == pytest.approx(tuple(coefficients / se))
    r2 = 1 - left @ left / ((y - y.mean()) ** 2).sum()
    assert (row.r2, row.adj_r2) == pytest.approx((r2, 1 - (1 - r2) * 79 / 77)) and row.p_a < 1e-9
    draws = np.random.default_rng(9).standard_t(77, 400_000)
    assert row.p_b == pytest.approx((abs(draws) >= abs(row.t_b)).mean(), abs=0.004)
    bands = {r.factor: r.band for r in factors.loading_bands(factors.regression(rows, "symbol", x=["a", "b"]), "symbol", x=["a", "b"]).collect()}
    assert bands["a"] == "p < 0.01"
    few = factors.regression(rows.limit(3), "symbol", x=["a", "b"]).first()
    assert few.n == 3 and few.alpha is None and few.p_a is None
    assert factors.typical_gap(rows, "symbol").first().periods == 252


def test_costs_by_callables(spark):
    prices, weights = panel(spark, 120), spark.createDataFrame([("s", "A", 0.5), ("s", "B", 0.5)], "strategy string, symbol string, weight double")
    cost = lambda **k: {r.date: r.cost_frac for r in engine.simulate(prices, weights, **k)[1].collect()}
    plain, own = cost(commission_bps=10.0, spread_bps=4.0), cost(cost_model=lambda two_way: two_way * 12 / 1e4)
    assert own == pytest.approx(plain)
    hit = cost(commission_bps=10.0, spread_bps=4.0, impact=engine.square_root_impact(0.1))
    assert hit[DAYS[0]] == pytest.approx(plain[DAYS[0]] + 0.1 * 2 * 0.5**1.5) and all(hit[d] >= plain[d] for d in plain)


def test_covariance_has_no_join_on_dates(spark):
    returns = with_returns(panel(spark, 50))
    for frame in (moments.covariance(returns), optimize.pair_sums(returns)):
        assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()
    # more symbols than a block, and a symbol without some dates
    wide = spark.createDataFrame([(DAYS[i], f"s{k}", float(np.sin(i * k + k))) for i in range(12) for k in range(7) if (i, k) != (3, 2)], "date date, symbol string, x double")
    before = moments.BLOCK
    try:
        moments.BLOCK = 3
        sums = {(r.i, r.j): (r.n, r.p0, r.p1, r.p2) for r in moments.outer_sums(wide).collect()}
    finally:
        moments.BLOCK = before
    rows = wide.collect()
    for a in range(7):
        for b in range(7):
            one, two = ({r.date: r.x for r in rows if r.symbol == f"s{k}"} for k in (a, b))
            both = [(one[d], two[d]) for d in one if d in two]
            assert sums[f"s{a}", f"s{b}"] == pytest.approx((len(both), sum(x for x, _ in both), sum(y for _, y in both), sum(x * y for x, y in both)))


def test_identity_shrinkage(spark):
    returns = with_returns(panel(spark, 200))
    fixed = {(r.i, r.j): r["cov"] for r in moments.shrunk_covariance(returns, target="identity", delta=1.0).collect()}
    assert len({round(v, 12) for (i, j), v in fixed.items() if i == j}) == 1 and all(v == 0 for (i, j), v in fixed.items() if i != j)
    row = moments.shrunk_covariance(returns, target="identity").first()
    assert 0 <= row.delta <= 1
    with pytest.raises(ValueError):
        moments.shrunk_covariance(returns, target="magic")


def test_plot_data(spark):
    shares = spark.createDataFrame([("p", "A", 0.6), ("p", "B", 0.4), ("p", "C", 0.0004)], "strategy string, symbol string, weight double")
    sectors = spark.createDataFrame([("A", "x")], "symbol string, sector string")
    assert {r.sector: r.weight for r in plotdata.sector_allocation(shares, sectors).collect()} == {"x": 0.6, "Other": 0.4}
    assert {r.sector: r.share for r in plotdata.sector_risk(shares.withColumnRenamed("weight", "share"), sectors).collect()} == pytest.approx({"x": 0.6, "Other": 0.4004})
    history = assemblers.weights_over_time(panel(spark, 60), shares.filter("weight > 0.1"), "M")
    assert {r.symbol: r.place for r in history.select("symbol", "place").distinct().collect()} == {"A": 1, "B": 2}
    assert all(r.w == pytest.approx(1) for r in history.groupBy("date").agg(F.sum("weight").alias("w")).collect())
    returns = with_returns(panel(spark, 250, "A"))
    bins = plotdata.distribution(returns, "symbol", bins=10).collect()
    assert sum(r.n for r in bins) == 243 and {r.bin for r in bins} <= set(range(10))


def test_small_things(spark):
    assert report.formatted({"cagr": 0.1234, "sharpe": 1.234, "n": 3, "x": math.nan}) == {"cagr": "12.34%", "sharpe": "1.23", "n": "3", "x": "N/A"}
    assert report.bar_chart({"a": math.nan}) == "<p>no data</p>" and report.bar_chart({"a<": 1.0, "b": -2.0}).count("<rect") == 2
    logger = meridia.enable_logging()
    assert meridia.enable_logging() is logger and len(logger.handlers) == 1
    logger.handlers.clear()
    frame = panel(spark, 5, "A")
    providers.set_default(providers.FrameProvider(frame))
    assert providers.prices(["A"], DAYS[0], DAYS[2]).count() == 3
    assert oos.min_backtest_length(1) == 0
