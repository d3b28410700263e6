"""Reports: each analysis as sections (heading, HTML), and pages of them.

The numbers are frames of the other modules; what is collected is what a page shows.
"""

from __future__ import annotations

import html
from collections.abc import Callable, Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import metrics
from meridia.functions.quantiles import exact_quantiles
from meridia.operators import engine, factors, moments, oos, optimize, plotdata, report, series, simulate, strategies, validation
from meridia.operators.recommend import Recommendation
from meridia.plans.context import Context
from meridia.plans.panel import with_returns

Sections = list[tuple[str, str]]


class Analysis:
    """What reports ask of a context, computed when asked for and kept."""

    def __init__(self, context: Context, mode: str | int | None = None) -> None:
        self.context, self.mode = context, mode

    @cached_property
    def wealth(self) -> DataFrame:
        """(strategy, date, value) of the portfolio over the whole panel."""
        return engine.simulate(self.context.panel.select("date", "symbol", "price"), self.context.weight_table(), mode=self.mode)[0].cache()

    @cached_property
    def returns(self) -> DataFrame:
        """(strategy, date, ret, bench, growth)."""
        rows = self.context.against_benchmark(self.wealth.select("strategy", "date", "value"))
        return rows.select("*", F.product(1 + F.col("ret")).over(Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("growth")).cache()

    @cached_property
    def drawdown(self) -> DataFrame:
        return series.drawdown_curve(self.returns, "strategy", value="growth")

    @cached_property
    def metrics(self) -> DataFrame:
        return metrics.report_metrics(self.returns, "strategy", rf=self.context.rate).cache()

    @cached_property
    def model_stats(self) -> DataFrame:
        """(strategy, ret, vol, sharpe) that the train's moments promise."""
        weights, train = self.context.weight_table(), self.context.train
        ret = weights.join(moments.mean_returns(train), "symbol").groupBy("strategy").agg(F.sum(F.col("weight") * F.col("mu")).alias("ret"))
        return ret.join(moments.forecast_vol(weights, moments.covariance(train)), "strategy").select("*", ((F.col("ret") - self.context.rate) / F.when(F.col("vol") > 1e-5, F.col("vol"))).alias("sharpe"))

    def terminal(self) -> DataFrame:
        """(strategy, total_return)."""
        return self.returns.groupBy("strategy").agg((F.max_by("growth", "date") - 1).alias("total_return"))

    def release(self) -> None:
        for name in ("wealth", "returns", "metrics"):
            if name in vars(self):
                vars(self).pop(name).unpersist()


def _sectors(context: Context) -> DataFrame:
    rows = list(context.sectors.items()) or [(s, "Other") for s in context.weights]
    return context.panel.sparkSession.createDataFrame(rows, "symbol string, sector string")


def data_quality(context: Context) -> Sections:
    """A banner if something had to be changed on the way, else nothing."""
    notes = context.notes
    said = []
    if notes.dropped:
        said.append(f"No prices of {', '.join(notes.dropped)}.")
    said += [f"{s}: weight {was:.2%} became {now:.2%}." for s, (was, now) in notes.reweighted.items()]
    if notes.default_rate:
        said.append(f"The risk-free rate is the default, {context.rate:.2%}.")
    return [("Data quality", "<ul>" + "".join(f"<li>{html.escape(x)}</li>" for x in said) + "</ul>")] if said else []


def summary(context: Context) -> Sections:
    rows = [{"symbol": s, "sector": context.sectors.get(s, "Other"), "weight": w} for s, w in sorted(context.weights.items(), key=lambda x: (-x[1], x[0]))]
    config = [{"benchmark": context.benchmark, "risk-free rate": context.rate}]
    return [("Executive summary", report.rows_table(config) + report.rows_table(rows))]


def portfolio(analysis: Analysis) -> Sections:
    rets = analysis.returns
    both = rets.select("date", F.explode(F.create_map(F.lit("portfolio"), "ret", F.lit("benchmark"), "bench")).alias("series", "ret"))
    grown = plotdata.growth(both, "series")
    rolled = series.rolling(both, "series", window=60, rf=analysis.context.rate)
    months = series.month_table(both.filter("series = 'portfolio'"), "series").select("year", *(f"m{i:02d}" for i in range(1, 13)))
    yearly = series.compound_by(both, "series", F.year("date").alias("year"))
    line = rets.groupBy("strategy").agg(F.regr_slope("ret", "bench").alias("slope"), F.regr_intercept("ret", "bench").alias("intercept"), F.regr_r2("ret", "bench").alias("r2"))
    train = moments.covariance(analysis.context.train)
    names = sorted(r[0] for r in train.select("i").distinct().collect())
    corr = train.groupBy("i").pivot("j", names).agg(F.first("corr"))
    shown = [report.formatted(r.asDict()) for r in analysis.metrics.collect()]
    return [
        ("Portfolio metrics", report.rows_table(shown)),
        ("Model statistics", report.table(analysis.model_stats)),
        ("Growth", report.lines(grown, "series", "growth")),
        ("Drawdown", report.lines(analysis.drawdown, "strategy", "dd")),
        ("Rolling volatility", report.lines(series.rolling(both, "series", window=30).filter("roll_vol IS NOT NULL"), "series", "roll_vol")),
        ("Rolling Sharpe", report.lines(rolled.filter("roll_sharpe IS NOT NULL"), "series", "roll_sharpe")),
        ("Monthly returns", report.heatmap(months, "year", [f"m{i:02d}" for i in range(1, 13)])),
        ("Distribution of returns", report.table(plotdata.distribution(rets, "strategy").orderBy("strategy", "bin"))),
        ("Yearly returns", report.bars(yearly.select(F.concat_ws(" ", "series", "year").alias("name"), "compound").orderBy("name"), "name", "compound")),
        ("Regression on the benchmark", report.table(line)),
        ("Growth of constituents", report.lines(series.growth_of_one(analysis.context.panel, "symbol"), "symbol", "growth")),
        ("Correlation in the train period", report.heatmap(corr, "i", names)),
    ]


def factor(analysis: Analysis, table: DataFrame, x: Sequence[str], *, baseline: DataFrame | None = None, window: int = 126) -> Sections:
    """``table``: (date, factors, rf). The baseline of the attribution is (symbol, weight), equal weights if not given."""
    context = analysis.context
    rows = factors.excess(analysis.returns, table, rf=context.rate)
    fit = factors.regression(rows, "strategy", x=x)
    betas = factors.rolling_regression(rows, "strategy", x=x, window=window)
    long = betas.selectExpr("strategy", "date", f"stack({len(x)}, {', '.join(f'{c!r}, beta_{c}' for c in x)}) AS (factor, beta)")
    parts = factors.cumulative_contributions(factors.contributions(rows, fit, "strategy", x=x), "strategy", x=x)
    stacked = parts.selectExpr("date", f"stack({len(x) + 2}, {', '.join(f'{c!r}, {c}' for c in (*(f'part_{c}' for c in x), 'alpha', 'unexplained'))}) AS (part, growth)")
    moved = table.selectExpr("date", f"stack({len(x)}, {', '.join(f'{c!r}, {c}' for c in x)}) AS (factor, ret)")
    own = context.weight_table().drop("strategy")
    equal = own.select("symbol", (1 / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).alias("weight"))
    effects = factors.brinson(own, baseline if baseline is not None else equal, context.panel.filter(F.col("symbol") != context.benchmark), _sectors(context))
    return [
        ("Factor regression", report.table(fit)),
        ("Factor loadings", report.table(factors.loading_bands(fit, "strategy", x=x))),
        ("Rolling exposures", report.lines(long, "factor", "beta")),
        ("Style drift", report.table(factors.style_drift(long, "factor"))),
        ("Factor regimes", report.table(factors.regimes(moved))),
        ("Cumulative contributions", report.lines(stacked, "part", "growth")),
        ("Growth of the portfolio", report.lines(plotdata.growth(analysis.returns, "strategy"), "strategy", "growth")),
        ("Attribution by sector", report.table(effects)),
        ("Asset allocation", report.bars(own.orderBy(F.desc("weight")), "symbol", "weight")),
        ("Sector allocation", report.bars(plotdata.sector_allocation(context.weight_table(), _sectors(context)).orderBy("sector"), "sector", "weight")),
    ]


def optimization(analysis: Analysis, *, caps: DataFrame | None = None) -> Sections:
    """All methods on the train period; with capitalisations (symbol, cap) and the context's views also Black and Litterman."""
    context = analysis.context
    train = context.train.filter(F.col("symbol") != context.benchmark)
    weights = optimize.optimized(train.withColumn("_all", F.lit(1)), "_all").select("strategy", "symbol", "weight").unionByName(context.weight_table())
    weights = context.panel.sparkSession.createDataFrame(weights.collect(), weights.schema)  # a row a symbol and method
    cov = moments.covariance(train)
    shares = moments.risk_contributions(weights, cov)
    values = validation.held(context.train, weights)
    rets = with_returns(values, "strategy")
    bench = context.train.filter(F.col("symbol") == context.benchmark).select("date", F.col("ret").alias("bench"))
    rolled = series.rolling(rets, "strategy", window=60, rf=context.rate).filter("roll_sharpe IS NOT NULL")
    curve = series.drawdown_curve(values, "strategy", value="price")
    edge = optimize.frontier(train)
    held, sectors, by_sector = plotdata.composition(weights), plotdata.sector_allocation(weights, _sectors(context)), plotdata.sector_risk(shares, _sectors(context))
    cloud, curve_of = optimize.cloud(train), edge.select(F.col("target").alias("ret"), "vol").distinct()
    expected = weights.join(moments.mean_returns(train), "symbol").groupBy("strategy").agg(F.sum(F.col("weight") * F.col("mu")).alias("ret"))
    marks = expected.join(moments.forecast_vol(weights, cov), "strategy").select(F.col("strategy").alias("name"), "ret", "vol")
    months = series.month_table(rets.filter("ret IS NOT NULL"), "strategy").select("strategy", "year", *(f"m{i:02d}" for i in range(1, 13)))
    names = sorted(r[0] for r in weights.select("strategy").distinct().collect())
    out = [
        ("Optimised portfolios", report.pies(held, "strategy", "symbol", "weight") + report.table(held.orderBy("strategy", F.desc("weight")))),
        ("Sectors of the portfolios", report.pies(sectors, "strategy", "sector", "weight") + report.table(sectors.orderBy("strategy", "sector"))),
        ("Risk contributions", report.stacked_bars(shares, "strategy", "symbol", "share") + report.table(shares.orderBy("strategy", "symbol"))),
        ("Risk by sector", report.stacked_bars(by_sector, "strategy", "sector", "share") + report.table(by_sector.orderBy("strategy", "sector"))),
        ("In-sample metrics", report.table(metrics.summary_metrics(rets, "strategy", rf=context.rate).orderBy("strategy"))),
        ("Cost of transition", report.table(engine.transition_cost(context.weight_table().drop("strategy"), weights))),
        ("Capture ratios", report.table(series.capture_ratios(rets.join(bench, "date"), "strategy").orderBy("strategy"))),
        ("Growth by method", report.lines(values, "strategy", "price")),
        ("Drawdown by method", report.lines(curve, "strategy", "dd")),
        ("Rolling Sharpe by method", report.lines(rolled, "strategy", "roll_sharpe")),
        ("Efficient frontier", report.scatter(cloud, "vol", "ret", "sharpe", curve=curve_of, marks=marks) + report.table(curve_of.orderBy("ret"))),
        ("Random portfolios", report.table(cloud.orderBy(F.desc("sharpe")).limit(20))),
        ("Monthly returns by method", "".join(f"<h3>{m}</h3>" + report.heatmap(months.filter(F.col("strategy") == m).drop("strategy"), "year", [f"m{i:02d}" for i in range(1, 13)]) for m in names)),
        ("Portfolios within standard limits", report.table(context.standard_portfolios().orderBy("strategy", "symbol"))),
    ]
    if caps is not None and context.views:
        market = moments.market_weights(caps)
        found = optimize.posterior(cov, market, context.views)
        out += [
            ("Returns by the views", report.stacked_bars(_pairs(found, "prior", "posterior"), "symbol", "kind", "value") + report.table(plotdata.posterior_shift(found).orderBy("place"))),
            ("Impact of the views", report.bars(plotdata.posterior_shift(found).orderBy("shift"), "symbol", "shift")),
            ("Weights by the views", report.stacked_bars(_pairs(plotdata.posterior_weights(found, market), "market", "weight"), "symbol", "kind", "value") + report.table(plotdata.posterior_weights(found, market))),
        ]
    return out


def _pairs(frame: DataFrame, *columns: str) -> DataFrame:
    """(symbol, kind, value): columns of a frame as rows."""
    return frame.selectExpr("symbol", f"stack({len(columns)}, {', '.join(f'{c!r}, {c}' for c in columns)}) AS (kind, value)")


def validated(analysis: Analysis, *, methods: Sequence[str] = ("equal_weight", "min_variance", "max_sharpe"), train_days: int = 365, step_days: int = 90) -> Sections:
    """The train's weights on either side of the split, and windows rolled over the whole panel."""
    context = analysis.context
    holdings = context.panel.filter(F.col("symbol") != context.benchmark).select("date", "symbol", "price", "ret", "log_ret")
    train_end = context.train.agg(F.max("date")).first()[0]
    weights = optimize.optimized(context.train.filter(F.col("symbol") != context.benchmark).withColumn("_all", F.lit(1)), "_all", list(methods)).select("strategy", "symbol", "weight")
    weights = weights.unionByName(context.weight_table("user"))
    weights = context.panel.sparkSession.createDataFrame(weights.collect(), weights.schema)
    splits = validation.split_metrics(holdings.select("date", "symbol", "price"), weights, train_end)
    windows = validation.rolling(holdings.select("date", "symbol", "price"), methods, fixed=context.weight_table("user"), train_days=train_days, step_days=step_days)
    after = validation.held(holdings.filter(F.col("date") > F.lit(train_end)), weights)
    return [
        ("Train and test", report.table(splits.orderBy("strategy", "split"))),
        ("Overfitting", report.table(validation.overfitting_scores(splits).orderBy("strategy"))),
        ("Rolling windows", report.table(windows.groupBy("strategy").agg(F.count(F.lit(1)).alias("windows"), F.avg("is_sharpe").alias("is_sharpe"), F.avg("oos_sharpe").alias("oos_sharpe")).orderBy("strategy"))),
        ("Growth outside the sample", report.lines(after, "strategy", "price")),
        ("Drawdown outside the sample", report.lines(series.drawdown_curve(after, "strategy", value="price"), "strategy", "dd")),
    ]


#: Single paths that a chart of simulations shows behind its bands.
DRAWN = 30
TARGETS, STRESSES = (0.05, 0.10, 0.20, 0.50), (-0.10, -0.20)


def monte_carlo_tables(analysis: Analysis, *, sims: int = 5000, days: int = 252, initial: float = 10_000.0, seed: int = 42) -> dict[str, DataFrame]:
    """Frames of a base run at the model's return and volatility, and of stressed runs."""
    spark, row = analysis.context.panel.sparkSession, analysis.model_stats.first()
    run = lambda shock, seed: simulate.paths(spark, row.ret, row.vol, sims=sims, days=days, initial=initial, shock=shock, seed=seed)
    base = run(0.0, seed)
    ends = simulate.terminal_returns(base)
    reached = [simulate.time_to_target(base, target=t, initial=initial).select(F.lit(t).alias("target"), "*") for t in TARGETS]
    stressed = []
    for i, shock in enumerate(STRESSES):
        last = run(shock, seed + i + 1).groupBy("sim_id").agg(F.max_by("value", "day").alias("value"))
        stressed.append(last.agg(F.lit(shock).alias("shock"), F.avg((F.col("value") >= initial).cast("double")).alias("recovered")).join(F.broadcast(exact_quantiles(last, [], "value", [0.5], ["median_end"]).drop("n")), F.lit(True)))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return {
        "metrics": simulate.simulation_metrics(ends), "probabilities": simulate.success_probabilities(ends), "survival": plotdata.survival(ends), "histogram": simulate.histogram(ends),
        "bands": simulate.bands(base), "paths": base.filter(F.col("sim_id") < DRAWN), "targets": union(reached), "stress": union(stressed),
    }


def monte_carlo(analysis: Analysis, **options: float) -> Sections:
    tables = monte_carlo_tables(analysis, **options)
    bands = tables["bands"].orderBy("day").collect()
    few = [r.path for r in tables["paths"].groupBy("sim_id").agg(F.array_sort(F.collect_list(F.struct("day", "value"))).alias("v")).select(F.col("v.value").alias("path")).collect()]
    survival = [r.prob for r in tables["survival"].orderBy("threshold").collect()]
    rest = [(f"Simulated {k}", report.table(tables[k])) for k in ("metrics", "probabilities", "histogram", "targets", "stress")]
    return [("Simulated paths", report.fan(bands, ("p05", "p95"), ("p25", "p75"), "p50", paths=few)), ("Probability of a return", report.line_chart({"prob": survival})), *rest]


def weights_over_time(panel: DataFrame, targets: DataFrame, mode: str | int | None = "M") -> DataFrame:
    """(strategy, date, symbol, weight, place) of static targets as they drift between rebalances."""
    rows = panel.join(targets, "symbol")
    flags = engine.rebalance_flags(rows.select("strategy", "date").distinct(), mode, "strategy")
    over = Window.partitionBy("strategy", "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(flags, ["strategy", "date"]).select("*", F.last(F.when(F.col("flag"), F.col("price")), ignorenulls=True).over(over).alias("base"))
    worth = F.col("weight") * F.col("price") / F.col("base")
    drifted = rows.select("strategy", "date", "symbol", (worth / F.sum(worth).over(Window.partitionBy("strategy", "date"))).alias("weight"))
    return plotdata.weight_history(drifted)


def backtest(result: strategies.Backtest, *, window: int = 63) -> Sections:
    rets = result.returns
    rolled = series.rolling(rets, "strategy", window=window).filter("roll_vol IS NOT NULL")
    names = [html.escape(r[0]) for r in result.wealth.select("strategy").distinct().orderBy("strategy").collect()]
    return [
        ("Summary", report.table(result.summary().orderBy("strategy"))),
        ("Wealth", report.lines(result.wealth, "strategy", "value")),
        ("Drawdown", report.lines(result.drawdowns(), "strategy", "dd")),
        ("Weights over time", "".join(f"<h3>{s}</h3>" + report.stacked_areas(result.weights.filter(F.col("strategy") == s), "symbol", "weight") for s in names)),
        ("Turnover", report.lines(result.blotter, "strategy", "turnover")),
        ("Rolling volatility", report.lines(rolled, "strategy", "roll_vol")),
        ("Rolling Sharpe", report.lines(rolled.filter("roll_sharpe IS NOT NULL"), "strategy", "roll_sharpe")),
        ("Metrics", report.table(result.metrics().orderBy("strategy"))),
        ("Costs", report.table(engine.cost_drag(result.blotter).orderBy("strategy"))),
        ("Out-of-sample statistics", report.table(result.statistics().orderBy("strategy"))),
        *([("Comparison of strategies", report.table(oos.sharpe_differences(rets).orderBy("one", "two")))] if result.n_trials > 1 else []),
    ]


def overfitting(assessment: validation.OverfittingReport) -> Sections:
    return [("Overfitting assessment", report.rows_table([assessment.to_dict()]))]


def combined(analysis: Analysis, *, table: DataFrame | None = None, x: Sequence[str] = (), caps: DataFrame | None = None, recommendation: Recommendation | None = None, strict: bool = False, sims: int = 5000, days: int = 252, seed: int = 42) -> Sections:
    """All analyses of a context. One that fails is a section that says so, or with ``strict`` an error."""
    parts: Mapping[str, Callable[[], Sections]] = {
        "Portfolio": lambda: portfolio(analysis),
        **({"Factors": lambda: factor(analysis, table, x)} if table is not None else {}),
        "Optimisation": lambda: optimization(analysis, caps=caps),
        "Validation": lambda: validated(analysis),
        "Simulation": lambda: monte_carlo(analysis, sims=sims, days=days, seed=seed),
        **({"Recommendation": recommendation.sections} if recommendation else {}),
    }
    out = [*data_quality(analysis.context), *summary(analysis.context)]
    for name, part in parts.items():
        try:
            out += part()
        except Exception as why:  # noqa: BLE001, a report shows what failed
            if strict:
                raise
            out.append(report.failure(name, why))
    return out


def write(path: str, title: str, sections: Sections) -> None:
    """A page of sections; of those with the same heading the first stays."""
    report.write(path, title, sections)
