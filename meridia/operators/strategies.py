"""Strategies as functions from a panel to targets, and their backtests as one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.metrics import summary_metrics
from meridia.operators import engine, oos, optimize, series, signals
from meridia.plans.panel import with_returns

#: A panel (date, symbol, price) to (symbol, weight), or with eff_date to a schedule.
Strategy = Callable[[DataFrame], DataFrame]


def fixed(weights: Mapping[str, float]) -> Strategy:
    return lambda panel: panel.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "symbol string, weight double")


def solved(method: str) -> Strategy:
    """Weights of a method of ``optimize`` on the whole panel."""
    if method not in optimize.METHODS:
        raise ValueError(f"unknown method {method!r}")
    return lambda panel: optimize.optimized(with_returns(panel).withColumn("_all", F.lit(1)), "_all", [method]).select("symbol", "weight")


def inverse_vol(lookback: int = 63, method: str = "ewma") -> Strategy:
    return lambda panel: signals.inverse_vol_weights(signals.trailing_volatility(with_returns(panel), lookback=lookback, method=method))


def trend_following(**options: float) -> Strategy:
    return lambda panel: signals.trend_following(panel, **options).withColumnRenamed("date", "eff_date")


def cross_sectional_momentum(lookback: int = 126, skip: int = 5, target: float = 0.10, vol_lookback: int = 63) -> Strategy:
    def weights(panel: DataFrame) -> DataFrame:
        scored = signals.momentum_score(panel, lookback=lookback, skip=skip)
        held = scored.select("date", "symbol", "price", F.when(F.col("score") > 0, 1.0).when(F.col("score").isNotNull(), 0.0).alias("signal"))
        sized = signals.vol_target_positions(signals.trailing_volatility(with_returns(held), lookback=vol_lookback), target=target)
        return signals.long_only_schedule(sized).withColumnRenamed("date", "eff_date")

    return weights


def vol_overlay(base: Strategy, *, target: float = 0.10, lookback: int = 63, max_leverage: float = 2.0) -> Strategy:
    """Weights of ``base`` tilted each day to symbols of low volatility.

    Those of a schedule are the ones that are in force on a day; days before its first
    one have none. Symbols that the base leaves out have no weight.
    """

    def weights(panel: DataFrame) -> DataFrame:
        held = base(panel)
        if "eff_date" in held.columns:
            named = F.lit("base").alias("strategy")
            grid = panel.select(named, "date", "symbol", "price")
            rows = engine.as_of_weights(grid, held.select(named, "eff_date", "symbol", "weight")).withColumnRenamed("target", "signal")
            begun = F.max(F.col("signal").isNotNull()).over(Window.partitionBy("date"))
            rows = rows.select("date", "symbol", "price", F.when(begun, F.coalesce("signal", F.lit(0.0))).alias("signal"))
        else:
            rows = panel.join(held.select("symbol", F.col("weight").alias("signal")), "symbol", "left").fillna(0.0, ["signal"])
        rows = with_returns(rows)
        sized = signals.vol_target_positions(signals.trailing_volatility(rows, lookback=lookback), target=target, max_leverage=max_leverage)
        return signals.long_only_schedule(sized).withColumnRenamed("date", "eff_date")

    return weights


@dataclass(frozen=True)
class Backtest:
    wealth: DataFrame
    blotter: DataFrame
    n_trials: int
    #: (strategy, date, symbol, weight) as they drift between rebalances.
    weights: DataFrame

    @property
    def returns(self) -> DataFrame:
        return with_returns(self.wealth.withColumnRenamed("value", "price"), "strategy").filter("ret IS NOT NULL").select("strategy", "date", "ret")

    def metrics(self, benchmark: DataFrame | None = None) -> DataFrame:
        """Family B of every strategy; ``benchmark``: (date, bench) returns."""
        rows = self.returns if benchmark is None else self.returns.join(benchmark, "date")
        return summary_metrics(rows, "strategy")

    def statistics(self) -> DataFrame:
        return oos.sharpe_probabilities(self.returns, "strategy", n_trials=self.n_trials)

    def summary(self) -> DataFrame:
        return engine.summary(self.wealth, self.blotter)

    def drawdowns(self) -> DataFrame:
        return series.drawdown_curve(self.wealth, "strategy")


def backtest(strategies: Mapping[str, Strategy], panel: DataFrame, *, mode: str | int | None = "M", **costs: float) -> Backtest:
    """All strategies at once: static ones as one plan, scheduled ones as another."""
    if not strategies:
        raise ValueError("no strategy")
    static, dated = [], []
    for name, strategy in strategies.items():
        targets = strategy(panel).withColumn("strategy", F.lit(name))
        (dated if "eff_date" in targets.columns else static).append(targets)
    runs = []
    for targets in (reduce(DataFrame.unionByName, x) for x in (static, dated) if x):
        runs.append((*engine.simulate(panel, targets, mode=mode, **costs), engine.weight_history(panel, targets, mode)))
    wealth, blotter, weights = (reduce(DataFrame.unionByName, x) for x in zip(*runs, strict=True))
    return Backtest(wealth, blotter, len(strategies), weights)
