"""Recommended weights with trades, alerts, suitability, a comparison and an out-of-sample check."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions import metrics
from meridia.operators import engine, moments, optimize, planning, report, series, shortfall, validation
from meridia.plans.panel import with_returns


@dataclass(frozen=True)
class Recommendation:
    """Frames of a recommendation. Weights are solved once: all other frames start from rows that are known."""

    weights: DataFrame
    alerts: DataFrame
    suitability: DataFrame | None = None
    trades: DataFrame | None = None
    plan: DataFrame | None = None
    comparison: DataFrame | None = None
    validation: DataFrame | None = None
    evidence: Mapping[str, object] | None = None

    def parts(self) -> dict[str, DataFrame]:
        return {k: v for k, v in vars(self).items() if isinstance(v, DataFrame)}

    @cached_property
    def _rows(self) -> dict[str, list[dict]]:
        return {k: [json.loads(x) for x in v.toJSON().collect()] for k, v in self.parts().items()}

    def to_dict(self) -> dict[str, object]:
        return self._rows | ({"evidence": dict(self.evidence)} if self.evidence else {})

    def to_text(self) -> str:
        return "\n".join(f"{k}:\n" + "\n".join("  " + json.dumps(r) for r in rows) for k, rows in self._rows.items())

    def sections(self) -> list[tuple[str, str]]:
        return [(f"Recommendation: {k}", report.rows_table(rows)) for k, rows in self._rows.items()]

    def to_html(self, path: str, title: str = "Recommendation") -> None:
        report.write(path, title, self.sections())


def _sector_map(sectors: DataFrame | None) -> dict[str, str] | None:
    """Symbols and their sectors; symbols are those of a portfolio."""
    return None if sectors is None else {r.symbol: r.sector for r in sectors.select("symbol", "sector").collect()}


def limiter(profile: planning.Profile | None, sectors: DataFrame | None) -> optimize.Limiter | None:
    """The profile's limits for the symbols of a problem."""
    if profile is None:
        return None
    of = _sector_map(sectors)
    return lambda symbols: planning.limits_of(profile, symbols, of)


def _solved(panel: DataFrame, method: str, profile: planning.Profile | None, sectors: DataFrame | None, estimator: str, components: int, objective: optimize.Objective | None) -> DataFrame:
    limits = limiter(profile, sectors)
    if limits:
        limits([r.symbol for r in panel.select("symbol").distinct().collect()])  # infeasible limits are known here, not in a task
    if method == "cvar":
        return shortfall.min_shortfall(with_returns(panel), limiter=limits)
    return optimize.estimated(with_returns(panel), method, estimator=estimator, components=components, limiter=limits, objective=objective)


def recommend_weights(
    panel: DataFrame,
    *,
    method: str = "max_sharpe",
    profile: planning.Profile | None = None,
    sectors: DataFrame | None = None,
    estimator: str = "sample",
    components: int = 3,
    objective: optimize.Objective | None = None,
) -> DataFrame:
    """(symbol, weight) of a method within the profile's limits; an error if these leave no room.

    Methods are those of ``optimize.METHODS``, ``optimize`` with an ``objective``, and
    ``cvar``: the least mean of the worst returns, which no covariance takes part in.
    """
    return _solved(panel, method, profile, sectors, estimator, components, objective).select("symbol", "weight")


def walk_forward(
    panel: DataFrame,
    method: str,
    *,
    train_days: int = 365,
    step_days: int = 90,
    most_lost: float = 0.5,
    profile: planning.Profile | None = None,
    sectors: DataFrame | None = None,
    estimator: str = "sample",
    components: int = 3,
    objective: optimize.Objective | None = None,
    current: DataFrame | None = None,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Whether advice holds up: the Sharpe of weights that are solved anew in each window, outside of it, against those of the whole panel inside.

    Each window is solved by the method, estimator, objective and limits of the advice
    itself. ``in_sample_sharpe`` is that of the advice (``weights``, else solved here) held
    over the whole panel; ``baseline_sharpe`` is the ``current`` weights' (symbol, weight)
    outside the same windows; ``is_sharpe`` is the windows' own inside.
    """
    now = None if current is None else current.select(F.lit("current").alias("strategy"), "symbol", "weight")
    rolled = validation.rolling(
        panel, [method], fixed=now, train_days=train_days, step_days=step_days, limiter=limiter(profile, sectors), estimator=estimator, components=components, objective=objective
    )
    advice = F.col("strategy") == method
    row = rolled.agg(
        F.count(F.when(advice, 1)).alias("windows"),
        F.avg(F.when(advice, F.col("is_sharpe"))).alias("is_sharpe"),
        F.avg(F.when(advice, F.col("oos_sharpe"))).alias("oos_sharpe"),
        F.avg(F.when(~advice, F.col("oos_sharpe"))).alias("baseline_sharpe"),
    )
    held = _solved(panel, method, profile, sectors, estimator, components, objective) if weights is None else weights
    whole = series.buy_and_hold(panel, held.select("symbol", "weight")).select(F.lit(method).alias("strategy"), "date", F.col("value").alias("price"))
    row = row.join(F.broadcast(with_returns(whole, "strategy").agg(metrics.sharpe(rf=0.02).alias("in_sample_sharpe"))), F.lit(True))  # a row each
    lost = F.when(F.col("in_sample_sharpe") > 0, F.greatest(F.lit(0.0), (F.col("in_sample_sharpe") - F.col("oos_sharpe")) / F.when(F.col("in_sample_sharpe") > 0, F.col("in_sample_sharpe"))))
    holds = F.when(F.col("windows") == 0, "inconclusive").when((F.col("oos_sharpe") > 0) & (F.coalesce("degradation", F.lit(0.0)) <= most_lost), "holds up").otherwise("fragile")
    return row.select("*", lost.alias("degradation")).select("*", holds.alias("verdict"))


def _evidence(rows: list, method: str, estimator: str, objective: optimize.Objective | None) -> dict[str, object]:
    """What the solved rows promise, and why these weights, in words."""
    if not rows:
        return {}
    found = {k: v for k, v in rows[0].asDict().items() if k not in ("symbol", "weight") and v is not None}
    if method == "cvar":
        return found | {"rationale": f"Weights with the least mean loss in the worst {found['tail']:.0%} of periods: {found['shortfall']:.2%}, at least {found['bound']:.2%} for any weights within the limits."}
    name = getattr(objective or optimize.neg_sharpe, "__name__", "objective") if method == "optimize" else method
    forecast = method in ("optimize", "max_sharpe")
    text = f"Weights by {name} on the {estimator} covariance" + ("" if forecast else ", without a forecast of returns")
    text += f": Sharpe {found['sharpe']:.2f}, return {found['expected_return']:.2%}, volatility {found['expected_vol']:.2%} a year, of log returns."
    if "shrinkage" in found:
        text += f" The covariance is shrunk by {found['shrinkage']:.2f}."
    return found | {"objective": name, "uses_return_forecast": forecast, "rationale": text}


def realized(panel: DataFrame, weights: DataFrame, strategy: str) -> DataFrame:
    """(strategy, vol, max_drawdown, ann_return) of weights held over the panel."""
    returns = with_returns(panel)
    named = weights.withColumn("strategy", F.lit(strategy))
    held = series.buy_and_hold(panel, weights).withColumn("strategy", F.lit(strategy))
    curve = series.drawdown_curve(held, "strategy").groupBy("strategy").agg(F.min("dd").alias("max_drawdown"))
    annual = with_returns(held.withColumnRenamed("value", "price"), "strategy").groupBy("strategy").agg(metrics.cagr().alias("ann_return"))
    return moments.forecast_vol(named, moments.covariance(returns)).join(curve, "strategy").join(annual, "strategy")


def recommend(
    panel: DataFrame,
    *,
    method: str = "max_sharpe",
    profile: planning.Profile | None = None,
    current: DataFrame | None = None,
    sectors: DataFrame | None = None,
    threshold: float = 0.0,
    cost_model: engine.Cost | None = None,
    results: DataFrame | None = None,
    betas: DataFrame | None = None,
    max_beta: float | None = None,
    estimator: str = "sample",
    components: int = 3,
    objective: optimize.Objective | None = None,
    validate: bool = False,
) -> Recommendation:
    """Weights of ``method`` within the profile's limits, what to trade from ``current``, and what speaks against them.

    ``objective`` is what the method ``optimize`` minimises. The evidence says how the
    weights came about and what they promise; with ``validate`` the same choices are
    solved anew in rolling windows, with ``current`` as the baseline.

    ``results``: returns (strategy, date, ret) of strategies to compare. ``betas``:
    (factor, beta) of the portfolio, for alerts above ``max_beta``.
    """
    solved = _solved(panel, method, profile, sectors, estimator, components, objective)
    # a row a symbol; solved once, whatever is asked of it afterwards
    rows = solved.collect()
    weights = panel.sparkSession.createDataFrame(rows, solved.schema).select("symbol", "weight")
    limits = profile or planning.Profile()
    returns = with_returns(panel)
    state = realized(panel, weights, method)
    shares = moments.risk_contributions(weights.withColumn("strategy", F.lit(method)), moments.covariance(returns))
    alerts = planning.risk_alerts(state, shares, vol_target=limits.max_volatility if profile else 0.10, max_drawdown=limits.max_drawdown or 0.20, betas=betas, max_beta=max_beta)
    alerts = alerts.unionByName(planning.weight_alerts(weights, max_weight=limits.max_weight, sectors=sectors, sector_caps=limits.sector_caps))
    trades = engine.rebalance_trades(current, weights, threshold=threshold) if current is not None else None
    return Recommendation(
        weights,
        alerts,
        planning.suitability(weights, profile, sectors=sectors, realized=state) if profile else None,
        trades,
        engine.rebalance_plan(trades, cost_model=cost_model) if trades is not None else None,
        planning.compared(results) if results is not None else None,
        walk_forward(panel, method, profile=profile, sectors=sectors, estimator=estimator, components=components, objective=objective, current=current, weights=weights) if validate else None,
        {"method": method, "estimator": estimator, "risk_tolerance": limits.risk_tolerance if profile else None} | _evidence(rows, method, estimator, objective),
    )
