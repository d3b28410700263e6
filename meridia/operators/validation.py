"""What holds outside the sample: splits, rolling windows and overfitting tables."""

from __future__ import annotations

import datetime
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import metrics
from meridia.operators import oos, optimize, planning, series, shortfall
from meridia.plans.panel import with_returns


def held(panel: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
    """(strategy, keys, date, price) of weights (strategy, keys, symbol, weight) that are bought once and held."""
    rows = panel.join(weights, [*keys, "symbol"])
    grown = series.growth_of_one(rows, "strategy", *keys, "symbol")
    return grown.groupBy("strategy", *keys, "date").agg(F.sum(F.col("weight") * F.col("growth")).alias("price"))


def _realized(values: DataFrame, *keys: str) -> DataFrame:
    rows = with_returns(values, "strategy", *keys).filter("ret IS NOT NULL")
    uw = metrics.underwater(rows, "strategy", *keys)
    return uw.groupBy("strategy", *keys).agg(
        metrics.cagr().alias("cagr"), metrics.annual_volatility().alias("ann_vol"), metrics.sharpe(rf=0.02).alias("sharpe"), F.min("uw").alias("max_drawdown"), F.count("ret").alias("n")
    )


def split_metrics(panel: DataFrame, weights: DataFrame, train_end: datetime.date) -> DataFrame:
    """(strategy, split, cagr, ann_vol, sharpe, max_drawdown, n): weights held over either side of a date.

    ``weights``: (strategy, symbol, weight). Both sides are keys of one plan; each starts anew.
    """
    sides = panel.select("*", F.when(F.col("date") <= F.lit(train_end), "train").otherwise("test").alias("split"))
    both = weights.join(panel.sparkSession.createDataFrame([("train",), ("test",)], "split string"), F.lit(True))
    return _realized(held(sides, both, "split"), "split")


def overfitting_scores(splits: DataFrame) -> DataFrame:
    """(strategy, sharpe_lost, cagr_lost): shares of the train's numbers that the test doesn't have."""
    of = lambda side, c: F.max(F.when(F.col("split") == side, F.col(c)))
    rows = splits.groupBy("strategy").agg(*(of(side, c).alias(f"{side}_{c}") for side in ("train", "test") for c in ("sharpe", "cagr")))
    lost = lambda c: F.coalesce(oos.overfitting_score(F.col(f"train_{c}"), F.col(f"test_{c}")), F.lit(0.0)).alias(f"{c}_lost")
    return rows.select("*", lost("sharpe"), lost("cagr"))


def rolling(
    panel: DataFrame,
    methods: Sequence[str],
    *,
    fixed: DataFrame | None = None,
    train_days: int = 365,
    step_days: int = 90,
    limiter: optimize.Limiter | None = None,
    estimator: str = "sample",
    components: int = 3,
    objective: optimize.Objective | None = None,
) -> DataFrame:
    """(window_id, strategy, is_sharpe, oos_sharpe): each window's weights held over its train and its test.

    ``fixed``: (strategy, symbol, weight) that take part in every window as they are. Each
    window has its own covariance, by ``estimator``.
    """
    returns = with_returns(panel)
    windows = planning.walk_forward_windows(panel.select("date"), train_days=train_days, step_days=step_days)
    parts = {part: planning.in_windows(returns, windows, part=part).select("window_id", "date", "symbol", "price", "ret", "log_ret") for part in ("train", "test")}
    paired = [m for m in methods if m != "cvar"]
    weights = optimize.optimized(parts["train"], "window_id", paired, limiter=limiter, estimator=estimator, components=components, objective=objective) if paired else None
    if "cvar" in methods:
        tails = shortfall.min_shortfall_by(parts["train"], "window_id", limiter=limiter)
        weights = tails if weights is None else weights.unionByName(tails)
    if fixed is not None:
        every = fixed.join(windows.select("window_id"), F.lit(True)).select("window_id", "strategy", "symbol", "weight")
        weights = every if weights is None else weights.unionByName(every)

    def sharpes(part: str, name: str) -> DataFrame:
        values = held(parts[part], weights, "window_id")
        return with_returns(values, "strategy", "window_id").groupBy("window_id", "strategy").agg(metrics.sharpe().alias(name))

    return sharpes("train", "is_sharpe").join(sharpes("test", "oos_sharpe"), ["window_id", "strategy"])


def rolling_schedule(panel: DataFrame, methods: Sequence[str], *, train_days: int = 365, step_days: int = 90, limiter: optimize.Limiter | None = None) -> DataFrame:
    """(strategy, eff_date, symbol, weight): each window's weights from the first day of its test on."""
    windows = planning.walk_forward_windows(panel.select("date"), train_days=train_days, step_days=step_days)
    weights = optimize.optimized(planning.in_windows(with_returns(panel), windows, part="train"), "window_id", list(methods), limiter=limiter)
    return weights.join(windows, "window_id").select("strategy", F.col("test_start").alias("eff_date"), "symbol", "weight")


@dataclass(frozen=True)
class OverfittingReport:
    """One row of ``assessed``, brought to the driver."""

    values: dict[str, object]

    def to_dict(self) -> dict[str, object]:
        return dict(self.values)

    def to_text(self) -> str:
        return "\n".join(f"{k}: {'n/a' if v is None else v if not isinstance(v, float) else round(v, 4)}" for k, v in self.values.items())

    def to_json(self) -> str:
        return json.dumps(self.values)


def assessed(returns: DataFrame, *, n_trials: int | None = None, blocks: int = 16) -> DataFrame:
    """(best, pbo, slope, oos_loss, splits, psr, dsr, min_track_record, verdict) of configurations (date, config, ret).

    Only dates on which all configurations have a return count. The best is that of the
    highest Sharpe over all dates, the first name on ties. A single configuration has no
    pbo, and its verdict rests on the deflated ratio.
    """
    of = Window.partitionBy("date")
    configs = returns.select("config").distinct().count()
    rows = returns.filter("ret IS NOT NULL").select("date", "config", "ret", F.count(F.lit(1)).over(of).alias("_n")).filter(F.col("_n") == configs)
    numbered = rows.select("date").distinct().select("date", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).alias("t"))  # a row a date
    rows = rows.join(numbered, "date")
    stats = oos.sharpe_probabilities(rows, "config", n_trials=n_trials or configs).join(oos.track_record_length(rows, "config"), "config")
    best = stats.orderBy(F.desc_nulls_last("sharpe"), "config").limit(1).select(F.col("config").alias("best"), "psr", "dsr", "min_track_record")
    if configs > 1:
        pbo = oos.overfitting_probability(oos.cscv_splits(rows.select("t", "config", "ret"), blocks=blocks))
    else:
        pbo = rows.agg(*(F.lit(None).cast("double").alias(c) for c in ("pbo", "slope", "oos_loss")), F.lit(0).cast("long").alias("splits"))
    return pbo.join(F.broadcast(best), F.lit(True), "left").select("*", oos.verdict(F.col("pbo"), F.col("dsr")).alias("verdict"))


def report_of(assessment: DataFrame) -> OverfittingReport:
    return OverfittingReport(assessment.first().asDict())
