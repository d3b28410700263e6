"""Investor profiles, alerts, suitability checks and rankings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import solvers
from meridia.operators import oos

#: Most volatility and most weight of one symbol, by tolerance.
PRESETS = {"conservative": (0.08, 0.25), "moderate": (0.12, 0.40), "aggressive": (0.20, 0.60)}
ORDER = tuple(PRESETS)


@dataclass(frozen=True)
class Profile:
    risk_tolerance: str = "moderate"
    max_volatility: float | None = None
    max_weight: float | None = None
    max_drawdown: float | None = None
    liquidity_floor: float = 0.0
    target_return: float | None = None
    excluded: tuple[str, ...] = ()
    sector_caps: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.risk_tolerance not in PRESETS:
            raise ValueError(f"risk_tolerance is one of {', '.join(PRESETS)}")
        for name, preset in zip(("max_volatility", "max_weight"), PRESETS[self.risk_tolerance], strict=True):
            value = getattr(self, name)
            object.__setattr__(self, name, preset if value is None else value)
        if not (0 < self.max_weight <= 1 and self.max_volatility > 0 and 0 <= self.liquidity_floor < 1):
            raise ValueError("limits are out of range")


def combined_tolerance(ability: str, willingness: str) -> str:
    """The lower of the two."""
    return min(ability, willingness, key=ORDER.index)


def build_profile(*, risk_tolerance: str | None = None, ability: str | None = None, willingness: str | None = None, **limits) -> Profile:
    """A profile of a tolerance, or of the lower of ability and willingness."""
    if risk_tolerance is None:
        given = [x for x in (ability, willingness) if x is not None]
        risk_tolerance = min(given, key=ORDER.index) if given else "moderate"
    return Profile(risk_tolerance, **limits)


def limits_of(profile: Profile, symbols: list[str], sectors: Mapping[str, str] | None = None) -> solvers.Limits:
    """What the profile allows the weights of ``symbols``; an error if that leaves no room for the budget."""
    each, budget = bounds(profile, symbols)
    high = np.array([x for _, x in each])
    if profile.sector_caps and sectors is None:
        raise ValueError("sector caps need the sectors of the symbols")
    if profile.sector_caps:
        room = sum(min(profile.sector_caps.get(sector, np.inf), sum(h for s, h in zip(symbols, high, strict=True) if sectors.get(s, "Other") == sector)) for sector in {sectors.get(s, "Other") for s in symbols})
        if room < budget - 1e-12:
            raise ValueError("the sector caps don't leave room for the budget")
    return solvers.sector_limits(symbols, sectors or {}, caps=profile.sector_caps, high=high, budget=budget)


def bounds(profile: Profile, symbols: list[str]) -> tuple[list[tuple[float, float]], float]:
    """Bounds of each symbol's weight and the budget they add up to; an error if that can't be."""
    out = [(0.0, 0.0) if s in profile.excluded else (0.0, profile.max_weight) for s in symbols]
    budget = 1 - profile.liquidity_floor
    if sum(high for _, high in out) < budget - 1e-12:
        raise ValueError("the limits don't leave room for the budget")
    return out, budget


def severity(value: Column, limit: float, band: float = 0.9) -> Column:
    return F.when(value > limit, "breach").when(value >= band * limit, "warning").otherwise("ok")


def _alert(rows: DataFrame, kind: str, subject: Column, value: Column, limit: float) -> DataFrame:
    out = rows.select(F.lit(kind).alias("kind"), subject.alias("subject"), value.alias("value"), F.lit(float(limit)).alias("allowed"))
    return out.select("*", severity(F.col("value"), limit).alias("severity")).filter("severity <> 'ok'")


def weight_alerts(weights: DataFrame, *, max_weight: float = 0.40, sectors: DataFrame | None = None, sector_caps: dict[str, float] | None = None) -> DataFrame:
    """Alerts on (symbol, weight), and on sums by sector of (symbol, sector)."""
    out = _alert(weights, "weight", F.col("symbol"), F.col("weight"), max_weight)
    if sectors is not None:
        by = weights.join(sectors, "symbol", "left").groupBy(F.coalesce("sector", F.lit("Other")).alias("sector")).agg(F.sum("weight").alias("weight"))
        for sector, cap in (sector_caps or {}).items():
            out = out.unionByName(_alert(by.filter(F.col("sector") == sector), "sector", F.col("sector"), F.col("weight"), cap))
    return out


def risk_alerts(portfolio: DataFrame, shares: DataFrame, *, vol_target: float = 0.10, max_drawdown: float = 0.20, max_share: float = 0.40, betas: DataFrame | None = None, max_beta: float | None = None) -> DataFrame:
    """Alerts on (strategy, vol, max_drawdown), on risk shares (strategy, symbol, share) and on loadings (factor, beta)."""
    out = _alert(portfolio, "volatility", F.col("strategy"), F.col("vol"), vol_target)
    out = out.unionByName(_alert(portfolio, "drawdown", F.col("strategy"), F.abs("max_drawdown"), max_drawdown))
    out = out.unionByName(_alert(shares, "risk_share", F.col("symbol"), F.col("share"), max_share))
    if betas is not None and max_beta is not None:
        out = out.unionByName(_alert(betas, "factor", F.col("factor"), F.abs("beta"), max_beta))
    return out


def suitability(weights: DataFrame, profile: Profile, *, sectors: DataFrame | None = None, realized: DataFrame | None = None) -> DataFrame:
    """(check, hard, passed, observed, allowed) of concentration, exclusions, liquidity and sector caps.

    ``realized``: one row (vol, max_drawdown, ann_return) of the weights adds checks of
    volatility and drawdown, and a target return, which is information only (not ``hard``).
    """
    row = lambda frame, name, observed, limit, ok, hard=True: frame.select(F.lit(name).alias("check"), F.lit(hard).alias("hard"), ok.alias("passed"), observed.alias("observed"), F.lit(float(limit)).alias("allowed"))
    most = weights.agg(F.max("weight").alias("w"))
    out = row(most, "concentration", F.col("w"), profile.max_weight, F.col("w") <= profile.max_weight + 1e-9)
    banned = weights.agg(F.coalesce(F.sum(F.when(F.col("symbol").isin(list(profile.excluded)), F.abs("weight"))), F.lit(0.0)).alias("w"))
    out = out.unionByName(row(banned, "exclusions", F.col("w"), 0.0, F.col("w") <= 1e-9))
    cash = weights.agg((1 - F.sum("weight")).alias("w"))
    out = out.unionByName(row(cash, "liquidity", F.col("w"), profile.liquidity_floor, F.col("w") >= profile.liquidity_floor - 1e-9))
    if sectors is not None:
        by = weights.join(sectors, "symbol", "left").groupBy(F.coalesce("sector", F.lit("Other")).alias("sector")).agg(F.sum("weight").alias("w"))
        for sector, cap in profile.sector_caps.items():
            out = out.unionByName(row(by.filter(F.col("sector") == sector), f"sector {sector}", F.col("w"), cap, F.col("w") <= cap + 1e-9))
    if realized is not None:
        out = out.unionByName(row(realized, "volatility", F.col("vol"), profile.max_volatility, F.col("vol") <= profile.max_volatility + 1e-9))
        if profile.max_drawdown is not None:
            out = out.unionByName(row(realized, "drawdown", F.abs("max_drawdown"), profile.max_drawdown, F.abs("max_drawdown") <= profile.max_drawdown + 1e-9))
        if profile.target_return is not None:
            out = out.unionByName(row(realized, "target return", F.col("ann_return"), profile.target_return, F.col("ann_return") >= profile.target_return, hard=False))
    return out


def is_suitable(checks: DataFrame) -> DataFrame:
    """(suitable): whether all hard checks passed."""
    return checks.agg(F.coalesce(F.bool_and(F.col("passed") | ~F.col("hard")), F.lit(True)).alias("suitable"))


def compared(returns: DataFrame, key: str = "strategy", *, by: str = "dsr", n_trials: int | None = None) -> DataFrame:
    """(key, n, sharpe, psr, dsr, rank, winner): strategies ranked, the best finite one being the winner."""
    trials = n_trials or returns.select(key).distinct().count()
    rows = ranking(oos.sharpe_probabilities(returns, key, n_trials=trials), key, by)
    return rows.select("*", ((F.col("rank") == 1) & F.col(by).isNotNull() & ~F.isnan(by)).alias("winner"))


def ranking(rows: DataFrame, key: str = "strategy", by: str = "sharpe") -> DataFrame:
    """Best first; those without a finite number last, ties by name."""
    value = F.when(~F.isnan(by) & (F.abs(by) < float("inf")), F.col(by))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("_v"), key)
    return rows.withColumn("_v", value).select(*rows.columns, F.row_number().over(order).alias("rank"))


def walk_forward_windows(dates: DataFrame, *, train_days: int = 365, step_days: int = 90) -> DataFrame:
    """(window_id, train_start, train_end, test_start, test_end), inclusive, while a test fits."""
    span = dates.agg(F.min("date").alias("low"), F.max("date").alias("high"))
    last = F.date_sub("high", train_days + step_days)
    rows = span.filter(F.col("low") <= last).select(F.explode(F.sequence("low", last, F.expr(f"interval {step_days} days"))).alias("train_start"))
    rows = rows.select("train_start", F.date_add("train_start", train_days).alias("train_end"), F.date_add("train_start", train_days + 1).alias("test_start"), F.date_add("train_start", train_days + step_days).alias("test_end"))
    return rows.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("train_start"))).alias("window_id"), "*")


def in_windows(returns: DataFrame, windows: DataFrame, *, part: str = "test") -> DataFrame:
    """Rows of each window's part. Windows are few and a day is in few of them: each names its days, an equi-join."""
    days = windows.select("window_id", F.explode(F.sequence(f"{part}_start", f"{part}_end", F.expr("interval 1 day"))).alias("date"))
    return returns.join(days, "date")
