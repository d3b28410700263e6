"""Signals and position sizes: all look only at rows up to their own."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.plans.panel import TRADING_DAYS, along, full, so_far, trailing


def trailing_volatility(returns: DataFrame, *, lookback: int = 63, method: str = "ewma", annualize: bool = True, periods: int = TRADING_DAYS, out: str = "vol") -> DataFrame:
    """Volatility of ``ret`` per symbol, null until ``lookback`` returns are there.

    ``simple`` is a moving standard deviation, ``ewma`` the bias-corrected exponential one
    of that span.
    """
    if method not in ("simple", "ewma"):
        raise ValueError(f"unknown method {method!r}")
    scale = periods**0.5 if annualize else 1.0
    if method == "simple":
        over = trailing(lookback, "symbol")
        return returns.select("*", (full(F.stddev_samp("ret").over(over), F.col("ret"), lookback, over) * scale).alias(out))
    return _ewma(returns, lookback, scale, out)


def _ewma(returns: DataFrame, span: int, scale: float, out: str) -> DataFrame:
    """Exponential standard deviation from running sums of weighted powers.

    Weights grow by 1 / (1 - a) a row. They start anew after as many rows as multiply them by
    1e100; the sums of the block before are brought to the new base, so no weight leaves
    the range of doubles however long a series is.
    """
    a = 2.0 / (span + 1)
    decay = 1 - a
    block_rows = max(2, int(-230 / math.log(decay))) if 0 < decay < 1 else 2
    rows = returns.select("*", F.count("ret").over(so_far("symbol")).alias("_n"))
    i = F.greatest(F.col("_n") - 1, F.lit(0))
    rows = rows.select("*", F.floor(i / block_rows).cast("long").alias("_block"), (i % block_rows).alias("_at"))
    w = F.when(F.col("ret").isNotNull(), F.when(F.col("_n") == 1, 1.0).otherwise(a) * F.pow(F.lit(decay), -F.col("_at")))
    over = Window.partitionBy("symbol", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"_s1": w * F.col("ret"), "_s2": w * F.col("ret") * F.col("ret"), "_q": w * w}
    rows = rows.select("*", *(F.sum(v).over(over).alias(k) for k, v in sums.items()))
    ends = rows.groupBy("symbol", "_block").agg(*(F.max_by(k, "date").alias(f"{k}e") for k in sums)).select("symbol", (F.col("_block") + 1).alias("_block"), *(f"{k}e" for k in sums))
    rows = rows.join(ends, ["symbol", "_block"], "left")
    carried = lambda k, power: F.coalesce(F.col(k), F.lit(0.0)) + F.coalesce(F.col(f"{k}e"), F.lit(0.0)) * decay ** (block_rows * power)
    at = F.pow(F.lit(decay), F.col("_at"))
    mean = at * carried("_s1", 1)
    var = at * carried("_s2", 1) - mean * mean
    divisor = 1 - at * at * carried("_q", 2)
    value = F.when((F.col("_n") >= span) & (divisor > 0) & F.col("ret").isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)) / divisor) * scale)
    return rows.select(*returns.columns, value.alias(out))


def momentum_signal(panel: DataFrame, *, lookback: int = 252, skip: int = 21) -> DataFrame:
    """Sign of the return from ``lookback`` to ``skip`` rows ago."""
    w = along("symbol")
    return panel.select("*", F.signum(F.try_divide(F.lag("price", skip).over(w), F.lag("price", lookback).over(w)) - 1).alias("signal"))


def crossover_signal(panel: DataFrame, *, fast: int = 50, slow: int = 200) -> DataFrame:
    if fast >= slow:
        raise ValueError("fast has to be shorter than slow")
    mean = lambda n: full(F.avg("price").over(trailing(n, "symbol")), F.col("price"), n, trailing(n, "symbol"))
    return panel.select("*", F.signum(mean(fast) - mean(slow)).alias("signal"))


def momentum_score(panel: DataFrame, *, lookback: int = 252, skip: int = 21) -> DataFrame:
    """Return of the lookback as a z-score among the symbols of a date."""
    w, day = along("symbol"), Window.partitionBy("date")
    rows = panel.select("*", (F.try_divide(F.lag("price", skip).over(w), F.lag("price", lookback).over(w)) - 1).alias("past"))
    sd = F.stddev_samp("past").over(day)
    return rows.select("*", ((F.col("past") - F.avg("past").over(day)) / F.when(sd != 0, sd)).alias("score")).drop("past")


def reversion_signal(panel: DataFrame, *, lookback: int = 20) -> DataFrame:
    """How many moving standard deviations a price is from its moving mean."""
    over = trailing(lookback, "symbol")
    sd = full(F.stddev_samp("price").over(over), F.col("price"), lookback, over)
    return panel.select("*", ((F.col("price") - F.avg("price").over(over)) / F.when(sd != 0, sd)).alias("score"))


def vol_target_positions(rows: DataFrame, *, target: float = 0.10, max_leverage: float = 2.0, scaling: str = "per_asset", cov: DataFrame | None = None, periods: int = TRADING_DAYS) -> DataFrame:
    """Positions from (date, symbol, signal, vol): the last row's volatility scales the signal to the target.

    ``portfolio`` scales all of a date alike, by the sum of |signal| * vol, or with ``cov``
    (i, j, cov) by the forecast volatility of |signal|. Gross exposure is capped.
    """
    if scaling not in ("per_asset", "portfolio"):
        raise ValueError(f"unknown scaling {scaling!r}")
    before = lambda x: F.lag(x).over(along("symbol"))
    day = Window.partitionBy("date")
    if scaling == "per_asset":
        prior = before("vol")
        out = rows.select("*", (F.col("signal") * target / F.when(prior != 0, prior)).alias("position"))
    elif cov is None:
        total = F.sum(F.abs("signal") * F.col("vol")).over(day)
        out = rows.select("*", total.alias("_total")).select("*", before("_total").alias("_prior"))
        out = out.select("*", (F.col("signal") * target / F.when(F.col("_prior") != 0, F.col("_prior"))).alias("position")).drop("_total", "_prior")
    else:
        one, two = rows.select("date", F.col("symbol").alias("i"), F.abs("signal").alias("a")), rows.select("date", F.col("symbol").alias("j"), F.abs("signal").alias("b"))
        total = one.join(cov, "i").join(two, ["date", "j"]).groupBy("date").agg(F.sqrt(F.greatest(F.sum(F.col("a") * F.col("b") * F.col("cov")), F.lit(0.0))).alias("_total"))
        out = rows.join(total, "date", "left").select("*", before("_total").alias("_prior"))
        out = out.select("*", (F.col("signal") * target / F.when(F.col("_prior") != 0, F.col("_prior"))).alias("position")).drop("_total", "_prior")
    gross = F.sum(F.abs("position")).over(day)
    return out.select(*(c for c in out.columns if c != "position"), (F.col("position") * F.least(F.lit(1.0), max_leverage / F.when(gross != 0, gross))).alias("position"))


def long_only_schedule(rows: DataFrame, value: str = "position") -> DataFrame:
    """Weights of each date: below 0 is 0, sum 1; dates with a null are left out, all zeros give equal weights."""
    day = Window.partitionBy("date")
    kept = F.greatest(F.col(value), F.lit(0.0))
    out = rows.select("date", "symbol", kept.alias("w"), F.sum(F.col(value).isNull().cast("int")).over(day).alias("missing"))
    out = out.filter("missing = 0").select("date", "symbol", "w", F.sum("w").over(day).alias("total"), F.count(F.lit(1)).over(day).alias("n"))
    return out.select("date", "symbol", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1 / F.col("n")).alias("weight"))


def inverse_vol_weights(vols: DataFrame) -> DataFrame:
    """(symbol, weight) from the last ``vol`` of each symbol; unusable ones get 0, all unusable equal weights."""
    last = vols.groupBy("symbol").agg(F.max_by("vol", "date").alias("vol"))
    inverse = F.when(F.col("vol") > 0, 1 / F.col("vol")).otherwise(0.0)
    every = Window.partitionBy(F.lit(0))
    rows = last.select("symbol", inverse.alias("inverse")).select("*", F.sum("inverse").over(every).alias("total"), F.count(F.lit(1)).over(every).alias("n"))
    return rows.select("symbol", F.when(F.col("total") > 0, F.col("inverse") / F.col("total")).otherwise(1 / F.col("n")).alias("weight"))


def kelly_fraction(mean_excess: Column, variance: Column) -> Column:
    return F.when(variance > 0, mean_excess / variance).otherwise(0.0)


def cppi_risky_weight(floor: Column, multiplier: float, value: Column, cap: float = 1.0) -> Column:
    """Share in the risky asset; the rest is safe."""
    cushion = multiplier * F.greatest(F.lit(0.0), value - floor) / F.when(value > 0, value)
    return F.when(value <= 0, 0.0).otherwise(F.least(cushion, F.lit(max(0.0, cap)), F.lit(1.0)))


def tilt_weights(base: DataFrame, scores: DataFrame, *, strength: float = 0.1) -> DataFrame:
    """Base weights moved towards those in proportion to positive scores."""
    if not 0 <= strength <= 1:
        raise ValueError("strength is from 0 to 1")
    every = Window.partitionBy(F.lit(0))
    rows = base.join(scores, "symbol", "left").select("symbol", (F.col("weight") / F.sum("weight").over(every)).alias("base"), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("score"))
    total = F.sum("score").over(every)
    rows = rows.select("symbol", "base", F.when(total > 0, F.least(F.greatest(F.col("base") + strength * (F.col("score") / F.when(total > 0, total) - F.col("base")), F.lit(0.0)), F.lit(1.0))).otherwise(F.col("base")).alias("w"))
    return rows.select("symbol", (F.col("w") / F.sum("w").over(every)).alias("weight"))


def target_vol_scalar(last_vol: Column, target: float = 0.10) -> Column:
    """Leverage to a target volatility, from 0 to 5; 1 where the volatility is unusable."""
    return F.when(last_vol > 0, F.least(F.greatest(target / F.when(last_vol > 0, last_vol), F.lit(0.0)), F.lit(5.0))).otherwise(1.0)


def trend_following(panel: DataFrame, *, momentum: tuple[int, int] = (252, 21), average: tuple[int, int] = (50, 200), target: float = 0.10, vol_lookback: int = 63, max_leverage: float = 2.0) -> DataFrame:
    """Schedule of the mean of momentum and crossover signals, sized to a volatility target, long only."""
    from meridia.plans.panel import with_returns

    both = [momentum_signal(panel, lookback=momentum[0], skip=momentum[1]).withColumnRenamed("signal", "s0"), crossover_signal(panel, fast=average[0], slow=average[1]).select("date", "symbol", F.col("signal").alias("s1"))]
    signals = reduce(lambda a, b: a.join(b, ["date", "symbol"]), both).select("date", "symbol", "price", ((F.col("s0") + F.col("s1")) / 2).alias("signal"))
    sized = trailing_volatility(with_returns(signals, "symbol"), lookback=vol_lookback)
    return long_only_schedule(vol_target_positions(sized, target=target, max_leverage=max_leverage))
