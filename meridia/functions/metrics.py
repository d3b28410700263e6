"""Realised metrics of return series, as aggregates of one column.

Two families are kept apart on purpose. *B* is on simple returns and null where it is
not defined; *A* (``report_metrics``) gives 0 there, takes calendar years and has a
drawdown without a start row. All take null returns as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.quantiles import exact_quantiles
from meridia.plans.panel import TRADING_DAYS, so_far

Name = str | Column


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


def growth(ret: Name = "ret") -> Column:
    return F.product(1 + _c(ret))


def cagr(ret: Name = "ret", periods: int = TRADING_DAYS) -> Column:
    g, n = growth(ret), F.count(_c(ret))
    return F.when((n > 0) & (g > 0), F.pow(g, F.lit(float(periods)) / n) - 1)


def annual_volatility(ret: Name = "ret", periods: int = TRADING_DAYS) -> Column:
    return F.when(F.count(_c(ret)) > 1, F.stddev_samp(_c(ret))) * periods**0.5


def sharpe(ret: Name = "ret", rf: float = 0.0, periods: int = TRADING_DAYS) -> Column:
    return F.when(F.count(_c(ret)) > 1, (F.avg(_c(ret)) - rf / periods) / _nonzero(F.stddev_samp(_c(ret))) * periods**0.5)


def downside_deviation(ret: Name = "ret", mar: float = 0.0, periods: int = TRADING_DAYS) -> Column:
    below = F.when(_c(ret) < mar, F.pow(_c(ret) - mar, F.lit(2.0)))
    return F.when(F.count(below) > 0, F.sqrt(F.sum(below) / F.count(_c(ret)))) * periods**0.5


def sortino(ret: Name = "ret", rf: float = 0.0, periods: int = TRADING_DAYS) -> Column:
    excess = (F.avg(_c(ret)) - rf / periods) * periods
    return F.when(F.count(_c(ret)) > 1, excess / _nonzero(downside_deviation(ret, rf / periods, periods)))


def value_at_risk(ret: Name = "ret", confidence: float = 0.95) -> Column:
    """A loss as a positive number, from the exact quantile with linear interpolation; ``expected_shortfall`` is for keys of any size."""
    return F.when(F.count(_c(ret)) > 1, -F.percentile(_c(ret), F.lit(1 - confidence)))


def omega(ret: Name = "ret", threshold: float = 0.0) -> Column:
    gains = F.coalesce(F.sum(F.when(_c(ret) > threshold, _c(ret) - threshold)), F.lit(0.0))
    return gains / _nonzero(F.sum(F.when(_c(ret) < threshold, threshold - _c(ret))))


def hit_rate(ret: Name = "ret") -> Column:
    return F.avg((_c(ret) > 0).cast("double"))


def win_loss_ratio(ret: Name = "ret") -> Column:
    return F.avg(F.when(_c(ret) > 0, _c(ret))) / F.abs(F.avg(F.when(_c(ret) < 0, _c(ret))))


def tail_ratio(ret: Name = "ret") -> Column:
    q = F.percentile(_c(ret), F.array(F.lit(0.95), F.lit(0.05)))
    return F.when(F.count(_c(ret)) > 1, F.abs(q[0]) / _nonzero(F.abs(q[1])))


def skewness(ret: Name = "ret") -> Column:
    """Bias-corrected; Spark's own is of the population."""
    n = F.count(_c(ret))
    return F.when((n > 2) & (F.stddev_pop(_c(ret)) > 0), F.skewness(_c(ret)) * F.sqrt(n * (n - 1.0)) / F.greatest(n - 2, F.lit(1)))


def kurtosis(ret: Name = "ret") -> Column:
    n = F.count(_c(ret))
    factor = (n - 1.0) / F.greatest((n - 2.0) * (n - 3.0), F.lit(1.0))
    return F.when((n > 3) & (F.stddev_pop(_c(ret)) > 0), factor * ((n + 1.0) * F.kurtosis(_c(ret)) + 6.0))


def tracking_error(active: Name = "active", periods: int = TRADING_DAYS) -> Column:
    return F.stddev_samp(_c(active)) * periods**0.5


def information_ratio(active: Name = "active", periods: int = TRADING_DAYS) -> Column:
    return F.avg(_c(active)) / _nonzero(F.stddev_samp(_c(active))) * periods**0.5


def underwater(returns: DataFrame, *keys: str) -> DataFrame:
    """``growth`` and ``uw``: below the highest growth so far, the start (1) included."""
    over = so_far(*keys)
    rows = returns.filter("ret IS NOT NULL").select("*", F.product(1 + F.col("ret")).over(over).alias("growth"))
    peak = F.greatest(F.lit(1.0), F.max("growth").over(over))
    return rows.select("*", (F.col("growth") / peak - 1).alias("uw"))


def expected_shortfall(returns: DataFrame, *keys: str, confidence: float = 0.95) -> DataFrame:
    """keys, var and cvar as positive losses: the quantile, and the mean of what is at or below it."""
    cut = exact_quantiles(returns, keys, "ret", [1 - confidence], ["q"], tails=True)
    return cut.filter("n > 1").select(*keys, (-F.col("q")).alias("var"), (-F.col("q_mean")).alias("cvar"))


def summary_metrics(returns: DataFrame, *keys: str, rf: float = 0.02, periods: int = TRADING_DAYS, confidence: float = 0.95) -> DataFrame:
    """One row of all metrics of family B for each key; with a column ``bench`` also those against it."""
    rows = underwater(returns, *keys)
    uw = F.col("uw")
    depth = F.min("uw")
    out = [
        F.count("ret").alias("n_obs"),
        cagr(periods=periods).alias("cagr"),
        annual_volatility(periods=periods).alias("ann_vol"),
        sharpe(rf=rf, periods=periods).alias("sharpe"),
        sortino(rf=rf, periods=periods).alias("sortino"),
        depth.alias("max_drawdown"),
        F.coalesce(F.avg(F.when(uw < 0, uw)), F.lit(0.0)).alias("avg_drawdown"),
        F.sqrt(F.avg(uw * uw)).alias("ulcer_index"),
        (cagr(periods=periods) / _nonzero(F.abs(depth))).alias("calmar"),
        omega().alias("omega"),
        hit_rate().alias("hit_rate"),
        win_loss_ratio().alias("win_loss_ratio"),
        downside_deviation(periods=periods).alias("downside_deviation"),
        skewness().alias("skewness"),
        kurtosis().alias("kurtosis"),
    ]
    if "bench" in returns.columns:
        active = F.col("ret") - F.col("bench")
        out += [tracking_error(active, periods).alias("tracking_error"), information_ratio(active, periods).alias("information_ratio")]
    cut = exact_quantiles(returns, keys, "ret", [1 - confidence, 0.05, 0.95], ["q", "low", "high"], tails=True).filter("n > 1")
    ends = cut.select(*keys, (F.abs("high") / _nonzero(F.abs("low"))).alias("tail_ratio"), (-F.col("q")).alias("var"), (-F.col("q_mean")).alias("cvar"))
    return rows.groupBy(*keys).agg(*out).join(ends, list(keys), "left")


def report_metrics(growths: DataFrame, *keys: str, rf: float = 0.02, periods: int = TRADING_DAYS) -> DataFrame:
    """Family A of (keys, date, ret, growth, bench): 0 where not defined, calendar years, signed VaR and CVaR."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    peak = F.max("growth").over(so_far(*keys))
    rows = growths.select("*", (F.col("growth") / peak - 1).alias("dd"))
    years = F.greatest(F.datediff(F.max("date"), F.min("date")) / 365.25, F.lit(1.0))
    total = F.max_by("growth", "date")
    grown = F.pow(total, 1 / years) - 1
    slope = zero(F.regr_slope("ret", "bench"))
    flat = (zero(F.stddev_samp("ret")) == 0) | (zero(F.stddev_samp("bench")) == 0)
    agg = rows.groupBy(*keys).agg(
        (F.avg("ret") * periods).alias("ann_return"),
        (F.stddev_samp("ret") * periods**0.5).alias("ann_vol"),
        zero(sharpe(rf=rf, periods=periods)).alias("sharpe"),
        zero(sortino(rf=rf, periods=periods)).alias("sortino"),
        F.min("dd").alias("max_drawdown"),
        grown.alias("cagr"),
        zero(grown / _nonzero(F.abs(F.min("dd")))).alias("calmar"),
        F.when(flat, 0.0).otherwise(slope).alias("beta"),
        F.when(flat, 0.0).otherwise(zero(F.regr_intercept("ret", "bench")) * periods).alias("alpha"),
        skewness().alias("skewness"),
        kurtosis().alias("kurtosis"),
    )
    tail = expected_shortfall(growths, *keys).select(*keys, (-F.col("var")).alias("var_95"), (-F.col("cvar")).alias("cvar_95"))
    return agg.join(tail, list(keys), "left")
