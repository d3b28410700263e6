"""Growth, drawdowns, rolling statistics and calendar resampling of long series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.plans.panel import TRADING_DAYS, along, full, so_far, trailing, with_returns


def growth_of_one(panel: DataFrame, *keys: str) -> DataFrame:
    """Price over the first price of its key."""
    return panel.select("*", (F.col("price") / F.first("price").over(so_far(*keys))).alias("growth"))


def buy_and_hold(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """(date, value): sum of weight times growth; a symbol without a weight has 0."""
    rows = growth_of_one(panel, "symbol").join(weights, "symbol")
    return rows.groupBy("date").agg(F.sum(F.col("weight") * F.col("growth")).alias("value"))


def drawdown_curve(values: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """``dd``: value over its highest so far, minus 1; no start row is made up."""
    return values.select("*", (F.col(value) / F.max(value).over(so_far(*keys)) - 1).alias("dd"))


def drawdown_episodes(curve: DataFrame, *keys: str) -> DataFrame:
    """One row an episode of (keys, date, dd): peak, trough, recovery (null while it lasts), depth, length in rows.

    A fall starts an island of negative rows; its peak is the row before, its recovery the row after.
    """
    order = along(*keys)
    rows = curve.select(*keys, "date", "dd", F.row_number().over(order).alias("row"), F.lag("date").over(order).alias("last"), F.lag("dd").over(order).alias("last_dd"), F.lead("date").over(order).alias("next"))
    starts = ((F.col("dd") < 0) & (F.coalesce("last_dd", F.lit(0.0)) >= 0)).cast("int")
    rows = rows.select("*", F.sum(starts).over(so_far(*keys)).alias("episode")).filter("dd < 0")
    return rows.groupBy(*keys, "episode").agg(
        F.min_by("last", "date").alias("peak_date"),
        F.min_by("date", F.struct("dd", "date")).alias("trough_date"),
        F.max_by("next", "date").alias("recovery_date"),
        F.min("dd").alias("depth"),
        F.count(F.lit(1)).alias("length"),
    )


def drawdown_stats(curve: DataFrame, *keys: str) -> DataFrame:
    """Deepest fall, ulcer index in percentage points, and mean absolute fall."""
    return curve.groupBy(*keys).agg(F.min("dd").alias("max_dd"), F.sqrt(F.avg(F.pow(100 * F.col("dd"), F.lit(2)))).alias("ulcer_pct"), F.avg(F.abs("dd")).alias("pain"))


def top_episodes(episodes: DataFrame, *keys: str, n: int = 5) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("depth", "episode")
    return episodes.select("*", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= n)


def rolling(returns: DataFrame, *keys: str, window: int, rf: float = 0.0, periods: int = TRADING_DAYS) -> DataFrame:
    """``roll_vol`` and ``roll_sharpe`` over full windows."""
    over = trailing(window, *keys)
    sd = full(F.stddev_samp("ret").over(over), F.col("ret"), window, over)
    mean = F.avg(F.col("ret") - rf / periods).over(over)
    return returns.select("*", (sd * periods**0.5).alias("roll_vol"), F.try_divide(mean * periods, F.when(sd != 0, sd * periods**0.5)).alias("roll_sharpe"))


def last_of_period(values: DataFrame, *keys: str, period: str, value: str = "value") -> DataFrame:
    """Last value of each calendar period and its change on the last one's, the first being null."""
    ends = values.groupBy(*keys, F.to_date(F.date_trunc(period, "date")).alias("date")).agg(F.max_by(value, "date").alias("price"))
    return with_returns(ends, *keys).drop("log_ret")


def compound_by(returns: DataFrame, *keys: Column | str) -> DataFrame:
    return returns.filter("ret IS NOT NULL").groupBy(*keys).agg((F.product(1 + F.col("ret")) - 1).alias("compound"))


def month_table(returns: DataFrame, *keys: str) -> DataFrame:
    """Compound return by year, one column a month."""
    rows = returns.filter("ret IS NOT NULL").select(*keys, F.year("date").alias("year"), F.month("date").alias("month"), "ret")
    out = rows.groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.product(1 + F.col("ret")) - 1)
    return out.withColumnsRenamed({str(i): f"m{i:02d}" for i in range(1, 13)})


def capture_ratios(returns: DataFrame, *keys: str) -> DataFrame:
    """Of (keys, date, ret, bench): compound return on up and down days over the benchmark's; 0 if its sign is wrong."""
    rows = returns.filter("ret IS NOT NULL AND bench IS NOT NULL")
    comp = lambda c, up: F.coalesce(F.product(F.when((F.col("bench") > 0) if up else (F.col("bench") <= 0), 1 + F.col(c))) - 1, F.lit(0.0))
    up, down = comp("bench", True), comp("bench", False)
    return rows.groupBy(*keys).agg(F.when(up > 0, comp("ret", True) / up).otherwise(0.0).alias("up_capture"), F.when(down < 0, comp("ret", False) / down).otherwise(0.0).alias("down_capture"))


def trailing_annual_return(panel: DataFrame, *keys: str, years: int, periods: int = TRADING_DAYS) -> DataFrame:
    """Annualised change over the last ``years``; null where there are fewer rows."""
    then = F.lag("price", periods * years).over(along(*keys))
    rows = panel.select(*keys, "date", (F.pow(F.try_divide(F.col("price"), then), F.lit(1.0 / years)) - 1).alias("annual"))
    return rows.groupBy(*keys).agg(F.max_by("annual", "date").alias("annual"))
