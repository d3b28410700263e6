"""What charts draw: small frames, one a chart, for any renderer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.quantiles import exact_quantiles
from meridia.plans.panel import along

#: Weights below this are not drawn.
LEAST = 0.001


def composition(portfolios: DataFrame, least: float = LEAST) -> DataFrame:
    """(strategy, symbol, weight) of what is held."""
    return portfolios.filter(F.col("weight") > least).select("strategy", "symbol", "weight")


def sector_allocation(portfolios: DataFrame, sectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(strategy, sector, weight); symbols without a sector are Other."""
    rows = composition(portfolios, least).join(sectors, "symbol", "left")
    return rows.groupBy("strategy", F.coalesce("sector", F.lit("Other")).alias("sector")).agg(F.sum("weight").alias("weight"))


def sector_risk(shares: DataFrame, sectors: DataFrame) -> DataFrame:
    """(strategy, sector, share) of risk shares (strategy, symbol, share)."""
    rows = shares.join(sectors, "symbol", "left")
    return rows.groupBy("strategy", F.coalesce("sector", F.lit("Other")).alias("sector")).agg(F.sum("share").alias("share"))


def weight_history(weights: DataFrame) -> DataFrame:
    """(strategy, date, symbol, weight, place): ``place`` orders symbols by mean weight, the heaviest first."""
    mean = weights.groupBy("strategy", "symbol").agg(F.avg("weight").alias("mean"))
    order = Window.partitionBy("strategy").orderBy(F.desc("mean"), "symbol")  # a row a symbol
    return weights.join(mean.select("strategy", "symbol", F.row_number().over(order).alias("place")), ["strategy", "symbol"])


def posterior_shift(posterior: DataFrame) -> DataFrame:
    """(symbol, prior, posterior, shift, place): the largest shift either way first."""
    rows = posterior.select("symbol", "prior", "posterior", (F.col("posterior") - F.col("prior")).alias("shift"))
    return rows.select("*", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("shift")), "symbol")).alias("place"))


def posterior_weights(posterior: DataFrame, market: DataFrame, least: float = 0.005) -> DataFrame:
    """(symbol, market, weight) where either is above ``least``, by the market's weight."""
    rows = posterior.select("symbol", "weight").join(market.withColumnRenamed("weight", "market"), "symbol", "full_outer").na.fill(0.0, ["weight", "market"])
    return rows.filter((F.col("weight") > least) | (F.col("market") > least)).select("symbol", "market", "weight").orderBy(F.desc("market"), "symbol")


def distribution(returns: DataFrame, *keys: str, bins: int = 50, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(keys, bin, start, n) of returns between two quantiles, in bins of equal width."""
    rows = returns.filter("ret IS NOT NULL").select(*keys, "ret")
    cut = exact_quantiles(rows, keys, "ret", [low, high], ["low", "high"]).drop("n")
    inside = (rows.join(cut, list(keys)) if keys else rows.join(F.broadcast(cut), F.lit(True))).filter("ret BETWEEN low AND high")
    width = (F.col("high") - F.col("low")) / bins
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("ret") - F.col("low"), width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return inside.groupBy(*keys, at.alias("bin")).agg(F.min(F.col("low") + at * width).alias("start"), F.count(F.lit(1)).alias("n"))


def survival(ends: DataFrame, points: int = 100) -> DataFrame:
    """(threshold, prob): the share of returns (ret) above each of equally spaced thresholds from the least to the most."""
    span = ends.agg(F.min("ret").alias("low"), F.max("ret").alias("high"), F.count("ret").alias("total"))
    step = (F.col("high") - F.col("low")) / (points - 1)
    # a return is above all thresholds up to its own place, so counts by place say it all
    at = F.when(step > 0, F.ceil((F.col("ret") - F.col("low")) / step)).otherwise(0).cast("int")
    counts = ends.join(F.broadcast(span), F.lit(True)).groupBy(F.least(at, F.lit(points)).alias("k")).agg(F.count("ret").alias("n"))
    grid = span.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"), "low", "total", step.alias("step"))
    over = Window.partitionBy(F.lit(0)).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)  # ``points`` rows
    rows = grid.join(counts, "k", "full_outer").select("k", "low", "step", "total", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("above"))
    return rows.filter("total IS NOT NULL").select((F.col("low") + F.col("k") * F.col("step")).alias("threshold"), (F.col("above") / F.col("total")).alias("prob"))


def growth(returns: DataFrame, *keys: str) -> DataFrame:
    """(keys, date, growth): compound growth of returns."""
    over = along(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return returns.filter("ret IS NOT NULL").select(*keys, "date", F.product(1 + F.col("ret")).over(over).alias("growth"))
