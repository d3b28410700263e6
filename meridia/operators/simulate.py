"""Simulated paths and what is asked of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.functions.quantiles import exact_quantiles
from meridia.plans.panel import TRADING_DAYS


def paths(spark: SparkSession, mu: float, vol: float, *, sims: int = 1000, days: int = 252, initial: float = 10_000.0, shock: float = 0.0, seed: int = 42) -> DataFrame:
    """(sim_id, day, value) of geometric Brownian motion; ``shock`` falls on the first day.

    A step's draw depends on the seed, path and day alone (Box and Muller on two MD5 hashes),
    so the result is the same for any number of partitions, after a lost task and in other engines.
    """
    sd, drift = vol / math.sqrt(TRADING_DAYS), mu / TRADING_DAYS
    digits = lambda k: F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), F.col("sim_id").cast("string"), F.col("day").cast("string")).cast("binary"))
    unit = lambda k: (F.conv(F.substring(digits(k), 1, 13), 16, 10).cast("long") + 0.5) / 2.0**52
    z = F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * math.pi * unit(2))
    steps = spark.range(sims).select(F.col("id").alias("sim_id"), F.explode(F.sequence(F.lit(0), F.lit(days))).alias("day"))
    step = F.when(F.col("day") == 0, 0.0).otherwise(drift - sd * sd / 2 + sd * z + F.when(F.col("day") == 1, math.log1p(shock)).otherwise(0.0))
    return steps.select("sim_id", "day", (initial * F.exp(F.sum(step).over(Window.partitionBy("sim_id").orderBy("day")))).alias("value"))


def terminal_returns(values: DataFrame) -> DataFrame:
    return values.groupBy("sim_id").agg((F.max_by("value", "day") / F.min_by("value", "day") - 1).alias("ret"))


def simulation_metrics(ends: DataFrame, *, confidence: float = 0.95) -> DataFrame:
    """Mean, median, signed VaR and CVaR, and the 5th and 95th percentiles of (ret)."""
    q = exact_quantiles(ends, [], "ret", [1 - confidence, 0.05, 0.5, 0.95, 1.0], ["var", "p5", "median", "p95", "all"], tails=True)
    return q.select(F.col("all_mean").alias("mean"), "median", "var", F.col("var_mean").alias("cvar"), "p5", "p95")


def success_probabilities(ends: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.50)) -> DataFrame:
    """(threshold, prob) that a return is over it: one pass, whatever the number of thresholds."""
    aggs = [F.avg((F.col("ret") > t).cast("double")).alias(f"p{i}") for i, t in enumerate(thresholds)]
    stacked = ", ".join(f"CAST({t} AS DOUBLE), p{i}" for i, t in enumerate(thresholds))
    return ends.agg(*aggs).selectExpr(f"stack({len(thresholds)}, {stacked}) AS (threshold, prob)")


def time_to_target(values: DataFrame, *, target: float, initial: float = 10_000.0) -> DataFrame:
    """Median first day at the target among paths that reach it, and their share."""
    first = values.groupBy("sim_id").agg(F.min(F.when(F.col("value") >= initial * (1 + target), F.col("day"))).alias("day"))
    median = exact_quantiles(first, [], "day", [0.5], ["median_day"]).select("median_day")
    return first.agg(F.avg(F.col("day").isNotNull().cast("double")).alias("share")).join(F.broadcast(median), F.lit(True)).select("median_day", "share")


def bands(values: DataFrame) -> DataFrame:
    """Percentiles of the paths by day."""
    qs = (0.05, 0.25, 0.50, 0.75, 0.95)
    return exact_quantiles(values, ["day"], "value", qs, [f"p{int(q * 100):02d}" for q in qs]).drop("n")


def histogram(ends: DataFrame, bins: int = 50) -> DataFrame:
    edges = ends.agg(F.min("ret").alias("low"), F.max("ret").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("ret") - F.col("low"), width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return ends.join(F.broadcast(edges), F.lit(True)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
