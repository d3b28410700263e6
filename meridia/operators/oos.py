"""Out-of-sample statistics: probabilistic and deflated Sharpe ratios, backtest overfitting."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.operators.moments import outer_sums
from meridia.plans.panel import TRADING_DAYS

EULER = 0.5772156649015329


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by built-in expressions.

    Below 5 in size, 0.5 plus Simpson's rule over 200 steps of the density from 0 (its
    error is under 1e-9); beyond that the continued fraction of the tail.
    """
    a = F.least(F.abs(z), F.lit(5.0))
    h = a / 200
    phi = lambda x: F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(199)), F.lit(0.0), lambda s, i: s + F.when(i % 2 == 1, 4.0).otherwise(2.0) * phi(i * h))
    body = h / 3 * (phi(F.lit(0.0)) + inner + phi(a))
    far = F.abs(z)
    tail = phi(far) / (far + 1 / (far + 2 / (far + 3 / (far + 4 / far))))
    upper = F.when(far <= 5, 0.5 - body).otherwise(tail)
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def moments(returns: DataFrame, *keys: str) -> DataFrame:
    """n, Sharpe a period, population skewness and kurtosis (not in excess); only where they are defined."""
    rows = returns.filter("ret IS NOT NULL").groupBy(*keys).agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("g3"), (F.kurtosis("ret") + 3).alias("g4"))
    return rows.filter("n >= 3 AND sd > 0").select("*", (F.col("mean") / F.col("sd")).alias("sr"))


def _variance_factor() -> Column:
    return 1 - F.col("g3") * F.col("sr") + (F.col("g4") - 1) / 4 * F.col("sr") * F.col("sr")


def _psr(benchmark: float) -> Column:
    return normal_cdf((F.col("sr") - benchmark) * F.sqrt(F.col("n") - 1.0) / F.sqrt(F.greatest(_variance_factor(), F.lit(1e-12))))


def expected_max_sharpe(n_trials: int, variance: float) -> float:
    if n_trials <= 1:
        return 0.0
    inv = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * inv(1 - 1 / n_trials) + EULER * inv(1 - 1 / (n_trials * math.e)))


def sharpe_probabilities(returns: DataFrame, *keys: str, n_trials: int = 1, threshold: float = 0.0, periods: int = TRADING_DAYS) -> DataFrame:
    """sr, psr against an annual threshold, and dsr: against the best Sharpe that so many trials give by luck."""
    rows = moments(returns, *keys)
    luck = expected_max_sharpe(n_trials, 1.0)
    spread = F.sqrt(F.greatest(_variance_factor(), F.lit(1e-12)) / (F.col("n") - 1.0))
    deflated = normal_cdf((F.col("sr") - luck * spread) / spread)
    return rows.select(*keys, "n", (F.col("sr") * math.sqrt(periods)).alias("sharpe"), _psr(threshold / math.sqrt(periods)).alias("psr"), deflated.alias("dsr"))


def track_record_length(returns: DataFrame, *keys: str, target: float = 0.0, prob: float = 0.95, periods: int = TRADING_DAYS) -> DataFrame:
    """Periods until a Sharpe over the target is significant; null where it isn't over it."""
    goal, z = target / math.sqrt(periods), NormalDist().inv_cdf(prob)
    gap = F.col("sr") - goal
    return moments(returns, *keys).select(*keys, F.when(gap > 0, 1 + _variance_factor() * F.pow(z / F.when(gap > 0, gap), F.lit(2))).alias("min_track_record"))


def min_backtest_length(n_trials: int, target: float = 1.0) -> float:
    """Years below which the best of so many trials reaches the target by luck."""
    if target <= 0:
        return math.nan
    return (expected_max_sharpe(n_trials, 1.0) / target) ** 2


def sharpe_differences(returns: DataFrame, key: str = "strategy") -> DataFrame:
    """(one, two, p_value) of each pair: two-sided, allowing for correlation."""
    rows = returns.filter("ret IS NOT NULL").select("date", F.col(key).alias("symbol"), F.col("ret").alias("x"))
    near = rows.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("symbol")))  # sums about the means keep their digits
    sums = outer_sums(near, powers=((1, 0), (0, 1), (1, 1), (2, 0), (0, 2))).filter("i < j")
    means = rows.groupBy("symbol").agg(F.avg("x").alias("m"))
    sums = sums.join(means.select(F.col("symbol").alias("i"), F.col("m").alias("mi")), "i").join(means.select(F.col("symbol").alias("j"), F.col("m").alias("mj")), "j")
    n, x, y, xy, xx, yy = (F.col(c) for c in ("n", "p0", "p1", "p2", "p3", "p4"))
    sxx, syy, sxy = xx - x * x / n, yy - y * y / n, xy - x * y / n
    sharpe = lambda m, p, s: (m + p / n) / F.sqrt(F.when(s > 0, s) / F.when(n > 1, n - 1))
    both = sums.select(F.col("i").alias("one"), F.col("j").alias("two"), "n", sharpe(F.col("mi"), x, sxx).alias("sa"), sharpe(F.col("mj"), y, syy).alias("sb"), (sxy / F.sqrt(F.when((sxx > 0) & (syy > 0), sxx * syy))).alias("rho"))
    sa, sb, rho = F.col("sa"), F.col("sb"), F.col("rho")
    var = (2 - 2 * rho + 0.5 * (sa * sa + sb * sb - 2 * sa * sb * rho * rho)) / F.col("n")
    z = F.abs(sa - sb) / F.sqrt(F.when(var > 0, var))
    return both.filter("n >= 5").select("one", "two", (2 * (1 - normal_cdf(z))).alias("p_value"))


def unranked(rank: Column, blocks: int) -> Column:
    """The ``rank``-th (from 0) set of half of the blocks, as the bits of a number.

    Sets are numbered by their combinatorial number: the highest block c of a set of k
    stands for C(c, k), the sets of k blocks below c.
    """
    choose = F.array(*(F.lit(math.comb(c, k)) for c in range(blocks) for k in range(blocks // 2 + 1)))
    begin = F.struct(rank.cast("long").alias("rank"), F.lit(blocks // 2).alias("k"), F.lit(0).cast("long").alias("mask"))

    def place(state: Column, c: Column) -> Column:
        below = F.element_at(choose, c * (blocks // 2 + 1) + state["k"] + 1).cast("long")
        taken = (state["k"] > 0) & (state["rank"] >= below)
        return F.struct(
            F.when(taken, state["rank"] - below).otherwise(state["rank"]).alias("rank"),
            F.when(taken, state["k"] - 1).otherwise(state["k"]).alias("k"),
            F.when(taken, state["mask"] + F.pow(F.lit(2.0), c).cast("long")).otherwise(state["mask"]).alias("mask"),
        )

    return F.aggregate(F.sequence(F.lit(blocks - 1), F.lit(0), F.lit(-1)), begin, place)["mask"]


def split_masks(spark: SparkSession, blocks: int, most: int = 20_000, seed: int = 0) -> DataFrame:
    """(split): all halves of the blocks as bit sets, or if they are more than ``most`` so many different ones by the seed."""
    if blocks % 2 or not 2 <= blocks <= 32:
        raise ValueError("blocks has to be even, from 2 to 32, as each config tables 2 to the power of half of them")
    total = math.comb(blocks, blocks // 2)
    if total <= most:
        ranks = spark.range(total).withColumnRenamed("id", "rank")
    else:  # ``most`` numbers at most
        ranks = spark.createDataFrame([(x,) for x in random.Random(seed).sample(range(total), most)], "rank long")
    return ranks.select(unranked(F.col("rank"), blocks).alias("split"))


def _subset_sums(values: Column) -> Column:
    """Sums of all subsets of an array's numbers: place m + 1 holds that of the elements at the bits of m. Each element doubles the table."""
    return F.aggregate(values, F.array(F.lit(0.0)), lambda sums, x: F.concat(sums, F.transform(sums, lambda s: s + x)))


def cscv_splits(rows: DataFrame, *, blocks: int = 16, most: int = 20_000, seed: int = 0) -> DataFrame:
    """(split, config, is_sharpe, oos_sharpe) over halves of the blocks, all of them or a sample of ``most``.

    ``rows``: (t, config, ret), t from 0 without gaps. Rows after the last whole block are
    left out. Each block gives n, sum and sum of squares about the config's mean. Sums of
    all subsets of the lower and of the upper blocks are tabled for each config, 2 to the
    power of half the blocks each, so a split costs two lookups a sum, whatever the number of
    blocks.
    """
    masks = split_masks(rows.sparkSession, blocks, most, seed)
    size = rows.agg(F.floor((F.max("t") + 1) / blocks).alias("size"))
    cut = rows.join(F.broadcast(size), F.lit(True)).filter((F.col("t") < F.col("size") * blocks) & F.col("ret").isNotNull())
    cut = cut.select("config", F.floor(F.col("t") / F.col("size")).cast("int").alias("block"), "ret")
    stats = cut.groupBy("config", "block").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.var_pop("ret").alias("var"))
    stats = stats.groupBy("config").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"), F.map_from_entries(F.collect_list(F.struct("block", F.struct("n", "mean", "var")))).alias("of"))
    lower = blocks // 2

    def table(value: Callable[[Column], Column], low: int, high: int) -> Column:
        return _subset_sums(F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda b: F.coalesce(value(F.try_element_at("of", b)), F.lit(0.0))))

    off = lambda b: b["mean"] - F.col("centre")
    values = {"n": lambda b: b["n"].cast("double"), "s": lambda b: b["n"] * off(b), "q": lambda b: b["n"] * (b["var"] + off(b) * off(b))}
    tables = stats.select("config", "centre", *(table(f, *span).alias(f"{name}{side}") for name, f in values.items() for side, span in enumerate([(0, lower), (lower, blocks)])))
    each = tables.join(F.broadcast(masks), F.lit(True))  # every config meets every split: that is the result
    low, high = (F.col("split") % 2**lower).cast("int") + 1, F.floor(F.col("split") / 2**lower).cast("int") + 1
    inside = {x: F.element_at(f"{x}0", low) + F.element_at(f"{x}1", high) for x in values}
    whole = {x: F.element_at(f"{x}0", 2**lower) + F.element_at(f"{x}1", 2 ** (blocks - lower)) for x in values}
    each = each.select("split", "config", "centre", *(v.alias(k) for k, v in inside.items()), *((whole[k] - v).alias(f"{k}_out") for k, v in inside.items()))

    def ratio(end: str) -> Column:
        n, s, q = (F.col(f"{x}{end}") for x in "nsq")
        var = (q - s * s / n) / F.when(n > 1, n - 1)
        return F.when(var > 1e-18, (F.col("centre") + s / n) / F.sqrt(F.when(var > 0, var)) * math.sqrt(TRADING_DAYS)).otherwise(0.0)

    return each.select("split", "config", ratio("").alias("is_sharpe"), ratio("_out").alias("oos_sharpe"))


def overfitting_probability(splits: DataFrame) -> DataFrame:
    """pbo: share of splits in which the best config inside ranks in the lower half outside; slope; share of losses."""
    of = Window.partitionBy("split")
    best = F.row_number().over(of.orderBy(F.desc("is_sharpe"), "config"))
    rank = F.rank().over(of.orderBy("oos_sharpe"))
    ties = F.count(F.lit(1)).over(Window.partitionBy("split", "oos_sharpe"))
    rows = splits.select("*", best.alias("best"), ((rank + (ties - 1) / 2) / (F.count(F.lit(1)).over(of) + 1)).alias("omega")).filter("best = 1")
    logit = F.ln(F.col("omega") / (1 - F.col("omega")))
    return rows.agg(F.avg((logit <= 0).cast("double")).alias("pbo"), F.regr_slope("oos_sharpe", "is_sharpe").alias("slope"), F.avg((F.col("oos_sharpe") < 0).cast("double")).alias("oos_loss"), F.count(F.lit(1)).alias("splits"))


def verdict(pbo: Column, dsr: Column) -> Column:
    return (
        F.when(pbo > 0.5, "likely_overfit")
        .when((pbo <= 0.1) & (F.coalesce(dsr, F.lit(1.0)) >= 0.95), "robust")
        .when(pbo.isNotNull(), "caution")
        .when(dsr.isNull(), "inconclusive")
        .when(dsr >= 0.95, "robust")
        .otherwise("caution")
    )


def overfitting_score(inside: Column, outside: Column) -> Column:
    """The share of an in-sample number that is lost outside; 0 where there is nothing to lose."""
    return F.when(inside > 0, F.greatest(F.lit(0.0), (inside - outside) / F.when(inside > 0, inside))).otherwise(0.0)
