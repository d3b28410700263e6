"""Optimised portfolios: moments are aggregated by Spark, each problem is solved where its small matrix is."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from meridia.functions import solvers
from meridia.operators.moments import complete, covariance, equilibrium_returns, forecast_vol, mean_returns, outer_sums, shrunk_covariance
from meridia.plans.panel import TRADING_DAYS

Solver = Callable[[np.ndarray, np.ndarray, "solvers.Limits | None"], np.ndarray]


def _nearest(w: np.ndarray, limits: solvers.Limits | None) -> np.ndarray:
    """``w`` itself, or what within the limits is nearest to it."""
    return w if limits is None else solvers.solve_qp(np.eye(len(w)), -w * limits.budget, limits)


METHODS: dict[str, Solver] = {
    "equal_weight": lambda mu, cov, limits: _nearest(np.full(len(mu), 1 / len(mu)), limits),
    "min_variance": lambda mu, cov, limits: solvers.min_variance(cov, limits),
    "max_sharpe": lambda mu, cov, limits: solvers.max_sharpe(mu, cov, limits=limits),
    "risk_parity": lambda mu, cov, limits: _nearest(solvers.risk_budget(cov), limits),
    "max_diversification": lambda mu, cov, limits: solvers.max_diversification(cov, limits),
    "min_correlation": lambda mu, cov, limits: solvers.min_correlation(cov, limits),
    "hrp": lambda mu, cov, limits: _nearest(solvers.hierarchical_risk_parity(cov), limits),
}

#: What the method ``optimize`` minimises: weights, means and covariance to a number.
Objective = Callable[[np.ndarray, np.ndarray, np.ndarray], float]


def neg_sharpe(w: np.ndarray, mu: np.ndarray, cov: np.ndarray, rf: float = 0.02) -> float:
    return -solvers.portfolio_stats(w, mu, cov, rf)[2]


def variance(w: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> float:
    return float(w @ cov @ w)


def weights_by(method: str, mu: np.ndarray, cov: np.ndarray, limits: solvers.Limits | None, objective: Objective | None = None) -> np.ndarray:
    """Weights of a named method, or of the method ``optimize`` those that minimise the objective."""
    if method == "optimize":
        goal = objective or neg_sharpe
        return solvers.minimize(lambda w: goal(w, mu, cov), limits or solvers.Limits(len(mu)))
    return METHODS[method](mu, cov, limits)


#: Limits of a problem from its symbols.
Limiter = Callable[[list[str]], "solvers.Limits"]


def square(frame: pd.DataFrame, values: str) -> tuple[list[str], np.ndarray]:
    """Symbols of (i, j, values) in order, and the matrix."""
    symbols = sorted(set(frame["i"]))
    i, j = (pd.Index(symbols).get_indexer(frame[c]) for c in ("i", "j"))
    out = np.zeros((len(symbols), len(symbols)))
    out[i, j] = frame[values]
    return symbols, out


def moments_of(frame: pd.DataFrame, periods: int = TRADING_DAYS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Symbols, mean and covariance from sums (i, j, n, p0, p1, p2) of x, y and xy, annualised."""
    frame = frame.assign(cov=(frame["p2"] - frame["p0"] * frame["p1"] / frame["n"]) / (frame["n"] - 1) * periods)
    symbols, cov = square(frame, "cov")
    own = frame[frame["i"] == frame["j"]].set_index("i")
    return symbols, (own["p0"] / own["n"] * periods).reindex(symbols).to_numpy(), (cov + cov.T) / 2


def shrinkage_of(frame: pd.DataFrame) -> tuple[list[str], np.ndarray, float]:
    """Symbols, covariance a period and intensity from sums (i, j, n, p0, ...) of ``SHRINKAGE_POWERS``."""
    n = float(frame["n"].max())
    raw = {}
    for k, powers in enumerate(solvers.SHRINKAGE_POWERS):
        symbols, matrix = square(frame, f"p{k}")
        raw[powers] = matrix / n
    return symbols, *solvers.constant_correlation_shrinkage(raw, n)


def _near_zero(rows: DataFrame) -> DataFrame:
    """``x`` about its mean over all dates: moments about the means of parts then keep their digits."""
    return rows.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("symbol")))


def pair_sums(returns: DataFrame, *keys: str, value: str = "log_ret", estimator: str = "sample") -> DataFrame:
    """(keys, i, j, n, p0, p1, ...): sums of powers, a row a pair of symbols, whatever the number of dates.

    Those of ``ledoit_wolf`` are about the means of all rows (``m0`` of i), over dates of a
    key on which all of its symbols have a value.
    """
    if estimator == "ledoit_wolf":
        rows = complete(returns, value, *keys)
        sums = outer_sums(_near_zero(rows), keys, solvers.SHRINKAGE_POWERS)
        return sums.join(rows.groupBy(F.col("symbol").alias("i")).agg(F.avg("x").alias("m0")), "i")
    if keys:
        rows = returns.select(*keys, "date", "symbol", F.col(value).alias("x")).filter("x IS NOT NULL")
    else:
        rows = complete(returns, value)
    return outer_sums(rows, keys)


def estimate(frame: pd.DataFrame, estimator: str, components: int, periods: int = TRADING_DAYS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Symbols, mean and covariance, annualised, from the ``pair_sums`` of an estimator."""
    frame = frame[frame["n"] > 2]
    if estimator == "ledoit_wolf":
        symbols, cov, _ = shrinkage_of(frame)
        own = frame[frame["i"] == frame["j"]].set_index("i").reindex(symbols)
        return symbols, ((own["p0"] / own["n"] + own["m0"]) * periods).to_numpy(), cov * periods
    symbols, mu, cov = moments_of(frame, periods)
    return symbols, mu, solvers.denoised(cov, components) if estimator == "denoise" else cov


def optimized(
    returns: DataFrame, key: str, methods: list[str] | None = None, *, value: str = "log_ret", limiter: Limiter | None = None, estimator: str = "sample", components: int = 3, objective: Objective | None = None
) -> DataFrame:
    """(key, strategy, symbol, weight) for each value of ``key``: one grouped solve each, windows in parallel.

    ``limiter`` gives the limits that hold for all methods; where a problem has no
    solution within them there are no rows. The covariance is that of ``estimator``.
    """
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator!r}")
    names = methods or list(METHODS)
    kind = returns.schema[key].dataType.simpleString()

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            symbols, mu, cov = estimate(frame, estimator, components)
        except ValueError:
            symbols, mu, cov = [], np.zeros(0), np.zeros((0, 0))
        rows = []
        for name in names if symbols else ():
            try:
                rows += [(frame[key].iloc[0], name, s, float(w)) for s, w in zip(symbols, weights_by(name, mu, cov, limiter(symbols) if limiter else None, objective), strict=True)]
            except (ValueError, np.linalg.LinAlgError):
                continue  # a window that can't be solved has no row
        return pd.DataFrame(rows, columns=[key, "strategy", "symbol", "weight"])

    return pair_sums(returns, key, value=value, estimator=estimator).groupBy(key).applyInPandas(solve, f"{key} {kind}, strategy string, symbol string, weight double")


def _whole(frame: DataFrame) -> GroupedData:
    """All rows as one group: a row a pair of symbols."""
    return frame.withColumn("_all", F.lit(1)).groupBy("_all")


ESTIMATORS = ("sample", "ledoit_wolf", "denoise")


def _partner(frame: pd.DataFrame) -> np.ndarray:
    """The sum of x_j in each row of sums of x_i (p0)."""
    symbols, first = square(frame, "p0")
    at = pd.Index(symbols)
    return first.T[at.get_indexer(frame["i"]), at.get_indexer(frame["j"])]


def estimated(
    returns: DataFrame, method: str, *, estimator: str = "sample", components: int = 3, limiter: Limiter | None = None, objective: Objective | None = None, rf: float = 0.02
) -> DataFrame:
    """(symbol, weight, expected_return, expected_vol, sharpe, shrinkage) of one method, on an estimate of the covariance of log returns.

    The last four are the portfolio's, the same in every row; shrinkage is null but for
    ``ledoit_wolf``. ``objective`` is what the method ``optimize`` minimises.
    """
    if method not in (*METHODS, "optimize") or estimator not in ESTIMATORS:
        raise ValueError(f"unknown method {method!r} or estimator {estimator!r}")
    if estimator == "ledoit_wolf":
        cov = shrunk_covariance(returns, value="log_ret").select("i", "j", "cov", "delta")
    else:
        cov = covariance(returns).select("i", "j", "cov", F.lit(None).cast("double").alias("delta"))
    both = cov.join(mean_returns(returns).withColumnRenamed("symbol", "i"), "i")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        symbols, matrix = square(frame, "cov")
        matrix = solvers.denoised(matrix, components) if estimator == "denoise" else matrix
        matrix = (matrix + matrix.T) / 2
        mu = frame.groupby("i")["mu"].first().reindex(symbols).to_numpy()
        w = weights_by(method, mu, matrix, limiter(symbols) if limiter else None, objective)
        ret, vol, sharpe = solvers.portfolio_stats(w, mu, matrix, rf)
        return pd.DataFrame({"symbol": symbols, "weight": w, "expected_return": ret, "expected_vol": vol, "sharpe": sharpe, "shrinkage": frame["delta"].iloc[0]})

    return _whole(both).applyInPandas(solve, "symbol string, weight double, expected_return double, expected_vol double, sharpe double, shrinkage double")


#: How likely a Poisson number of mean 1 is at most 0, 1, ...
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563]


def _resampled(rows: DataFrame, samples: int, seed: int) -> DataFrame:
    """Sums of ``SHRINKAGE_POWERS`` in every sample.

    How often a date is drawn in a sample is a Poisson number of mean 1 by an MD5 of seed,
    sample and date, so samples need no shared random state and no copy of the panel: a
    date carries an array of these numbers.
    """

    def drawn(sample: Column) -> Column:
        digits = F.md5(F.concat_ws(":", F.lit(str(seed)), sample.cast("string"), F.col("date").cast("string")).cast("binary"))
        u = F.conv(F.substring(digits, 1, 13), 16, 10).cast("long") / 2.0**52
        return sum(((u > p).cast("int") for p in POISSON), F.lit(0))

    times = F.transform(F.sequence(F.lit(1), F.lit(samples)), drawn)
    return outer_sums(_near_zero(rows).withColumn("times", times), powers=solvers.SHRINKAGE_POWERS, times="times")


def bootstrap_shrinkage(returns: DataFrame, *, samples: int = 100, seed: int = 42, value: str = "ret") -> DataFrame:
    """(sample, n, delta): dates of each resampling and its own shrinkage intensity, null where a series doesn't vary."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            delta = shrinkage_of(frame)[2]
        except ValueError:
            delta = None
        return pd.DataFrame({"sample": [frame["sample"].iloc[0]], "n": [float(frame["n"].max())], "delta": pd.array([delta], "Float64")})

    return _resampled(complete(returns, value), samples, seed).groupBy("sample").applyInPandas(solve, "sample int, n double, delta double")


def bootstrapped(
    returns: DataFrame, *, samples: int = 100, seed: int = 42, value: str = "ret", limiter: Limiter | None = None, estimator: str = "ledoit_wolf", initial: DataFrame | None = None
) -> DataFrame:
    """(symbol, weight): mean of min-variance weights over resampled dates, within limits if any.

    Each sample's covariance is shrunk with its own intensity (``ledoit_wolf``; where a
    series doesn't vary in a sample, that sample's is not shrunk) or taken as it is
    (``sample``); fourth-order sums of all samples come from one pass. With fewer dates
    than symbols and one, nothing is estimated: the ``initial`` weights (symbol, weight),
    or equal ones, are returned with a sum of 1.
    """
    if estimator not in ("sample", "ledoit_wolf"):
        raise ValueError(f"unknown estimator {estimator!r}")
    rows = complete(returns, value)
    dates, symbols = rows.agg(F.countDistinct("date"), F.countDistinct("symbol")).first()
    if dates < symbols + 1:
        known = returns.select("symbol").distinct()
        given = known.withColumn("weight", F.lit(1.0)) if initial is None else initial.select("symbol", "weight").join(known, "symbol", "left_semi")
        return given.select("symbol", (F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0)))).alias("weight"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        names, _, cov = moments_of(frame.rename(columns={"p1": "p2", "p2": "p1"}).assign(p1=_partner(frame)))
        if estimator == "ledoit_wolf":
            try:
                cov = shrinkage_of(frame)[1] * TRADING_DAYS
            except ValueError:
                pass  # the plain covariance of this sample
        return pd.DataFrame({"symbol": names, "weight": solvers.min_variance(cov, limiter(names) if limiter else None)})

    each = _resampled(rows, samples, seed).groupBy("sample").applyInPandas(solve, "symbol string, weight double")
    mean = each.groupBy("symbol").agg(F.avg("weight").alias("weight"))
    return mean if limiter else mean.select("symbol", (F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0)))).alias("weight"))


def budgeted(returns: DataFrame, budget: Mapping[str, float], *, value: str = "log_ret") -> DataFrame:
    """(symbol, weight, share) whose shares of the risk are the budget's; symbols that it leaves out have none."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        symbols, _, cov = moments_of(frame)
        w = solvers.risk_budget(cov, [budget.get(s, 0.0) for s in symbols])
        return pd.DataFrame({"symbol": symbols, "weight": w, "share": solvers.risk_shares(w, cov)})

    return _whole(pair_sums(returns.filter(F.col("symbol").isin(list(budget))), value=value)).applyInPandas(solve, "symbol string, weight double, share double")


#: The symbol of a benchmark among holdings, before all others.
BENCHMARK = "\x00benchmark"


def tracking(returns: DataFrame, benchmark: DataFrame, *, value: str = "ret", limiter: Limiter | None = None, periods: int = TRADING_DAYS) -> DataFrame:
    """(symbol, weight, tracking_error): the weights within limits whose returns stray least from a benchmark's (date, bench).

    The benchmark is one more row and column of the pair sums, so the variance of the
    difference is a quadratic program on sums; dates without a value of it or of any
    symbol are left out.
    """
    own = returns.select("date", "symbol", F.col(value).alias("x"))
    both = own.unionByName(benchmark.select("date", F.lit(BENCHMARK).alias("symbol"), F.col("bench").alias("x"))).filter("x IS NOT NULL")
    every = F.broadcast(both.agg(F.countDistinct("symbol").alias("_every")))  # a row
    both = both.withColumn("_there", F.count(F.lit(1)).over(Window.partitionBy("date"))).join(every, F.lit(True)).filter("_there = _every").select("date", "symbol", "x")
    sums = outer_sums(_near_zero(both))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        names, _, cov = moments_of(frame, periods)
        symbols, cov_held, cov_bench = names[1:], cov[1:, 1:], cov[1:, 0]
        w = solvers.solve_qp(cov_held, -cov_bench, limiter(symbols) if limiter else solvers.Limits(len(symbols)))
        stray = w @ cov_held @ w - 2 * w @ cov_bench + cov[0, 0]
        return pd.DataFrame({"symbol": symbols, "weight": w, "tracking_error": float(np.sqrt(max(stray, 0.0)))})

    return _whole(sums).applyInPandas(solve, "symbol string, weight double, tracking_error double")


def frontier(returns: DataFrame, *, points: int = 50, value: str = "log_ret") -> DataFrame:
    """(target, vol, symbol, weight) of least variance along the efficient frontier."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        symbols, mu, cov = moments_of(frame)
        rows = [(t, vol, s, float(x)) for t, vol, w in solvers.efficient_frontier(mu, cov, points) for s, x in zip(symbols, w, strict=True)]
        return pd.DataFrame(rows, columns=["target", "vol", "symbol", "weight"])

    return _whole(pair_sums(returns, value=value)).applyInPandas(solve, "target double, vol double, symbol string, weight double")


def corners(returns: DataFrame, *, value: str = "log_ret") -> DataFrame:
    """(corner, mean, vol, symbol, weight): the portfolios between which the frontier's weights are straight lines, the highest mean first."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        symbols, mu, cov = moments_of(frame)
        found = solvers.critical_line(mu, solvers.regularized(solvers.check_covariance(cov)))
        rows = [(k, c.mean, float(np.sqrt(c.weights @ cov @ c.weights)), s, float(x)) for k, c in enumerate(found) for s, x in zip(symbols, c.weights, strict=True)]
        return pd.DataFrame(rows, columns=["corner", "mean", "vol", "symbol", "weight"])

    return _whole(pair_sums(returns, value=value)).applyInPandas(solve, "corner int, mean double, vol double, symbol string, weight double")


def cloud(returns: DataFrame, *, portfolios: int = 2500, seed: int = 42, rf: float = 0.02) -> DataFrame:
    """(id, ret, vol, sharpe) of random long-only portfolios; the draws are hashes of seed, portfolio and symbol."""
    mu = mean_returns(returns)
    draws = mu.join(returns.sparkSession.range(portfolios), F.lit(True)).select("id", "symbol", "mu", (-F.ln((F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "symbol"), 11) + 0.5) / 2.0**53)).alias("e"))
    weights = draws.select(F.col("id").alias("strategy"), "symbol", "mu", (F.col("e") / F.sum("e").over(Window.partitionBy("id"))).alias("weight"))
    vol = forecast_vol(weights.select("strategy", "symbol", "weight"), covariance(returns))
    ret = weights.groupBy("strategy").agg(F.sum(F.col("weight") * F.col("mu")).alias("ret"))
    return ret.join(vol, "strategy").select(F.col("strategy").alias("id"), "ret", "vol", ((F.col("ret") - rf) / F.col("vol")).alias("sharpe"))


def posterior(cov: DataFrame, weights: DataFrame, views: Sequence[tuple[Mapping[str, float], float, float]], *, tau: float = 0.05, risk_aversion: float = 2.5) -> DataFrame:
    """(symbol, prior, posterior, weight) of Black and Litterman.

    ``views``: (portfolio of symbols, its return, confidence); {"a": 1} is an absolute
    view, {"a": 1, "b": -1} a relative one. The weight is that of unbounded optimisation
    at the posterior, scaled to 1.
    """
    prior = equilibrium_returns(weights, cov, risk_aversion=risk_aversion)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        symbols, matrix = square(frame, "cov")
        pi = frame.groupby("i")["pi"].first().reindex(symbols).to_numpy()
        picks = np.array([[v.get(s, 0.0) for s in symbols] for v, _, _ in views]).reshape(len(views), len(symbols))
        mean, spread = solvers.black_litterman(pi, matrix, picks, np.array([q for _, q, _ in views]), np.array([c for _, _, c in views]), tau)
        w = np.linalg.solve(risk_aversion * spread, mean)
        return pd.DataFrame({"symbol": symbols, "prior": pi, "posterior": mean, "weight": w / w.sum()})

    both = cov.select("i", "j", "cov").join(prior.withColumnRenamed("symbol", "i"), "i")
    return _whole(both).applyInPandas(solve, "symbol string, prior double, posterior double, weight double")
