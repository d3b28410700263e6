"""Factor regressions and performance attribution."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.solvers import student_p
from meridia.plans.panel import TRADING_DAYS, along


def excess(returns: DataFrame, factors: DataFrame, *, rf: float = 0.02) -> DataFrame:
    """Returns less the factor table's rf (or the rate given), on common dates."""
    rate = F.coalesce(F.col("rf"), F.lit(rf / TRADING_DAYS)) if "rf" in factors.columns else F.lit(rf / TRADING_DAYS)
    return returns.filter("ret IS NOT NULL").join(factors, "date").withColumn("y", F.col("ret") - rate)


def _moments(x: Sequence[str], y: str) -> list[Column]:
    """Count, means and centred second moments of x and y: all that least squares needs, without sums that lose digits."""
    names = [*x, y]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return [F.count(F.lit(1)), *(F.avg(F.col(c).cast("double")) for c in names), *(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in pairs)]


def _unpacked(values: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, means and symmetric scatters (n times covariances) of rows of ``_moments`` of m series."""
    n, mean = values[:, 0], values[:, 1 : m + 1]
    scatter = np.zeros((len(values), m, m))
    i, j = np.triu_indices(m)
    scatter[:, i, j] = scatter[:, j, i] = values[:, m + 1 :] * n[:, None]
    return n, mean, scatter


def _merged(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Moments of two sets of rows together."""
    (n, mean, scatter), (k, other, rest) = one, two
    total, gap = n + k, other - mean
    share = np.divide(k, total, out=np.zeros_like(k), where=total > 0)
    return total, mean + gap * share[:, None], scatter + rest + (n * share)[:, None, None] * gap[:, :, None] * gap[:, None, :]


def _slopes(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have independent factors, and of these the slopes and the inverse of the factors' scatter.

    Factors are scaled to unit scatter first; they count as dependent if that matrix is singular to ten digits.
    """
    k = scatter.shape[1] - 1
    size = np.sqrt(np.maximum(np.diagonal(scatter, axis1=1, axis2=2)[:, :k], 0))
    ok = (size > 0).all(axis=1)
    unit = np.where(size > 0, size, 1.0)
    corr = scatter[:, :k, :k] / (unit[:, :, None] * unit[:, None, :])
    ok &= np.linalg.eigvalsh(corr)[:, 0] > 1e-10 if k and len(corr) else ok
    inverse = np.linalg.inv(corr[ok]) / (unit[ok][:, :, None] * unit[ok][:, None, :]) if ok.any() else np.zeros((0, k, k))
    return ok, (inverse @ scatter[ok][:, :k, k:])[:, :, 0], inverse


def typical_gap(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, days, periods): the most frequent number of days between dates, and periods a year (12 from 28 days on)."""
    gaps = rows.select(*keys, "date").distinct().select(*keys, F.datediff("date", F.lag("date").over(along(*keys))).alias("gap"))
    return gaps.filter("gap IS NOT NULL").groupBy(*keys).agg(F.mode("gap", deterministic=True).alias("days")).select(*keys, "days", F.when(F.col("days") >= 28, 12).otherwise(TRADING_DAYS).alias("periods"))


def regression(rows: DataFrame, *keys: str, x: Sequence[str], y: str = "y", least_rows: int | None = None) -> DataFrame:
    """(keys, n, alpha, one beta a factor, r2, adj_r2, t and two-sided p of alpha and each beta).

    Least squares from centred moments, one aggregation; all keys of a batch are solved as one
    stack of matrices. Rows with a null are left out.
    """
    k = len(x)
    least = least_rows or k + 2
    sums = rows.dropna(subset=[*x, y]).groupBy(*keys).agg(F.array(*_moments(x, y)).alias("_m"))
    names = ["alpha", *(f"beta_{c}" for c in x), "r2", "adj_r2", *(f"{kind}_{c}" for kind in ("t", "p") for c in ("alpha", *x))]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema.fields[: len(keys)]), "n long", *(f"{c} double" for c in names)])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, mean, scatter = _unpacked(np.array(frame["_m"].tolist(), float).reshape(len(frame), -1), k + 1) if len(frame) else (np.zeros(0), np.zeros((0, k + 1)), np.zeros((0, k + 1, k + 1)))
            out = np.full((len(frame), len(names)), np.nan)
            enough = np.flatnonzero(n >= least)
            independent, slopes, inverse = _slopes(scatter[enough])
            ok = enough[independent]
            if len(ok):
                m, mid, total = n[ok], mean[ok], scatter[ok][:, k, k]
                alpha = mid[:, k] - (slopes * mid[:, :k]).sum(axis=1)
                left = np.maximum(total - (slopes * scatter[ok][:, :k, k]).sum(axis=1), 0)
                freedom = m - k - 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    r2 = np.where(total > 0, 1 - left / total, np.nan)
                    of_alpha = 1 / m + np.einsum("ri,rij,rj->r", mid[:, :k], inverse, mid[:, :k])
                    spread = np.sqrt((left / freedom)[:, None] * np.column_stack([of_alpha, np.diagonal(inverse, axis1=1, axis2=2)]))
                    coefficients = np.column_stack([alpha, slopes])
                    t = coefficients / spread
                    p = student_p(np.nan_to_num(t, posinf=1e9, neginf=-1e9), freedom[:, None])
                    out[ok] = np.concatenate([coefficients, r2[:, None], (1 - (1 - r2) * (m - 1) / freedom)[:, None], t, np.where(np.isnan(t), np.nan, p)], axis=1)
            table = frame[list(keys)].copy()
            table["n"] = n.astype(np.int64)
            for i, c in enumerate(names):
                table[c] = pd.Series(out[:, i], index=table.index).astype(object).where(np.isfinite(out[:, i]), None)
            yield table

    return sums.mapInPandas(work, schema)


def rolling_beta(rows: DataFrame, *keys: str, x: str, y: str = "y", window: int = 126) -> DataFrame:
    """One-factor slope over the ``window`` rows before each, its own row left out."""
    over = along(*keys).rowsBetween(-window, -1)
    n = F.count(F.lit(1)).over(over)
    return rows.select(*keys, "date", F.when(n >= window, F.covar_pop(x, y).over(over) / F.nullif(F.var_pop(x).over(over), F.lit(0.0))).alias("beta"))


def rolling_regression(rows: DataFrame, *keys: str, x: Sequence[str], y: str = "y", window: int = 126) -> DataFrame:
    """(keys, date, one beta a factor) over the rows before each date; singular windows are left out.

    Rows of a key are cut into blocks as long as the window, so each window is the end of
    one block and the beginning of the next: moments that grow along a block, from either
    side, are merged in two. That takes the same time a row whatever the window, and
    moments are about means throughout.
    """
    m = len(x) + 1
    numbered = rows.dropna(subset=[*x, y]).select(*keys, "date", *x, y, (F.row_number().over(along(*keys)) - 1).alias("_i"))
    numbered = numbered.withColumn("_block", F.floor(F.col("_i") / window))
    block = Window.partitionBy(*keys, "_block")
    grown = lambda order: F.array(*(f.over(block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) for f in _moments(x, y)))
    sides = numbered.select(*keys, "date", "_i", grown(F.asc("_i")).alias("_head"), grown(F.desc("_i")).alias("_tail"))
    over = along(*keys, order="_i")
    both = sides.select(*keys, "date", "_i", F.lag("_head").over(over).alias("_head"), F.when(F.col("_i") % window != 0, F.lag("_tail", window).over(over)).alias("_tail")).filter(F.col("_i") >= window).drop("_i")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in both.schema.fields[: len(keys) + 1]), *(f"beta_{c} double" for c in x)])
    width = 1 + m + m * (m + 1) // 2

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            head, tail = (_unpacked(np.array([np.zeros(width) if v is None else v for v in frame[c]], float), m) for c in ("_head", "_tail"))
            ok, slopes, _ = _slopes(_merged(head, tail)[2])
            out = frame.loc[ok, [*keys, "date"]].copy()
            for i, c in enumerate(x):
                out[f"beta_{c}"] = slopes[:, i]
            yield out

    return both.mapInPandas(work, schema)


def contributions(rows: DataFrame, betas: DataFrame, *keys: str, x: Sequence[str]) -> DataFrame:
    """Per date: each factor's part, what they and alpha explain, and the rest."""
    both = rows.join(betas, list(keys))
    parts = [(F.col(f"beta_{c}") * F.col(c)).alias(f"part_{c}") for c in x]
    both = both.select(*keys, "date", "y", "alpha", *parts)
    explained = sum((F.col(f"part_{c}") for c in x), F.col("alpha"))
    return both.select("*", explained.alias("explained"), (F.col("y") - explained).alias("unexplained"))


def cumulative_contributions(parts: DataFrame, *keys: str, x: Sequence[str]) -> DataFrame:
    """Compound growth of each factor's part, of alpha and of the rest, by date."""
    over = along(*keys).rowsBetween(Window.unboundedPreceding, 0)
    grown = lambda c: (F.product(1 + F.col(c)).over(over) - 1).alias(c)
    return parts.select(*keys, "date", *map(grown, (*(f"part_{c}" for c in x), "alpha", "unexplained")))


def loading_bands(fit: DataFrame, *keys: str, x: Sequence[str]) -> DataFrame:
    """(keys, factor, beta, p, band) of a regression: how sure each loading is."""
    stacked = ", ".join(f"'{c}', beta_{c}, p_{c}" for c in x)
    rows = fit.selectExpr(*keys, f"stack({len(x)}, {stacked}) AS (factor, beta, p)")
    return rows.select("*", F.when(F.col("p") < 0.01, "p < 0.01").when(F.col("p") < 0.05, "p < 0.05").when(F.col("p") < 0.10, "p < 0.10").otherwise("not significant").alias("band"))


def neutralized(rows: DataFrame, *keys: str, x: Sequence[str]) -> DataFrame:
    """Residual of each row's return; null where a key has too few rows."""
    betas = regression(rows, *keys, x=x)
    return rows.join(betas, list(keys), "left").select(*keys, "date", (F.col("y") - sum((F.col(f"beta_{c}") * F.col(c) for c in x), F.col("alpha"))).alias("residual"))


def style_drift(betas: DataFrame, *keys: str) -> DataFrame:
    """First and last beta of (keys, date, beta), their difference and its share of the first."""
    rows = betas.filter("beta IS NOT NULL").groupBy(*keys).agg(F.min_by("beta", "date").alias("first"), F.max_by("beta", "date").alias("last"))
    drift = F.col("last") - F.col("first")
    return rows.select("*", drift.alias("drift"), F.coalesce(F.try_divide(drift, F.abs("first")), F.lit(0.0)).alias("relative"))


def regimes(factors: DataFrame, *, window: int = 63) -> DataFrame:
    """(factor, compound, regime) of the last rows of (factor, date, ret)."""
    order = Window.partitionBy("factor").orderBy(F.desc("date"))
    last = factors.filter("ret IS NOT NULL").select("*", F.row_number().over(order).alias("row")).filter(F.col("row") <= window)
    return last.groupBy("factor").agg((F.product(1 + F.col("ret")) - 1).alias("compound")).select("*", F.when(F.col("compound") > 0, "up").otherwise("down").alias("regime"))


def brinson(portfolio: DataFrame, benchmark: DataFrame, returns: DataFrame, sectors: DataFrame) -> DataFrame:
    """Allocation, selection and interaction by sector of period-compounded returns, and their total."""
    compound = returns.groupBy("symbol").agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("r"))
    rows = compound.join(sectors, "symbol", "left").join(portfolio.withColumnRenamed("weight", "p"), "symbol", "left").join(benchmark.withColumnRenamed("weight", "b"), "symbol", "left")
    rows = rows.select(F.coalesce("sector", F.lit("Other")).alias("sector"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("b", F.lit(0.0)).alias("b"), "r")
    by = rows.groupBy("sector").agg(F.sum("p").alias("wp"), F.sum("b").alias("wb"), F.sum(F.col("p") * F.col("r")).alias("cp"), F.sum(F.col("b") * F.col("r")).alias("cb"))
    every = Window.partitionBy(F.lit(0))
    by = by.select("*", F.coalesce(F.try_divide("cp", "wp"), F.lit(0.0)).alias("rp"), F.coalesce(F.try_divide("cb", "wb"), F.lit(0.0)).alias("rb"), F.sum("cb").over(every).alias("total_b"))
    parts = by.select(
        "sector", "wp", "wb", "rp", "rb", ((F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("total_b"))).alias("allocation"), (F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"), ((F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))).alias("interaction")
    )
    total = parts.agg(F.lit("Total").alias("sector"), F.sum("wp").alias("wp"), F.sum("wb").alias("wb"), F.sum(F.col("wp") * F.col("rp")).alias("rp"), F.sum(F.col("wb") * F.col("rb")).alias("rb"), F.sum("allocation").alias("allocation"), F.sum("selection").alias("selection"), F.sum("interaction").alias("interaction"))
    return parts.unionByName(total)


def asset_analytics(returns: DataFrame, *, rf: float = 0.02, periods: int = TRADING_DAYS) -> DataFrame:
    """Per symbol of (date, symbol, ret, bench): geometric Sharpe, Sortino on the deviation of losses, beta and alpha."""
    n = F.count("ret")
    total = F.product(1 + F.col("ret"))
    annual = F.pow(total, F.lit(float(periods)) / n) - 1
    vol = F.stddev_samp("ret") * periods**0.5
    down = F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))) * periods**0.5
    beta = F.when(F.count(F.col("ret") + F.col("bench")) >= 10, F.try_divide(F.covar_samp("ret", "bench"), F.var_samp("bench")))
    bench = F.pow(F.product(1 + F.col("bench")), F.lit(float(periods)) / F.count("bench")) - 1
    rows = returns.filter("ret IS NOT NULL").groupBy("symbol").agg((total - 1).alias("total_return"), annual.alias("ann_return"), vol.alias("ann_vol"), F.try_divide(annual - rf, vol).alias("sharpe"), F.try_divide(annual - rf, down).alias("sortino"), beta.alias("beta"), bench.alias("bench_return"))
    return rows.select("*", ((F.col("ann_return") - rf) - F.col("beta") * (F.col("bench_return") - rf)).alias("alpha")).drop("bench_return")
