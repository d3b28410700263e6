"""Pair moments of return panels: covariance, correlation, shrinkage, risk shares."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from meridia.functions.metrics import expected_shortfall
from meridia.plans.panel import TRADING_DAYS


def complete(returns: DataFrame, value: str = "log_ret", *keys: str) -> DataFrame:
    """(keys, date, symbol, x) of the dates (of a key) on which every symbol has a value."""
    rows = returns.select(*keys, "date", "symbol", F.col(value).alias("x"))
    missing = F.sum(F.col("x").isNull().cast("int")).over(Window.partitionBy(*keys, "date"))
    return rows.select("*", missing.alias("missing")).filter("missing = 0").drop("missing")


#: Cells of a matrix that is multiplied at once, and symbols of a block of products.
CELLS, BLOCK = 4_000_000, 1_000


def outer_sums(rows: DataFrame, keys: Sequence[str] = (), powers: Sequence[tuple[int, int]] = ((1, 0), (0, 1), (1, 1)), *, times: str | None = None) -> DataFrame:
    """(keys, i, j, n, p0, p1, ...): sums over dates of x_i ** a * x_j ** b for each (a, b) of ``powers``.

    ``rows``: keys, date, symbol, x without nulls; only dates on which both symbols have a
    value count. A date's values meet as one array, blocks of dates are multiplied as
    matrices, and a row a pair of symbols and block is shuffled: no row meets another in a
    join. With ``times``, an array column that is the same for all of a date, there is a
    further key ``sample``: the place in the array, whose number is the date's weight.
    """
    more = [times] if times else []
    wide = rows.groupBy(*keys, "date", *more).agg(F.collect_list(F.struct("symbol", "x")).alias("_v")).select(*keys, *more, "_v")
    names = [f"p{k}" for k in range(len(powers))]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields] + ["sample int"] * bool(times)
    schema = ", ".join([*kinds, "i string", "j string", "n double", *(f"{n} double" for n in names)])
    out = [*keys, *["sample"] * bool(times), "i", "j", "n", *names]

    def blocks(x: np.ndarray, there: np.ndarray, weight: np.ndarray | None) -> Iterator[tuple[slice, slice, list[np.ndarray]]]:
        of = lambda k: there if k == 0 else x**k
        left = lambda k: of(k) if weight is None else of(k) * weight[:, None]
        cuts = [slice(k, k + BLOCK) for k in range(0, x.shape[1], BLOCK)]
        for one in cuts:
            for two in cuts:
                yield one, two, [left(a)[:, one].T @ of(b)[:, two] for a, b in [(0, 0), *powers]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.num_columns - 1)
            found = lists.flatten()
            at, symbols = pd.factorize(found.field(0).to_pandas(), sort=True)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            value = found.field(1).to_numpy(zero_copy_only=False)
            weights = np.array(batch.column(len(keys)).to_pylist()) if times else None
            frame = batch.select(range(len(keys))).to_pandas()
            groups = frame.groupby(list(keys), sort=False, dropna=False).indices.values() if keys else [np.arange(batch.num_rows)]
            size = max(1, CELLS // max(1, len(symbols)))
            for members in groups:
                for start in range(0, len(members), size):
                    part = members[start : start + size]
                    place = np.full(batch.num_rows, -1)
                    place[part] = np.arange(len(part))
                    inside = place[row] >= 0
                    x, there = np.zeros((len(part), len(symbols))), np.zeros((len(part), len(symbols)))
                    x[place[row[inside]], at[inside]] = value[inside]
                    there[place[row[inside]], at[inside]] = 1.0
                    for s in range(weights.shape[1]) if times else [None]:
                        for one, two, sums in blocks(x, there, weights[part, s] if times else None):
                            i, j = np.nonzero(sums[0])
                            columns = [np.asarray(symbols)[one][i], np.asarray(symbols)[two][j], *(m[i, j] for m in sums)]
                            table = pd.DataFrame(dict(zip(out[len(out) - len(columns) :], columns, strict=True)))
                            for k in reversed(keys):
                                table.insert(0, k, [frame[k].iloc[part[0]]] * len(table))
                            if times:
                                table.insert(len(keys), "sample", np.int32(s + 1))
                            yield pa.RecordBatch.from_pandas(table[out], schema=target, preserve_index=False)

    target = to_arrow_schema(StructType.fromDDL(schema))
    return wide.mapInArrow(work, schema).groupBy(*out[: out.index("n")]).agg(*(F.sum(n).alias(n) for n in ["n", *names]))


def covariance(returns: DataFrame, *, value: str = "log_ret", periods: int = TRADING_DAYS) -> DataFrame:
    """(i, j, cov, corr) annualised."""
    sums = outer_sums(complete(returns, value), powers=((1, 0), (0, 1), (1, 1), (2, 0), (0, 2)))
    n, x, y, xy, xx, yy = (F.col(c) for c in ("n", "p0", "p1", "p2", "p3", "p4"))
    inner = lambda ab, a, b: ab - a * b / n
    spread = inner(xx, x, x) * inner(yy, y, y)
    return sums.select("i", "j", F.when(n > 1, inner(xy, x, y) / (n - 1) * periods).alias("cov"), F.when(spread > 0, inner(xy, x, y) / F.sqrt(spread)).alias("corr"))


def mean_returns(returns: DataFrame, *, value: str = "log_ret", periods: int = TRADING_DAYS) -> DataFrame:
    return complete(returns, value).groupBy("symbol").agg((F.avg("x") * periods).alias("mu"))


def shrunk_covariance(returns: DataFrame, *, value: str = "ret", periods: int = TRADING_DAYS, target: str = "constant_correlation", delta: float | None = None) -> DataFrame:
    """(i, j, cov, delta): Ledoit and Wolf's shrinkage to constant correlation or a multiple of the identity, or by a ``delta`` that is given."""
    if target not in ("constant_correlation", "identity"):
        raise ValueError(f"unknown target {target!r}")
    rows = complete(returns, value)
    centred = rows.select("date", "symbol", (F.col("x") - F.avg("x").over(Window.partitionBy("symbol"))).alias("x"))
    m = outer_sums(centred, powers=((1, 1), (2, 2), (3, 1), (1, 3), (2, 0), (0, 2)))
    m = m.select("i", "j", F.col("n").alias("t"), *((F.col(f"p{k}") / F.col("n")).alias(c) for k, c in enumerate(("s", "q", "c", "c2", "si", "sj"))))
    same, s, si, sj = F.col("i") == F.col("j"), F.col("s"), F.col("si"), F.col("sj")
    pi = F.col("q") - s * s
    one = m.agg(F.avg(F.when(~same, s / F.sqrt(si * sj))).alias("rbar"), F.avg(F.when(same, s)).alias("mean_var"))  # a single row
    m = m.join(F.broadcast(one), F.lit(True))
    if target == "identity":
        m = m.select("*", F.when(same, F.col("mean_var")).otherwise(0.0).alias("f"), pi.alias("pi"), F.lit(0.0).alias("rho"))
    else:
        theta = (F.sqrt(sj / si) * (F.col("c") - si * s) + F.sqrt(si / sj) * (F.col("c2") - sj * s)) * F.col("rbar") / 2
        m = m.select("*", F.when(same, s).otherwise(F.col("rbar") * F.sqrt(si * sj)).alias("f"), pi.alias("pi"), F.when(same, pi).otherwise(theta).alias("rho"))
    gap = F.sum(F.pow(F.col("f") - s, F.lit(2)))
    share = (F.sum("pi") - F.sum("rho")) / F.when(gap > 0, gap) / F.max("t")
    own = F.when(gap > 0, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).otherwise(0.0) if delta is None else F.lit(float(delta))
    m = m.join(F.broadcast(m.agg(own.alias("delta"))), F.lit(True))
    return m.select("i", "j", (periods * (F.col("delta") * F.col("f") + (1 - F.col("delta")) * s)).alias("cov"), "delta")


def forecast_vol(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """(strategy, vol) of (strategy, symbol, weight)."""
    one, two = weights.select("strategy", F.col("symbol").alias("i"), F.col("weight").alias("wi")), weights.select("strategy", F.col("symbol").alias("j"), F.col("weight").alias("wj"))
    return one.join(cov, "i").join(two, ["strategy", "j"]).groupBy("strategy").agg(F.sqrt(F.greatest(F.sum(F.col("wi") * F.col("wj") * F.col("cov")), F.lit(0.0))).alias("vol"))


def risk_contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """(strategy, symbol, share): parts of the variance; 0 where there is next to none."""
    one, two = weights.select("strategy", F.col("symbol").alias("i"), F.col("weight").alias("wi")), weights.select("strategy", F.col("symbol").alias("j"), F.col("weight").alias("wj"))
    part = one.join(cov, "i").join(two, ["strategy", "j"]).groupBy("strategy", F.col("i").alias("symbol")).agg(F.sum(F.col("wi") * F.col("wj") * F.col("cov")).alias("part"))
    total = F.sum("part").over(Window.partitionBy("strategy"))
    return part.select("strategy", "symbol", F.when(total >= 1e-28, F.col("part") / F.when(total != 0, total)).otherwise(0.0).alias("share"))


def equilibrium_returns(weights: DataFrame, cov: DataFrame, *, risk_aversion: float = 2.5) -> DataFrame:
    return cov.join(weights.select(F.col("symbol").alias("j"), "weight"), "j", "left").groupBy(F.col("i").alias("symbol")).agg((risk_aversion * F.sum(F.col("cov") * F.coalesce("weight", F.lit(0.0)))).alias("pi"))


def market_weights(caps: DataFrame) -> DataFrame:
    """Capitalisations as weights; a missing one counts as the mean of the others."""
    every = Window.partitionBy(F.lit(0))
    rows = caps.select("symbol", F.coalesce(F.col("cap"), F.avg("cap").over(every), F.lit(1.0)).alias("cap"))
    return rows.select("symbol", (F.col("cap") / F.sum("cap").over(every)).alias("weight"))


def portfolio_shortfall(returns: DataFrame, weights: DataFrame, *, value: str = "ret", confidence: float = 0.95, periods: int = TRADING_DAYS) -> DataFrame:
    """(strategy, var, cvar, cvar_annual) of weights (strategy, symbol, weight) as positive losses."""
    rows = returns.filter(F.col(value).isNotNull()).join(weights, "symbol").groupBy("strategy", "date").agg(F.sum(F.col("weight") * F.col(value)).alias("ret"))
    return expected_shortfall(rows, "strategy", confidence=confidence).select("*", (F.col("cvar") * periods**0.5).alias("cvar_annual"))
