"""Least expected shortfall by cutting planes: scenarios stay in Spark, the solver sees cuts.

The shortfall of weights is the mean loss in the worst dates, those up to the rank of the
quantile (of equal ones at that rank, so many as belong to it). It is the largest mean
loss over all sets of so many dates, so the mean returns of the tail at any weights are
a plane that lies below it everywhere and touches it there. A round solves a small quadratic program over the planes found so far, near the best
weights, for several step sizes at once; Spark then finds the tails of all these candidates in
one pass and sums them: what comes back is a row a candidate and symbol. It ends when the
planes' lower bound meets the best value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions import solvers
from meridia.functions.quantiles import exact_quantiles
from meridia.operators.moments import complete

#: Candidates (rows) to their shortfalls and the planes that touch there.
Evaluate = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Steps of the candidates of a round, from near the best weights to as far as the planes' own minimum.
STEPS = (0.03, 0.3, 3.0, 1e7)


@dataclass(frozen=True)
class Least:
    weights: np.ndarray
    value: float
    bound: float  # no weights within the limits have less
    rounds: int


def least(evaluate: Evaluate, limits: solvers.Limits, *, tolerance: float = 1e-7, rounds: int = 500) -> Least:
    """The least value of a function that is the maximum of planes through the origin; an error if ``rounds`` don't suffice."""
    start = [np.full(limits.n, limits.budget / limits.n), *(np.eye(limits.n) * limits.budget if limits.n <= 50 else [])]
    ask = np.array([solvers.solve_qp(np.eye(limits.n), -w, limits) for w in start])
    values, planes = evaluate(ask)
    best, value = ask[values.argmin()], values.min()
    bound, scale = -np.inf, max(np.abs(planes).max(), 1e-300)
    a, low, high = limits.rows
    away = np.maximum(np.abs(np.broadcast_to(limits.high, limits.n) - best), np.abs(best - np.broadcast_to(limits.low, limits.n)))
    reach = min(float(away @ away), 2.0 * limits.budget**2 if np.min(limits.low) >= 0 else np.inf)
    for k in range(rounds):
        ask = []
        for step in STEPS:
            problem = solvers.Limits(limits.n + 1)
            m = len(planes)
            problem.rows = (
                np.block([[a, np.zeros((len(a), 1))], [planes / scale, -np.ones((m, 1))]]),
                np.concatenate([low, np.full(m, -np.inf)]),
                np.concatenate([high, np.zeros(m)]),
            )
            near = np.diag([*np.full(limits.n, 1 / step), 0.0])
            w = solvers.solve_qp(near, np.array([*(-best / step), 1.0]), problem)[:-1]
            model = float((planes @ w).max())
            ask.append(w)
            bound = max(bound, model - scale * (reach - float((w - best) @ (w - best))) / (2 * step))
        if value - bound <= tolerance * max(abs(value), scale):
            return Least(best, float(value), float(bound), k)
        found, more = evaluate(np.array(ask))
        planes = np.concatenate([planes, more])
        if found.min() < value:
            best, value = ask[int(found.argmin())], found.min()
    raise ValueError(f"no optimum after {rounds} rounds: {value} with a bound of {bound}")


def tails_of(returns: np.ndarray, confidence: float) -> Evaluate:
    """Shortfalls over a matrix of dates and symbols that is here."""

    most = int((len(returns) - 1) * (1 - confidence)) + 1

    def evaluate(candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = returns @ candidates.T
        return _planes(candidates, *_tail(returns, values, np.partition(values, most - 1, axis=0)[most - 1]), most)

    return evaluate


def _tail(x: np.ndarray, values: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of rows of ``x`` (and their number) whose value is below a candidate's edge, then of those at it."""
    ones = np.column_stack([x, np.ones(len(x))])
    return (values < edge).T.astype(float) @ ones, (values == edge).T.astype(float) @ ones


def _planes(candidates: np.ndarray, below: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    share = (most - below[:, -1]) / at[:, -1]
    planes = -(below + share[:, None] * at)[:, :-1] / most
    return (planes * candidates).sum(axis=1), planes


def _spark_tails(wide: DataFrame, n: int, confidence: float) -> Evaluate:
    """Shortfalls over ``wide`` (x: an array of all symbols' returns a date). Only candidates go there, only planes come back."""

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)

    def evaluate(candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = len(candidates)

        def portfolio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = matrix(batch) @ candidates.T
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(count, dtype=np.int32), len(values))), pa.array(values.ravel())], names=["c", "ret"])

        cut = exact_quantiles(wide.mapInArrow(portfolio, "c int, ret double"), ["c"], "ret", [1 - confidence], interpolate=False)
        edges = sorted(cut.collect(), key=lambda r: r.c)
        edge, most = np.array([r.q0 for r in edges]), int((edges[0].n - 1) * (1 - confidence)) + 1

        def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, count, n + 1))
            for batch in batches:
                x = matrix(batch)
                total += np.stack(_tail(x, x @ candidates.T, edge))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "total"])

        out = np.zeros(2 * count * (n + 1))
        for r in wide.mapInArrow(tail, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect():
            out[r.cell] = r.total
        return _planes(candidates, *out.reshape(2, count, n + 1), most)

    return evaluate


def min_shortfall(returns: DataFrame, *, limiter: Callable[[list[str]], solvers.Limits] | None = None, confidence: float = 0.95, value: str = "ret", tolerance: float = 1e-7) -> DataFrame:
    """(symbol, weight, shortfall, bound, tail): the weights of least expected shortfall within limits, over dates on which all symbols have a value.

    ``bound``: no weights have less, but for the tolerance. Dates are read in several
    rounds; a row a symbol comes to the driver.
    """
    rows = complete(returns, value)
    symbols = [r.symbol for r in rows.select("symbol").distinct().orderBy("symbol").collect()]
    schema = "symbol string, weight double, shortfall double, bound double, tail double"
    if not symbols:
        return returns.sparkSession.createDataFrame([], schema)
    limits = limiter(symbols) if limiter else solvers.Limits(len(symbols))
    wide = rows.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("symbol", "x"))).alias("v")).select(F.col("v.x").alias("x")).persist()
    try:
        found = least(_spark_tails(wide, len(symbols), confidence), limits, tolerance=tolerance)
    finally:
        wide.unpersist()
    data = [(s, float(w), found.value, found.bound, 1 - confidence) for s, w in zip(symbols, found.weights, strict=True)]
    return returns.sparkSession.createDataFrame(data, schema)


def min_shortfall_by(returns: DataFrame, key: str, *, limiter: Callable[[list[str]], solvers.Limits] | None = None, confidence: float = 0.95, value: str = "ret") -> DataFrame:
    """(key, strategy, symbol, weight) of each key, a task each: for keys of few dates, as rolling windows are."""
    kind = returns.schema[key].dataType.simpleString()

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot(index="date", columns="symbol", values="x").dropna()
        limits = limiter(list(table.columns)) if limiter else solvers.Limits(table.shape[1])
        w = least(tails_of(table.to_numpy(), confidence), limits).weights if len(table) else np.zeros(0)
        return pd.DataFrame({key: frame[key].iloc[0], "strategy": "cvar", "symbol": table.columns[: len(w)], "weight": w})

    return complete(returns, value, key).groupBy(key).applyInPandas(solve, f"{key} {kind}, strategy string, symbol string, weight double")
