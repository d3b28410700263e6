"""Embedding whitening from an exact scatter matrix, computed in residues.

Entries are turned into integers. Every task multiplies its vectors modulo several primes
below 2^20 as double matrices (8,192 rows at a time, so that no product sum passes 2^53),
and keeps one matrix a prime. Spark adds those cell by cell; the driver puts the sums
together by Chinese remaindering. How many primes are needed follows from the number of
vectors and the largest entry, which a first pass finds, so the scatter is exact for any
partitioning and after lost executors. A column of ones gives the sums and the count.

The covariance (n * scatter - sums * sums') / n^2 is exact too: only the last division
rounds, to the nearest double. Whitened values start from the integers n * x - sums, so
nothing cancels.

Bounds: the driver holds dimensions^2 integers a prime, so ``MOST_DIMENSIONS`` is an error
beyond; a task sends half of that.

Edge cases: a null vector, and one with a null, NaN or infinite entry, is dropped; a null
or repeated id is kept as it is, equal vectors get equal values. Vectors of different
lengths, and entries that don't fit a long, are a ValueError. Components without variance
(fewer vectors than dimensions, equal entries) have a null whitened value and explain 0;
the identity's error is taken over the others. An empty table, and vectors without
entries, give no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import lean

MOST_DIMENSIONS = 2048
PRIMES_BELOW = 1 << 20
#: Rows of a product: 2^13 * (2^20)^2 = 2^53.
GEMM_ROWS = 1 << 13
SCALE, SHIFT = 64, 1_000_000


@dataclass(frozen=True)
class Whitening:
    """Components by falling eigenvalue, of n integer vectors with these sums."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues, the first ones
    axes: np.ndarray  # unit columns
    trace: float
    error: float  # of the whitened covariance, filled in by ``measured``

    @property
    def live(self) -> np.ndarray:
        """Components with variance."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)


def primes(count: int) -> list[int]:
    """The largest primes below ``PRIMES_BELOW``."""
    out, n = [], PRIMES_BELOW - 1
    while len(out) < count:
        if all(n % d for d in range(3, isqrt(n) + 1, 2)):
            out.append(n)
        n -= 2
    return out


def primes_for(n: int, largest: int) -> list[int]:
    """So many primes that sums of n products of two entries up to ``largest`` in size are told apart."""
    span, product, count = 2 * n * max(largest, 1) ** 2 + 1, 1, 0
    while product < span:
        count += 1
        product *= primes(count)[-1]
    return primes(count)


def remaindered(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """The integers nearest to 0 with these residues (a row a prime), as Python integers."""
    total, product = residues[0].astype(object), moduli[0]
    for row, p in zip(residues[1:], moduli[1:], strict=True):
        digit = (row.astype(object) - total) * pow(product, -1, p) % p
        total, product = total + digit * product, product * p
    return np.where(total > product // 2, total - product, total)


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows of ``table`` whose vector has no null or non-finite entry."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return table.filter(F.col(vector).isNotNull() & F.forall(F.col(vector).cast("array<double>"), finite))


def integers(vectors: pa.Array, dimensions: int) -> np.ndarray:
    """floor(64 * c) + 1000000 of each entry, a row a vector."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dimensions)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def _residue_products(batches: Iterator[pa.RecordBatch], dimensions: int, moduli: list[int]) -> np.ndarray:
    out = np.zeros((len(moduli), dimensions + 1, dimensions + 1), np.int64)
    for batch in batches:
        for low in range(0, batch.num_rows, GEMM_ROWS):
            x = integers(batch.column(0).slice(low, GEMM_ROWS), dimensions)
            x = np.column_stack([x, np.ones(len(x), np.int64)])
            for k, p in enumerate(moduli):
                rest = (x % p).astype(float)
                out[k] = (out[k] + (rest.T @ rest).astype(np.int64)) % p
    return out


def scatter(vectors: DataFrame, dimensions: int, moduli: list[int]) -> np.ndarray:
    """Sums of products of all pairs of dimensions (the last one is 1) as exact integers."""
    rows, columns = np.triu_indices(dimensions + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _residue_products(batches, dimensions, moduli)
        for k in range(len(moduli)):
            cell = np.arange(len(rows)) + k * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(found[k][rows, columns])], names=["cell", "residue"])

    summed = vectors.mapInArrow(lean(work), "cell long, residue long").groupBy("cell").agg(F.sum("residue").alias("residue"))
    residues = np.zeros((len(moduli), len(rows)), np.int64)
    for part in summed.toArrow().to_batches():
        cell, residue = (part.column(i).to_numpy() for i in (0, 1))
        residues[cell // len(rows), cell % len(rows)] = residue
    exact = remaindered(residues % np.array(moduli)[:, None], moduli)
    out = np.zeros((dimensions + 1, dimensions + 1), object)
    out[rows, columns] = out[columns, rows] = exact
    return out


def fit(table: DataFrame, vector: str = "embedding", components: int = 32) -> Whitening | None:
    """The first components of all usable vectors' covariance; None if there is no entry."""
    vectors = usable(table, vector).select(F.col(vector).cast("array<double>").alias("vector"))
    size = F.size("vector")
    largest = F.max(F.array_max(F.transform("vector", lambda c: F.abs(F.floor(c * SCALE).cast("double")))))
    n, low, high, top = vectors.agg(F.count("*"), F.min(size), F.max(size), largest).first()
    if not n or not high:
        return None
    if low != high or high > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {low} to {high} entries; one length up to {MOST_DIMENSIONS} is needed")
    if top + SHIFT >= 2.0**63:
        raise ValueError("an entry doesn't fit a long")
    sums = scatter(vectors, high, primes_for(n, int(top) + SHIFT))
    s = sums[high, :high]
    spread = n * sums[:high, :high] - np.outer(s, s)
    covariance = np.array([[x / (n * n) for x in row] for row in spread.tolist()])
    values, axes = np.linalg.eigh(covariance)
    first = np.argsort(-values, kind="stable")[:components]
    model = Whitening(n, tuple(s.tolist()), values[first], axes[:, first], sum(spread.diagonal().tolist()) / (n * n), 0.0)
    return measured(vectors, model)


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - sums as exact integers; Python's where a long could be too short."""
    middle = np.array([s // model.n for s in model.sums], np.int64)
    off, rest = x - middle, np.array([s - model.n * m for s, m in zip(model.sums, middle.tolist(), strict=True)], object)
    longest = max(int(np.abs(off).max(initial=0)), 1) * model.n + model.n
    if longest**2 * max(x.shape[1], 1) < 2**63:
        return model.n * off - rest.astype(np.int64)
    return model.n * off.astype(object) - rest


def _project(centred: np.ndarray, model: Whitening) -> np.ndarray:
    scale = np.divide(1.0, np.sqrt(model.values, where=model.live, out=np.ones(len(model.values))), where=model.live, out=np.full(len(model.values), np.nan))
    return (centred.astype(float) / model.n) @ model.axes * scale


def measured(vectors: DataFrame, model: Whitening) -> Whitening:
    """``model`` with the largest entry of the whitened covariance minus the identity, from all vectors."""
    live = int(model.live.sum())
    rows, columns = np.triu_indices(live + 1)
    size = len(model.sums)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((live + 1, live + 1))
        for batch in batches:
            for low in range(0, batch.num_rows, GEMM_ROWS):
                z = _project(_centred(integers(batch.column(0).slice(low, GEMM_ROWS), size), model), model)[:, :live]
                z = np.column_stack([z, np.ones(len(z))])
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(total[rows, columns])], names=["cell", "total"])

    if not live:
        return model
    summed = vectors.mapInArrow(lean(work), "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    total = np.zeros((live + 1, live + 1))
    cell = summed["cell"].to_numpy()
    total[rows[cell], columns[cell]] = total[columns[cell], rows[cell]] = summed["total"].to_numpy()
    mean = total[live, :live] / model.n
    off = total[:live, :live] / model.n - np.outer(mean, mean) - np.eye(live)
    return Whitening(model.n, model.sums, model.values, model.axes, model.trace, float(np.abs(off).max()))


def whiten(table: DataFrame, model: Whitening | None, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, ``deviation`` (decimal, exact) and ``whitened`` (an array) of each usable row."""
    kind = table.schema[key].dataType.simpleString()
    rows = usable(table, vector).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    schema = f"key {kind}, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    size, count = len(model.sums), len(model.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, GEMM_ROWS):
                part = batch.slice(low, GEMM_ROWS)
                centred = _centred(integers(part.column(1), size), model)
                square = (centred * centred).sum(axis=1)
                z = _project(centred, model).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * count, pa.int32()), pa.array(z, from_pandas=True))
                exact = pa.array([int(x) for x in square], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([part.column(0), exact, lists], names=["key", "deviation", "whitened"])

    return rows.mapInArrow(lean(work), schema).withColumnRenamed("key", key)


def op13_whitening(embeddings: DataFrame) -> DataFrame:
    """A row a vector and component, up to 32; ``deviation`` is null where it doesn't fit a long (n * n times a variance)."""
    model = fit(embeddings)
    rows = whiten(embeddings, model)
    n, trace, error = (model.n, model.trace, model.error) if model else (0, 0.0, 0.0)
    shares = [float(v / trace) if live else 0.0 for v, live in zip(model.values, model.live, strict=True)] if model else []
    values = F.zip_with("whitened", F.array(*map(F.lit, shares)).cast("array<double>"), lambda w, e: F.struct(w.alias("whitened"), e.alias("explained")))
    return rows.select("vec_id", "deviation", F.posexplode(values).alias("at", "value")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS long)").alias("deviation"),
        "value.whitened",
        "value.explained",
        F.lit(error).alias("identity_error"),
    )
