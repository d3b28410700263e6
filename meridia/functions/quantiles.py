"""Exact quantiles of keys of any size, without a task that holds a key's values.

A sketch of bounded size brackets each quantile; a second pass counts what lies below the
bracket and each distinct value within it; only those are ordered. Both passes aggregate
before they shuffle, so a key that holds most of the rows is no heavier than others, and
many quantiles of many keys share the two passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch misses a rank by at most n / ACCURACY; brackets are MARGIN times as wide on either side,
#: and unbounded for keys of so few values that this would be less than some ranks.
ACCURACY, MARGIN, FEW = 2_000, 4, 10_000


def brackets(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(keys, _n, _low, _high): the number of values, and for each probability bounds that its quantile lies between; null is unbounded."""
    wide = MARGIN / ACCURACY
    at = sorted({p + side for p in probs for side in (-wide, wide) if 0 < p + side < 1} | {0.5})
    sketch = rows.groupBy(*keys).agg(F.count(value).alias("_n"), F.percentile_approx(value, F.array(*map(F.lit, at)), ACCURACY).alias("_edges"))
    edge = lambda p, side: F.when(F.col("_n") > FEW, F.col("_edges")[at.index(p + side)]) if 0 < p + side < 1 else F.lit(None).cast("double")
    return sketch.select(*keys, "_n", F.array(*(edge(p, -wide) for p in probs)).alias("_low"), F.array(*(edge(p, wide) for p in probs)).alias("_high"))


def inside(rows: DataFrame, bounds: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(keys, _n, _edges, _v, _often, _total): the distinct values within brackets, and with a null value the rows between these; their number and sum.

    ``_edges`` is the number of bounds that a row has passed, which orders the gaps among the values.
    """
    both = rows.select(*keys, F.col(value).cast("double").alias("_v"))
    both = both.join(bounds, list(keys)) if keys else both.join(F.broadcast(bounds), F.lit(True))  # without keys: a single row
    entered = [F.coalesce(F.col("_v") >= F.col("_low")[k], F.lit(True)) for k in range(len(probs))]
    left = [F.coalesce(F.col("_v") > F.col("_high")[k], F.lit(False)) for k in range(len(probs))]
    edges = sum((x.cast("int") for x in entered + left), F.lit(0))
    within = reduce(or_, (a & ~b for a, b in zip(entered, left, strict=True)))
    return both.select(*keys, "_n", edges.alias("_edges"), F.when(within, F.col("_v")).alias("_v"), F.col("_v").alias("_x")).groupBy(*keys, "_n", "_edges", "_v").agg(F.count(F.lit(1)).alias("_often"), F.sum("_x").alias("_total"))


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str] | None = None, *, interpolate: bool = True, tails: bool = False) -> DataFrame:
    """(keys, n, names): quantiles of ``value`` by key with linear interpolation, nulls left out.

    With ``tails`` also the mean of the values up to each quantile, as ``<name>_mean``: sums are
    taken in the same pass. Keys without a value have no row; without ``keys`` there is one row, of null quantiles if
    there is no value. Without ``interpolate`` they are values themselves, those at the ranks below. Names are q0, q1, ... if not given. Should a sketch have missed a
    rank (it is counted, so this is known), the query fails rather than give another value.
    """
    names = names or [f"q{k}" for k in range(len(probs))]
    there = rows.filter(F.col(value).isNotNull())
    found = inside(there, brackets(there, keys, value, probs), keys, value, probs)
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_edges", F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = found.select(*keys, "_n", "_v", F.sum("_often").over(order).alias("_upto"), F.sum("_total").over(order).alias("_sum"))
    place = [(F.col("_n") - 1) * p for p in map(float, probs)]
    first = lambda rank: F.min(F.when(F.col("_upto") > rank, F.struct("_upto", "_v", "_sum")))
    ends = [first(end(x)).alias(f"_{side}{k}") for k, x in enumerate(place) for side, end in (("a", F.floor), ("b", F.ceil))]
    out = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *ends)

    def between(k: int) -> Column:
        a, b = F.col(f"_a{k}._v"), F.col(f"_b{k}._v")
        missed = F.raise_error(F.lit("a quantile lies outside of its bracket"))
        return F.when(F.col("_n").isNull(), F.lit(None).cast("double")).when(a.isNotNull() & b.isNotNull(), a + (b - a) * (place[k] - F.floor(place[k])) if interpolate else a).otherwise(missed)

    means = [(F.col(f"_a{k}._sum") / F.col(f"_a{k}._upto")).alias(f"{name}_mean") for k, name in enumerate(names)] if tails else []
    return out.select(*keys, F.col("_n").alias("n"), *(between(k).alias(name) for k, name in enumerate(names)), *means)
