"""What is known of each asset: fundamentals, capitalisations, exposures, and a sentence on it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators import factors

FUNDAMENTALS = {"name": "string", "sector": "string", "market_cap": "double", "pe_ratio": "double", "dividend_yield": "double", "week52_high": "double", "week52_low": "double"}


def fundamentals(symbols: DataFrame, known: DataFrame | None) -> DataFrame:
    """(symbol, all columns of FUNDAMENTALS): null where nothing is known; columns that ``known`` lacks are null."""
    have = set(known.columns) if known is not None else set()
    rows = symbols.select("symbol").distinct()
    if known is not None:
        rows = rows.join(known.select("symbol", *(c for c in FUNDAMENTALS if c in have)), "symbol", "left")
    return rows.select("symbol", *((F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in FUNDAMENTALS.items()))


def market_caps(symbols: DataFrame, known: DataFrame | None) -> DataFrame:
    """(symbol, cap): a missing one is the mean of those there are, 1 if there are none.

    Without a table of capitalisations it is an error, not a guess.
    """
    if known is None:
        raise ValueError("no table of capitalisations")
    rows = symbols.select("symbol").distinct().join(known.select("symbol", "cap"), "symbol", "left")
    return rows.select("symbol", F.coalesce("cap", F.avg("cap").over(Window.partitionBy(F.lit(0))), F.lit(1.0)).alias("cap"))  # a row a symbol


def _percent(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), "n/a").otherwise(F.format_string("%.1f%%", c * 100))


def _number(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), "n/a").otherwise(F.format_string("%.2f", c))


def narration() -> Column:
    """A sentence on a row of ``info``; what is missing is n/a."""
    c = F.col
    risk = F.when(c("beta") > 1.2, "more volatile than the benchmark").when(c("beta") < 0.8, "calmer than the benchmark").when(c("beta").isNotNull(), "about as volatile as the benchmark").otherwise("without a benchmark to compare")
    return F.concat(
        c("symbol"), F.lit(" returned "), _percent(c("ann_return")), F.lit(" a year at a volatility of "), _percent(c("ann_vol")), F.lit(" (Sharpe "), _number(c("sharpe")),
        F.lit("); it is "), risk, F.lit(" (beta "), _number(c("beta")), F.lit(")."),
    )


def info(returns: DataFrame, weights: DataFrame | None = None, *, known: DataFrame | None = None, factor_rows: DataFrame | None = None, x: Sequence[str] = (), rf: float = 0.02, narrate: Callable[[dict], str] | None = None) -> DataFrame:
    """Analytics, weight, correlation to the portfolio, exposures, fundamentals and a sentence, a row a symbol.

    ``returns``: (date, symbol, ret, bench). ``factor_rows``: (date, symbol, y, factors).
    ``narrate`` may word the sentence; where it fails or is blank the standard one stays.
    """
    out = factors.asset_analytics(returns, rf=rf)
    if weights is not None:
        portfolio = returns.join(weights, "symbol").groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("_p"))
        corr = returns.join(portfolio, "date").groupBy("symbol").agg(F.corr("ret", "_p").alias("portfolio_corr"))
        out = out.join(weights, "symbol", "left").join(corr, "symbol", "left")
    if factor_rows is not None:
        fit = factors.regression(factor_rows, "symbol", x=x)
        out = out.join(fit.select("symbol", *(f"beta_{c}" for c in x)), "symbol", "left")
    out = out.join(fundamentals(out, known), "symbol").select("*", narration().alias("narration"))
    if narrate is None:
        return out

    def work(frames):
        for frame in frames:
            for i, row in frame.iterrows():
                try:
                    text = narrate(row.to_dict())
                except Exception:  # noqa: BLE001, the caller's wording must not end the job
                    continue
                if isinstance(text, str) and text.strip():
                    frame.loc[i, "narration"] = text
            yield pd.DataFrame(frame)

    return out.mapInPandas(work, out.schema)
