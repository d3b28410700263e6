"""A stream's panel: tumbling windows per symbol, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_prices(stream: DataFrame, *, time: str = "ts", symbol: str = "event_type", value: str = "value", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(date, symbol, price, n) of a stream or a table; rows later than ``late`` are left out of a stream."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(F.window(time, window).alias("w"), F.col(symbol).alias("symbol")).agg(F.avg(value).alias("price"), F.count(value).alias("n"))
    return out.select(F.to_date("w.start").alias("date"), "symbol", "price", "n")
