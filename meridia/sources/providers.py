"""Providers of prices and rates behind one protocol."""

from __future__ import annotations

import datetime
import logging
from collections.abc import Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.sources.readers import register

#: The rate that is taken where none can be had.
DEFAULT_RATE = 0.02


class RateUnavailable(RuntimeError):
    """There is no rate; not to be mistaken for a rate that equals the default."""


@runtime_checkable
class Provider(Protocol):
    def prices(self, symbols: Sequence[str], start: datetime.date, end: datetime.date) -> DataFrame:
        """(date, symbol, price), both dates included."""

    def rate(self) -> float:
        """The annual risk-free rate as a decimal."""


class FileProvider:
    """Long prices in files of any format that Spark reads; filters reach the scan."""

    def __init__(self, spark: SparkSession, path: str, *, format: str = "parquet", rates: str | None = None, **options: str) -> None:
        self.spark, self.path, self.format, self.rates, self.options = spark, path, format, rates, options

    def prices(self, symbols: Sequence[str], start: datetime.date, end: datetime.date) -> DataFrame:
        reader = self.spark.read.format(self.format).options(**self.options)
        if self.format in ("csv", "json"):
            reader = reader.schema("date DATE, symbol STRING, price DOUBLE")
        return reader.load(self.path).select("date", "symbol", "price").filter(F.col("symbol").isin(list(symbols)) & F.col("date").between(F.lit(start), F.lit(end)))

    def rate(self) -> float:
        """Last close of (date, close), in percent."""
        if self.rates is None:
            raise RateUnavailable("no table of rates")
        row = self.spark.read.format(self.format).load(self.rates).filter("close IS NOT NULL").agg(F.max_by("close", "date")).first()
        if row[0] is None:
            raise RateUnavailable("the table of rates is empty")
        return float(row[0]) / 100


class FolderProvider:
    """A folder with a delimited file a symbol, read by a source of ours; ``rates`` is the symbol whose last price is the rate in percent."""

    def __init__(self, spark: SparkSession, path: str, *, rates: str | None = None) -> None:
        register(spark)
        self.spark, self.path, self.rates = spark, path, rates

    def prices(self, symbols: Sequence[str], start: datetime.date, end: datetime.date) -> DataFrame:
        rows = self.spark.read.format("prices").load(self.path)
        return rows.filter(F.col("symbol").isin(list(symbols))).filter(F.col("date") >= F.lit(start)).filter(F.col("date") <= F.lit(end))

    def rate(self) -> float:
        if self.rates is None:
            raise RateUnavailable("no series of rates")
        row = self.spark.read.format("prices").load(self.path).filter(F.col("symbol") == self.rates).agg(F.max_by("price", "date")).first()
        if row[0] is None:
            raise RateUnavailable(f"no rate in {self.rates}")
        return float(row[0]) / 100


class FrameProvider:
    """A frame that is there already."""

    def __init__(self, frame: DataFrame, rate: float | None = None) -> None:
        self.frame, self._rate = frame, rate

    def prices(self, symbols: Sequence[str], start: datetime.date, end: datetime.date) -> DataFrame:
        return self.frame.filter(F.col("symbol").isin(list(symbols)) & F.col("date").between(F.lit(start), F.lit(end)))

    def rate(self) -> float:
        if self._rate is None:
            raise RateUnavailable("no rate given")
        return self._rate


_default: list[Provider] = []


def set_default(provider: Provider) -> None:
    _default[:] = [provider]


def get_default() -> Provider:
    if not _default:
        raise LookupError("no default provider is set")
    return _default[0]


def rate_or_default(provider: Provider) -> tuple[float, bool]:
    """The rate, and whether it is the default for want of one."""
    try:
        return provider.rate(), False
    except RateUnavailable as why:
        logging.getLogger("meridia").warning("risk-free rate: %s", why)
        return DEFAULT_RATE, True


def factor_table(spark: SparkSession, path: str) -> DataFrame:
    """(date, one column a factor) as decimals from text with a preamble: the table starts at the
    line of names that begins with a comma; rows have a date of 8 or 6 digits, percentages, and
    -99.99 or -999 where there is no value."""
    lines = spark.read.text(path)
    header = lines.filter(F.col("value").rlike("^,")).first()
    if header is None:
        raise ValueError("no line of factor names")
    names = [x.strip() for x in header[0].split(",")[1:]]
    cells = F.split("value", ",")
    number = lambda i: F.when(~F.trim(cells[i]).isin("-99.99", "-999", "-999.00"), F.trim(cells[i]).try_cast("double") / 100)
    key = F.trim(cells[0])
    date = F.coalesce(F.try_to_date(key, "yyyyMMdd"), F.try_to_date(F.concat(key, F.lit("01")), "yyyyMMdd"))
    rows = lines.filter(F.col("value").rlike(r"^\s*\d{6}(\d\d)?\s*,")).select(date.alias("date"), *(number(i + 1).alias(n) for i, n in enumerate(names)))
    return rows.na.drop()


def prices(symbols: Sequence[str], start: datetime.date, end: datetime.date, provider: Provider | None = None) -> DataFrame:
    """(date, symbol, price) of a provider or the default one."""
    return (provider or get_default()).prices(symbols, start, end)
