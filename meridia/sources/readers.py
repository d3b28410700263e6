"""Data sources: prices in a file a symbol, and factor tables in zip archives, with a cache.

``prices`` reads a folder of delimited files, one a symbol. Filters on symbols choose the
files, filters on dates are applied while a file is read; each file is a partition. The
price is that of the first of the preferred columns that a file has.

``factor_archive`` reads the tables of delimited files within zip archives: each member
is a partition, and is decoded in its task. A member is a preamble, then tables, each a
line of names that begins with a comma and rows of a date and percentages; the first
table alone is read, as what follows (months, years) says the same at other periods.
"""

from __future__ import annotations

import csv
import datetime
import glob
import io
import os
import uuid
import zipfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Columns that hold the price, the best first.
PRICE_COLUMNS = ("adj close", "adj_close", "close", "price")
#: What stands for no value in factor tables.
MISSING = ("-99.99", "-999", "-999.00", "")


class Pushed:
    """What filters on a symbol and a date leave: a set of symbols and a range of dates."""

    def __init__(self) -> None:
        self.symbols: set[str] | None = None
        self.first, self.last = datetime.date.min, datetime.date.max

    def take(self, filters: Iterable[Filter], symbol: str) -> Iterator[Filter]:
        """Applies those that can be; yields the others."""
        day = datetime.timedelta(days=1)
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == (symbol,) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = wanted if self.symbols is None else self.symbols & wanted
            elif column == ("date",) and isinstance(f, EqualTo):
                self.first, self.last = max(self.first, f.value), min(self.last, f.value)
            elif column == ("date",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + day if isinstance(f, GreaterThan) else f.value)
            elif column == ("date",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value - day if isinstance(f, LessThan) else f.value)
            else:
                yield f

    def has(self, symbol: str) -> bool:
        return self.symbols is None or symbol in self.symbols


class PriceFile(InputPartition):
    def __init__(self, symbol: str, path: str) -> None:
        super().__init__((symbol, path))
        self.symbol, self.path = symbol, path


class PriceReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        if "path" not in options:
            raise ValueError("a folder of files is needed: load(path)")
        self.path, self.suffix, self.pushed = options["path"], options.get("suffix", ".csv"), Pushed()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return list(self.pushed.take(filters, "symbol"))

    def partitions(self) -> list[InputPartition]:
        names = {os.path.basename(f).removesuffix(self.suffix): f for f in sorted(glob.glob(os.path.join(glob.escape(self.path), f"*{self.suffix}")))}
        return [PriceFile(s, f) for s, f in names.items() if self.pushed.has(s)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, PriceFile):
            return  # Spark asks for one task where there is no file
        with open(partition.path, newline="", encoding="utf-8-sig") as lines:
            rows = csv.reader(lines)
            names = [x.strip().lower() for x in next(rows, [])]
            price = next((names.index(c) for c in PRICE_COLUMNS if c in names), None)
            if "date" not in names or price is None:
                raise ValueError(f"{partition.path} has no date or no price among {names}")
            at = names.index("date")
            for row in rows:
                if len(row) <= max(at, price):
                    continue
                date = datetime.date.fromisoformat(row[at].strip()[:10])
                if self.pushed.first <= date <= self.pushed.last:
                    try:
                        value = float(row[price])
                    except ValueError:
                        continue
                    if value == value:
                        yield date, partition.symbol, value


class PriceFolder(DataSource):
    """``spark.read.format("prices").load(folder)``: date, symbol, price."""

    @classmethod
    def name(cls) -> str:
        return "prices"

    def schema(self) -> str:
        return "date date, symbol string, price double"

    def reader(self, schema: object) -> DataSourceReader:
        return PriceReader(dict(self.options))


class Member(InputPartition):
    def __init__(self, archive: str, member: str) -> None:
        super().__init__((archive, member))
        self.archive, self.member = archive, member


def _archives(path: str) -> list[str]:
    found = sorted(glob.glob(os.path.join(glob.escape(path), "*.zip"))) if os.path.isdir(path) else [path]
    if not found:
        raise ValueError(f"no archive in {path}")
    return found


def _members(path: str) -> list[Member]:
    out = []
    for archive in _archives(path):
        with zipfile.ZipFile(archive) as z:
            out += [Member(archive, m) for m in sorted(z.namelist()) if m.lower().endswith((".csv", ".txt"))]
    if not out:
        raise ValueError(f"no delimited file in {path}")
    return out


def table_of(lines: Iterable[str]) -> Iterator[list[str]]:
    """The cells of the first table: its names, then its rows, up to the line that isn't one."""
    begun = False
    for line in lines:
        cells = [x.strip() for x in line.rstrip("\r\n").split(",")]
        if not begun:
            if begun := line.startswith(",") and len(cells) > 1:
                yield cells[1:]
        elif len(cells) > 1 and cells[0].isdigit() and len(cells[0]) in (6, 8):
            yield cells
        elif any(cells):
            return
        # an empty line may stand within a table


def date_of(digits: str) -> datetime.date:
    return datetime.date(int(digits[:4]), int(digits[4:6]), int(digits[6:] or 1))


class FactorReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.path, self.names, self.pushed = options["path"], names, Pushed()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return list(self.pushed.take(filters, "member"))

    def partitions(self) -> list[InputPartition]:
        return [m for m in _members(self.path) if self.pushed.has(m.member)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, Member):
            return
        with zipfile.ZipFile(partition.archive) as z, z.open(partition.member) as raw:
            rows = table_of(io.TextIOWrapper(raw, encoding="utf-8", errors="replace"))
            if next(rows, None) is None:
                raise ValueError(f"no table in {partition.member} of {partition.archive}")
            for row in rows:
                date = date_of(row[0])
                values = row[1 : len(self.names) + 1]
                if self.pushed.first <= date <= self.pushed.last and len(values) == len(self.names) and not any(v in MISSING for v in values):
                    yield partition.member, date, *(float(v) / 100 for v in values)


class FactorArchive(DataSource):
    """``spark.read.format("factor_archive").load(file or folder)``: member, date and a column a factor, as decimals.

    Rows without a value of every factor are left out. The names are those of the first member.
    """

    @classmethod
    def name(cls) -> str:
        return "factor_archive"

    def _names(self) -> list[str]:
        first = _members(self.options["path"])[0]
        with zipfile.ZipFile(first.archive) as z, z.open(first.member) as raw:
            names = next(table_of(io.TextIOWrapper(raw, encoding="utf-8", errors="replace")), None)
        if names is None:
            raise ValueError(f"no table in {first.member} of {first.archive}")
        return names

    def schema(self) -> str:
        return "member string, date date, " + ", ".join(f"`{n}` double" for n in self._names())

    def reader(self, schema: object) -> DataSourceReader:
        return FactorReader(dict(self.options), self._names())


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, with filters that reach the readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PriceFolder, FactorArchive):
        spark.dataSource.register(source)


def cached(spark: SparkSession, folder: str, name: str, load: object) -> DataFrame:
    """The frame that ``load()`` gives, written once as Parquet below ``folder`` and read from there.

    It is written beside its place and renamed: a reader sees a whole table or none. Of two
    that start cold at once the first to finish stays, the other takes that one. The folder
    is one that all executors reach.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(f"{folder}/{name}.parquet")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        own = hadoop.Path(f"{folder}/.{name}-{uuid.uuid4().hex}.parquet")
        load().write.parquet(own.toString())
        # renaming onto a folder that is there would move into it, so it is looked for again
        if files.exists(place) or not files.rename(own, place):
            files.delete(own, True)
        elif files.exists(hadoop.Path(place, own.getName())):
            files.delete(hadoop.Path(place, own.getName()), True)  # another was first between the look and the move
    return spark.read.parquet(place.toString())


def factors(spark: SparkSession, path: str, *, member: str | None = None, start: datetime.date | None = None, end: datetime.date | None = None, cache: str | None = None) -> DataFrame:
    """(date, one column a factor) of an archive between two dates, both included; with ``cache`` the archive is decoded once."""
    register(spark)
    load = lambda: spark.read.format("factor_archive").load(path)
    name = os.path.basename(path.rstrip("/")).removesuffix(".zip")
    rows = cached(spark, cache, name, load) if cache else load()
    for wanted in ([F.col("member") == member] if member else []) + ([F.col("date") >= F.lit(start)] if start else []) + ([F.col("date") <= F.lit(end)] if end else []):
        rows = rows.filter(wanted)
    return rows.drop("member")
