"""Price folders and factor archives: filters reach the readers, members are decoded in tasks, the cache is whole."""

import datetime
import threading
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from meridia.plans.context import Context
from meridia.sources import providers, readers

D = datetime.date


@pytest.fixture
def folder(tmp_path):
    for k, symbol in enumerate(("AA", "BB", "C.D", "RATE")):
        lines = ["Date,Open,Close,Adj Close"] + [f"2021-{m:02d}-{d:02d},1,{9},{100 + k + m + d / 100}" for m in range(1, 7) for d in range(1, 29)]
        (tmp_path / f"{symbol}.csv").write_text("\n".join([*lines, "2021-07-01,1,2,null", "", "short"]) + "\n")
    (tmp_path / "note.txt").write_text("no prices")
    return str(tmp_path)


def test_price_folder(spark, folder):
    readers.register(spark)
    rows = spark.read.format("prices").load(folder)
    assert rows.count() == 4 * 6 * 28 and rows.rdd.getNumPartitions() == 4
    some = rows.filter(F.col("symbol").isin("AA", "C.D")).filter((F.col("date") > F.lit(D(2021, 2, 3))) & (F.col("date") <= F.lit(D(2021, 3, 2))))
    assert some.rdd.getNumPartitions() == 2
    got = some.collect()
    assert {r.symbol for r in got} == {"AA", "C.D"} and min(r.date for r in got) == D(2021, 2, 4) and max(r.date for r in got) == D(2021, 3, 2)
    assert {r.price for r in got if r.symbol == "AA" and r.date == D(2021, 3, 1)} == {103.01}
    assert rows.filter("symbol = 'ZZ'").count() == 0
    (row,) = rows.filter("symbol = 'BB' AND price > 107.2 AND date = DATE'2021-06-28'").collect()  # a filter on prices stays Spark's
    assert row.price == 107.28


def test_pushed_filters():
    pushed = readers.Pushed()
    other = IsNotNull(("symbol",))
    filters = [In(("symbol",), ("A", "B")), EqualTo(("symbol",), "B"), GreaterThan(("date",), D(2021, 1, 1)), LessThanOrEqual(("date",), D(2021, 1, 9)), EqualTo(("price",), 1.0), other]
    assert list(pushed.take(filters, "symbol")) == filters[4:]
    assert pushed.symbols == {"B"} and (pushed.first, pushed.last) == (D(2021, 1, 2), D(2021, 1, 9)) and not pushed.has("A")


def test_provider_of_a_folder(spark, folder):
    provider = providers.FolderProvider(spark, folder, rates="RATE")
    assert isinstance(provider, providers.Provider) and provider.rate() == pytest.approx(1.0928)
    context = Context.from_provider(provider, {"AA": 0.5, "C.D": 0.4, "GONE": 0.1}, "BB", D(2021, 1, 1), D(2021, 3, 31), as_of=D(2021, 6, 1))
    assert context.notes.dropped == ("GONE",) and context.rate == provider.rate() and not context.notes.default_rate
    assert context.panel.agg(F.max("date")).first()[0] == D(2021, 5, 28)
    with pytest.raises(providers.RateUnavailable):
        providers.FolderProvider(spark, folder).rate()
    with pytest.raises(ValueError):
        Context.from_provider(provider, {"AA": 1.0}, "BB", D(2021, 5, 1), D(2021, 3, 31), as_of=D(2021, 6, 1))
    with pytest.raises(ValueError):
        Context.from_provider(provider, {}, "BB", D(2021, 1, 1), D(2021, 3, 31))


DAILY = """Made by hand.

,Mkt-RF,SMB,RF
20210104,  1.50, -0.25, 0.01
20210105,  0.50,-99.99, 0.01
20210106, -0.75,  0.10, 0.01

  Monthly
,Mkt-RF,SMB,RF
202101,  9.00,  9.00, 0.10
Copyright
"""


@pytest.fixture
def archive(tmp_path):
    path = tmp_path / "three.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("daily.CSV", DAILY.replace("\n", "\r\n"))
        z.writestr("monthly.csv", ",Mkt-RF,SMB,RF\n202101, 2.00, 1.00, 0.10\n202102, 3.00, 1.00, 0.10\n")
        z.writestr("readme.md", "nothing")
    return str(path)


def test_factor_archive(spark, archive, tmp_path):
    rows = readers.factors(spark, archive, member="daily.CSV")
    assert rows.columns == ["date", "Mkt-RF", "SMB", "RF"] and rows.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, rows.collect())) == [(D(2021, 1, 4), 0.015, -0.0025, 0.0001), (D(2021, 1, 6), -0.0075, 0.001, 0.0001)]
    assert [r.date for r in readers.factors(spark, archive, member="monthly.csv", start=D(2021, 2, 1)).collect()] == [D(2021, 2, 1)]
    assert readers.factors(spark, archive).count() == 4 and readers.factors(spark, archive, end=D(2021, 1, 4)).count() == 2
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("a.csv", "no table here\n")
        z.writestr("b.md", "x")
    with pytest.raises(Exception, match="no table"):
        readers.factors(spark, str(tmp_path / "none.zip")).count()


def test_cold_cache_read_by_two(spark, archive, tmp_path):
    cache, found, loads = str(tmp_path / "cache"), [], []
    gate = threading.Barrier(2)

    def load():
        loads.append(1)
        gate.wait(60)  # both have seen that there is no table
        return spark.read.format("factor_archive").load(archive)

    readers.register(spark)
    threads = [threading.Thread(target=lambda: found.append(readers.cached(spark, cache, "three", load).count())) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == [4, 4] and len(loads) == 2
    assert readers.cached(spark, cache, "three", lambda: pytest.fail("it is there already")).count() == 4
    assert [p.name for p in (tmp_path / "cache").iterdir() if not p.name.endswith(".crc")] == ["three.parquet"]
    assert readers.factors(spark, archive, cache=cache, member="daily.CSV").count() == 2
