"""Long price panels (date, symbol, price) and the macros that every operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

TRADING_DAYS = 252


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def along(*keys: str, order: str = "date") -> WindowSpec:
    """Rows of each key in order; unordered keys make a single task of all rows, so none is an error."""
    if not keys:
        raise ValueError("a window needs a key, or all rows go to one task")
    return Window.partitionBy(*keys).orderBy(order)


def trailing(rows: int, *keys: str, order: str = "date") -> WindowSpec:
    return along(*keys, order=order).rowsBetween(1 - rows, 0)


def so_far(*keys: str, order: str = "date") -> WindowSpec:
    return along(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, of: Column, rows: int, over: WindowSpec) -> Column:
    """A moving value, null until its window holds ``rows`` values of ``of``."""
    return F.when(F.count(of).over(over) >= rows, value)


def clean(value: Column) -> Column:
    """NaN and infinity as null: one kind of missing value."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def spine(raw: DataFrame) -> DataFrame:
    """Every date for every symbol; prices where there are none are null.

    Symbols are a dimension: their distinct list is collected per date set, not per row.
    """
    dates, symbols = raw.select("date").distinct(), raw.select("symbol").distinct()
    return dates.join(symbols, F.lit(True)).join(raw, ["date", "symbol"], "left")


def filled(panel: DataFrame, *, backward: bool = False) -> DataFrame:
    """Forward fill per symbol, backward too if asked, then only dates on which all symbols have a price."""
    forward = F.last("price", ignorenulls=True).over(so_far("symbol"))
    out = panel.select("date", "symbol", forward.alias("price"))
    if backward:
        rest = along("symbol").rowsBetween(0, Window.unboundedFollowing)
        out = out.select("date", "symbol", F.coalesce("price", F.first("price", ignorenulls=True).over(rest)).alias("price"))
    missing = F.sum(F.col("price").isNull().cast("int")).over(Window.partitionBy("date"))
    return out.select("*", missing.alias("missing")).filter("missing = 0").drop("missing")


def with_returns(panel: DataFrame, *keys: str, price: str = "price") -> DataFrame:
    """The panel with ``ret`` (simple) and ``log_ret``, null on the first row of a key."""
    before = F.lag(price).over(along(*(keys or ("symbol",))))
    change = F.try_divide(F.col(price), before)
    return panel.select("*", (change - 1).alias("ret"), F.when(change > 0, F.ln(change)).alias("log_ret"))


def ship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily, three symbols: mean unit price of what ships, by return flag."""
    raw = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("symbol"), "l_extendedprice", "l_quantity")
    raw = raw.groupBy("date", "symbol").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    return filled(spine(raw))


def week_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly, five symbols: mean order price by priority."""
    raw = read(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("date"), F.col("o_orderpriority").alias("symbol"), "o_totalprice")
    raw = raw.groupBy("date", "symbol").agg(F.avg("o_totalprice").alias("price"))
    return filled(spine(raw))


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty days, one symbol an event type: mean value."""
    raw = read(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("symbol"), "value")
    return raw.groupBy("date", "symbol").agg(F.avg("value").alias("price"))


def week_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, bench): mean price of all orders of a week."""
    raw = read(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("date"), "o_totalprice")
    return raw.groupBy("date").agg(F.avg("o_totalprice").alias("bench"))


def sql_panel(name: str) -> str:
    """The panel in DuckDB's SQL: common table expressions up to px (date, symbol, price)."""
    raw = {
        "ship": "SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS symbol, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem GROUP BY 1, 2",
        "week": "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, o_orderpriority AS symbol, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2",
        "event": "SELECT CAST(ts AS DATE) AS date, event_type AS symbol, avg(value) AS price FROM events GROUP BY 1, 2",
    }[name]
    return f"""raw AS ({raw}),
spine AS (SELECT d.date, s.symbol, raw.price FROM (SELECT DISTINCT date FROM raw) d CROSS JOIN (SELECT DISTINCT symbol FROM raw) s
  LEFT JOIN raw ON raw.date = d.date AND raw.symbol = s.symbol),
ff AS (SELECT date, symbol, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM spine),
px AS (SELECT * FROM ff WHERE date NOT IN (SELECT date FROM ff WHERE price IS NULL)),
rets AS (SELECT date, symbol, price, price / lag(price) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret,
  ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY date)) AS log_ret FROM px)"""
