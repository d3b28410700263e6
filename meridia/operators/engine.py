"""Cost-aware rebalancing without a day loop.

Between two rebalances a portfolio's value is a weighted sum of price ratios, so wealth
is a product over completed segments times the ratio within the present one. Strategies
are a key: any number of them run as one plan, and every window is partitioned by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.plans.panel import TRADING_DAYS, along, so_far

CALENDAR = {"M": "month", "Q": "quarter", "Y": "year"}


def rebalance_flags(days: DataFrame, mode: str | int | None, *keys: str) -> DataFrame:
    """``flag`` on the first row of each new period (or every ``mode`` rows) of (keys, date); always on the first."""
    order = along(*keys)
    first = F.row_number().over(order) == 1
    if mode is None:
        flag = first
    elif isinstance(mode, int):
        flag = (F.row_number().over(order) - 1) % mode == 0
    elif mode in CALENDAR:
        number = F.date_part(F.lit(CALENDAR[mode]), F.col("date"))
        flag = first | (number != F.lag(number).over(order))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return days.select("*", flag.alias("flag"))


def as_of_weights(grid: DataFrame, schedule: DataFrame) -> DataFrame:
    """(strategy, date, symbol, price, target): the schedule's last row at or before each date.

    Both timelines are united and the last value carried forward, so no row meets many.
    A date whose schedule leaves a symbol out gives it 0.
    """
    dated = schedule.select("strategy", F.col("eff_date").alias("date")).distinct()
    symbols = schedule.select("strategy", "symbol").distinct()
    whole = dated.join(symbols, "strategy").join(schedule.withColumnRenamed("eff_date", "date"), ["strategy", "date", "symbol"], "left")
    marks = whole.select("strategy", "date", "symbol", F.lit(None).cast("double").alias("price"), F.coalesce("weight", F.lit(0.0)).alias("w"), F.lit(0).alias("kind"))
    rows = grid.select("strategy", "date", "symbol", "price", F.lit(None).cast("double").alias("w"), F.lit(1).alias("kind"))
    over = Window.partitionBy("strategy", "symbol").orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, 0)
    united = marks.unionByName(rows).select("*", F.last("w", ignorenulls=True).over(over).alias("target"))
    return united.filter("kind = 1").select("strategy", "date", "symbol", "price", "target")


def _changed(rows: DataFrame) -> DataFrame:
    """``flag`` where any target of a strategy moves, its first dated row included; rows before that go."""
    own = along("strategy", "symbol")
    moved = F.abs(F.col("target") - F.coalesce(F.lag("target").over(own), F.lit(0.0))) > 1e-12
    first = F.lag("target").over(own).isNull()
    rows = rows.filter("target IS NOT NULL").select("*", (moved | first).alias("moved"))
    return rows.select("*", F.max("moved").over(Window.partitionBy("strategy", "date")).alias("flag")).drop("moved")


#: A cost as a share of the value: of what is traded both ways, or of the array of trades.
Cost = Callable[[Column], Column]


def trade_cost(two_way: Column, commission_bps: float, spread_bps: float) -> Column:
    """Share of the value that trading ``two_way`` notional costs."""
    return (commission_bps + spread_bps / 2) / 1e4 * two_way


def square_root_impact(coefficient: float) -> Cost:
    """An impact model: each trade costs the coefficient times its size to the power of 1.5."""
    return lambda trades: F.aggregate(trades, F.lit(0.0), lambda s, x: s + coefficient * F.pow(F.abs(x), F.lit(1.5)))


def _held(panel: DataFrame, targets: DataFrame, mode: str | int | None) -> DataFrame:
    """(strategy, date, symbol, price, target, flag, base, held, worth, all_worth): what was held into each date since the last rebalance."""
    if "eff_date" in targets.columns:
        names = targets.select("strategy", "symbol").distinct()
        rows = _changed(as_of_weights(panel.join(names, "symbol"), targets))
    else:
        rows = panel.join(targets.withColumnRenamed("weight", "target"), "symbol").select("strategy", "date", "symbol", "price", "target")
        flags = rebalance_flags(rows.select("strategy", "date").distinct(), mode, "strategy")
        rows = rows.join(flags, ["strategy", "date"])
    day = Window.partitionBy("strategy", "date")
    before = along("strategy", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    base = lambda x: F.last(F.when(F.col("flag"), F.col(x)), ignorenulls=True).over(before)
    book = F.sum("target").over(day)
    refused = F.raise_error(F.concat(F.lit("weights have to add up to more than 0: "), "strategy", F.lit(" on "), F.col("date").cast("string")))
    rows = rows.withColumn("target", F.when(book > 1e-8, F.col("target")).otherwise(refused.cast("double")))
    rows = rows.select("*", base("price").alias("base"), base("target").alias("held"))
    rows = rows.select("*", (F.coalesce("held", F.lit(0.0)) * F.coalesce(F.try_divide(F.col("price"), F.col("base")), F.lit(0.0))).alias("worth"))
    return rows.select("*", F.sum("worth").over(day).alias("all_worth"))


def weight_history(panel: DataFrame, targets: DataFrame, mode: str | int | None = "M") -> DataFrame:
    """(strategy, date, symbol, weight) of static targets or a schedule: the target on a rebalance, else the share that it has drifted to."""
    rows = _held(panel, targets, mode)
    return rows.select("strategy", "date", "symbol", F.when(F.col("flag"), F.col("target")).otherwise(F.coalesce(F.try_divide("worth", "all_worth"), F.lit(0.0))).alias("weight"))


def summary(wealth: DataFrame, blotter: DataFrame, initial: float = 1.0) -> DataFrame:
    """(strategy, terminal_wealth, total_return, max_drawdown, rebalances, avg_turnover, cost_drag) of a simulation."""
    peak = F.max("value").over(so_far("strategy"))
    falls = wealth.select("strategy", "date", "value", (F.col("value") / peak - 1).alias("dd"))
    ends = falls.groupBy("strategy").agg(F.max_by("value", "date").alias("terminal_wealth"), F.min("dd").alias("max_drawdown"))
    costs = cost_drag(blotter).select("strategy", "rebalances", (F.col("turnover") / F.col("rebalances")).alias("avg_turnover"), "cost_drag")
    return ends.join(costs, "strategy").select("strategy", "terminal_wealth", (F.col("terminal_wealth") / initial - 1).alias("total_return"), "max_drawdown", "rebalances", "avg_turnover", "cost_drag")


def simulate(
    panel: DataFrame,
    targets: DataFrame,
    *,
    mode: str | int | None = "M",
    commission_bps: float = 0.0,
    spread_bps: float = 0.0,
    initial: float = 1.0,
    cash_drag: float = 0.0,
    cost_model: Cost | None = None,
    impact: Cost | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(wealth, blotter) of each strategy.

    ``targets``: (strategy, symbol, weight), or with ``eff_date`` a schedule, which then
    says when to rebalance. wealth: strategy, date, value, turnover. blotter: strategy,
    date, turnover, cost_frac of each rebalance. ``cost_model`` gives the cost of what is
    traded both ways in place of commission and spread; ``impact`` that of the array of
    trades on top of either. Targets of a date that don't add up to more than 0 make the
    query fail, as shares of such a book have no meaning.
    """
    rows = _held(panel, targets, mode)
    drifted = F.coalesce(F.try_divide("worth", "all_worth"), F.lit(0.0))
    daily = rows.groupBy("strategy", "date").agg(
        F.first("flag").alias("flag"),
        F.sum("worth").alias("v"),
        F.sum("held").alias("s"),
        F.sum(F.abs(F.col("target") - drifted)).alias("two_way"),
        *([F.collect_list(F.col("target") - drifted).alias("trades")] if impact else []),
    )
    order, past = along("strategy"), along("strategy").rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.select("*", F.coalesce(F.sum(F.col("flag").cast("int")).over(past), F.lit(0)).alias("segment"), F.row_number().over(order).alias("row"))
    v1 = F.first("v").over(Window.partitionBy("strategy", "segment").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    grown = F.when(F.col("row") == 1, 1.0).otherwise((1 + v1 - F.col("s")) * F.try_divide(F.col("v"), v1))
    paid_for = cost_model(F.col("two_way")) if cost_model else trade_cost(F.col("two_way"), commission_bps, spread_bps)
    cost = F.when(F.col("flag"), paid_for + (impact(F.col("trades")) if impact else F.lit(0.0))).otherwise(0.0)
    daily = daily.select("*", grown.alias("grown"), cost.alias("cost_frac"), F.when(F.col("flag"), F.col("two_way") / 2).otherwise(0.0).alias("turnover"))
    completed = F.coalesce(F.product(F.when(F.col("flag") & (F.col("row") > 1), F.col("grown")).otherwise(1.0)).over(past), F.lit(1.0))
    paid = F.product(1 - F.col("cost_frac")).over(so_far("strategy"))
    drag = F.pow(F.lit(1 - cash_drag / TRADING_DAYS), F.col("row") - 1)
    wealth = daily.select("strategy", "date", (initial * completed * F.col("grown") * paid * drag).alias("value"), "turnover")
    return wealth, daily.filter("flag").select("strategy", "date", "turnover", "cost_frac")


def cost_drag(blotter: DataFrame) -> DataFrame:
    return blotter.groupBy("strategy").agg((1 - F.product(1 - F.col("cost_frac"))).alias("cost_drag"), F.sum("turnover").alias("turnover"), F.count(F.lit(1)).alias("rebalances"))


def turnover(before: DataFrame, after: DataFrame) -> DataFrame:
    """one_way, two_way, buys and sells between two (strategy, symbol, weight) tables; missing is 0."""
    both = before.withColumnRenamed("weight", "was").join(after.withColumnRenamed("weight", "is"), ["strategy", "symbol"], "full_outer")
    move = F.coalesce("is", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))
    return both.select("strategy", move.alias("move")).groupBy("strategy").agg(
        (F.sum(F.abs("move")) / 2).alias("one_way"), F.sum(F.abs("move")).alias("two_way"), F.sum(F.greatest("move", F.lit(0.0))).alias("buys"), F.sum(F.greatest(-F.col("move"), F.lit(0.0))).alias("sells")
    )


def transition_cost(current: DataFrame, targets: DataFrame, *, bps: float = 10.0) -> DataFrame:
    """Cost of going from (symbol, weight) to each target strategy."""
    each = targets.select("strategy").distinct().join(current, F.lit(True)).select("strategy", "symbol", "weight")
    return turnover(each, targets).select("strategy", (F.col("one_way") * bps / 1e4).alias("cost"), "one_way")


def rebalance_trades(current: DataFrame, target: DataFrame, *, threshold: float = 0.0) -> DataFrame:
    """(symbol, before, after, delta, action); smaller moves than ``threshold`` are held."""
    both = current.withColumnRenamed("weight", "before").join(target.withColumnRenamed("weight", "after"), "symbol", "full_outer")
    rows = both.select("symbol", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    rows = rows.select("*", (F.col("after") - F.col("before")).alias("delta")).filter(F.abs("delta") > 1e-12)
    return rows.select("*", F.when(F.abs("delta") < threshold, "hold").when(F.col("delta") > 0, "buy").otherwise("sell").alias("action"))


def rebalance_plan(trades: DataFrame, *, commission_bps: float = 1.0, spread_bps: float = 5.0, cost_model: Cost | None = None) -> DataFrame:
    """(turnover, cost, executed, held) of ``rebalance_trades``: turnover of all moves, cost of what is executed."""
    size = F.abs("delta")
    done = F.coalesce(F.sum(F.when(F.col("action") != "hold", size)), F.lit(0.0))
    cost = cost_model(done) if cost_model else trade_cost(done, commission_bps, spread_bps)
    return trades.agg((F.coalesce(F.sum(size), F.lit(0.0)) / 2).alias("turnover"), cost.alias("cost"), F.count_if(F.col("action") != "hold").alias("executed"), F.count_if(F.col("action") == "hold").alias("held"))
