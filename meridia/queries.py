"""One query an operator over the given tables, with its SQL where SQL can say it."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.functions import metrics
from meridia.operators import assemblers, assets, engine, factors, moments, oos, optimize, planning, plotdata, recommend, series, shortfall, signals, simulate, strategies, validation
from meridia.plans import panel as P
from meridia.streaming.windows import windowed_prices

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without a negative zero, so that two engines give the same values."""
    return frame.select(*((F.round(F.col(n), digits) + 0.0).alias(n) if t == "double" else F.col(n) for n, t in frame.dtypes))


def query(name: str, keys: str = "", values: str = "", sql: str = "", digits: int = 6) -> Callable[[Query], Query]:
    """Registers a query. ``sql`` gives ``keys`` as they are and ``values`` to be rounded."""

    def register(f: Query) -> Query:
        names = [*keys.split(), *values.split()]
        QUERIES[name] = lambda spark, sf: rounded(f(spark, sf).select(*names) if names else f(spark, sf), digits)
        if sql:
            SQL[name] = f"SELECT {', '.join([*keys.split(), *(f'round({v}, {digits}) + 0.0 AS {v}' for v in values.split())])} FROM ({sql})"
        return f

    return register


def _returns(spark: SparkSession, sf: str, name: str = "week") -> DataFrame:
    return P.with_returns({"ship": P.ship_panel, "week": P.week_panel, "event": P.event_panel}[name](spark, sf))


def _with_bench(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly returns with those of the mean price of all orders as ``bench``."""
    bench = P.week_benchmark(spark, sf).select("date", F.lit("all").alias("k"), "bench")
    bench = bench.select("date", (F.try_divide("bench", F.lag("bench").over(P.along("k"))) - 1).alias("bench"))
    return _returns(spark, sf).join(bench, "date")


def _equal(panel: DataFrame, strategy: str = "equal") -> DataFrame:
    symbols = panel.select("symbol").distinct()
    return symbols.select(F.lit(strategy).alias("strategy"), "symbol", (1 / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).alias("weight"))


def _by_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Weights by each priority's share of all order value."""
    rows = P.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.sum("o_totalprice").alias("v"))
    return rows.select(F.lit("sales").alias("strategy"), "symbol", (F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(0)))).alias("weight"))


def _sectors(panel: DataFrame) -> DataFrame:
    return panel.select("symbol").distinct().select("symbol", F.when(F.col("symbol") < "3", "urgent").otherwise("other").alias("sector"))


WEEK, SHIP, EVENT = P.sql_panel("week"), P.sql_panel("ship"), P.sql_panel("event")
W = "PARTITION BY symbol ORDER BY date"
TO_NOW = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BENCH = """bm AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS b FROM orders GROUP BY 1),
br AS (SELECT date, b / lag(b) OVER (ORDER BY date) - 1 AS bench FROM bm),
rb AS (SELECT rets.*, br.bench FROM rets JOIN br ON br.date = rets.date)"""
EQUAL = "w AS (SELECT symbol, 1.0 / count(*) OVER () AS weight FROM (SELECT DISTINCT symbol FROM px))"
SALES = "sales AS (SELECT o_orderpriority AS symbol, sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders) AS weight FROM orders GROUP BY 1)"
COV = """cr AS (SELECT * FROM rets WHERE log_ret IS NOT NULL),
cov AS (SELECT a.symbol AS i, b.symbol AS j, covar_samp(a.log_ret, b.log_ret) * 252 AS cov, corr(a.log_ret, b.log_ret) AS corr FROM cr a JOIN cr b ON a.date = b.date GROUP BY 1, 2)"""


@query("simple_returns", "date symbol", "price ret log_ret", f"WITH {SHIP} SELECT * FROM rets")
def simple_returns(spark, sf):
    return _returns(spark, sf, "ship")


@query("growth_of_one", "date symbol", "growth", f"WITH {WEEK} SELECT date, symbol, price / first_value(price) OVER ({W}) AS growth FROM px")
def growth_of_one(spark, sf):
    return series.growth_of_one(P.week_panel(spark, sf), "symbol")


_DD = f"dd AS (SELECT date, symbol, price / max(price) OVER ({W} {TO_NOW}) - 1 AS dd FROM px)"


def _dd(spark, sf):
    return series.drawdown_curve(P.week_panel(spark, sf), "symbol", value="price")


@query("drawdown_curve", "date symbol", "dd", f"WITH {WEEK}, {_DD} SELECT * FROM dd")
def drawdown_curve(spark, sf):
    return _dd(spark, sf)


@query(
    "drawdown_episodes", "symbol episode peak_date trough_date recovery_date length", "depth",
    f"""WITH {WEEK}, {_DD},
l AS (SELECT *, lag(date) OVER ({W}) AS last, lag(dd) OVER ({W}) AS last_dd, lead(date) OVER ({W}) AS next FROM dd),
e AS (SELECT *, sum(CASE WHEN dd < 0 AND coalesce(last_dd, 0) >= 0 THEN 1 ELSE 0 END) OVER ({W} {TO_NOW}) AS episode FROM l)
SELECT symbol, CAST(episode AS BIGINT) AS episode, arg_min(last, date) AS peak_date, arg_min(date, (dd, date)) AS trough_date,
  (array_agg(next ORDER BY date DESC))[1] AS recovery_date, count(*) AS length, min(dd) AS depth FROM e WHERE dd < 0 GROUP BY 1, 2""",
)
def drawdown_episodes(spark, sf):
    return series.drawdown_episodes(_dd(spark, sf), "symbol")


@query("drawdown_stats", "symbol", "max_dd ulcer_pct pain", f"WITH {WEEK}, {_DD} SELECT symbol, min(dd) AS max_dd, sqrt(avg(pow(100 * dd, 2))) AS ulcer_pct, avg(abs(dd)) AS pain FROM dd GROUP BY 1")
def drawdown_stats(spark, sf):
    return series.drawdown_stats(_dd(spark, sf), "symbol")


_UW = f"""g AS (SELECT *, exp(sum(ln(1 + ret)) OVER ({W} {TO_NOW})) AS growth FROM rets WHERE ret IS NOT NULL),
uw AS (SELECT *, growth / greatest(1.0, max(growth) OVER ({W} {TO_NOW})) - 1 AS uw FROM g)"""
_SUMMARY = """SELECT symbol, count(ret) AS n_obs, pow(exp(sum(ln(1 + ret))), 252.0 / count(ret)) - 1 AS cagr, stddev_samp(ret) * sqrt(252) AS ann_vol,
  (avg(ret) - 0.02 / 252) / stddev_samp(ret) * sqrt(252) AS sharpe,
  (avg(ret) - 0.02 / 252) * 252 / (sqrt(sum(CASE WHEN ret < 0.02 / 252 THEN pow(ret - 0.02 / 252, 2) END) / count(ret)) * sqrt(252)) AS sortino,
  min(uw) AS max_drawdown, coalesce(avg(CASE WHEN uw < 0 THEN uw END), 0) AS avg_drawdown, sqrt(avg(uw * uw)) AS ulcer_index,
  (pow(exp(sum(ln(1 + ret))), 252.0 / count(ret)) - 1) / abs(min(uw)) AS calmar,
  sum(CASE WHEN ret > 0 THEN ret END) / -sum(CASE WHEN ret < 0 THEN ret END) AS omega, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
  avg(CASE WHEN ret > 0 THEN ret END) / abs(avg(CASE WHEN ret < 0 THEN ret END)) AS win_loss_ratio,
  abs(quantile_cont(ret, 0.95)) / abs(quantile_cont(ret, 0.05)) AS tail_ratio,
  sqrt(sum(CASE WHEN ret < 0 THEN ret * ret END) / count(ret)) * sqrt(252) AS downside_deviation, skewness(ret) AS skewness, kurtosis(ret) AS kurtosis"""
_SUMMARY_NAMES = "cagr ann_vol sharpe sortino max_drawdown avg_drawdown ulcer_index calmar omega hit_rate win_loss_ratio tail_ratio downside_deviation skewness kurtosis"


def _tail(name: str) -> str:
    return f"""tq AS (SELECT symbol, quantile_cont(ret, 0.05) AS q FROM {name} WHERE ret IS NOT NULL GROUP BY 1),
tail AS (SELECT r.symbol, -min(q) AS var, -avg(ret) AS cvar FROM {name} r JOIN tq ON tq.symbol = r.symbol WHERE ret <= q GROUP BY 1)"""


@query("summary_metrics", "symbol n_obs", f"{_SUMMARY_NAMES} var cvar", f"WITH {SHIP}, {_UW}, {_tail('uw')}, s AS ({_SUMMARY} FROM uw GROUP BY 1) SELECT s.*, var, cvar FROM s JOIN tail ON tail.symbol = s.symbol", digits=5)
def summary_metrics(spark, sf):
    return metrics.summary_metrics(_returns(spark, sf, "ship"), "symbol")


@query(
    "benchmark_metrics", "symbol n_obs", "tracking_error information_ratio",
    f"WITH {WEEK}, {BENCH} SELECT symbol, count(ret) AS n_obs, stddev_samp(ret - bench) * sqrt(252) AS tracking_error, avg(ret - bench) / stddev_samp(ret - bench) * sqrt(252) AS information_ratio FROM rb WHERE ret IS NOT NULL GROUP BY 1",
)
def benchmark_metrics(spark, sf):
    return metrics.summary_metrics(_with_bench(spark, sf), "symbol")


@query("tail_risk", "symbol", "var cvar", f"WITH {SHIP}, {_tail('rets')} SELECT * FROM tail")
def tail_risk(spark, sf):
    return metrics.expected_shortfall(_returns(spark, sf, "ship"), "symbol")


_REPORT = f"""gr AS (SELECT *, exp(sum(ln(1 + ret)) OVER ({W} {TO_NOW})) AS growth FROM rb WHERE ret IS NOT NULL),
gd AS (SELECT *, growth / max(growth) OVER ({W} {TO_NOW}) - 1 AS dd FROM gr)"""


@query(
    "report_metrics", "symbol", "ann_return ann_vol max_drawdown cagr calmar beta alpha",
    f"""WITH {WEEK}, {BENCH}, {_REPORT},
m AS (SELECT symbol, avg(ret) * 252 AS ann_return, stddev_samp(ret) * sqrt(252) AS ann_vol, min(dd) AS max_drawdown,
  pow(arg_max(growth, date), 1 / greatest(date_diff('day', min(date), max(date)) / 365.25, 1.0)) - 1 AS cagr, regr_slope(ret, bench) AS beta, regr_intercept(ret, bench) * 252 AS alpha FROM gd GROUP BY 1)
SELECT *, coalesce(cagr / nullif(abs(max_drawdown), 0), 0) AS calmar FROM m""",
)
def report_metrics(spark, sf):
    rows = _with_bench(spark, sf).filter("ret IS NOT NULL")
    return metrics.report_metrics(rows.select("*", F.product(1 + F.col("ret")).over(P.so_far("symbol")).alias("growth")), "symbol")


_ROLL = "ROWS BETWEEN 59 PRECEDING AND CURRENT ROW"


@query(
    "rolling_statistics", "date symbol", "roll_vol roll_sharpe",
    f"""WITH {SHIP}, r AS (SELECT date, symbol, CASE WHEN count(ret) OVER ({W} {_ROLL}) >= 60 THEN stddev_samp(ret) OVER ({W} {_ROLL}) END AS sd, avg(ret - 0.02 / 252) OVER ({W} {_ROLL}) AS m FROM rets)
SELECT date, symbol, sd * sqrt(252) AS roll_vol, m * 252 / (sd * sqrt(252)) AS roll_sharpe FROM r""",
)
def rolling_statistics(spark, sf):
    return series.rolling(_returns(spark, sf, "ship"), "symbol", window=60, rf=0.02)


@query("month_end_returns", "date symbol", "price ret", f"WITH {SHIP}, e AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS date, arg_max(price, px.date) AS price FROM px GROUP BY 1, 2) SELECT *, price / lag(price) OVER ({W}) - 1 AS ret FROM e")
def month_end_returns(spark, sf):
    return series.last_of_period(P.ship_panel(spark, sf), "symbol", period="month", value="price")


@query("year_end_returns", "date symbol", "price ret", f"WITH {SHIP}, e AS (SELECT symbol, CAST(date_trunc('year', date) AS DATE) AS date, arg_max(price, px.date) AS price FROM px GROUP BY 1, 2) SELECT *, price / lag(price) OVER ({W}) - 1 AS ret FROM e")
def year_end_returns(spark, sf):
    return series.last_of_period(P.ship_panel(spark, sf), "symbol", period="year", value="price")


_MONTHS = " ".join(f"m{i:02d}" for i in range(1, 13))


@query(
    "month_table", "symbol year", _MONTHS,
    f"WITH {WEEK} SELECT symbol, CAST(year(date) AS INT) AS year, {', '.join(f'exp(sum(ln(1 + ret)) FILTER (month(date) = {i})) - 1 AS m{i:02d}' for i in range(1, 13))} FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2",
)
def month_table(spark, sf):
    return series.month_table(_returns(spark, sf), "symbol")


@query(
    "capture_ratios", "symbol", "up_capture down_capture",
    f"""WITH {WEEK}, {BENCH}, c AS (SELECT symbol, exp(sum(ln(1 + ret)) FILTER (bench > 0)) - 1 AS ru, exp(sum(ln(1 + bench)) FILTER (bench > 0)) - 1 AS bu,
  exp(sum(ln(1 + ret)) FILTER (bench <= 0)) - 1 AS rd, exp(sum(ln(1 + bench)) FILTER (bench <= 0)) - 1 AS bd FROM rb WHERE ret IS NOT NULL AND bench IS NOT NULL GROUP BY 1)
SELECT symbol, CASE WHEN bu > 0 THEN ru / bu ELSE 0 END AS up_capture, CASE WHEN bd < 0 THEN rd / bd ELSE 0 END AS down_capture FROM c""",
)
def capture_ratios(spark, sf):
    return series.capture_ratios(_with_bench(spark, sf), "symbol")


def _moving(n: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("trailing_volatility", "date symbol", "vol", f"WITH {SHIP} SELECT date, symbol, CASE WHEN count(ret) {_moving(63)} >= 63 THEN stddev_samp(ret) {_moving(63)} * sqrt(252) END AS vol FROM rets")
def trailing_volatility(spark, sf):
    return signals.trailing_volatility(_returns(spark, sf, "ship"), method="simple")


@query(
    "ewma_volatility", "date symbol", "vol",
    f"""WITH {WEEK}, n AS (SELECT *, row_number() OVER ({W}) - 1 AS i FROM rets WHERE ret IS NOT NULL),
q AS (SELECT *, pow(1 - 2 / 21.0, -i) * CASE WHEN i = 0 THEN 1.0 ELSE 2 / 21.0 END AS q FROM n),
s AS (SELECT date, symbol, i, pow(1 - 2 / 21.0, i) AS b, sum(q * ret) OVER ({W} {TO_NOW}) AS s1, sum(q * ret * ret) OVER ({W} {TO_NOW}) AS s2, sum(q * q) OVER ({W} {TO_NOW}) AS q2 FROM q)
SELECT r.date, r.symbol, CASE WHEN i + 1 >= 20 THEN sqrt((b * s2 - pow(b * s1, 2)) / (1 - b * b * q2)) * sqrt(252) END AS vol FROM rets r LEFT JOIN s ON s.date = r.date AND s.symbol = r.symbol""",
)
def ewma_volatility(spark, sf):
    return signals.trailing_volatility(_returns(spark, sf), lookback=20)


@query("momentum_signal", "date symbol", "signal", f"WITH {WEEK} SELECT date, symbol, CAST(sign(lag(price, 4) OVER ({W}) / lag(price, 52) OVER ({W}) - 1) AS DOUBLE) AS signal FROM px")
def momentum_signal(spark, sf):
    return signals.momentum_signal(P.week_panel(spark, sf), lookback=52, skip=4)


def _sma(n: int) -> str:
    return f"CASE WHEN count(price) {_moving(n)} >= {n} THEN avg(price) {_moving(n)} END"


@query("crossover_signal", "date symbol", "signal", f"WITH {SHIP} SELECT date, symbol, CAST(sign({_sma(50)} - {_sma(200)}) AS DOUBLE) AS signal FROM px")
def crossover_signal(spark, sf):
    return signals.crossover_signal(P.ship_panel(spark, sf))


_PAST = f"past AS (SELECT date, symbol, lag(price, 4) OVER ({W}) / lag(price, 26) OVER ({W}) - 1 AS past FROM px)"


@query("momentum_score", "date symbol", "score", f"WITH {WEEK}, {_PAST} SELECT date, symbol, (past - avg(past) OVER (PARTITION BY date)) / nullif(stddev_samp(past) OVER (PARTITION BY date), 0) AS score FROM past")
def momentum_score(spark, sf):
    return signals.momentum_score(P.week_panel(spark, sf), lookback=26, skip=4)


@query("reversion_signal", "date symbol", "score", f"WITH {WEEK} SELECT date, symbol, CASE WHEN count(price) {_moving(20)} >= 20 THEN (price - avg(price) {_moving(20)}) / nullif(stddev_samp(price) {_moving(20)}, 0) END AS score FROM px")
def reversion_signal(spark, sf):
    return signals.reversion_signal(P.week_panel(spark, sf))


_POS = f"""sv AS (SELECT date, symbol, sign(lag(price, 4) OVER ({W}) / lag(price, 26) OVER ({W}) - 1) AS signal, CASE WHEN count(ret) {_moving(20)} >= 20 THEN stddev_samp(ret) {_moving(20)} * sqrt(252) END AS vol FROM rets),
p0 AS (SELECT date, symbol, signal * 0.1 / nullif(lag(vol) OVER ({W}), 0) AS p FROM sv),
pos AS (SELECT date, symbol, p * least(1.0, 2.0 / nullif(sum(abs(p)) OVER (PARTITION BY date), 0)) AS position FROM p0)"""


def _positions(spark, sf):
    sized = signals.momentum_signal(P.week_panel(spark, sf), lookback=26, skip=4)
    return signals.vol_target_positions(signals.trailing_volatility(P.with_returns(sized), lookback=20, method="simple"))


@query("vol_target_positions", "date symbol", "position", f"WITH {WEEK}, {_POS} SELECT * FROM pos")
def vol_target_positions(spark, sf):
    return _positions(spark, sf)


@query(
    "long_only_schedule", "date symbol", "weight",
    f"""WITH {WEEK}, {_POS}, c AS (SELECT date, symbol, greatest(position, 0) AS w, count(*) OVER (PARTITION BY date) AS n, count(position) OVER (PARTITION BY date) AS k FROM pos)
SELECT date, symbol, CASE WHEN sum(w) OVER (PARTITION BY date) > 0 THEN w / sum(w) OVER (PARTITION BY date) ELSE 1.0 / n END AS weight FROM c WHERE k = n""",
)
def long_only_schedule(spark, sf):
    return signals.long_only_schedule(_positions(spark, sf))


@query(
    "inverse_vol_weights", "symbol", "weight",
    f"""WITH {WEEK}, v AS (SELECT date, symbol, stddev_samp(ret) {_moving(20)} AS vol FROM rets), l AS (SELECT symbol, arg_max(vol, date) AS vol FROM v GROUP BY 1)
SELECT symbol, (1 / vol) / sum(1 / vol) OVER () AS weight FROM l""",
)
def inverse_vol_weights(spark, sf):
    return signals.inverse_vol_weights(signals.trailing_volatility(_returns(spark, sf), lookback=20, method="simple"))


@query(
    "bet_sizes", "symbol", "kelly cppi scalar",
    f"""WITH {WEEK}, m AS (SELECT symbol, avg(ret) AS m, var_samp(ret) AS v, arg_max(price, date) / arg_min(price, date) AS g FROM rets GROUP BY 1)
SELECT symbol, (m - 0.02 / 252) / v AS kelly, least(3 * greatest(0, g - 0.8) / g, 1) AS cppi, least(greatest(0.1 / (sqrt(v) * sqrt(252)), 0), 5) AS scalar FROM m""",
)
def bet_sizes(spark, sf):
    rows = _returns(spark, sf).groupBy("symbol").agg(F.avg("ret").alias("m"), F.var_samp("ret").alias("v"), (F.max_by("price", "date") / F.min_by("price", "date")).alias("g"))
    return rows.select("symbol", signals.kelly_fraction(F.col("m") - 0.02 / 252, F.col("v")).alias("kelly"), signals.cppi_risky_weight(F.lit(0.8), 3.0, F.col("g")).alias("cppi"), signals.target_vol_scalar(F.sqrt("v") * 252**0.5).alias("scalar"))


@query(
    "tilted_weights", "symbol", "weight",
    f"""WITH {WEEK}, {SALES}, s AS (SELECT symbol, greatest(avg(ret), 0) AS s FROM rets GROUP BY 1), t AS (SELECT sales.symbol, weight AS b, s / sum(s) OVER () AS s FROM sales JOIN s ON s.symbol = sales.symbol),
c AS (SELECT symbol, least(greatest(b + 0.3 * (s - b), 0), 1) AS w FROM t) SELECT symbol, w / sum(w) OVER () AS weight FROM c""",
)
def tilted_weights(spark, sf):
    scores = _returns(spark, sf).groupBy("symbol").agg(F.avg("ret").alias("score"))
    return signals.tilt_weights(_by_sales(spark, sf).drop("strategy"), scores, strength=0.3)


@query(
    "turnover", "strategy", "one_way two_way buys sells",
    f"WITH {WEEK}, {EQUAL}, {SALES}, m AS (SELECT sales.weight - w.weight AS d FROM w JOIN sales ON sales.symbol = w.symbol) SELECT 'x' AS strategy, sum(abs(d)) / 2 AS one_way, sum(abs(d)) AS two_way, sum(greatest(d, 0)) AS buys, sum(greatest(-d, 0)) AS sells FROM m",
)
def turnover(spark, sf):
    return engine.turnover(_equal(P.week_panel(spark, sf), "x"), _by_sales(spark, sf).withColumn("strategy", F.lit("x")))


@query(
    "transition_cost", "strategy", "cost one_way",
    f"WITH {WEEK}, {EQUAL}, {SALES}, m AS (SELECT sales.weight - w.weight AS d FROM w JOIN sales ON sales.symbol = w.symbol) SELECT 'sales' AS strategy, sum(abs(d)) / 2 * 10 / 1e4 AS cost, sum(abs(d)) / 2 AS one_way FROM m",
)
def transition_cost(spark, sf):
    return engine.transition_cost(_equal(P.week_panel(spark, sf)).drop("strategy"), _by_sales(spark, sf))


@query("rebalance_trades", "symbol action", "before after delta", f"WITH {WEEK}, {EQUAL}, {SALES} SELECT w.symbol, w.weight AS before, sales.weight AS after, sales.weight - w.weight AS delta, CASE WHEN abs(sales.weight - w.weight) < 0.001 THEN 'hold' WHEN sales.weight > w.weight THEN 'buy' ELSE 'sell' END AS action FROM w JOIN sales ON sales.symbol = w.symbol")
def rebalance_trades(spark, sf):
    return engine.rebalance_trades(_equal(P.week_panel(spark, sf)).drop("strategy"), _by_sales(spark, sf).drop("strategy"), threshold=0.001)


@query("rebalance_dates", "date", "", f"WITH {SHIP}, d AS (SELECT DISTINCT date FROM px), f AS (SELECT date, quarter(date) AS q, lag(quarter(date)) OVER (ORDER BY date) AS l FROM d) SELECT date FROM f WHERE l IS NULL OR q <> l")
def rebalance_dates(spark, sf):
    days = P.ship_panel(spark, sf).select(F.lit("all").alias("strategy"), "date").distinct()
    return engine.rebalance_flags(days, "Q", "strategy").filter("flag")


@query("buy_and_hold", "date", "value", f"WITH {WEEK}, {SALES}, g AS (SELECT date, px.symbol, price / first_value(price) OVER (PARTITION BY px.symbol ORDER BY date) AS g FROM px) SELECT date, sum(weight * g) AS value FROM g JOIN sales ON sales.symbol = g.symbol GROUP BY 1")
def buy_and_hold(spark, sf):
    return series.buy_and_hold(P.week_panel(spark, sf), _by_sales(spark, sf).drop("strategy"))


_SEGMENTS = f"""d AS (SELECT date, row_number() OVER (ORDER BY date) AS row, coalesce(month(date) <> lag(month(date)) OVER (ORDER BY date), true) AS flag FROM (SELECT DISTINCT date FROM px)),
sg AS (SELECT *, coalesce(sum(CASE WHEN flag THEN 1 ELSE 0 END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM d),
st AS (SELECT row_number() OVER (ORDER BY date) AS seg, date AS start FROM d WHERE flag),
pr AS (SELECT sg.date, sg.row, sg.flag, sg.seg, p.symbol, sales.weight AS w, p.price / b.price AS ratio FROM sg JOIN px p ON p.date = sg.date JOIN sales ON sales.symbol = p.symbol
  LEFT JOIN st ON st.seg = sg.seg LEFT JOIN px b ON b.date = st.start AND b.symbol = p.symbol),
v AS (SELECT date, row, flag, seg, coalesce(sum(w * ratio), 0) AS v FROM pr GROUP BY 1, 2, 3, 4),
tr AS (SELECT pr.date, sum(abs(pr.w - coalesce(pr.w * ratio / v.v, 0))) AS two_way FROM pr JOIN v ON v.date = pr.date GROUP BY 1),
f AS (SELECT v.date, v.row, v.flag, CASE WHEN v.row = 1 THEN 1.0 ELSE v.v END AS g, CASE WHEN v.flag THEN two_way * (1 + 5.0 / 2) / 1e4 ELSE 0 END AS cf, CASE WHEN v.flag THEN two_way / 2 ELSE 0 END AS turnover FROM v JOIN tr ON tr.date = v.date)"""


def _simulated(spark, sf):
    return engine.simulate(P.week_panel(spark, sf), _by_sales(spark, sf), mode="M", commission_bps=1.0, spread_bps=5.0, cash_drag=0.02)


@query(
    "rebalanced_wealth", "strategy date", "value turnover",
    f"""WITH {WEEK}, {SALES}, {_SEGMENTS}
SELECT 'sales' AS strategy, date, coalesce(exp(sum(ln(CASE WHEN flag AND row > 1 THEN g ELSE 1 END)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) * g
  * exp(sum(ln(1 - cf)) OVER (ORDER BY date {TO_NOW})) * pow(1 - 0.02 / 252, row - 1) AS value, turnover FROM f""",
)
def rebalanced_wealth(spark, sf):
    return _simulated(spark, sf)[0]


@query("rebalance_blotter", "strategy date", "turnover cost_frac", f"WITH {WEEK}, {SALES}, {_SEGMENTS} SELECT 'sales' AS strategy, date, turnover, cf AS cost_frac FROM f WHERE flag")
def rebalance_blotter(spark, sf):
    return _simulated(spark, sf)[1]


@query("cost_drag", "strategy rebalances", "cost_drag turnover", f"WITH {WEEK}, {SALES}, {_SEGMENTS} SELECT 'sales' AS strategy, count(*) AS rebalances, 1 - exp(sum(ln(1 - cf))) AS cost_drag, sum(turnover) AS turnover FROM f WHERE flag")
def cost_drag(spark, sf):
    return engine.cost_drag(_simulated(spark, sf)[1])


_FOLLOWED = f"""sch AS (SELECT date, symbol, CASE WHEN sum(w) OVER (PARTITION BY date) > 0 THEN w / sum(w) OVER (PARTITION BY date) ELSE 1.0 / n END AS weight
  FROM (SELECT date, symbol, greatest(position, 0) AS w, count(*) OVER (PARTITION BY date) AS n, count(position) OVER (PARTITION BY date) AS k FROM pos) WHERE k = n),
tg AS (SELECT px.date, px.symbol, price, last_value(weight IGNORE NULLS) OVER (PARTITION BY px.symbol ORDER BY px.date {TO_NOW}) AS target FROM px LEFT JOIN sch ON sch.date = px.date AND sch.symbol = px.symbol),
tt AS (SELECT *, lag(target) OVER ({W}) AS lt FROM tg WHERE target IS NOT NULL),
fl AS (SELECT date, bool_or(lt IS NULL OR abs(target - lt) > 1e-12) AS flag FROM tt GROUP BY 1),
dt AS (SELECT date, flag, row_number() OVER (ORDER BY date) AS row, max(CASE WHEN flag THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM fl),
pr AS (SELECT dt.date, row, flag, t.symbol, t.target, b.target AS w, t.price / b.price AS ratio FROM dt JOIN tt t ON t.date = dt.date LEFT JOIN tt b ON b.date = dt.base AND b.symbol = t.symbol),
v AS (SELECT date, row, flag, sum(w * ratio) AS v FROM pr GROUP BY 1, 2, 3),
tr AS (SELECT pr.date, sum(abs(pr.target - coalesce(pr.w * ratio / v.v, 0))) AS two_way FROM pr JOIN v ON v.date = pr.date GROUP BY 1),
f AS (SELECT v.date, v.row, v.flag, CASE WHEN v.row = 1 THEN 1.0 ELSE v.v END AS g, CASE WHEN v.flag THEN two_way * (1 + 5.0 / 2) / 1e4 ELSE 0 END AS cf, CASE WHEN v.flag THEN two_way / 2 ELSE 0 END AS turnover FROM v JOIN tr ON tr.date = v.date)"""


@query(
    "scheduled_wealth", "strategy date", "value turnover",
    f"""WITH {WEEK}, {_POS}, {_FOLLOWED}
SELECT 'momentum' AS strategy, date, coalesce(exp(sum(ln(CASE WHEN flag AND row > 1 THEN g ELSE 1 END)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) * g
  * exp(sum(ln(1 - cf)) OVER (ORDER BY date {TO_NOW})) AS value, turnover FROM f""",
)
def scheduled_wealth(spark, sf):
    """The long-only momentum schedule, followed with costs."""
    schedule = signals.long_only_schedule(_positions(spark, sf)).select(F.lit("momentum").alias("strategy"), F.col("date").alias("eff_date"), "symbol", "weight")
    return engine.simulate(P.week_panel(spark, sf), schedule, commission_bps=1.0, spread_bps=5.0)[0]


_EWMA = f"""en AS (SELECT *, row_number() OVER ({W}) - 1 AS i FROM rets WHERE ret IS NOT NULL),
eq AS (SELECT *, pow(1 - 2 / 21.0, -i) * CASE WHEN i = 0 THEN 1.0 ELSE 2 / 21.0 END AS q FROM en),
es AS (SELECT date, symbol, i, pow(1 - 2 / 21.0, i) AS b, sum(q * ret) OVER ({W} {TO_NOW}) AS s1, sum(q * ret * ret) OVER ({W} {TO_NOW}) AS s2, sum(q * q) OVER ({W} {TO_NOW}) AS q2 FROM eq),
ev AS (SELECT r.date, r.symbol, CASE WHEN i + 1 >= 20 THEN sqrt((b * s2 - pow(b * s1, 2)) / (1 - b * b * q2)) * sqrt(252) END AS vol FROM rets r LEFT JOIN es ON es.date = r.date AND es.symbol = r.symbol)"""


def _momentum_schedule(spark, sf) -> DataFrame:
    return signals.long_only_schedule(_positions(spark, sf)).withColumnRenamed("date", "eff_date")


@query(
    "overlay_schedule", "date symbol", "weight",
    f"""WITH {WEEK}, {_POS}, {_FOLLOWED}, {_EWMA}, op AS (SELECT tg.date, tg.symbol, target * 0.1 / nullif(lag(vol) OVER (PARTITION BY tg.symbol ORDER BY tg.date), 0) AS p FROM tg JOIN ev ON ev.date = tg.date AND ev.symbol = tg.symbol),
oq AS (SELECT date, symbol, p * least(1.0, 2.0 / nullif(sum(abs(p)) OVER (PARTITION BY date), 0)) AS position FROM op),
oc AS (SELECT date, symbol, greatest(position, 0) AS w, count(*) OVER (PARTITION BY date) AS n, count(position) OVER (PARTITION BY date) AS k FROM oq)
SELECT date, symbol, CASE WHEN sum(w) OVER (PARTITION BY date) > 0 THEN w / sum(w) OVER (PARTITION BY date) ELSE 1.0 / n END AS weight FROM oc WHERE k = n""",
)
def overlay_schedule(spark, sf):
    """The momentum schedule, tilted each day to symbols of low volatility."""
    return strategies.vol_overlay(lambda panel: _momentum_schedule(spark, sf), lookback=20)(P.week_panel(spark, sf)).withColumnRenamed("eff_date", "date")


_MANY = f"""tw AS (SELECT 'equal' AS strategy, symbol, weight FROM w UNION ALL SELECT 'sales', symbol, weight FROM sales),
d AS (SELECT date, row_number() OVER (ORDER BY date) AS row, coalesce(month(date) <> lag(month(date)) OVER (ORDER BY date), true) AS flag FROM (SELECT DISTINCT date FROM px)),
db AS (SELECT *, max(CASE WHEN flag THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM d),
pr AS (SELECT strategy, db.date, row, flag, p.symbol, weight AS w, p.price / b.price AS ratio FROM db JOIN px p ON p.date = db.date JOIN tw ON tw.symbol = p.symbol LEFT JOIN px b ON b.date = db.base AND b.symbol = p.symbol),
v AS (SELECT strategy, date, row, flag, sum(w * ratio) AS v FROM pr GROUP BY 1, 2, 3, 4),
tr AS (SELECT pr.strategy, pr.date, sum(abs(pr.w - coalesce(pr.w * ratio / v.v, 0))) AS two_way FROM pr JOIN v ON v.date = pr.date AND v.strategy = pr.strategy GROUP BY 1, 2),
f AS (SELECT v.strategy, v.date, v.row, v.flag, CASE WHEN v.row = 1 THEN 1.0 ELSE v.v END AS g, CASE WHEN v.flag THEN two_way * (1 + 5.0 / 2) / 1e4 ELSE 0 END AS cf FROM v JOIN tr ON tr.date = v.date AND tr.strategy = v.strategy),
wealth AS (SELECT strategy, date, coalesce(exp(sum(ln(CASE WHEN flag AND row > 1 THEN g ELSE 1 END)) OVER (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) * g
  * exp(sum(ln(1 - cf)) OVER (PARTITION BY strategy ORDER BY date {TO_NOW})) AS value FROM f)"""


def _two(spark, sf):
    """The strategies equal and sales."""
    return _equal(P.week_panel(spark, sf)).unionByName(_by_sales(spark, sf))


def _backtest(spark, sf):
    of = {r: _two(spark, sf).filter(F.col("strategy") == r).drop("strategy") for r in ("equal", "sales")}
    return strategies.backtest({k: (lambda panel, v=v: v) for k, v in of.items()}, P.week_panel(spark, sf), commission_bps=1.0, spread_bps=5.0)


@query("backtest_of_many", "strategy date", "value", f"WITH {WEEK}, {EQUAL}, {SALES}, {_MANY} SELECT * FROM wealth")
def backtest_of_many(spark, sf):
    return _backtest(spark, sf).wealth


@query(
    "backtest_metrics", "strategy n_obs", "cagr ann_vol sharpe",
    f"""WITH {WEEK}, {EQUAL}, {SALES}, {_MANY}, r AS (SELECT strategy, value / lag(value) OVER (PARTITION BY strategy ORDER BY date) - 1 AS ret FROM wealth)
SELECT strategy, count(ret) AS n_obs, pow(exp(sum(ln(1 + ret))), 252.0 / count(ret)) - 1 AS cagr, stddev_samp(ret) * sqrt(252) AS ann_vol, (avg(ret) - 0.02 / 252) / stddev_samp(ret) * sqrt(252) AS sharpe FROM r GROUP BY 1""",
)
def backtest_metrics(spark, sf):
    return _backtest(spark, sf).metrics()


@query(
    "scheduled_weights", "strategy date symbol", "weight",
    f"WITH {WEEK}, {_POS}, {_FOLLOWED} SELECT 'momentum' AS strategy, pr.date, symbol, CASE WHEN pr.flag THEN target ELSE w * ratio / v.v END AS weight FROM pr JOIN v ON v.date = pr.date",
)
def scheduled_weights(spark, sf):
    """Shares of the momentum schedule as they drift between its changes."""
    return engine.weight_history(P.week_panel(spark, sf), _momentum_schedule(spark, sf).select(F.lit("momentum").alias("strategy"), "eff_date", "symbol", "weight"))


@query(
    "backtest_summary", "strategy rebalances", "terminal_wealth total_return max_drawdown avg_turnover cost_drag",
    f"""WITH {WEEK}, {EQUAL}, {SALES}, {_MANY}, wd AS (SELECT strategy, date, value, value / max(value) OVER (PARTITION BY strategy ORDER BY date {TO_NOW}) - 1 AS dd FROM wealth),
a AS (SELECT strategy, arg_max(value, date) AS terminal_wealth, min(dd) AS max_drawdown FROM wd GROUP BY 1),
c AS (SELECT f.strategy, count(*) AS rebalances, avg(two_way / 2) AS avg_turnover, 1 - exp(sum(ln(1 - cf))) AS cost_drag FROM f JOIN tr ON tr.date = f.date AND tr.strategy = f.strategy WHERE flag GROUP BY 1)
SELECT a.*, terminal_wealth - 1 AS total_return, rebalances, avg_turnover, cost_drag FROM a JOIN c ON c.strategy = a.strategy""",
)
def backtest_summary(spark, sf):
    return _backtest(spark, sf).summary()


@query("strategy_backtests", "strategy n_obs", "cagr ann_vol sharpe max_drawdown")
def strategy_backtests(spark, sf):
    """Every strategy of the library at once; solvers and schedules are beyond SQL."""
    panel = P.week_panel(spark, sf)
    of = {m: strategies.solved(m) for m in optimize.METHODS} | {
        "inverse_vol": strategies.inverse_vol(lookback=20),
        "trend": strategies.trend_following(momentum=(26, 4), average=(5, 20), vol_lookback=20),
        "momentum": strategies.cross_sectional_momentum(lookback=26, skip=4, vol_lookback=20),
        "overlay": strategies.vol_overlay(lambda p: _by_sales(spark, sf).drop("strategy"), lookback=20),
    }
    return strategies.backtest(of, panel, commission_bps=1.0, spread_bps=5.0).metrics()


@query(
    "weight_history", "strategy date symbol place", "weight",
    f"""WITH {WEEK}, {SALES}, d AS (SELECT date, coalesce(month(date) <> lag(month(date)) OVER (ORDER BY date), true) AS flag FROM (SELECT DISTINCT date FROM px)),
b AS (SELECT date, max(CASE WHEN flag THEN date END) OVER (ORDER BY date {TO_NOW}) AS base FROM d),
x AS (SELECT b.date, p.symbol, sales.weight * p.price / q.price AS worth FROM b JOIN px p ON p.date = b.date JOIN px q ON q.date = b.base AND q.symbol = p.symbol JOIN sales ON sales.symbol = p.symbol),
y AS (SELECT date, symbol, worth / sum(worth) OVER (PARTITION BY date) AS weight FROM x), z AS (SELECT symbol, CAST(row_number() OVER (ORDER BY avg(weight) DESC, symbol) AS INT) AS place FROM y GROUP BY 1)
SELECT 'sales' AS strategy, date, y.symbol, place, weight FROM y JOIN z ON z.symbol = y.symbol""",
)
def weight_history(spark, sf):
    return assemblers.weights_over_time(P.week_panel(spark, sf), _by_sales(spark, sf))


@query(
    "rebalance_plan", "executed held", "turnover cost",
    f"WITH {WEEK}, {EQUAL}, {SALES}, m AS (SELECT abs(sales.weight - w.weight) AS d FROM w JOIN sales ON sales.symbol = w.symbol) SELECT count(*) FILTER (d >= 0.002) AS executed, count(*) FILTER (d < 0.002) AS held, sum(d) / 2 AS turnover, coalesce(sum(d) FILTER (d >= 0.002), 0) * 3.5 / 1e4 AS cost FROM m WHERE d > 1e-12",
    digits=9,
)
def rebalance_plan(spark, sf):
    return engine.rebalance_plan(engine.rebalance_trades(_equal(P.week_panel(spark, sf)).drop("strategy"), _by_sales(spark, sf).drop("strategy"), threshold=0.002))


@query(
    "vol_target_portfolio", "date symbol", "position",
    f"""WITH {WEEK}, {_POS}, tot AS (SELECT *, sum(abs(signal) * vol) OVER (PARTITION BY date) AS total FROM sv), pp AS (SELECT date, symbol, signal * 0.1 / nullif(lag(total) OVER ({W}), 0) AS p FROM tot)
SELECT date, symbol, p * least(1.0, 2.0 / nullif(sum(abs(p)) OVER (PARTITION BY date), 0)) AS position FROM pp""",
)
def vol_target_portfolio(spark, sf):
    sized = signals.momentum_signal(P.week_panel(spark, sf), lookback=26, skip=4)
    return signals.vol_target_positions(signals.trailing_volatility(P.with_returns(sized), lookback=20, method="simple"), scaling="portfolio")


@query("annual_returns", "symbol", "annual", f"WITH {WEEK}, a AS (SELECT symbol, date, sqrt(price / lag(price, 104) OVER ({W})) - 1 AS annual FROM px) SELECT symbol, arg_max(annual, date) AS annual FROM a GROUP BY 1")
def annual_returns(spark, sf):
    return series.trailing_annual_return(P.week_panel(spark, sf), "symbol", years=2, periods=52)


@query("date_gaps", "symbol days periods", "", f"WITH {WEEK}, g AS (SELECT symbol, date_diff('day', lag(date) OVER ({W}), date) AS g FROM px) SELECT symbol, CAST(mode(g) AS INT) AS days, CAST(CASE WHEN mode(g) >= 28 THEN 12 ELSE 252 END AS INT) AS periods FROM g GROUP BY 1")
def date_gaps(spark, sf):
    return factors.typical_gap(P.week_panel(spark, sf), "symbol")


@query("covariance", "i j", "cov corr", f"WITH {WEEK}, {COV} SELECT * FROM cov")
def covariance(spark, sf):
    return moments.covariance(_returns(spark, sf))


@query(
    "shrunk_covariance", "i j", "cov delta",
    f"""WITH {WEEK}, c AS (SELECT date, symbol, ret - avg(ret) OVER (PARTITION BY symbol) AS x FROM rets WHERE ret IS NOT NULL),
m AS (SELECT a.symbol AS i, b.symbol AS j, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS q, avg(a.x * a.x * a.x * b.x) AS c, avg(a.x * b.x * b.x * b.x) AS c2, avg(a.x * a.x) AS si, avg(b.x * b.x) AS sj, count(*) AS t FROM c a JOIN c b ON a.date = b.date GROUP BY 1, 2),
r AS (SELECT avg(s / sqrt(si * sj)) AS rbar FROM m WHERE i <> j),
f AS (SELECT *, CASE WHEN i = j THEN s ELSE rbar * sqrt(si * sj) END AS f, q - s * s AS pi,
  CASE WHEN i = j THEN q - s * s ELSE rbar / 2 * (sqrt(sj / si) * (c - si * s) + sqrt(si / sj) * (c2 - sj * s)) END AS rho FROM m CROSS JOIN r),
d AS (SELECT least(greatest((sum(pi) - sum(rho)) / sum(pow(f - s, 2)) / max(t), 0), 1) AS delta FROM f)
SELECT i, j, 252 * (delta * f + (1 - delta) * s) AS cov, delta FROM f CROSS JOIN d""",
)
def shrunk_covariance(spark, sf):
    return moments.shrunk_covariance(_returns(spark, sf))


@query(
    "identity_shrinkage", "i j", "cov delta",
    f"""WITH {WEEK}, c AS (SELECT date, symbol, ret - avg(ret) OVER (PARTITION BY symbol) AS x FROM rets WHERE ret IS NOT NULL),
m AS (SELECT a.symbol AS i, b.symbol AS j, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS q, count(*) AS t FROM c a JOIN c b ON a.date = b.date GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN i = j THEN (SELECT avg(s) FROM m WHERE i = j) ELSE 0 END AS f FROM m),
d AS (SELECT least(greatest(sum(q - s * s) / sum(pow(f - s, 2)) / max(t), 0), 1) AS delta FROM f)
SELECT i, j, 252 * (delta * f + (1 - delta) * s) AS cov, delta FROM f CROSS JOIN d""",
)
def identity_shrinkage(spark, sf):
    return moments.shrunk_covariance(_returns(spark, sf), target="identity")


_PAIRS = """pm AS (SELECT a.symbol AS i, b.symbol AS j, avg(a.log_ret) * 252 AS mi, avg(b.log_ret) * 252 AS mj, var_samp(a.log_ret) * 252 AS sii, var_samp(b.log_ret) * 252 AS sjj, covar_samp(a.log_ret, b.log_ret) * 252 AS sij
  FROM rets a JOIN rets b ON a.date = b.date AND a.symbol < b.symbol WHERE a.log_ret IS NOT NULL AND b.log_ret IS NOT NULL GROUP BY 1, 2)"""


@query(
    "two_asset_portfolios", "pair strategy symbol", "weight",
    f"""WITH {WEEK}, {_PAIRS}, x AS (SELECT i, j, unnest([{{'strategy': 'equal_weight', 'w': 0.5}}, {{'strategy': 'min_variance', 'w': least(greatest((sjj - sij) / (sii + sjj - 2 * sij), 0), 1)}},
  {{'strategy': 'risk_parity', 'w': sqrt(sjj) / (sqrt(sii) + sqrt(sjj))}}, {{'strategy': 'max_diversification', 'w': sqrt(sjj) / (sqrt(sii) + sqrt(sjj))}}, {{'strategy': 'hrp', 'w': sjj / (sii + sjj)}}]) AS u FROM pm)
SELECT i || '/' || j AS pair, u.strategy AS strategy, i AS symbol, u.w AS weight FROM x UNION ALL SELECT i || '/' || j, u.strategy, j, 1 - u.w FROM x""",
    digits=4,
)
def two_asset_portfolios(spark, sf):
    """Each pair of symbols by the methods that have a closed form for two."""
    return optimize.optimized(_paired(spark, sf), "pair", ["equal_weight", "min_variance", "risk_parity", "max_diversification", "hrp"])


def _paired(spark, sf) -> DataFrame:
    """Returns of each pair of symbols, which ``pair`` names."""
    returns = _returns(spark, sf)
    symbols = returns.select("symbol").distinct()
    pairs = symbols.join(symbols.withColumnRenamed("symbol", "other"), F.col("symbol") < F.col("other"))
    named = pairs.select(F.concat_ws("/", "symbol", "other").alias("pair"), F.explode(F.array("symbol", "other")).alias("symbol"))
    return returns.join(named, "symbol")


_ONE_PAIR = "pr AS (SELECT * FROM pm WHERE i = '1-URGENT' AND j = '2-HIGH')"


def _pair(spark, sf):
    return _returns(spark, sf).filter("symbol IN ('1-URGENT', '2-HIGH')")


@query(
    "efficient_frontier", "symbol", "target vol weight",
    f"""WITH {WEEK}, {_PAIRS}, {_ONE_PAIR}, q AS (SELECT *, least(mi, mj) + 0.1 * abs(mi - mj) AS a, 1.2 * (least(mi, mj) + 0.9 * abs(mi - mj)) AS b FROM pr),
t AS (SELECT *, a + k * (b - a) / 49 AS target FROM q CROSS JOIN (SELECT unnest(range(50)) AS k)), w AS (SELECT *, (target - mj) / (mi - mj) AS w FROM t WHERE target BETWEEN least(mi, mj) - 1e-12 AND greatest(mi, mj) + 1e-12),
v AS (SELECT *, sqrt(w * w * sii + (1 - w) * (1 - w) * sjj + 2 * w * (1 - w) * sij) AS vol FROM w) SELECT i AS symbol, target, vol, w AS weight FROM v UNION ALL SELECT j, target, vol, 1 - w FROM v""",
    digits=5,
)
def efficient_frontier(spark, sf):
    return optimize.frontier(_pair(spark, sf))


@query("frontier_corners")
def frontier_corners(spark, sf):
    return optimize.corners(_returns(spark, sf))


@query("frontier_of_all")
def frontier_of_all(spark, sf):
    return optimize.frontier(_returns(spark, sf))


@query(
    "five_asset_portfolios", "strategy symbol", "weight",
    f"""WITH RECURSIVE {WEEK}, {COV}, cl AS (SELECT i, list(cov ORDER BY j) AS row FROM cov GROUP BY 1),
cm AS (SELECT list(row ORDER BY i) AS c, list(i ORDER BY i) AS names, (SELECT list(sqrt(cov) ORDER BY i) FROM cov WHERE i = j) AS sd, (SELECT list(m ORDER BY symbol) FROM (SELECT symbol, avg(log_ret) * 252 AS m FROM rets GROUP BY 1)) AS mu FROM cl),
goals AS (SELECT c, names, unnest([{{'strategy': 'min_variance', 'b': list_transform(sd, lambda x: 1.0::DOUBLE)}}, {{'strategy': 'max_sharpe', 'b': list_transform(mu, lambda x: x - 0.02)}}, {{'strategy': 'max_diversification', 'b': sd}}, {{'strategy': 'risk_parity', 'b': list_transform(sd, lambda x: 0.2::DOUBLE)}}]) AS g FROM cm),
it AS (SELECT g.strategy AS strategy, names, c, g.b AS b, list_transform(names, lambda x: 1.0::DOUBLE) AS y, 0 AS k FROM goals
  UNION ALL SELECT strategy, names, c, b, list_transform(range(1, len(b) + 1), lambda i: CASE WHEN strategy = 'risk_parity' THEN sqrt(y[i] * b[i] / list_sum(list_transform(range(1, len(b) + 1), lambda j: c[i][j] * y[j])))
    ELSE y[i] * (b[i] + sqrt(b[i] * b[i] + 4 * list_sum(list_transform(range(1, len(b) + 1), lambda j: greatest(c[i][j], 0) * y[j])) * list_sum(list_transform(range(1, len(b) + 1), lambda j: greatest(-c[i][j], 0) * y[j]))))
      / (2 * list_sum(list_transform(range(1, len(b) + 1), lambda j: greatest(c[i][j], 0) * y[j]))) END), k + 1 FROM it WHERE k < 2000)
SELECT strategy, names[i] AS symbol, y[i] / list_sum(y) AS weight FROM it CROSS JOIN (SELECT unnest(range(1, 6)) AS i) WHERE k = 2000""",
    digits=5,
)
def five_asset_portfolios(spark, sf):
    """All five symbols at once; SQL iterates multiplicative updates, which have the same fixed points."""
    methods = ["min_variance", "max_sharpe", "max_diversification", "risk_parity"]
    return optimize.optimized(_returns(spark, sf).withColumn("market", F.lit("orders")), "market", methods)


@query(
    "two_asset_sharpe", "pair symbol", "weight",
    f"""WITH {WEEK}, {_PAIRS}, e AS (SELECT *, mi - 0.02 AS ei, mj - 0.02 AS ej FROM pm),
c AS (SELECT *, unnest([0.0::DOUBLE, 1.0::DOUBLE, least(greatest((ei * sjj - ej * sij) / (ei * sjj + ej * sii - (ei + ej) * sij), 0), 1)]) AS w FROM e),
b AS (SELECT i, j, arg_max(w, (w * ei + (1 - w) * ej) / sqrt(w * w * sii + (1 - w) * (1 - w) * sjj + 2 * w * (1 - w) * sij)) AS w FROM c GROUP BY 1, 2)
SELECT i || '/' || j AS pair, i AS symbol, w AS weight FROM b UNION ALL SELECT i || '/' || j, j, 1 - w FROM b""",
    digits=5,
)
def two_asset_sharpe(spark, sf):
    """Each pair of symbols at its best Sharpe ratio: one program each, the closed form in SQL."""
    return optimize.optimized(_paired(spark, sf), "pair", ["max_sharpe"])


@query(
    "two_asset_tracking", "symbol", "weight tracking_error",
    f"""WITH {WEEK}, {BENCH}, p AS (SELECT a.date, a.ret AS a, b.ret AS b, a.bench FROM rb a JOIN rb b ON a.date = b.date WHERE a.symbol = '1-URGENT' AND b.symbol = '2-HIGH' AND a.ret IS NOT NULL AND b.ret IS NOT NULL AND a.bench IS NOT NULL),
w AS (SELECT least(greatest(covar_samp(a - b, bench - b) / var_samp(a - b), 0), 1) AS w FROM p),
t AS (SELECT w, stddev_samp(w * a + (1 - w) * b - bench) * sqrt(252) AS te FROM p CROSS JOIN w GROUP BY 1)
SELECT '1-URGENT' AS symbol, w AS weight, te AS tracking_error FROM t UNION ALL SELECT '2-HIGH', 1 - w, te FROM t""",
    digits=5,
)
def two_asset_tracking(spark, sf):
    """The pair's weights that are nearest to the mean price of all orders."""
    rows = _with_bench(spark, sf)
    return optimize.tracking(rows.filter("symbol IN ('1-URGENT', '2-HIGH')"), rows.select("date", "bench").distinct())


@query("tracking_weights")
def tracking_weights(spark, sf):
    rows = _with_bench(spark, sf)
    return optimize.tracking(rows, rows.select("date", "bench").distinct())


@query(
    "risk_budgets", "symbol", "weight share",
    f"""WITH {WEEK}, {_PAIRS}, {_ONE_PAIR}, r AS (SELECT *, ((0.7 - 0.5) * sij - 0.7 * sjj + sqrt(sii * sjj) * sqrt(0.04 * sij * sij / (sii * sjj) + 0.7 * 0.3)) / (0.3 * sii - 0.7 * sjj + 2 * 0.2 * sij) AS w FROM pr)
SELECT i AS symbol, w AS weight, 0.7 AS share FROM r UNION ALL SELECT j, 1 - w, 0.3 FROM r""",
)
def risk_budgets(spark, sf):
    return optimize.budgeted(_pair(spark, sf), {"1-URGENT": 0.7, "2-HIGH": 0.3})


@query(
    "posterior_returns", "symbol", "prior posterior",
    f"""WITH {WEEK}, {COV}, {SALES}, pi AS (SELECT cov.i AS symbol, 2.5 * sum(cov * weight) AS prior FROM cov JOIN sales ON sales.symbol = cov.j GROUP BY 1),
p AS (SELECT symbol, CASE symbol WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN -1.0 ELSE 0.0 END AS p FROM sales),
sp AS (SELECT cov.i AS symbol, sum(cov * p) AS sp FROM cov JOIN p ON p.symbol = cov.j GROUP BY 1),
g AS (SELECT (0.02 - sum(p * prior)) / (sum(p * sp) * (1 + 1 / 0.5)) AS gain FROM p JOIN pi ON pi.symbol = p.symbol JOIN sp ON sp.symbol = p.symbol)
SELECT pi.symbol, prior, prior + sp * gain AS posterior FROM pi JOIN sp ON sp.symbol = pi.symbol CROSS JOIN g""",
)
def posterior_returns(spark, sf):
    """One relative view at half confidence."""
    return optimize.posterior(moments.covariance(_returns(spark, sf)), _by_sales(spark, sf).drop("strategy"), [({"1-URGENT": 1.0, "2-HIGH": -1.0}, 0.02, 0.5)])


@query(
    "recommended_weights", "symbol", "weight",
    f"WITH {SALES} SELECT symbol, CASE WHEN symbol = '4-NOT SPECIFIED' THEN 0.0 WHEN symbol < '3' THEN 0.35 / 2 ELSE (0.9 - 0.35) / 2 END AS weight FROM sales",
    digits=5,
)
def recommended_weights(spark, sf):
    """Nearest to equal weights within a profile: 10 % cash, a symbol excluded, and a sector of two at its cap of 35 %; the other two share the rest."""
    panel = P.week_panel(spark, sf)
    profile = planning.Profile(max_weight=0.275, liquidity_floor=0.1, sector_caps={"urgent": 0.35}, excluded=("4-NOT SPECIFIED",))
    return recommend.recommend_weights(panel, method="equal_weight", profile=profile, sectors=_sectors(panel))


@query(
    "portfolio_cvar", "strategy", "var cvar cvar_annual",
    f"""WITH {WEEK}, {SALES}, p AS (SELECT date, sum(weight * ret) AS ret FROM rets JOIN sales ON sales.symbol = rets.symbol WHERE ret IS NOT NULL GROUP BY 1), q AS (SELECT quantile_cont(ret, 0.05) AS q FROM p)
SELECT 'sales' AS strategy, -min(q) AS var, -avg(ret) AS cvar, -avg(ret) * sqrt(252) AS cvar_annual FROM p CROSS JOIN q WHERE ret <= q""",
)
def portfolio_cvar(spark, sf):
    return moments.portfolio_shortfall(_returns(spark, sf), _by_sales(spark, sf))


@query(
    "realized_risk", "strategy", "vol max_drawdown ann_return",
    f"""WITH {WEEK}, {COV}, {SALES}, vo AS (SELECT sqrt(sum(a.weight * b.weight * cov)) AS vol FROM cov JOIN sales a ON a.symbol = cov.i JOIN sales b ON b.symbol = cov.j),
g AS (SELECT date, px.symbol, price / first_value(price) OVER (PARTITION BY px.symbol ORDER BY date) AS g FROM px), bh AS (SELECT date, sum(weight * g) AS value FROM g JOIN sales ON sales.symbol = g.symbol GROUP BY 1),
bd AS (SELECT *, value / max(value) OVER (ORDER BY date {TO_NOW}) - 1 AS dd, value / lag(value) OVER (ORDER BY date) - 1 AS ret FROM bh)
SELECT 'sales' AS strategy, min(vol) AS vol, min(dd) AS max_drawdown, pow(exp(sum(ln(1 + ret))), 252.0 / count(ret)) - 1 AS ann_return FROM bd CROSS JOIN vo""",
)
def realized_risk(spark, sf):
    return recommend.realized(P.week_panel(spark, sf), _by_sales(spark, sf).drop("strategy"), "sales")


@query(
    "least_shortfall", "symbol", "weight shortfall",
    f"""WITH {WEEK}, p AS (SELECT a.date, a.ret AS a, b.ret AS b FROM rets a JOIN rets b ON a.date = b.date WHERE a.symbol = '1-URGENT' AND b.symbol = '2-HIGH' AND a.ret IS NOT NULL AND b.ret IS NOT NULL),
k AS (SELECT CAST(floor((count(*) - 1) * (1 - 0.95::DOUBLE)) AS BIGINT) + 1 AS k FROM p),
g AS (SELECT unnest(range(1001)) / 1000.0::DOUBLE AS w), gv AS (SELECT w, w * a + (1 - w) * b AS r FROM g CROSS JOIN p),
gs AS (SELECT w, -avg(r) AS f FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY r) AS i FROM gv) CROSS JOIN k WHERE i <= k GROUP BY 1),
o AS (SELECT arg_min(w, f) AS w FROM gs),
t AS (SELECT (y.b - x.b) / ((x.a - x.b) - (y.a - y.b)) AS w FROM p x JOIN p y ON x.date < y.date WHERE (x.a - x.b) <> (y.a - y.b)),
c AS (SELECT DISTINCT t.w FROM t CROSS JOIN o WHERE t.w BETWEEN greatest(o.w - 0.001, 0) AND least(o.w + 0.001, 1) UNION SELECT w FROM g WHERE w IN (0, 1)),
cv AS (SELECT w, w * a + (1 - w) * b AS r FROM c CROSS JOIN p),
cs AS (SELECT w, -avg(r) AS f FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY r) AS i FROM cv) CROSS JOIN k WHERE i <= k GROUP BY 1),
m AS (SELECT arg_min(w, f) AS w, min(f) AS f FROM cs) SELECT '1-URGENT' AS symbol, w AS weight, f AS shortfall FROM m UNION ALL SELECT '2-HIGH', 1 - w, f FROM m""",
    digits=5,
)
def least_shortfall(spark, sf):
    """Two symbols; SQL scans weights, then all of those near the best one where two dates change places."""
    return shortfall.min_shortfall(_pair(spark, sf))


@query("least_shortfall_of_all")
def least_shortfall_of_all(spark, sf):
    return shortfall.min_shortfall(_returns(spark, sf))


@query("sector_allocation", "strategy sector", "weight", f"WITH {SALES} SELECT 'sales' AS strategy, CASE WHEN symbol < '3' THEN 'urgent' ELSE 'other' END AS sector, sum(weight) AS weight FROM sales WHERE weight > 0.001 GROUP BY 2")
def sector_allocation(spark, sf):
    return plotdata.sector_allocation(_by_sales(spark, sf), _sectors(P.week_panel(spark, sf)))


@query("cap_weights", "symbol", "cap weight", f"WITH {SALES}, k AS (SELECT symbol, CASE WHEN symbol < '4' THEN weight * 100 END AS cap FROM sales), c AS (SELECT symbol, coalesce(cap, avg(cap) OVER ()) AS cap FROM k) SELECT symbol, cap, cap / sum(cap) OVER () AS weight FROM c")
def cap_weights(spark, sf):
    """Capitalisations of some symbols are known; the others count as the mean."""
    known = _by_sales(spark, sf).filter("symbol < '4'").select("symbol", (F.col("weight") * 100).alias("cap"))
    caps = assets.market_caps(_by_sales(spark, sf), known)
    return caps.join(moments.market_weights(caps), "symbol")


_PARTS = "parts AS (SELECT cov.i AS symbol, sum(a.weight * b.weight * cov) AS part FROM cov JOIN sales a ON a.symbol = cov.i JOIN sales b ON b.symbol = cov.j GROUP BY 1)"


@query("risk_contributions", "strategy symbol", "share", f"WITH {WEEK}, {COV}, {SALES}, {_PARTS} SELECT 'sales' AS strategy, symbol, part / sum(part) OVER () AS share FROM parts")
def risk_contributions(spark, sf):
    return moments.risk_contributions(_by_sales(spark, sf), moments.covariance(_returns(spark, sf)))


@query("sector_risk", "strategy sector", "share", f"WITH {WEEK}, {COV}, {SALES}, {_PARTS} SELECT 'sales' AS strategy, CASE WHEN symbol < '3' THEN 'urgent' ELSE 'other' END AS sector, sum(part) / (SELECT sum(part) FROM parts) AS share FROM parts GROUP BY 2")
def sector_risk(spark, sf):
    return plotdata.sector_risk(moments.risk_contributions(_by_sales(spark, sf), moments.covariance(_returns(spark, sf))), _sectors(P.week_panel(spark, sf)))


@query("forecast_volatility", "strategy", "vol", f"WITH {WEEK}, {COV}, {SALES}, {_PARTS} SELECT 'sales' AS strategy, sqrt(sum(part)) AS vol FROM parts")
def forecast_volatility(spark, sf):
    return moments.forecast_vol(_by_sales(spark, sf), moments.covariance(_returns(spark, sf)))


@query("equilibrium_returns", "symbol", "pi", f"WITH {WEEK}, {COV}, {SALES} SELECT cov.i AS symbol, 2.5 * sum(cov * weight) AS pi FROM cov JOIN sales ON sales.symbol = cov.j GROUP BY 1")
def equilibrium_returns(spark, sf):
    return moments.equilibrium_returns(_by_sales(spark, sf).drop("strategy"), moments.covariance(_returns(spark, sf)))


@query(
    "brinson_attribution", "sector", "wp wb rp rb allocation selection interaction",
    f"""WITH {WEEK}, {EQUAL}, {SALES}, c AS (SELECT symbol, exp(sum(ln(1 + coalesce(ret, 0)))) - 1 AS r FROM rets GROUP BY 1),
s AS (SELECT CASE WHEN c.symbol < '3' THEN 'urgent' ELSE 'other' END AS sector, sum(sales.weight) AS wp, sum(w.weight) AS wb, sum(sales.weight * r) AS cp, sum(w.weight * r) AS cb FROM c JOIN w ON w.symbol = c.symbol JOIN sales ON sales.symbol = c.symbol GROUP BY 1),
p AS (SELECT sector, wp, wb, cp / wp AS rp, cb / wb AS rb, (wp - wb) * (cb / wb - sum(cb) OVER ()) AS allocation, wb * (cp / wp - cb / wb) AS selection, (wp - wb) * (cp / wp - cb / wb) AS interaction FROM s)
SELECT * FROM p UNION ALL SELECT 'Total', sum(wp), sum(wb), sum(wp * rp), sum(wb * rb), sum(allocation), sum(selection), sum(interaction) FROM p""",
)
def brinson_attribution(spark, sf):
    panel = P.week_panel(spark, sf)
    return factors.brinson(_by_sales(spark, sf).drop("strategy"), _equal(panel).drop("strategy"), P.with_returns(panel), _sectors(panel))


def _excess(spark, sf):
    return _with_bench(spark, sf).filter("ret IS NOT NULL AND bench IS NOT NULL").select("date", "symbol", (F.col("ret") - 0.02 / 252).alias("y"), (F.col("bench") - 0.02 / 252).alias("mkt"))


_EX = f"ex AS (SELECT date, symbol, ret - 0.02 / 252 AS y, bench - 0.02 / 252 AS mkt FROM rb WHERE ret IS NOT NULL AND bench IS NOT NULL)"


@query("factor_regression", "symbol n", "alpha beta_mkt r2", f"WITH {WEEK}, {BENCH}, {_EX} SELECT symbol, count(*) AS n, regr_intercept(y, mkt) AS alpha, regr_slope(y, mkt) AS beta_mkt, regr_r2(y, mkt) AS r2 FROM ex GROUP BY 1")
def factor_regression(spark, sf):
    return factors.regression(_excess(spark, sf), "symbol", x=["mkt"])


@query(
    "factor_inference", "symbol n", "adj_r2 t_alpha t_mkt",
    f"""WITH {WEEK}, {BENCH}, {_EX}, r AS (SELECT symbol, count(*) AS n, regr_intercept(y, mkt) AS a, regr_slope(y, mkt) AS b, regr_r2(y, mkt) AS r2, regr_sxx(y, mkt) AS sxx, regr_syy(y, mkt) AS syy, avg(mkt) AS m FROM ex GROUP BY 1),
s AS (SELECT *, sqrt((1 - r2) * syy / (n - 2)) AS s FROM r) SELECT symbol, n, 1 - (1 - r2) * (n - 1) / (n - 2) AS adj_r2, a / (s * sqrt(1.0 / n + m * m / sxx)) AS t_alpha, b / (s / sqrt(sxx)) AS t_mkt FROM s""",
)
def factor_inference(spark, sf):
    return factors.regression(_excess(spark, sf), "symbol", x=["mkt"])


@query(
    "factor_contributions", "date symbol", "part_mkt explained unexplained",
    f"WITH {WEEK}, {BENCH}, {_EX}, b AS (SELECT symbol, regr_intercept(y, mkt) AS a, regr_slope(y, mkt) AS b FROM ex GROUP BY 1) SELECT date, ex.symbol, b * mkt AS part_mkt, a + b * mkt AS explained, y - a - b * mkt AS unexplained FROM ex JOIN b ON b.symbol = ex.symbol",
)
def factor_contributions(spark, sf):
    rows = _excess(spark, sf)
    return factors.contributions(rows, factors.regression(rows, "symbol", x=["mkt"]), "symbol", x=["mkt"])


_BETAS = f"""bw AS (SELECT date, symbol, count(*) OVER b AS n, covar_pop(y, mkt) OVER b / nullif(var_pop(mkt) OVER b, 0) AS beta FROM ex WINDOW b AS ({W} ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)),
betas AS (SELECT date, symbol, CASE WHEN n >= 52 THEN beta END AS beta FROM bw)"""


@query("rolling_beta", "date symbol", "beta", f"WITH {WEEK}, {BENCH}, {_EX}, {_BETAS} SELECT * FROM betas")
def rolling_beta(spark, sf):
    return factors.rolling_beta(_excess(spark, sf), "symbol", x="mkt", window=52)


@query("style_drift", "symbol", "first last drift relative", f"WITH {WEEK}, {BENCH}, {_EX}, {_BETAS}, f AS (SELECT symbol, arg_min(beta, date) AS first, arg_max(beta, date) AS last FROM betas WHERE beta IS NOT NULL GROUP BY 1) SELECT *, last - first AS drift, (last - first) / abs(first) AS relative FROM f")
def style_drift(spark, sf):
    return factors.style_drift(factors.rolling_beta(_excess(spark, sf), "symbol", x="mkt", window=52), "symbol")


@query("neutralized_returns", "date symbol", "residual", f"WITH {WEEK}, {BENCH}, {_EX}, b AS (SELECT symbol, regr_intercept(y, mkt) AS a, regr_slope(y, mkt) AS b FROM ex GROUP BY 1) SELECT date, ex.symbol, y - a - b * mkt AS residual FROM ex JOIN b ON b.symbol = ex.symbol")
def neutralized_returns(spark, sf):
    return factors.neutralized(_excess(spark, sf), "symbol", x=["mkt"])


@query(
    "rolling_regression", "symbol date", "beta_mkt beta_last",
    f"""WITH {WEEK}, {BENCH}, {_EX}, e2 AS (SELECT *, lag(mkt) OVER ({W}) AS last FROM ex), e3 AS (SELECT * FROM e2 WHERE last IS NOT NULL),
c AS (SELECT symbol, date, count(*) OVER b AS n, var_pop(mkt) OVER b AS a, var_pop(last) OVER b AS d, covar_pop(mkt, last) OVER b AS m, covar_pop(y, mkt) OVER b AS p, covar_pop(y, last) OVER b AS q FROM e3 WINDOW b AS ({W} ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING))
SELECT symbol, date, (p * d - q * m) / (a * d - m * m) AS beta_mkt, (q * a - p * m) / (a * d - m * m) AS beta_last FROM c WHERE n >= 52""",
)
def rolling_regression(spark, sf):
    """Two factors: the benchmark and its last move."""
    rows = _excess(spark, sf)
    rows = rows.select("*", F.lag("mkt").over(P.along("symbol")).alias("last")).na.drop()
    return factors.rolling_regression(rows, "symbol", x=["mkt", "last"], window=52)


@query("factor_regimes", "factor regime", "compound", f"WITH {WEEK}, o AS (SELECT symbol AS factor, ret, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM rets WHERE ret IS NOT NULL), c AS (SELECT factor, exp(sum(ln(1 + ret))) - 1 AS compound FROM o WHERE k <= 63 GROUP BY 1) SELECT *, CASE WHEN compound > 0 THEN 'up' ELSE 'down' END AS regime FROM c")
def factor_regimes(spark, sf):
    return factors.regimes(_returns(spark, sf).withColumnRenamed("symbol", "factor"))


@query(
    "asset_analytics", "symbol", "total_return ann_return ann_vol sharpe sortino beta alpha",
    f"""WITH {WEEK}, {BENCH}, a AS (SELECT symbol, exp(sum(ln(1 + ret))) - 1 AS total_return, pow(exp(sum(ln(1 + ret))), 252.0 / count(ret)) - 1 AS ann_return, stddev_samp(ret) * sqrt(252) AS ann_vol,
  stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS down, covar_samp(ret, bench) / var_samp(bench) AS beta, pow(exp(sum(ln(1 + bench))), 252.0 / count(bench)) - 1 AS br FROM rb WHERE ret IS NOT NULL GROUP BY 1)
SELECT symbol, total_return, ann_return, ann_vol, (ann_return - 0.02) / ann_vol AS sharpe, (ann_return - 0.02) / down AS sortino, beta, (ann_return - 0.02) - beta * (br - 0.02) AS alpha FROM a""",
)
def asset_analytics(spark, sf):
    return factors.asset_analytics(_with_bench(spark, sf))


_CDF = """CASE WHEN abs({z}) <= 5 THEN 0.5 + sign({z}) * (abs({z}) / 600) * (1 + exp(-{z} * {z} / 2) + list_sum(list_transform(range(1, 200), lambda i: CASE WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END * exp(-pow(i * {z} / 200, 2) / 2)))) / sqrt(2 * pi())
  ELSE CASE WHEN {z} > 0 THEN 1.0 ELSE 0.0 END END"""
_MOMENTS = """mo AS (SELECT symbol, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sr, avg(pow(ret - m, 3)) / pow(avg(pow(ret - m, 2)), 1.5) AS g3, avg(pow(ret - m, 4)) / pow(avg(pow(ret - m, 2)), 2) AS g4
  FROM (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS m FROM rets WHERE ret IS NOT NULL) GROUP BY 1),
vf AS (SELECT *, 1 - g3 * sr + (g4 - 1) / 4 * sr * sr AS vf FROM mo)"""


@query(
    "sharpe_probabilities", "symbol n", "sharpe psr dsr",
    f"""WITH {WEEK}, {_MOMENTS}, z AS (SELECT symbol, n, sr * sqrt(252) AS sharpe, sr * sqrt(n - 1) / sqrt(vf) AS a, (sr - {oos.expected_max_sharpe(5, 1.0)!r} * sqrt(vf / (n - 1))) / sqrt(vf / (n - 1)) AS b FROM vf)
SELECT symbol, n, sharpe, {_CDF.format(z="a")} AS psr, {_CDF.format(z="b")} AS dsr FROM z""",
)
def sharpe_probabilities(spark, sf):
    return oos.sharpe_probabilities(_returns(spark, sf), "symbol", n_trials=5)


@query("track_record_length", "symbol", "min_track_record", f"WITH {WEEK}, {_MOMENTS} SELECT symbol, CASE WHEN sr > 0 THEN 1 + vf * pow(1.6448536269514715 / sr, 2) END AS min_track_record FROM vf", digits=3)
def track_record_length(spark, sf):
    return oos.track_record_length(_returns(spark, sf), "symbol")


@query(
    "sharpe_differences", "one two", "p_value",
    f"""WITH {WEEK}, r AS (SELECT * FROM rets WHERE ret IS NOT NULL), p AS (SELECT a.symbol AS one, b.symbol AS two, count(*) AS n, avg(a.ret) / stddev_samp(a.ret) AS sa, avg(b.ret) / stddev_samp(b.ret) AS sb, corr(a.ret, b.ret) AS rho FROM r a JOIN r b ON a.date = b.date AND a.symbol < b.symbol GROUP BY 1, 2),
z AS (SELECT one, two, abs(sa - sb) / sqrt((2 - 2 * rho + 0.5 * (sa * sa + sb * sb - 2 * sa * sb * rho * rho)) / n) AS z FROM p) SELECT one, two, 2 * (1 - ({_CDF.format(z="z")})) AS p_value FROM z""",
)
def sharpe_differences(spark, sf):
    return oos.sharpe_differences(_returns(spark, sf).withColumnRenamed("symbol", "strategy"))


_CSCV = """t AS (SELECT symbol AS config, ret, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS t FROM rets WHERE ret IS NOT NULL),
b AS (SELECT config, CAST(floor(t / sz) AS INT) AS block, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM t CROSS JOIN (SELECT floor((max(t) + 1) / 16) AS sz FROM t) WHERE t < sz * 16 GROUP BY 1, 2),
m AS (SELECT range AS split FROM range(65536) WHERE bit_count(range) = 8),
h AS (SELECT split, config, (split >> block) & 1 AS inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM b CROSS JOIN m GROUP BY 1, 2, 3),
sp AS (SELECT split, config, max(CASE WHEN inside = 1 THEN s / n / sqrt((q - s * s / n) / (n - 1)) * sqrt(252) END) AS is_sharpe, max(CASE WHEN inside = 0 THEN s / n / sqrt((q - s * s / n) / (n - 1)) * sqrt(252) END) AS oos_sharpe FROM h GROUP BY 1, 2)"""


def _splits(spark, sf):
    rows = _returns(spark, sf).filter("ret IS NOT NULL")
    return oos.cscv_splits(rows.select((F.row_number().over(P.along("symbol")) - 1).alias("t"), F.col("symbol").alias("config"), "ret"))


@query("cscv_splits", "split config", "is_sharpe oos_sharpe", f"WITH {WEEK}, {_CSCV} SELECT * FROM sp")
def cscv_splits(spark, sf):
    return _splits(spark, sf)


@query(
    "overfitting_probability", "splits", "pbo slope oos_loss",
    f"""WITH {WEEK}, {_CSCV}, k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY is_sharpe DESC, config) AS best, rank() OVER (PARTITION BY split ORDER BY oos_sharpe) AS rk, count(*) OVER (PARTITION BY split) AS n FROM sp)
SELECT count(*) AS splits, avg(CASE WHEN rk / (n + 1.0) <= 0.5 THEN 1.0 ELSE 0.0 END) AS pbo, regr_slope(oos_sharpe, is_sharpe) AS slope, avg(CASE WHEN oos_sharpe < 0 THEN 1.0 ELSE 0.0 END) AS oos_loss FROM k WHERE best = 1""",
)
def overfitting_probability(spark, sf):
    return oos.overfitting_probability(_splits(spark, sf))


@query(
    "overfitting_assessment", "best splits verdict", "pbo slope oos_loss psr dsr",
    f"""WITH {WEEK}, {_CSCV}, {_MOMENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY is_sharpe DESC, config) AS best, rank() OVER (PARTITION BY split ORDER BY oos_sharpe) AS rk, count(*) OVER (PARTITION BY split) AS n FROM sp),
o AS (SELECT count(*) AS splits, avg(CASE WHEN rk / (n + 1.0) <= 0.5 THEN 1.0 ELSE 0.0 END) AS pbo, regr_slope(oos_sharpe, is_sharpe) AS slope, avg(CASE WHEN oos_sharpe < 0 THEN 1.0 ELSE 0.0 END) AS oos_loss FROM k WHERE best = 1),
z AS (SELECT symbol AS best, sr * sqrt(n - 1) / sqrt(vf) AS a, (sr - {oos.expected_max_sharpe(5, 1.0)!r} * sqrt(vf / (n - 1))) / sqrt(vf / (n - 1)) AS b FROM vf ORDER BY sr DESC, symbol LIMIT 1),
x AS (SELECT best, {_CDF.format(z="a")} AS psr, {_CDF.format(z="b")} AS dsr FROM z)
SELECT best, splits, pbo, slope, oos_loss, psr, dsr, CASE WHEN pbo > 0.5 THEN 'likely_overfit' WHEN pbo <= 0.1 AND dsr >= 0.95 THEN 'robust' ELSE 'caution' END AS verdict FROM o CROSS JOIN x""",
)
def overfitting_assessment(spark, sf):
    return validation.assessed(_returns(spark, sf).select("date", F.col("symbol").alias("config"), "ret"))


@query(
    "strategy_comparison", "strategy n rank winner", "sharpe dsr",
    f"""WITH {WEEK}, {_MOMENTS}, z AS (SELECT symbol, n, sr * sqrt(252) AS sharpe, (sr - {oos.expected_max_sharpe(5, 1.0)!r} * sqrt(vf / (n - 1))) / sqrt(vf / (n - 1)) AS b FROM vf), x AS (SELECT symbol, n, sharpe, {_CDF.format(z="b")} AS dsr FROM z),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY dsr DESC, symbol) AS INT) AS rank FROM x) SELECT symbol AS strategy, n, rank, rank = 1 AS winner, sharpe, dsr FROM r""",
)
def strategy_comparison(spark, sf):
    return planning.compared(_returns(spark, sf).withColumnRenamed("symbol", "strategy"))


_SPLITS = f"""tw AS (SELECT 'equal' AS strategy, symbol, weight FROM w UNION ALL SELECT 'sales', symbol, weight FROM sales),
sd AS (SELECT *, CASE WHEN date <= DATE '1996-01-01' THEN 'train' ELSE 'test' END AS split FROM px),
sg AS (SELECT strategy, split, date, sum(weight * g) AS v FROM (SELECT date, split, symbol, price / first_value(price) OVER (PARTITION BY split, symbol ORDER BY date) AS g FROM sd) x JOIN tw ON tw.symbol = x.symbol GROUP BY 1, 2, 3),
sr AS (SELECT *, v / lag(v) OVER (PARTITION BY strategy, split ORDER BY date) - 1 AS ret FROM sg),
su AS (SELECT *, v / greatest(1.0, max(v) OVER (PARTITION BY strategy, split ORDER BY date {TO_NOW})) - 1 AS uw FROM sr WHERE ret IS NOT NULL),
sm AS (SELECT strategy, split, count(*) AS n, pow(exp(sum(ln(1 + ret))), 252.0 / count(*)) - 1 AS cagr, stddev_samp(ret) * sqrt(252) AS ann_vol, (avg(ret) - 0.02 / 252) / stddev_samp(ret) * sqrt(252) AS sharpe, min(uw) AS max_drawdown FROM su GROUP BY 1, 2)"""


def _split(spark, sf):
    return validation.split_metrics(P.week_panel(spark, sf), _two(spark, sf), datetime.date(1996, 1, 1))


@query("train_and_test", "strategy split n", "cagr ann_vol sharpe max_drawdown", f"WITH {WEEK}, {EQUAL}, {SALES}, {_SPLITS} SELECT * FROM sm")
def train_and_test(spark, sf):
    return _split(spark, sf)


@query(
    "overfitting_scores", "strategy", "sharpe_lost cagr_lost",
    f"""WITH {WEEK}, {EQUAL}, {SALES}, {_SPLITS} SELECT a.strategy, CASE WHEN a.sharpe > 0 THEN greatest(0, (a.sharpe - b.sharpe) / a.sharpe) ELSE 0 END AS sharpe_lost, CASE WHEN a.cagr > 0 THEN greatest(0, (a.cagr - b.cagr) / a.cagr) ELSE 0 END AS cagr_lost
FROM sm a JOIN sm b ON a.strategy = b.strategy WHERE a.split = 'train' AND b.split = 'test'""",
)
def overfitting_scores(spark, sf):
    return validation.overfitting_scores(_split(spark, sf))


@query(
    "return_distribution", "symbol bin n", "start",
    f"""WITH {SHIP}, q AS (SELECT symbol, quantile_cont(ret, 0.01) AS low, quantile_cont(ret, 0.99) AS high FROM rets GROUP BY 1), x AS (SELECT r.symbol, low, (high - low) / 50 AS width, ret FROM rets r JOIN q ON q.symbol = r.symbol WHERE ret BETWEEN low AND high),
b AS (SELECT *, least(CAST(floor((ret - low) / width) AS INT), 49) AS bin FROM x) SELECT symbol, bin, count(*) AS n, min(low + bin * width) AS start FROM b GROUP BY 1, 2""",
)
def return_distribution(spark, sf):
    return plotdata.distribution(_returns(spark, sf, "ship"), "symbol")


_UNIT = "(('0x' || substr(md5('42:{k}:' || sim || ':' || day), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE"


@query(
    "simulated_paths", "day", "p05 p25 p50 p75 p95",
    f"""WITH {SHIP}, pm AS (SELECT avg(r) * 252 AS mu, stddev_samp(r) * sqrt(252) AS vol FROM (SELECT date, avg(log_ret) AS r FROM rets WHERE log_ret IS NOT NULL GROUP BY 1)),
st AS (SELECT sim, day, CASE WHEN day = 0 THEN 0 ELSE mu / 252 - vol * vol / 504 + vol / sqrt(252) * sqrt(-2 * ln({_UNIT.format(k=1)})) * cos(2 * pi() * {_UNIT.format(k=2)}) END AS x FROM (SELECT unnest(range(1000)) AS sim) CROSS JOIN (SELECT unnest(range(253)) AS day) CROSS JOIN pm),
pv AS (SELECT day, 10000 * exp(sum(x) OVER (PARTITION BY sim ORDER BY day)) AS value FROM st)
SELECT CAST(day AS INT) AS day, {', '.join(f'quantile_cont(value, {q}) AS p{int(q * 100):02d}' for q in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM pv GROUP BY 1""",
    digits=3,
)
def simulated_paths(spark, sf):
    """A thousand years at the return and volatility of the equally weighted daily panel."""
    daily = _returns(spark, sf, "ship").filter("log_ret IS NOT NULL").groupBy("date").agg(F.avg("log_ret").alias("r"))
    row = daily.agg((F.avg("r") * 252).alias("mu"), (F.stddev_samp("r") * 252**0.5).alias("vol")).first()
    return simulate.bands(simulate.paths(spark, row.mu, row.vol))


def _paths(spark, sf):
    """A path a user: 1000 and a tenth of the running sum of (value - 50) of all of its events, in order."""
    rows = P.read(spark, sf, "events").select(F.col("user_id").alias("sim_id"), "event_id", "value")
    order = Window.partitionBy("sim_id").orderBy("event_id")
    return rows.select("sim_id", (F.row_number().over(order) - 1).alias("day"), (1000 + F.sum(F.col("value") - 50).over(order.rowsBetween(Window.unboundedPreceding, 0)) / 10).alias("value"))


_PATHS = """pt AS (SELECT user_id AS sim_id, row_number() OVER w - 1 AS day, 1000 + sum(value - 50) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 10 AS value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
en AS (SELECT sim_id, arg_max(value, day) / arg_min(value, day) - 1 AS ret FROM pt GROUP BY 1)"""


@query("simulation_metrics", "", "mean median var cvar p5 p95", f"WITH {_PATHS}, q AS (SELECT quantile_cont(ret, 0.05) AS q FROM en) SELECT avg(ret) AS mean, median(ret) AS median, min(q) AS var, avg(CASE WHEN ret <= q THEN ret END) AS cvar, quantile_cont(ret, 0.05) AS p5, quantile_cont(ret, 0.95) AS p95 FROM en CROSS JOIN q")
def simulation_metrics(spark, sf):
    return simulate.simulation_metrics(simulate.terminal_returns(_paths(spark, sf)))


@query("success_probabilities", "", "threshold prob", f"WITH {_PATHS}, t AS (SELECT unnest([0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.50])::DOUBLE AS threshold) SELECT threshold, avg(CASE WHEN ret > threshold THEN 1.0 ELSE 0.0 END) AS prob FROM en CROSS JOIN t GROUP BY 1")
def success_probabilities(spark, sf):
    return simulate.success_probabilities(simulate.terminal_returns(_paths(spark, sf)))


@query("time_to_target", "", "median_day share", f"WITH {_PATHS}, f AS (SELECT sim_id, min(CASE WHEN value >= 1000 * 1.01 THEN day END) AS day FROM pt GROUP BY 1) SELECT median(day) AS median_day, avg(CASE WHEN day IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share FROM f")
def time_to_target(spark, sf):
    return simulate.time_to_target(_paths(spark, sf), target=0.01, initial=1000.0)


@query("path_bands", "day", "p05 p25 p50 p75 p95", f"WITH {_PATHS} SELECT CAST(day AS INT) AS day, {', '.join(f'quantile_cont(value, {q}) AS p{int(q * 100):02d}' for q in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM pt GROUP BY 1")
def path_bands(spark, sf):
    return simulate.bands(_paths(spark, sf))


@query(
    "survival_curve", "", "threshold prob",
    f"WITH {_PATHS}, s AS (SELECT min(ret) AS low, (max(ret) - min(ret)) / 99 AS step FROM en), g AS (SELECT unnest(range(100)) AS k) SELECT low + k * step AS threshold, avg(CASE WHEN ceil((ret - low) / step) > k THEN 1.0 ELSE 0.0 END) AS prob FROM en CROSS JOIN s CROSS JOIN g GROUP BY k, low, step",
)
def survival_curve(spark, sf):
    return plotdata.survival(simulate.terminal_returns(_paths(spark, sf)))


@query("weight_alerts", "kind subject severity", "value allowed", f"WITH {SALES}, a AS (SELECT 'weight' AS kind, symbol AS subject, weight AS value, 0.2 AS allowed FROM sales UNION ALL SELECT 'sector', 'urgent', sum(weight), 0.35 FROM sales WHERE symbol < '3') SELECT kind, subject, value, CAST(allowed AS DOUBLE) AS allowed, CASE WHEN value > allowed THEN 'breach' ELSE 'warning' END AS severity FROM a WHERE value >= 0.9 * allowed")
def weight_alerts(spark, sf):
    return planning.weight_alerts(_by_sales(spark, sf).drop("strategy"), max_weight=0.2, sectors=_sectors(P.week_panel(spark, sf)), sector_caps={"urgent": 0.35})


@query("suitability", "check_name passed", "observed", f"WITH {SALES} SELECT 'concentration' AS check_name, max(weight) <= 0.4 AS passed, max(weight) AS observed FROM sales UNION ALL SELECT 'exclusions', true, 0.0 UNION ALL SELECT 'liquidity', 1 - sum(weight) >= -1e-9, 1 - sum(weight) FROM sales")
def suitability(spark, sf):
    return planning.suitability(_by_sales(spark, sf).drop("strategy"), planning.Profile()).withColumnRenamed("check", "check_name")


@query("strategy_ranking", "symbol rank", "sharpe", f"WITH {WEEK}, s AS (SELECT symbol, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe FROM rets GROUP BY 1) SELECT symbol, CAST(row_number() OVER (ORDER BY sharpe DESC NULLS LAST, symbol) AS INT) AS rank, sharpe FROM s")
def strategy_ranking(spark, sf):
    return planning.ranking(_returns(spark, sf).groupBy("symbol").agg(metrics.sharpe().alias("sharpe")), "symbol")


_WINDOWS = f"wi AS (SELECT row_number() OVER (ORDER BY train_start) AS window_id, CAST(train_start AS DATE) AS train_start FROM (SELECT unnest(generate_series(min(date), max(date) - 455, INTERVAL 90 DAY)) AS train_start FROM px))"


@query("walk_forward_windows", "window_id train_start train_end test_start test_end", "", f"WITH {WEEK}, {_WINDOWS} SELECT CAST(window_id AS INT) AS window_id, train_start, train_start + 365 AS train_end, train_start + 366 AS test_start, train_start + 455 AS test_end FROM wi")
def walk_forward_windows(spark, sf):
    return planning.walk_forward_windows(P.week_panel(spark, sf).select("date"))


@query("walk_forward_sharpe", "window_id symbol", "sharpe", f"WITH {WEEK}, {_WINDOWS} SELECT CAST(window_id AS INT) AS window_id, symbol, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe FROM rets JOIN wi ON date BETWEEN train_start + 366 AND train_start + 455 GROUP BY 1, 2")
def walk_forward_sharpe(spark, sf):
    returns = _returns(spark, sf)
    inside = planning.in_windows(returns, planning.walk_forward_windows(returns.select("date")))
    return inside.groupBy("window_id", "symbol").agg(metrics.sharpe().alias("sharpe"))


_ROLLED = f"""tw AS (SELECT 'equal' AS strategy, symbol, weight FROM w UNION ALL SELECT 'sales', symbol, weight FROM sales),
pt AS (SELECT window_id, 'train' AS part, px.* FROM px JOIN wi ON date BETWEEN train_start AND train_start + 365 UNION ALL SELECT window_id, 'test', px.* FROM px JOIN wi ON date BETWEEN train_start + 366 AND train_start + 455),
pg AS (SELECT window_id, part, date, symbol, price / first_value(price) OVER (PARTITION BY window_id, part, symbol ORDER BY date) AS g FROM pt),
pv AS (SELECT window_id, part, strategy, date, sum(weight * g) AS v FROM pg JOIN tw ON tw.symbol = pg.symbol GROUP BY 1, 2, 3, 4),
pq AS (SELECT *, v / lag(v) OVER (PARTITION BY window_id, part, strategy ORDER BY date) - 1 AS ret FROM pv),
ps AS (SELECT window_id, part, strategy, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe FROM pq GROUP BY 1, 2, 3)"""


@query("rolling_sharpes", "window_id strategy", "is_sharpe oos_sharpe", f"WITH {WEEK}, {EQUAL}, {SALES}, {_WINDOWS}, {_ROLLED} SELECT CAST(a.window_id AS INT) AS window_id, a.strategy, a.sharpe AS is_sharpe, b.sharpe AS oos_sharpe FROM ps a JOIN ps b ON a.window_id = b.window_id AND a.strategy = b.strategy WHERE a.part = 'train' AND b.part = 'test'")
def rolling_sharpes(spark, sf):
    return validation.rolling(P.week_panel(spark, sf), [], fixed=_two(spark, sf))


@query(
    "recommendation_validation", "windows verdict", "is_sharpe oos_sharpe baseline_sharpe in_sample_sharpe degradation",
    f"""WITH {WEEK}, {EQUAL}, {SALES}, {_WINDOWS}, {_ROLLED}, h AS (SELECT date, sum(weight * g) AS v FROM (SELECT date, symbol, price / first_value(price) OVER ({W}) AS g FROM px) x JOIN w ON w.symbol = x.symbol GROUP BY 1),
hr AS (SELECT v / lag(v) OVER (ORDER BY date) - 1 AS ret FROM h), i AS (SELECT (avg(ret) - 0.02 / 252) / stddev_samp(ret) * sqrt(252) AS a FROM hr),
o AS (SELECT count(*) FILTER (strategy = 'equal' AND part = 'test') AS windows, avg(sharpe) FILTER (strategy = 'equal' AND part = 'train') AS is_sharpe, avg(sharpe) FILTER (strategy = 'equal' AND part = 'test') AS oos_sharpe, avg(sharpe) FILTER (strategy = 'sales' AND part = 'test') AS baseline_sharpe FROM ps),
d AS (SELECT *, a AS in_sample_sharpe, CASE WHEN a > 0 THEN greatest(0, (a - oos_sharpe) / a) END AS degradation FROM o CROSS JOIN i)
SELECT *, CASE WHEN windows = 0 THEN 'inconclusive' WHEN oos_sharpe > 0 AND coalesce(degradation, 0) <= 0.5 THEN 'holds up' ELSE 'fragile' END AS verdict FROM d""",
)
def recommendation_validation(spark, sf):
    """Equal weights as the advice, shares of sales as what is held now."""
    return recommend.walk_forward(P.week_panel(spark, sf), "equal_weight", current=_by_sales(spark, sf).drop("strategy"))


@query("walk_forward_weights")
def walk_forward_weights(spark, sf):
    """Weights of every method on each training window."""
    returns = _returns(spark, sf)
    inside = planning.in_windows(returns, planning.walk_forward_windows(returns.select("date")), part="train")
    return optimize.optimized(inside, "window_id")


@query("optimized_portfolios")
def optimized_portfolios(spark, sf):
    return optimize.optimized(_returns(spark, sf).withColumn("market", F.lit("orders")), "market")


_DRAWS = f"""cx AS (SELECT date, symbol, ret FROM rets WHERE ret IS NOT NULL),
dr AS (SELECT date, s AS sample, ('0x' || substr(md5('42:' || s || ':' || date), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u FROM (SELECT DISTINCT date FROM cx) CROSS JOIN (SELECT unnest(range(1, 101)) AS s)),
mt AS (SELECT date, sample, {' + '.join(f'CAST(u > {p!r} AS INT)' for p in optimize.POISSON)} AS m FROM dr),
cn AS (SELECT mt.sample, mt.date, symbol, m, ret - sum(m * ret) OVER (PARTITION BY mt.sample, symbol) / sum(m) OVER (PARTITION BY mt.sample, symbol) AS x FROM cx JOIN mt ON mt.date = cx.date WHERE m > 0)"""


@query(
    "bootstrap_shrinkage", "sample", "n delta",
    f"""WITH {WEEK}, {_DRAWS},
m AS (SELECT a.sample, a.symbol AS i, b.symbol AS j, sum(a.m) AS t, sum(a.m * a.x * b.x) / sum(a.m) AS s, sum(a.m * a.x * a.x * b.x * b.x) / sum(a.m) AS q, sum(a.m * a.x * a.x * a.x * b.x) / sum(a.m) AS c,
  sum(a.m * a.x * b.x * b.x * b.x) / sum(a.m) AS c2, sum(a.m * a.x * a.x) / sum(a.m) AS si, sum(a.m * b.x * b.x) / sum(a.m) AS sj FROM cn a JOIN cn b ON a.sample = b.sample AND a.date = b.date GROUP BY 1, 2, 3),
r AS (SELECT sample, avg(s / sqrt(si * sj)) AS rbar FROM m WHERE i <> j GROUP BY 1),
f AS (SELECT m.*, CASE WHEN i = j THEN s ELSE rbar * sqrt(si * sj) END AS f, q - s * s AS pi,
  CASE WHEN i = j THEN q - s * s ELSE rbar / 2 * (sqrt(sj / si) * (c - si * s) + sqrt(si / sj) * (c2 - sj * s)) END AS rho FROM m JOIN r ON r.sample = m.sample)
SELECT CAST(sample AS INT) AS sample, CAST(max(t) AS DOUBLE) AS n, least(greatest((sum(pi) - sum(rho)) / sum(pow(f - s, 2)) / max(t), 0), 1) AS delta FROM f GROUP BY 1""",
)
def bootstrap_shrinkage(spark, sf):
    """Each of 100 resamplings has its own intensity, from sums of one pass."""
    return optimize.bootstrap_shrinkage(_returns(spark, sf))


@query("bootstrapped_weights")
def bootstrapped_weights(spark, sf):
    return optimize.bootstrapped(_returns(spark, sf))


@query("event_windows", "date symbol n", "price", "SELECT CAST(ts AS DATE) AS date, event_type AS symbol, count(value) AS n, avg(value) AS price FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return windowed_prices(P.read(spark, sf, "events"))
