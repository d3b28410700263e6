"""What an analysis starts from: clean prices split into train and test, and weights that fit them."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions.solvers import Limits, sector_limits
from meridia.operators.moments import covariance, mean_returns
from meridia.operators.optimize import optimized
from meridia.plans.panel import filled, spine, with_returns
from meridia.sources.providers import Provider, rate_or_default


@dataclass(frozen=True)
class Notes:
    """What had to be changed on the way."""

    dropped: tuple[str, ...] = ()
    reweighted: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    default_rate: bool = False

    @property
    def any(self) -> bool:
        return bool(self.dropped or self.reweighted or self.default_rate)


@dataclass(frozen=True)
class Context:
    panel: DataFrame
    train: DataFrame
    test: DataFrame
    weights: Mapping[str, float]
    benchmark: str
    rate: float
    notes: Notes
    sectors: Mapping[str, str] = field(default_factory=dict)
    sector_caps: Mapping[str, float] = field(default_factory=dict)
    sector_mins: Mapping[str, float] = field(default_factory=dict)
    #: (portfolio of symbols, its return, confidence) each; see ``optimize.posterior``.
    views: tuple = ()

    @staticmethod
    def from_prices(
        prices: DataFrame,
        weights: Mapping[str, float],
        benchmark: str,
        train_start: datetime.date,
        train_end: datetime.date,
        *,
        as_of: datetime.date,
        rate: float | None = None,
        provider: Provider | None = None,
        names: Mapping[str, str] | None = None,
        sectors: Mapping[str, str] | None = None,
        sector_caps: Mapping[str, float] | None = None,
        sector_mins: Mapping[str, float] | None = None,
        views: Sequence[tuple[Mapping[str, float], float, float]] = (),
    ) -> Context:
        """Symbols without prices are dropped and the other weights scaled up; without the benchmark it is an error.

        Train is from ``train_start`` to ``train_end``, test from the day after to the day
        before ``as_of``, all days included. ``names`` renames symbols.
        """
        names = dict(names or {})
        wanted = [*weights, benchmark]
        window = prices.filter(F.col("symbol").isin(wanted) & F.col("date").between(F.lit(train_start), F.lit(as_of - datetime.timedelta(days=1))))
        there = {r.symbol for r in window.filter("price IS NOT NULL").select("symbol").distinct().collect()}
        if benchmark not in there:
            raise ValueError(f"no prices of the benchmark {benchmark}")
        dropped = tuple(s for s in weights if s not in there)
        kept = {s: w for s, w in weights.items() if s in there}
        if not kept:
            raise ValueError("no prices of any holding")
        reweighted = {}
        if dropped:
            total = sum(kept.values())
            if abs(total) < 1e-12:
                raise ValueError("what is left of the weights adds up to 0")
            reweighted = {names.get(s, s): (w, w / total) for s, w in kept.items()}
            kept = {s: w / total for s, w in kept.items()}
        fallback = False
        if rate is None:
            rate, fallback = rate_or_default(provider) if provider else (0.02, True)
        if names:
            table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
            window = window.withColumn("symbol", F.coalesce(F.element_at(table, F.col("symbol")), F.col("symbol")))
        panel = with_returns(filled(spine(window.select("date", "symbol", "price"))))
        new = lambda s: names.get(s, s)
        return Context(
            panel,
            panel.filter(F.col("date") <= F.lit(train_end)),
            panel.filter(F.col("date") > F.lit(train_end)),
            {new(s): w for s, w in kept.items()},
            new(benchmark),
            rate,
            Notes(tuple(map(new, dropped)), reweighted, fallback),
            {new(s): v for s, v in (sectors or {}).items()},
            dict(sector_caps or {}),
            dict(sector_mins or {}),
            tuple(({new(s): v for s, v in of.items()}, q, c) for of, q, c in views),
        )

    @staticmethod
    def from_provider(
        provider: Provider, weights: Mapping[str, float], benchmark: str, train_start: datetime.date, train_end: datetime.date, *, as_of: datetime.date | None = None, **options: object
    ) -> Context:
        """The context of what a provider has of the holdings and the benchmark up to ``as_of`` (today).

        Options are those of ``from_prices``; the rate is the provider's where none is given.
        """
        if not weights:
            raise ValueError("no holdings")
        until = as_of or datetime.date.today()
        if not train_start <= train_end < until:
            raise ValueError(f"dates are out of order: {train_start}, {train_end}, {until}")
        prices = provider.prices([*weights, benchmark], train_start, until - datetime.timedelta(days=1))
        return Context.from_prices(prices, weights, benchmark, train_start, train_end, as_of=until, provider=provider, **options)

    def train_moments(self) -> tuple[DataFrame, DataFrame]:
        """(symbol, mu) and (i, j, cov, corr) of the train period, without the benchmark."""
        rows = self.train.filter(F.col("symbol") != self.benchmark)
        return mean_returns(rows), covariance(rows)

    def constraint_sets(self) -> dict[str, Callable[[list[str]], Limits]]:
        """Limits that optimisers are run with: none, 40 % a symbol, and the sectors' caps and mins."""
        sectors, caps, mins = self.sectors, self.sector_caps, self.sector_mins  # tasks get these alone
        return {
            "unconstrained": lambda symbols: Limits(len(symbols)),
            "balanced": lambda symbols: Limits(len(symbols), high=max(0.40, 1 / max(1, len(symbols)))),
            "sectors": lambda symbols: sector_limits(symbols, sectors, caps=caps, mins=mins),
        }

    def standard_portfolios(self) -> DataFrame:
        """(strategy, symbol, weight) of the train period: equal weights, least variance and best Sharpe without limits, best Sharpe within 40 % a symbol, and where there are any within the sectors' limits."""
        rows = self.train.filter(F.col("symbol") != self.benchmark).withColumn("_all", F.lit(1))
        sets = self.constraint_sets()
        runs = [("unconstrained", {"equal_weight": "equal", "min_variance": "min_vol", "max_sharpe": "max_sharpe"}), ("balanced", {"max_sharpe": "balanced"})]
        if self.sectors and (self.sector_caps or self.sector_mins):
            runs.append(("sectors", {"max_sharpe": "sector"}))
        of = lambda name, methods: optimized(rows, "_all", list(methods), limiter=sets[name]).select(F.element_at(F.create_map(*(F.lit(x) for m in methods.items() for x in m)), F.col("strategy")).alias("strategy"), "symbol", "weight")
        return reduce(DataFrame.unionByName, (of(*run) for run in runs))

    def weight_table(self, strategy: str = "portfolio") -> DataFrame:
        return self.panel.sparkSession.createDataFrame([(strategy, s, float(w)) for s, w in self.weights.items()], "strategy string, symbol string, weight double")

    def against_benchmark(self, values: DataFrame) -> DataFrame:
        """(strategy, date, ret, bench) of wealth (strategy, date, value)."""
        bench = self.panel.filter(F.col("symbol") == self.benchmark).select("date", F.col("ret").alias("bench"))
        rets = with_returns(values.withColumnRenamed("value", "price"), "strategy").select("strategy", "date", "ret")
        return rets.filter("ret IS NOT NULL").join(bench, "date")
