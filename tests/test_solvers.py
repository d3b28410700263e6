"""Solvers against their conditions of optimality and plain versions of themselves."""

import time

import numpy as np
import pytest
from test_operators import panel

from meridia.functions import solvers
from meridia.operators import optimize
from meridia.plans.panel import with_returns


def covariance(n, seed=0):
    rng = np.random.default_rng(seed + n)
    a = rng.normal(size=(n, 3))
    return (a @ a.T + np.diag(rng.uniform(0.5, 2, n))) / 100, rng.normal(0.05, 0.1, n)


def plain_linkage(distance):
    clusters = [[i] for i in range(len(distance))]
    while len(clusters) > 1:
        _, i, j = min((min(distance[x, y] for x in a for y in b), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        clusters.append(clusters[i] + clusters[j])
        del clusters[j], clusters[i]
    return clusters[0]


@pytest.mark.parametrize("n", [1, 2, 7, 30])
def test_linkage_from_a_spanning_tree(n):
    cov, _ = covariance(n)
    sd = np.sqrt(np.diag(cov))
    distance = np.sqrt((1 - np.clip(cov / np.outer(sd, sd), -1, 1)) / 2)
    assert solvers.single_linkage_order(distance) == plain_linkage(distance)


def test_a_thousand_symbols_in_seconds():
    cov, _ = covariance(1000)
    began = time.perf_counter()
    w = solvers.hierarchical_risk_parity(cov)
    assert w.sum() == pytest.approx(1) and (w > 0).all() and time.perf_counter() - began < 10


def assert_optimal(gradient, w, high):
    free = (w > 1e-7) & (w < high - 1e-7)
    level = gradient[free].mean() if free.any() else np.median(gradient)
    assert w.sum() == pytest.approx(1) and w.min() > -1e-9 and w.max() < high + 1e-9
    assert abs(gradient[free] - level).max(initial=0) < 1e-8
    assert (gradient[w <= 1e-7] > level - 1e-8).all() and (gradient[w >= high - 1e-7] < level + 1e-8).all()


@pytest.mark.parametrize("n", [2, 5, 30])
def test_ratios_meet_their_conditions_with_caps(n):
    cov, mu = covariance(n)
    high = 1.0 if n == 2 else 0.3
    limits, sd = solvers.Limits(n, high=high), np.sqrt(np.diag(cov))
    for gain, w in ((mu - 0.02, solvers.max_sharpe(mu, cov, limits=limits)), (sd, solvers.max_diversification(cov, limits))):
        vol = np.sqrt(w @ cov @ w)
        assert_optimal(-(gain / vol - (w @ gain) * (cov @ w) / vol**3), w, high)
    w = solvers.min_correlation(cov, limits)
    corr = cov / np.outer(sd, sd)
    up, down = w @ corr @ w - w @ w, 1 - w @ w + 1e-10
    assert_optimal(2 * ((corr @ w - w) * down + up * w) / down**2, w, high)
    budget = np.arange(1.0, n + 1)
    assert solvers.risk_shares(solvers.risk_budget(cov, budget), cov) == pytest.approx(budget / budget.sum(), abs=1e-12)


def test_ratios_with_sector_limits_and_without_a_gain():
    cov, mu = covariance(4)
    limits = solvers.sector_limits("abcd", {"a": "x", "b": "x"}, caps={"x": 0.3}, mins={"x": 0.2}, low=0.05, high=0.6, budget=0.9)
    w = solvers.max_sharpe(mu, cov, limits=limits)
    assert w.sum() == pytest.approx(0.9) and 0.2 - 1e-9 <= w[:2].sum() <= 0.3 + 1e-9 and w.min() > 0.05 - 1e-9
    ratio = lambda v: (v @ mu - 0.02) / np.sqrt(v @ cov @ v)
    rng = np.random.default_rng(1)
    for v in rng.dirichlet(np.ones(4), 3000) * 0.7 + 0.05:
        if 0.2 <= v[:2].sum() <= 0.3 and v.max() <= 0.6:
            assert ratio(v) <= ratio(w) + 1e-9
    losing = solvers.max_sharpe(-np.abs(mu) - 0.1, cov)
    assert losing.sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        solvers.best_ratio(-np.ones(4), cov, solvers.Limits(4))


@pytest.mark.parametrize("n", [1, 2, 5, 25])
def test_frontier_is_one_path(n):
    cov, mu = covariance(n)
    corners = solvers.critical_line(mu, cov)
    means = [c.mean for c in corners]
    assert means == sorted(means, reverse=True) and means[0] == pytest.approx(mu.max()) and means[-1] == pytest.approx(mu.min())
    for k, c in enumerate(corners):
        least = solvers.solve_qp(cov, np.zeros(n), solvers.Limits(n, a_eq=mu[None], b_eq=np.array([c.mean])))
        assert np.sqrt(c.weights @ cov @ c.weights) == pytest.approx(np.sqrt(least @ cov @ least), abs=1e-7)
        if 0 < k < len(corners) - 1:  # a symbol enters or leaves at each corner
            held = [set(np.flatnonzero((corners[k - 1].weights + x.weights) > 1e-9)) for x in (c,)] + [set(np.flatnonzero((c.weights + corners[k + 1].weights) > 1e-9))]
            assert held[0] != held[1]
    for target, vol, w in solvers.efficient_frontier(mu, cov, 9):
        least = solvers.solve_qp(cov, np.zeros(n), solvers.Limits(n, a_eq=mu[None], b_eq=np.array([target])))
        assert w @ mu == pytest.approx(target) and vol == pytest.approx(np.sqrt(least @ cov @ least), abs=1e-7)


def test_frontier_of_equal_means():
    cov, _ = covariance(3)
    corners = solvers.critical_line(np.full(3, 0.05), cov)
    assert all(c.weights.sum() == pytest.approx(1) for c in corners)
    best = solvers.min_variance(cov)
    assert len(corners) == 1 and corners[0].weights == pytest.approx(best)
    some = solvers.critical_line(np.array([0.05, 0.05, 0.02]), cov)
    assert min(c.weights @ cov @ c.weights for c in some) >= best @ cov @ best - 1e-12
    pair = solvers.min_variance(cov[:2, :2])
    assert min(np.abs(c.weights - np.append(pair, 0)).max() for c in some) < 1e-6


def test_corners_of_a_panel(spark):
    rows = optimize.corners(with_returns(panel(spark, 80))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.corner, []).append(r.weight)
    assert all(sum(w) == pytest.approx(1) for w in by.values()) and len(by) >= 2
