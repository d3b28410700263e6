"""Portfolio solvers on the small matrices that Spark's aggregations leave: numpy only.

Problems are minimised over weights w with low <= w <= high, sum(w) = budget and, where
given, a_in @ w <= b_in and a_eq @ w = b_eq.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np

Objective = Callable[[np.ndarray], float]


@dataclass
class Limits:
    n: int
    low: np.ndarray | float = 0.0
    high: np.ndarray | float = 1.0
    budget: float = 1.0
    a_in: np.ndarray | None = None
    b_in: np.ndarray | None = None
    a_eq: np.ndarray | None = None
    b_eq: np.ndarray | None = None
    rows: tuple = field(init=False, default=())

    def __post_init__(self) -> None:
        one = np.ones((1, self.n))
        blocks = [(np.eye(self.n), np.broadcast_to(self.low, self.n), np.broadcast_to(self.high, self.n)), (one, np.array([self.budget]), np.array([self.budget]))]
        if self.a_in is not None:
            blocks.append((np.atleast_2d(self.a_in), np.full(len(np.atleast_1d(self.b_in)), -np.inf), np.atleast_1d(self.b_in)))
        if self.a_eq is not None:
            blocks.append((np.atleast_2d(self.a_eq), np.atleast_1d(self.b_eq), np.atleast_1d(self.b_eq)))
        self.rows = tuple(np.concatenate([np.asarray(b[k], float) for b in blocks]) for k in range(3))


def sector_limits(symbols: Sequence[str], sectors: Mapping[str, str], *, caps: Mapping[str, float] | None = None, mins: Mapping[str, float] | None = None, low=0.0, high=1.0, budget: float = 1.0) -> Limits:
    """Limits with the most and the least of each sector; sectors without a symbol bind nothing."""
    rows, bounds = [], []
    for sign, of in ((1.0, caps or {}), (-1.0, mins or {})):
        for sector, value in of.items():
            row = np.array([sign * (sectors.get(s, "Other") == sector) for s in symbols])
            if row.any():
                rows.append(row)
                bounds.append(sign * value)
    return Limits(len(symbols), low, high, budget, np.array(rows) if rows else None, np.array(bounds) if rows else None)


def check_covariance(cov: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    cov = np.asarray(cov, float)
    if not np.isfinite(cov).all():
        raise ValueError("covariance has missing values")
    if abs(cov - cov.T).max(initial=0) > tolerance:
        raise ValueError("covariance isn't symmetric")
    if np.linalg.eigvalsh(cov).min(initial=0) < -tolerance:
        raise ValueError("covariance isn't positive semi-definite")
    return cov


def regularized(cov: np.ndarray, most_condition: float = 1e10) -> np.ndarray:
    """With a trace-sized ridge where the condition number is too high."""
    positive = (e := np.linalg.eigvalsh(cov))[e > 0]
    if len(positive) == len(e) and positive.max() / positive.min() <= most_condition:
        return cov
    return cov + np.eye(len(cov)) * 1e-8 * np.trace(cov) / len(cov)


def denoised(cov: np.ndarray, components: int = 3) -> np.ndarray:
    """All eigenvalues below the largest ``components`` replaced by their mean."""
    values, vectors = np.linalg.eigh(cov)
    rest = len(values) - components
    if rest > 0:
        values[:rest] = values[:rest].mean()
    return (vectors * values) @ vectors.T


#: Powers (a, b) of x_i ** a * x_j ** b whose sums give shrinkage; those with b > a are their transposes.
SHRINKAGE_POWERS = ((1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1))


def constant_correlation_shrinkage(raw: Mapping[tuple[int, int], np.ndarray], n: float) -> tuple[np.ndarray, float]:
    """Covariance a period and intensity of Ledoit and Wolf from ``raw`` moments (matrices of means of powers) of n dates.

    Moments about the mean follow from raw ones by the binomial theorem, so that one pass
    gives those of every weighting of the dates. Series should be near their means
    already, or digits are lost.
    """
    of = dict(raw) | {(b, a): m.T for (a, b), m in raw.items()} | {(0, 0): np.ones_like(raw[1, 0])}
    mean_i, mean_j = of[1, 0], of[0, 1]

    def central(p: int, q: int) -> np.ndarray:
        return sum(math.comb(p, a) * math.comb(q, b) * (-mean_i) ** (p - a) * (-mean_j) ** (q - b) * of[a, b] for a in range(p + 1) for b in range(q + 1))

    s, si, sj = central(1, 1), central(2, 0), central(0, 2)
    if not n >= 2 or si.min(initial=1) < 1e-14:
        raise ValueError("shrinkage needs two dates, and series that vary")
    same, scale = np.eye(len(s), dtype=bool), np.sqrt(si * sj)
    mean_corr = (s / scale)[~same].mean() if len(s) > 1 else 0.0
    target = np.where(same, s, mean_corr * scale)
    pi = central(2, 2) - s * s
    theta = np.sqrt(sj / si) * (central(3, 1) - si * s) + np.sqrt(si / sj) * (central(1, 3) - sj * s)
    rho = np.where(same, pi, mean_corr / 2 * theta)
    gap = ((target - s) ** 2).sum()
    apart = gap > 1e-24 * (s * s).sum()  # of two series the target is the covariance itself
    delta = float(np.clip((pi.sum() - rho.sum()) / gap / n, 0, 1)) if apart else 0.0
    return delta * target + (1 - delta) * s, delta


def solve_qp(p: np.ndarray, q: np.ndarray, limits: Limits, rounds: int = 100, tolerance: float = 1e-10) -> np.ndarray:
    """Minimum of w'Pw/2 + q'w for a positive semi-definite P, by a primal-dual interior-point method.

    Predictor and corrector steps share one factorisation a round; the active rows are then
    solved for exactly. A ValueError if the conditions of optimality aren't met, as where
    nothing is within the limits.
    """
    a, low, high = limits.rows
    size = max(1e-300, float(np.abs(p).max()), float(np.abs(q).max()))
    p, q = p / size, q / size
    equal = low == high
    up, down = ~equal & np.isfinite(high), ~equal & np.isfinite(low)
    e, to = a[equal], low[equal]
    g, h = np.concatenate([a[up], -a[down]]), np.concatenate([high[up], -low[down]])
    if (low > high).any():
        raise ValueError("a lower limit is above its upper one")
    n, k, m = limits.n, len(e), len(g)
    w, y = np.full(n, limits.budget / n), np.zeros(k)
    s, z = np.maximum(h - g @ w, 1.0), np.ones(m)
    unit = max(1.0, float(np.abs(h).max(initial=0)), float(np.abs(to).max(initial=0)))
    for turn in range(rounds):
        dual, primal, slack = p @ w + q + e.T @ y + g.T @ z, e @ w - to, g @ w + s - h
        gap = s @ z / m if m else 0.0
        if max(abs(dual).max(), abs(primal).max(initial=0), abs(slack).max(initial=0)) < tolerance * unit and gap < tolerance:
            break
        d = z / s
        kkt = np.block([[p + g.T @ (d[:, None] * g) + 1e-13 * np.eye(n), e.T], [e, -1e-13 * np.eye(k)]])
        try:
            inverse = np.linalg.inv(kkt)
        except np.linalg.LinAlgError:
            break  # as near as doubles get

        def step(target: np.ndarray) -> tuple[np.ndarray, ...]:
            """Changes that bring s * z to ``target``."""
            inner = (s * z - target) / s
            right = np.concatenate([-dual + g.T @ (inner - d * slack), -primal])
            found = inverse @ right
            found += inverse @ (right - kkt @ found)
            dw, dy = found[:n], found[n:]
            ds = -slack - g @ dw
            return dw, dy, ds, -inner - d * ds

        def room(*pairs: tuple[np.ndarray, np.ndarray]) -> float:
            return min([1.0, *(float(np.min(-x[c < 0] / c[c < 0], initial=np.inf)) for x, c in pairs)])

        _, _, ds, dz = step(np.zeros(m))
        far = room((s, ds), (z, dz))
        centre = ((s + far * ds) @ (z + far * dz) / m / gap) ** 3 if m and gap > 0 else 0.0
        # a second-order correction, but where that hasn't ended soon (it can cycle) plain steps along the central path
        dw, dy, ds, dz = step(centre * gap - ds * dz if turn < 25 else np.full(m, 0.2 * gap))
        far = min(1.0, (0.995 if turn < 25 else 0.9) * room((s, ds), (z, dz)))
        w, y, s, z = w + far * dw, y + far * dy, s + far * ds, z + far * dz
        s, z = np.maximum(s, 1e-300), np.maximum(z, 1e-300)
    return _checked(p, q, e, to, g, h, w, y, z, unit, z > s)


def _checked(p, q, e, to, g, h, w, y, z, unit, active) -> np.ndarray:
    """The solution on the active rows if that is within all others, else ``w``; an error if neither is optimal."""
    rows, right = np.concatenate([e, g[active]]), np.concatenate([to, h[active]])
    kkt = np.block([[p, rows.T], [rows, np.zeros((len(rows), len(rows)))]])
    out = np.linalg.lstsq(kkt, np.concatenate([-q, right]), rcond=None)[0]
    exact, multiplier = out[: len(w)], out[len(w) + len(e) :]
    off = max(abs(e @ exact - to).max(initial=0), (g @ exact - h).max(initial=0))
    if off < 1e-9 * unit and multiplier.min(initial=0) > -1e-8 and abs(kkt @ out - np.concatenate([-q, right])).max() < 1e-9 * unit:
        return exact
    wrong = max(abs(p @ w + q + e.T @ y + g.T @ z).max(), abs(e @ w - to).max(initial=0), (g @ w - h).max(initial=0), float(z @ np.maximum(h - g @ w, 0)))
    if not wrong < 1e-6 * unit:
        raise ValueError(f"the quadratic program has no solution within its limits, or none was found (residual {wrong:.1e})")
    return w


def minimize(
    objective: Objective, limits: Limits, start: np.ndarray | None = None, rounds: int = 200, tolerance: float = 1e-10, slope: Callable[[np.ndarray], np.ndarray] | None = None
) -> np.ndarray:
    """Sequential quadratic programming for any smooth objective; without its ``slope``, numeric gradients."""
    w = np.full(limits.n, limits.budget / limits.n) if start is None else np.asarray(start, float)

    def gradient(x: np.ndarray) -> np.ndarray:
        if slope is not None:
            return slope(x)
        h = 1e-6
        return np.array([(objective(x + h * e) - objective(x - h * e)) / (2 * h) for e in np.eye(limits.n)])

    a, low, high = limits.rows
    hessian, g, f = np.eye(limits.n), gradient(w), objective(w)
    for _ in range(rounds):
        shifted = Limits(limits.n)
        shifted.rows = (a, low - a @ w, high - a @ w)
        shifted.budget = 0.0
        step = solve_qp(hessian, g, shifted)
        size = 1.0
        while size > 1e-10 and not objective(w + size * step) <= f + 1e-4 * size * (g @ step):
            size /= 2
        new = w + size * step
        g_new, f_new = gradient(new), objective(new)
        s, y = new - w, g_new - g
        if size <= 1e-10 or abs(s).max() < tolerance:
            break
        hs, sy = hessian @ s, s @ y
        theta = 1.0 if sy >= 0.2 * s @ hs else 0.8 * (s @ hs) / (s @ hs - sy)
        r = theta * y + (1 - theta) * hs
        hessian = hessian - np.outer(hs, hs) / (s @ hs) + np.outer(r, r) / (s @ r)
        w, g, f = new, g_new, f_new
    return w


def min_variance(cov: np.ndarray, limits: Limits | None = None) -> np.ndarray:
    return solve_qp(regularized(check_covariance(cov)), np.zeros(len(cov)), limits or Limits(len(cov)))


def portfolio_stats(w: np.ndarray, mu: np.ndarray, cov: np.ndarray, rf: float = 0.02) -> tuple[float, float, float]:
    ret, vol = float(w @ mu), float(np.sqrt(max(w @ cov @ w, 0)))
    return ret, vol, (ret - rf) / vol if vol > 1e-5 else 0.0


def best_ratio(gain: np.ndarray, cov: np.ndarray, limits: Limits) -> np.ndarray:
    """Weights of the highest gain'w / sqrt(w'Cw) within limits, as one quadratic program.

    Weights are scaled so that their gain is 1: the least variance of y = scale * w, with
    the scale as one more variable that all limits are multiplied by (Charnes and
    Cooper). A ValueError where no weights have a gain above 0.
    """
    a, low, high = limits.rows
    scaled = Limits(limits.n + 1)
    lower, upper = np.isfinite(low), np.isfinite(high)
    rows = np.concatenate([np.column_stack([a[upper], -high[upper]]), np.column_stack([-a[lower], low[lower]])])
    equal = low == high
    twice = np.concatenate([equal[upper], equal[lower]])  # of an equality one side is enough, as an equation
    keep = np.concatenate([np.ones(upper.sum(), bool), ~equal[lower]])
    size = max(np.abs(gain).max(initial=0), 1e-300)
    one = np.append(gain / size, 0.0)
    positive = np.append(np.zeros(limits.n), -1.0)
    at = np.concatenate([rows[keep], one[None], positive[None]])
    top = np.concatenate([np.zeros(keep.sum()), [1.0, 0.0]])
    scaled.rows = (at, np.concatenate([np.where(twice[keep], 0.0, -np.inf), [1.0, -np.inf]]), top)
    unit = max(float(np.trace(cov)) / len(cov), 1e-300)
    y = solve_qp(np.block([[cov / unit, np.zeros((limits.n, 1))], [np.zeros((1, limits.n + 1))]]), np.zeros(limits.n + 1), scaled)
    if y[-1] <= 1e-12:
        raise ValueError("no weights with a gain")
    return y[:-1] / y[-1]


def max_sharpe(mu: np.ndarray, cov: np.ndarray, rf: float = 0.02, limits: Limits | None = None) -> np.ndarray:
    """By one quadratic program; where no weights earn more than ``rf``, by descent."""
    limits = limits or Limits(len(mu))
    try:
        return best_ratio(mu - rf / limits.budget, cov, limits)
    except (ValueError, ZeroDivisionError):

        def slope(w: np.ndarray) -> np.ndarray:
            vol = np.sqrt(max(w @ cov @ w, 1e-30))
            return -mu / vol + (w @ mu - rf) * (cov @ w) / vol**3

        return minimize(lambda w: -(w @ mu - rf) / np.sqrt(max(w @ cov @ w, 1e-30)), limits, slope=slope)


@dataclass(frozen=True)
class Corner:
    """A point of the frontier at which a symbol enters or leaves; between two of them weights are straight lines."""

    mean: float
    weights: np.ndarray


def critical_line(mu: np.ndarray, cov: np.ndarray) -> list[Corner]:
    """All corners of the long-only frontier (weights from 0, sum 1), from the highest mean to the lowest.

    At each trade-off t of variance and mean the free weights solve equations that are
    linear in t; t falls from infinity until a free weight reaches 0 or the gradient of a fixed
    one meets the others', and that symbol changes sides. Equal means are told apart by
    their order, by a billionth of the span of all; if all are equal there is one portfolio.
    """
    n, span = len(mu), float(np.ptp(mu)) if len(mu) else 0.0
    if span <= 1e-12 * np.abs(mu).max(initial=0):
        least = min_variance(cov)
        return [Corner(float(least @ mu), least)]
    mean = mu + np.arange(n)[::-1] * 1e-9 * span / n
    top = int(mean.argmax())
    free, t = [top], np.inf
    corners = [Corner(float(mu[top]), np.eye(n)[top])]
    for _ in range(50 * n + 50):
        inverse = np.linalg.inv(np.block([[cov[np.ix_(free, free)], np.ones((len(free), 1))], [np.ones((1, len(free))), np.zeros((1, 1))]]))
        still, moving = inverse[:, -1], inverse[:, :-1] @ mean[free]  # w = still + t * moving, the last is the multiplier of the sum
        base, rate = cov[:, free] @ still[:-1] + still[-1], cov[:, free] @ moving[:-1] + moving[-1] - mean
        events = []
        if len(free) > 1:
            events += [(-still[k] / moving[k], i) for k, i in enumerate(free) if moving[k] > 0]
        events += [(-base[i] / rate[i], i) for i in set(range(n)) - set(free) if rate[i] > 0]
        events = [(x, i) for x, i in events if x < t - 1e-12 * max(1.0, abs(t) if np.isfinite(t) else 1.0)]
        if not events:
            break
        t, i = max(events)
        w = np.zeros(n)
        w[free] = np.maximum(still[:-1] + t * moving[:-1], 0.0)
        w /= w.sum()
        if abs(w - corners[-1].weights).max() > 1e-14:
            corners.append(Corner(float(w @ mu), w))
        free = [x for x in free if x != i] if i in free else sorted([*free, i])
    last = int(mean.argmin())
    if abs(corners[-1].mean - mu[last]) > 1e-12 * max(1.0, abs(mu[last])):
        corners.append(Corner(float(mu[last]), np.eye(n)[last]))
    return corners


def efficient_frontier(mu: np.ndarray, cov: np.ndarray, points: int = 50) -> list[tuple[float, float, np.ndarray]]:
    """(target, vol, weights) of least variance for targets from the 10 % to 1.2 times the 90 % quantile of means.

    All of them lie between corners of one path.
    """
    corners = critical_line(mu, regularized(check_covariance(cov)))
    means = np.array([c.mean for c in corners])
    out = []
    for target in np.linspace(np.quantile(mu, 0.1), 1.2 * np.quantile(mu, 0.9), points):
        if mu.min() - 1e-12 <= target <= mu.max() + 1e-12:
            k = int(np.clip(np.searchsorted(-means, -target), 1, max(len(corners) - 1, 1)))
            one, two = corners[k - 1], corners[min(k, len(corners) - 1)]
            gap = one.mean - two.mean
            share = float(np.clip((one.mean - target) / gap, 0, 1)) if gap > 0 else 0.0
            w = (1 - share) * one.weights + share * two.weights
            out.append((float(target), float(np.sqrt(w @ cov @ w)), w))
    return out


def risk_budget(cov: np.ndarray, budget: Sequence[float] | None = None, rounds: int = 5000) -> np.ndarray:
    """Weights whose risk shares are the budget's, by cyclic descent on the convex log-barrier form."""
    cov = regularized(check_covariance(cov))
    b = np.ones(len(cov)) if budget is None else np.asarray(budget, float)
    if b.sum() <= 0:
        raise ValueError("the budget has to be positive")
    b = b / b.sum()
    x = b / np.sqrt(np.diag(cov))
    if (b > 0).all():
        return _by_newton(cov, b, x)
    for _ in range(rounds):
        before = x.copy()
        for i in range(len(x)):
            rest = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-rest + np.sqrt(rest * rest + 4 * cov[i, i] * b[i])) / (2 * cov[i, i])
        if abs(x - before).max() < 1e-14 * max(1, abs(x).max()):
            break
    return x / x.sum()


def _by_newton(cov: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Minimum of x'Cx/2 - b'ln x: its gradient is 0 where risk shares are those of b. Steps are damped far from it."""
    x = x / np.sqrt(x @ cov @ x)
    for _ in range(rounds):
        g = cov @ x - b / x
        step = np.linalg.solve(cov + np.diag(b / x**2), -g)
        decrement = np.sqrt(max(-g @ step, 0.0))
        if decrement < 1e-14:
            break
        # the barrier's terms b ln x have a self-concordance of 1 / sqrt(b)
        x = x + step / (1 + decrement / np.sqrt(b.min())) if decrement > 0.25 * np.sqrt(b.min()) else x + step
    return x / x.sum()


def risk_shares(w: np.ndarray, cov: np.ndarray) -> np.ndarray:
    total = w @ cov @ w
    return w * (cov @ w) / total if total >= 1e-28 else np.zeros(len(w))


def max_diversification(cov: np.ndarray, limits: Limits | None = None) -> np.ndarray:
    sd = np.sqrt(np.diag(check_covariance(cov)))
    return best_ratio(sd, cov, limits or Limits(len(cov)))


def min_correlation(cov: np.ndarray, limits: Limits | None = None) -> np.ndarray:
    sd = np.sqrt(np.diag(check_covariance(cov)))
    corr = cov / np.outer(sd, sd)
    parts = lambda w: (w @ corr @ w - w @ w, 1 - w @ w + 1e-10)

    def slope(w: np.ndarray) -> np.ndarray:
        up, down = parts(w)
        return 2 * ((corr @ w - w) * down + up * w) / down**2

    return minimize(lambda w: parts(w)[0] / parts(w)[1], limits or Limits(len(cov)), slope=slope)


def single_linkage_order(distance: np.ndarray) -> list[int]:
    """Leaves in the order of a single-linkage dendrogram, the part that came about first to the left.

    Single linkage merges along the edges of a minimum spanning tree, shortest first. The
    tree grows by its nearest point, which takes n * n steps in all.
    """
    n = len(distance)
    near, link, out = distance[0].copy() if n else np.zeros(0), np.zeros(n, int), np.ones(n, bool)
    out[:1] = False
    edges = []
    for _ in range(n - 1):
        j = int(np.where(out, near, np.inf).argmin())
        edges.append((near[j], link[j], j))
        out[j] = False
        closer = out & (distance[j] < near)
        near[closer], link[closer] = distance[j][closer], j
    cluster = list(range(n))  # of a point: its tree's root
    born, leaves = list(range(n)), [[i] for i in range(n)]

    def root(i: int) -> int:
        while cluster[i] != i:
            cluster[i] = cluster[cluster[i]]
            i = cluster[i]
        return i

    for step, (_, i, j) in enumerate(sorted(edges)):
        a, b = root(i), root(j)
        if born[a] > born[b]:
            a, b = b, a
        cluster[b], born[a] = a, n + step
        leaves[a], leaves[b] = leaves[a] + leaves[b], []
    return leaves[root(0)] if n else []


def hierarchical_risk_parity(cov: np.ndarray) -> np.ndarray:
    """Single linkage on correlation distance, then bisection of the leaf order by cluster variance at equal weights."""
    sd = np.sqrt(np.diag(check_covariance(cov)))
    clusters = [single_linkage_order(np.sqrt((1 - np.clip(cov / np.outer(sd, sd), -1, 1)) / 2))]
    weights = np.ones(len(cov))
    todo = clusters
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        va, vb = (cov[np.ix_(x, x)].mean() for x in (left, right))
        share = 1 - va / (va + vb) if va + vb > 0 else 0.5
        weights[left] *= share
        weights[right] *= 1 - share
        todo += [left, right]
    return weights


def black_litterman(prior: np.ndarray, cov: np.ndarray, picks: np.ndarray, views: np.ndarray, confidences: np.ndarray, tau: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and covariance; without views the prior and (1 + tau) times the covariance."""
    if not len(picks):
        return prior, (1 + tau) * cov
    omega = np.diag(tau * np.einsum("ki,ij,kj->k", picks, cov, picks) / np.clip(confidences, 0.01, 1))
    inverse = np.linalg.inv(tau * cov)
    spread = np.linalg.inv(inverse + picks.T @ np.linalg.solve(omega, picks))
    return spread @ (inverse @ prior + picks.T @ np.linalg.solve(omega, views)), cov + spread


def shortfall(w: np.ndarray, returns: np.ndarray, confidence: float = 0.95) -> float:
    """CVaR as a positive loss: minus the mean of portfolio returns at or below the quantile."""
    values = returns @ w
    return float(-values[values <= np.quantile(values, 1 - confidence)].mean())


def tracking_error(w: np.ndarray, returns: np.ndarray, benchmark: np.ndarray) -> float:
    active = returns @ w - benchmark
    return float(active.std(ddof=1)) if len(active) > 1 else 0.0


def mean_squared_error(true: np.ndarray, guess: np.ndarray) -> float:
    return float(np.mean((np.asarray(true) - np.asarray(guess)) ** 2))


def mean_absolute_error(true: np.ndarray, guess: np.ndarray) -> float:
    return float(np.mean(np.abs(np.asarray(true) - np.asarray(guess))))


def min_shortfall(returns: np.ndarray, limits: Limits | None = None, confidence: float = 0.95) -> np.ndarray:
    return minimize(lambda w: shortfall(w, returns, confidence), limits or Limits(returns.shape[1]))


def min_tracking_error(returns: np.ndarray, benchmark: np.ndarray, limits: Limits | None = None) -> np.ndarray:
    """A quadratic problem: the variance of returns against the benchmark."""
    x, b = returns - returns.mean(axis=0), benchmark - benchmark.mean()
    return solve_qp(x.T @ x, -x.T @ b, limits or Limits(returns.shape[1]))


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray, rounds: int = 400) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, for arrays a and x."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-np.minimum(y, 1 - 1e-300))) / p
    tiny = 1e-300
    d = 1 / np.where(abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
    c, f = np.ones_like(y), d.copy()
    for m in range(1, rounds):
        for numerator in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + numerator * d, 1 + numerator / c
            d, c = 1 / np.where(abs(d) < tiny, tiny, d), np.where(abs(c) < tiny, tiny, c)
            f = f * d * c
    out = np.where(y <= 0, 0.0, front * f)
    return np.where(swap, 1 - out, out)


def student_p(t: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Student's distribution."""
    t, freedom = np.asarray(t, float), np.asarray(freedom, float)
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))
