"""Test statistics and p-values in NumPy and plain Python: no SciPy is needed."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=200_000)
def ks_equal(n: int, h: int) -> float:
    """Exact two-sided p for two samples of n values whose counts differ by at most h."""
    if h <= 0:
        return 1.0
    total, k = 0.0, 1
    base = math.lgamma(2 * n + 1) - 2 * math.lgamma(n + 1)
    while k * h <= n:
        term = math.exp(math.lgamma(2 * n + 1) - math.lgamma(n - k * h + 1) - math.lgamma(n + k * h + 1) - base)
        total += term if k % 2 else -term
        k += 1
    return min(1.0, max(0.0, 2 * total))


@lru_cache(maxsize=20_000)
def ks_unequal(m: int, n: int, h: int) -> float:
    """Exact p for samples of m and n values; h: the largest |n * count1 - m * count2|.

    Chance that a random lattice path from (0, 0) to (m, n) leaves the band |n i - m j| < h.
    """
    if h <= 0:
        return 1.0
    j = np.arange(n + 1)
    inside = np.where(m * j < h, 1.0, 0.0)
    inside = np.cumprod(inside)
    for i in range(1, m + 1):
        stay = np.abs(n * i - m * j) < h
        came = inside * (i / (i + j)) * stay
        share = np.where(stay, j / (i + j), 0.0)
        row = np.zeros(n + 1)
        low, high = np.searchsorted(m * j, n * i - h, side="right"), np.searchsorted(m * j, n * i + h, side="left")
        last = 0.0
        for k in range(low, high):
            last = came[k] + last * share[k]
            row[k] = last
        inside = row
    return float(min(1.0, max(0.0, 1.0 - inside[n])))


def ks_2samp(x: np.ndarray, y: np.ndarray) -> float:
    m, n = len(x), len(y)
    if not m or not n:
        return 1.0
    grid = np.concatenate([x, y])
    c1 = np.searchsorted(np.sort(x), grid, side="right")
    c2 = np.searchsorted(np.sort(y), grid, side="right")
    if m == n:
        return ks_equal(n, int(np.abs(c1 - c2).max()))
    return ks_unequal(m, n, int(np.abs(c1 * n - c2 * m).max()))


def mw_from_u(u: float, m: int, n: int, ties: float) -> float:
    """Two-sided normal p of the U statistic with continuity and tie correction; ties: sum of t^3 - t."""
    total = m + n
    var = m * n / 12 * (total + 1 - ties / (total * (total - 1))) if total > 1 else 0
    if var <= 0:
        return 1.0
    z = (abs(u - m * n / 2) - 0.5) / math.sqrt(var)
    return min(1.0, math.erfc(z / math.sqrt(2)))


@lru_cache(maxsize=10_000)
def _mw_counts(m: int, n: int) -> tuple[int, ...]:
    counts = np.zeros(m * n + 1, object)
    counts[0] = 1
    for k in range(1, m + 1):  # Gaussian binomial coefficient
        top = n + k
        grown = counts.copy()
        grown[top:] -= counts[: len(counts) - top] if top <= m * n else 0
        for i in range(k, len(grown)):
            grown[i] += grown[i - k]
        counts = grown
    return tuple(counts.tolist())


def mannwhitneyu(x: np.ndarray, y: np.ndarray) -> float:
    """Two-sided p; exact where a sample has at most 8 values and there are no ties."""
    m, n = len(x), len(y)
    if not m or not n:
        return 1.0
    both = np.concatenate([x, y])
    values, inverse, t = np.unique(both, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(t) - (t - 1) / 2)[inverse]
    u = ranks[:m].sum() - m * (m + 1) / 2
    if min(m, n) <= 8 and len(values) == m + n:
        counts = _mw_counts(m, n)
        least = int(min(u, m * n - u))
        return min(1.0, 2 * sum(counts[: least + 1]) / math.comb(m + n, m))
    return mw_from_u(u, m, n, float((t.astype(float) ** 3 - t).sum()))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0 or a <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, dof: int) -> float:
    return 1.0 if dof <= 0 else gamma_q(dof / 2, x / 2)


def chi2_contingency(a: np.ndarray, b: np.ndarray) -> float:
    """p of the 2 x k table; Yates' correction with one degree of freedom."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    keep = a + b > 0
    a, b = a[keep], b[keep]
    dof = len(a) - 1
    if dof <= 0:
        return 1.0
    rows, cols = np.array([a.sum(), b.sum()]), a + b
    want = rows[:, None] * cols[None, :] / rows.sum()
    diff = np.abs(np.vstack([a, b]) - want)
    if dof == 1:
        diff = np.maximum(diff - np.minimum(0.5, diff), 0)
    if not want.all():
        return 1.0
    return chi2_sf(float((diff**2 / want).sum()), dof)


def g_test(expected: np.ndarray, observed: np.ndarray) -> tuple[float, float]:
    """Power divergence with lambda 0: statistic and p."""
    e, o = np.asarray(expected, float), np.asarray(observed, float)
    keep = (e > 0) & (o > 0)
    g = 2 * float((o[keep] * np.log(o[keep] / e[keep])).sum())
    return g, chi2_sf(g, len(o) - 1)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def hotelling(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-sample T^2 and its p; samples are rows."""
    (n, p), m = x.shape, len(y)
    if n + m - p - 1 <= 0:
        return 0.0, 1.0
    pooled = ((n - 1) * np.atleast_2d(np.cov(x, rowvar=False)) + (m - 1) * np.atleast_2d(np.cov(y, rowvar=False))) / (n + m - 2)
    diff = x.mean(0) - y.mean(0)
    t2 = n * m / (n + m) * float(diff @ np.linalg.pinv(pooled) @ diff)
    return t2, f_sf(t2 * (n + m - p - 1) / ((n + m - 2) * p), p, n + m - p - 1)


TESTS = {"ks": ks_2samp, "mw": mannwhitneyu}


def _lowest(heights: list[float], valleys: list[float]) -> list[float]:
    """For each maximum, the lowest valley between it and the last maximum before it that is higher; valleys[k] lies before heights[k]."""
    out, above = [], []  # above: maxima that are higher than all behind them, with their lowest valley
    for height, low in zip(heights, valleys, strict=True):
        while above and above[-1][0] <= height:
            low = min(low, above.pop()[1])
        above.append((height, low))
        out.append(low)
    return out


def _crossing(x: np.ndarray, p: int, level: float, to: int) -> float:
    """Where x falls to the level, from p on to the left (to = -1) or right (1), interpolated."""
    size, i = 64, p
    while True:
        part = x[i : i + size] if to > 0 else x[max(0, i - size + 1) : i + 1][::-1]
        hit = np.flatnonzero(part <= level)
        if len(hit):
            i += to * int(hit[0])
            break
        i, size = i + to * len(part), size * 2
        if not 0 <= i < len(x):
            return float(i - to)
    return i - to * (level - x[i]) / (x[i - to] - x[i]) if x[i] < level else float(i)


def peaks(x: np.ndarray, width: float | None = None, prominence: float | None = None) -> np.ndarray:
    """Indices of local maxima with at least the given width (at half prominence) and prominence.

    Plateaus count by their middle; the ends are no peaks.  One pass over the
    maxima for each side: a maximum is set against the last higher one.
    """
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.zeros(0, int)
    begins = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    v = x[begins]  # of the plateaus
    up = np.concatenate([[True], v[1:] > v[:-1]])
    top = np.flatnonzero(up & np.concatenate([v[:-1] > v[1:], [True]]))  # the ends may be higher than peaks
    if not len(top):
        return np.zeros(0, int)
    heights = v[top].tolist()
    between = np.minimum.reduceat(v, top)[:-1].tolist()  # from a maximum to the next
    left = _lowest(heights, [min(v[: top[0] + 1].min(), heights[0]), *between])
    right = _lowest(heights[::-1], [min(v[top[-1] :].min(), heights[-1]), *between[::-1]])[::-1]
    ends = np.concatenate([begins[1:], [len(x)]]) - 1
    prominences = v[top] - np.maximum(left, right)
    chosen = (top > 0) & (top < len(v) - 1)
    if prominence is not None:
        chosen &= prominences >= prominence
    out = []
    for k in np.flatnonzero(chosen):
        p = int(begins[top[k]] + ends[top[k]]) // 2
        if width is not None:
            level = x[p] - prominences[k] / 2
            if _crossing(x, p, level, 1) - _crossing(x, p, level, -1) < width:
                continue
        out.append(p)
    return np.array(out, int)


def emd(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> float:
    """Least cost of moving `supply` to `demand` (equal sums), by shortest augmenting paths with potentials."""
    m, n = cost.shape
    left, need = supply.astype(float).copy(), demand.astype(float).copy()
    flow = np.zeros((m, n))
    u, v = np.zeros(m), np.zeros(n)
    eps = 1e-12
    while left.max(initial=0) > eps and need.max(initial=0) > eps:
        dist_u = np.where(left > eps, 0.0, np.inf)
        dist_v = np.full(n, np.inf)
        done_u, done_v = np.zeros(m, bool), np.zeros(n, bool)
        from_u, from_v = np.full(m, -1), np.full(n, -1)
        end = -1
        while True:
            du, dv = np.where(done_u, np.inf, dist_u), np.where(done_v, np.inf, dist_v)
            i, j = int(du.argmin()), int(dv.argmin())
            if dv[j] <= du[i]:
                if not np.isfinite(dv[j]):
                    break
                done_v[j] = True
                if need[j] > eps:
                    end = j
                    break
                through = np.maximum(dv[j] - (cost[:, j] - u - v[j]), dv[j])
                better = (flow[:, j] > eps) & ~done_u & (through < dist_u)
                dist_u[better], from_u[better] = through[better], j
            else:
                done_u[i] = True
                through = du[i] + np.maximum(cost[i] - u[i] - v, 0)
                better = ~done_v & (through < dist_v)
                dist_v[better], from_v[better] = through[better], i
        if end < 0:
            break
        reach = dist_v[end]
        u[done_u] += reach - dist_u[done_u]
        v[done_v] -= reach - dist_v[done_v]
        path, j, amount = [], end, need[end]
        while True:
            i = from_v[j]
            path.append((i, j, 1))
            if from_u[i] < 0:
                amount = min(amount, left[i])
                break
            path.append((i, from_u[i], -1))
            amount = min(amount, flow[i, from_u[i]])
            j = from_u[i]
        for a, b, sign in path:
            flow[a, b] += sign * amount
        left[i] -= amount
        need[end] -= amount
    return float((flow * cost).sum())


def levenshtein(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def weighted_levenshtein(a: list, b: list, rename=None, insdel=None, time_match=None, time_insdel=None) -> float:
    """Distance of two sequences of (activity, bin): costs of renaming and of inserting or deleting, and of the bins'.

    Defaults: 1 for a rename, insertion or deletion; the bins' difference for a
    match; nothing more for an insertion or deletion.
    """
    rename = rename or (lambda x, y: 1.0)
    insdel = insdel or (lambda x: 1.0)
    time_match = time_match or (lambda x, y: abs(x - y))
    time_insdel = time_insdel or (lambda x: 0.0)
    gap = lambda e: insdel(e[0]) + time_insdel(e[1])
    row = [0.0]
    for y in b:
        row.append(row[-1] + gap(y))
    for x in a:
        last, row[0] = row[0], row[0] + gap(x)
        for j, y in enumerate(b, 1):
            step = last + (0.0 if x[0] == y[0] else rename(x[0], y[0])) + time_match(x[1], y[1])
            last, row[j] = row[j], min(row[j] + gap(x), row[j - 1] + gap(y), step)
    return row[-1]


def locate_change(test, low: int, middle: int, high: int, alpha: float) -> int:
    """Bisection: where the change between [low, middle) and [middle, high) is.

    test(a, b, c): p of [a, b) against [b, c).  Of the halves' three
    neighbouring pairs the least p leads on, the leftmost of equal ones, until
    none is within alpha; then the last index of the first part.
    """
    while True:
        m1, m2 = low + (middle - low) // 2, middle + (high - middle) // 2
        options = [(test(a, b, c), k, a, b, c) for k, (a, b, c) in enumerate(((low, m1, middle), (m1, middle, m2), (middle, m2, high)))]
        p, _, a, b, c = min(options)
        if not p <= alpha or (a, b, c) == (low, middle, high):
            return middle - 1
        low, middle, high = a, b, c


def bisected_change(test, low: int, middle: int, high: int, alpha: float) -> int:
    """The other rule of bisection: halve as long as both parts differ, and give the beginning of the second one.

    The published form steps over the whole first part where it means its first
    half; here it is the half.
    """
    while test(low, middle, high) < alpha:
        m1, m2 = low + (middle - low) // 2, middle + (high - middle) // 2
        p, place = min((test(*x), k) for k, x in enumerate(((low, m1, middle), (m1, middle, m2), (middle, m2, high))))
        closer = ((low, m1, middle), (m1, middle, m2), (middle, m2, high))[place]
        if p >= alpha or closer == (low, middle, high):
            break
        low, middle, high = closer
    return middle
