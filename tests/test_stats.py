"""Statistics against enumeration and brute force."""

from __future__ import annotations

import itertools
import math
import time

import numpy as np
import pytest

from driftline.functions import stats
from driftline.operators import distances
from driftline.operators.evaluation import assign


def _ks_brute(m: int, n: int, h: int) -> float:
    bad = total = 0
    for ones in itertools.combinations(range(m + n), m):
        i = j = worst = 0
        for k in range(m + n):
            i, j = (i + 1, j) if k in ones else (i, j + 1)
            worst = max(worst, abs(n * i - m * j))
        total += 1
        bad += worst >= h
    return bad / total


@pytest.mark.parametrize("n", [3, 5])
def test_ks_equal_is_enumeration(n):
    for h in range(n + 1):
        assert stats.ks_equal(n, h) == pytest.approx(_ks_brute(n, n, h * n) if h else 1.0)


@pytest.mark.parametrize(("m", "n"), [(3, 4), (5, 4), (2, 6)])
def test_ks_unequal_is_enumeration(m, n):
    for h in range(1, m * n + 1):
        assert stats.ks_unequal(m, n, h) == pytest.approx(_ks_brute(m, n, h))


def test_mann_whitney_exact_is_enumeration():
    x, y = np.array([1.0, 4.0, 6.0]), np.array([2.0, 3.0, 5.0, 7.0])
    both = np.concatenate([x, y])
    u = lambda a, b: sum((p > q) + 0.5 * (p == q) for p in a for q in b)
    seen = u(x, y)
    all_u = [u(both[list(c)], np.delete(both, list(c))) for c in itertools.combinations(range(7), 3)]
    low = min(seen, 12 - seen)
    assert stats.mannwhitneyu(x, y) == pytest.approx(min(1.0, 2 * sum(v <= low for v in all_u) / len(all_u)))
    assert stats.mannwhitneyu(np.ones(20), np.ones(20)) == 1.0


def test_tails():
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert stats.chi2_sf(10.0, 4) == pytest.approx(math.exp(-5) * 6)
    assert stats.f_sf(4.0, 2, 10) == pytest.approx((1 + 2 * 4 / 10) ** -5)
    assert stats.chi2_contingency([10, 0], [10, 0]) == 1.0
    a, b = np.array([10.0, 20, 30]), np.array([20.0, 20, 20])
    assert stats.chi2_contingency(a, b) == pytest.approx(stats.chi2_sf(float(((a - b) ** 2 / (a + b)).sum()), 2))
    g, _ = stats.g_test([1, 2], [2, 2])
    assert g == pytest.approx(4 * math.log(2))


def test_hotelling_finds_a_shift():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    assert stats.hotelling(x, rng.normal(size=(50, 3)) + 2)[1] < 1e-6
    assert stats.hotelling(x, x)[1] == pytest.approx(1.0)


def test_peaks():
    x = np.array([0, 1, 3, 1, 0, 2, 2, 2, 0, 5.0])
    assert stats.peaks(x).tolist() == [2, 6]
    assert stats.peaks(x, prominence=2.5).tolist() == [2]
    assert stats.peaks(x, width=3).tolist() == [6]
    assert stats.peaks(np.ones(5)).tolist() == []


F1 = {tuple("abdf"): 0.5, tuple("acf"): 0.4, tuple("abef"): 0.1}
F2 = {tuple("abdf"): 0.5, tuple("acf"): 0.35, tuple("abdef"): 0.15}
F3 = {tuple("abdf"): 0.2, tuple("acf"): 0.7, tuple("abef"): 0.1}


def test_peaks_of_a_long_series_take_one_pass():
    x = np.random.default_rng(3).random(1_000_000)
    started = time.perf_counter()
    found = stats.peaks(x, 2.0, 0.5)
    assert time.perf_counter() - started < 40
    assert len(found) > 10_000 and (x[found] > x[found - 1]).all() and (x[found] > x[found + 1]).all()


def test_emd_goldens():
    assert distances.emd_of_languages(F1, F2) == pytest.approx(0.05)
    assert distances.emd_of_languages(F1, F3) == pytest.approx(0.15)


def test_emd_is_assignment_on_small_cases():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = rng.integers(2, 6)
        cost = rng.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert stats.emd(cost, np.ones(n), np.ones(n)) == pytest.approx(best)


def test_weighted_levenshtein():
    a, b = [("x", 0), ("y", 1)], [("x", 2), ("z", 1), ("y", 1)]
    assert stats.weighted_levenshtein(a, b) == pytest.approx(3.0)
    assert stats.weighted_levenshtein(a, []) == pytest.approx(2.0)
    assert distances.normalised_weighted([], []) == 0.0
    assert distances.normalised(list("ab"), list("aba")) == pytest.approx(1 / 3)


def test_assign_goldens():
    assert assign([1050, 934, 2100], [1000, 1149, 2000]) == [(934, 1000), (1050, 1149), (2100, 2000)]
    assert assign([], [1]) == assign([1], []) == []


def test_assign_is_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(150):
        d, a = rng.integers(0, 600, rng.integers(0, 5)).tolist(), rng.integers(0, 600, rng.integers(0, 5)).tolist()
        best = (0, 0)
        for k in range(min(len(d), len(a)) + 1):
            for x in itertools.combinations(d, k):
                for y in itertools.permutations(a, k):
                    if all(abs(p - q) <= 200 for p, q in zip(x, y)):
                        best = min(best, (-k, sum((p - q) ** 2 for p, q in zip(x, y))))
        got = assign(d, a)
        assert (-len(got), sum((p - q) ** 2 for p, q in got)) == best
