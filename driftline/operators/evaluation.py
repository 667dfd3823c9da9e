"""Detected against known change points: assignment, precision, recall, lag, Pareto points.

Input rows carry `detected` (array of double) and `actual` (array of double).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def assign(detected: list[float], actual: list[float], lag: float = 200) -> list[tuple[float, float]]:
    """Most pairs within the lag, and of these the least sum of squares.

    An optimal matching of points on a line need not cross, so a table over
    the sorted lists finds it.
    """
    d, a = sorted(detected), sorted(actual)
    best = [[(0, 0.0)] * (len(a) + 1) for _ in range(len(d) + 1)]
    for i in range(1, len(d) + 1):
        for j in range(1, len(a) + 1):
            options = [best[i - 1][j], best[i][j - 1]]
            if abs(d[i - 1] - a[j - 1]) <= lag:
                n, s = best[i - 1][j - 1]
                options.append((n - 1, s + (d[i - 1] - a[j - 1]) ** 2))
            best[i][j] = min(options)
    out, i, j = [], len(d), len(a)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((d[i], a[j]))
    return out[::-1]


def with_assignment(results: DataFrame, lag: float = 200) -> DataFrame:
    """`results` with pairs: array<struct<d, a>>; it is found once and used by every measure."""

    @F.pandas_udf("array<struct<d:double,a:double>>")
    def pairs(detected: pd.Series, actual: pd.Series) -> pd.Series:
        held = lambda x: [] if x is None else [v for v in x if v is not None]
        return pd.Series([[{"d": d, "a": a} for d, a in assign(held(x), held(y), lag)] for x, y in zip(detected, actual, strict=True)])

    return results.withColumn("pairs", pairs("detected", "actual"))


def with_tp_fp(assigned: DataFrame, lag: float = 200, count_duplicates: bool = True) -> DataFrame:
    """tp, fp, n_detected, n_actual.  Without duplicates, only detections out of reach of every known point are false."""
    near = lambda d: F.exists("actual", lambda a: F.abs(d - a) <= lag)
    far = F.size(F.filter("detected", lambda d: ~near(d)))
    tp = F.size("pairs")
    return assigned.withColumns({"tp": tp, "fp": F.size("detected") - tp if count_duplicates else far, "n_detected": F.size("detected"), "n_actual": F.size("actual")})


def ratio(a: Column, b: Column, undefined: float = NAN) -> Column:
    return F.when(b == 0, F.lit(undefined)).otherwise(a / b)


def with_scores(counted: DataFrame, undefined: float = NAN) -> DataFrame:
    """precision, recall, f1, avg_lag; undefined values are NaN (so is f1 without true positives)."""
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp"), undefined), ratio(F.col("tp"), F.col("n_actual"), undefined)
    f1 = F.when(F.col("tp") == 0, F.lit(undefined)).otherwise(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n_actual")))
    lags = F.aggregate("pairs", F.lit(0.0), lambda s, p: s + F.abs(p.d - p.a))
    return counted.withColumns({"precision": precision, "recall": recall, "f1": f1, "avg_lag": ratio(lags, F.size("pairs"))})


def with_rates(counted: DataFrame, negatives: int | None = None) -> DataFrame:
    """tpr and fpr; fpr is NaN where the number of possible negatives is not known."""
    fpr = F.lit(NAN) if negatives is None else ratio(F.col("fp"), F.lit(negatives))
    return counted.withColumns({"tpr": ratio(F.col("tp"), F.col("n_actual")), "fpr": fpr})


def evaluated(results: DataFrame, lag: float = 200, count_duplicates: bool = True) -> DataFrame:
    return with_scores(with_tp_fp(with_assignment(results, lag), lag, count_duplicates))


def roc_points(scored: DataFrame, by: str = "window_size", undefined: float = 0.0) -> DataFrame:
    """Mean precision and recall of each window size."""
    value = lambda c: F.avg(F.nanvl(F.col(c), F.lit(undefined)))
    return scored.groupBy(by).agg(value("precision").alias("precision"), value("recall").alias("recall"))


def scatter_points(rows: DataFrame, by: str, dims: list[str], nan_as: float = 0.0) -> DataFrame:
    return rows.groupBy(by).agg(*(F.avg(F.coalesce(F.nanvl(F.col(d).cast("double"), F.lit(nan_as)), F.lit(nan_as))).alias(d) for d in dims))


def pareto(points: DataFrame, dims: list[str], lower_is_better: list[bool] | None = None) -> DataFrame:
    """Points that no other one beats strictly in every dimension."""
    lower = lower_is_better or [False] * len(dims)
    other = points.select(*(F.col(d).alias(f"_{d}") for d in dims))
    beats = F.lit(True)
    for d, low in zip(dims, lower, strict=True):
        beats = beats & ((F.col(f"_{d}") < F.col(d)) if low else (F.col(f"_{d}") > F.col(d)))
    return points.join(other, beats, "left_anti")
