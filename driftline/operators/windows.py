"""Two adjacent windows sliding over a log: counts, statistics, p-values, streaks.

Reference window [i, i+w), detection window [i+w, i+2w), for i from 0 to
n-2w-1; the result stands at i+w.  Counts come from running sums, so a
position costs the number of distinct values, whatever w is.  A series is cut
into chunks of cases with 2w cases of the next chunk added, so that no series
has to pass through one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from driftline.functions import stats

KEYS = ("log_id", "series")
CHUNK = 20_000


def two_windows(series: DataFrame, w: int, step: int = 1, chunk: int = CHUNK) -> DataFrame:
    """log_id, series, pos, value, c1, c2: how often each value of the series occurs in both windows.

    series: log_id, series, case_idx (dense), value.  Values in neither window have no row.
    """
    first, last = F.greatest(F.lit(0), F.floor((F.col("case_idx") - 2 * w) / chunk)), F.floor(F.col("case_idx") / chunk)
    data = series.withColumn("chunk", F.explode(F.sequence(first, last)))
    values = data.select(*KEYS, "chunk", F.col("value").alias("v")).distinct()
    grid = data.join(values, [*KEYS, "chunk"])
    order = Window.partitionBy(*KEYS, "chunk", "v").orderBy("case_idx")
    hit = F.col("value").eqNullSafe(F.col("v")).cast("long")
    before = grid.withColumn("p", F.sum(hit).over(order) - hit)
    ahead = before.withColumns({"p1": F.lead("p", w).over(order), "p2": F.lead("p", 2 * w).over(order)})
    own = (F.floor(F.col("case_idx") / chunk) == F.col("chunk")) & F.col("p2").isNotNull() & (F.col("case_idx") % step == 0)
    counts = ahead.where(own).select(*KEYS, (F.col("case_idx") + w).alias("pos"), F.col("v").alias("value"), (F.col("p1") - F.col("p")).alias("c1"), (F.col("p2") - F.col("p1")).alias("c2"))
    return counts.where("c1 + c2 > 0")


def ks_statistic(counts: DataFrame) -> DataFrame:
    """log_id, series, pos, h: largest difference of the cumulative counts."""
    up_to = Window.partitionBy(*KEYS, "pos").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("d", F.abs(F.sum(F.col("c1") - F.col("c2")).over(up_to))).groupBy(*KEYS, "pos").agg(F.max("d").alias("h"))


def mw_statistic(counts: DataFrame) -> DataFrame:
    """log_id, series, pos, u, ties: U of the reference window, and the sum of t^3 - t."""
    below = Window.partitionBy(*KEYS, "pos").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    t = (F.col("c1") + F.col("c2")).cast("double")
    data = counts.withColumn("l", F.coalesce(F.sum("c2").over(below), F.lit(0)))
    return data.groupBy(*KEYS, "pos").agg(F.sum(F.col("c1") * (F.col("l") + F.col("c2") / 2)).alias("u"), F.sum(t * t * t - t).alias("ties"))


def chi2_statistic(counts: DataFrame) -> DataFrame:
    """log_id, series, pos, chi2, dof for windows of equal size; Yates' correction with one degree of freedom."""
    d, s = F.abs(F.col("c1") - F.col("c2")).cast("double"), (F.col("c1") + F.col("c2")).cast("double")
    yates = F.greatest(F.lit(0.0), d / 2 - 0.5)
    sums = counts.groupBy(*KEYS, "pos").agg(F.sum(d * d / s).alias("plain"), F.sum(2 * yates * yates / (s / 2)).alias("yates"), (F.count("*") - 1).alias("dof"))
    return sums.select(*KEYS, "pos", F.when(F.col("dof") == 1, F.col("yates")).otherwise(F.col("plain")).alias("chi2"), "dof")


@F.pandas_udf(DoubleType())
def _ks_p(n: pd.Series, h: pd.Series) -> pd.Series:
    return pd.Series([stats.ks_equal(int(a), int(b)) for a, b in zip(n, h, strict=True)])


@F.pandas_udf(DoubleType())
def _mw_p(n: pd.Series, u: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([stats.mw_from_u(b, int(a), int(a), c) for a, b, c in zip(n, u, ties, strict=True)])


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([stats.chi2_sf(a, int(b)) for a, b in zip(x, dof, strict=True)])


def p_values(series: DataFrame, w: int, step: int = 1, test: str = "ks") -> DataFrame:
    """log_id, series, pos, pval.  test: ks, mw, chi2."""
    counts = two_windows(series, w, step)
    if test == "ks":
        return ks_statistic(counts).select(*KEYS, "pos", _ks_p(F.lit(w), "h").alias("pval"))
    if test == "mw":
        if w <= 8:
            return sliding_udf(series, w, step, stats.mannwhitneyu)
        return mw_statistic(counts).select(*KEYS, "pos", _mw_p(F.lit(w), "u", "ties").alias("pval"))
    if test == "chi2":
        return chi2_statistic(counts).select(*KEYS, "pos", _chi2_p("chi2", "dof").alias("pval"))
    raise ValueError(f"unknown test {test!r}")


def sliding_udf(series: DataFrame, w: int, step: int, test, chunk: int = CHUNK) -> DataFrame:
    """log_id, series, pos, pval for any test of two arrays, in chunks."""
    first, last = F.greatest(F.lit(0), F.floor((F.col("case_idx") - 2 * w) / chunk)), F.floor(F.col("case_idx") / chunk)
    data = series.withColumn("chunk", F.explode(F.sequence(first, last)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("case_idx")
        x, at, k = pdf["value"].to_numpy(), pdf["case_idx"].to_numpy(), pdf["chunk"].iloc[0]
        rows = [(at[i] + w, float(test(x[i : i + w], x[i + w : i + 2 * w]))) for i in range(len(x) - 2 * w) if at[i] // chunk == k and at[i] % step == 0]
        return pd.DataFrame({"log_id": pdf["log_id"].iloc[0], "series": pdf["series"].iloc[0], "pos": [r[0] for r in rows], "pval": [r[1] for r in rows]})

    return data.groupBy(*KEYS, "chunk").applyInPandas(run, "log_id string, series string, pos long, pval double")


def _pieces(x: np.ndarray, starts: np.ndarray, w: int):
    """x and the starts in pieces that have at most about 8w different values each."""
    if len(starts) and len(x) > 8 * w and len(np.unique(x)) > 8 * w:
        for i in range(0, int(starts[-1]) + 1, 6 * w):
            own = starts[(starts >= i) & (starts < i + 6 * w)]
            yield x[i : i + 8 * w], own - i
    else:
        yield x, starts


def _counts(x: np.ndarray, starts: np.ndarray, w: int):
    """c1, c2 at all starts, of one value of x after another, in order."""
    _, codes = np.unique(x, return_inverse=True)
    order = np.argsort(codes, kind="stable")
    for hits in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        sums = np.zeros(len(x) + 1, np.int64)
        sums[hits + 1] = 1
        sums = np.cumsum(sums)
        low, middle, high = sums[starts], sums[starts + w], sums[starts + 2 * w]
        yield middle - low, high - middle


def ks_in_memory(x: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    """p of the windows [i, i + w) and [i + w, i + 2w) of x, at all starts i."""
    out = []
    for part, at in _pieces(x, starts, w):
        difference, h = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for c1, c2 in _counts(part, at, w):
            difference += c1 - c2
            np.maximum(h, np.abs(difference), out=h)
        out.append(h)
    h = np.concatenate(out)
    different, back = np.unique(h, return_inverse=True)
    return np.array([stats.ks_equal(w, int(k)) for k in different], float)[back]


def mw_in_memory(x: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    """The same of the Mann-Whitney test."""
    if w <= 8:
        return np.array([stats.mannwhitneyu(x[i : i + w], x[i + w : i + 2 * w]) for i in starts], float)
    out = []
    for part, at in _pieces(x, starts, w):
        u, ties, below = (np.zeros(len(at)) for _ in range(3))
        for c1, c2 in _counts(part, at, w):
            u += c1 * (below + c2 / 2)
            below += c2
            t = (c1 + c2).astype(float)
            ties += t * t * t - t
        out.append(np.stack([u, ties]))
    different, back = np.unique(np.concatenate(out, 1), axis=1, return_inverse=True)
    return np.array([stats.mw_from_u(u, w, w, t) for u, t in different.T], float)[back.ravel()]


IN_MEMORY = {"ks": ks_in_memory, "mw": mw_in_memory}


def sliding_hotelling(series: DataFrame, w: int, step: int = 1) -> DataFrame:
    """log_id, pos, t2, pval over all series of a log together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="case_idx", columns="series", values="value").sort_index().to_numpy(float)
        rows = [(i + w, *stats.hotelling(x[i : i + w], x[i + w : i + 2 * w])) for i in range(0, len(x) - 2 * w, step)]
        return pd.DataFrame({"log_id": pdf["log_id"].iloc[0], "pos": [r[0] for r in rows], "t2": [r[1] for r in rows], "pval": [r[2] for r in rows]})

    return series.groupBy("log_id").applyInPandas(run, "log_id string, pos long, t2 double, pval double")


def padded(p: DataFrame, lengths: DataFrame, fill: float = 1.0, value: str = "pval") -> DataFrame:
    """log_id, case_idx, value for every case of the log; `fill` where nothing was evaluated.  lengths: log_id, n_cases."""
    grid = lengths.where("n_cases > 0").select("log_id", F.explode(F.sequence(F.lit(0), F.col("n_cases") - 1)).alias("case_idx"))
    return grid.join(p.withColumnRenamed("pos", "case_idx"), ["log_id", "case_idx"], "left").select("log_id", "case_idx", F.coalesce(value, F.lit(fill)).alias(value))


def streaks(p: DataFrame, alpha: float, phi: int, by: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """by, pos: where the phi-th value in a row under alpha stands (compact series: neighbours by position)."""
    order = Window.partitionBy(*by).orderBy("pos")
    data = p.withColumn("low", F.col("pval") < alpha).withColumn("island", F.sum((~F.col("low")).cast("int")).over(order))
    rank = F.row_number().over(Window.partitionBy(*by, "island").orderBy("pos"))
    return data.where("low").withColumn("r", rank).where(F.col("r") == phi).select(*by, "pos")


def peak_positions(p: DataFrame, width: float | None, prominence: float | None, minima: bool, step: int = 1, offset: int = 0, value: str = "pval") -> DataFrame:
    """log_id, pos: peaks of the series (of its negative where `minima`), by `step` and `offset` from index to case."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos")[value].to_numpy(float)
        found = stats.peaks(-x if minima else x, width, prominence) * step + offset
        return pd.DataFrame({"log_id": pdf["log_id"].iloc[0], "pos": found})

    return p.groupBy("log_id").applyInPandas(run, "log_id string, pos long")
