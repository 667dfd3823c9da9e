"""Window count and J-measure of activity pairs, for every case."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_length(events: DataFrame) -> DataFrame:
    """log_id, l: whole mean number of events in a case."""
    cases = events.groupBy("log_id", "case_idx").agg(F.count("*").alias("n"))
    return cases.groupBy("log_id").agg(F.floor(F.sum("n") / F.count("*")).alias("l"))


def subsequences(events: DataFrame, pairs: DataFrame | None = None, l: int | None = None) -> DataFrame:  # noqa: E741
    """log_id, case_idx, a, b, n_s, n_f for pairs that occur: windows of l events that begin with a, and those of them with a later b."""
    data = events.join(mean_length(events), "log_id") if l is None else events.withColumn("l", F.lit(l))
    x = data.select("log_id", "case_idx", F.col("evt_idx").alias("i"), F.col("activity").alias("a"), "l")
    y = events.select("log_id", "case_idx", F.col("evt_idx").alias("j"), F.col("activity").alias("b"))
    if pairs is not None:
        x = x.join(pairs.select("log_id", "a").distinct(), ["log_id", "a"], "left_semi")
    hits = x.join(y, ["log_id", "case_idx"]).where("j > i and j - i < l").select("log_id", "case_idx", "a", "b", "i").distinct()
    found = hits.groupBy("log_id", "case_idx", "a", "b").agg(F.count("*").alias("n_f"))
    starts = x.groupBy("log_id", "case_idx", "a").agg(F.count("*").alias("n_s"))
    out = found.join(starts, ["log_id", "case_idx", "a"])
    return out if pairs is None else out.join(pairs.select("log_id", "a", "b").distinct(), ["log_id", "a", "b"], "left_semi")


def all_pairs(events: DataFrame) -> DataFrame:
    acts = events.select("log_id", "activity").distinct()
    return acts.select("log_id", F.col("activity").alias("a")).join(acts.select("log_id", F.col("activity").alias("b")), "log_id")


def _grid(events: DataFrame, pairs: DataFrame) -> DataFrame:
    return events.select("log_id", "case_idx").distinct().join(pairs.select("log_id", "a", "b").distinct(), "log_id")


def window_count(events: DataFrame, pairs: DataFrame | None = None, l: int | None = None) -> DataFrame:  # noqa: E741
    """log_id, case_idx, a, b, value: number of windows with b after a; zero where there are none."""
    pairs = all_pairs(events) if pairs is None else pairs
    found = subsequences(events, pairs, l)
    return _grid(events, pairs).join(found, ["log_id", "case_idx", "a", "b"], "left").select("log_id", "case_idx", "a", "b", F.coalesce(F.col("n_f").cast("double"), F.lit(0.0)).alias("value"))


def j_measure(events: DataFrame, pairs: DataFrame | None = None, l: int | None = None) -> DataFrame:  # noqa: E741
    """log_id, case_idx, a, b, value: J-measure of the rule that b follows a within l events."""
    pairs = all_pairs(events) if pairs is None else pairs
    found = subsequences(events, pairs, l)
    per = events.groupBy("log_id", "case_idx", "activity").agg(F.count("*").alias("n"))
    size = events.groupBy("log_id", "case_idx").agg(F.count("*").alias("size"))
    rate = lambda x, p: per.select("log_id", "case_idx", F.col("activity").alias(x), F.col("n").alias(p))
    data = _grid(events, pairs).join(size, ["log_id", "case_idx"])
    data = data.join(rate("a", "n_a"), ["log_id", "case_idx", "a"], "left").join(rate("b", "n_b"), ["log_id", "case_idx", "b"], "left")
    data = data.join(found, ["log_id", "case_idx", "a", "b"], "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("size")
    data = data.select("log_id", "case_idx", "a", "b", share("n_a").alias("pa"), share("n_b").alias("pb"), F.coalesce(F.col("n_f") / F.col("n_s"), F.lit(0.0)).alias("p"))
    term = lambda x, y: F.when((x == 0) | (y == 0), 0.0).otherwise(x * F.log2(x / y))
    j = F.col("pa") * (term(F.col("p"), F.col("pb")) + term(1 - F.col("p"), 1 - F.col("pb")))
    return data.select("log_id", "case_idx", "a", "b", j.alias("value"))


def _followed(case: np.ndarray, place: np.ndarray, codes: np.ndarray, k: int, l: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    """pair (a * k + b), case, n_f of all cases where b follows an a within l events, by pair; events in order, codes under 0 are none."""
    hits = []
    for d in range(1, max(1, min(l, len(case)))):
        i = np.flatnonzero((case[d:] == case[:-d]) & (place[d:] - place[:-d] < l) & (codes[d:] >= 0) & (codes[:-d] >= 0))
        if not len(i):
            break
        hits.append(i * k + codes[i + d])
    if not hits:
        return (np.zeros(0, np.int64),) * 3
    i, b = np.divmod(np.unique(np.concatenate(hits)), k)
    n = int(case[-1]) + 1
    key, count = np.unique((codes[i] * k + b) * n + case[i], return_counts=True)
    return key // n, key % n, count


def _window_counts(case: np.ndarray, place: np.ndarray, codes: np.ndarray, order: list[int], n: int, l: int) -> Iterator[np.ndarray]:  # noqa: E741
    k = len(order)
    pair, at, count = _followed(case, place, codes.astype(np.int64), k, l)
    ends = np.searchsorted(pair, np.arange(k * k + 1))
    for a in order:
        for b in order:
            i, j = ends[a * k + b], ends[a * k + b + 1]
            if i < j:
                x = np.zeros(n)
                x[at[i:j]] = count[i:j]
                yield x


def _j_measures(case: np.ndarray, place: np.ndarray, codes: np.ndarray, order: list[int], n: int, l: int) -> Iterator[np.ndarray]:  # noqa: E741
    k = len(order)
    size = np.maximum(1, np.bincount(case, minlength=n))
    pair, at, count = _followed(case, place, codes.astype(np.int64), k, l)
    ends = np.searchsorted(pair, np.arange(k * k + 1))
    number = {a: np.bincount(case[codes == a], minlength=n) for a in order}

    def term(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, some = np.zeros(len(x)), (x != 0) & (y != 0)
        out[some] = x[some] * np.log2(x[some] / y[some])
        return out

    for a in order:
        for b in order:
            both = np.flatnonzero((number[a] > 0) & (number[b] > 0))
            if not len(both):
                continue
            i, j = ends[a * k + b], ends[a * k + b + 1]
            followed = np.zeros(n)
            followed[at[i:j]] = count[i:j]
            p, pb = followed[both] / number[a][both], number[b][both] / size[both]
            x = np.zeros(n)
            x[both] = np.round(number[a][both] / size[both] * (term(p, pb) + term(1 - p, 1 - pb)), 12)
            yield x


#: The measures of all pairs that occur in some cases, in memory: from case (from 0), place, code of each event in order, the codes
#: in order of their names, the number of cases and l, the signal of a pair after another; pairs that are 0 in all cases may have none.
IN_MEMORY = {"WC": _window_counts, "J": _j_measures}


def service_times(events: DataFrame, bins: int = 3, sample_share: float = 0.2, seed: int = 0) -> DataFrame:
    """log_id, case_idx, evt_idx, activity, seconds, bin: events of an interval log with their service time's bin.

    The intended meaning: k-means centres from a sample of the durations, then
    the nearest centre for every event.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    seconds = (F.unix_micros("ts") - F.unix_micros("start_ts")) / 1e6
    data = events.withColumn("seconds", seconds)
    vectors = VectorAssembler(inputCols=["seconds"], outputCol="v", handleInvalid="skip").transform(data)
    sample = vectors.sample(sample_share, seed)
    model = KMeans(k=bins, seed=seed, featuresCol="v").fit(sample if sample.limit(bins).count() == bins else vectors)
    centres = sorted(float(c[0]) for c in model.clusterCenters())
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col("seconds") - c).alias("d"), F.lit(i).alias("bin")) for i, c in enumerate(centres))))
    return data.withColumn("bin", nearest.bin).select("log_id", "case_idx", "evt_idx", "activity", "seconds", "bin")
