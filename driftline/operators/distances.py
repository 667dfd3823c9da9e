"""Distances of traces and of window languages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import stats


def encoded(trace_table: DataFrame) -> DataFrame:
    """`trace_table` with code: a string with one character for each event, for the built-in `levenshtein`.

    Characters are given by the rank of the activity in the log.  More than
    55,000 activities of one log do not fit below the surrogates: an error.
    """
    acts = trace_table.select("log_id", F.explode("trace").alias("x")).distinct()
    table = acts.groupBy("log_id").agg(F.array_sort(F.collect_set("x")).alias("acts"))
    table = table.withColumn("acts", F.when(F.size("acts") <= 55_000, F.col("acts")).otherwise(F.raise_error(F.lit("a log of more than 55,000 activities"))))
    char = lambda x: F.decode(F.unhex(F.lpad(F.hex(F.array_position("acts", x) + 255), 4, "0")), "UTF-16BE")
    return trace_table.join(table, "log_id").withColumn("code", F.array_join(F.transform("trace", char), "")).drop("acts")


def variant_distances(variant_table: DataFrame) -> DataFrame:
    """log_id, v1, v2, lev, distance for v1 <= v2: edit distance of variants, whole and by the longer length."""
    data = encoded(variant_table).select("log_id", "variant_id", "code")
    x = data.select("log_id", F.col("variant_id").alias("v1"), F.col("code").alias("c1"))
    y = data.select("log_id", F.col("variant_id").alias("v2"), F.col("code").alias("c2"))
    longest = F.greatest(F.length("c1"), F.length("c2"))
    pairs = x.join(y, "log_id").where("v1 <= v2").withColumn("lev", F.levenshtein("c1", "c2"))
    return pairs.select("log_id", "v1", "v2", "lev", F.when(longest == 0, 0.0).otherwise(F.col("lev") / longest).alias("distance"))


def weighted_distances(variant_table: DataFrame, **costs) -> DataFrame:
    """log_id, v1, v2, weighted, distance for v1 <= v2: weighted edit distance of timed variants, whole and by the longer length.

    variant_table: log_id, variant_id, trace, bins (of each event's duration).
    costs: functions rename(a, b), insdel(a), time_match(x, y), time_insdel(x),
    as `stats.weighted_levenshtein` takes them; they run in Python, a batch of
    pairs at a time.
    """
    side = lambda k: variant_table.select("log_id", F.col("variant_id").alias(f"v{k}"), F.arrays_zip(F.col("trace").alias("a"), F.col("bins").alias("x")).alias(f"t{k}"))

    @F.pandas_udf("double")
    def weighted(first: pd.Series, second: pd.Series) -> pd.Series:
        held = lambda t: [(e["a"], e["x"]) for e in t]
        return pd.Series([stats.weighted_levenshtein(held(a), held(b), **costs) for a, b in zip(first, second, strict=True)], dtype=float)

    pairs = side(1).join(side(2), "log_id").where("v1 <= v2").withColumn("weighted", weighted("t1", "t2"))
    longest = F.greatest(F.size("t1"), F.size("t2"))
    return pairs.select("log_id", "v1", "v2", "weighted", F.when(longest == 0, 0.0).otherwise(F.col("weighted") / longest).alias("distance"))


def window_starts(w: int, step: int) -> Column:
    """The multiples of `step` from which on 2 * w cases hold case_idx."""
    first = F.ceil(F.greatest(F.lit(0), F.col("case_idx") - 2 * w + 1) / step) * step
    last = F.floor(F.col("case_idx") / step) * step
    return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long")))


def window_language(case_variant: DataFrame, w: int, step: int = 1) -> DataFrame:
    """log_id, pos, side, variant_id, p: the stochastic languages of both windows at each position evaluated."""
    n = Window.partitionBy("log_id")
    data = case_variant.withColumn("n", F.max("case_idx").over(n) + 1)
    return (
        data.withColumn("start", F.explode(window_starts(w, step)))
        .where(F.col("start") < F.col("n") - 2 * w)
        .groupBy("log_id", "start", (F.col("case_idx") >= F.col("start") + w).cast("int").alias("side"), "variant_id")
        .agg((F.count("*") / w).alias("p"))
        .select("log_id", (F.col("start") + w).alias("pos"), "side", "variant_id", "p")
    )


def emd_series(trace_table: DataFrame, w: int, step: int = 1) -> DataFrame:
    """log_id, pos, value: earth mover's distance of the windows before and after each position evaluated."""
    from driftline import eventlog

    known = eventlog.variants(trace_table)
    language = window_language(eventlog.case_variants(trace_table), w, step)
    words = language.join(known.select("log_id", "variant_id", "trace"), ["log_id", "variant_id"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[tuple, float] = {}
        rows = []
        for (log_id, pos), g in pdf.groupby(["log_id", "pos"]):
            a, b = g[g.side == 0], g[g.side == 1]
            cost = pd.DataFrame(index=a.variant_id, columns=b.variant_id, dtype=float)
            for i, x in zip(a.variant_id, a.trace, strict=True):
                for j, y in zip(b.variant_id, b.trace, strict=True):
                    key = (min(i, j), max(i, j))
                    if key not in held:
                        held[key] = normalised(list(x), list(y))
                    cost.loc[i, j] = held[key]
            rows.append((log_id, pos, stats.emd(cost.to_numpy(), a.p.to_numpy(), b.p.to_numpy())))
        return pd.DataFrame(rows, columns=["log_id", "pos", "value"])

    # neighbouring positions share variants, so a task takes a stretch of them and keeps distances
    return words.withColumn("part", F.floor(F.col("pos") / (64 * step))).groupBy("log_id", "part").applyInPandas(one, "log_id string, pos long, value double")


def normalised(a: list, b: list) -> float:
    longest = max(len(a), len(b))
    return stats.levenshtein(a, b) / longest if longest else 0.0


def normalised_weighted(a: list, b: list, **costs) -> float:
    longest = max(len(a), len(b))
    return stats.weighted_levenshtein(a, b, **costs) / longest if longest else 0.0


def emd_of_languages(first: dict[tuple, float], second: dict[tuple, float], distance=normalised) -> float:
    """Earth mover's distance of two languages {trace: share}."""
    import numpy as np

    cost = np.array([[distance(list(x), list(y)) for y in second] for x in first])
    return stats.emd(cost, np.array(list(first.values())), np.array(list(second.values())))
