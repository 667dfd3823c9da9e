"""From per-run results to measures of each algorithm.

Results have the columns algorithm, log_source, log, detected, actual, seconds
and params (a string that stands for one parameter setting; null rows drop out of
grouping by setting).  Assignments are found once, by `evaluation`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import scalars
from driftline.operators import evaluation

NAN = float("nan")

#: Names of algorithms in result files, and short names.
SHORT_NAMES = {
    "Zheng DBSCAN": "RINV",
    "ProDrift": "ProDrift",
    "Maaradji Runs": "ProDrift",
    "Bose J": "J-Measure",
    "Bose WC": "Window Count",
    "Earth Mover's Distance": "EMD",
    "Process Graph Metrics": "PGM",
    "Martjushev ADWIN J": "ADWIN J",
    "Martjushev ADWIN WC": "ADWIN WC",
    "LCDD": "LCDD",
}

#: Change patterns as one corpus spells them, and their codes.
PATTERN_CODES = {
    "ConditionalMove": "cm",
    "ConditionalRemoval": "cre",
    "ConditionalToSequence": "cf",
    "Frequency": "fr",
    "Loop": "lp",
    "ParallelMove": "pm",
    "ParallelRemoval": "pre",
    "ParallelToSequence": "pl",
    "SerialMove": "sm",
    "SerialRemoval": "sre",
    "Skip": "cb",
    "Substitute": "rp",
    "Swap": "sw",
}


def renamed(results: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Short names; unknown ones stay."""
    table = F.create_map(*(F.lit(x) for kv in (names or SHORT_NAMES).items() for x in kv))
    return results.withColumn("algorithm", F.coalesce(F.element_at(table, F.col("algorithm")), F.col("algorithm")))


def excluded(results: DataFrame, algorithm: str = "Martjushev ADWIN WC") -> DataFrame:
    return results.where(F.col("algorithm") != algorithm)


def _token(k: int) -> Column:
    return F.try_element_at(F.split("log", "_"), F.lit(k))


def is_atomic() -> Column:
    """Logs with a single change pattern: by the log's name and source."""
    letters = F.array_sort(F.array_distinct(F.filter(F.split(_token(-1), ""), lambda c: c != "")))
    ceravolo = ~letters.eqNullSafe(F.array(F.lit("i"), F.lit("o"), F.lit("r")))
    return F.when(F.col("log_source") == "Ostovar", F.lower("log").startswith("atomic")).when(F.lower("log").startswith("bose"), True).when(F.col("log_source") == "Ceravolo", ceravolo).otherwise(False)


def atomic_only(results: DataFrame) -> DataFrame:
    logs = results.where(is_atomic()).select("log").distinct()
    return results.join(logs, "log", "left_semi")


def change_pattern() -> Column:
    """Last part of the log's name, or the one before a noise level; null for the Bose log."""
    last = F.when(_token(-1).rlike("^[0-9]+$"), _token(-2)).otherwise(_token(-1))
    table = F.create_map(*(F.lit(x) for kv in PATTERN_CODES.items() for x in kv))
    return F.when(F.col("log_source") == "Ceravolo", _token(-1)).when(F.col("log_source") == "Ostovar", F.coalesce(F.element_at(table, last), F.raise_error(F.concat(F.lit("unknown change pattern "), last)).cast("string"))).when(F.col("log_source") == "Bose", F.lit(None).cast("string")).otherwise(F.raise_error(F.concat(F.lit("unknown log source "), F.col("log_source"))).cast("string"))


def noise_level() -> Column:
    """As text; null for the Bose log."""
    return F.when(F.col("log_source") == "Ceravolo", F.regexp_extract("log", "noise([0-9]*)_", 1)).when(F.col("log_source") == "Ostovar", F.when(_token(-1).rlike("^[0-9]+$"), _token(-1)).otherwise("0"))


def is_noiseless() -> Column:
    return F.when(F.col("log_source") == "Ostovar", ~(F.col("log").endswith("_2") | F.col("log").endswith("_5"))).when(F.col("log_source") == "Ceravolo", _token(3) == "noise0").otherwise(True)


def preprocessed(results: DataFrame) -> DataFrame:
    """Without one algorithm, with short names, atomic logs only, with change_pattern and noise."""
    return atomic_only(renamed(excluded(results))).withColumns({"change_pattern": change_pattern(), "noise": noise_level()})


def noise_split(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of noise-free logs, and the others."""
    logs = results.where(is_noiseless()).select("log").distinct()
    return results.join(logs, "log", "left_semi"), results.join(logs, "log", "left_anti")


def duplicate_rows(results: DataFrame) -> DataFrame:
    """Rows that occur more than once, with their number."""
    keys = [F.to_json(F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in results.dtypes]
    flat = results.select(*keys)
    return flat.groupBy(*flat.columns).agg(F.count("*").alias("n")).where("n > 1")


def require_distinct(results: DataFrame) -> DataFrame:
    if not duplicate_rows(results).isEmpty():
        raise ValueError("the results contain duplicate rows")
    return results


def harmonic(*values: Column) -> Column:
    """Harmonic mean; a zero wins over NaN."""
    zero, nan = F.lit(False), F.lit(False)
    total = F.lit(0.0)
    for v in values:
        zero, nan = zero | (v == 0), nan | F.isnan(v)
        total = total + 1 / F.when((v == 0) | F.isnan(v), 1.0).otherwise(v)
    return F.when(zero, 0.0).when(nan, NAN).otherwise(len(values) / total)


def accuracy_by_params(counted: DataFrame, by: tuple[str, ...] = ("algorithm", "params")) -> DataFrame:
    """Micro-averaged precision, recall and F1 of each setting; no detections at all: F1 is 0.

    counted: with tp, fp, n_detected, n_actual.  fp counts duplicates or not, as `evaluation.with_tp_fp` was asked.
    """
    sums = counted.where("params is not null").groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum(F.col("tp") + F.col("fp")).alias("detected"), F.sum("n_actual").alias("positives"))
    p, r = evaluation.ratio(F.col("tp"), F.col("detected")), evaluation.ratio(F.col("tp"), F.col("positives"))
    return sums.withColumns({"precision": p, "recall": r}).withColumn("f1", harmonic(F.col("precision"), F.col("recall"))).select(*by, "precision", "recall", "f1")


def _best(scores: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Best setting; NaN counts as -1, of equal ones the least setting wins."""
    masked = F.nanvl(F.col(value), F.lit(-1.0))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(masked.desc(), "params"))
    return scores.withColumn("_r", rank).where("_r = 1").drop("_r")


def accuracy(counted: DataFrame, by: tuple[str, ...] = ("algorithm",)) -> DataFrame:
    return _best(accuracy_by_params(counted, (*by, "params")), "f1", by).select(*by, F.col("params").alias("best_params"), "precision", "recall", F.col("f1").alias("accuracy"))


def latency_by_params(assigned: DataFrame, lag: float = 200, min_support: int = 1, by: tuple[str, ...] = ("algorithm", "params")) -> DataFrame:
    """Score 1 - mean lag / lag of each setting; NaN under `min_support` pairs."""
    lags = F.aggregate("pairs", F.lit(0.0), lambda s, x: s + F.abs(x.d - x.a))
    sums = assigned.where("params is not null").groupBy(*by).agg(F.sum(lags).alias("s"), F.sum(F.size("pairs")).alias("n"))
    return sums.select(*by, F.when(F.col("n") >= max(1, min_support), 1 - F.col("s") / F.col("n") / lag).otherwise(NAN).alias("latency"))


def latency(assigned: DataFrame, lag: float = 200, min_support: int = 1, by: tuple[str, ...] = ("algorithm",)) -> DataFrame:
    best = _best(latency_by_params(assigned, lag, min_support, (*by, "params")), "latency", by)
    return best.select(*by, F.col("params").alias("best_params"), "latency", ((1 - F.col("latency")) * lag).alias("mean_lag"))


def recall_by_pattern(counted: DataFrame, by: tuple[str, ...] = ("algorithm", "params")) -> DataFrame:
    sums = counted.where("params is not null and change_pattern is not null").groupBy(*by, "change_pattern").agg(F.sum("tp").alias("tp"), F.sum("n_actual").alias("n"))
    return sums.select(*by, "change_pattern", evaluation.ratio(F.col("tp"), F.col("n")).alias("recall"))


def versatility_by_params(counted: DataFrame, by: tuple[str, ...] = ("algorithm", "params")) -> DataFrame:
    """Mean recall over the change patterns."""
    defined = F.when(~F.isnan("recall"), F.col("recall"))
    return recall_by_pattern(counted, by).groupBy(*by).agg(F.coalesce(F.avg(defined), F.lit(NAN)).alias("versatility"))


def versatility(counted: DataFrame, by: tuple[str, ...] = ("algorithm",)) -> DataFrame:
    rows = counted.where(F.col("log_source").isin("Ceravolo", "Ostovar"))
    return _best(versatility_by_params(rows, (*by, "params")), "versatility", by).select(*by, F.col("params").alias("best_params"), "versatility")


def scalability(results: DataFrame) -> DataFrame:
    """Mean seconds of a run, also as HH:MM:SS."""
    return results.groupBy("algorithm").agg(F.avg("seconds").alias("mean_seconds")).withColumn("scalability", scalars.format_duration(F.col("mean_seconds")))


def relative_scalability(results: DataFrame, lengths: DataFrame) -> DataFrame:
    """Milliseconds for each case and event.  lengths: log_source, log, n_cases, n_events (a row for each log)."""
    data = results.join(lengths, ["log_source", "log"])
    return data.groupBy("algorithm").agg((F.sum("seconds") / F.sum("n_cases") * 1000).alias("ms_per_case"), (F.sum("seconds") / F.sum("n_events") * 1000).alias("ms_per_event"))


def with_ms_per_event(results: DataFrame, lengths: DataFrame) -> DataFrame:
    return results.join(lengths, ["log_source", "log"]).withColumn("ms_per_event", F.col("seconds") * 1000 / F.col("n_events"))


def sensitivity(counted: DataFrame, lag: float = 200, min_support: int = 1) -> DataFrame:
    """algorithm, params, score: harmonic mean of F1, versatility and latency of each setting."""
    rows = counted.where(F.col("log_source").isin("Ceravolo", "Ostovar"))
    by = ["algorithm", "params"]
    joined = accuracy_by_params(counted).select(*by, "f1").join(versatility_by_params(rows), by).join(latency_by_params(counted, lag, min_support), by)
    return joined.select(*by, harmonic(F.col("f1"), F.col("versatility"), F.col("latency")).alias("score"))


def sensitivity_iqr(scores: DataFrame) -> DataFrame:
    q = lambda p: F.percentile("score", F.lit(p))
    return scores.where(~F.isnan("score")).groupBy("algorithm").agg((q(0.75) - q(0.25)).alias("iqr"))


def noise_means(counted: DataFrame, lag: float = 200, min_support: int = 1) -> DataFrame:
    """log_source, algorithm, noise, score: harmonic mean of the best accuracy, latency and versatility at each noise level."""
    by = ("log_source", "algorithm", "noise")
    rows = counted.where(F.col("log_source").isin("Ceravolo", "Ostovar"))
    a, b, c = accuracy(rows, by).select(*by, "accuracy"), latency(rows, lag, min_support, by).select(*by, "latency"), versatility(rows, by).select(*by, "versatility")
    return a.join(b, list(by)).join(c, list(by)).select(*by, harmonic(F.col("accuracy"), F.col("latency"), F.col("versatility")).alias("score"))


def robustness(means: DataFrame) -> DataFrame:
    """algorithm, robustness: area under the scores over noise, relative to the score without noise held; mean of the sources."""
    order = Window.partitionBy("log_source", "algorithm").orderBy("x")
    data = means.select("log_source", "algorithm", F.col("noise").cast("int").alias("x"), F.nanvl("score", F.lit(0.0)).alias("y"))
    steps = data.withColumn("area", (F.col("x") - F.lag("x").over(order)) * (F.col("y") + F.lag("y").over(order)) / 2)
    ends = steps.groupBy("log_source", "algorithm").agg(F.sum("area").alias("area"), F.max(F.when(F.col("x") == 0, F.col("y"))).alias("first"), (F.max("x") - F.min("x")).alias("span"))
    ideal = F.col("first") * F.col("span")
    auc = F.when(F.col("first").isNull(), F.raise_error("no score without noise").cast("double")).when(ideal == 0, 0.0).otherwise(F.coalesce("area", F.lit(0.0)) / ideal)
    return ends.withColumn("auc", auc).groupBy("algorithm").agg(F.avg("auc").alias("robustness"))


def pattern_distribution(results: DataFrame) -> DataFrame:
    """change_pattern, Ceravolo, Ostovar, Bose, total, percent: numbers of logs."""
    logs = results.select("log_source", "log", F.coalesce("change_pattern", F.lit("Mixed (Bose)")).alias("change_pattern")).distinct()
    table = logs.groupBy("change_pattern").pivot("log_source", ["Ceravolo", "Ostovar", "Bose"]).count().na.fill(0)
    total = F.col("Ceravolo") + F.col("Ostovar") + F.col("Bose")
    return table.withColumn("total", total).withColumn("percent", 100 * F.col("total") / F.sum("total").over(Window.partitionBy()))


def dataset_totals(results: DataFrame, lengths: DataFrame) -> DataFrame:
    """Logs, cases, events and drifts of the data set."""
    logs = results.groupBy("log_source", "log").agg(F.first(F.size("actual")).alias("drifts")).join(lengths, ["log_source", "log"])
    return logs.agg(F.count("*").alias("logs"), F.sum("n_cases").alias("cases"), F.sum("n_events").alias("events"), F.sum("drifts").alias("drifts"))


def mean_duration(results: DataFrame) -> DataFrame:
    """Mean of HH:MM:SS durations (column duration)."""
    return results.groupBy("algorithm").agg(scalars.format_duration(F.avg(scalars.parse_duration(F.col("duration")))).alias("mean_duration"))


def counted(results: DataFrame, lag: float = 200, count_duplicates: bool = True) -> DataFrame:
    return evaluation.with_tp_fp(evaluation.with_assignment(results, lag), lag, count_duplicates)


def measures(results: DataFrame, lengths: DataFrame, lag: float = 200, min_support: int = 1, count_duplicates: bool = True) -> DataFrame:
    """One row for each algorithm, from raw results."""
    data = counted(preprocessed(require_distinct(results)), lag, count_duplicates).cache()
    clean, _ = noise_split(data)
    out = accuracy(clean).select("algorithm", "accuracy")
    out = out.join(latency(clean, lag, min_support).select("algorithm", F.col("mean_lag").alias("latency")), "algorithm", "left")
    out = out.join(versatility(clean).select("algorithm", "versatility"), "algorithm", "left")
    out = out.join(scalability(data).select("algorithm", "scalability"), "algorithm", "left")
    out = out.join(relative_scalability(data, lengths), "algorithm", "left")
    out = out.join(sensitivity_iqr(sensitivity(clean, lag, min_support)), "algorithm", "left")
    return out.join(robustness(noise_means(data, lag, min_support)), "algorithm", "left")


def plot_inputs(data: DataFrame, lag: float = 200) -> dict[str, DataFrame]:
    """Long tables from which the figures are drawn; `data` is counted and preprocessed."""
    clean, _ = noise_split(data)
    long = accuracy(clean).select("algorithm", F.explode(F.create_map(F.lit("precision"), F.col("precision"), F.lit("recall"), F.col("recall"), F.lit("f1"), F.col("accuracy"))).alias("metric", "value"))
    lags = clean.select("algorithm", "params", F.explode("pairs").alias("p")).select("algorithm", "params", F.abs(F.col("p.d") - F.col("p.a")).alias("lag"))
    best = versatility(clean).select("algorithm", F.col("best_params").alias("params"))
    return {
        "accuracy": long,
        "latency": lags.join(latency(clean, lag).select("algorithm", F.col("best_params").alias("params")), ["algorithm", "params"], "left_semi"),
        "versatility": recall_by_pattern(clean.where(F.col("log_source").isin("Ceravolo", "Ostovar"))).join(best, ["algorithm", "params"], "left_semi"),
        "scalability": data.select("algorithm", (F.col("seconds") / 60).alias("minutes")),
        "sensitivity": sensitivity(clean, lag),
        "robustness": noise_means(data, lag),
        "f1_duration": evaluation.scatter_points(evaluation.with_scores(data), "algorithm", ["f1", "seconds"]),
        "radar": recall_by_pattern(clean).join(best, ["algorithm", "params"], "left_semi").select("algorithm", F.col("change_pattern").alias("axis"), F.coalesce(F.nanvl("recall", F.lit(0.0)), F.lit(0.0)).alias("radius")),
        "pareto": _with_front(evaluation.scatter_points(evaluation.with_scores(data), "algorithm", ["f1", "seconds"])),
        "roc": evaluation.roc_points(evaluation.with_scores(data), "params"),
    }


def _with_front(points: DataFrame) -> DataFrame:
    """Points with whether no other one is both more accurate and faster."""
    front = evaluation.pareto(points, ["f1", "seconds"], [False, True]).select("algorithm", F.lit(True).alias("on_front"))
    return points.join(front, "algorithm", "left").withColumn("on_front", F.coalesce("on_front", F.lit(False)))


def p_value_plot(p: DataFrame, detected: DataFrame, actual: DataFrame) -> DataFrame:
    """log_id, layer, x, y: a p-value series (log_id, pos, pval), and change points found and known (log_id, change_point) as lines at x."""
    lines = lambda t, layer: t.select("log_id", F.lit(layer).alias("layer"), F.col("change_point").cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    series = p.select("log_id", F.lit("p").alias("layer"), F.col("pos").cast("double").alias("x"), F.col("pval").alias("y"))
    return series.unionByName(lines(detected, "detected")).unionByName(lines(actual, "actual"))
