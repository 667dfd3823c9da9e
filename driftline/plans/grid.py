"""Parameter grids: registry of detectors, plans of runs, and timed result rows."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import eventlog
from driftline.functions import scalars
from driftline.operators import detectors, evaluation
from driftline.sources import results


@dataclass(frozen=True)
class Detector:
    """label: written to results.  params: result column of each argument.  find(events, **arguments) -> change points.

    longer_than: the argument that a log must have more cases than, or it gets
    no result row.  several: an argument whose list of values is worked off in
    one go, with the result column it fills; `find` then has that column too,
    and `several_values(**arguments)` are its values.
    """

    label: str
    params: dict[str, str]
    find: Callable[..., DataFrame]
    longer_than: str | None = None
    several: str | None = None
    several_values: Callable[..., list[float]] | None = None


_SLIDING = {"w": "Window Size", "step": "SW Step Size"}
_ADAPTIVE = {"least": "Min Adaptive Window", "most": "Max Adaptive Window", "alpha": "P-Value", "step": "ADWIN Step Size"}


def _distances(mrid: float, eps_modifiers: list[float]) -> list[float]:
    """eps is a share of mrid."""
    return [mrid * m for m in eps_modifiers]


REGISTRY: dict[str, Detector] = {
    "bose_j": Detector("Bose J", _SLIDING, lambda e, w, step: detectors.bose(e, w, "J", "ks", step)),
    "bose_wc": Detector("Bose WC", _SLIDING, lambda e, w, step: detectors.bose(e, w, "WC", "ks", step)),
    "martjushev_j": Detector("Martjushev J", {"w": "Window Size", "alpha": "P-Value"}, lambda e, w, alpha=0.55: detectors.martjushev(e, w, alpha, "J")),
    "martjushev_wc": Detector("Martjushev WC", {"w": "Window Size", "alpha": "P-Value"}, lambda e, w, alpha=0.55: detectors.martjushev(e, w, alpha, "WC")),
    "adwin_j": Detector("Martjushev ADWIN J", _ADAPTIVE, lambda e, least, most, alpha, step: detectors.adwin(e, least, most, alpha, step, "J"), "least"),
    "adwin_wc": Detector("Martjushev ADWIN WC", _ADAPTIVE, lambda e, least, most, alpha, step: detectors.adwin(e, least, most, alpha, step, "WC"), "least"),
    "emd": Detector("Earth Mover's Distance", _SLIDING, detectors.emd),
    "prodrift": Detector("Maaradji Runs", _SLIDING, lambda e, w, step: detectors.prodrift(e, w, step, 0.05)),
    "pgm": Detector("Process Graph Metrics", {"w": "Min Adaptive Window", "most": "Max Adaptive Window", "alpha": "P-Value"}, detectors.pgm),
    "rinv": Detector("Zheng DBSCAN", {"mrid": "MRID"}, lambda e, mrid, eps_modifiers: detectors.rinv_multi(e, mrid, _distances(mrid, eps_modifiers)).withColumnRenamed("eps", "Epsilon"), None, "Epsilon", _distances),
    "lcdd": Detector("LCDD", {"complete": "Complete-Window Size", "detection": "Detection-Window Size", "stable_period": "Stable Period"}, detectors.lcdd),
}

#: Names of parameters in published grids; a pair is a list of two values.
PARAMETER_NAMES = {"window_size": "w", "step_size": "step", "min_max_window_pair": "least,most", "pvalue": "alpha", "window_pairs": "complete,detection"}
#: Approaches of published grids, with the switch of each signal where there are two.
APPROACHES = {
    "Bose": {"bose_j": "do_j", "bose_wc": "do_wc"},
    "Martjushev": {"martjushev_j": "do_j", "martjushev_wc": "do_wc"},
    "Martjushev ADWIN": {"adwin_j": "do_j", "adwin_wc": "do_wc"},
    "Earthmover": {"emd": None},
    "Maaradji": {"prodrift": None},
    "ProcessGraph": {"pgm": None},
    "Zheng": {"rinv": None},
    "LCDD": {"lcdd": None},
}
RESULT = "algorithm string, log_source string, log string, detected array<double>, actual array<double>, n_cases long, seconds double"


def settings(grid: dict[str, list]) -> list[dict]:
    """Every combination.  A key `a,b` holds pairs for a and b."""
    out = []
    for values in itertools.product(*grid.values()):
        row = {}
        for key, value in zip(grid, values, strict=True):
            names = key.split(",")
            row |= dict(zip(names, value if len(names) > 1 else [value], strict=True))
        out.append(row)
    return out


def plan(spark: SparkSession, config: dict[str, dict], logs: DataFrame, test_run: bool = False) -> DataFrame:
    """approach, params (JSON), and a log's columns: settings x logs.  config: {approach: {param: values}}; test_run: the first of each."""
    rows = [(a, json.dumps(s, sort_keys=True)) for a, grid in config.items() for s in settings(grid)[: 1 if test_run else None]]
    table = spark.createDataFrame(rows, "approach string, params string")
    return table.crossJoin(logs.orderBy("log").limit(1) if test_run else logs)


def load_config(path: str) -> dict[str, dict]:
    """{approach of the registry: {argument: values}} from YAML: {approaches: {name: {enabled, meta-params, params}}}.

    Names are those of the registry or of published grids.
    """
    import yaml

    with open(path) as f:
        found = yaml.safe_load(f)["approaches"]
    out = {}
    for name, a in found.items():
        if not a.get("enabled", True):
            continue
        switches = a.get("meta-params") or {}
        for approach, switch in APPROACHES.get(name, {name: None}).items():
            if switch is not None and not switches.get(switch, True):
                continue
            grid = {PARAMETER_NAMES.get(k, k): v for k, v in a["params"].items()}
            if approach == "pgm" and "least,most" in grid:
                grid["w,most"] = grid.pop("least,most")
            out[approach] = grid
    return out


def run(events: DataFrame, approach: str, log: dict, n_cases: int, **params) -> list[dict]:
    """Result rows of one approach and setting on one log: one, or one for each value of the detector's `several`.

    log: log_id, log_source, actual.  The time is that of this log and setting alone, from the plan to the change points.
    """
    detector = REGISTRY[approach]
    if detector.longer_than is not None and n_cases <= params[detector.longer_than]:
        return []
    started = time.perf_counter()
    found = detector.find(events.where(F.col("log_id") == log["log_id"]), **params).collect()  # change points of one log
    seconds = time.perf_counter() - started
    row = {"algorithm": detector.label, "log_source": log["log_source"], "log": log["log_id"], "actual": log["actual"], "n_cases": n_cases, "seconds": seconds}
    row |= {column: float(params[argument]) for argument, column in detector.params.items() if params.get(argument) is not None}
    if detector.several is None:
        return [row | {"detected": sorted(r.change_point for r in found)}]
    return [row | {detector.several: v, "detected": sorted(r.change_point for r in found if r[detector.several] == v)} for v in detector.several_values(**params)]


def run_all(events: DataFrame, config: dict[str, dict], logs: DataFrame, lag: float = 200, threads: int = 1, test_run: bool = False) -> DataFrame:
    """Evaluated rows of the whole plan, `threads` runs at a time; parameters that an approach lacks are null.

    logs: log_id, log_source, actual.  A run's rows come to the driver: its change points and its time.
    """
    spark = events.sparkSession
    todo = plan(spark, config, logs.withColumn("log", F.col("log_id")), test_run).collect()  # settings x logs
    sizes = {r.log_id: r.n_cases for r in eventlog.log_lengths(events).collect()}  # a row for each log
    one = lambda r: run(events, r.approach, r.asDict(), sizes.get(r.log_id, 0), **json.loads(r.params))
    with ThreadPoolExecutor(max(1, threads)) as pool:
        rows = [row for part in pool.map(one, todo) for row in part]
    columns = [c for d in (REGISTRY[a] for a in config) for c in (*d.params.values(), *([d.several] if d.several else []))]
    columns = list(dict.fromkeys(columns))
    schema = RESULT + "".join(f", `{c}` double" for c in columns)
    names = [f.split()[0] for f in RESULT.split(", ")] + columns
    table = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
    return evaluation.evaluated(table.withColumn("seconds_per_case", F.col("seconds") / F.col("n_cases")), lag)


def as_results(evaluated: DataFrame) -> DataFrame:
    """Rows of `run_all` with the columns of result files."""
    named = {"algorithm": "Algorithm", "log_source": "Log Source", "log": "Log", "detected": "Detected Changepoints", "actual": "Actual Changepoints for Log", "f1": "F1-Score", "avg_lag": "Average Lag", "seconds": "Duration (Seconds)", "seconds_per_case": "Seconds per Case"}
    kept = [F.col(a).alias(b) for a, b in named.items()]
    kept.append(scalars.format_duration(F.col("seconds")).alias("Duration"))
    return evaluated.select(*kept, *(F.col(f"`{c}`") for c in evaluated.columns if c in results.PARAMETERS))
