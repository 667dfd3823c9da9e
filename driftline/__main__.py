"""Command line: run a grid of detectors on a folder of logs, and evaluate result files.

    python -m driftline --logs LOGS --config grid.yml --out FOLDER [--runAndEvaluate] [--test-run] [--num-cores N]

Logs are XES files in a folder for each corpus.  Results go to FOLDER/results,
measures to FOLDER/measures, as CSV.  Without a choice the detectors are run.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import eventlog
from driftline.functions import scalars
from driftline.plans import grid, scoreboard
from driftline.sources import catalogue, results, xes


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftline", description="Concept drift detectors on event logs")
    p.add_argument("--evaluate", action="store_true", help="evaluate results that are there already")
    p.add_argument("--runApproaches", "--run-approaches", action="store_true", help="run all approaches on the logs (default)")
    p.add_argument("--runAndEvaluate", "--run-and-evaluate", action="store_true", help="both")
    p.add_argument("--test-run", action="store_true", help="the first setting of each approach on the first log")
    p.add_argument("--num-cores", type=int, help="runs at a time; default: all cores but two")
    p.add_argument("--logs", required=True, help="folder with a folder of XES files for each corpus")
    p.add_argument("--config", help="grid (YAML)")
    p.add_argument("--out", required=True, help="folder of results")
    p.add_argument("--lag", type=float, default=200, help="cases between a change point and its detection, at most")
    return p


def known_logs(events: DataFrame, paths: DataFrame) -> DataFrame:
    """log_id, log_source, actual of the logs that the catalogue knows."""
    return catalogue.with_ground_truth(paths).select(F.col("log").alias("log_id"), "log_source", "actual").join(events.select("log_id").distinct(), "log_id")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    runs = args.runApproaches or args.runAndEvaluate or not args.evaluate
    if runs and not args.config:
        raise SystemExit("--config is needed to run the detectors")
    spark = spark or SparkSession.builder.appName("driftline").getOrCreate()
    folders = f"{args.logs}/*/*"
    paths = spark.read.format("binaryFile").load(folders).select("path")
    events = xes.read(spark, folders).drop("attrs").persist()
    try:
        if runs:
            threads = args.num_cores or max(1, (os.cpu_count() or 3) - 2)
            found = grid.run_all(events, grid.load_config(args.config), known_logs(events, paths), args.lag, threads, args.test_run)
            results.write_csv(grid.as_results(found), f"{args.out}/results")
        if args.evaluate or args.runAndEvaluate:
            sources = paths.select(scalars.log_source(F.col("path")).alias("log_source"), scalars.log_name(F.col("path")).alias("log"))
            lengths = eventlog.log_lengths(events).withColumnRenamed("log_id", "log").join(sources, "log")
            rows = results.params_of(results.read_csv(spark, f"{args.out}/results"))
            results.write_csv(scoreboard.measures(rows, lengths, args.lag), f"{args.out}/measures")
    finally:
        events.unpersist()


if __name__ == "__main__":
    main()
