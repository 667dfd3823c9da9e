"""Result files: reading with list and interval columns, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import scalars

#: Columns of result files; parameters of single approaches may be absent.
COLUMNS = {
    "Algorithm": "string",
    "Log Source": "string",
    "Log": "string",
    "Detected Changepoints": "string",
    "Actual Changepoints for Log": "string",
    "F1-Score": "double",
    "Average Lag": "double",
    "Duration": "string",
    "Duration (Seconds)": "double",
    "Seconds per Case": "double",
    "Window Size": "double",
    "SW Step Size": "double",
    "P-Value": "double",
    "Min Adaptive Window": "double",
    "Max Adaptive Window": "double",
    "ADWIN Step Size": "double",
    "MRID": "double",
    "Epsilon": "double",
    "Complete-Window Size": "double",
    "Detection-Window Size": "double",
    "Stable Period": "double",
}
PARAMETERS = list(COLUMNS)[10:]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw columns, with list cells as arrays and the duration in seconds besides."""
    raw = spark.read.option("header", True).option("multiLine", False).csv(path)
    for name, kind in COLUMNS.items():
        column = F.col(f"`{name}`") if name in raw.columns else F.lit(None)
        raw = raw.withColumn(name, F.expr(f"try_cast(`{name}` as {kind})") if name in raw.columns else column.cast(kind))
    for name in ("Detected Changepoints", "Actual Changepoints for Log"):
        raw = raw.withColumn(name, scalars.parse_list(F.col(f"`{name}`")))
    return raw.withColumn("duration_seconds", scalars.parse_duration(F.col("Duration")))


def params_of(raw: DataFrame) -> DataFrame:
    """`raw` under the scoreboard's names; params: the parameters that are set, as sorted JSON."""
    params = F.to_json(F.struct(*(F.col(f"`{p}`").alias(p) for p in PARAMETERS)))
    return raw.select(
        F.col("Algorithm").alias("algorithm"), F.col("`Log Source`").alias("log_source"), F.col("Log").alias("log"), F.col("`Detected Changepoints`").alias("detected"),
        F.col("`Actual Changepoints for Log`").alias("actual"), F.col("`Duration (Seconds)`").alias("seconds"), F.col("Duration").alias("duration"), params.alias("params"),
    )


def read_many(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Files of several approaches under one name each: {algorithm: path}; columns that one lacks are null."""
    out = None
    for algorithm, path in sources.items():
        part = read_csv(spark, path).withColumn("Algorithm", F.lit(algorithm))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


#: Folders of older result files, and the label of each of their options; a plain label holds for all.
LEGACY_FILE, LEGACY_OPTION = "evaluation_results.csv", "Algorithm/Options"
LEGACY = {
    "Bose": {"Bose Average J": "Bose J", "Bose Average WC": "Bose WC"},
    "Martjushev": {"Martjushev Recursive Bisection; Average J; p=0.55": "Martjushev J", "Martjushev Recursive Bisection; Average WC; p=0.55": "Martjushev WC"},
    "Maaradji": "ProDrift",
    "Earthmover": None,
    "ProcessGraph": "Process Graphs",
    "Zheng": "Zheng",
}


def read_legacy(spark: SparkSession, folder: str) -> DataFrame:
    """Results in the older layout, a file for each approach, under today's labels (Algorithm).

    Options that no label is known for are left out where an approach has several; those of Earthmover stay as they are.
    """
    out = None
    for approach, labels in LEGACY.items():
        path = f"{folder}/{approach}/{LEGACY_FILE}"
        option = F.col(f"`{LEGACY_OPTION}`")
        names = spark.read.option("header", True).csv(path).withColumnRenamed(LEGACY_OPTION, "Algorithm").columns
        raw = read_csv(spark, path)
        if isinstance(labels, dict):
            label = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[option]
        else:
            label = option if labels is None else F.lit(labels)
        part = raw.withColumn("Algorithm", label).where("Algorithm is not null").drop(LEGACY_OPTION).select(*dict.fromkeys([*(n for n in names if n != "Algorithm"), *COLUMNS, "duration_seconds"]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays become JSON cells."""
    cells = [F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*cells).write.option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """by: partition columns, so that parts of different runs never overwrite each other."""
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
