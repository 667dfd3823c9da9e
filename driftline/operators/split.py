"""Splitting a log into sub-logs by time or by number of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def _micros(column: str):
    return F.unix_micros(F.col(column))


def by_case_groups(events: DataFrame, group_size: int) -> DataFrame:
    """`events` with sublog: consecutive cases, `group_size` in each, the last one partial."""
    return events.withColumn("sublog", F.floor(F.col("case_idx") / group_size))


def by_start_time(events: DataFrame, interval: int = DAY) -> DataFrame:
    """`events` with sublog: whole intervals from the log's first event to the case's start."""
    starts = events.groupBy("log_id", "case_idx").agg(F.min(_micros("ts")).alias("start"))
    first = starts.groupBy("log_id").agg(F.min("start").alias("first"))
    cases = starts.join(first, "log_id").select("log_id", "case_idx", F.floor((F.col("start") - F.col("first")) / interval).alias("sublog"))
    return events.join(cases, ["log_id", "case_idx"])


def _midnight(events: DataFrame) -> DataFrame:
    return events.groupBy("log_id").agg(F.unix_micros(F.date_trunc("day", F.min("ts"))).alias("midnight"))


def by_trim(events: DataFrame, interval: int = DAY) -> DataFrame:
    """`events` with sublog: each event in the window that it falls in, counted from midnight of the first day.

    Windows include both bounds, so an event on a bound is in two of them.
    """
    data = events.join(_midnight(events), "log_id")
    at = _micros("ts") - F.col("midnight")
    k = F.floor(at / interval)
    both = F.when((at % interval == 0) & (k > 0), F.array(k - 1, k)).otherwise(F.array(k))
    return data.withColumn("sublog", F.explode(both)).drop("midnight")


def by_intersection(events: DataFrame, interval: int = DAY) -> DataFrame:
    """`events` with sublog: whole cases, in every window that they overlap."""
    spans = events.groupBy("log_id", "case_idx").agg(F.min(_micros("ts")).alias("low"), F.max(_micros("ts")).alias("high"))
    spans = spans.join(_midnight(events), "log_id")
    k = lambda c: F.floor((F.col(c) - F.col("midnight")) / interval)
    cases = spans.select("log_id", "case_idx", F.explode(F.sequence(k("low"), k("high"))).alias("sublog"))
    return events.join(cases, ["log_id", "case_idx"])


def sorted_by_time(events: DataFrame) -> DataFrame:
    """Events of each case renumbered by timestamp."""
    place = F.row_number().over(Window.partitionBy("log_id", "case_idx").orderBy("ts", "evt_idx")) - 1
    return events.withColumn("evt_idx", place.cast("long"))


def sublog_sizes(split: DataFrame) -> DataFrame:
    """log_id, sublog, n_cases, n_events."""
    return split.groupBy("log_id", "sublog").agg(F.countDistinct("case_idx").alias("n_cases"), F.count("*").alias("n_events"))
