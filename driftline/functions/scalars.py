"""Column functions: dates, durations, list cells, log names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def midnight(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def time_difference(a: Column, b: Column, scale: str = "seconds") -> Column:
    """b - a in minutes, hours or days; anything else: seconds."""
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6 / {"minutes": 60, "hours": 3600, "days": 86400}.get(scale, 1)


def parse_duration(text: Column) -> Column:
    """Seconds of HH:MM:SS."""
    part = lambda k: F.element_at(F.split(text, ":"), k).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def format_duration(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds, beginning again after a day."""
    s = F.pmod(F.floor(seconds).cast("long"), F.lit(86400))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))


def parse_list(text: Column, kind: str = "double") -> Column:
    """A list cell of numbers; nan becomes a missing element."""
    return F.from_json(F.regexp_replace(text, "(?i)nan", "null"), f"array<{kind}>")


def format_list(values: Column) -> Column:
    return F.to_json(values)


def log_name(path: Column) -> Column:
    return F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\."), 1)


def log_source(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)
