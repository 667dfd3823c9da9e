"""XES event logs (plain or gzip) through Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import scalars

_CELL = "array<struct<_key:string,_value:string>>"
_EVENT = f"struct<string:{_CELL},date:{_CELL},int:{_CELL},float:{_CELL},boolean:{_CELL},id:{_CELL}>"
#: Inference would make structs of single children, so the schema is given.
SCHEMA = f"string {_CELL}, date {_CELL}, int {_CELL}, event array<{_EVENT}>"

#: Attribute names of the XES standard extensions.
NAME, TIME, START = "concept:name", "time:timestamp", "start_timestamp"


def _attributes(e: Column, kinds: tuple[str, ...] = ("string", "date", "int", "float", "boolean", "id")) -> Column:
    cells = F.concat(*(F.coalesce(e[k], F.array().cast(_CELL)) for k in kinds))
    return F.map_from_entries(F.array_distinct(F.transform(F.filter(cells, lambda c: c["_key"].isNotNull()), lambda c: F.struct(c["_key"], c["_value"]))))


def read(spark: SparkSession, path: str, activity: str = NAME, row_order: bool = True) -> DataFrame:
    """Events (with attrs) of the log files at `path`; cases in file order.

    A file is one log, named by its file name, and XML is read a file at a
    time, so the place of a trace in its file gives the order.
    """
    raw = spark.read.format("xml").option("rowTag", "trace").schema(SCHEMA).load(path)
    rows = raw.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"), "string", "event")
    rows = rows.withColumn("log_id", scalars.log_name(F.col("file")))
    name = F.filter("string", lambda c: c["_key"] == NAME)
    case = F.coalesce(F.try_element_at(name, F.lit(1))["_value"], F.col("place").cast("string"))
    from driftline import eventlog

    cases = eventlog.numbered(rows.select("log_id", "place"), ["log_id"], ["place"], "case_idx")
    flat = rows.select("log_id", "place", case.alias("case_id"), F.posexplode(F.coalesce("event", F.array().cast(f"array<{_EVENT}>"))).alias("evt_idx", "e"))
    attrs = flat.select("log_id", "place", "case_id", F.col("evt_idx").cast("long").alias("evt_idx"), _attributes(F.col("e")).alias("attrs"))
    get = lambda k: F.try_element_at("attrs", F.lit(k))
    out = attrs.join(cases, ["log_id", "place"])
    return out.select("log_id", "case_id", "case_idx", "evt_idx", get(activity).alias("activity"), F.try_to_timestamp(get(TIME)).alias("ts"), F.try_to_timestamp(get(START)).alias("start_ts"), "attrs")
