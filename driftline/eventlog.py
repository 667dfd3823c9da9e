"""Event logs as DataFrames: events, traces, variants, activities, lengths.

An events table has log_id, case_id, case_idx (0-based place of the case in
its log), evt_idx (0-based place in the case), activity and, where known, ts
and start_ts.  Order is always explicit in case_idx and evt_idx.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, FractionalType, IntegralType, StringType, TimestampNTZType, TimestampType

EVENT_COLUMNS = ("log_id", "case_id", "case_idx", "evt_idx", "activity")


def _bucket(df: DataFrame, column: str) -> Column:
    """A coarse key that sorts as `column` does, for numbering in two levels."""
    kind = df.schema[column].dataType
    if isinstance(kind, IntegralType):
        return F.floor(F.col(column) / 65536)
    if isinstance(kind, TimestampType | TimestampNTZType):
        return F.date_trunc("hour", column)
    if isinstance(kind, DecimalType | FractionalType):
        return F.floor(F.col(column) / 65536)
    if isinstance(kind, DateType):
        return F.trunc(column, "month")
    if isinstance(kind, StringType):
        return F.substring(column, 1, 6)
    return F.lit(0)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], to: str) -> DataFrame:
    """`df` with the 0-based position of each row in its group, without sorting a group in one task.

    Rows are numbered within buckets of the first order column; the buckets'
    counts, a small table, give the offsets.
    """
    data = df.withColumn("_b", _bucket(df, order[0]))
    counts = data.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, F.col("_b"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_o"))
    within = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)) - 1
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*by, "_b")]
    out = data.withColumn("_w", within).alias("x").join(offsets.alias("o"), same)
    return out.select(*(f"x.{c}" for c in df.columns), (F.col("_w") + F.col("_o")).cast("long").alias(to))


def from_table(df: DataFrame, case: str, activity: Column | str, order_by: Sequence[str], log_id: str = "log", case_order: Sequence[str] | None = None, ts: str | None = None, start_ts: str | None = None, dense: bool = True) -> DataFrame:
    """Events of a flat table; cases are numbered by `case_order` (default: the case key itself).

    dense=False: case_idx is the case key itself, which tells cases apart and is
    no place; enough for relations, activities and lengths, and one shuffle.
    """
    activity = F.col(activity) if isinstance(activity, str) else activity
    if not dense:
        extra = [F.col(c).cast("timestamp").alias(n) for c, n in ((ts, "ts"), (start_ts, "start_ts")) if c]
        place = F.row_number().over(Window.partitionBy(case).orderBy(*order_by)) - 1
        return df.where(F.col(case).isNotNull()).select(F.lit(log_id).alias("log_id"), F.col(case).cast("string").alias("case_id"), F.col(case).alias("case_idx"), place.cast("long").alias("evt_idx"), activity.alias("activity"), *extra)
    keys = list(case_order or [case])
    cases = numbered(df.groupBy(case).agg(*(F.min(k).alias(k) for k in keys if k != case), F.count("*").alias("_n")).drop("_n").withColumn("log_id", F.lit(log_id)), ["log_id"], [*keys, *([case] if case not in keys else [])], "case_idx")
    extra = [F.col(c).cast("timestamp").alias(n) for c, n in ((ts, "ts"), (start_ts, "start_ts")) if c]
    place = F.row_number().over(Window.partitionBy("_case").orderBy(*order_by)) - 1  # by the column of the join, which then needs no other shuffle
    flat = df.withColumn("_case", F.col(case)).select("_case", place.cast("long").alias("evt_idx"), activity.alias("activity"), *extra)
    out = flat.join(cases.select(F.col(case).alias("_case"), "log_id", "case_idx"), "_case")
    return out.select("log_id", F.col("_case").cast("string").alias("case_id"), "case_idx", "evt_idx", "activity", *(n for c, n in ((ts, "ts"), (start_ts, "start_ts")) if c))


def traces(events: DataFrame) -> DataFrame:
    """log_id, case_idx, case_id, trace, n_events: the activity sequence of each case."""
    pairs = F.array_sort(F.collect_list(F.struct("evt_idx", "activity")))
    return events.groupBy("log_id", "case_idx").agg(F.first("case_id").alias("case_id"), F.transform(pairs, lambda x: x.activity).alias("trace"), F.count("*").alias("n_events"))


def variants(trace_table: DataFrame) -> DataFrame:
    """log_id, variant_id, trace, freq: the distinct traces; ids by first appearance."""
    seen = trace_table.groupBy("log_id", "trace").agg(F.count("*").alias("freq"), F.min("case_idx").alias("first_case"))
    return numbered(seen, ["log_id"], ["first_case"], "variant_id").select("log_id", "variant_id", "trace", "freq")


def case_variants(trace_table: DataFrame) -> DataFrame:
    """log_id, case_idx, variant_id."""
    return trace_table.join(variants(trace_table), ["log_id", "trace"]).select("log_id", "case_idx", "variant_id")


def activities(events: DataFrame) -> DataFrame:
    """The distinct activities of each log."""
    return events.select("log_id", "activity").distinct()


def activities_of_all(events: DataFrame) -> DataFrame:
    """The distinct activities of several logs together."""
    return events.select("activity").distinct()


def num_activities(events: DataFrame) -> DataFrame:
    return activities(events).groupBy("log_id").agg(F.count("*").alias("n_activities"))


def log_lengths(events: DataFrame) -> DataFrame:
    """Cases and events of each log."""
    per_case = events.groupBy("log_id", "case_idx").agg(F.count("*").alias("n"))
    return per_case.groupBy("log_id").agg(F.count("*").alias("n_cases"), F.sum("n").alias("n_events"))


PACKED = "log_id string, chunk long, names array<string>, lengths binary, codes binary"
#: Cases in a row of a packed log.
PACK = 20_000


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs, and compressed."""
    size = next(k for k in (1, 2, 4, 8) if x.max(initial=0) < 1 << (8 * k))
    return bytes([size]) + zlib.compress(x.astype(f"u{size}").tobytes(), 1)


def spread(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), f"u{packed[0]}").astype(np.int64)


def packed(events: DataFrame, chunk: int = PACK) -> DataFrame:
    """log_id, chunk, names, lengths, codes: the traces of `chunk` cases in a row, events as places in the row's names.

    For detectors that pass through a log in one task: a byte or two for an event.
    """

    def run(table: pa.Table) -> pa.Table:
        k = table["chunk"][0].as_py()
        names = table["activity"].combine_chunks().dictionary_encode(null_encoding="encode")
        case = table["case_idx"].to_numpy() - k * chunk
        codes = names.indices.to_numpy()[np.lexsort((table["evt_idx"].to_numpy(), case))]
        row = [table["log_id"][0].as_py(), k, names.dictionary.to_pylist(), squeezed(np.bincount(case)), squeezed(codes)]
        return pa.table([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()), strict=True)], ["log_id", "chunk", "names", "lengths", "codes"])

    data = events.select("log_id", "case_idx", "evt_idx", F.col("activity").cast("string").alias("activity"))
    return data.withColumn("chunk", F.floor(F.col("case_idx") / chunk)).groupBy("log_id", "chunk").applyInArrow(run, PACKED)


class Packed:
    """One log of `packed`, unpacked a row at a time; some rows are held, the latest used.  Made for a way through the cases that seldom turns back."""

    def __init__(self, table: pa.Table, chunk: int = PACK, held: int = 4):
        self.table, self.chunk, self.most = table.sort_by("chunk"), chunk, held
        self.at = {k: i for i, k in enumerate(self.table["chunk"].to_pylist())}
        found = {x for names in self.table["names"].to_pylist() for x in names}
        self.names = sorted(found - {None}) + [None] * (None in found)
        self.numbers = {x: i for i, x in enumerate(self.names)}
        last = max(self.at)
        self.n = last * chunk + len(spread(self.table["lengths"][self.at[last]].as_py()))
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each case of a row begins in its codes (and the end), and the codes, places in `names`."""
        if k not in self.held:
            if len(self.held) >= self.most:
                del self.held[next(iter(self.held))]
            lengths, codes = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if k in self.at:
                i = self.at[k]
                lengths = spread(self.table["lengths"][i].as_py())
                own = np.array([self.numbers[x] for x in self.table["names"][i].as_py()], np.int64)
                codes = own[spread(self.table["codes"][i].as_py())]
            full = np.zeros(min(self.chunk, self.n - k * self.chunk), np.int64)
            full[: len(lengths)] = lengths
            self.held[k] = np.concatenate([[0], np.cumsum(full)]), codes
        return self.held[k]

    def part(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of the cases from `low` to below `high`."""
        begins, codes, size = [np.zeros(1, np.int64)], [], 0
        for k in range(low // self.chunk, -(-high // self.chunk)):
            b, c = self.row(k)
            i, j = max(0, low - k * self.chunk), min(self.chunk, high - k * self.chunk)
            begins.append(b[i + 1 : j + 1] - b[i] + size)
            codes.append(c[b[i] : b[j]])
            size += b[j] - b[i]
        return np.concatenate(begins), np.concatenate([*codes, np.zeros(0, np.int64)])
