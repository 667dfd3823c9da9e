"""Helpers that several corpus operators use: shared storage, bounded broadcasts, Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes, about, of an Arrow batch handed to Python; texts may be long, so batches stay short.
ARROW_ROWS, ARROW_BYTES = 2000, 4 << 20

T = TypeVar("T")

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share.

    Read from `spark.checkpoint.dir`; only where that is unset on one machine
    (tests) a temporary folder of this process stands in, which goes with it.
    On a cluster the setting is required.
    """
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; driver and executors need a shared folder")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="driftline-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return "file://" + _local_dir


def written(df: DataFrame, what: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    This cuts the lineage and survives lost executors.  Folders carry a unique
    name; `drop_written` removes them once their readers are done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftline/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftline_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table of `written` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._driftline_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let the files of finished shuffles go now, not when the driver happens to collect its garbage; a job in between, since the last one's are held."""
    gc.collect()
    spark.range(1).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jvm.System.gc()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers from 0 on, each in as few bytes an item as its greatest needs, byte by byte, compressed."""
    parts, sizes = [], []
    for a in arrays:
        width = (int(a.max(initial=0)).bit_length() + 7) // 8
        parts.append(a.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes())
        sizes += [len(a), width]
    data = b"".join(parts)
    return np.array([len(arrays), *sizes], "<i8").tobytes() + pa.compress(data, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of `pack`, as uint64."""
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    sizes = np.frombuffer(blob, "<i8", 2 * n, 8).reshape(n, 2)
    data = np.frombuffer(pa.decompress(blob[8 + 16 * n :], int((sizes[:, 0] * sizes[:, 1]).sum()), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for length, width in sizes.tolist():
        a = np.zeros((length, 8), np.uint8)
        a[:, :width] = data[at : at + length * width].reshape(width, length).T
        out.append(a.view("<u8").reshape(-1))
        at += length * width
    return out


def of_lowest_hash(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most `n` different rows of `columns`, those of lowest hash; repeated rows count once.

    Rows above a cut, estimated from the number of different hashes, are left
    out first, so that about `n` rows in all reach the last task, not `n` from
    each one before it.
    """
    rows = df.select(F.xxhash64(*columns).alias("_hash"), *columns)
    different = rows.agg(F.approx_count_distinct("_hash", 0.02)).first()[0]
    share = (1.2 * n + 1000) / max(different, 1)
    if share < 1:
        rows = rows.where(F.col("_hash") < int(share * 2.0**64) - (1 << 63))
    return rows.distinct().orderBy("_hash", *columns).limit(n).select(*columns)


def most_frequent(df: DataFrame, count: str, n: int) -> DataFrame:
    """The rows of greatest `count` (over 0), at most `n` of them: all those from some bucket of counts up.

    Buckets have a width of 1/16 in log2 of the count: a thousand rows, whatever the counts.
    """
    bucket = F.floor(F.log2(F.col(count)) * 16)
    sizes = sorted(((r.b, r.n) for r in df.where(F.col(count) > 0).groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    held, least = 0, None
    for b, size in sizes:
        held += size
        if held > n:
            break
        least = b
    return df.where("false") if least is None else df.where((F.col(count) > 0) & (bucket >= least))


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], T]) -> T:
    """What `make` gives, made once by a Python worker that goes on with the same operator; a worker holds one such thing."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give what this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def make_room(key: Hashable = None) -> None:
    """Let go what this worker `held` for another operator: all but `key`."""
    if _held and key not in _held:
        _held.clear()
        release()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], key: Hashable = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, for Python workers, which stay for the next operators: with room made before it, and what it freed given back behind it."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(key)
        yield from run(batches)
        release()

    return lean_run


def column_free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores appended until no column of `df` has it (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def binary_chunks(column: pa.Array | pa.ChunkedArray, limit: int = 4 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices `(first, last, values)` of a text column with about `limit` bytes each; nulls become b""."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield first, last, [v or b"" for v in column.slice(first, last - first).to_pylist()]
        first = last


def grouped_stream(df: DataFrame, key: str, handle: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """Apply `handle` to the rows of each value of `key`, one group in memory at a time.

    Like a grouped map, without its cost for each group: rows are dealt by
    `key`, sorted within partitions and streamed.  Groups must be of bounded
    size; the callers see to that.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        out: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and group[0][key] != row[key]:
                    out.extend(handle(group))
                    group = []
                    if len(out) > 5000:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)
                        out = []
                group.append(row)
        if group:
            out.extend(handle(group))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(lean(run), schema)
