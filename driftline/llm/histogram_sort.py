"""Sharding by histogram sort, with DataFrame operations only.

Rows are ordered by (hash of the text, doc_id), so equal texts lie together,
and cut into shards of near equal bytes.  The cuts are found by counting:
each round counts exact bytes in the buckets between candidate boundaries
(probes), over all partitions, and every splitter whose bucket is still too
large gets new probes within that bucket, until it is within tolerance of its
target or a single key is left.  Inside a large group of equal texts the probes
go on over doc_id.  Then rows are exchanged once, by piece: each shard is cut
into several pieces of equal bytes, so that a task's share does not grow with
the shard.  Slots follow from the row number in the piece and the counts of
the pieces before.

Law `bytes`: a shard's bytes differ from the mean by the tolerance and the
largest row at most, unless rows repeat both text and doc_id: such rows are one
key and stay together.

What the driver sees in a round is a row for each splitter: the bucket that its
target falls in, picked where the counts are.  Broadcast are the splitters and
their probes, some 100 bytes each; with `piece_bytes` to a piece that is 40 MB
for 100 TB.

Defined results: a null text has no bytes and the checksum of the empty text;
a null doc_id sorts first; rows equal in both keys have any order between
them; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Bits below the first digit of the signed 64-bit hash, and probes for each later interval.
LOW_BITS, PROBES = 52, 256
LEAST = -(1 << 63)


@dataclass(frozen=True)
class Interval:
    """Keys whose hash is in [low, high] or, if `by_id`, with hash `low` and id in [id_low, id_high]; bytes of the keys before."""

    low: int
    high: int
    by_id: bool
    id_low: int
    id_high: int
    before: int

    @property
    def width(self) -> int:
        size = self.id_high - self.id_low + 1 if self.by_id else self.high - self.low + 1
        return -(-size // PROBES)


def _literal(like: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small table made by an expression."""
    held = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema.replace(', ', ',')}>>".replace(" ", ":"))
    return like.sparkSession.range(1).select(F.inline(held))


def _buckets(keys: DataFrame, intervals: list[Interval]) -> DataFrame:
    """(k, before, b, bytes, h0, h1, i0, i1): exact bytes and outermost keys of the buckets of each interval."""
    measures = [F.sum("size").alias("bytes"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("i").alias("i0"), F.max("i").alias("i1")]
    if intervals[0].width == 1 << 56:  # all keys
        return keys.groupBy(F.shiftright("h", LOW_BITS).alias("b")).agg(*measures).select(F.lit(0).alias("k"), F.lit(0).cast("long").alias("before"), "b", "bytes", "h0", "h1", "i0", "i1")
    rows = [{"k": k, "digit": x.low >> LOW_BITS, "low": x.low, "high": x.high, "by_id": x.by_id, "id_low": x.id_low, "id_high": x.id_high, "before": x.before, "width": str(x.width)} for k, x in enumerate(intervals)]
    table = _literal(keys, rows, "k int, digit long, low long, high long, by_id boolean, id_low long, id_high long, before long, width string")
    inside = (F.shiftright("h", LOW_BITS) == F.col("digit")) & F.col("h").between(F.col("low"), F.col("high")) & (~F.col("by_id") | F.col("i").between(F.col("id_low"), F.col("id_high")))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    at = F.floor(F.when(F.col("by_id"), wide("i") - wide("id_low")).otherwise(wide("h") - wide("low")) / wide("width")).cast("long")
    return keys.join(F.broadcast(table), inside).groupBy("k", "before", at.alias("b")).agg(*measures)


def _splitters(keys: DataFrame, parts: int, tolerance: float) -> list[tuple[int, int]]:
    """Keys (hash, id) at which parts 1, 2, ... begin; `keys` has h, i, size."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    near = max(1.0, tolerance * total / parts)
    found: dict[int, tuple[int, int]] = {}
    waiting = {j: Interval(LEAST, -LEAST - 1, False, 0, 0, 0) for j in range(1, parts)} if total else {}
    while waiting:
        intervals = sorted(set(waiting.values()), key=lambda x: (x.low, x.id_low))
        number = {x: k for k, x in enumerate(intervals)}
        targets = _literal(keys, [{"k": number[x], "j": j, "target": j * total / parts} for j, x in waiting.items()], "k int, j int, target double")
        # of each interval's buckets, with the bytes up to each: the one that a target falls in
        order = Window.partitionBy("k").orderBy("b")
        counted = _buckets(keys, intervals).withColumns({"after": F.col("before") + F.sum("bytes").over(order), "last": F.lead("b").over(order).isNull()}).withColumn("until", F.col("after") - F.col("bytes"))
        inside = (F.col("target") > F.col("until")) | (F.col("until") == F.col("before"))
        picked = counted.join(F.broadcast(targets), "k").where(inside & ((F.col("target") <= F.col("after")) | F.col("last")))
        now, waiting = waiting, {}
        for r in picked.collect():  # a row for each splitter
            low_off, high_off = abs(r.target - r.until), abs(r.after - r.target)
            by_id = now[r.j].by_id
            if min(low_off, high_off) <= near or (r.h0 == r.h1 and r.i0 == r.i1):
                if low_off <= high_off:
                    found[r.j] = (r.h0, r.i0 if by_id else LEAST)
                else:
                    found[r.j] = (r.h1, r.i1 + 1) if by_id else (r.h1 + 1, LEAST)
            elif r.h0 == r.h1:
                waiting[r.j] = Interval(r.h0, r.h0, True, r.i0, r.i1, r.until)
            else:
                waiting[r.j] = Interval(r.h0, r.h1, False, 0, 0, r.until)
    return [found[j] for j in sorted(found)]


def shards(rows: DataFrame, n_shards: int, key: str, size: str, text_hash: str, tolerance: float = 0.001, pieces: int = 8, piece_bytes: int = 256 << 20) -> DataFrame:
    """`rows` with the columns shard (int) and slot (long, gapless from 0 in each shard).

    key: a long column, size: its bytes, text_hash: a long column by which equal
    texts are equal.  pieces: tasks for each shard at least; more where a piece
    would pass `piece_bytes`.  The input's own columns shard and slot, if any,
    are replaced.
    """
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    packed = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    rows = written(rows.select(packed, F.coalesce(F.col(text_hash), F.lit(0)).alias("h"), F.coalesce(F.col(key), F.lit(LEAST)).alias("i"), F.col(size).cast("long").alias("size")), "rows")
    keys = rows.select("h", "i", "size")
    total = keys.agg(F.sum("size")).first()[0] or 0
    pieces = max(pieces, -(-total // (n_shards * piece_bytes)))
    splitters = _splitters(keys, n_shards * pieces, tolerance)
    # for each first digit: the pieces begun before it, and the splitters within it
    within: dict[int, list[dict]] = {}
    for h, i in splitters:
        within.setdefault(h >> LOW_BITS, []).append({"h": h, "i": i})
    table, begun = [], 0
    for digit in range(-(1 << 63 - LOW_BITS), 1 << 63 - LOW_BITS):
        table.append({"digit": digit, "begun": begun, "within": within.get(digit, [])})
        begun += len(within.get(digit, []))
    digits = _literal(rows, table, "digit long, begun int, within array<struct<h long, i long>>")
    passed = F.size(F.filter("within", lambda s: (s.h < F.col("h")) | ((s.h == F.col("h")) & (s.i <= F.col("i")))))
    placed = rows.drop("size").withColumn("digit", F.shiftright("h", LOW_BITS)).join(F.broadcast(digits), "digit").select("row", "h", "i", (F.col("begun") + passed).alias("piece"))
    before = placed.groupBy("piece").agg(F.count("*").alias("n")).withColumn("shard", F.expr(f"cast(piece div {pieces} as int)"))
    before = before.select("piece", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("piece").orderBy("h", "i")) - 1)
    out = numbered.join(F.broadcast(before), "piece")  # a row for each piece
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"))
