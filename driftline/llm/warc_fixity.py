"""WARC fixity audit by Merkle trees over ordered records.

Each replica's records are hashed where they are read; a tree over their
ordered positions has a node for every 16 neighbouring nodes of the level
below, with the hash over its children, its bytes and its records.  The audit
compares the roots and goes down only where hashes differ, so that below the
leaves it touches nothing of the branches that agree.  Going down it adds up
the bytes of the siblings to the left, which gives the offsets of the
corrupted records in both replicas.

Levels are written to the shared folder, a sixteenth as many rows each, so a
lost executor costs a task, not the tree.  Groups are of 16 rows at most;
records that share a position are first folded into one by sums that do not
depend on order, with partial aggregation.

Defined results: a null position comes after all others; records that share a
position are one leaf with the bytes of all (its record hash is then over
count and sums of theirs); a null payload is an empty record; an empty replica
has no tree, and every record of the other is reported; two empty replicas
give no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: log2 of the children of a node.
FAN_BITS = 4


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """Text of a WARC response record (RFC-like header lines, payload, two line ends)."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")))
    return F.concat(head, F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(records: DataFrame, position: str, payload: str, replica: int) -> DataFrame:
    """(replica, pos, hash, bytes, records): a row for each position."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    hashed = records.select(F.col(position).cast("long").alias("pos"), F.sha2(body, 256).alias("hash"), F.octet_length(body).cast("long").alias("bytes"))
    part = lambda k: F.sum(F.conv(F.substring("hash", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    folded = hashed.groupBy("pos").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.max("hash").alias("one"), F.concat_ws(",", F.count("*"), part(0), part(1), part(2), part(3)).alias("all"))
    return folded.select(F.lit(replica).alias("replica"), "pos", F.when(F.col("records") == 1, F.col("one")).otherwise(F.sha2("all", 256)).alias("hash"), "bytes", "records")


def _level(below: DataFrame) -> DataFrame:
    """The nodes over those of `below` (replica, node, hash, bytes, records)."""
    children = F.array_sort(F.collect_list(F.struct("node", "hash", "bytes")))
    text = F.concat_ws("|", F.transform(children, lambda c: F.concat_ws(":", c.node.bitwiseAND((1 << FAN_BITS) - 1), c.hash, c.bytes)))
    return below.groupBy("replica", F.shiftright("node", FAN_BITS).alias("node")).agg(F.sha2(text, 256).alias("hash"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"))


def _compared(nodes: DataFrame) -> DataFrame:
    """A row for each node, with both replicas' hash and bytes (null and 0 where one has none)."""
    of = lambda r, c: F.max(F.when(F.col("replica") == r, F.col(c)))
    return nodes.groupBy("node").agg(of(0, "hash").alias("hash_a"), of(1, "hash").alias("hash_b"), F.coalesce(of(0, "bytes"), F.lit(0)).alias("bytes_a"), F.coalesce(of(1, "bytes"), F.lit(0)).alias("bytes_b"))


def tree(primary: DataFrame, replica: DataFrame, position: str, payload: str) -> tuple[list[DataFrame], int]:
    """Levels of both replicas' trees, leaves first, and the position of leaf 0."""
    both = written(leaves(primary, position, payload, 0).unionByName(leaves(replica, position, payload, 1)), "leaves")
    ends = both.agg(F.min("pos").alias("low"), F.max("pos").alias("high")).first()
    low, high = (ends.low or 0, ends.high or 0)
    node = F.coalesce(F.col("pos"), F.lit(high + 1)) - F.lit(low)
    levels = [both.withColumn("node", node).select("replica", "node", "hash", "bytes", "records")]
    span = high + 1 - low
    while span:
        span >>= FAN_BITS
        levels.append(written(_level(levels[-1]), "level"))
    return levels, low


def roots(levels: list[DataFrame]) -> DataFrame:
    """replica, hash, bytes, records of each tree that has a record."""
    return levels[-1].select("replica", "hash", "bytes", "records")


def audit(primary: DataFrame, replica: DataFrame, position: str, payload: str) -> DataFrame:
    """A row for each position at which the replicas differ.

    position, kind (altered, missing from the replica, extra in it), offset and
    bytes in the primary and in the replica, hashes of both records.
    """
    levels, low = tree(primary, replica, position, payload)
    differs = ~F.col("hash_a").eqNullSafe(F.col("hash_b"))
    at = _compared(levels[-1]).where(differs).withColumns({"offset_a": F.lit(0).cast("long"), "offset_b": F.lit(0).cast("long")})
    for k in range(len(levels) - 2, -1, -1):
        parents = written(at.select(F.col("node").alias("parent"), F.col("offset_a").alias("from_a"), F.col("offset_b").alias("from_b")), "differ")
        children = _compared(levels[k].join(parents.select("parent"), F.shiftright("node", FAN_BITS) == F.col("parent"), "left_semi"))
        earlier = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        placed = children.withColumn("parent", F.shiftright("node", FAN_BITS)).withColumns({f"before_{s}": F.coalesce(F.sum(f"bytes_{s}").over(earlier), F.lit(0)) for s in "ab"})
        at = placed.where(differs).join(parents, "parent").select("node", "hash_a", "hash_b", "bytes_a", "bytes_b", *((F.col(f"from_{s}") + F.col(f"before_{s}")).alias(f"offset_{s}") for s in "ab"))
    kind = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("altered")
    return at.select((F.col("node") + F.lit(low)).alias("position"), kind.alias("kind"), "offset_a", "bytes_a", "offset_b", "bytes_b", "hash_a", "hash_b")
