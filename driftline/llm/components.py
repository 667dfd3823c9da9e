"""Connected components by alternating star contraction, on DataFrames.

Each round rewires edges towards smaller nodes with two grouped minima; the
depth falls geometrically, and no neighbour list is ever gathered.  Edges meet
their node's minimum by (node, salt), so that the edges of a node that has a
third of them all are dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written


#: Parts into which the edges of a node are dealt.
SALTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """`edges` (u, v) with m, the least v of their u.

    One exchange deals the edges by (u, salt); the minima of the parts, few for
    a node, are joined with those of the nodes before the edges see them.
    """
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).repartition("u", "salt")
    parts = dealt.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"))
    return dealt.join(parts.select("u", "salt").join(least, "u"), ["u", "salt"])


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns u, v (any orderable type) in; (node, root) out for every node of an edge, root the least node reachable.

    Loops, repeated edges and either direction are fine; rows with a null are
    ignored; no edges give no rows.
    """
    now = written(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _sign(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        small = _with_least(large).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least).distinct()
        after = written(small, "edges")
        sign = _sign(after)
        drop_written(large)
        drop_written(now)
        now = after
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
