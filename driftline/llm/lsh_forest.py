"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

The plan:

1. One pass over the texts gives each row its class (documents with equal
   shingle sets are one class, however many copies there are), set size and
   MinHash signature.
2. The forest: `TREES` sorted orders of the classes, each by a rotation of the
   signature.  All orders are one range-partitioned sort by (order, first DEPTH
   values, next values, class), so that even a third of all classes with one
   prefix is dealt over many tasks.  A pass over the sorted rows keeps those
   whose longest common prefix with a neighbour has DEPTH values at least; a
   run of such neighbours is a region.
3. In the first `orders` orders the depth adapts: a region goes down, a value
   at a time, until it holds at most `leaf` classes (and `piece_bytes`); what
   is equal in all values kept is dealt by class.  Regions with the same
   members count once.  Each is settled on the full shingle sets: a spanning
   forest of its links.
4. The links found are joined into components.  In *all* orders, the regions
   that still hold several components, again those of equal members once, are
   finished exactly: what is outside a region's largest component meets the
   whole region, in blocks of `piece_bytes`.
5. All links are joined into components; a row's component is the least
   doc_id of it.

All sizes of regions and clusters take this way.  Within a task every pair that
the signatures leave possible is compared once, unless a chain of confirmed
links joins it already; the rows that come out are a forest of links, never
all pairs.

What may be missed: a pair of exactly the similarity asked for (0.75) shares
DEPTH values in no order with probability (1 - 0.75^4)^32 = 5e-6, less above
it; the signature bound before the full comparison costs 4.5 standard
deviations (3e-6).  The size of a region or cluster changes nothing in this.

Defined results: texts without words, and null texts, have an empty set and
are linked with nothing; texts of fewer words than the shingle have their
whole word sequence as one shingle; rows that repeat a doc_id or have none
count as rows of their own, and a null doc_id never names a component unless
no row of it has an id; an empty table gives an empty result.  Other columns
of the input are ignored by `near_duplicates`.  `keep_rows` keeps all columns and,
of each component, the one row of least doc_id (null last), of rows with that
id the one whose text has the least hash; rows without words all stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .shared import binary_chunks, column_free_name, drop_written, grouped_stream, lean, short_batches, written

PERMUTATIONS = 128
TREES = 32
DEPTH = 4
#: Values of a rotation by which an order sorts, and bits of an order's number in its keys.
DEEPEST, TREE_BITS = 8, 5
#: Bits of the filter that picks the documents whose sets are needed; its size does not grow with the data.
FILTER_BITS = 1 << 22

_rng = np.random.default_rng(20)
_FACTOR = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERM = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    t = tx.tokens(texts, lower=True)
    hashes, first = tx.windows(t, k)
    cuts = np.searchsorted(first, t.bounds)
    out = []
    for i, n in enumerate(t.counts.tolist()):
        if n >= k:
            out.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
        elif n:
            value = np.array([n], np.uint64)
            for h in t.hashes[t.bounds[i] : t.bounds[i] + n]:
                value = tx.mix(value * np.uint64(31) + h)
            out.append(value)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a set."""
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(values), 4096):
        block = values[i : i + 4096, None] * _FACTOR[None, :]
        block += _TERM
        block >>= np.uint64(32)
        np.minimum(out, block.min(0), out=out)
    return out.astype(np.uint32)


def class_of(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _rows(docs: DataFrame, k: int) -> DataFrame:
    """row, doc_id, n_shingles, cls, sig of each row of `docs` (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in binary_chunks(batch.column(2)):
                sets = shingle_sets(texts, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([class_of(s) for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["row", "doc_id", "n_shingles", "cls", "sig"],
                )

    return docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "row long, doc_id long, n_shingles long, cls binary, sig binary")


def _order_keys(classes: DataFrame) -> DataFrame:
    """(region, rest, cls, weight) of each class (cls, sig, weight) in each order.

    region: the order's number, then a hash of the first DEPTH values of its
    rotation; rest: 16 bits each of the next values.  Together they sort as the
    rotations do, up to the arrangement of sister branches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS).astype(np.uint64)
            for tree in range(TREES):
                rotated = np.roll(sig, -DEPTH * tree, 1)
                key = np.full(len(sig), tree, np.uint64)
                for d in range(DEPTH):
                    key = tx.mix(key ^ rotated[:, d]) + np.uint64(d)
                key = (key >> np.uint64(TREE_BITS)) | np.uint64(tree << (64 - TREE_BITS))
                rest = np.zeros(len(sig), np.uint64)
                for d in range(DEPTH, DEEPEST):
                    rest = (rest << np.uint64(16)) | (rotated[:, d] & np.uint64(0xFFFF))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rest.view(np.int64)), batch.column(0), batch.column(2)], ["region", "rest", "cls", "weight"])

    return classes.select("cls", "sig", "weight").mapInArrow(lean(run), "region long, rest long, cls binary, weight long")


def _members(classes: DataFrame) -> DataFrame:
    """(region, rest, cls, weight): the sorted orders without classes that no neighbour shares DEPTH values with.

    The first and the last row of a task stay, since their neighbours may be in
    another; a region of theirs that holds nothing else has one member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        known = True  # whether the held row stays already
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            region = rows.column(0).to_numpy()
            same = region[1:] == region[:-1]
            stays = np.zeros(len(region), bool)
            stays[1:] |= same
            stays[:-1] |= same
            stays[0] |= known
            yield rows.slice(0, len(region) - 1).filter(pa.array(stays[:-1]))
            held, known = rows.slice(len(region) - 1), bool(stays[-1])
        if held is not None:
            yield held

    order = ["region", "rest", "cls"]
    return _order_keys(classes).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(run), "region long, rest long, cls binary, weight long")


def _once(tasks: DataFrame) -> DataFrame:
    """`tasks` (chunk, cls) without those of one class, and of those with the same classes only one."""
    same = tasks.groupBy("chunk").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("h")).where("n > 1")
    return tasks.join(same.groupBy("n", "h").agg(F.min("chunk").alias("chunk")).select("chunk"), "chunk", "left_semi")


def _leaves(members: DataFrame, orders: int, leaf: int, piece_bytes: int) -> DataFrame:
    """(chunk, cls): regions of the first orders, at the least depth at which they are small enough."""
    own = members.where(F.shiftrightunsigned("region", 64 - TREE_BITS) < orders)
    depths = F.array(*(F.struct(F.lit(d).alias("depth"), (F.lit(0).cast("long") if d == DEPTH else F.shiftright("rest", 16 * (DEEPEST - d))).alias("prefix")) for d in range(DEPTH, DEEPEST + 1)))
    at = own.select("region", "cls", "weight", F.explode(depths).alias("x")).select("region", "cls", "weight", "x.depth", "x.prefix")
    sizes = at.groupBy("region", "depth", "prefix").agg(F.count("*").alias("m"), F.sum("weight").alias("w")).where("m > 1")
    parts = F.greatest(F.ceil(F.col("m") / leaf), F.ceil(F.col("w") / piece_bytes))
    fits = at.join(sizes.select("region", "depth", "prefix", parts.alias("parts")), ["region", "depth", "prefix"])
    # the least depth that fits, or else the greatest
    best = fits.groupBy("region", "cls").agg(F.min_by(F.struct("depth", "prefix", "parts"), F.when(F.col("parts") == 1, F.col("depth")).otherwise(1000 - F.col("depth"))).alias("r"))
    part = F.when(F.col("r.parts") > 1, F.pmod(F.xxhash64("cls"), F.col("r.parts"))).otherwise(0)
    return _once(best.select(F.xxhash64("region", "r.depth", "r.prefix", part).alias("chunk"), "cls"))


def _open_regions(members: DataFrame, joined: DataFrame, piece_bytes: int) -> DataFrame:
    """(chunk, cls, comp): regions of all orders that hold several components, in blocks.

    Classes outside a region's largest component meet all classes of the region.
    """
    state = written(members.join(joined.select(F.col("node").alias("cls"), "root"), "cls", "left").select("region", "cls", "weight", F.coalesce("root", "cls").alias("comp")), "state")
    mixed = state.groupBy("region").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("h"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    todo = state.join(mixed.groupBy("n", "h").agg(F.min("region").alias("region")).select("region"), "region", "left_semi")
    sizes = todo.groupBy("region", "comp").agg(F.count("*").alias("m"), F.sum("weight").alias("w"))
    total = sizes.groupBy("region").agg(F.max_by(F.struct("comp", "w"), F.struct("m", "comp")).alias("main"), F.sum("w").alias("w"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / piece_bytes)).cast("int")
    todo = todo.join(total.select("region", F.col("main.comp").alias("main"), blocks(F.col("w") - F.col("main.w")).alias("xs"), blocks(F.col("w")).alias("ys")), "region")
    mine = lambda c: F.pmod(F.xxhash64("cls"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = todo.where("comp <> main").select("region", "cls", "comp", mine("xs").alias("x"), every("ys").alias("y"))
    whole = todo.select("region", "cls", "comp", every("xs").alias("x"), mine("ys").alias("y"))
    return left.unionByName(whole).select(F.xxhash64("region", "x", "y").alias("chunk"), "cls", "comp").distinct()


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of `ids` (column `b`): FILTER_BITS / 8 bytes, whatever the number of ids."""
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    words = ids.groupBy((F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits"))
    found = words.toArrow()  # FILTER_BITS / 64 rows at most
    bits[found["w"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def _sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(cls, elems): full sets of the classes in `members` (cls, rep), from a second pass over the texts.

    A fixed-size filter on doc_id keeps most other rows out of that pass; the
    join on the class makes the choice exact.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    wanted = docs.sparkSession.sparkContext.broadcast(_filter_of(members.select(F.pmod(F.xxhash64(F.col("rep")), F.lit(FILTER_BITS)).alias("b"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = (wanted.value[b // 64] >> (b % 64).astype(np.uint64)) & np.uint64(1)
            for _, _, texts in binary_chunks(batch.column(1).filter(pa.array(hit.astype(bool)))):
                sets = {class_of(s): s for s in shingle_sets(texts, k) if len(s)}
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.binary()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], ["cls", "elems"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select(bit.cast("int").alias("b"), "text").mapInArrow(lean(run), "cls binary, elems binary")
    return found.join(members.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("elems").alias("elems"))


def settle(classes: list[bytes], sets: list[np.ndarray], sigs: np.ndarray, percent: int, joined: list[bytes] | None = None) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links among the given classes.

    Classes like the most common signature come first: they tend to have most
    links, so later pairs are mostly joined already.  joined: a component each,
    as far as known before.
    """
    m = len(classes)
    joined = joined or classes
    if m > 2:
        top = []
        for column in sigs.T:
            values, counts = np.unique(column, return_counts=True)
            top.append(values[np.argmax(counts)])
        order = np.argsort(-(sigs == np.array(top)).sum(1), kind="stable")
        classes, sets, sigs, joined = [classes[i] for i in order], [sets[i] for i in order], sigs[order], [joined[i] for i in order]
    sizes = np.array([len(s) for s in sets], np.int64)
    share = percent / 100
    least = PERMUTATIONS * share - 4.5 * np.sqrt(PERMUTATIONS * share * (1 - share)) if m > 2 else 0
    root = np.unique(np.array(joined, object), return_inverse=True)[1]
    links = []
    for p in range(m - 1):
        rest = np.arange(p + 1, m)
        rest = rest[(root[rest] != root[p]) & (100 * np.minimum(sizes[rest], sizes[p]) >= percent * np.maximum(sizes[rest], sizes[p]))]
        if len(rest) and least > 0:
            rest = rest[(sigs[rest] == sigs[p]).sum(1) >= least]
        if not len(rest):
            continue
        bounds = np.concatenate([[0], np.cumsum(sizes[rest])])
        flat = np.concatenate([sets[q] for q in rest])
        at = np.minimum(np.searchsorted(sets[p], flat), sizes[p] - 1)
        both = tx.summed((sets[p][at] == flat).astype(np.int64), bounds)
        for q in rest[100 * both >= percent * (sizes[rest] + sizes[p] - both)]:
            if root[q] != root[p]:
                links.append((classes[p], classes[q]))
                root[root == root[q]] = root[p]
    return links


def _links(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): spanning forests of the links within each chunk of `tasks` (chunk, cls, comp)."""

    def handle(group: list[dict]) -> list[dict]:
        found = {r["cls"]: r for r in group}
        rows = list(found.values())
        sigs = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint32).reshape(-1, PERMUTATIONS)
        return [{"u": u, "v": v} for u, v in settle(list(found), [np.frombuffer(r["elems"], np.uint64) for r in rows], sigs, percent, [r["comp"] for r in rows])]

    return grouped_stream(tasks.join(sets, "cls").select("chunk", "cls", "comp", "sig", "elems"), "chunk", handle, "u binary, v binary")


def _components(docs: DataFrame, k: int, percent: int, orders: int, leaf: int, piece_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Of `docs` (row, doc_id, text): the rows (row, doc_id, n_shingles, cls), and (cls, first) with the first row of each class's component."""
    short_batches(docs.sparkSession)
    rows = written(_rows(docs, k), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = written(rows.where("cls is not null").groupBy("cls").agg(first, F.first("sig").alias("sig"), (F.first("n_shingles") * 8 + 32768).alias("weight")), "classes")
    members = written(_members(classes), "members")
    known = members.select("cls").distinct().join(classes, "cls").select("cls", F.col("first.doc_id").alias("rep"), "sig")
    known = written(known, "known")
    sets = written(_sets(docs, known, k).join(known.select("cls", "sig"), "cls"), "sets")
    links = written(_links(_leaves(members, orders, leaf, piece_bytes).withColumn("comp", F.col("cls")), sets, percent), "links")
    more = written(_links(_open_regions(members, components(links), piece_bytes), sets, percent), "links")
    joined = written(components(links.unionByName(more)), "joined")
    for table in (members, known, sets, links, more):
        drop_written(table)
    least = joined.join(classes.select(F.col("cls").alias("node"), "first"), "node").groupBy("root").agg(F.min("first").alias("least"))
    named = joined.join(least, "root").select(F.col("node").alias("cls"), "least")
    return rows, classes.select("cls", "first").join(named, "cls", "left").select("cls", F.coalesce("least", "first").alias("first"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, orders: int = 4, leaf: int = 256, piece_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text)."""
    rows, ids = _components(docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text"), k, percent, orders, leaf, piece_bytes)
    found = rows.where("cls is not null").select("doc_id", "n_shingles", "cls").join(ids, "cls").select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))
    alone = rows.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = found.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_rows(docs: DataFrame, k: int = 5, percent: int = 75, orders: int = 4, leaf: int = 256, piece_bytes: int = 16 << 20) -> DataFrame:
    """The rows of `docs`, all columns, but one row alone of each component.

    Rows are told apart by doc_id and a hash of the text together, since ids may
    repeat or be missing; of rows equal in both any one stays.
    """
    row = column_free_name(docs, "row")
    marked = docs.withColumn(row, F.xxhash64(F.col("text").cast("string")))
    _, ids = _components(marked.select(F.col(row).alias("row"), "doc_id", "text"), k, percent, orders, leaf, piece_bytes)
    stay = ids.select(F.col("first.row").alias(f"_{row}"), F.col("first.doc_id").alias(f"_{row}_id")).distinct()
    worded = F.coalesce(F.col("text").cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    same = (F.col(row) == F.col(f"_{row}")) & F.col("doc_id").cast("long").eqNullSafe(F.col(f"_{row}_id"))
    one = marked.where(worded).join(stay.hint("merge"), same, "left_semi")
    place = F.row_number().over(Window.partitionBy(row, "doc_id").orderBy(row))
    one = one.withColumn(f"_{row}_place", place).where(F.col(f"_{row}_place") == 1).select(*docs.columns)
    return one.unionByName(docs.where(~worded))
