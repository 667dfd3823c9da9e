"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and non-ASCII characters, A-Z lower-cased,
so changes of punctuation and spacing do not hide a passage.  Benchmark items
are taken in blocks of bounded size; the running Karp-Rabin hashes of their
windows of `least` tokens are the seeds of a block.  One map-only pass over the
documents joins their windows with the seeds, `PAIRS` of places at a time; a
hit counts only where the tokens are the same, and hits in a row are one
maximal match, so that what is kept grows with the matches, not with the pairs.
For each item whose matches could cover enough of it, greedy tiling marks the
longest match of unmarked tokens again and again, in both texts, until none of
`least` tokens is left; each tile is confirmed byte by byte.  The share of the
item's tokens under tiles is the coverage; order does not matter, so reordered
passages are caught.

Nothing is shuffled and only a block is broadcast; a benchmark of any size is a
matter of more blocks.

Defined results: null and empty texts, on either side, match nothing, nor do
items shorter than `least` tokens; repeated rows give repeated results; ties
between matches of one length go to the first place in the document, then in
the item; empty tables give empty results.  Other columns are ignored by
`overlaps` and kept by `keep_rows`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import binary_chunks, lean, make_room, short_batches

SCHEMA = "doc_id long, item_id long, n_tiles long, covered long, item_tokens long, coverage double, longest long"


#: Pairs of places (in a document, in an item) that are looked at together.
PAIRS = 1 << 20


def matches_of(group: np.ndarray, diagonal: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring places joined: group, diagonal, first and last place of each whole run."""
    order = np.lexsort((first, diagonal, group))
    group, diagonal, first, last = group[order], diagonal[order], first[order], last[order]
    begins = np.ones(len(first), bool)
    begins[1:] = (group[1:] != group[:-1]) | (diagonal[1:] != diagonal[:-1]) | (first[1:] != last[:-1] + 1)
    at = np.flatnonzero(begins)
    return group[at], diagonal[at], first[at], last[np.append(at[1:], len(first)) - 1] if len(at) else last[:0]


def greedy(n_doc: int, n_item: int, matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the document, place in the item, length) of maximal matches of the same form."""
    heap = [(-n, i, j) for i, j, n in matches]
    heapify(heap)
    used_doc, used_item = np.zeros(n_doc, bool), np.zeros(n_item, bool)
    found = []
    while heap:
        n, i, j = heappop(heap)
        free = np.concatenate([[False], ~(used_doc[i : i - n] | used_item[j : j - n]), [False]])
        edges = np.flatnonzero(free[1:] != free[:-1]).reshape(-1, 2)
        if len(edges) == 1 and edges[0, 1] - edges[0, 0] == -n:
            found.append((i, j, -n))
            used_doc[i : i - n] = used_item[j : j - n] = True
            continue
        for a, b in edges.tolist():  # what is left of it, in runs
            if b - a >= least:
                heappush(heap, (a - b, i + a, j + a))
    return found


def tiles(doc: np.ndarray, item: np.ndarray, pairs: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles of two token sequences; pairs: (place in the document, place in the item) of all common windows of `least` tokens."""
    _, diagonal, first, last = matches_of(np.zeros(len(pairs), np.int64), pairs[:, 0] - pairs[:, 1], pairs[:, 0], pairs[:, 0])
    return greedy(len(doc), len(item), list(zip(first.tolist(), (first - diagonal).tolist(), (last - first + least).tolist(), strict=True)), least)


@dataclass
class Block:
    """Items of one block, with their tokens, and the seeds."""

    ids: list[int | None]
    tokens: tx.Tokens
    index: tx.HashIndex
    first: np.ndarray  # of each seed, where its places begin
    places: np.ndarray  # (item, place)


def block_of(ids: list[int | None], texts: list[bytes], least: int) -> Block:
    t = tx.tokens(texts, tx.NOT_ALNUM, lower=True)
    hashes, at = tx.windows(t, least)
    order = np.argsort(hashes, kind="stable")
    seeds, first = np.unique(hashes[order], return_index=True)
    owners = t.owners[at[order]]
    return Block(ids, t, tx.HashIndex(seeds), np.append(first, len(order)), np.column_stack([owners, at[order] - t.bounds[owners]]))


def _word(t: tx.Tokens, k: int) -> bytes:
    return t.data[t.starts[k] : t.ends[k]].tobytes()


def _common(own: tx.Tokens, base: int, at: np.ndarray, seed: np.ndarray, block: Block, least: int) -> tuple[np.ndarray, ...]:
    """Maximal matches (item, diagonal, first and last place of their windows) of a document whose windows `at` have the seeds `seed`."""
    n = block.first[seed + 1] - block.first[seed]
    total = np.cumsum(n)
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1], PAIRS), side="right"), len(n)))
    cuts = np.unique(np.append(0, cuts))
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        m = n[a:b]
        place = block.places[np.repeat(block.first[seed[a:b]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())]
        where = np.repeat(at[a:b], m)
        there = block.tokens.bounds[place[:, 0]] + place[:, 1]
        same = np.ones(len(where), bool)
        for k in range(least):
            same &= own.hashes[base + where + k] == block.tokens.hashes[there + k]
        item, where, j = place[same, 0], where[same], place[same, 1]
        parts.append(matches_of(item, where - j, where, where))
    return matches_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _reach(item: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items, and how many of each one's tokens lie under matches (item, start, length)."""
    wide = np.int64(1) << 40
    order = np.lexsort((start, item))
    begin = item[order] * wide + start[order]
    end = begin + length[order]
    before = np.concatenate([[-1], np.maximum.accumulate(end)[:-1]])
    items, first = np.unique(item[order], return_index=True)
    return items, np.add.reduceat(np.maximum(end - np.maximum(begin, before), 0), first)


def matches(texts: list[bytes], block: Block, least: int, threshold: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(index of the text, index of the item, tiles) where the tiles cover `threshold` of the item at least."""
    t = tx.tokens(texts, tx.NOT_ALNUM, lower=True)
    hashes, at = tx.windows(t, least)
    seed = block.index.find(hashes)
    hit = np.flatnonzero(seed >= 0)
    if not len(hit):
        return
    seed, at = seed[hit], at[hit]
    owners = t.owners[at]
    sizes = block.tokens.counts
    for doc in np.unique(owners).tolist():
        low, high = np.searchsorted(owners, [doc, doc + 1])
        base = int(t.bounds[doc])
        item, diagonal, first, last = _common(t, base, at[low:high] - base, seed[low:high], block, least)
        if not len(item):
            continue
        start, length = first - diagonal, last - first + least
        items, reach = _reach(item, start, length)
        for k in items[reach >= threshold * sizes[items]].tolist():
            mine = item == k
            there = int(block.tokens.bounds[k])
            found = greedy(int(t.counts[doc]), int(sizes[k]), list(zip(first[mine].tolist(), start[mine].tolist(), length[mine].tolist(), strict=True)), least)
            found = [(i, j, n) for i, j, n in found if all(_word(t, base + i + x) == _word(block.tokens, there + j + x) for x in range(n))]
            if sum(n for _, _, n in found) >= threshold * sizes[k]:
                yield doc, k, found


def blocks(benchmark: DataFrame, least: int, block_bytes: int) -> Iterator[Block]:
    """The items (item_id, text) in blocks of about `block_bytes`, streamed through the driver."""
    ids: list[int | None] = []
    texts: list[bytes] = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text.encode())
        held += len(texts[-1])
        if held >= block_bytes:
            yield block_of(ids, texts, least)
            ids, texts, held = [], [], 0
    if ids:
        yield block_of(ids, texts, least)


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """A row for each document and item with coverage of `threshold` at least."""
    spark = docs.sparkSession
    short_batches(spark)
    out = spark.createDataFrame([], SCHEMA)
    for block in blocks(benchmark, least, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                ids = batch.column(0)
                for i, _, texts in binary_chunks(batch.column(1)):
                    rows = [
                        (ids[i + doc].as_py(), block.ids[item], len(found), covered, int(block.tokens.counts[item]), covered / int(block.tokens.counts[item]), max(k for _, _, k in found))
                        for doc, item, found in matches(texts, block, least, threshold)
                        for covered in [sum(k for _, _, k in found)]
                    ]
                    if rows:
                        types = [pa.int64()] * 5 + [pa.float64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "item_id", "n_tiles", "covered", "item_tokens", "coverage", "longest"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), SCHEMA))
    return out


def keep_rows(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of `docs`, all columns, that no item's tiles give away; the text alone goes to Python."""
    spark = docs.sparkSession
    short_batches(spark)
    for block in blocks(benchmark, least, block_bytes):
        docs = docs.where(_clean(spark.sparkContext.broadcast(block), least, threshold)(F.col("text").cast("string")))
    return docs


def _clean(shared, least: int, threshold: float):
    @F.arrow_udf("boolean")
    def clean(column: pa.Array) -> pa.Array:
        make_room()
        out = np.ones(len(column), bool)
        for i, _, texts in binary_chunks(column):
            for doc, _, _ in matches(texts, shared.value, least, threshold):
                out[i + doc] = False
        return pa.array(out)

    return clean
