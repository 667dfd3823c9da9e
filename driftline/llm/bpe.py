"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of parts.  Every adjacent pair that the ranks
know waits in the bucket of its rank; a bitmap in two levels tells which
buckets hold something, so find-first-set gives the next rank.  Entries whose
parts have merged meanwhile are stale and skipped when they come up.  A merge
costs O(log of the bucket) however long the pre-token is, so that pre-tokens
of millions of bytes take time in proportion; and the new pre-tokens of many
texts share one list and one queue, which spares each of them its own.

Encoding and decoding are map-only.  A worker keeps the pre-tokens met last
(two generations of a fixed number, short ones only); the ranks file is read on
the driver and broadcast (its size is the vocabulary's, fixed).

Defined results: a null text counts as empty and has no ids; repeated rows
give repeated results; an empty table gives an empty result; other columns are
ignored by `digests` and kept by `encode` and `decode`, whose new column takes
the place of one of the same name.  Special tokens are ordinary text.  A null
list of ids decodes to null, an id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held, lean, short_batches

#: Pre-tokens of at most so many characters are remembered, so many in each generation.
REMEMBERED_LENGTH, REMEMBERED = 48, 150_000


class RankQueue:
    """Buckets of positions by rank, and a bitmap in two levels of the ranks whose buckets hold something."""

    __slots__ = ("buckets", "low", "top")

    def __init__(self, buckets: dict[int, list[int]]) -> None:
        self.buckets = buckets  # each list a heap
        self.top = 0
        self.low: dict[int, int] = {}
        for rank in buckets:
            self._mark(rank)

    def _mark(self, rank: int) -> None:
        group = rank >> 8
        self.low[group] = self.low.get(group, 0) | 1 << (rank & 255)
        self.top |= 1 << group

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
        else:
            self.buckets[rank] = [position]
            self._mark(rank)

    def first(self) -> int:
        """The lowest rank: find-first-set on both levels."""
        group = (self.top & -self.top).bit_length() - 1
        low = self.low[group]
        return group << 8 | (low & -low).bit_length() - 1

    def clear(self, rank: int) -> None:
        """Unmark a rank whose bucket has run empty."""
        group = rank >> 8
        self.low[group] = low = self.low[group] & ~(1 << (rank & 255))
        if not low:
            self.top &= ~(1 << group)


class Codec:
    """Encoder and decoder for one set of ranks and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.find = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.double = np.array([ranks.get(bytes([i, j]), -1) for i in range(256) for j in range(256)], np.int32)
        self.newer: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each of several pre-tokens.

        They lie in one linked list, with walls between them, and share the
        queue: the lowest rank of all is the lowest of its own pre-token too.
        """
        ranks, longest = self.ranks, self.longest
        text = b"".join(pieces)
        n = len(text)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        starts = np.concatenate([[0], ends[:-1]])
        data = np.frombuffer(text, np.uint8)
        pair = np.full(n, -1, np.int32)
        pair[:-1] = self.double[data[:-1].astype(np.int64) * 256 + data[1:]]
        pair[ends[ends > starts] - 1] = -1
        ids = array("i", self.single[data].tobytes())
        waiting = array("i", pair.tobytes())  # rank for which the pair that starts here waits
        after = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())  # start of the next part
        previous = np.arange(-1, n - 1, dtype=np.int32)
        previous[starts[ends > starts]] = -1
        before = array("i", previous.tobytes())
        stop = array("i", np.repeat(ends, ends - starts).astype(np.int32).tobytes())
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        known, first = np.unique(pair[order], return_index=True)
        queue = RankQueue({r: part.tolist() for r, part in zip(known.tolist(), np.split(order, first[1:]), strict=True)} if len(order) else {})
        get, push = ranks.get, queue.push
        while queue.top:
            rank = queue.first()
            bucket = queue.buckets[rank]
            lowest = rank
            while bucket and lowest >= rank:
                i = heappop(bucket)
                if waiting[i] != rank:
                    continue  # stale
                gone = after[i]
                follows = after[gone]
                after[i] = follows
                waiting[gone] = waiting[i] = ids[gone] = -1
                ids[i] = rank
                if follows < stop[i]:
                    before[follows] = i
                    end = after[follows]
                    new = get(text[i:end]) if end - i <= longest else None
                    if new is not None:
                        waiting[i] = new
                        push(new, i)
                        if new < lowest:
                            lowest = new
                left = before[i]
                if left >= 0:
                    new = get(text[left:follows]) if follows - left <= longest else None
                    if new is None:
                        waiting[left] = -1
                    elif new != waiting[left]:
                        waiting[left] = new
                        push(new, left)
                        if new < lowest:
                            lowest = new
            if not bucket:
                queue.clear(rank)
        left_over = np.frombuffer(ids, np.int32)
        alive = np.flatnonzero(left_over >= 0)
        flat, cuts = left_over[alive].tolist(), np.searchsorted(alive, np.append(starts, n)).tolist()
        return [tuple(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _remember(self, found: dict[str, tuple[int, ...]]) -> None:
        for piece, ids in found.items():
            if len(piece) <= REMEMBERED_LENGTH:
                if len(self.newer) >= REMEMBERED:
                    self.older, self.newer = self.newer, {}
                self.newer[piece] = ids

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        split = [self.find(t) for t in texts]
        found: dict[str, tuple[int, ...]] = {}
        new: list[tuple[str, bytes]] = []
        for piece in set(chain.from_iterable(split)):
            ids = self.newer.get(piece)
            if ids is None:
                ids = self.older.get(piece)
            if ids is None:
                raw = piece.encode()
                whole = self.ranks.get(raw)
                if whole is None:
                    new.append((piece, raw))
                    continue
                ids = (whole,)
            found[piece] = ids
        if new:
            found |= zip([p for p, _ in new], self.merge([raw for _, raw in new]), strict=True)
        self._remember({p: ids for p, ids in found.items() if p not in self.newer})
        return [list(chain.from_iterable(map(found.__getitem__, pieces))) for pieces in split]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _chunks(texts: list[str | None], limit: int = 4 << 20) -> Iterator[list[str]]:
    """The texts in runs of about `limit` characters; nulls are empty."""
    out: list[str] = []
    held = 0
    for t in texts:
        out.append(t or "")
        held += len(out[-1])
        if held >= limit:
            yield out
            out, held = [], 0
    if out:
        yield out


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def _codec(shared) -> Codec:
    """The codec of this worker; it outlives tasks, and with it the pre-tokens remembered, until another operator comes."""
    return held(shared.id, lambda: Codec(*shared.value))


class _Shared:
    def __init__(self, spark, ranks_path: str, pattern: str):
        self.held = spark.sparkContext.broadcast((read_ranks(ranks_path), pattern))
        self.id = ("codec", ranks_path, pattern)

    @property
    def value(self):
        return self.held.value


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the ids of each text in the column `ids`."""
    short_batches(docs.sparkSession)
    shared = _Shared(docs.sparkSession, ranks_path, pattern)

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        codec = _codec(shared)
        return pa.array([ids for texts in _chunks(column.to_pylist()) for ids in codec.encode_all(texts)], pa.list_(pa.int32()))

    return docs.withColumn(ids, run(F.col(text).cast("string")))


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """`docs` with the bytes of each list of ids in the column `to` (binary)."""
    shared = _Shared(docs.sparkSession, ranks_path, pattern)

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        codec = _codec(shared)
        return pa.array([None if x is None else codec.decode(x) for x in column.to_pylist()], pa.binary())

    return docs.withColumn(to, run(F.col(ids)))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, then decoded from the ids, in one pass."""
    short_batches(docs.sparkSession)
    shared = _Shared(docs.sparkSession, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        decimal = [str(i) for i in range(max(codec.bytes_of, default=0) + 1)]
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for ids in chain.from_iterable(map(codec.encode_all, _chunks(batch.column(1).to_pylist()))):
                counts.append(len(ids))
                encoded.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, shared.id), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
