"""Vectorised tokenising and hashing of UTF-8 texts with NumPy.

Texts of a chunk are joined with a separator and handled as one byte array:
token bounds come from a byte table, token hashes from prefix sums of a
polynomial over Z/2^64, finished with a mixing function.  No Python object is
made for a token.  Hashes are the same in every process.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Byte tables: True where a byte separates tokens.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SEPARATOR = b"\n"
#: Bytes hashed at once; a single longer token is hashed whole.
_PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_pow = _powers(_BASE, _PIECE + 1)
_inverse = _powers(_BASE_INVERSE, _PIECE + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Tokens:
    """Tokens of several texts, in order.

    hashes: of each token.  bounds: token index at which each text begins, and
    the number of tokens at the end.  starts, ends: byte positions in `data`.
    """

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owners(self) -> np.ndarray:
        """Index of the text that each token is from."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + _PIECE, side="right")))
        n = int(ends[j - 1]) - at
        pw, inv = (_pow, _inverse) if n <= _PIECE else (_powers(_BASE, n + 1), _powers(_BASE_INVERSE, n + 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[at : at + n].astype(np.uint64) + np.uint64(1)) * pw[:n], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64) * _STEP)
        i = j
    return out


def tokens(texts: list[bytes], separators: np.ndarray = SPACE, lower: bool = False) -> Tokens:
    """Maximal runs of non-separators of each text.  lower: A-Z are read as a-z.

    The line feed must be a separator (it joins the texts).
    """
    joined = _SEPARATOR.join(texts)
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.zeros(len(texts), np.int64)
    np.cumsum(lengths[:-1] + 1, out=begins[1:])
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    bounds = np.append(np.searchsorted(starts, begins), len(starts))
    return Tokens(_hash_spans(data, starts, ends), bounds, starts, ends, data)


def lines(texts: list[bytes]) -> Tokens:
    """Non-empty lines (split at the line feed) of each text, as tokens."""
    return tokens(texts, NEWLINE)


def windows(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k tokens that lie within one text, and the index of each one's first token."""
    n = len(t.hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    acc = t.hashes[:n].copy()
    for i in range(1, k):
        acc *= _STEP
        acc += t.hashes[i : i + n]
    owners = t.owners
    first = np.flatnonzero(owners[:n] == owners[k - 1 :])
    return mix(acc[first]), first


class HashIndex:
    """Position of uint64 hashes in a fixed set of distinct ones, by buckets of their top bits."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max(initial=0))
        self.padded = np.append(self.keys, np.zeros(self.deepest + 1, np.uint64))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index into the given keys, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.keys) or not len(hashes):
            return out
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        open_ = np.flatnonzero(at < end)
        at, end, wanted = at[open_], end[open_], hashes[open_]
        while len(open_):
            hit = self.padded[at] == wanted
            out[open_[hit]] = self.order[at[hit]]
            at = at + 1
            left = ~hit & (at < end)
            open_, at, end, wanted = open_[left], at[left], end[left], wanted[left]
        return out


def summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]
