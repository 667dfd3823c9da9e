"""Quality classifier: interpolated modified Kneser-Ney over words, perplexity thresholds by language.

The model is of order 3 over words (A-Z lower-cased), with two marks before
each text and an end behind it.  The trusted text is that of all documents
labelled good, without those that set the thresholds.

Training is counts in shards.  A trigram goes to the shard of its middle word,
with its number in a chunk of text; so a shard has all that its trigrams, their
contexts, and the bigrams that begin with one of its words need: counts,
continuation counts and weights.  What it lacks are the continuation counts of
words: each shard tells how many of its words stand before each word, to that
word's own shard, which adds them up and answers.  Numbers of rare n-grams, for
the discounts, are added up by the driver.

Scoring sends the documents' trigrams to the shard of their middle word, where
what the trigram adds to the probability of its last word alone is looked up
and summed by text.  The probability of the word alone is added where the
text is for the most frequent words (at most `HEAD`), and in the word's shard
for others.  This is done in `SLICES` passes over the texts, a part of the shards
in each, so that a pass's share alone is on disk.  Texts are not shuffled.

All that is shuffled or written are packed arrays of a chunk or a shard: words as
numbers in a list of its different words, in as few bytes as they need, compressed.

A fifth of the good documents, by hash of the id, is never trained on.  The
thresholds are quantiles over all of those, for each language with at least
`least` of them.

No table of the model is broadcast whole, nor joined.  The different trigrams of a
shard, all those around its most frequent word with them, must fit a task.

Words are told apart by 64-bit hashes, n-grams by their words, texts to be scored by
64-bit hashes.

Defined results: texts without words, and null texts, have no perplexity (null)
and are not kept; rows with a null language, or one with too few documents to
have a threshold, have that of all languages together; repeated rows are judged
alike; without trusted rows nothing has a threshold and all texts with words
are kept; an empty table gives an empty result.  Other columns are ignored by
`perplexities` and kept by `keep_rows`.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .shared import binary_chunks, collect_garbage, column_free_name, drop_written, held, lean, pack, short_batches, unpack, written

#: Width of the buckets of log10 perplexity for the quantiles.
STEP = 0.001
#: Hashes that stand for the mark before a text and for its end.
START, END = np.uint64(0x3C733E), np.uint64(0x3C2F733E)
#: Words that go to all tasks with their values, at most.
HEAD = 1 << 20
#: Bytes of text whose n-grams a task holds at once, about: where it packs them for shards, and where it does not.
PACK_CHUNK, CHUNK = 2 << 20, 1 << 20
#: Bytes of trusted text for a shard, about, and at least; passes over the texts to be scored.
SHARD_BYTES, LEAST_SHARD, SLICES = 6 << 20, 1 << 16, 6
#: Ids of trusted documents that go to all tasks, at most; more are joined by a shuffle.
BROADCAST_IDS = 1 << 22
#: Remainder (by 5) of the hash of the id of good documents that set the thresholds.
CALIBRATION = 1
#: Kinds of packed rows, in the order in which a shard reads them: trigrams; words that follow (to their own shards);
#: continuation counts of a shard's own words, and of those that follow its words; numbers for the driver; trigrams to be scored.
TRIGRAMS, FOLLOWERS, WORDS, ANSWERS, NUMBERS, ASKED = range(6)
PACKED = "kind int, shard int, origin int, blob binary"


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, each with two marks before and an end behind; the owner of each; words of each text."""
    t = tx.tokens(texts, lower=True)
    lengths = t.counts + 3
    first = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(first[-1], np.uint64)
    out[first[:-1]] = out[first[:-1] + 1] = START
    out[first[1:] - 1] = END
    inside = np.ones(len(out), bool)
    inside[first[:-1]] = inside[first[:-1] + 1] = inside[first[1:] - 1] = False
    out[inside] = t.hashes
    return out, np.repeat(np.arange(len(texts)), lengths), t.counts


def gram_hash(*words: np.ndarray) -> np.ndarray:
    """Hash of n-grams, words in order; of different orders, different ones."""
    out = np.full(len(words[-1]), len(words), np.uint64)
    for w in words:
        out = tx.mix(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return out


def _home(words: np.ndarray, n: int) -> np.ndarray:
    """The shard of each word."""
    return (words % np.uint64(n)).astype(np.int64)


def _packed(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kind, shard, origin, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(shard, pa.int32()), pa.array(origin, pa.int32()), pa.array(blob, pa.binary())], ["kind", "shard", "origin", "blob"])


def _deltas(words: np.ndarray) -> np.ndarray:
    """Of sorted hashes; `np.cumsum` takes them back."""
    return np.diff(words, prepend=np.uint64(0))


def _coded(words: np.ndarray, *codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The words that `codes` use, as deltas, and the codes among these."""
    used = np.zeros(len(words), bool)
    for c in codes:
        used[c] = True
    place = np.cumsum(used) - 1
    return _deltas(words[used]), *(place[c] for c in codes)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, bytes]]]]:
    """(shard, its rows (kind, origin, blob)) of packed rows that are sorted by shard."""
    rows = ((s, k, o, x.as_py()) for batch in batches for k, s, o, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True))
    row = next(rows, None)

    def own(shard: int) -> Iterator[tuple[int, int, bytes]]:
        nonlocal row
        while row is not None and row[0] == shard:
            yield row[1:]
            row = next(rows, None)

    while row is not None:
        shard = row[0]
        yield shard, (mine := own(shard))
        for _ in mine:  # what was not asked for
            pass


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _rare(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4."""
    return np.bincount(counts[counts <= 4], minlength=5)[1:5].tolist()


def _continued(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the bigrams (v, w) of trigrams sorted by v, w, u; how many different words stand before each.

    N-grams that begin a text have none before and keep their number.
    """
    first = _runs(v, w)
    return first, np.where(v[first] == start, np.add.reduceat(c, first), np.diff(first, append=len(v)))


def count_trigrams(texts: DataFrame, n: int) -> DataFrame:
    """Packed rows of n shards: TRIGRAMS, FOLLOWERS and NUMBERS of the texts (column text), marks and ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, chunk in binary_chunks(batch.column(0), PACK_CHUNK):
                s, _, _ = sequences(chunk)
                at = np.flatnonzero(s != START)
                _, first, c = np.unique(gram_hash(s[at - 2], s[at - 1], s[at]), return_index=True, return_counts=True)
                at = at[first]
                words, codes = np.unique(s, return_inverse=True)
                home = _home(s[at - 1], n)
                order = np.lexsort((codes[at - 2], codes[at - 1], home))
                at, c, home = at[order], c[order], home[order]
                ends = np.append(_runs(home), len(home))
                yield _packed([(TRIGRAMS, home[i], 0, pack(*_coded(words, *(codes[at[i:j] - k] for k in (2, 1, 0))), c[i:j])) for i, j in zip(ends[:-1], ends[1:], strict=True)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            # columns of places take 4 bytes an item, and are in memory once
            parts = [[np.cumsum(deltas), *(x.astype(np.int32) for x in (u, v, w)), c.view(np.int64)] for deltas, u, v, w, c in (unpack(blob) for _, _, blob in rows)]
            words = np.unique(np.concatenate([p[0] for p in parts]))
            for p in parts:
                place = np.searchsorted(words, p[0]).astype(np.int32)
                p[1:4] = (place[x] for x in p[1:4])
            columns = [np.concatenate([p.pop() for p in parts]) for _ in range(4)]
            del parts
            order = np.lexsort((columns[3], columns[1], columns[2]))
            for k in range(4):
                columns[k] = columns[k][order]
            del order
            c, w, v, u = columns
            del columns
            first = _runs(u, v, w)
            u, v, w, c = u[first], v[first], w[first], np.add.reduceat(c, first)
            del first
            two, continued = _continued(u, v, w, c, int(np.searchsorted(words, START)) if START in words else -1)
            followers, before = np.unique(w[two], return_counts=True)
            home = _home(words[followers], n)
            order = np.argsort(home, kind="stable")
            followers, before, home = words[followers[order]], before[order], home[order]
            ends = np.append(_runs(home), len(home))
            yield _packed([(TRIGRAMS, shard, 0, pack(_deltas(words), u, v, w, c)), (NUMBERS, shard, 0, pack(np.array([*_rare(c), *_rare(continued)])))])
            yield _packed([(FOLLOWERS, home[i], shard, pack(_deltas(followers[i:j]), before[i:j])) for i, j in zip(ends[:-1], ends[1:], strict=True)])

    short_batches(texts.sparkSession)
    counted = texts.select(F.col("text").cast("string")).mapInArrow(lean(count), PACKED)
    return written(_dealt(counted, n).mapInArrow(lean(merge), PACKED), "trigrams")


def _dealt(rows: DataFrame, n: int, slices: int = 1) -> DataFrame:
    """Packed rows, each shard's in one task, sorted by shard and kind.  Of n shards there are those of one remainder by `slices`."""
    return rows.repartitionById(n // slices, F.floor(F.col("shard") / slices).cast("int")).sortWithinPartitions("shard", "kind")


def count_words(trigrams: DataFrame, n: int) -> DataFrame:
    """Packed rows: WORDS, ANSWERS and NUMBERS of the words that follow others."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            origins, parts = zip(*((origin, unpack(blob)) for _, origin, blob in rows), strict=True)
            words, place = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)
            ends = np.cumsum([0, *(len(p[0]) for p in parts)])
            answers = [(ANSWERS, origin, shard, pack(counts[place[i:j]])) for origin, i, j in zip(origins, ends[:-1], ends[1:], strict=True)]
            level, size = np.unique(_level(counts), return_counts=True)
            numbers = np.array([*_rare(counts), counts.sum(), len(counts)])
            yield _packed([(WORDS, shard, shard, pack(_deltas(words), counts)), (NUMBERS, shard, shard, pack(numbers, level, size)), *answers])

    return written(_dealt(trigrams.where(f"kind = {FOLLOWERS}"), n).mapInArrow(lean(merge), PACKED), "words")


def _level(counts: np.ndarray) -> np.ndarray:
    """Buckets of counts, 1/16 wide in log2."""
    return np.floor(np.log2(counts) * 16).astype(np.int64)


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from the numbers of n-grams seen once to four times."""
    if not (n1 and n2):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.95, 2.95), strict=True)]


def _cut(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.asarray(d)[np.minimum(counts, 3) - 1]


def _index(name: str, head: np.ndarray) -> tx.HashIndex:
    """The index of a model's head; a worker builds it once for a pass."""
    return held(name, lambda: tx.HashIndex(head))


@dataclass
class Orders:
    """What all shards need: discounts by order, the number of all bigrams, the probability of an unknown word."""

    cut: dict[int, list[float]]
    total: float
    rest: float

    def p1(self, counts: np.ndarray) -> np.ndarray:
        return (counts - _cut(counts, self.cut[1])) / self.total + self.rest

    @property
    def unknown(self) -> float:
        return float(np.log10(self.rest))


class Shard:
    """A shard of the model in memory, from its TRIGRAMS, WORDS and ANSWERS; other rows are left in `rows`.

    words: all in its trigrams, sorted; n-grams are of places in it.
    """

    def __init__(self, shard: int, rows: Iterator[tuple[int, int, bytes]], n: int, orders: Orders):
        none = np.zeros(0, np.int64)
        self.words, u, v, w, c, answers = np.zeros(0, np.uint64), none, none, none, none, {}
        self.own, self.own_p1, self.next = np.zeros(0, np.uint64), np.zeros(0), None
        for kind, origin, blob in rows:
            if kind == TRIGRAMS:
                deltas, *columns = unpack(blob)
                self.words = np.cumsum(deltas)
                u, v, w, c = (x.view(np.int64) for x in columns)
                del columns
            elif kind == WORDS:
                deltas, counts = unpack(blob)
                self.own, self.own_p1 = np.cumsum(deltas), orders.p1(counts.astype(np.int64))
            elif kind == ANSWERS:
                answers[origin] = unpack(blob)[0].astype(np.int64)
            else:
                self.next = kind, origin, blob
                break
        self.size = d = max(1, len(self.words))
        self.log_rest2 = np.zeros(d)
        self.bigrams = self.contexts = self.trigrams = none
        self.log_p2 = self.log_p1 = self.log_rest3 = self.log_p3 = np.zeros(0)
        self.of_bigram = self.of_context = none
        if not len(u):
            return
        two, continued = _continued(u, v, w, c, int(np.searchsorted(self.words, START)) if START in self.words else -1)
        followers = np.unique(w[two])
        home, p1 = _home(self.words[followers], n), np.zeros(d)
        for j, counts in answers.items():
            p1[followers[home == j]] = orders.p1(counts)
        # order 2: bigrams by their first word
        v2, w2 = v[two], w[two]
        del w, followers, home, answers
        first = _runs(v2)
        total = np.add.reduceat(continued, first)
        rest2 = np.add.reduceat(_cut(continued, orders.cut[2]), first) / total
        size = np.diff(first, append=len(v2))
        p2 = (continued - _cut(continued, orders.cut[2])) / np.repeat(total, size) + np.repeat(rest2, size) * p1[w2]
        self.log_rest2[v2[first]] = np.log10(rest2)
        self.bigrams, self.log_p2, self.log_p1 = v2 * d + w2, np.log10(p2), np.log10(p1[w2])
        del continued, v2, w2, p1, total, rest2, size
        # order 3: trigrams by their first two words
        v *= d
        v += u
        self.contexts, of_context = np.unique(v, return_inverse=True)
        del v
        self.of_context = of_context.astype(np.int32)
        del of_context
        self.of_bigram = np.repeat(np.arange(len(two), dtype=np.int32), np.diff(two, append=len(u)))
        self.trigrams = self.of_bigram * np.int64(d)
        self.trigrams += u
        del u
        total = np.bincount(self.of_context, c)
        cut = _cut(c, orders.cut[3])
        rest3 = np.bincount(self.of_context, cut) / total
        self.log_rest3 = np.log10(rest3)
        p3 = (c - cut) / total[self.of_context]
        del c, cut, total
        p3 += rest3[self.of_context] * p2[self.of_bigram]
        self.log_p3 = np.log10(p3, out=p3)

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Places of `wanted` in a sorted table, where `some`; -1 for others."""
        out = np.full(len(wanted), -1, np.int64)
        i = np.flatnonzero(some)
        if len(table) and len(i):
            at = np.minimum(np.searchsorted(table, wanted[i]), len(table) - 1)
            hit = table[at] == wanted[i]
            out[i[hit]] = at[hit]
        return out

    def places(self, words: np.ndarray) -> np.ndarray:
        return self._find(self.words, words, np.ones(len(words), bool))

    def added(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the words (places) before w add to log10 of its probability; all in order of v, at best."""
        two = self._find(self.bigrams, v * self.size + w, (v >= 0) & (w >= 0))
        context = self._find(self.contexts, v * self.size + u, (v >= 0) & (u >= 0))
        three = self._find(self.trigrams, two * self.size + u, (two >= 0) & (context >= 0))
        out = np.where(v >= 0, self.log_rest2[v], 0.0)
        out[two >= 0] = (self.log_p2 - self.log_p1)[two[two >= 0]]
        out[context >= 0] += self.log_rest3[context[context >= 0]]
        out[three >= 0] = self.log_p3[three[three >= 0]] - self.log_p1[two[three >= 0]]
        return out

    def added_alone(self, words: np.ndarray, unknown: float) -> np.ndarray:
        """What its own words' probabilities are above that of an unknown word, in log10."""
        at = self._find(self.own, words, np.ones(len(words), bool))
        out = np.zeros(len(words))
        out[at >= 0] = np.log10(self.own_p1[at[at >= 0]]) - unknown
        return out

    def values(self, unknown: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hashes, values) of n-grams; a value is what the n-gram adds to the estimate without it, as it ends a text or goes before a word."""
        (v2, w2), (v, u) = np.divmod(self.bigrams, self.size), np.divmod(self.contexts, self.size)
        yield gram_hash(self.own), np.log10(self.own_p1) - unknown
        first = np.unique(v2)
        yield gram_hash(self.words[first]), self.log_rest2[first]
        yield gram_hash(self.words[v2], self.words[w2]), self.log_p2 - self.log_rest2[v2] - self.log_p1
        yield gram_hash(self.words[u], self.words[v]), self.log_rest3
        b = self.of_bigram
        u = self.trigrams - b * np.int64(self.size)
        yield gram_hash(self.words[u], self.words[v2[b]], self.words[w2[b]]), self.log_p3 - self.log_rest3[self.of_context] - self.log_p2[b]


@dataclass
class Language:
    """A trained model: packed rows of n shards, and what goes to the tasks: the head, and whether it has all words."""

    packed: DataFrame
    n: int
    orders: Orders
    head: np.ndarray
    values: np.ndarray
    complete: bool
    parts: tuple[DataFrame, ...] = ()

    @property
    def shards(self) -> DataFrame:
        """(gram, value): hashes of all n-grams, and what each adds to log10 of a text's probability where it occurs."""
        n, orders = self.n, self.orders

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, rows in _by_shard(batches):
                for gram, value in Shard(shard, rows, n, orders).values(orders.unknown):
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(value)], ["gram", "value"])

        return _dealt(self.packed, n).mapInArrow(lean(run), "gram long, value double").groupBy("gram").agg(F.sum("value").alias("value"))

    def drop(self) -> None:
        """Delete its tables."""
        for table in self.parts:
            drop_written(table)


def train(texts: DataFrame) -> Language:
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = SLICES * max(min(spark.sparkContext.defaultParallelism, size // (SLICES * LEAST_SHARD)), -(-size // (SLICES * SHARD_BYTES)), 1)
    trigrams = count_trigrams(texts, n)
    collect_garbage(spark)
    words = count_words(trigrams, n)
    of = lambda table: [unpack(r.blob) for r in table.where(f"kind = {NUMBERS}").select("blob").collect()]  # noqa: E731  # n rows, of a thousand numbers at most
    rare = np.sum([x for (x,) in of(trigrams)] or [[0] * 8], 0, dtype=np.int64).tolist()
    numbers = of(words)
    *rare_words, total, different = np.sum([x for x, _, _ in numbers] or [[0] * 6], 0, dtype=np.int64).tolist()
    cut = {3: discounts(*rare[:4]), 2: discounts(*rare[4:]), 1: discounts(*rare_words)}
    all_cut = rare_words[0] * cut[1][0] + rare_words[1] * cut[1][1] + (different - sum(rare_words[:2])) * cut[1][2]
    orders = Orders(cut, float(total or 1), (all_cut / total if total else 1.0) / (different + 1))
    # the head: all words from some bucket of counts up
    sizes: dict[int, int] = {}
    for _, levels, many in numbers:
        for k, m in zip(levels.tolist(), many.tolist(), strict=True):
            sizes[k] = sizes.get(k, 0) + m
    held, least = 0, None
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > HEAD:
            break
        held, least = held + sizes[k], k

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                deltas, counts = unpack(blob)
                own = _level(counts) >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(deltas)[own].view(np.int64)), pa.array(counts[own].astype(np.int64))], ["word", "c"])

    head, values = np.zeros(0, np.uint64), np.zeros(0)
    if least is not None:
        top = words.where(f"kind = {WORDS}").select("blob").mapInArrow(lean(frequent), "word long, c long").toArrow()  # HEAD rows at most
        head, values = top["word"].to_numpy().view(np.uint64), np.log10(orders.p1(top["c"].to_numpy())) - orders.unknown
    packed = trigrams.where(f"kind = {TRIGRAMS}").unionByName(words.where(f"kind in ({WORDS}, {ANSWERS})"))
    return Language(packed, n, orders, head, values, held == different, (trigrams, words))


def good_documents(labels: DataFrame) -> DataFrame:
    """doc_id of documents labelled good and not toxic, and whether they set the thresholds."""
    good = labels.where("doc_id is not null and quality > 0 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.withColumn("calibrates", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == CALIBRATION)


def fit(docs: DataFrame, labels: DataFrame) -> Language:
    """From the texts of all good documents that do not set the thresholds."""
    ids = good_documents(labels).where("not calibrates").select("doc_id")
    few = ids.count() <= BROADCAST_IDS
    return train(docs.select("doc_id", "text").join(ids.hint("broadcast" if few else "merge"), "doc_id", "left_semi"))


def perplexities(docs: DataFrame, model: Language, key: str | None = None) -> DataFrame:
    """key, doc_id, lang, n_tokens, log_ppl (log10 of the perplexity for a token) of each row of `docs`, written.

    key: a long column that is handed on; null without one.
    """
    spark = docs.sparkSession
    short_batches(spark)
    n, orders, unknown = model.n, model.orders, model.orders.unknown
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((model.head, model.values, model.complete))
    text = F.col("text").cast("string")
    texts = docs.select(F.xxhash64(text).alias("id"), text.alias("text"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows, with the sum over their words as if each stood alone; those not in the head are taken for unknown."""
        head, value, _ = shared.value
        index, value = _index(name, head), np.append(value, 0.0)
        for batch in batches:
            for i, j, chunk in binary_chunks(batch.column(4), CHUNK):
                s, owner, words = sequences(chunk)
                inner = np.flatnonzero(s != START)
                different, codes = np.unique(s[inner], return_inverse=True)
                total = np.bincount(owner[inner], value[index.find(different)][codes], len(chunk)) + unknown * (words + 1)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(4)), pa.array(np.where(words > 0, words + 1, 0)), pa.array(total, mask=words == 0)], ["key", "id", "doc_id", "lang", "n_tokens", "total"])

    def asking(part: int):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """For each shard of the pass: ids of texts; text and words of trigrams; text and word where the word is not in the head."""
            head, _, complete = shared.value
            index = _index(name, head)
            for batch in batches:
                for i, j, chunk in binary_chunks(batch.column(1), PACK_CHUNK):
                    ids = np.asarray(batch.column(0).slice(i, j - i)).view(np.uint64)
                    s, owner, words = sequences(chunk)
                    different, codes = np.unique(s, return_inverse=True)
                    home = _home(different, n)
                    now = home % SLICES == part
                    rare = index.find(different) < 0
                    known = np.ones(len(different), bool)
                    if complete:  # a word that is not in the head follows nothing, and nothing follows it but the mark
                        known, rare = ~rare | (different == START), np.zeros(len(different), bool)
                    rows = []
                    inner = (s != START) & (words[owner] > 0)
                    at = np.flatnonzero(inner & np.append(False, (now & known)[codes[:-1]]))
                    at = at[np.argsort(home[codes[at - 1]], kind="stable")]
                    alone = np.flatnonzero(inner & (now & rare)[codes])
                    alone = alone[np.argsort(home[codes[alone]], kind="stable")]
                    of, of_alone = home[codes[at - 1]], home[codes[alone]]
                    for k in range(part, n, SLICES):
                        three = at[slice(*np.searchsorted(of, [k, k + 1]))]
                        one = alone[slice(*np.searchsorted(of_alone, [k, k + 1]))]
                        if len(three) or len(one):
                            rows.append((ASKED, k, 0, pack(ids, owner[three], owner[one], *_coded(different, codes[three - 2], codes[three - 1], codes[three], codes[one]))))
                    if rows:
                        yield _packed(rows)

        return ask

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            table = Shard(shard, rows, n, orders)
            row = table.next
            while row is not None:
                ids, owner, owner_alone, deltas, u, v, w, alone = unpack(row[2])
                words = np.cumsum(deltas)
                place = table.places(words)
                sums = np.bincount(owner.astype(np.int64), table.added(*(place[x.astype(np.int64)] for x in (u, v, w))), len(ids))
                sums += np.bincount(owner_alone.astype(np.int64), table.added_alone(words[alone.astype(np.int64)], unknown), len(ids))
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some].view(np.int64)), pa.array(sums[some])], ["id", "added"])
                row = next(rows, None)

    read = docs.select((F.lit(None).cast("long") if key is None else F.col(key)).alias("key"), F.xxhash64(text).alias("id"), F.col("doc_id").cast("long"), F.col("lang").cast("string"), text.alias("text"))
    base = written(read.mapInArrow(lean(begin, name), "key long, id long, doc_id long, lang string, n_tokens long, total double"), "alone")
    sums = []
    for part in range(SLICES):
        rows = model.packed.where(F.col("shard") % SLICES == part).unionByName(texts.mapInArrow(lean(asking(part), name), PACKED))
        sums.append(written(_dealt(rows, n, SLICES).mapInArrow(lean(answer, name), "id long, added double").groupBy("id").agg(F.sum("added").alias("added")), "added"))
        collect_garbage(spark)
    # each row of a text has asked for it
    copies = base.groupBy("id").agg(F.count("*").alias("copies"))
    added = functools.reduce(DataFrame.unionByName, sums).groupBy("id").agg(F.sum("added").alias("added")).join(copies.hint("merge"), "id").select("id", (F.col("added") / F.col("copies")).alias("added"))
    out = base.join(added.hint("merge"), "id", "left")
    out = written(out.select("key", "doc_id", "lang", "n_tokens", (-(F.col("total") + F.coalesce("added", F.lit(0.0))) / F.greatest("n_tokens", F.lit(1))).alias("log_ppl")), "perplexity")
    for table in (base, *sums):
        drop_written(table)
    return out


def thresholds(scored: DataFrame, labels: DataFrame, quantile: float, slack: float, least: int = 50) -> DataFrame:
    """(lang, threshold): the bound on log_ppl of each language with `least` documents, and of all together (null).

    The quantile (to STEP) of all good documents that the model has not seen, plus `slack`.
    """
    good = good_documents(labels).where("calibrates").select("doc_id")
    bucket = F.ceil(F.col("log_ppl") / STEP).cast("long").alias("bucket")
    counts = scored.where("log_ppl is not null").join(good, "doc_id", "left_semi").groupBy("lang", bucket).agg(F.count("*").alias("n"))
    counts = counts.where("lang is not null").unionByName(counts.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")))
    by_lang = Window.partitionBy("lang")
    below = counts.withColumn("below", F.sum("n").over(by_lang.orderBy("bucket"))).withColumn("total", F.sum("n").over(by_lang))
    enough = below.where(F.col("lang").isNull() | (F.col("total") >= least))
    return enough.where(F.col("below") >= quantile * F.col("total")).groupBy("lang").agg((F.min("bucket") * STEP + slack).alias("threshold"))


def judge(scored: DataFrame, bounds: DataFrame) -> DataFrame:
    """`scored` with threshold and kept; `bounds` has a row for each language at most."""
    rest = bounds.where("lang is null").select("threshold").first()
    own = bounds.where("lang is not null")
    common = F.lit(None if rest is None else rest.threshold).cast("double")
    out = scored.join(own, "lang", "left").withColumn("threshold", F.coalesce("threshold", common))
    return out.withColumn("kept", F.col("log_ppl").isNotNull() & F.coalesce(F.col("log_ppl") <= F.col("threshold"), F.lit(True)))


def keep_rows(docs: DataFrame, labels: DataFrame, quantile: float, slack: float) -> DataFrame:
    """The rows of `docs`, all columns, that are kept.  The verdict hangs on text and language alone, so rows find theirs by a hash of the text, and the language."""
    key = column_free_name(docs, "key")
    marked = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    scored = perplexities(marked, fit(docs, labels), key)
    kept = judge(scored, thresholds(scored, labels, quantile, slack)).where("kept").select(F.col("key").alias(f"_{key}"), F.col("lang").alias(f"_{key}_lang")).distinct()
    same = (F.col(key) == F.col(f"_{key}")) & F.col("lang").cast("string").eqNullSafe(F.col(f"_{key}_lang"))
    return marked.join(kept.hint("merge"), same, "left_semi").select(*docs.columns)
