"""LM scoring: a hidden Markov language model, trained by Baum-Welch over all training text.

Symbols are the most frequent words (at most `head`), `TAIL` classes
that share out all other words by hash, and the end of a text.  A word of a
tail class has the class's emission times its own share of the class, from the
counts of all words.  So the state tables have a fixed size, while the counts
cover every word of the corpus.

Plan: one pass counts words (by 64-bit hash, each task sends a word once) and
the counts are summed into a table.  The training texts are written once as
symbols.  From random tables, each of `rounds` Baum-Welch rounds runs the scaled
forward-backward recursion over *all* training texts, sums the expected counts
of each symbol across partitions, and sets the new tables.  Last, one pass
scores every text by the scaled forward recursion; its words outside the head
are joined with the counts, already grouped by word within a task, and added.
The frequent words never take part in a shuffle.

Words are told apart by 64-bit hashes.  A text of any length is one sequence;
of a long one, forward values are kept at intervals and found again.

Defined results: a null or empty text is its end alone; repeated rows are
scored alike, one result each; a null doc_id has no remainder and is held out;
without training texts all counts are zero and every word has the same
probability; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .shared import binary_chunks, drop_written, most_frequent, short_batches, written

#: The hash that stands for the end of a text in the count table.
END = np.uint64(0x454E44)
TAIL = 1024
#: Tokens (with padding) that the recursion holds at once.
CELLS = 1 << 20
#: Symbols of encoded texts that a task of a round gathers before the recursion.
HELD = 1 << 22
#: Bytes of symbols a task of a round, about.
ROUND_BYTES = 64 << 20


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c): hash and count of every word of `train` (text), ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "c"])

        for batch in batches:
            for _, _, texts in binary_chunks(batch.column(0)):
                words, n = np.unique(tx.tokens(texts, lower=True).hashes, return_counts=True)
                held.append((np.append(words, END), np.append(n, len(texts))))
                if sum(len(w) for w, _ in held) > 3_000_000:
                    yield flush()
        if held:
            yield flush()

    return train.select(F.col("text").cast("string")).mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The head words with their counts, and of each tail class the count of its tokens and of its different words."""

    words: np.ndarray
    counts: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    n: int
    v: int

    def __post_init__(self) -> None:
        self.index = tx.HashIndex(self.words)

    @property
    def symbols(self) -> int:
        return len(self.words) + TAIL + 1

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        at = self.index.find(hashes)
        tail = at < 0
        at[tail] = len(self.words) + (hashes[tail] % np.uint64(TAIL)).astype(np.int64)
        return at.astype(np.int32)

    def unigram(self) -> np.ndarray:
        """Smoothed probabilities of the symbols; ends are counted in `end`."""
        ends = self.n - self.counts.sum() - self.tail_tokens.sum()
        total = np.concatenate([self.counts, self.tail_tokens, [ends]]) + 0.5
        return total / total.sum()


def vocabulary(counts: DataFrame, head: int) -> Vocabulary:
    words = counts.where(F.col("word") != int(END))
    top = most_frequent(words, "c", head).orderBy(F.desc("c"), "word").toArrow()  # `head` rows at most
    known = top["word"].to_numpy()
    total = counts.agg(F.sum("c"), F.count("*")).first()
    tail_tokens, tail_words = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    in_class = F.col("word").bitwiseAND(TAIL - 1)  # the unsigned remainder, as in `encode`: TAIL is a power of two
    for r in words.groupBy(in_class.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("w")).collect():  # TAIL rows
        tail_tokens[r.k], tail_words[r.k] = r.c, r.w
    top_class = (known.view(np.uint64) % np.uint64(TAIL)).astype(np.int64)
    np.subtract.at(tail_tokens, top_class, top["c"].to_numpy())
    np.subtract.at(tail_words, top_class, 1)
    return Vocabulary(known.view(np.uint64), top["c"].to_numpy(), tail_tokens, tail_words, total[0] or 0, total[1])


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray  # [state, next state]
    emit: np.ndarray  # [symbol, state]


def _batches(symbols: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, their lengths, symbols [time, text]) of like lengths, longest first; together CELLS symbols or one text."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        longest = max(1, int(lengths[order[at]]))
        rows = order[at : at + max(1, CELLS // longest)]
        n = lengths[rows]
        grid = np.zeros((len(rows), longest), np.int32)
        inside = np.arange(longest) < n[:, None]
        grid[inside] = symbols[np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        yield rows, n, np.ascontiguousarray(grid.T)
        at += len(rows)


def forward(model: Model, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 probability of each symbol sequence; every one has a symbol at least."""
    out = np.zeros(len(bounds) - 1)
    for rows, n, grid in _batches(symbols, bounds):
        active = np.searchsorted(-n, -np.arange(len(grid)), side="left")  # texts longer than t
        a = model.start * model.emit[grid[0]]
        scale = a.sum(1)
        logs = np.log10(scale, dtype=np.float64)
        a /= scale[:, None]
        for t in range(1, len(grid)):
            k = active[t]
            a = a[:k] @ model.step
            a *= model.emit[grid[t, :k]]
            scale = a.sum(1)
            a /= scale[:, None]
            logs[:k] += np.log10(scale)
        out[rows] = logs
    return out


def _stretch(model: Model, symbols: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward values of a stretch of a text, and its emissions over the scales; before: the value ahead of it."""
    ahead = np.take(model.emit, symbols, axis=0)
    alpha = np.empty_like(ahead)
    for t in range(len(symbols)):
        a = np.multiply(model.start if before is None else before @ model.step, ahead[t], out=alpha[t])
        c = a.sum()
        a /= c
        ahead[t] /= c
        before = a
    return alpha, ahead


def _expected_long(model: Model, symbols: np.ndarray, starts: np.ndarray, steps: np.ndarray, emitted: np.ndarray) -> None:
    """`expected` of one long text, added to the sums (steps before they are multiplied by the model's).

    Forward values are kept at the beginnings of stretches of CELLS tokens, and
    found again for a stretch on the way back: memory has the size of a stretch.
    """
    before: list[np.ndarray | None] = [None]
    for i in range(0, len(symbols) - CELLS, CELLS):
        before.append(_stretch(model, symbols[i : i + CELLS], before[-1])[0][-1].copy())
    back, message = np.ascontiguousarray(model.step.T), None
    for k in range(len(before) - 1, -1, -1):
        own = symbols[k * CELLS : (k + 1) * CELLS]
        alpha, later = _stretch(model, own, before[k])
        for t in range(len(own) - 1, -1, -1):  # later[t] becomes what step t tells the one before
            if message is not None:
                later[t] *= message @ back
            message, beyond = later[t], message
            if t == len(own) - 1:
                behind = beyond
        following = later[1:] if behind is None else np.vstack([later[1:], behind])
        m = len(following)
        steps += alpha[:m].T @ following
        alpha[:m] *= following @ back
        message = message.copy()
        if k == 0:
            starts += alpha[0]
        for s in range(len(model.start)):
            emitted[:, s] += np.bincount(own, alpha[:, s], len(emitted))


def expected(model: Model, symbols: np.ndarray, bounds: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected starts and steps; `emitted` [symbol, state] is added to."""
    states = len(model.start)
    starts, steps = np.zeros(states), np.zeros((states, states))
    back, ones = np.ascontiguousarray(model.step.T), np.ones(states, model.emit.dtype)
    for _, n, grid in _batches(symbols, bounds):
        if len(grid) > CELLS:  # one text alone
            _expected_long(model, grid[:, 0], starts, steps, emitted)
            continue
        # all cells of active texts, time after time
        flat = grid[np.arange(len(grid))[:, None] < n]
        active = np.searchsorted(-n, -np.arange(len(grid)), side="left")
        at = np.concatenate([[0], np.cumsum(active)])
        begin, active = at.tolist(), active.tolist()
        ahead = np.take(model.emit, flat, axis=0)
        alpha, scale = np.empty_like(ahead), np.empty(len(flat), ahead.dtype)
        for t, k in enumerate(active):
            i = begin[t]
            a = alpha[i : i + k]
            if t:
                np.matmul(alpha[before : before + k], model.step, out=a)
                a *= ahead[i : i + k]
            else:
                np.multiply(model.start, ahead[:k], out=a)
            c = np.matmul(a, ones, out=scale[i : i + k])
            a /= c[:, None]
            before = i
        ahead /= scale[:, None]
        beta = np.ones((active[0], states), ahead.dtype)  # texts already ended keep their ones
        for t in range(len(active) - 1, 0, -1):
            k, i = active[t], begin[t]
            b = ahead[i : i + k]
            b *= beta[:k]
            np.matmul(b, back, out=beta[:k])
        later, first = ahead[active[0] :], active[0]
        previous = np.arange(first, len(flat)) - np.repeat(active[:-1], active[1:])
        steps += np.take(alpha, previous, axis=0).T @ later
        alpha[previous] *= later @ back
        starts += alpha[:first].sum(0)
        for s in range(states):
            emitted[:, s] += np.bincount(flat, alpha[:, s], len(emitted))
    return starts, steps * model.step


def maximised(starts: np.ndarray, steps: np.ndarray, emitted: np.ndarray, prior: np.ndarray, weight: float) -> Model:
    """New tables; each state's emissions are smoothed by `weight` tokens of the unigram distribution."""
    emit = (emitted + weight * prior[:, None]) / (emitted.sum(0) + weight)
    step = (steps + 0.1) / (steps + 0.1).sum(1, keepdims=True)
    return Model(((starts + 0.1) / (starts + 0.1).sum()).astype(np.float32), step.astype(np.float32), emit.astype(np.float32))


def _ended(t: tx.Tokens, symbols: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with the end behind each text's, and the new bounds."""
    return np.insert(symbols, t.bounds[1:], end), t.bounds + np.arange(len(t.bounds))


def random_tables(vocab: Vocabulary, states: int, seed: int) -> Model:
    """Tables to begin with; without training texts, those of no counts."""
    prior = vocab.unigram()
    if not vocab.n:
        return maximised(np.ones(states), np.ones((states, states)), np.tile(prior[:, None], states), prior, 1.0)
    noise = np.random.default_rng(seed).gamma(1.0, 1.0, (len(prior), states))
    return maximised(np.ones(states), np.ones((states, states)) + 4 * np.eye(states), prior[:, None] * noise * 1e4, prior, 1.0)


def encoded(train: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(symbols): those of each row of `train` (text) with its end, as the bytes of 32-bit integers."""
    shared = train.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            for _, _, texts in binary_chunks(batch.column(0), 8 << 20):
                t = tx.tokens(texts, lower=True)
                symbols, bounds = _ended(t, vocab.encode(t.hashes), vocab.symbols - 1)
                yield pa.RecordBatch.from_arrays([pa.array([symbols[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["symbols"])

    return train.select(F.col("text").cast("string")).mapInArrow(run, "symbols binary")


def baum_welch(train: DataFrame, vocab: Vocabulary, model: Model) -> Model:
    """One round over all of `train` (symbols)."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(model)
    n_symbols, states = model.emit.shape
    prior = vocab.unigram()
    names = [f"e{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        emitted = np.zeros((n_symbols, states))
        starts, steps = np.zeros(states), np.zeros((states, states))
        held: list[bytes] = []
        size = 0

        def add() -> None:
            bounds = np.cumsum([0, *(len(x) // 4 for x in held)])
            s, x = expected(model, np.frombuffer(b"".join(held), np.int32), bounds, emitted)
            held.clear()
            np.add(starts, s, out=starts)
            np.add(steps, x, out=steps)

        for batch in batches:
            for text in batch.column(0):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= 4 * HELD:
                    add()
                    size = 0
        if held:
            add()
        seen = np.flatnonzero(emitted.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(emitted[seen, k]) for k in range(states))], ["symbol", *names])
        extra = np.vstack([starts, steps])  # rows below zero: starts, then the steps from each state
        yield pa.RecordBatch.from_arrays([pa.array(-1 - np.arange(states + 1)), *(pa.array(extra[:, k]) for k in range(states))], ["symbol", *names])

    # rounded to whole millionths: sums of integers do not depend on the order of tasks
    sums = train.mapInArrow(run, "symbol long, " + ", ".join(f"{n} double" for n in names)).groupBy("symbol").agg(*(F.sum(F.round(F.col(n) * 1e6).cast("long")).alias(n) for n in names)).toArrow()  # a row for each symbol
    emitted, extra = np.zeros((n_symbols, states)), np.zeros((states + 1, states))
    at, values = sums["symbol"].to_numpy(), np.column_stack([sums[n].to_numpy() for n in names]) / 1e6
    emitted[at[at >= 0]] = values[at >= 0]
    extra[-1 - at[at < 0]] = values[at < 0]
    shared.unpersist()
    return maximised(extra[0], extra[1:], emitted, prior, 200.0)


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocab, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and one for each tail word of a task's chunk, with the texts that have it."""
        vocab, model = shared.value
        part, serial = TaskContext.get().partitionId() << 36, 0
        floor = vocab.n + 0.5 * (vocab.v + 1)
        head_log = np.log10((np.append(vocab.counts, vocab.n - vocab.counts.sum() - vocab.tail_tokens.sum()) + 0.5) / floor)
        class_log = np.log10(vocab.tail_tokens + 0.5 * (vocab.tail_words + 1))
        ends_known = int(vocab.n > 0)
        for batch in batches:
            for i, j, texts in binary_chunks(batch.column(1), 8 << 20):
                t = tx.tokens(texts, lower=True)
                symbols = vocab.encode(t.hashes)
                in_head = symbols < len(vocab.words)
                base = np.zeros(len(symbols))
                base[in_head] = head_log[symbols[in_head]]
                share = np.zeros(len(symbols))
                tail = np.flatnonzero(~in_head)
                share[tail] = -class_log[symbols[tail] - len(vocab.words)]
                rows = part + serial + np.arange(len(texts))
                serial += len(texts)
                exact = forward(model, *_ended(t, symbols, vocab.symbols - 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows),
                        batch.column(0).slice(i, j - i),
                        pa.array(t.counts + 1),
                        pa.array(tx.summed(in_head.astype(np.int64), t.bounds) + ends_known),
                        pa.array(tx.summed(base, t.bounds) + head_log[-1]),
                        pa.array(exact + tx.summed(share, t.bounds)),
                        pa.nulls(len(texts), pa.int64()),
                        pa.nulls(len(texts), pa.list_(pa.int64())),
                    ],
                    ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "word", "rows"],
                )
                order = np.argsort(t.hashes[tail], kind="stable")
                words, first = np.unique(t.hashes[tail][order], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(rows[t.owners[tail][order]]))
                none = pa.nulls(len(words), pa.int64())
                real = pa.nulls(len(words), pa.float64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, real, real, pa.array(words.view(np.int64)), lists], ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "word", "rows"])

    both = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, word long, rows array<long>"), "scores")
    floor = float(vocab.n + 0.5 * (vocab.v + 1))
    tail = both.where("word is not null").select("word", "rows").join(counts, "word", "left").select(F.explode("rows").alias("row"), F.coalesce("c", F.lit(0)).alias("c"))
    gain = F.log10(F.col("c") + 0.5)
    # for a tail word, the base has log10((c + 0.5) / floor) and the model the same numerator over its class's total, which is in `score` already
    added = tail.groupBy("row").agg(F.sum(gain).alias("gain"), F.count("*").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("known"))
    texts = both.where("row is not null").select("row", "doc_id", "n_tokens", "n_known", "base_score", "score")
    out = texts.join(added, "row", "left")
    gain, n = F.coalesce("gain", F.lit(0.0)), F.coalesce("n", F.lit(0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("base_score") + gain - n * F.log10(F.lit(floor))).alias("base_score"), (F.col("score") + gain).alias("score"))


def language_scores(docs: DataFrame, states: int = 8, head: int = 1 << 16, rounds: int = 13, seed: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of `docs`.

    Learns from rows whose crc32(doc_id as text) mod 5 is not 1, in `rounds`
    rounds over all of them.
    """
    short_batches(docs.sparkSession)
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    train = docs.where(remainder != 1)
    counts = written(word_counts(train), "words")
    vocab = vocabulary(counts, head)
    model = random_tables(vocab, states, seed)
    if vocab.n:
        texts = written(encoded(train, vocab), "symbols")
        # a task's sums have the size of the tables, so there are few tasks but for the text they hold
        rounds_over = texts.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-4 * vocab.n // ROUND_BYTES)))
        for _ in range(rounds):
            model = baum_welch(rounds_over, vocab, model)
        drop_written(texts)
    out = score(docs, counts, vocab, model)
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return out.select("doc_id", (F.coalesce(remainder, F.lit(1)) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(vocab.n).cast("long").alias("train_tokens"), "base_score", "score")
