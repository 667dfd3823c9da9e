"""Quality rules: an isolation forest on rule statistics, with a threshold from labelled rows.

`rule_table` computes the statistics of every whole text in one pass.
`fit` draws a bounded sample of rows (documented parameters `n_trees` and
`sample_size`, as the method has it), grows random trees, and then scores
*all* labelled rows to set the threshold.  `judge` scores the table;
`keep_rows` filters documents by the same verdict.

Defined results: a null text counts as empty; an empty text has zero
statistics and fails the base rule (fewer than ten words); repeated rows are
judged alike; an empty table gives an empty result; without labelled rows of
both kinds no row is rejected for its score.  Other columns of the input are
ignored by `rule_table` and kept by `keep_rows`.  Where a document has several
labels the lowest holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import binary_chunks, lean, make_room, of_lowest_hash, short_batches

#: Characters counted as symbols (fixed by the contract).
SYMBOLS = b"#*$%&|<>"

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
SCHEMA = "doc_id long, " + ", ".join(f"{s} long" for s in STATISTICS)

#: Score buckets for the threshold.
BUCKETS = 4096

_CLASS = np.zeros((3, 256), bool)
_CLASS[0, list(SYMBOLS)] = True
_CLASS[1, 0x41:0x5B] = True
_CLASS[2] = ~tx.SPACE
_CLASS[2, 0x80:0xC0] = False  # continuation bytes are no code points of their own


def rule_statistics(texts: list[bytes], window: int = 5) -> dict[str, np.ndarray]:
    """Statistics of each text; exact but for collisions of 64-bit hashes within one text."""
    words, rows = tx.tokens(texts), tx.lines(texts)
    n = len(texts)
    out = {"n_words": words.counts}
    lengths = np.fromiter(map(len, texts), np.int64, n)
    begins = np.zeros(n + 1, np.int64)
    np.cumsum(lengths + 1, out=begins[1:])
    for k, name in enumerate(("n_symbols", "n_upper", "word_chars")):
        hits = np.flatnonzero(_CLASS[k][words.data])
        out[name] = np.diff(np.searchsorted(hits, begins))
    # lines with a word: some word begins within them
    worded = np.searchsorted(words.starts, rows.starts) < np.searchsorted(words.starts, rows.ends)
    owners, hashes = rows.owners[worded], rows.hashes[worded]
    out["n_lines"] = np.bincount(owners, minlength=n)
    keys = tx.mix(hashes + owners.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    first = np.unique(keys, return_index=True)[1]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owners[first], minlength=n)
    # words covered by windows that occur again in the same text
    hashes, first = tx.windows(words, window)
    covered = np.zeros(len(words.hashes) + 1, np.int64)
    if len(first):
        keys = tx.mix(hashes + words.owners[first].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        order = np.argsort(keys)
        ordered = keys[order]
        same = np.flatnonzero(ordered[1:] == ordered[:-1])
        again = first[np.unique(np.concatenate([order[same], order[same + 1]]))] if len(same) else np.empty(0, np.int64)
        np.add.at(covered, again, 1)
        np.add.at(covered, again + window, -1)
    out["n_repeat_words"] = tx.summed((np.cumsum(covered)[:-1] > 0).astype(np.int64), words.bounds)
    return {k: out[k].astype(np.int64) for k in STATISTICS}


def rule_table(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row of `docs` (doc_id, text), map-only."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in binary_chunks(batch.column(1)):
                stats = rule_statistics(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(stats[s]) for s in STATISTICS)], ["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), SCHEMA)


#: Shares of repeated lines and words that ordinary texts may have; what is beyond counts.
ORDINARY_LINES, ORDINARY_WORDS = 0.3, 0.1


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios only, so that long texts are not odd for their length; digits are left out, since numbers are no fault.

    Symbols and capitals a character, repeated lines and words beyond what is ordinary, and mean word length.
    """
    v = {k: x.astype(np.float64) for k, x in stats.items()}
    words, chars, rows = (np.maximum(v[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    beyond = lambda x, ordinary: np.maximum(x - ordinary, 0.0)
    return np.column_stack([v["n_symbols"] / chars, beyond(v["n_dup_lines"] / rows, ORDINARY_LINES), beyond(v["n_repeat_words"] / words, ORDINARY_WORDS), v["n_upper"] / chars, chars / words])


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


@dataclass
class Forest:
    """Trees as arrays [tree, node]: feature (-1 at a leaf), split value, child on the left (right is next), depth."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path length / expected): near 1 for anomalies, under 0.5 for ordinary rows."""
        total = np.zeros(len(x))
        for feature, split, left, depth in zip(self.feature, self.split, self.left, self.depth, strict=True):
            at = np.zeros(len(x), np.int64)
            active = np.arange(len(x))
            while len(active):
                node = at[active]
                inner = feature[node] >= 0
                active, node = active[inner], node[inner]
                at[active] = left[node] + (x[active, feature[node]] >= split[node])
            total += depth[at]
        return np.exp2(-total / max(len(self.feature), 1) / self.norm)


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow(x: np.ndarray, n_trees: int, sample_size: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    most = int(np.ceil(np.log2(max(sample_size, 2))))
    trees = []
    for _ in range(n_trees if len(x) else 0):
        nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, rng.choice(len(x), min(sample_size, len(x)), replace=False), 0)]
        while todo:
            node, rows, level = todo.pop()
            low, high = x[rows].min(0), x[rows].max(0)
            open_ = np.flatnonzero(high > low)
            if level == most or len(rows) < 2 or not len(open_):
                nodes[node] = [-1, 0.0, 0, level + _expected(len(rows))]
                continue
            f = rng.choice(open_)
            at = rng.uniform(low[f], high[f])
            at = at if at > low[f] else high[f]
            right = x[rows, f] >= at
            nodes[node] = [f, at, len(nodes), 0.0]
            todo += [(len(nodes), rows[~right], level + 1), (len(nodes) + 1, rows[right], level + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        trees.append(np.array(nodes, float))
    size = max(map(len, trees), default=1)
    packed = np.zeros((len(trees), size, 4))
    packed[:, :, 0] = -1
    for k, t in enumerate(trees):
        packed[k, : len(t)] = t
    return Forest(packed[..., 0].astype(np.int64), packed[..., 1], packed[..., 2].astype(np.int64), packed[..., 3], max(_expected(min(sample_size, max(len(x), 2))), 1.0))


@dataclass
class RuleModel:
    forest: Forest
    threshold: float

    def verdict(self, stats: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and whether each row is kept."""
        score = self.forest.score(features(stats))
        return score, ~base_failed(stats) & (score <= self.threshold)


def threshold_from(good: np.ndarray, bad: np.ndarray, false_rate: float) -> float:
    """Upper edge of the bucket that parts the labelled rows best, rejecting at most `false_rate` of the good ones.

    good, bad: rows of either label in each score bucket.  Best: the share of
    bad rows rejected less the share of good ones.
    """
    if not good.sum() or not bad.sum():
        return np.inf
    lost = (good.sum() - np.cumsum(good)) / good.sum()
    caught = (bad.sum() - np.cumsum(bad)) / bad.sum()
    gain = np.where(lost <= false_rate, caught - lost, -1.0)
    return (int(np.argmax(gain)) + 1) / BUCKETS


def fit(table: DataFrame, labels: DataFrame, n_trees: int = 100, sample_size: int = 256, false_rate: float = 0.005, seed: int = 7) -> RuleModel:
    """Forest from `n_trees * sample_size` rows at most (different ones, of lowest hash), threshold from every labelled row.

    table: of `rule_table`.  labels: doc_id, quality (0: bad).
    """
    spark = table.sparkSession
    rows = of_lowest_hash(table, n_trees * sample_size, "doc_id", *STATISTICS).toPandas()
    forest = grow(features({s: rows[s].to_numpy(np.int64) for s in STATISTICS}), n_trees, sample_size, seed)
    model = spark.sparkContext.broadcast(RuleModel(forest, np.inf))
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            score, _ = model.value.verdict({s: batch.column(s).to_numpy() for s in STATISTICS})
            good = batch.column("quality").to_numpy(zero_copy_only=False) > 0
            bucket = np.clip((score * BUCKETS).astype(np.int64), 0, BUCKETS - 1)
            for k in (0, 1):
                counts[k] += np.bincount(bucket[good == k], minlength=BUCKETS)
        good, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(good), pa.array(bucket), pa.array(counts[good, bucket])], ["good", "bucket", "n"])

    # rows that the base rules reject anyway say nothing about the threshold
    judged = table.where("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words").join(marked, "doc_id").select(*STATISTICS, "quality")
    counts = np.zeros((2, BUCKETS), np.int64)
    for r in judged.mapInArrow(run, "good long, bucket long, n long").groupBy("good", "bucket").agg(F.sum("n").alias("n")).collect():  # 2 * BUCKETS rows at most
        counts[r.good, r.bucket] = r.n
    return RuleModel(forest, threshold_from(counts[1], counts[0], false_rate))


def judge(table: DataFrame, model: RuleModel) -> DataFrame:
    """The table's columns, base_failed, score (anomaly, 0 to 1) and kept."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = {s: batch.column(s).to_numpy() for s in STATISTICS}
            score, kept = shared.value.verdict(stats)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base_failed(stats)), pa.array(score), pa.array(kept)], [*batch.schema.names, "base_failed", "score", "kept"])

    return table.select("doc_id", *STATISTICS).mapInArrow(run, SCHEMA + ", base_failed boolean, score double, kept boolean")


def keep_rows(docs: DataFrame, model: RuleModel) -> DataFrame:
    """The rows of `docs`, all columns, that the model keeps; the text alone goes to Python, no shuffle."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def kept(column: pa.Array) -> pa.Array:
        make_room()
        parts = [shared.value.verdict(rule_statistics(texts))[1] for _, _, texts in binary_chunks(column)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0, bool))

    return docs.where(kept(F.col("text").cast("string")))
