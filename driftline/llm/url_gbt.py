"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

A rule (`host/path`) fits its host and all subdomains where the URL's path
starts with the rule's; the longest rule that fits decides.  The trees learn
from labelled URLs: lengths, depth, digit ratio, entropy, parameter counts and
statistics of the host's suffixes.  They are fitted on the driver to at most
`max_labelled` labelled rows (those of lowest hash of the URL); judging is one
map-only pass over all rows.  Host, path, rule and lexical features are columns;
Python sees the features alone.

Defined results: a null URL, or one without `://`, has an empty host and path,
fits no rule and is judged by its features like any other; repeated rows are
judged alike; among rules of equal length the least string wins; where labels
are all of one kind, or there are none, the trees say that kind, or allow; an
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import of_lowest_hash

#: A-Z, lower-cased; other letters stay.
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(urls: DataFrame) -> DataFrame:
    """`urls` (url) with host and path: what follows the first `://`, up to `/`, `?` or `#`, and from there up to `?` or `#`."""
    begin = F.instr("url", "://")
    rest = F.when(begin > 0, F.substring("url", begin + 3, F.length("url"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return urls.withColumns({"host": F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _SMALL), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def with_rule(parts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """`parts` (host, path) with rule and rule_verdict: the longest rule that fits, of equal ones the least; null without one.

    rules: (verdict, host/path).  Each suffix of the host is looked up in a map of
    the rules by host, so the cost grows with the labels of a host.
    """
    by_host: dict[str, list[dict]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        by_host.setdefault(host, []).append({"path": slash + path, "shortness": -len(rule), "rule": rule, "verdict": verdict})
    known = F.from_json(F.lit(json.dumps(by_host)), "map<string,array<struct<path:string,shortness:int,rule:string,verdict:string>>>")
    labels = F.split("host", "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    none = F.array().cast("array<struct<path:string,shortness:int,rule:string,verdict:string>>")
    found = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(known, s), none)))
    fits = F.filter(found, lambda r: F.startswith(F.col("path"), r.path))
    best = F.array_min(F.transform(fits, lambda r: F.struct(r.shortness.alias("shortness"), r.rule.alias("rule"), r.verdict.alias("verdict"))))
    return parts.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.verdict")}).drop("_best")


@dataclass
class Suffixes:
    """Share of blocked URLs and number of URLs by host suffix, from the labelled rows."""

    blocked: dict[str, tuple[int, int]] = field(default_factory=dict)
    prior: float = 0.5

    @classmethod
    def of(cls, hosts: list[str], labels: np.ndarray) -> Suffixes:
        out = cls(prior=float(labels.mean()) if len(labels) else 0.5)
        for host, y in zip(hosts, labels.tolist(), strict=True):
            for s in cls.names(host):
                n, b = out.blocked.get(s, (0, 0))
                out.blocked[s] = (n + 1, b + int(y))
        return out

    @staticmethod
    def names(host: str) -> list[str]:
        labels = host.split(".")
        return [".".join(labels[-k:]) for k in (1, 2, 3)]

    def values(self, host: str) -> list[float]:
        out = []
        for s in self.names(host):
            n, b = self.blocked.get(s, (0, 0))
            out += [(b + 20 * self.prior) / (n + 20), np.log1p(n)]
        return out


def with_lexical(parts: DataFrame) -> DataFrame:
    """`parts` (url, host, path) with the features (array of double) that a URL alone gives."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, "^[^?]*\\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1))
    inner = F.regexp_replace("path", "^/+|/+$", "")
    count = lambda c, what: F.length(c) - F.length(F.replace(c, F.lit(what)))
    # entropy of the characters: log2(n) less the mean of log2 of the counts, from the sorted characters' runs
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(url, "")), ""), F.lit("((?s).)\\1*"), 0)
    entropy = F.log2(n) - F.aggregate(runs, F.lit(0.0), lambda s, r: s + F.length(r) * F.log2(F.greatest(F.length(r), F.lit(1)))) / n
    found = [
        F.length(url), F.length("host"), F.length("path"), count(F.col("host"), "."), count(inner, "/") + (inner != "").cast("int"), F.length(F.regexp_replace(url, "[^0-9]", "")) / n, entropy,
        count(query, "&") + (query != "").cast("int"), F.length(query), F.contains(url, F.lit("#")), count(F.col("host"), "-"), F.endswith("path", F.lit("/")), F.contains("path", F.lit(".")), F.startswith(url, F.lit("https")),
    ]
    return parts.withColumn("lexical", F.array(*(x.cast("double") for x in found)))


def features(lexical: np.ndarray, hosts: list[str], suffixes: Suffixes) -> np.ndarray:
    """Rows of lexical features, with the statistics of the hosts' suffixes."""
    known = {h: suffixes.values(h) for h in set(hosts)}
    return np.column_stack([lexical, np.array([known[h] for h in hosts], float).reshape(len(hosts), 6)]) if len(hosts) else np.empty((0, 20))


@dataclass
class Boosted:
    """Trees of fixed depth as arrays [tree, inner node] and [tree, leaf]."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    prior: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-score))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, weight: float = 5.0) -> Boosted:
    """Logistic gradient boosting over histograms of at most `bins` quantile cuts a feature."""
    none = Boosted(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), 0.0)
    if not len(y) or y.min() == y.max():
        none.prior = -9.0 if not len(y) or y[0] == 0 else 9.0
        return none
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1], method="lower")) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    prior = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(len(y), prior)
    feature, cut, leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f_of, c_of = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            split = np.full(len(f_of), 10**9)
            for f in range(x.shape[1]):
                key = (node - base) * bins + binned[:, f]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + weight) + (gt - gs) ** 2 / (ht - hs + weight) - gt**2 / (ht + weight)
                gain[:, len(cuts[f]) :] = 0  # no cut to the right of the last
                at = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(width), at] > best + 1e-12):
                    best[k] = gain[k, at[k]]
                    f_of[base + k], c_of[base + k], split[base + k] = f, cuts[f][at[k]], at[k]
            node = 2 * node + 1 + (binned[np.arange(len(y)), f_of[node]] > split[node])
        end = node - len(f_of)
        value = rate * np.bincount(end, g, 2**depth) / (np.bincount(end, h, 2**depth) + weight)
        score += value[end]
        feature.append(f_of)
        cut.append(c_of)
        leaf.append(value)
    return Boosted(np.array(feature), np.array(cut), np.array(leaf), prior)


def fit(labelled: DataFrame, max_labelled: int = 20000) -> tuple[Suffixes, Boosted]:
    """From rows (url, block: 0 or 1)."""
    sample = of_lowest_hash(labelled.where("url is not null and block is not null").select("url", F.col("block").cast("int").alias("block")), max_labelled, "url", "block")
    rows = with_lexical(with_parts(sample)).select("host", "block", "lexical").collect()  # max_labelled rows
    y = np.array([r.block for r in rows], float)
    hosts = [r.host for r in rows]
    suffixes = Suffixes.of(hosts, y)
    return suffixes, boost(features(np.array([r.lexical for r in rows], float), hosts, suffixes), y)


def probability(parts: DataFrame, model: tuple[Suffixes, Boosted]) -> DataFrame:
    """`parts` (url, host, path) with block_probability."""
    shared = parts.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(lexical: pa.Array, host: pa.Array) -> pa.Array:
        suffixes, trees = shared.value
        flat = lexical.flatten().to_numpy(zero_copy_only=False).reshape(len(lexical), -1) if len(lexical) else np.empty(0)
        return pa.array(trees.probability(features(flat, host.to_pylist(), suffixes)), pa.float64())

    return with_lexical(parts).withColumn("block_probability", score("lexical", "host")).drop("lexical")


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: tuple[Suffixes, Boosted] | None) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability of each row of `pages` (page_id, url).

    Without a model, rows that no rule fits have a null verdict.
    """
    rows = with_rule(with_parts(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))), rules)
    rows = rows.withColumn("block_probability", F.lit(None).cast("double")) if model is None else probability(rows, model)
    by_trees = F.when(F.col("block_probability") >= 0.5, "block").when(F.col("block_probability").isNotNull(), "allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_trees).alias("verdict"), "block_probability")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None) -> DataFrame:
    """`judge` with trees that learn from `labelled` (url, block); where there is no such table, from the URLs that a rule decides."""
    if labelled is None:
        decided = with_rule(with_parts(pages.select(F.col("url").cast("string").alias("url"))), rules)
        labelled = decided.select("url", (F.col("rule_verdict") == "block").cast("int").alias("block"))
    return judge(pages, rules, fit(labelled))
