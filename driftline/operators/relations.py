"""Relations between activities: directly-follows, concurrency, footprints, closures, runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline import eventlog


def directly_follows_events(events: DataFrame) -> DataFrame:
    """log_id, case_idx, a, b of each pair of consecutive events."""
    ahead = F.lead("activity").over(Window.partitionBy("log_id", "case_idx").orderBy("evt_idx"))
    return events.select("log_id", "case_idx", F.col("activity").alias("a"), ahead.alias("b"), F.lead("evt_idx").over(Window.partitionBy("log_id", "case_idx").orderBy("evt_idx")).alias("_n")).where("_n is not null").drop("_n")


def directly_follows_case(events: DataFrame) -> DataFrame:
    """Multiset of each case: log_id, case_idx, a, b, n."""
    return directly_follows_events(events).groupBy("log_id", "case_idx", "a", "b").agg(F.count("*").alias("n"))


def directly_follows(events: DataFrame) -> DataFrame:
    """Multiset of each log: log_id, a, b, n."""
    return directly_follows_events(events).groupBy("log_id", "a", "b").agg(F.count("*").alias("n"))


def directly_follows_sets(events: DataFrame) -> DataFrame:
    """Distinct pairs of each case."""
    return directly_follows_events(events).distinct()


def concurrency(relation: DataFrame, by: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """Pairs of a relation that hold both ways, self-loops included."""
    pairs = relation.select(*by, "a", "b").distinct()
    back = pairs.select(*by, F.col("a").alias("b"), F.col("b").alias("a"))
    return pairs.join(back, [*by, "a", "b"], "left_semi")


def eventually_follows(events: DataFrame) -> DataFrame:
    """Distinct (a, b) with an a before a b, of each case, from first and last positions."""
    ends = events.groupBy("log_id", "case_idx", "activity").agg(F.min("evt_idx").alias("first"), F.max("evt_idx").alias("last"))
    x = ends.select("log_id", "case_idx", F.col("activity").alias("a"), "first")
    y = ends.select("log_id", "case_idx", F.col("activity").alias("b"), "last")
    return x.join(y, ["log_id", "case_idx"]).where("first < last").select("log_id", "case_idx", "a", "b")


def closure_of_cases(events: DataFrame) -> DataFrame:
    """All ordered event pairs of each case: log_id, case_idx, i, j, a, b."""
    x = events.select("log_id", "case_idx", F.col("evt_idx").alias("i"), F.col("activity").alias("a"))
    y = events.select("log_id", "case_idx", F.col("evt_idx").alias("j"), F.col("activity").alias("b"))
    return x.join(y, ["log_id", "case_idx"]).where("i < j")


def footprint(events: DataFrame, by: str = "log_id") -> DataFrame:
    """Causal footprint of each sub-log: by, a, b, rel (A always, S sometimes, N never follows)."""
    data = events if by == "log_id" else events.withColumn("log_id", F.col(by))
    pairs = eventually_follows(data).groupBy("log_id", "a", "b").agg(F.count("*").alias("n_ab"))
    cases = data.select("log_id", "case_idx", "activity").distinct().groupBy("log_id", "activity").agg(F.count("*").alias("n_a"))
    grid = cases.select("log_id", F.col("activity").alias("a"), "n_a").join(cases.select("log_id", F.col("activity").alias("b")), "log_id")
    rel = F.when(F.col("n_ab").isNull(), "N").when(F.col("n_ab") == F.col("n_a"), "A").otherwise("S")
    return grid.join(pairs, ["log_id", "a", "b"], "left").select(F.col("log_id").alias(by), "a", "b", rel.alias("rel"))


def relation_type_count(footprints: DataFrame, by: str = "log_id", compat: bool = True) -> DataFrame:
    """For each activity the numbers of its A, S and N relations; compat: N counts as S."""
    n = lambda r: F.sum((F.col("rel") == r).cast("long"))
    counts = footprints.groupBy(by, "a").agg(n("A").alias("n_a"), n("S").alias("n_s"), n("N").alias("n_n"))
    if compat:
        counts = counts.select(by, "a", "n_a", (F.col("n_s") + F.col("n_n")).alias("n_s"), F.lit(0).cast("long").alias("n_n"))
    return counts


def relation_entropy(footprints: DataFrame, by: str = "log_id", compat: bool = True) -> DataFrame:
    """Entropy of each activity's relation types."""
    counts = relation_type_count(footprints, by, compat)
    total = F.count("*").over(Window.partitionBy(by)).cast("double")
    term = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(-F.col(c) / total * F.log2(F.col(c) / total))
    return counts.withColumn("entropy", term("n_a") + term("n_s") + term("n_n")).select(by, "a", "entropy")


def transitive_closure(relation: DataFrame, by: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """Pairs joined by a path of any length, by squaring the relation until it stands."""
    now = relation.select(*by, "a", "b").distinct().cache()
    size = now.count()
    while True:
        left = now.select(*by, "a", F.col("b").alias("m"))
        right = now.select(*by, F.col("a").alias("m"), "b")
        grown = now.union(left.join(right, [*by, "m"]).select(*by, "a", "b")).distinct().cache()
        n = grown.count()
        now.unpersist()
        now = grown
        if n == size:
            return now
        size = n


def transitive_reduction(relation: DataFrame, by: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """Pairs of an acyclic relation that no longer path makes redundant."""
    edges = relation.select(*by, "a", "b").distinct()
    closure = transitive_closure(edges, by)
    longer = edges.select(*by, "a", F.col("b").alias("m")).join(closure.select(*by, F.col("a").alias("m"), "b"), [*by, "m"]).select(*by, "a", "b")
    return edges.join(longer, [*by, "a", "b"], "left_anti")


def irreflexive(relation: DataFrame) -> DataFrame:
    return relation.where("a <> b")


def relation_matrix(events: DataFrame, weak: bool = False) -> DataFrame:
    """The 1-cells of the relation matrix: log_id, case_idx, a, b, kind.

    D: directly follows in the case.  W rows equal the D rows; weak: they hold
    eventually-follows instead.
    """
    d = directly_follows_sets(events)
    w = eventually_follows(events) if weak else d
    return d.withColumn("kind", F.lit("D")).unionByName(w.withColumn("kind", F.lit("W")))


def _reduced(trace: list, concurrent: set) -> list[tuple]:
    """Label pairs of the transitive reduction of a trace's order without concurrent pairs."""
    n = len(trace)
    edge = [[j for j in range(i + 1, n) if (trace[i], trace[j]) not in concurrent] for i in range(n)]
    reach = [0] * n  # bit sets of what lies behind
    for i in range(n - 1, -1, -1):
        for j in edge[i]:
            reach[i] |= reach[j] | 1 << j
    out = set()
    for i in range(n):
        through = 0
        for j in edge[i]:
            through |= reach[j]
        out.update((trace[i], trace[j]) for j in edge[i] if not through >> j & 1)
    return sorted(out)


def runs(trace_table: DataFrame, concurrent: DataFrame, by: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """by, trace, run: the partial-order run of each distinct trace, given the concurrent pairs.

    run: sorted pairs as text, equal for equal runs.  The pairs of a log are as
    many as its activities' pairs at most.
    """
    pairs = concurrent.groupBy(*by).agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    todo = trace_table.select(*by, "trace").distinct().join(pairs, list(by), "left")

    @F.pandas_udf("string")
    def run(trace: pd.Series, pairs: pd.Series) -> pd.Series:
        held = [set() if p is None else {(x["a"], x["b"]) for x in p} for p in pairs]
        return pd.Series([";".join(f"{a}>{b}" for a, b in _reduced(list(t), c)) for t, c in zip(trace, held, strict=True)])

    return todo.select(*by, "trace", run("trace", "pairs").alias("run"))


def case_runs(trace_table: DataFrame, concurrent: DataFrame) -> DataFrame:
    """log_id, case_idx, run."""
    return trace_table.join(runs(trace_table, concurrent), ["log_id", "trace"]).select("log_id", "case_idx", "run")


def graph_metrics(relation: DataFrame, by: str = "log_id") -> DataFrame:
    """Nodes, edges, density, mean degrees and occurrences of a directly-follows graph (a, b, n)."""
    nodes = relation.select(by, F.explode(F.array("a", "b")).alias("x")).distinct().groupBy(by).agg(F.count("*").alias("n_nodes"))
    edges = relation.groupBy(by).agg(F.count("*").alias("n_edges"), F.sum("n").alias("occurrences"))
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return nodes.join(edges, by).withColumns({"density": F.when(pairs > 0, F.col("n_edges") / pairs), "mean_degree": F.col("n_edges") / F.col("n_nodes")})


def dependency_graph(relation: DataFrame, threshold: float = 0.99, by: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """by, a, b, n, dependency of a directly-follows graph (by, a, b, n): the edges of a heuristics net.

    The dependency of a on b is (n_ab - n_ba) / (n_ab + n_ba + 1), that of a
    loop n_aa / (n_aa + 1); edges under the threshold are left out.
    """
    back = relation.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    m = F.coalesce("m", F.lit(0))
    value = F.when(F.col("a") == F.col("b"), F.col("n") / (F.col("n") + 1)).otherwise((F.col("n") - m) / (F.col("n") + m + 1))
    return relation.join(back, [*by, "a", "b"], "left").withColumn("dependency", value).where(F.col("dependency") >= threshold).select(*by, "a", "b", "n", "dependency")


def degrees(relation: DataFrame, by: str = "log_id") -> DataFrame:
    """In- and out-degree of each activity."""
    ends = relation.select(by, F.col("a").alias("x"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(relation.select(by, F.col("b").alias("x"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy(by, F.col("x").alias("activity")).agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
