"""Detectors against literal state machines, and on logs with a known drift."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
from helpers import make_log
from pyspark.sql import functions as F

from driftline import eventlog
from driftline.functions import stats
from driftline.operators import detectors, relations, windows
from driftline.plans import catalogue
from driftline.streaming import lcdd as online


def points(df) -> list[float]:
    return sorted(r.change_point for r in df.collect())


def near(found: list[float], true: float, lag: float = 100) -> bool:
    return bool(found) and all(abs(x - true) <= lag for x in found)


@pytest.fixture(scope="module")
def choice(spark):
    return catalogue.choice_log(spark).cache()


def test_prodrift_finds_the_choice(spark, choice):
    whole = points(detectors.prodrift(choice, 100, 2))
    assert near(whole, 500)
    assert points(detectors.prodrift(choice, 100, 2, alpha_from="prefix")) == whole


def test_prodrift_series_are_direct(spark, choice):
    """Running sums, prefix concurrency and window concurrency against a direct computation."""
    small = choice.where("case_idx >= 440 and case_idx < 560").selectExpr("log_id", "case_id", "case_idx - 440 as case_idx", "evt_idx", "activity")
    traces = {r.case_idx: r.trace for r in eventlog.traces(small).collect()}
    w = 20
    for mode in ("log", "prefix", "window"):
        got = {r.pos: r.pval for r in detectors.prodrift_p(small, w, 1, mode).collect()}
        assert sorted(got) == list(range(w, 120 - w))
        for pos in (20, 55, 99):
            i = pos - w
            upto = {"log": range(120), "prefix": range(max(2 * w, i + 2 * w)), "window": range(i, i + 2 * w)}[mode]
            pairs = {(a, b) for k in upto for a, b in zip(traces[k], traces[k][1:])}
            both = {p for p in pairs if p[::-1] in pairs}
            runs = [tuple(relations._reduced(traces[k], both)) for k in range(i, i + 2 * w)]
            names = sorted(set(runs))
            one, two = ([sum(r == n for r in part) for n in names] for part in (runs[:w], runs[w:]))
            assert got[pos] == pytest.approx(stats.chi2_contingency(one, two))


def test_window_statistics_are_direct(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, 130).astype(float)
    s = spark.createDataFrame([("l", "s", i, float(v)) for i, v in enumerate(x)], "log_id string, series string, case_idx long, value double")
    w = 25
    for test, f in (("ks", stats.ks_2samp), ("mw", stats.mannwhitneyu)):
        for step in (1, 4):
            got = {r.pos: r.pval for r in windows.p_values(s, w, step, test).collect()}
            assert got == pytest.approx({i + w: f(x[i : i + w], x[i + w : i + 2 * w]) for i in range(0, 130 - 2 * w, step)})
    chunked = {(r.pos, r.value): (r.c1, r.c2) for r in windows.two_windows(s, w, 1, chunk=17).collect()}
    whole = {(r.pos, r.value): (r.c1, r.c2) for r in windows.two_windows(s, w).collect()}
    assert chunked == whole


@pytest.mark.parametrize(("measure", "test", "w", "step"), [("WC", "ks", 10, 1), ("J", "ks", 10, 3), ("J", "mw", 10, 1), ("WC", "mw", 6, 7)])
def test_mean_p_is_direct_over_chunks(spark, measure, test, w, step):
    """Chunks of 25 cases against the tests on the signals of the whole log; an event without an activity is in no pair."""
    rng = np.random.default_rng(4)
    log = make_log(spark, ["".join(rng.choice(list("abc" if i < 50 else "bcd"), rng.integers(1, 8))) for i in range(93)])
    log = log.withColumn("activity", F.when((F.col("case_idx") % 9 > 0) | (F.col("evt_idx") != 1), F.col("activity"))).cache()
    got = detectors._mean_p(log, w, measure, test, step, 25).collect()
    signals = detectors.signals(log, measure).where("series rlike '[a-d]>[a-d]'").toPandas()
    x = signals.pivot(index="case_idx", columns="series", values="value").sort_index().to_numpy()
    assert x.shape == (93, 16)
    want = {i + w: np.mean([stats.TESTS[test](x[i : i + w, k], x[i + w : i + 2 * w, k]) for k in range(16)]) for i in range(0, 93 - 2 * w, step)}
    assert {r["first"] + k * step: p for r in got for k, p in enumerate(r.p)} == pytest.approx(want)


def test_mean_p_goes_by_places_with_gaps(spark):
    """Events two places apart are in no window of two, whether others stand between them or not."""
    rng = np.random.default_rng(11)
    log = make_log(spark, ["".join(rng.choice(list("abc"), rng.integers(1, 5))) for i in range(61)]).withColumn("evt_idx", F.col("evt_idx") * 2 + F.col("case_idx") % 2).cache()
    got = {r["first"] + k: p for r in detectors._mean_p(log, 8, "WC", "ks", 1, 20).collect() for k, p in enumerate(r.p)}
    x = detectors.signals(log, "WC").toPandas().pivot(index="case_idx", columns="series", values="value").sort_index().to_numpy()
    assert got == pytest.approx({i + 8: np.mean([stats.ks_2samp(x[i : i + 8, k], x[i + 8 : i + 16, k]) for k in range(9)]) for i in range(61 - 16)})


def test_bose_makes_its_events_once(spark):
    """The events are joined with their cases, and shuffled to the slices, once in the plan that ran."""
    rows = [(i, j, "abc"[(i * j + i // 40) % 3]) for i in range(90) for j in range(4)]
    table = spark.createDataFrame(rows, "k long, j long, a string")
    log = catalogue._drifting(eventlog.from_table(table, "k", "a", ["j"], "made"), "made", table.select("k"), "a", "b", "c")
    assert log.where("case_idx < 45 and evt_idx = 0 and activity = 'c'").count() == sum((i // 40) % 3 == 2 for i in range(45))
    found = detectors.bose(log, 10, "WC", "ks", 5)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Join \[_case#", plan)) == 1


def test_many_values_are_counted_in_pieces():
    x, starts, w = np.random.default_rng(5).random(300), np.arange(0, 280, 3), 10
    for test, f in windows.IN_MEMORY.items():
        assert f(x, starts, w) == pytest.approx([stats.TESTS[test](x[i : i + w], x[i + w : i + 2 * w]) for i in starts])


@pytest.mark.parametrize(("n", "evaluated"), [(10, 0), (11, 1)])
def test_last_window_is_not_evaluated(spark, n, evaluated):
    s = spark.createDataFrame([("l", "s", i, 1.0) for i in range(n)], "log_id string, series string, case_idx long, value double")
    assert windows.p_values(s, 5).count() == evaluated


def _lcdd_literal(cases: list[set], c: int, d: int) -> list[int]:
    """State machine: a reference window closes, then relations are compared case by case."""
    out, s = [], 0
    while True:
        if s + c >= len(cases):
            return out
        ref = set().union(*cases[s : s + c])
        t, cut = s + c, None
        while t < len(cases):
            if cases[t] - ref:
                cut = t
                break
            t += 1
            if t == s + c + d and t < len(cases) and len(ref - set().union(*cases[s + c : t])) > 1:
                cut = s + c
                break
        if cut is None:
            return out
        out.append(cut)
        s = cut


def test_lcdd_batch_and_online_are_the_state_machine():
    rng = np.random.default_rng(4)
    for _ in range(300):
        cases = [set(rng.integers(0, 6, rng.integers(0, 4)).tolist()) for _ in range(rng.integers(0, 60))]
        c, d = int(rng.integers(1, 8)), int(rng.integers(1, 8))
        want = _lcdd_literal(cases, c, d)
        assert detectors.lcdd_points(cases, c, d) == want
        machine = online.Online(c, d)
        assert [x for r in cases for x in machine.feed(frozenset(r))] == want


def test_lcdd_stable_period_places_the_cut():
    """Relations 1 and 2 end at case 12, 3 and 4 at case 20 of a detection window that begins at 10."""
    cases = [{0, 1, 2, 3, 4}] * 12 + [{0, 3, 4}] * 8 + [{0}] * 30
    assert detectors.lcdd_points(cases, 5, 5, "compat") == []
    assert detectors.lcdd_points(cases, 10, 12, "paper", 20)[0] == 20
    assert detectors.lcdd_points(cases, 10, 12, "paper", 4)[0] == 12
    assert detectors.lcdd_points(cases, 10, 5, "paper", 4)[0] == 12


def test_adaptive_windows():
    same = lambda a, b, c: 1.0
    tried = []
    assert detectors.adwin_points(lambda *x: tried.append(x) or 1.0, 30, 3, 7, 0.1, 2) == []
    assert tried == [(0, 3, 6), (0, 5, 10), (0, 7, 14), (7, 10, 14), (7, 12, 18), (7, 14, 22), (14, 18, 22), (14, 20, 26), (14, 22, 30)]
    assert detectors.adwin_points(same, 6, 3, 7, 0.1, 2) == []


def _rinv_literal(row: list[int], mrid: int) -> set[int]:
    out, begin = set(), 1
    for j in range(2, len(row) + 1):
        if j == len(row) or row[j] != row[begin]:
            if j - begin >= mrid:
                out |= {begin} | ({j} if j < len(row) else set())
            begin = j
    return out - {1}


def test_rinv_candidates_are_run_lengths(spark):
    rng = np.random.default_rng(5)
    traces = ["ab" if rng.random() < (0.95 if i // 12 % 2 else 0.05) else "ba" for i in range(60)]
    got = {r.candidate for r in detectors.rinv_candidates(make_log(spark, traces), 4).collect()}
    want = set()
    for pair in ("ab", "ba"):
        want |= _rinv_literal([int(t == pair) for t in traces], 4)
    assert got == want


def test_relational_detectors_find_a_swap(spark):
    log = make_log(spark, ["abcde"] * 150 + ["acbde"] * 150)
    assert near(points(detectors.rinv(log, 60, 20)), 150, 5)
    assert points(detectors.lcdd(log, 50, 50)) == [150]
    longer = make_log(spark, ["abcde"] * 200 + ["acbde"] * 200)
    assert near(points(detectors.emd(longer, 90, 4)), 200, 20)


def test_adaptive_detectors_find_a_swap(spark):
    rng = np.random.default_rng(6)
    traces = ["".join(rng.choice(list("ab"), 6, p=[p, 1 - p])) for p in [0.9] * 150 + [0.2] * 150]
    log = make_log(spark, traces)
    assert near(points(detectors.martjushev(log, 40, 0.2, "WC")), 150, 60)
    assert detectors.adwin(log, 40, 120, 0.2, 10, "WC").count() > 0
    assert points(detectors.pgm(log, 60, 200, 0.01))
    assert near(points(detectors.bose(log, 60, "WC", "ks", 1)), 150, 40)
    both = log.unionByName(make_log(spark, ["ab"] * 5, "short"))
    assert {r.log_id for r in detectors.adwin(both, 40, 120, 0.2, 10, "WC").collect()} == {"log"}
    assert points(detectors.adwin(log, 150, 200, 0.4, 10, "WC")) == []


def test_bose_in_steps_is_valleys_of_its_series(spark):
    rng = np.random.default_rng(7)
    log = make_log(spark, ["".join(rng.choice(list("abc"), 5, p=p)) for p in ([0.8, 0.1, 0.1], [0.1, 0.8, 0.1]) for _ in range(200)]).cache()
    for step in (5, 10):
        p = [r.pval for r in detectors.bose_p(log, 100, "WC", "ks", step).orderBy("pos").collect()]
        assert len(p) == len(range(0, 400 - 200, step))
        assert points(detectors.bose(log, 100, "WC", "ks", step)) == [k * step + 100 for k in stats.peaks(-np.array(p), 80 / step, 0.1)]
    assert near(points(detectors.bose(log, 100, "WC", "ks", 5)), 200, 40)
    assert detectors.bose(log, 100, "WC", "ks", 5)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # with the facts of each log, no other


def test_packed_log_is_the_traces_and_pgm_its_points(spark):
    rng = np.random.default_rng(8)
    traces = ["".join(rng.choice(list("abcd"[: 3 + i // 150]), rng.integers(1, 7), p=None if i < 150 else [0.7, 0.1, 0.1, 0.1])) for i in range(300)]
    rows = eventlog.packed(make_log(spark, traces), 40)
    assert rows.count() == 8  # not a row for each case and item
    log = eventlog.Packed(rows.toArrow(), 40, 2)
    for low, high in ((0, 300), (35, 45), (40, 80), (79, 80), (300, 300), (0, 1)):
        begins, codes = log.part(low, high)
        assert ["".join(log.names[k] for k in codes[i:j]) for i, j in zip(begins[:-1], begins[1:], strict=True)] == traces[low:high]
    nodes = np.array([[t.count(x) for x in "abcd"] for t in traces])
    edges = np.array([[sum(t[i : i + 2] == x + y for i in range(len(t) - 1)) for x in "abcd" for y in "abcd"] for t in traces])
    sums = [detectors.Table(np.concatenate([np.zeros((1, x.shape[1])), x.cumsum(0)])) for x in (edges, nodes)]
    want = detectors.pgm_points(*sums, 40, 120, 0.05)
    assert want and detectors.pgm_points(detectors.Counted(log, "e"), detectors.Counted(log, "v"), 40, 120, 0.05) == want
    x, y = rng.integers(0, 9, (2, 50, 4))
    both = [(a[(a > 0) & (b > 0)], b[(a > 0) & (b > 0)]) for a, b in zip(x, y, strict=True)]
    assert detectors._chi2_shared(x, y) == pytest.approx([stats.chi2_contingency(a, b) if len(a) else 0.0 for a, b in both])


def test_lcdd_of_a_packed_log_looks_at_each_case_a_few_times(spark):
    class Watched(list):
        looks = 0

        def __getitem__(self, i):
            found = super().__getitem__(i)
            Watched.looks += len(found) if isinstance(i, slice) else 1
            return found

    # two relations are gone in each detection window, and none is new
    cases = Watched([{1, 2, 3, 4, 5}] * 20 + [{1, 2, 3}] * 20 + [{1}] * 4000)
    assert detectors.lcdd_points(cases, 20, 20) == [20, 40]
    assert Watched.looks < 3 * len(cases)
    rng = np.random.default_rng(9)
    traces = ["".join(rng.choice(list("abcd"), rng.integers(1, 6))) for _ in range(200)]
    log = make_log(spark, traces).withColumn("activity", F.when(F.col("activity") != "d", F.col("activity")))
    sets = [{t[i : i + 2] for i in range(len(t) - 1) if "d" not in t[i : i + 2]} for t in traces]
    packed = detectors.Relations(eventlog.Packed(eventlog.packed(log, 30).toArrow(), 30, 2), 2, 5)
    assert [len(x) for x in packed[0:200]] == [len(x) for x in sets]
    for mode in ("compat", "paper"):
        assert detectors.lcdd_points(packed, 10, 5, mode, 4) == detectors.lcdd_points(sets, 10, 5, mode, 4)
    assert points(detectors.lcdd(log, 10, 5)) == detectors.lcdd_points(sets, 10, 5)


def test_locate_change():
    x = np.array([0.0] * 30 + [1.0] * 50)
    p = lambda a, b, c: stats.ks_2samp(x[a:b], x[b:c])
    assert abs(stats.locate_change(p, 0, 40, 80, 0.05) - 30) <= 10


def test_bisected_change():
    x = np.array([0.0] * 30 + [1.0] * 50)
    p = lambda a, b, c: stats.ks_2samp(x[a:b], x[b:c])
    assert abs(stats.bisected_change(p, 0, 40, 80, 0.05) - 30) <= 10
    assert stats.bisected_change(lambda *_: 1.0, 0, 40, 80, 0.05) == 40
    assert stats.bisected_change(lambda *_: 0.0, 0, 3, 6, 0.05) >= 0


def test_hotelling_series(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 2)) + (np.arange(60)[:, None] >= 30) * 3
    rows = [("l", f"s{k}", i, float(x[i, k])) for i in range(60) for k in range(2)]
    got = windows.sliding_hotelling(spark.createDataFrame(rows, "log_id string, series string, case_idx long, value double"), 15).toPandas()
    assert abs(got.loc[got.pval.idxmin(), "pos"] - 30) <= 3


def test_streaks(spark):
    p = spark.createDataFrame([("l", i, v) for i, v in enumerate([0.9, 0.01, 0.01, 0.9, 0.01, 0.01, 0.01, 0.01])], "log_id string, pos long, pval double")
    assert [r.pos for r in windows.streaks(p, 0.05, 3).collect()] == [6]


def test_streaming_lcdd(spark, tmp_path):
    cases = [(i, ["ab"] if i < 20 else ["ba"]) for i in range(40)]
    for part in range(4):
        pd.DataFrame([{"log_id": "l", "case_idx": i, "relations": r} for i, r in cases[part * 10 : part * 10 + 10]]).to_parquet(tmp_path / f"{part}.parquet")
    stream = spark.readStream.schema("log_id string, case_idx long, relations array<string>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = online.detect(stream, 5, 5).writeStream.format("memory").queryName("cuts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.change_point for r in spark.sql("select * from cuts").collect()] == [20.0]
