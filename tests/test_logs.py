"""Model, relations, splitting, sources and the grid on small logs."""

from __future__ import annotations

import gzip

from helpers import make_log
from pyspark.sql import functions as F

from driftline import eventlog
from driftline.operators import distances, evaluation, measures, relations, split
from driftline.plans import grid
from driftline.sources import results, xes


def rows(df) -> set[tuple]:
    return {tuple(r) for r in df.collect()}


def test_numbered_is_dense(spark):
    df = spark.createDataFrame([("l", x) for x in (5, 70000, 65536, 1, 200000, -3)], "log_id string, k long")
    got = {r.k: r.i for r in eventlog.numbered(df, ["log_id"], ["k"], "i").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}


def test_numbering_of_other_keys(spark):
    from decimal import Decimal
    from datetime import date

    for kind, keys in (("decimal(12,2)", [Decimal("1.5"), Decimal("-3"), Decimal("70000.25")]), ("double", [1e9, -2.5, 3.25]), ("date", [date(2024, 5, 1), date(1999, 1, 31), date(2024, 5, 9)]), ("string", ["ord0000012", "ord0000003", "a"])):
        df = spark.createDataFrame([("l", k) for k in keys], f"log_id string, k {kind}")
        got = {r.k: r.i for r in eventlog.numbered(df, ["log_id"], ["k"], "i").collect()}
        assert got == {k: i for i, k in enumerate(sorted(got))}


def test_cases_without_places(spark):
    t = spark.createDataFrame([(7, "a", 1), (7, "b", 2), (3, "a", 1), (None, "a", 1)], "k long, x string, o int")
    plain, dense = (eventlog.from_table(t, "k", "x", ["o"], dense=d) for d in (False, True))
    assert rows(plain.select("case_id", "case_idx", "evt_idx", "activity")) == {("7", 7, 0, "a"), ("7", 7, 1, "b"), ("3", 3, 0, "a")}
    assert rows(relations.directly_follows(plain)) == rows(relations.directly_follows(dense)) == {("log", "a", "b", 1)}


def test_empty_and_single_cases(spark):
    empty = make_log(spark, ["a"]).where("false")
    assert eventlog.log_lengths(empty).count() == 0
    assert relations.directly_follows(make_log(spark, ["a"])).count() == 0
    assert rows(relations.concurrency(relations.directly_follows(make_log(spark, ["aaa", "ab", "ba"])))) == {("log", "a", "a"), ("log", "a", "b"), ("log", "b", "a")}


def test_footprint_definition(spark):
    traces = ["abc", "acb", "ab", "ca"]
    got = {(r.a, r.b): r.rel for r in relations.footprint(make_log(spark, traces)).collect()}
    for a in "abc":
        for b in "abc":
            has = [t for t in traces if a in t]
            follows = [t for t in has if b in t[t.index(a) + 1 :]]
            assert got[a, b] == ("N" if not follows else "A" if len(follows) == len(has) else "S")


def test_runs_drop_concurrency(spark):
    log = make_log(spark, ["abcd", "acbd"])
    runs = relations.case_runs(eventlog.traces(log), relations.concurrency(relations.directly_follows(log)))
    assert {r.run for r in runs.collect()} == {"a>b;a>c;b>d;c>d"}


def test_measures_by_hand(spark):
    log = make_log(spark, ["abab", "bbbb"])
    got = {(r.case_idx, r.a, r.b): r.value for r in measures.window_count(log, l=2).collect()}
    assert got[0, "a", "b"] == 2 and got[0, "b", "a"] == 1 and got[1, "b", "b"] == 3 and got[1, "a", "b"] == 0


def test_splits(spark):
    log = make_log(spark, ["ab", "a", "b"])
    assert rows(split.sublog_sizes(split.by_case_groups(log, 2))) == {("log", 0, 2, 3), ("log", 1, 1, 1)}
    timed = log.withColumn("ts", F.expr("timestamp'2024-01-01 12:00:00' + make_interval(0, 0, 0, case_idx + evt_idx, 12)"))
    assert {(r.sublog, r.n_events) for r in split.sublog_sizes(split.by_trim(timed)).collect()} != set()
    assert split.by_intersection(timed).select("sublog").distinct().count() >= 2


def test_evaluation_edges(spark):
    data = spark.createDataFrame([("none", [], [10.0]), ("unknown", [5.0], []), ("hit", [10.0, 12.0], [10.0])], "name string, detected array<double>, actual array<double>")
    got = {r.name: r for r in evaluation.evaluated(data).collect()}
    assert got["none"].f1 != got["none"].f1 and got["none"].recall == 0
    assert (got["hit"].tp, got["hit"].fp) == (1, 1) and got["hit"].avg_lag == 0
    assert got["unknown"].recall != got["unknown"].recall


XES = """<?xml version="1.0"?><log><trace><string key="concept:name" value="c1"/>
<event><string key="concept:name" value="a"/><date key="time:timestamp" value="2024-01-01T10:00:00+00:00"/><int key="cost" value="3"/></event>
<event><string key="concept:name" value="b"/><date key="time:timestamp" value="2024-01-01T11:00:00+00:00"/></event></trace>
<trace><string key="concept:name" value="c2"/><event><string key="concept:name" value="a"/></event></trace></log>"""


def test_xes(spark, tmp_path):
    with gzip.open(tmp_path / "mini.xes.gz", "wt") as f:
        f.write(XES)
    got = xes.read(spark, str(tmp_path / "mini.xes.gz")).orderBy("case_idx", "evt_idx").collect()
    assert [(r.log_id, r.case_id, r.case_idx, r.evt_idx, r.activity) for r in got] == [("mini", "c1", 0, 0, "a"), ("mini", "c1", 0, 1, "b"), ("mini", "c2", 1, 0, "a")]
    assert got[0].attrs["cost"] == "3" and got[0].ts is not None and got[2].ts is None


def test_results_round_trip(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    (tmp_path / "r.csv").write_text('Algorithm,Log Source,Log,Detected Changepoints,Actual Changepoints for Log,Duration,Duration (Seconds),MRID\nLCDD,Bose,bose_log,"[1, nan, 2.5]",[499],01:00:01,3601,\n')
    raw = results.read_csv(spark, path)
    r = results.params_of(raw).first()
    assert r.detected == [1.0, None, 2.5] and r.actual == [499.0] and raw.first().duration_seconds == 3601
    results.write_csv(raw, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["Detected Changepoints"] == "[1.0,null,2.5]"
    assert results.read_many(spark, {"A": path, "B": path}).count() == 2


def test_grid_settings():
    assert grid.settings({"w,most": [(1, 2), (3, 4)], "alpha": [0.1]}) == [{"w": 1, "most": 2, "alpha": 0.1}, {"w": 3, "most": 4, "alpha": 0.1}]


def test_drift_logs_are_whole(spark):
    from driftline.plans import catalogue

    d = "/root/testdata/sf0.001"
    order, drift = (f(spark, d).select("case_idx", "evt_idx", "activity") for f in (catalogue.order_log, catalogue.drift_log))
    n = order.agg({"case_idx": "max"}).first()[0] + 1
    other = {"NO": "XO", "AF": "NO"}
    want = {(c, e): other.get(a, a) if c >= n / 2 else a for c, e, a in order.collect()}
    assert n > 1000 and {(c, e): a for c, e, a in drift.collect()} == want


def _config(path):
    path.write_text("""approaches:
  Zheng: {enabled: true, params: {mrid: [10], eps_modifiers: [[0.1, 0.5]]}}
  Martjushev ADWIN: {enabled: true, meta-params: {do_j: false, do_wc: true}, params: {min_max_window_pair: [[10, 40], [60, 80]], pvalue: [0.2], step_size: [10]}}
  ProcessGraph: {enabled: false, params: {min_max_window_pair: [[10, 40]], pvalue: [0.1]}}
  LCDD: {enabled: true, params: {window_pairs: [[10, 10]], stable_period: [5, 10]}}
""")
    return str(path)


def test_grid_runs_each_setting_on_each_log(spark, tmp_path):
    config = grid.load_config(_config(tmp_path / "grid.yml"))
    assert set(config) == {"rinv", "adwin_wc", "lcdd"} and config["adwin_wc"]["least,most"] == [[10, 40], [60, 80]]
    events = make_log(spark, ["abc"] * 50 + ["acb"] * 50, "one").unionByName(make_log(spark, ["abc"] * 30, "two")).cache()
    logs = spark.createDataFrame([("one", "s", [50.0]), ("two", "s", [])], "log_id string, log_source string, actual array<double>")
    got = grid.run_all(events, config, logs, 10, 3).collect()
    lines = {(r.algorithm, r.log, r["Epsilon"], r["Min Adaptive Window"], r["Stable Period"]): r for r in got}
    # of ADWIN's pairs on the log of 30 cases, only the smaller one fits
    assert len(got) == len(lines) == 4 + 3 + 4
    assert ("Martjushev ADWIN WC", "two", None, 60.0, None) not in lines
    assert lines["LCDD", "one", None, None, 5.0].detected == [50.0] and lines["LCDD", "one", None, None, 5.0].f1 == 1
    assert {lines["Zheng DBSCAN", "one", e, None, None].detected[0] for e in (1.0, 5.0)} == {50.0}
    assert lines["LCDD", "two", None, None, 10.0].detected == [] and all(r.seconds > 0 for r in got)
    assert grid.run_all(events, config, logs, test_run=True).count() == 4


def test_command_line(spark, tmp_path):
    from driftline.__main__ import main

    folder = tmp_path / "logs" / "Bose"
    folder.mkdir(parents=True)
    event = lambda a: f'<event><string key="concept:name" value="{a}"/><date key="time:timestamp" value="2024-01-01T00:00:00.000+00:00"/></event>'
    trace = lambda i, t: f'<trace><string key="concept:name" value="c{i}"/>{"".join(map(event, t))}</trace>'
    with gzip.open(folder / "bose_log.xes.gz", "wt") as f:
        f.write("<log>" + "".join(trace(i, "abc" if i < 50 else "acb") for i in range(100)) + "</log>")
    main(["--logs", str(tmp_path / "logs"), "--config", _config(tmp_path / "grid.yml"), "--out", str(tmp_path / "out"), "--runAndEvaluate", "--num-cores", "2"], spark)
    raw = results.read_csv(spark, str(tmp_path / "out" / "results"))
    assert {r["Algorithm"] for r in raw.collect()} == {"Zheng DBSCAN", "Martjushev ADWIN WC", "LCDD"}
    assert raw.where("`Stable Period` = 5").first()["Detected Changepoints"] == [50.0]
    measures_ = {r.algorithm: r for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "measures")).collect()}
    assert len(measures_) == 2 and all(float(r.ms_per_case) > 0 for r in measures_.values())  # one ADWIN variant is left out


def test_older_results_are_relabelled(spark, tmp_path):
    head = "Algorithm/Options,Log,Detected Changepoints,Actual Changepoints for Log,Duration"
    line = lambda option: f'{option},log,"[1, 2]","[1]",00:00:05'
    options = {
        "Bose": ["Bose Average J", "Bose Average WC", "other"], "Martjushev": ["Martjushev Recursive Bisection; Average J; p=0.55", "?"],
        "Maaradji": ["x"], "Earthmover": ["Earth Mover"], "ProcessGraph": ["y"], "Zheng": ["z"],
    }
    for folder, found in options.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / results.LEGACY_FILE).write_text("\n".join([head, *map(line, found)]) + "\n")
    got = results.read_legacy(spark, str(tmp_path)).collect()
    assert sorted(r["Algorithm"] for r in got) == ["Bose J", "Bose WC", "Earth Mover", "Martjushev J", "ProDrift", "Process Graphs", "Zheng"]
    assert all(r["Detected Changepoints"] == [1.0, 2.0] and r["duration_seconds"] == 5 for r in got)


def test_dependency_graph(spark):
    rows = [("l", "a", "b", 200), ("l", "b", "a", 1), ("l", "a", "a", 120), ("l", "b", "c", 50), ("l", "c", "d", 99)]
    graph = relations.dependency_graph(spark.createDataFrame(rows, "log_id string, a string, b string, n long"), 0.98)
    assert {(r.a, r.b): round(r.dependency, 6) for r in graph.collect()} == {("a", "b"): round(199 / 202, 6), ("a", "a"): round(120 / 121, 6), ("b", "c"): round(50 / 51, 6), ("c", "d"): 0.99}


def test_weighted_distances(spark):
    table = spark.createDataFrame([("l", 0, ["a", "b"], [1, 2]), ("l", 1, ["a", "c", "b"], [1, 0, 4]), ("l", 2, [], [])], "log_id string, variant_id int, trace array<string>, bins array<int>")
    got = {(r.v1, r.v2): (r.weighted, r.distance) for r in distances.weighted_distances(table, insdel=lambda a: 5.0 if a == "c" else 1.0).collect()}
    assert got[0, 0] == (0.0, 0.0) and got[2, 2] == (0.0, 0.0)
    assert got[0, 1] == (4.0, 4 / 3)  # rename b to c and insert b: 1 + |2 - 0| + 1, under the 5 of c
    assert got[0, 2] == (2.0, 1.0)


def test_plot_inputs(spark):
    from driftline.plans import catalogue, scoreboard

    data = scoreboard.counted(scoreboard.preprocessed(catalogue.fixture(spark))).cache()
    tables = scoreboard.plot_inputs(data)
    assert set(tables) == {"accuracy", "latency", "versatility", "scalability", "sensitivity", "robustness", "f1_duration", "radar", "pareto", "roc"}
    names = {r.algorithm for r in data.select("algorithm").distinct().collect()}
    for key, table in tables.items():
        found = table.collect()
        assert found, key
        assert key == "roc" or {r.algorithm for r in found} <= names
    points_ = tables["pareto"].collect()
    for r in points_:
        assert r.on_front == (not any(o.f1 > r.f1 and o.seconds < r.seconds for o in points_))
    p = spark.createDataFrame([("l", 5, 0.5)], "log_id string, pos long, pval double")
    line = spark.createDataFrame([("l", 7.0)], "log_id string, change_point double")
    assert rows(scoreboard.p_value_plot(p, line, line)) == {("l", "p", 5.0, 0.5), ("l", "detected", 7.0, None), ("l", "actual", 7.0, None)}
