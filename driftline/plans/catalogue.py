"""Registered queries on the driver's tables, and the SQL that each equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import eventlog
from driftline.functions import scalars
from driftline.operators import detectors, distances, evaluation, measures, relations, split, windows
from driftline.plans import grid, scoreboard
from driftline.sources import catalogue as log_catalogue

# --- logs -------------------------------------------------------------------


def order_log(spark: SparkSession, sf_dir: str, dense: bool = True) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return eventlog.from_table(t, "l_orderkey", F.concat("l_returnflag", "l_linestatus"), ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus"], "order", dense=dense)


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return eventlog.from_table(t, "user_id", "event_type", ["ts", "event_id"], "user", ts="ts")


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return eventlog.from_table(t, "conv_id", "role", ["turn"], "chat")


def _drifting(e: DataFrame, log_id: str, cases: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """A whole log in which, from half of its cases on, y is called z and x is called y.  cases: the case key of each event in its table."""
    n = cases.distinct().agg(F.count(cases.columns[0]).alias("n")).select(F.lit(log_id).alias("log_id"), "n")
    late = F.col("case_idx") >= F.col("n") / 2
    renamed = F.when(F.col("activity") == x, y).when(F.col("activity") == y, z).otherwise(F.col("activity"))
    return e.join(F.broadcast(n), "log_id").withColumn("activity", F.when(late, renamed).otherwise(F.col("activity"))).select(*e.columns)


def drift_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole order log with a drift in the middle."""
    return _drifting(order_log(spark, sf_dir), "order", spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey"), "AF", "NO", "XO")


def user_drift_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole user log with a drift in the middle."""
    return _drifting(user_log(spark, sf_dir), "user", spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id"), "click", "view", "scroll")


def chat_drift_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chat log with a drift in the middle."""
    return _drifting(chat_log(spark, sf_dir), "chat", spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id"), "user", "assistant", "tool")


def choice_log(spark: SparkSession) -> DataFrame:
    """1000 made cases: an early choice between c and d turns from 3 in 5 to 1 in 5 at case 500."""
    cases = spark.range(1000).withColumn("c", F.col("id") % 5 < F.when(F.col("id") < 500, 3).otherwise(1))
    trace = F.when(F.col("c"), F.array(*map(F.lit, "abce"))).otherwise(F.array(*map(F.lit, "abde")))
    return cases.select(F.lit("choice").alias("log_id"), F.col("id").cast("string").alias("case_id"), F.col("id").alias("case_idx"), F.posexplode(trace).alias("evt_idx", "activity"))


def coin_log(spark: SparkSession) -> DataFrame:
    """600 made cases of six events, each a or b by a hash: nine in ten are a at first, one in five from case 300 on."""
    events = spark.range(600).select(F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("evt_idx"))
    share = F.when(F.col("id") < 300, 90).otherwise(20)
    kind = F.when(F.pmod(F.xxhash64("id", "evt_idx"), F.lit(100)) < share, "a").otherwise("b")
    return events.select(F.lit("coin").alias("log_id"), F.col("id").cast("string").alias("case_id"), F.col("id").alias("case_idx"), F.col("evt_idx").cast("long").alias("evt_idx"), kind.alias("activity"))


_LOGS = {
    "order": """order_ AS (SELECT 'order' AS log_id, l_orderkey AS k, l_returnflag || l_linestatus AS activity,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, l_linestatus) - 1 AS evt_idx,
  dense_rank() OVER (ORDER BY l_orderkey) - 1 AS case_idx FROM lineitem)""",
    "user": """user_ AS (SELECT 'user' AS log_id, user_id AS k, event_type AS activity, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS evt_idx,
  dense_rank() OVER (ORDER BY user_id) - 1 AS case_idx FROM events)""",
    "chat": """chat_ AS (SELECT 'chat' AS log_id, conv_id AS k, role AS activity,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS evt_idx,
  dense_rank() OVER (ORDER BY conv_id) - 1 AS case_idx FROM conversations)""",
}
_DRIFTS = {"drift": ("order", "AF", "NO", "XO"), "user_drift": ("user", "click", "view", "scroll"), "chat_drift": ("chat", "user", "assistant", "tool")}
for _name, (_log, _x, _y, _z) in _DRIFTS.items():
    _LOGS[_name] = _LOGS[_log] + f""", {_name}_ AS (SELECT * REPLACE (CASE WHEN case_idx < n / 2 THEN activity WHEN activity = '{_x}' THEN '{_y}' WHEN activity = '{_y}' THEN '{_z}' ELSE activity END AS activity)
  FROM {_log}_, (SELECT count(DISTINCT case_idx) AS n FROM {_log}_))"""
_DF = """df AS (SELECT * FROM (SELECT log_id, case_idx, activity AS a, lead(activity) OVER (PARTITION BY case_idx ORDER BY evt_idx) AS b FROM {t}) WHERE b IS NOT NULL)"""


def _sql(log: str, rest: str, *more: str) -> str:
    head = [_LOGS[log], *(m.replace("{t}", f"{log}_") for m in more)]
    return "WITH RECURSIVE " + ", ".join(head) + rest.replace("{t}", f"{log}_")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- model ------------------------------------------------------------------


@query("activities", _sql("order", " SELECT DISTINCT log_id, activity FROM {t}"))
def _(spark, d):
    return eventlog.activities(order_log(spark, d, dense=False))


@query("num_activities", _sql("order", " SELECT log_id, count(DISTINCT activity) AS n_activities FROM {t} GROUP BY 1"))
def _(spark, d):
    return eventlog.num_activities(order_log(spark, d, dense=False))


@query("activities_of_all", "SELECT DISTINCT activity FROM (SELECT role AS activity FROM conversations UNION ALL SELECT event_type FROM events)")
def _(spark, d):
    return eventlog.activities_of_all(chat_log(spark, d).select("log_id", "activity").union(user_log(spark, d).select("log_id", "activity")))


@query("log_lengths", "SELECT 'order' AS log_id, count(DISTINCT l_orderkey) AS n_cases, count(*) AS n_events FROM lineitem UNION ALL SELECT 'user', count(DISTINCT user_id), count(*) FROM events UNION ALL SELECT 'chat', count(DISTINCT conv_id), count(*) FROM conversations")
def _(spark, d):
    cut = lambda e: e.select("log_id", "case_idx")
    return eventlog.log_lengths(cut(order_log(spark, d, dense=False)).union(cut(user_log(spark, d))).union(cut(chat_log(spark, d))))


_TRACES = "traces AS (SELECT log_id, case_idx, string_agg(activity, ',' ORDER BY evt_idx) AS trace FROM {t} GROUP BY 1, 2)"


@query("trace_variants", _sql("order", " SELECT log_id, row_number() OVER (ORDER BY min(case_idx)) - 1 AS variant_id, trace, count(*) AS freq FROM traces GROUP BY log_id, trace", _TRACES))
def _(spark, d):
    return eventlog.variants(eventlog.traces(order_log(spark, d))).withColumn("trace", F.array_join("trace", ","))


@query("traces", _sql("chat", " SELECT log_id, case_idx, any_value(k)::VARCHAR AS case_id, string_agg(activity, ',' ORDER BY evt_idx) AS trace, count(*) AS n_events FROM {t} GROUP BY 1, 2"))
def _(spark, d):
    return eventlog.traces(chat_log(spark, d)).withColumn("trace", F.array_join("trace", ","))


# --- relations --------------------------------------------------------------


@query("directly_follows", _sql("order", " SELECT log_id, a, b, count(*) AS n FROM df GROUP BY 1, 2, 3", _DF))
def _(spark, d):
    return relations.directly_follows(order_log(spark, d, dense=False))


@query("directly_follows_per_case", _sql("order", " SELECT log_id, case_idx, a, b, count(*) AS n FROM df GROUP BY 1, 2, 3, 4", _DF))
def _(spark, d):
    return relations.directly_follows_case(order_log(spark, d))


@query("directly_follows_sets", _sql("chat", " SELECT DISTINCT log_id, case_idx, a, b FROM df", _DF))
def _(spark, d):
    return relations.directly_follows_sets(chat_log(spark, d))


@query("alpha_concurrency", _sql("order", " SELECT DISTINCT x.log_id, x.a, x.b FROM df x JOIN df y ON x.a = y.b AND x.b = y.a", "df AS (SELECT DISTINCT log_id, a, b FROM (SELECT log_id, activity AS a, lead(activity) OVER (PARTITION BY case_idx ORDER BY evt_idx) AS b FROM {t}) WHERE b IS NOT NULL)"))
def _(spark, d):
    return relations.concurrency(relations.directly_follows(order_log(spark, d, dense=False)))


_PAIRS = """eva AS (SELECT DISTINCT x.g, x.case_idx, x.activity AS a, y.activity AS b FROM ev x JOIN ev y ON x.g = y.g AND x.case_idx = y.case_idx AND x.evt_idx < y.evt_idx),
acts AS (SELECT g, activity, count(DISTINCT case_idx) AS n FROM ev GROUP BY 1, 2),
fp AS (SELECT p.g, p.activity AS a, q.activity AS b, CASE WHEN count(e.case_idx) = 0 THEN 'N' WHEN count(e.case_idx) = any_value(p.n) THEN 'A' ELSE 'S' END AS rel
  FROM acts p JOIN acts q ON p.g = q.g LEFT JOIN eva e ON e.g = p.g AND e.a = p.activity AND e.b = q.activity GROUP BY 1, 2, 3)"""
_WHOLE = "ev AS (SELECT log_id AS g, * FROM {t})"
_GROUPS = "ev AS (SELECT case_idx // 2500 AS g, * FROM {t})"


@query("eventually_follows", _sql("chat", " SELECT g AS log_id, case_idx, a, b FROM eva", _WHOLE, _PAIRS))
def _(spark, d):
    return relations.eventually_follows(chat_log(spark, d))


@query("causal_footprint", _sql("chat", " SELECT g AS log_id, a, b, rel FROM fp", _WHOLE, _PAIRS))
def _(spark, d):
    return relations.footprint(chat_log(spark, d))


def _grouped_footprint(spark, d):
    return relations.footprint(split.by_case_groups(order_log(spark, d), 2500), "sublog")


@query("causal_footprint_groups", _sql("order", " SELECT CAST(g AS BIGINT) AS sublog, a, b, rel FROM fp", _GROUPS, _PAIRS))
def _(spark, d):
    return _grouped_footprint(spark, d)


_RTC = "SELECT CAST(g AS BIGINT) AS sublog, a, count(*) FILTER (rel = 'A') AS n_a, count(*) FILTER (rel <> 'A') AS n_s, CAST(0 AS BIGINT) AS n_n, count(*) AS n FROM fp GROUP BY 1, 2"


@query("relation_type_count", _sql("order", " SELECT sublog, a, n_a, n_s, n_n FROM (" + _RTC + ")", _GROUPS, _PAIRS))
def _(spark, d):
    return relations.relation_type_count(_grouped_footprint(spark, d), "sublog")


@query(
    "relation_entropy",
    _sql("order", " SELECT sublog, a, round(CASE WHEN n_a = 0 THEN 0 ELSE -n_a / t * log2(n_a / t) END + CASE WHEN n_s = 0 THEN 0 ELSE -n_s / t * log2(n_s / t) END, 9) AS entropy FROM (SELECT *, CAST(count(*) OVER (PARTITION BY sublog) AS DOUBLE) AS t FROM (" + _RTC + "))", _GROUPS, _PAIRS),
)
def _(spark, d):
    return relations.relation_entropy(_grouped_footprint(spark, d), "sublog").withColumn("entropy", F.round("entropy", 9))


@query("closure_of_cases", _sql("chat", " SELECT x.log_id, x.case_idx, x.evt_idx AS i, y.evt_idx AS j, x.activity AS a, y.activity AS b FROM {t} x JOIN {t} y ON x.case_idx = y.case_idx AND x.evt_idx < y.evt_idx"))
def _(spark, d):
    return relations.closure_of_cases(chat_log(spark, d))


def _chain(spark):
    rows = [("l", a, b) for a, b in _CHAIN]
    return spark.createDataFrame(rows, "log_id string, a string, b string")


_CHAIN = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("a", "e"), ("e", "d"), ("b", "d"), ("d", "f"), ("a", "f")]
_CHAIN_SQL = "e(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _CHAIN) + "), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)"


@query("transitive_closure", f"WITH RECURSIVE {_CHAIN_SQL} SELECT 'l' AS log_id, a, b FROM c")
def _(spark, d):
    return relations.transitive_closure(_chain(spark))


@query("transitive_reduction", f"WITH RECURSIVE {_CHAIN_SQL} SELECT 'l' AS log_id, a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM e x JOIN c ON x.b = c.a WHERE x.a = e.a AND c.b = e.b)")
def _(spark, d):
    return relations.transitive_reduction(_chain(spark))


@query("irreflexive_follows", _sql("order", " SELECT log_id, a, b, count(*) AS n FROM df WHERE a <> b GROUP BY 1, 2, 3", _DF))
def _(spark, d):
    return relations.irreflexive(relations.directly_follows(order_log(spark, d, dense=False)))


@query("relation_matrix_sparse", _sql("order", " SELECT DISTINCT log_id, case_idx, a, b, kind FROM df, (VALUES ('D'), ('W')) k(kind)", _DF))
def _(spark, d):
    return relations.relation_matrix(order_log(spark, d))


@query("graph_metrics", _sql("order", """, g AS (SELECT a, b, count(*) AS n FROM df GROUP BY 1, 2), v AS (SELECT count(DISTINCT x) AS n_nodes FROM (SELECT a AS x FROM g UNION ALL SELECT b FROM g))
SELECT 'order' AS log_id, n_nodes, count(*) AS n_edges, CAST(sum(n) AS BIGINT) AS occurrences, round(count(*) / (n_nodes * (n_nodes - 1)), 9) AS density, round(count(*) / n_nodes, 9) AS mean_degree FROM g, v GROUP BY n_nodes""", _DF))
def _(spark, d):
    m = relations.graph_metrics(relations.directly_follows(order_log(spark, d, dense=False)))
    return m.withColumns({c: F.round(c, 9) for c in ("density", "mean_degree")})


@query("degrees", _sql("order", """, g AS (SELECT DISTINCT a, b FROM df), x AS (SELECT a AS activity, 1 AS o, 0 AS i FROM g UNION ALL SELECT b, 0, 1 FROM g)
SELECT 'order' AS log_id, activity, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM x GROUP BY 2""", _DF))
def _(spark, d):
    return relations.degrees(relations.directly_follows(order_log(spark, d, dense=False)))


_RUNS = """conc AS (SELECT DISTINCT x.a, x.b FROM df x JOIN df y ON x.a = y.b AND x.b = y.a),
edge AS (SELECT x.case_idx, x.evt_idx AS i, y.evt_idx AS j, x.activity AS a, y.activity AS b FROM {t} x JOIN {t} y ON x.case_idx = y.case_idx AND x.evt_idx < y.evt_idx LEFT JOIN conc c ON c.a = x.activity AND c.b = y.activity WHERE c.a IS NULL),
reach AS (SELECT case_idx, i, j FROM edge UNION SELECT r.case_idx, r.i, e.j FROM reach r JOIN edge e ON e.case_idx = r.case_idx AND e.i = r.j),
longer AS (SELECT DISTINCT m.case_idx, m.i, r.j FROM edge m JOIN reach r ON r.case_idx = m.case_idx AND r.i = m.j),
red AS (SELECT DISTINCT e.case_idx, a, b FROM edge e LEFT JOIN longer l ON l.case_idx = e.case_idx AND l.i = e.i AND l.j = e.j WHERE l.i IS NULL),
runs AS (SELECT c.case_idx, coalesce(string_agg(a || '>' || b, ';' ORDER BY a, b), '') AS run FROM (SELECT DISTINCT case_idx FROM {t}) c LEFT JOIN red USING (case_idx) GROUP BY 1)"""


@query("runs", _sql("chat", " SELECT 'chat' AS log_id, run, count(*) AS freq FROM runs GROUP BY 2", _DF, _RUNS))
def _(spark, d):
    e = chat_log(spark, d)
    return relations.case_runs(eventlog.traces(e), relations.concurrency(relations.directly_follows(e))).groupBy("log_id", "run").agg(F.count("*").alias("freq"))


# --- measures ---------------------------------------------------------------

_SF = """len AS (SELECT floor(count(*) / count(DISTINCT case_idx)) AS l FROM {t}),
f AS (SELECT x.case_idx, x.activity AS a, y.activity AS b, count(DISTINCT x.evt_idx) AS n_f FROM {t} x JOIN {t} y ON x.case_idx = y.case_idx AND y.evt_idx > x.evt_idx, len WHERE y.evt_idx - x.evt_idx < l GROUP BY 1, 2, 3),
s AS (SELECT case_idx, activity, count(*) AS n FROM {t} GROUP BY 1, 2), sz AS (SELECT case_idx, count(*) AS size FROM {t} GROUP BY 1),
acts AS (SELECT DISTINCT activity FROM {t}), grid AS (SELECT c.case_idx, c.size, x.activity AS a, y.activity AS b FROM sz c, acts x, acts y)"""


@query("window_count", _sql("chat", " SELECT 'chat' AS log_id, case_idx, a, b, CAST(coalesce(n_f, 0) AS DOUBLE) AS value FROM grid LEFT JOIN f USING (case_idx, a, b)", _SF))
def _(spark, d):
    return measures.window_count(chat_log(spark, d))


_J = """j AS (SELECT g.case_idx, g.a, g.b, coalesce(x.n, 0) / g.size AS pa, coalesce(y.n, 0) / g.size AS pb, coalesce(f.n_f / x.n, 0) AS p FROM grid g
LEFT JOIN s x ON x.case_idx = g.case_idx AND x.activity = g.a LEFT JOIN s y ON y.case_idx = g.case_idx AND y.activity = g.b LEFT JOIN f ON f.case_idx = g.case_idx AND f.a = g.a AND f.b = g.b),
jv AS (SELECT case_idx, a, b, pa * (CASE WHEN p = 0 OR pb = 0 THEN 0 ELSE p * log2(p / pb) END + CASE WHEN 1 - p = 0 OR 1 - pb = 0 THEN 0 ELSE (1 - p) * log2((1 - p) / (1 - pb)) END) AS value FROM j)"""


@query("j_measure", _sql("chat", " SELECT 'chat' AS log_id, case_idx, a, b, round(value, 9) AS value FROM jv", _SF, _J))
def _(spark, d):
    return measures.j_measure(chat_log(spark, d)).withColumn("value", F.round("value", 9))


@query("service_times")
def _(spark, d):
    e = user_log(spark, d)
    from pyspark.sql import Window

    start = F.coalesce(F.lag("ts").over(Window.partitionBy("log_id", "case_idx").orderBy("evt_idx")), F.col("ts"))
    return measures.service_times(e.withColumn("start_ts", start))


# --- windows ----------------------------------------------------------------

_WC = """f AS (SELECT x.case_idx, count(DISTINCT x.evt_idx) AS n FROM {t} x JOIN {t} y ON x.case_idx = y.case_idx AND y.evt_idx > x.evt_idx, (SELECT floor(count(*) / count(DISTINCT case_idx)) AS l FROM {t}) WHERE y.evt_idx - x.evt_idx < l AND x.activity = 'NO' AND y.activity = 'NO' GROUP BY 1),
sig AS (SELECT c.case_idx, coalesce(n, 0) AS v FROM (SELECT DISTINCT case_idx FROM {t}) c LEFT JOIN f USING (case_idx)),
pre AS (SELECT s.case_idx, w.v, sum(CAST(s.v = w.v AS INT)) OVER (PARTITION BY w.v ORDER BY s.case_idx) - CAST(s.v = w.v AS INT) AS p FROM sig s, (SELECT DISTINCT v FROM sig) w),
cnt AS (SELECT i + {w} AS pos, v, c1, c2 FROM (SELECT case_idx AS i, v, lead(p, {w}) OVER q - p AS c1, lead(p, 2 * {w}) OVER q - lead(p, {w}) OVER q AS c2 FROM pre WINDOW q AS (PARTITION BY v ORDER BY case_idx)) WHERE c2 IS NOT NULL),
ks AS (SELECT pos, max(abs(d)) AS h FROM (SELECT pos, sum(c1 - c2) OVER (PARTITION BY pos ORDER BY v) AS d FROM cnt) GROUP BY 1)"""
_W = 100


def _signal(spark, d):
    e = order_log(spark, d)
    pair = spark.createDataFrame([("order", "NO", "NO")], "log_id string, a string, b string")
    return measures.window_count(e, pair).select("log_id", F.lit("NO>NO").alias("series"), "case_idx", "value")


_KS_P = "CASE WHEN h <= 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(1, CAST({w} // h AS BIGINT) + 1), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(lgamma(2 * {w} + 1) - lgamma({w} - k * h + 1) - lgamma({w} + k * h + 1) - (lgamma(2 * {w} + 1) - 2 * lgamma({w} + 1)))))) END"


@query("ks_sliding_stat", _sql("order", " SELECT 'order' AS log_id, 'NO>NO' AS series, pos, CAST(h AS BIGINT) AS h FROM ks", _WC).replace("{w}", str(_W)))
def _(spark, d):
    return windows.ks_statistic(windows.two_windows(_signal(spark, d), _W))


@query("ks_sliding_pvalue", (_sql("order", " SELECT 'order' AS log_id, 'NO>NO' AS series, pos, round(" + _KS_P + ", 9) AS pval FROM ks", _WC)).replace("{w}", str(_W)))
def _(spark, d):
    return windows.p_values(_signal(spark, d), _W).withColumn("pval", F.round("pval", 9))


@query("ks_strided", (_sql("order", " SELECT 'order' AS log_id, 'NO>NO' AS series, pos, round(" + _KS_P + ", 9) AS pval FROM ks WHERE (pos - {w}) % 7 = 0", _WC)).replace("{w}", str(_W)))
def _(spark, d):
    return windows.p_values(_signal(spark, d), _W, 7).withColumn("pval", F.round("pval", 9))


@query(
    "mannwhitney_sliding_u",
    _sql("order", " SELECT 'order' AS log_id, 'NO>NO' AS series, pos, CAST(sum(c1 * (l + c2 / 2)) AS DOUBLE) AS u, CAST(sum(pow(c1 + c2, 3) - (c1 + c2)) AS DOUBLE) AS ties FROM (SELECT *, coalesce(sum(c2) OVER (PARTITION BY pos ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM cnt) GROUP BY pos", _WC).replace("{w}", str(_W)),
)
def _(spark, d):
    return windows.mw_statistic(windows.two_windows(_signal(spark, d), _W)).withColumns({"u": F.col("u").cast("double"), "ties": F.col("ties").cast("double")})


#: Upper tail of the gamma distribution with shape {a} at {x}, by the series of the lower one.
_TAIL = "CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 200 + CAST(2 * {x} AS BIGINT)), lambda i: exp(({a} + i) * ln({x}) - {x} - lgamma({a} + i + 1))))) END"
_MW = """mw AS (SELECT *, (abs(u - {w} * {w} / 2) - 0.5) / sqrt({w} * {w} / 12 * (2 * {w} + 1 - ties / (2 * {w} * (2 * {w} - 1)))) AS z, 2 * {w} * (2 * {w} - 1) * (2 * {w} + 1) AS all_tied FROM (SELECT series, pos, sum(c1 * (l + c2 / 2)) AS u, CAST(sum(pow(c1 + c2, 3) - (c1 + c2)) AS DOUBLE) AS ties
  FROM (SELECT *, coalesce(sum(c2) OVER (PARTITION BY series, pos ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM cnt) GROUP BY 1, 2))"""
_MW_P = "CASE WHEN ties >= all_tied OR z <= 0 THEN 1.0 ELSE " + _TAIL.replace("{a}", "0.5").replace("{x}", "(z * z / 2)") + " END"


@query("mannwhitney_pvalue", _sql("order", " SELECT 'order' AS log_id, series, pos, round(" + _MW_P + ", 9) AS pval FROM mw", _WC.replace("cnt AS (SELECT i + {w} AS pos", "cnt AS (SELECT 'NO>NO' AS series, i + {w} AS pos").replace("WHERE c2 IS NOT NULL)", "WHERE c2 IS NOT NULL AND i % 5 = 0)"), _MW).replace("{w}", str(_W)))
def _(spark, d):
    return windows.p_values(_signal(spark, d), _W, 5, "mw").withColumn("pval", F.round("pval", 9))


_CHI = "SELECT 'order' AS log_id, 'NO>NO' AS series, pos, round(CASE WHEN count(*) = 2 THEN sum(2 * pow(greatest(0, abs(c1 - c2) / 2 - 0.5), 2) / ((c1 + c2) / 2)) ELSE sum(pow(c1 - c2, 2) / (c1 + c2)) END, 9) AS chi2, count(*) - 1 AS dof FROM cnt WHERE c1 + c2 > 0 GROUP BY pos"


@query("chi2_sliding_stat", _sql("order", " " + _CHI, _WC).replace("{w}", str(_W)))
def _(spark, d):
    return windows.chi2_statistic(windows.two_windows(_signal(spark, d), _W)).withColumn("chi2", F.round("chi2", 9))


@query(
    "consecutive_low",
    (
        _sql("order", ", p AS (SELECT pos, round(" + _KS_P + ", 9) AS pval FROM ks), i AS (SELECT pos, pval, sum(CAST(NOT (pval < 0.3) AS INT)) OVER (ORDER BY pos) AS g FROM p) SELECT 'order' AS log_id, pos FROM (SELECT pos, row_number() OVER (PARTITION BY g ORDER BY pos) AS r FROM i WHERE pval < 0.3) WHERE r = 5", _WC)
    ).replace("{w}", str(_W)),
)
def _(spark, d):
    p = windows.p_values(_signal(spark, d), _W).withColumn("pval", F.round("pval", 9))
    return windows.streaks(p, 0.3, 5)


_HOTELLING = """s2 AS (SELECT x.case_idx AS i, x.v AS x, y.v AS y FROM sig x JOIN sig y ON x.case_idx = y.case_idx AND x.series = 'click>view' AND y.series = 'view>click'),
m AS (SELECT b.i AS s, {g} AS dummy, avg(x) FILTER (a.i < b.i + {w}) AS x1, avg(x) FILTER (a.i >= b.i + {w}) AS x2, avg(y) FILTER (a.i < b.i + {w}) AS y1, avg(y) FILTER (a.i >= b.i + {w}) AS y2,
  (var_samp(x) FILTER (a.i < b.i + {w}) + var_samp(x) FILTER (a.i >= b.i + {w})) / 2 AS xx, (var_samp(y) FILTER (a.i < b.i + {w}) + var_samp(y) FILTER (a.i >= b.i + {w})) / 2 AS yy,
  (covar_samp(x, y) FILTER (a.i < b.i + {w}) + covar_samp(x, y) FILTER (a.i >= b.i + {w})) / 2 AS xy
  FROM (SELECT i FROM s2 WHERE i % 2 = 0 AND i < (SELECT max(i) + 1 FROM s2) - 2 * {w}) b JOIN s2 a ON a.i BETWEEN b.i AND b.i + 2 * {w} - 1 GROUP BY b.i),
t AS (SELECT s + {w} AS pos, {w} / 2 * (yy * pow(x1 - x2, 2) - 2 * xy * (x1 - x2) * (y1 - y2) + xx * pow(y1 - y2, 2)) / (xx * yy - xy * xy) AS t2 FROM m)"""


@query("hotelling_sliding", _sql("user", ", sig AS (SELECT a || '>' || b AS series, case_idx, coalesce(n_f, 0) AS v FROM grid LEFT JOIN f USING (case_idx, a, b)), " + _HOTELLING + " SELECT 'user' AS log_id, pos, round(t2, 6) AS t2, round(pow(1 + t2 / (2 * {w} - 2), -(2 * {w} - 3) / 2), 6) AS pval FROM t", _SF).replace("{w}", "20").replace("{g}", "1"))
def _(spark, d):
    """Over two signals, where the F distribution's tail has a closed form."""
    pairs = spark.createDataFrame([("user", "click", "view"), ("user", "view", "click")], "log_id string, a string, b string")
    out = windows.sliding_hotelling(detectors.signals(user_log(spark, d), "WC", pairs), 20, 2)
    return out.withColumns({"t2": F.round("t2", 6), "pval": F.round("pval", 6)})


# --- detectors --------------------------------------------------------------

_SIG_WC = "sig AS (SELECT a || '>' || b AS series, case_idx, CAST(coalesce(n_f, 0) AS DOUBLE) AS v FROM grid LEFT JOIN f USING (case_idx, a, b))"
_SIG_J = "sig AS (SELECT a || '>' || b AS series, case_idx, round(value, 12) AS v FROM jv)"
#: From sig (series, case_idx, v): how often each value occurs in both windows, and the largest difference of the running counts.
_CNT = """vals AS (SELECT DISTINCT series, v FROM sig), pre AS (SELECT s.series, s.case_idx, x.v, sum(CAST(s.v = x.v AS INT)) OVER (PARTITION BY s.series, x.v ORDER BY s.case_idx) - CAST(s.v = x.v AS INT) AS p FROM sig s JOIN vals x ON s.series = x.series),
cnt AS (SELECT series, i + {w} AS pos, v, c1, c2 FROM (SELECT series, case_idx AS i, v, lead(p, {w}) OVER q - p AS c1, lead(p, 2 * {w}) OVER q - lead(p, {w}) OVER q AS c2 FROM pre WINDOW q AS (PARTITION BY series, v ORDER BY case_idx)) WHERE c2 IS NOT NULL AND i % {step} = 0),
ks AS (SELECT series, pos, max(abs(d)) AS h FROM (SELECT series, pos, sum(c1 - c2) OVER (PARTITION BY series, pos ORDER BY v) AS d FROM cnt) GROUP BY 1, 2)"""
_MEAN_KS = "mp AS (SELECT pos, round(avg(" + _KS_P + "), 12) AS pval FROM ks GROUP BY 1)"
_MEAN_MW = "mp AS (SELECT pos, round(avg(" + _MW_P + "), 12) AS pval FROM mw GROUP BY 1)"
#: From xs (i, x): maxima (middles of plateaus), their prominence and their width at half of it.
_PEAKS = """pl AS (SELECT min(i) AS s, max(i) AS e, any_value(x) AS x FROM (SELECT i, x, sum(c) OVER (ORDER BY i) AS g FROM (SELECT i, x, CASE WHEN x = lag(x) OVER (ORDER BY i) THEN 0 ELSE 1 END AS c FROM xs)) GROUP BY g),
pk AS (SELECT (s + e) // 2 AS p, x FROM (SELECT *, lag(x) OVER (ORDER BY s) AS a, lead(x) OVER (ORDER BY s) AS b FROM pl) WHERE x > a AND x > b),
lim AS (SELECT p, k.x, coalesce((SELECT max(y.i) + 1 FROM xs y WHERE y.i < p AND y.x > k.x), 0) AS lo, coalesce((SELECT min(y.i) - 1 FROM xs y WHERE y.i > p AND y.x > k.x), (SELECT max(i) FROM xs)) AS hi FROM pk k),
prom AS (SELECT *, m.x - greatest((SELECT min(y.x) FROM xs y WHERE y.i BETWEEN lo AND p), (SELECT min(y.x) FROM xs y WHERE y.i BETWEEN p AND hi)) AS pr FROM lim m),
lev AS (SELECT *, x - pr / 2 AS lv FROM prom),
edge AS (SELECT *, coalesce((SELECT max(y.i) FROM xs y WHERE y.i BETWEEN lo AND p AND y.x <= lv), lo) AS l, coalesce((SELECT min(y.i) FROM xs y WHERE y.i BETWEEN p AND hi AND y.x <= lv), hi) AS r FROM lev),
wide AS (SELECT e.p, e.pr, CASE WHEN r0.x < lv THEN r - (lv - r0.x) / (r1.x - r0.x) ELSE r END - CASE WHEN l0.x < lv THEN l + (lv - l0.x) / (l1.x - l0.x) ELSE l END AS width
  FROM edge e JOIN xs l0 ON l0.i = l JOIN xs l1 ON l1.i = l + 1 JOIN xs r0 ON r0.i = r JOIN xs r1 ON r1.i = r - 1)"""


def _with(sql: str, w: int, step: int = 1) -> str:
    return sql.replace("{w}", str(w)).replace("{step}", str(step))


@query("bose_avg_pvalue", _with(_sql("chat", " SELECT 'chat' AS log_id, pos, round(pval, 9) AS pval FROM mp", _SF, _J, _SIG_J, _CNT, _MEAN_KS), 20, 2))
def _(spark, d):
    return detectors.bose_p(chat_log(spark, d), 20, "J", "ks", 2).withColumn("pval", F.round("pval", 9))


@query("bose_wc_mw_pvalue", _with(_sql("chat", " SELECT 'chat' AS log_id, pos, round(pval, 9) AS pval FROM mp", _SF, _SIG_WC, _CNT, _MW, _MEAN_MW), 20))
def _(spark, d):
    return detectors.bose_p(chat_log(spark, d), 20, "WC", "mw", 1).withColumn("pval", F.round("pval", 9))


@query("bose_changepoints", _with(_sql("drift", " SELECT 'order' AS log_id, CAST(p AS DOUBLE) AS change_point FROM wide WHERE width >= 80 AND pr >= 0.1", _SF, _SIG_WC, _CNT, _MEAN_KS, "xs AS (SELECT c.case_idx AS i, -coalesce(pval, 1.0) AS x FROM (SELECT DISTINCT case_idx FROM {t}) c LEFT JOIN mp ON pos = case_idx)", _PEAKS), 300))
def _(spark, d):
    return detectors.bose(drift_log(spark, d), 300, "WC", "ks", 1)


@query("bose_step_changepoints", _with(_sql("drift", " SELECT 'order' AS log_id, CAST(p * 10 + 300 AS DOUBLE) AS change_point FROM wide WHERE width >= 8 AND pr >= 0.1", _SF, _SIG_WC, _CNT, _MEAN_KS, "xs AS (SELECT (pos - 300) // 10 AS i, -pval AS x FROM mp)", _PEAKS), 300, 10))
def _(spark, d):
    return detectors.bose(drift_log(spark, d), 300, "WC", "ks", 10)


@query("martjushev_changepoints")
def _(spark, d):
    return detectors.martjushev(user_drift_log(spark, d), 40, 0.4, "WC")


@query("martjushev_univariate_changepoints")
def _(spark, d):
    pair = spark.createDataFrame([("user", "click", "click")], "log_id string, a string, b string")
    return detectors.martjushev_univariate(detectors.signals(user_drift_log(spark, d), "WC", pair), 40, 0.05)


@query("adwin_changepoints")
def _(spark, d):
    return detectors.adwin(user_drift_log(spark, d), 30, 60, 0.4, 10, "WC")


@query("adwin_jumping_changepoints")
def _(spark, d):
    return detectors.adwin(user_drift_log(spark, d), 30, 60, 0.4, 10, "WC", variant="jumping")


#: Chi-square of the runs of both windows, from rcnt (pos, run, c1, c2).
_RUN_P = """rv AS (SELECT DISTINCT run FROM runs), rpre AS (SELECT s.case_idx, x.run, sum(CAST(s.run = x.run AS INT)) OVER (PARTITION BY x.run ORDER BY s.case_idx) - CAST(s.run = x.run AS INT) AS p FROM runs s, rv x),
rcnt AS (SELECT i + {w} AS pos, run, c1, c2 FROM (SELECT case_idx AS i, run, lead(p, {w}) OVER q - p AS c1, lead(p, 2 * {w}) OVER q - lead(p, {w}) OVER q AS c2 FROM rpre WINDOW q AS (PARTITION BY run ORDER BY case_idx)) WHERE c2 IS NOT NULL AND i % {step} = 0)"""
_CHI_P = """chi AS (SELECT pos, CASE WHEN count(*) = 2 THEN sum(2 * pow(greatest(0, abs(c1 - c2) / 2 - 0.5), 2) / ((c1 + c2) / 2)) ELSE sum(pow(c1 - c2, 2) / (c1 + c2)) END AS x2, count(*) - 1 AS dof FROM rcnt WHERE c1 + c2 > 0 GROUP BY 1),
rp AS (SELECT pos, CASE WHEN dof = 0 THEN 1.0 ELSE """ + _TAIL.replace("{a}", "(dof / 2)").replace("{x}", "(x2 / 2)") + """ END AS pval FROM chi)"""
_STREAK = "hit AS (SELECT pos FROM (SELECT pos, row_number() OVER (PARTITION BY g ORDER BY pos) AS r FROM (SELECT *, sum(CAST(pval >= 0.05 AS INT)) OVER (ORDER BY pos) AS g FROM rp) WHERE pval < 0.05) WHERE r = {w} // 3)"
#: Runs by the concurrency of each pair of windows alone (cases i to i + 2w - 1).
_WINDOW_RUNS = """starts AS (SELECT case_idx AS s FROM (SELECT DISTINCT case_idx FROM {t}) WHERE case_idx % {step} = 0 AND case_idx < (SELECT max(case_idx) + 1 FROM {t}) - 2 * {w}),
conc AS (SELECT DISTINCT x.s, x.a, x.b FROM (SELECT DISTINCT s, a, b FROM starts JOIN df ON case_idx BETWEEN s AND s + 2 * {w} - 1) x JOIN (SELECT DISTINCT s, a, b FROM starts JOIN df ON case_idx BETWEEN s AND s + 2 * {w} - 1) y ON x.s = y.s AND x.a = y.b AND x.b = y.a),
vt AS (SELECT case_idx, string_agg(activity, ',' ORDER BY evt_idx) AS trace FROM {t} GROUP BY 1), vs AS (SELECT DISTINCT s, trace FROM starts JOIN vt ON case_idx BETWEEN s AND s + 2 * {w} - 1),
ve AS (SELECT trace, u.i AS i, string_split(trace, ',')[u.i] AS a FROM (SELECT DISTINCT trace FROM vt), LATERAL (SELECT unnest(range(1, len(string_split(trace, ',')) + 1)) AS i) u),
edge AS (SELECT v.s, v.trace, x.i, y.i AS j, x.a, y.a AS b FROM vs v JOIN ve x ON x.trace = v.trace JOIN ve y ON y.trace = v.trace AND x.i < y.i LEFT JOIN conc c ON c.s = v.s AND c.a = x.a AND c.b = y.a WHERE c.a IS NULL),
reach AS (SELECT s, trace, i, j FROM edge UNION SELECT r.s, r.trace, r.i, e.j FROM reach r JOIN edge e ON e.s = r.s AND e.trace = r.trace AND e.i = r.j),
longer AS (SELECT DISTINCT m.s, m.trace, m.i, r.j FROM edge m JOIN reach r ON r.s = m.s AND r.trace = m.trace AND r.i = m.j),
red AS (SELECT DISTINCT e.s, e.trace, a, b FROM edge e LEFT JOIN longer l ON l.s = e.s AND l.trace = e.trace AND l.i = e.i AND l.j = e.j WHERE l.i IS NULL),
wr AS (SELECT v.s, v.trace, coalesce(string_agg(a || '>' || b, ';' ORDER BY a, b), '') AS run FROM vs v LEFT JOIN red r ON r.s = v.s AND r.trace = v.trace GROUP BY 1, 2),
rcnt AS (SELECT s + {w} AS pos, run, count(*) FILTER (case_idx < s + {w}) AS c1, count(*) FILTER (case_idx >= s + {w}) AS c2 FROM wr JOIN vt USING (trace) WHERE case_idx BETWEEN s AND s + 2 * {w} - 1 GROUP BY 1, 2)"""
#: The same by the concurrency of all cases up to the newest of the windows, which the first 2w cases have in common.
_PREFIX_RUNS = _WINDOW_RUNS.replace("JOIN df ON case_idx BETWEEN s AND s + 2 * {w} - 1", "JOIN df ON case_idx <= s + 2 * {w} - 1")


@query("prodrift_pvalue", _with(_sql("chat_drift", " SELECT 'chat' AS log_id, pos, round(pval, 9) AS pval FROM rp", _DF, _RUNS, _RUN_P, _CHI_P), 20, 2))
def _(spark, d):
    return detectors.prodrift_p(chat_drift_log(spark, d), 20, 2).withColumn("pval", F.round("pval", 9))


@query("prodrift_changepoints", _with(_sql("chat_drift", " SELECT 'chat' AS log_id, CAST(pos AS DOUBLE) AS change_point FROM hit", _DF, _RUNS, _RUN_P, _CHI_P, _STREAK), 20))
def _(spark, d):
    return detectors.prodrift(chat_drift_log(spark, d), 20, 1)


@query("prodrift_step_changepoints", _with(_sql("chat_drift", " SELECT 'chat' AS log_id, CAST(pos AS DOUBLE) AS change_point FROM hit", _DF, _RUNS, _RUN_P, _CHI_P, _STREAK), 20, 2))
def _(spark, d):
    return detectors.prodrift(chat_drift_log(spark, d), 20, 2)


@query("prodrift_prefix_changepoints", _with(_sql("chat_drift", " SELECT 'chat' AS log_id, CAST(pos AS DOUBLE) AS change_point FROM hit", _DF, _PREFIX_RUNS, _CHI_P, _STREAK), 20))
def _(spark, d):
    return detectors.prodrift(chat_drift_log(spark, d), 20, 1, alpha_from="prefix")


@query("prodrift_prefix_pvalue", _with(_sql("chat_drift", " SELECT 'chat' AS log_id, pos, round(pval, 9) AS pval FROM rp", _DF, _PREFIX_RUNS, _CHI_P), 20, 2))
def _(spark, d):
    return detectors.prodrift_p(chat_drift_log(spark, d), 20, 2, "prefix").withColumn("pval", F.round("pval", 9))


@query("prodrift_window_pvalue", _with(_sql("chat_drift", " SELECT 'chat' AS log_id, pos, round(pval, 9) AS pval FROM rp", _DF, _WINDOW_RUNS, _CHI_P), 20, 2))
def _(spark, d):
    return detectors.prodrift_p(chat_drift_log(spark, d), 20, 2, "window").withColumn("pval", F.round("pval", 9))


@query("prodrift_window_changepoints", _with(_sql("chat_drift", " SELECT 'chat' AS log_id, CAST(pos AS DOUBLE) AS change_point FROM hit", _DF, _WINDOW_RUNS, _CHI_P, _STREAK), 20))
def _(spark, d):
    return detectors.prodrift(chat_drift_log(spark, d), 20, 1, alpha_from="window")


@query("pgm_changepoints")
def _(spark, d):
    return detectors.pgm(drift_log(spark, d), 100, 400, 0.05)


_PGM = """ev AS (SELECT case_idx, 'e' AS kind, a || '>' || b AS x FROM df UNION ALL SELECT case_idx, 'v', activity FROM {t}),
o AS (SELECT kind, x, count(*) FILTER (case_idx < 600) AS o1, count(*) FILTER (case_idx >= 600) AS o2 FROM ev WHERE case_idx >= 100 AND case_idx < 1100 GROUP BY 1, 2),
k AS (SELECT *, sum(o1) OVER (PARTITION BY kind) AS t1, sum(o2) OVER (PARTITION BY kind) AS t2 FROM o WHERE o1 > 0 AND o2 > 0)"""


@query("pgm_statistics", _sql("order", """ SELECT 'order' AS log_id, kind, round(sum(pow(o1 - (o1 + o2) * t1 / (t1 + t2), 2) / ((o1 + o2) * t1 / (t1 + t2)) + pow(o2 - (o1 + o2) * t2 / (t1 + t2), 2) / ((o1 + o2) * t2 / (t1 + t2))), 6) AS chi2,
round(sum(2 * o2 * ln(o2 / o1)), 6) AS g, count(*) - 1 AS dof FROM k GROUP BY kind""", _DF, _PGM))
def _(spark, d):
    return detectors.table_statistics(detectors.pgm_counts(order_log(spark, d), 100, 500)).withColumns({c: F.round(c, 6) for c in ("chi2", "g")})


_RINV = """n AS (SELECT max(case_idx) + 1 AS n FROM {t}), has AS (SELECT DISTINCT a, b, case_idx FROM df), pairs AS (SELECT DISTINCT a, b FROM has),
cell AS (SELECT p.a, p.b, c.case_idx AS j, h.case_idx IS NOT NULL AS v FROM pairs p CROSS JOIN (SELECT DISTINCT case_idx FROM {t} WHERE case_idx >= 1) c LEFT JOIN has h ON h.a = p.a AND h.b = p.b AND h.case_idx = c.case_idx),
run AS (SELECT a, b, v, g, min(j) AS s, max(j) AS e FROM (SELECT *, j - row_number() OVER (PARTITION BY a, b, v ORDER BY j) AS g FROM cell) GROUP BY 1, 2, 3, 4),
cand AS (SELECT DISTINCT c AS candidate FROM (SELECT s AS c FROM run WHERE e - s + 1 >= {mrid} AND s <> 1 UNION ALL SELECT e + 1 FROM run, n WHERE e - s + 1 >= {mrid} AND e < n.n - 1)),
clu AS (SELECT k, count(*) AS size, avg(candidate) AS centre, min(candidate) AS low FROM (SELECT candidate, sum(g) OVER (ORDER BY candidate) AS k FROM (SELECT candidate, CASE WHEN candidate - lag(candidate) OVER (ORDER BY candidate) > {eps} THEN 1 ELSE 0 END AS g FROM cand)) GROUP BY k),
ord AS (SELECT centre, row_number() OVER (ORDER BY size DESC, low) AS r FROM clu),
acc AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS DOUBLE[]) AS taken UNION ALL
  SELECT o.r, CASE WHEN o.centre > 1 AND o.centre - len(list_filter(acc.taken, lambda x: x < o.centre)) >= {mrid} AND len(list_filter(acc.taken, lambda x: x < o.centre)) + 1 - o.centre <= {mrid} AND NOT list_contains(acc.taken, o.centre) THEN list_append(acc.taken, o.centre) ELSE acc.taken END
  FROM acc JOIN ord o ON o.r = acc.r + 1)"""


@query("rinv_candidates", _sql("chat", " SELECT 'chat' AS log_id, candidate FROM cand", _DF, _RINV).replace("{mrid}", "4").replace("{eps}", "2"))
def _(spark, d):
    return detectors.rinv_candidates(chat_log(spark, d), 4)


@query("rinv_clusters", _sql("chat", " SELECT 'chat' AS log_id, size, centre, low FROM clu", _DF, _RINV).replace("{mrid}", "4").replace("{eps}", "1"))
def _(spark, d):
    return detectors.rinv_clusters(detectors.rinv_candidates(chat_log(spark, d), 4), 1)


@query("rinv_changepoints", _sql("chat", " SELECT 'chat' AS log_id, unnest(taken) AS change_point FROM (SELECT taken FROM acc ORDER BY r DESC LIMIT 1)", _DF, _RINV).replace("{mrid}", "4").replace("{eps}", "1"))
def _(spark, d):
    return detectors.rinv(chat_log(spark, d), 4, 1)


@query("rinv_multi_eps", " UNION ALL ".join("(" + _sql("drift", f" SELECT 'order' AS log_id, CAST({e} AS DOUBLE) AS eps, unnest(taken) AS change_point FROM (SELECT taken FROM acc ORDER BY r DESC LIMIT 1)", _DF, _RINV).replace("{mrid}", "300").replace("{eps}", str(e)) + ")" for e in (30, 60, 90)))
def _(spark, d):
    return detectors.rinv_multi(drift_log(spark, d), 300, [30, 60, 90])


_LCDD = """n AS (SELECT max(case_idx) + 1 AS n FROM {t}), rel AS (SELECT DISTINCT case_idx, a || '>' || b AS x FROM df), cs AS (SELECT DISTINCT case_idx FROM {t}),
nxt AS (SELECT s.case_idx AS s,
  (SELECT min(r.case_idx) FROM rel r WHERE r.case_idx >= s.case_idx + {c} AND r.x NOT IN (SELECT x FROM rel q WHERE q.case_idx >= s.case_idx AND q.case_idx < s.case_idx + {c})) AS new_at,
  (SELECT count(*) FROM (SELECT DISTINCT x FROM rel q WHERE q.case_idx >= s.case_idx AND q.case_idx < s.case_idx + {c} EXCEPT SELECT x FROM rel q WHERE q.case_idx >= s.case_idx + {c} AND q.case_idx < s.case_idx + {c} + {d})) AS gone FROM cs s),
nx AS (SELECT s, CASE WHEN s + {c} >= n THEN NULL WHEN new_at < s + {c} + {d} THEN new_at WHEN s + {c} + {d} < n AND gone > 1 THEN s + {c} ELSE new_at END AS t FROM nxt, n),
walk AS (SELECT t AS p FROM nx WHERE s = 0 UNION ALL SELECT nx.t FROM walk JOIN nx ON nx.s = walk.p WHERE walk.p IS NOT NULL)"""


@query("lcdd_changepoints", _sql("chat", " SELECT 'chat' AS log_id, CAST(p AS DOUBLE) AS change_point FROM walk WHERE p IS NOT NULL", _DF, _LCDD).replace("{c}", "3").replace("{d}", "3"))
def _(spark, d):
    return detectors.lcdd(chat_log(spark, d), 3, 3)


#: For each case s and relation x: the last place of x before s + c, and the next one from there on.
_LCDD_FAST = """n AS (SELECT max(case_idx) + 1 AS n FROM {t}), rel AS (SELECT DISTINCT case_idx, a || '>' || b AS x FROM df), cs AS (SELECT DISTINCT case_idx AS s FROM {t}), xs AS (SELECT DISTINCT x FROM rel), sx AS (SELECT s, x FROM cs, xs),
prv AS (SELECT k.s, k.x, r.case_idx AS p FROM sx k ASOF JOIN rel r ON k.x = r.x AND r.case_idx < k.s + {c}), nxt AS (SELECT k.s, k.x, r.case_idx AS q FROM sx k ASOF JOIN rel r ON k.x = r.x AND r.case_idx >= k.s + {c}),
st AS (SELECT k.s, min(q) FILTER (NOT coalesce(p >= k.s, false)) AS new_at, count(*) FILTER (coalesce(p >= k.s, false) AND coalesce(q >= k.s + {c} + {d}, true)) AS gone FROM sx k LEFT JOIN prv ON prv.s = k.s AND prv.x = k.x LEFT JOIN nxt ON nxt.s = k.s AND nxt.x = k.x GROUP BY 1),
nx AS (SELECT s, CASE WHEN s + {c} >= n THEN NULL WHEN new_at < s + {c} + {d} THEN new_at WHEN s + {c} + {d} < n AND gone > 1 THEN s + {c} ELSE new_at END AS t FROM st, n),
walk AS (SELECT t AS p FROM nx WHERE s = 0 UNION ALL SELECT nx.t FROM walk JOIN nx ON nx.s = walk.p WHERE walk.p IS NOT NULL)"""


@query("lcdd_order", _sql("drift", " SELECT 'order' AS log_id, CAST(p AS DOUBLE) AS change_point FROM walk WHERE p IS NOT NULL", _DF, _LCDD_FAST).replace("{c}", "200").replace("{d}", "200"))
def _(spark, d):
    return detectors.lcdd(drift_log(spark, d), 200, 200)


@query("lcdd_user", _sql("user_drift", " SELECT 'user' AS log_id, CAST(p AS DOUBLE) AS change_point FROM walk WHERE p IS NOT NULL", _DF, _LCDD_FAST).replace("{c}", "10").replace("{d}", "10"))
def _(spark, d):
    return detectors.lcdd(user_drift_log(spark, d), 10, 10)


# --- distances --------------------------------------------------------------

_VARIANTS = "var AS (SELECT row_number() OVER (ORDER BY min(case_idx)) - 1 AS variant_id, trace, code FROM (SELECT case_idx, string_agg(activity, ',' ORDER BY evt_idx) AS trace, string_agg(chr(64 + CAST(r AS INT)), '' ORDER BY evt_idx) AS code FROM (SELECT *, dense_rank() OVER (ORDER BY activity) AS r FROM {t}) GROUP BY 1) GROUP BY trace, code)"


@query("trace_levenshtein", _sql("chat", " SELECT 'chat' AS log_id, x.variant_id AS v1, y.variant_id AS v2, CAST(levenshtein(x.code, y.code) AS BIGINT) AS lev, round(levenshtein(x.code, y.code) / greatest(length(x.code), length(y.code)), 9) AS distance FROM var x JOIN var y ON x.variant_id <= y.variant_id", _VARIANTS))
def _(spark, d):
    v = distances.variant_distances(eventlog.variants(eventlog.traces(chat_log(spark, d))))
    return v.withColumns({"lev": F.col("lev").cast("long"), "distance": F.round("distance", 9)})


_LANG = """cv AS (SELECT t.case_idx, v.variant_id FROM traces t JOIN (SELECT trace, row_number() OVER (ORDER BY min(case_idx)) - 1 AS variant_id FROM traces GROUP BY trace) v USING (trace)), n AS (SELECT count(*) AS n FROM cv),
st AS (SELECT case_idx AS s FROM cv, n WHERE case_idx % 3 = 0 AND case_idx < n - 40)"""


@query("window_language", _sql("chat", " SELECT 'chat' AS log_id, s + 20 AS pos, CAST(case_idx >= s + 20 AS INT) AS side, variant_id, round(count(*) / 20, 9) AS p FROM st JOIN cv ON case_idx >= s AND case_idx < s + 40 GROUP BY 1, 2, 3, 4", _TRACES, _LANG))
def _(spark, d):
    return distances.window_language(eventlog.case_variants(eventlog.traces(chat_log(spark, d))), 20, 3).withColumn("p", F.round("p", 9))


@query("emd_series")
def _(spark, d):
    return distances.emd_series(eventlog.traces(chat_log(spark, d)), 20, 2)


@query("emd_changepoints")
def _(spark, d):
    """The whole order log, a position in fifty (the detector's step)."""
    return detectors.emd(drift_log(spark, d), 25, 50)


# --- splitting --------------------------------------------------------------

_SPLIT = "SELECT log_id, sublog, count(DISTINCT case_idx) AS n_cases, count(*) AS n_events FROM x GROUP BY 1, 2"


@query("split_case_groups", _sql("user", ", x AS (SELECT *, CAST(case_idx // 7 AS BIGINT) AS sublog FROM {t}) " + _SPLIT))
def _(spark, d):
    return split.sublog_sizes(split.by_case_groups(user_log(spark, d), 7))


@query("split_start_time", _sql("user", ", c AS (SELECT case_idx, min(epoch_us(ts)) AS st FROM {t} GROUP BY 1), x AS (SELECT u.*, CAST(floor((c.st - (SELECT min(st) FROM c)) / 3600000000) AS BIGINT) AS sublog FROM {t} u JOIN c USING (case_idx)) " + _SPLIT))
def _(spark, d):
    return split.sublog_sizes(split.by_start_time(user_log(spark, d), 3_600_000_000))


_MID = "m AS (SELECT epoch_us(date_trunc('day', min(ts))) AS mid FROM {t})"


@query("split_trim", _sql("user", ", y AS (SELECT u.*, epoch_us(ts) - mid AS off FROM {t} u, m), x AS (SELECT *, CAST(floor(off / 86400000000) AS BIGINT) AS sublog FROM y UNION ALL SELECT *, CAST(floor(off / 86400000000) AS BIGINT) - 1 FROM y WHERE off % 86400000000 = 0 AND off > 0) " + _SPLIT, _MID))
def _(spark, d):
    return split.sublog_sizes(split.by_trim(user_log(spark, d)))


@query("split_intersect", _sql("user", ", c AS (SELECT case_idx, unnest(range(CAST(floor((min(epoch_us(ts)) - any_value(mid)) / 86400000000) AS BIGINT), CAST(floor((max(epoch_us(ts)) - any_value(mid)) / 86400000000) AS BIGINT) + 1)) AS sublog FROM {t}, m GROUP BY 1), x AS (SELECT u.*, sublog FROM {t} u JOIN c USING (case_idx)) " + _SPLIT, _MID))
def _(spark, d):
    return split.sublog_sizes(split.by_intersection(user_log(spark, d)))


# --- evaluation -------------------------------------------------------------

#: Inline cases for the assignment: three detections each.
ASSIGNMENTS = [("doc", [1050, 934, 2100], [1000, 1149, 2000]), ("dup", [1000, 1001, 2000], [1000, 2000]), ("far", [10, 5000, 990], [1000, 2000]), ("tie", [100, 300, 500], [200, 400, 600])]


def _assignments(spark):
    rows = [(n, [float(x) for x in d], [float(x) for x in a]) for n, d, a in ASSIGNMENTS]
    return spark.createDataFrame(rows, "name string, detected array<double>, actual array<double>")


_ASSIGN_SQL = (
    "WITH r(name, detected, actual) AS (VALUES " + ", ".join(f"('{n}', {d}::DOUBLE[], {a}::DOUBLE[])" for n, d, a in ASSIGNMENTS) + """),
o AS (SELECT name, detected, actual, unnest(list_append(range(1, len(actual) + 1), 0)) AS i FROM r), m AS (SELECT x.name, x.detected, x.actual, x.i AS i1, y.i AS i2, z.i AS i3 FROM o x JOIN o y USING (name) JOIN o z USING (name)
  WHERE (x.i = 0 OR x.i <> y.i) AND (x.i = 0 OR x.i <> z.i) AND (y.i = 0 OR y.i <> z.i)),
c AS (SELECT name, detected, actual, list_filter([CASE WHEN i1 > 0 THEN abs(detected[1] - actual[i1]) END, CASE WHEN i2 > 0 THEN abs(detected[2] - actual[i2]) END, CASE WHEN i3 > 0 THEN abs(detected[3] - actual[i3]) END], lambda x: x IS NOT NULL) AS gaps FROM m),
b AS (SELECT name, any_value(detected) AS detected, any_value(actual) AS actual, arg_min(gaps, -1e12 * len(gaps) + coalesce(list_sum(list_transform(gaps, lambda g: g * g)), 0)) AS gaps FROM c WHERE len(list_filter(gaps, lambda g: g > 200)) = 0 GROUP BY name),
s AS (SELECT name, len(gaps) AS tp, len(detected) - len(gaps) AS fp, len(list_filter(detected, lambda d: len(list_filter(actual, lambda a: abs(d - a) <= 200)) = 0)) AS far, len(actual) AS n_actual, list_sum(gaps) AS gap, list_sum(list_transform(gaps, lambda g: g * g)) AS squares FROM b)"""
)


@query("assignment", _ASSIGN_SQL + " SELECT name, CAST(tp AS BIGINT) AS n_pairs, round(coalesce(squares, 0), 6) AS squares FROM s")
def _(spark, d):
    a = evaluation.with_assignment(_assignments(spark))
    return a.select("name", F.size("pairs").cast("long").alias("n_pairs"), F.round(F.aggregate("pairs", F.lit(0.0), lambda s, p: s + (p.d - p.a) * (p.d - p.a)), 6).alias("squares"))


@query("tp_fp", _ASSIGN_SQL + " SELECT name, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM s")
def _(spark, d):
    return evaluation.with_tp_fp(evaluation.with_assignment(_assignments(spark))).select("name", F.col("tp").cast("long"), F.col("fp").cast("long"))


@query("tp_fp_ignore_duplicates", _ASSIGN_SQL + " SELECT name, CAST(tp AS BIGINT) AS tp, CAST(far AS BIGINT) AS fp FROM s")
def _(spark, d):
    return evaluation.with_tp_fp(evaluation.with_assignment(_assignments(spark)), count_duplicates=False).select("name", F.col("tp").cast("long"), F.col("fp").cast("long"))


@query("precision_recall_f1", _ASSIGN_SQL + " SELECT name, round(tp / (tp + fp), 9) AS precision, round(tp / n_actual, 9) AS recall, round(2 * tp / (tp + fp + n_actual), 9) AS f1 FROM s")
def _(spark, d):
    return evaluation.evaluated(_assignments(spark)).select("name", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("avg_lag", _ASSIGN_SQL + " SELECT name, round(gap / tp, 9) AS avg_lag FROM s")
def _(spark, d):
    return evaluation.evaluated(_assignments(spark)).select("name", F.round("avg_lag", 9).alias("avg_lag"))


@query("tpr_fpr", _ASSIGN_SQL + " SELECT name, round(tp / n_actual, 9) AS tpr, round(fp / 50, 9) AS fpr FROM s")
def _(spark, d):
    counted = evaluation.with_tp_fp(evaluation.with_assignment(_assignments(spark)))
    return evaluation.with_rates(counted, 50).select("name", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


def _fixture() -> list[tuple]:
    """Result rows: algorithms x settings x logs, with detections near at most one known point each."""
    logs = [("Ceravolo", f"x_y_noise{k}_1000_{p}", [499]) for k in (0, 5, 10) for p in ("cb", "cd", "cf")]
    logs += [("Ceravolo", "x_y_noise0_1000_ior", [499])]
    logs += [("Ostovar", f"Atomic_{p}_output_{p}{s}", [999, 1999]) for p in ("Loop", "Swap") for s in ("", "_2", "_5")]
    logs += [("Ostovar", "Composite_Loop_output_Loop", [999, 1999]), ("Bose", "bose_log", [1199, 2399, 3599, 4799])]
    rows, k = [], 0
    for name in ("Bose J", "LCDD", "Zheng DBSCAN", "Martjushev ADWIN WC"):
        for setting in (1, 2):
            for source, log, actual in logs:
                k += 1
                found = [a + (k * 37 + 11 * i) % 190 - 90 for i, a in enumerate(actual) if (k + i) % 3]
                found += [actual[0] + 15] if k % 5 == 0 else []
                found += [actual[-1] + 450] if k % 4 == 0 else []
                rows.append((name, source, log, [float(x) for x in found], [float(x) for x in actual], float(k % 17) + 0.5, f"s{setting}"))
    return rows


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_fixture(), "algorithm string, log_source string, log string, detected array<double>, actual array<double>, seconds double, params string")


def fixture_lengths(spark: SparkSession) -> DataFrame:
    f = fixture(spark).select("log_source", "log", "actual").dropDuplicates(["log_source", "log"])
    return f.select("log_source", "log", (F.size("actual") * 1000).cast("long").alias("n_cases"), (F.length("log") * 1000).cast("long").alias("n_events"))


_ROWS = ", ".join(f"('{a}', '{s}', '{l}', {d}::DOUBLE[], {t}::DOUBLE[], {x}, '{p}')" for a, s, l, d, t, x, p in _fixture())
_NAMES = "CASE algorithm " + " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'" for k, v in scoreboard.SHORT_NAMES.items()) + " ELSE algorithm END"
_CODES = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scoreboard.PATTERN_CODES.items()) + " END"
_BASE = f"""WITH raw(algorithm, log_source, log, detected, actual, seconds, params) AS (VALUES {_ROWS}),
pre AS (SELECT {_NAMES} AS algorithm, log_source, log, detected, actual, CAST(seconds AS DOUBLE) AS seconds, params,
  CASE log_source WHEN 'Ceravolo' THEN list_extract(string_split(log, '_'), -1) WHEN 'Ostovar' THEN (SELECT {_CODES} FROM (SELECT CASE WHEN regexp_full_match(list_extract(string_split(log, '_'), -1), '[0-9]+') THEN list_extract(string_split(log, '_'), -2) ELSE list_extract(string_split(log, '_'), -1) END AS t)) END AS change_pattern,
  CASE log_source WHEN 'Ceravolo' THEN regexp_extract(log, 'noise([0-9]*)_', 1) WHEN 'Ostovar' THEN CASE WHEN regexp_full_match(list_extract(string_split(log, '_'), -1), '[0-9]+') THEN list_extract(string_split(log, '_'), -1) ELSE '0' END END AS noise
  FROM raw WHERE algorithm <> 'Martjushev ADWIN WC' AND ((log_source = 'Ostovar' AND lower(log) LIKE 'atomic%') OR lower(log) LIKE 'bose%' OR (log_source = 'Ceravolo' AND list_sort(list_distinct(string_split(list_extract(string_split(log, '_'), -1), ''))) <> ['i', 'o', 'r']))),
gaps AS (SELECT *, list_filter(list_transform(actual, lambda a: list_min(list_transform(detected, lambda d: abs(d - a)))), lambda g: g <= 200) AS g FROM pre),
cnt AS (SELECT *, len(g) AS tp, len(detected) - len(g) AS fp, len(actual) AS n_actual, coalesce(list_sum(g), 0) AS gap,
  CASE log_source WHEN 'Ostovar' THEN NOT (log LIKE '%\\_2' ESCAPE '\\' OR log LIKE '%\\_5' ESCAPE '\\') WHEN 'Ceravolo' THEN list_extract(string_split(log, '_'), 3) = 'noise0' ELSE true END AS clean,
  CAST(len(actual) * 1000 AS BIGINT) AS n_cases, CAST(length(log) * 1000 AS BIGINT) AS n_events FROM gaps),
acc AS (SELECT algorithm, params, CASE WHEN sum(tp) = 0 THEN 0.0 ELSE 2 / (sum(tp + fp) / sum(tp) + sum(n_actual) / sum(tp)) END AS f1, sum(tp) / sum(tp + fp) AS precision, sum(tp) / sum(n_actual) AS recall FROM cnt WHERE clean GROUP BY 1, 2),
lat AS (SELECT algorithm, params, 1 - sum(gap) / sum(tp) / 200 AS latency FROM cnt WHERE clean GROUP BY 1, 2),
ver AS (SELECT algorithm, params, avg(r) AS versatility FROM (SELECT algorithm, params, change_pattern, sum(tp) / sum(n_actual) AS r FROM cnt WHERE clean AND change_pattern IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
sen AS (SELECT algorithm, params, CASE WHEN f1 = 0 OR versatility = 0 OR latency = 0 THEN 0.0 ELSE 3 / (1 / f1 + 1 / versatility + 1 / latency) END AS score FROM acc JOIN ver USING (algorithm, params) JOIN lat USING (algorithm, params)),
nacc AS (SELECT log_source, algorithm, noise, max(CASE WHEN tp = 0 THEN 0.0 ELSE 2 / (n / tp + na / tp) END) AS a, max(CASE WHEN tp = 0 THEN NULL ELSE 1 - gap / tp / 200 END) AS l FROM (SELECT log_source, algorithm, noise, params, sum(tp) AS tp, sum(tp + fp) AS n, sum(n_actual) AS na, sum(gap) AS gap FROM cnt WHERE log_source <> 'Bose' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
nver AS (SELECT log_source, algorithm, noise, max(v) AS v FROM (SELECT log_source, algorithm, noise, params, avg(r) AS v FROM (SELECT log_source, algorithm, noise, params, change_pattern, sum(tp) / sum(n_actual) AS r FROM cnt WHERE log_source <> 'Bose' GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
nm AS (SELECT log_source, algorithm, noise, CASE WHEN a = 0 OR v = 0 OR l = 0 THEN 0.0 WHEN l IS NULL THEN 'nan'::DOUBLE ELSE 3 / (1 / a + 1 / l + 1 / v) END AS score FROM nacc JOIN nver USING (log_source, algorithm, noise)),
rb AS (SELECT algorithm, avg(auc) AS robustness FROM (SELECT log_source, algorithm, CASE WHEN first * span = 0 THEN 0 ELSE area / (first * span) END AS auc FROM (SELECT log_source, algorithm, sum(ar) AS area, max(CASE WHEN x = 0 THEN y END) AS first, max(x) - min(x) AS span FROM
  (SELECT log_source, algorithm, x, y, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS ar FROM (SELECT log_source, algorithm, CAST(noise AS INT) AS x, CASE WHEN isnan(score) THEN 0 ELSE score END AS y FROM nm) WINDOW w AS (PARTITION BY log_source, algorithm ORDER BY x)) GROUP BY 1, 2)) GROUP BY 1)"""


def _clean(spark):
    return scoreboard.noise_split(scoreboard.counted(scoreboard.preprocessed(fixture(spark))))[0]


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query("preprocess_results", _BASE + " SELECT algorithm, log_source, log, params, change_pattern, noise FROM pre")
def _(spark, d):
    return scoreboard.preprocessed(fixture(spark)).select("algorithm", "log_source", "log", "params", "change_pattern", "noise")


@query("noise_split", _BASE + " SELECT algorithm, log, params, CASE WHEN clean THEN 'clean' ELSE 'noisy' END AS part FROM cnt")
def _(spark, d):
    clean, noisy = scoreboard.noise_split(scoreboard.preprocessed(fixture(spark)))
    return clean.select("algorithm", "log", "params", F.lit("clean").alias("part")).union(noisy.select("algorithm", "log", "params", F.lit("noisy")))


@query("accuracy_by_params", _BASE + " SELECT algorithm, params, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM acc")
def _(spark, d):
    return _round(scoreboard.accuracy_by_params(_clean(spark)), "precision", "recall", "f1")


@query("accuracy_best", _BASE + " SELECT algorithm, arg_min(params, -f1 * 1e6 + CAST(substr(params, 2) AS INT)) AS best_params, round(max(f1), 9) AS accuracy FROM acc GROUP BY 1")
def _(spark, d):
    return _round(scoreboard.accuracy(_clean(spark)).select("algorithm", "best_params", "accuracy"), "accuracy")


@query("latency_by_params", _BASE + " SELECT algorithm, params, round(latency, 9) AS latency FROM lat")
def _(spark, d):
    return _round(scoreboard.latency_by_params(_clean(spark)), "latency")


@query("latency_best", _BASE + " SELECT algorithm, round((1 - max(latency)) * 200, 9) AS mean_lag FROM lat GROUP BY 1")
def _(spark, d):
    return _round(scoreboard.latency(_clean(spark)).select("algorithm", "mean_lag"), "mean_lag")


@query("versatility", _BASE + " SELECT algorithm, round(max(versatility), 9) AS versatility FROM ver GROUP BY 1")
def _(spark, d):
    return _round(scoreboard.versatility(_clean(spark)).select("algorithm", "versatility"), "versatility")


@query("recall_by_pattern", _BASE + " SELECT algorithm, params, change_pattern, round(sum(tp) / sum(n_actual), 9) AS recall FROM cnt WHERE clean AND change_pattern IS NOT NULL GROUP BY 1, 2, 3")
def _(spark, d):
    return _round(scoreboard.recall_by_pattern(_clean(spark)), "recall")


@query("scalability", _BASE + " SELECT algorithm, round(avg(seconds), 9) AS mean_seconds, strftime(make_timestamp(CAST(floor(avg(seconds)) AS BIGINT) * 1000000), '%H:%M:%S') AS scalability FROM pre GROUP BY 1")
def _(spark, d):
    return _round(scoreboard.scalability(scoreboard.preprocessed(fixture(spark))), "mean_seconds")


@query("rel_scalability", _BASE + " SELECT algorithm, round(sum(seconds) / sum(n_cases) * 1000, 9) AS ms_per_case, round(sum(seconds) / sum(n_events) * 1000, 9) AS ms_per_event FROM cnt GROUP BY 1")
def _(spark, d):
    return _round(scoreboard.relative_scalability(scoreboard.preprocessed(fixture(spark)), fixture_lengths(spark)), "ms_per_case", "ms_per_event")


@query("ms_per_event", _BASE + " SELECT algorithm, log, params, round(seconds * 1000 / n_events, 9) AS ms_per_event FROM cnt")
def _(spark, d):
    return _round(scoreboard.with_ms_per_event(scoreboard.preprocessed(fixture(spark)), fixture_lengths(spark)).select("algorithm", "log", "params", "ms_per_event"), "ms_per_event")


@query("param_sensitivity", _BASE + " SELECT algorithm, params, round(score, 9) AS score FROM sen")
def _(spark, d):
    return _round(scoreboard.sensitivity(_clean(spark)), "score")


@query("param_sensitivity_iqr", _BASE + " SELECT algorithm, round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 9) AS iqr FROM sen GROUP BY 1")
def _(spark, d):
    return _round(scoreboard.sensitivity_iqr(scoreboard.sensitivity(_clean(spark))), "iqr")


@query("noise_means", _BASE + " SELECT log_source, algorithm, noise, round(score, 9) AS score FROM nm")
def _(spark, d):
    return _round(scoreboard.noise_means(scoreboard.counted(scoreboard.preprocessed(fixture(spark)))), "score")


@query("robustness_auc", _BASE + " SELECT algorithm, round(robustness, 9) AS robustness FROM rb")
def _(spark, d):
    return _round(scoreboard.robustness(scoreboard.noise_means(scoreboard.counted(scoreboard.preprocessed(fixture(spark))))), "robustness")


@query(
    "measures",
    _BASE + """ SELECT a.algorithm, round(a.accuracy, 9) AS accuracy, round(b.l, 9) AS latency, round(c.v, 9) AS versatility, d.scalability, round(d.pc, 9) AS ms_per_case, round(d.pe, 9) AS ms_per_event, round(e.iqr, 9) AS iqr, round(rb.robustness, 9) AS robustness
FROM (SELECT algorithm, max(f1) AS accuracy FROM acc GROUP BY 1) a JOIN (SELECT algorithm, (1 - max(latency)) * 200 AS l FROM lat GROUP BY 1) b USING (algorithm) JOIN (SELECT algorithm, max(versatility) AS v FROM ver GROUP BY 1) c USING (algorithm)
JOIN (SELECT algorithm, strftime(make_timestamp(CAST(floor(avg(seconds)) AS BIGINT) * 1000000), '%H:%M:%S') AS scalability, sum(seconds) / sum(n_cases) * 1000 AS pc, sum(seconds) / sum(n_events) * 1000 AS pe FROM cnt GROUP BY 1) d USING (algorithm)
JOIN (SELECT algorithm, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr FROM sen GROUP BY 1) e USING (algorithm) JOIN rb USING (algorithm)""",
)
def _(spark, d):
    return _round(scoreboard.measures(fixture(spark), fixture_lengths(spark)), "accuracy", "latency", "versatility", "ms_per_case", "ms_per_event", "iqr", "robustness")


@query("change_pattern_distribution", _BASE + ", l AS (SELECT DISTINCT log_source, log, coalesce(change_pattern, 'Mixed (Bose)') AS change_pattern FROM pre) SELECT change_pattern, count(*) FILTER (log_source = 'Ceravolo') AS Ceravolo, count(*) FILTER (log_source = 'Ostovar') AS Ostovar, count(*) FILTER (log_source = 'Bose') AS Bose, count(*) AS total, round(100 * count(*) / (SELECT count(*) FROM l), 9) AS percent FROM l GROUP BY 1")
def _(spark, d):
    return _round(scoreboard.pattern_distribution(scoreboard.preprocessed(fixture(spark))), "percent")


@query("dataset_totals", _BASE + " SELECT count(*) AS logs, CAST(sum(n_cases) AS BIGINT) AS cases, CAST(sum(n_events) AS BIGINT) AS events, CAST(sum(n_actual) AS BIGINT) AS drifts FROM (SELECT DISTINCT log_source, log, n_cases, n_events, n_actual FROM cnt)")
def _(spark, d):
    return scoreboard.dataset_totals(scoreboard.preprocessed(fixture(spark)), fixture_lengths(spark))


@query("duplicate_rows", "WITH r(algorithm, x) AS (VALUES ('a', 1), ('a', 1), ('b', 2), ('b', 3)) SELECT algorithm, x, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return scoreboard.duplicate_rows(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 3)], "algorithm string, x int"))


@query("roc_points", _BASE + " SELECT params, round(avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END), 9) AS precision, round(avg(tp / n_actual), 9) AS recall FROM cnt GROUP BY 1")
def _(spark, d):
    return _round(evaluation.roc_points(evaluation.with_scores(scoreboard.counted(scoreboard.preprocessed(fixture(spark)))), "params"), "precision", "recall")


_POINTS = _BASE + ", p AS (SELECT algorithm, params, avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (tp + fp + n_actual) END) AS f1, avg(seconds) AS seconds FROM cnt GROUP BY 1, 2)"


def _scatter(spark):
    scored = evaluation.with_scores(scoreboard.counted(scoreboard.preprocessed(fixture(spark))))
    return evaluation.scatter_points(scored.withColumn("name", F.concat_ws("/", "algorithm", "params")), "name", ["f1", "seconds"])


@query("scatter_points", _POINTS + " SELECT algorithm || '/' || params AS name, round(f1, 9) AS f1, round(seconds, 9) AS seconds FROM p")
def _(spark, d):
    return _round(_scatter(spark), "f1", "seconds")


@query("pareto_front", _POINTS + " SELECT algorithm || '/' || params AS name, round(f1, 9) AS f1, round(seconds, 9) AS seconds FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE round(q.f1, 9) > round(p.f1, 9) AND round(q.seconds, 9) < round(p.seconds, 9))")
def _(spark, d):
    return evaluation.pareto(_round(_scatter(spark), "f1", "seconds"), ["f1", "seconds"], [False, True])


@query("mean_duration", "WITH r(algorithm, s) AS (VALUES ('a', 3661), ('a', 61), ('b', 90000)) SELECT algorithm, strftime(make_timestamp((CAST(floor(avg(s)) AS BIGINT) % 86400) * 1000000), '%H:%M:%S') AS mean_duration FROM r GROUP BY 1")
def _(spark, d):
    return scoreboard.mean_duration(spark.createDataFrame([("a", "01:01:01"), ("a", "00:01:01"), ("b", "25:00:00")], "algorithm string, duration string"))


@query("log_catalogue", "SELECT * FROM (VALUES ('Bose', 'bose_log', '1199,2399,3599,4799'), ('Ceravolo', 'a_b_noise0_1000_cb', '499'), ('Ostovar', 'Atomic_Loop_output_Loop', '999,1999')) t(log_source, log, points)")
def _(spark, d):
    paths = ["logs/Bose/bose_log.xes.gz", "logs/Ceravolo/a_b_noise0_1000_cb.xes.gz", "logs/Ceravolo/a_b_noise0_500_cb.xes.gz", "logs/Ostovar/Atomic_Loop_output_Loop.xes.gz"]
    out = log_catalogue.with_ground_truth(spark.createDataFrame([(p,) for p in paths], "path string"))
    return out.select("log_source", "log", F.array_join(F.transform("actual", lambda x: x.cast("int").cast("string")), ",").alias("points"))


@query("time_differences", "SELECT event_id, round((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 3600000000, 6) AS hours, strftime(make_timestamp((epoch_us(ts) // 1000000 % 86400) * 1000000), '%H:%M:%S') AS clock FROM events")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    seconds = F.unix_micros("ts") / 1e6
    return e.select("event_id", F.round(scalars.time_difference(scalars.midnight(F.col("ts")), F.col("ts"), "hours"), 6).alias("hours"), scalars.format_duration(seconds).alias("clock"))


@query("grid_plan", "SELECT approach, count(*) AS n FROM (SELECT 'lcdd' AS approach, a.x, b.x FROM range(7) a(x), range(7) b(x) UNION ALL SELECT 'pgm', a.x, b.x FROM range(16) a(x), range(4) b(x)) CROSS JOIN range(2) GROUP BY 1")
def _(spark, d):
    windows_ = [100, 200, 300, 400, 600, 800, 1200]
    config = {"lcdd": {"complete,detection": [(w, w) for w in windows_], "stable_period": [5, 10, 20, 50, 100, 150, 200]}, "pgm": {"w,most": [(a, b) for a in (100, 200, 300, 400) for b in (400, 500, 600, 700)], "alpha": [0.1, 0.05, 0.005, 0.0001]}}
    logs = spark.createDataFrame([("l1",), ("l2",)], "log string")
    return grid.plan(spark, config, logs).groupBy("approach").agg(F.count("*").alias("n"))


@query(
    "grid_run",
    "WITH found AS (" + " UNION ALL ".join(
        [f"SELECT 'LCDD' AS algorithm, NULL AS eps, {w} AS w, p AS d FROM (" + _sql("drift", " SELECT p FROM walk WHERE p IS NOT NULL", _DF, _LCDD_FAST).replace("{c}", str(w)).replace("{d}", str(w)) + ")" for w in (100, 200)]
        + [f"SELECT 'Zheng DBSCAN', {e}, NULL, d FROM (" + _sql("drift", " SELECT unnest(taken) AS d FROM (SELECT taken FROM acc ORDER BY r DESC LIMIT 1)", _DF, _RINV).replace("{mrid}", "300").replace("{eps}", str(e)) + ")" for e in (30, 60)]
    ) + """), true_ AS (SELECT ceil(count(DISTINCT l_orderkey) / 2) - 1 AS a, count(DISTINCT l_orderkey) AS n FROM lineitem),
runs AS (SELECT * FROM (VALUES ('LCDD', NULL, 100), ('LCDD', NULL, 200), ('Zheng DBSCAN', 30, NULL), ('Zheng DBSCAN', 60, NULL)) r(algorithm, eps, w)),
j AS (SELECT r.algorithm, r.eps, r.w, count(d) AS n_d, min(abs(d - a)) FILTER (abs(d - a) <= 200) AS lag FROM runs r CROSS JOIN true_ LEFT JOIN found f ON f.algorithm = r.algorithm AND f.eps IS NOT DISTINCT FROM r.eps AND f.w IS NOT DISTINCT FROM r.w GROUP BY ALL)
SELECT algorithm, 'order' AS log, CAST(eps AS DOUBLE) AS epsilon, CAST(w AS DOUBLE) AS complete_window, n AS n_cases, CAST(n_d AS INT) AS n_detected, CASE WHEN lag IS NULL THEN NULL ELSE round(2 / (n_d + 1), 9) END AS f1, lag AS avg_lag FROM j, true_""",
)
def _(spark, d):
    e = drift_log(spark, d).persist()
    middle = F.ceil(F.col("n_cases") / 2).cast("double") - 1  # the last case before the change
    logs = eventlog.log_lengths(e).select("log_id", F.lit("driver").alias("log_source"), F.array(middle).alias("actual"))
    out = grid.run_all(e, {"lcdd": {"complete,detection": [(100, 100), (200, 200)], "stable_period": [10]}, "rinv": {"mrid": [300], "eps_modifiers": [[0.1, 0.2]]}}, logs)
    e.unpersist()
    nan = lambda c: F.when(F.isnan(c), None).otherwise(F.round(c, 9))
    return out.select("algorithm", "log", F.col("Epsilon").alias("epsilon"), F.col("Complete-Window Size").alias("complete_window"), "n_cases", "n_detected", nan(F.col("f1")).alias("f1"), nan(F.col("avg_lag")).alias("avg_lag"))


@query("peaks", _with(_sql("chat_drift", " SELECT 'chat' AS log_id, p * 2 + 20 AS pos FROM wide WHERE width >= 5 AND pr >= 0.02", _SF, _SIG_WC, _CNT, _MEAN_KS, "xs AS (SELECT (pos - 20) // 2 AS i, -pval AS x FROM mp)", _PEAKS), 20, 2))
def _(spark, d):
    return windows.peak_positions(detectors.bose_p(chat_drift_log(spark, d), 20, "WC", "ks", 2), 5, 0.02, True, 2, 20)
