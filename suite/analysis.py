"""Plan corpora, latency comparison, forecasts, workflow, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.constants import FORECAST_DEFAULT
from fleetlens.operators import abtest, forecast, quantiles, reconcile, rollups, workflow
from fleetlens.plans import corpus
from fleetlens.session import spread
from suite.health import AS_OF, QPS, _rated, rounded
from suite.views import table, view, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn

    return add


# --- plan corpora ---------------------------------------------------------------------------------

NODES = """docs AS (SELECT plan_id, CASE WHEN plan_id % 13 = 0 THEN concat('[', plan_json, ']') WHEN plan_id % 17 = 0 THEN substr(plan_json, 2) ELSE plan_json END AS doc FROM plan_docs),
good AS (SELECT plan_id, CASE WHEN starts_with(doc, '[') THEN json_extract(doc, '$[0]') ELSE json(doc) END AS j FROM docs WHERE json_valid(doc)),
walk AS (SELECT plan_id, '0' AS path, NULL::VARCHAR AS parent_path, 0 AS depth, json_extract(j, '$.Plan') AS n FROM good
  UNION ALL SELECT plan_id, concat(path, '.', k), path, depth + 1, json_extract(n, concat('$.Plans[', k, ']'))
  FROM (SELECT *, unnest(range(CAST(json_array_length(json_extract(n, '$.Plans')) AS BIGINT))) AS k FROM walk WHERE json_extract(n, '$.Plans') IS NOT NULL)),
nodes AS (SELECT plan_id, path, parent_path, depth, coalesce(n->>'$."Node Type"', 'Unknown') AS node_type, n->>'$."Relation Name"' AS relation_name,
  coalesce(CAST(n->>'$."Total Cost"' AS DOUBLE), 0) AS total_cost, coalesce(CAST(n->>'$."Plan Rows"' AS BIGINT), 0) AS plan_rows,
  coalesce(CAST(n->>'$."Actual Rows"' AS BIGINT), 0) AS actual_rows, coalesce(CAST(n->>'$."Actual Loops"' AS BIGINT), 1) AS loops,
  n->>'$."Filter"' AS filter_condition, coalesce(CAST(n->>'$."Rows Removed by Filter"' AS BIGINT), 0) AS removed FROM walk),
measured AS (SELECT *, total_cost * greatest(1, loops) AS cost_score, CASE WHEN plan_rows = 0 THEN 0 ELSE abs(actual_rows - plan_rows)::DOUBLE / plan_rows END AS row_estimate_error,
  node_type = 'Seq Scan' AS is_seq_scan, max(CASE WHEN path = '0' THEN total_cost END) OVER (PARTITION BY plan_id) AS root_cost FROM nodes)"""
PLANS = with_views("plan_docs", more=NODES).replace("WITH ", "WITH RECURSIVE ", 1)


def _parsed(spark, sf, fields=None):
    """Documents as objects, as one-element lists and, some, broken."""
    i, j = F.col("plan_id"), F.col("plan_json")
    doc = F.when(i % 13 == 0, F.concat(F.lit("["), j, F.lit("]"))).when(
        i % 17 == 0, F.substring(j, F.lit(2), F.length(j))).otherwise(j)
    return corpus.parse_plans(spread(view(spark, sf, "plan_docs")).select("plan_id", doc.alias("plan_json")), fields=fields)


@query(PLANS + """ SELECT plan_id, path, parent_path, CAST(depth AS INTEGER) AS depth, node_type, relation_name, total_cost, plan_rows, actual_rows, loops,
  filter_condition, removed AS rows_removed_by_filter, cost_score, row_estimate_error, is_seq_scan,
  (is_seq_scan OR row_estimate_error > 10 OR removed > 1000) AS is_problematic FROM measured""")
def plan_nodes(spark, sf):
    return corpus.flatten_plans(_parsed(spark, sf)).select(
        "plan_id", "path", "parent_path", "depth", "node_type", "relation_name", "total_cost", "plan_rows", "actual_rows",
        "loops", "filter_condition", "rows_removed_by_filter", "cost_score", "row_estimate_error", "is_seq_scan", "is_problematic")


@query(with_views("plan_docs", more=NODES.split(",\nwalk")[0]) + " SELECT plan_id, NOT json_valid(doc) AS parse_error FROM docs WHERE NOT json_valid(doc)")
def broken_plans(spark, sf):
    return _parsed(spark, sf).where("parse_error").select("plan_id", "parse_error")


@query(PLANS + """ SELECT m.plan_id, total_cost, 0::DOUBLE AS total_time_ms, CAST(j->>'$."Planning Time"' AS DOUBLE) AS planning_time_ms,
  CAST(j->>'$."Execution Time"' AS DOUBLE) AS execution_time_ms, 0::BIGINT AS shared_hit_blocks, 0::BIGINT AS shared_read_blocks, 4 AS node_count
FROM measured m JOIN good g ON g.plan_id = m.plan_id WHERE path = '0'""")
def plan_totals(spark, sf):
    return corpus.plan_totals(_parsed(spark, sf))


FOUND = """found AS (SELECT *, unnest(list_filter([CASE WHEN is_seq_scan AND actual_rows > 500 THEN 'seq_scan' END,
  CASE WHEN row_estimate_error > 10 AND actual_rows > 100 THEN 'bad_estimate' END, CASE WHEN total_cost > root_cost * 0.5 THEN 'high_cost' END], lambda x: x IS NOT NULL)) AS finding FROM measured)"""


@query(PLANS + f", {FOUND} SELECT plan_id, path, finding FROM found")
def plan_findings(spark, sf):
    return corpus.plan_findings(corpus.flatten_plans(_parsed(spark, sf, corpus.FOR_FINDINGS))).select("plan_id", "path", "finding")


WANTED = """wanted AS (SELECT plan_id, path, relation_name AS table_name, removed, list_slice(list_filter(
  regexp_extract_all(filter_condition, '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\s*(?:=|>|<|>=|<=|[Ll][Ii][Kk][Ee]|[Ii][Nn])', 1),
  lambda x: lower(x) NOT IN ('and', 'or', 'not', 'null', 'true', 'false', 'is')), 1, 4) AS columns FROM measured
  WHERE is_seq_scan AND actual_rows > 500 AND removed > 100 AND filter_condition IS NOT NULL)"""


@query(PLANS + f", {WANTED} SELECT plan_id, path, table_name, array_to_string(columns, ', ') AS columns, concat('Filter removes ', removed, ' rows') AS reason FROM wanted WHERE len(columns) > 0")
def index_candidates(spark, sf):
    out = corpus.index_candidates(corpus.flatten_plans(_parsed(spark, sf, corpus.FOR_CANDIDATES)))
    return out.withColumn("columns", F.array_join("columns", ", "))


@query(PLANS + f", {WANTED} SELECT table_name, array_to_string(columns, ', ') AS columns, count(*) AS plans FROM wanted WHERE len(columns) > 0 GROUP BY 1, 2")
def index_candidate_rollup(spark, sf):
    return corpus.candidate_rollup(corpus.index_candidates(corpus.flatten_plans(_parsed(spark, sf, corpus.FOR_CANDIDATES))))


@query(PLANS + f""", {WANTED}, per AS (SELECT plan_id,
  string_agg(concat('  - ', relation_name, ' (actual_rows=', actual_rows, ', cost=', printf('%.1f', total_cost), ', filter_removed=', removed, ')'), chr(10) ORDER BY path) FILTER (is_seq_scan AND actual_rows > 500) AS scans,
  count(*) FILTER (is_seq_scan AND actual_rows > 500) AS n_scans,
  string_agg(concat('  - ', node_type, ' on ', coalesce(relation_name, 'None'), ': estimated=', plan_rows, ' actual=', actual_rows), chr(10) ORDER BY path) FILTER (row_estimate_error > 10 AND actual_rows > 100) AS bad,
  count(*) FILTER (row_estimate_error > 10 AND actual_rows > 100) AS n_bad, max(root_cost) AS cost FROM measured GROUP BY plan_id),
idx AS (SELECT plan_id, string_agg(concat('  - ', table_name, '.(', array_to_string(columns, ', '), ')'), chr(10) ORDER BY path) AS wanted FROM wanted WHERE len(columns) > 0 GROUP BY plan_id)
SELECT plan_id, contains(lower(summary), 'seq scan') AS has_seq_scan, summary FROM (
SELECT p.plan_id, concat('Execution time: ', printf('%.1f', CAST(j->>'$."Execution Time"' AS DOUBLE)), 'ms', chr(10), 'Planning time: ', printf('%.1f', CAST(j->>'$."Planning Time"' AS DOUBLE)), 'ms', chr(10),
  'Total cost: ', printf('%.1f', cost), chr(10), 'Buffer hits: 0, reads: 0', chr(10),
  CASE WHEN n_scans > 0 THEN concat(chr(10), 'SEQ SCANS (', n_scans, '):', chr(10), scans) ELSE '' END,
  CASE WHEN n_bad > 0 THEN concat(chr(10), chr(10), 'BAD ROW ESTIMATES (', n_bad, '):', chr(10), bad) ELSE '' END,
  CASE WHEN wanted IS NOT NULL THEN concat(chr(10), chr(10), 'INDEX CANDIDATES:', chr(10), wanted) ELSE '' END) AS summary
FROM per p JOIN good g ON g.plan_id = p.plan_id LEFT JOIN idx ON idx.plan_id = p.plan_id)""")
def plan_summaries(spark, sf):
    return corpus.plan_summaries(_parsed(spark, sf, corpus.FOR_SUMMARIES))


# --- latency comparison ---------------------------------------------------------------------------

EXCLUSIVE = """sorted AS (SELECT session_id, phase, latency_ms AS x, row_number() OVER (PARTITION BY session_id, phase ORDER BY latency_ms) AS r,
  count(*) OVER (PARTITION BY session_id, phase) AS n FROM replay_latencies),
places AS (SELECT *, unnest([50, 95, 99]) AS p FROM sorted),
spots AS (SELECT *, greatest(1, least(n - 1, (n + 1) * p // 100)) AS j FROM places),
pct AS (SELECT session_id, phase, n, p, (max(CASE WHEN r = j THEN x END) * (100 - ((n + 1) * p - j * 100)) + max(CASE WHEN r = j + 1 THEN x END) * ((n + 1) * p - j * 100)) / 100 AS v
  FROM spots GROUP BY session_id, phase, n, p, j),
wide AS (SELECT session_id, phase, n, max(v) FILTER (p = 50) AS p50, max(v) FILTER (p = 95) AS p95, max(v) FILTER (p = 99) AS p99 FROM pct GROUP BY 1, 2, 3)"""


@query(with_views("replay_latencies", more=EXCLUSIVE) + """ SELECT session_id, phase, n, round(CASE WHEN n >= 2 THEN p50 END, 9) AS p50,
  round(CASE WHEN n >= 2 THEN p95 END, 9) AS p95, round(CASE WHEN n >= 2 THEN p99 END, 9) AS p99 FROM wide""")
def replay_percentiles(spark, sf):
    out = quantiles.exclusive_percentiles(view(spark, sf, "replay_latencies"), ["session_id", "phase"], "latency_ms")
    return rounded(out, "p50", "p95", "p99")


@query(with_views("replay_latencies", more=EXCLUSIVE) + """,
moments AS (SELECT session_id, count(*) FILTER (phase = 'before') AS n1, count(*) FILTER (phase = 'after') AS n2,
  avg(latency_ms) FILTER (phase = 'before') AS m1, avg(latency_ms) FILTER (phase = 'after') AS m2,
  var_samp(latency_ms) FILTER (phase = 'before') AS v1, var_samp(latency_ms) FILTER (phase = 'after') AS v2 FROM replay_latencies GROUP BY 1),
pair AS (SELECT m.*, b.p95 AS b95, b.p99 AS b99, a.p95 AS a95, a.p99 AS a99, (m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0) AS t
  FROM moments m JOIN wide b ON b.session_id = m.session_id AND b.phase = 'before' JOIN wide a ON a.session_id = m.session_id AND a.phase = 'after'),
scored AS (SELECT *, abs(t) / sqrt(2.0::DOUBLE) AS z, 1 / (1 + 0.3275911::DOUBLE * abs(t) / sqrt(2.0::DOUBLE)) AS k FROM pair)
SELECT session_id, n1 AS before_n, n2 AS after_n, round(t, 6) AS welch_t, round((b99 - a99) / b99 * 100, 6) AS p99_improvement_pct,
  round((b95 - a95) / b95 * 100, 6) AS p95_improvement_pct,
  round(CASE WHEN n1 < 30 OR n2 < 30 THEN 0.5 WHEN t IS NULL THEN 0 ELSE 1 - ((((1.061405429::DOUBLE * k - 1.453152027::DOUBLE) * k + 1.421413741::DOUBLE) * k - 0.284496736::DOUBLE) * k + 0.254829592::DOUBLE) * k * exp(-z * z) END, 6) AS statistical_confidence,
  coalesce((b99 - a99) / b99 * 100 > 5 AND n1 >= 30 AND n2 >= 30 AND abs(t) > 1.959963984540054::DOUBLE, false) AS is_improvement FROM scored""")
def replay_comparison(spark, sf):
    """Gain, Welch test and verdict per session."""
    out = abtest.compare_phases(view(spark, sf, "replay_latencies"), ["session_id"])
    kept = out.select("session_id", "before_n", "after_n", "welch_t", "p99_improvement_pct", "p95_improvement_pct",
                      "statistical_confidence", "is_improvement")
    return rounded(kept, "welch_t", "p99_improvement_pct", "p95_improvement_pct", "statistical_confidence", digits=6)


# --- forecasts ------------------------------------------------------------------------------------

SERIES = QPS + """,
minutes AS (SELECT database_id, date_trunc('minute', time) AS ds, coalesce(avg(active_connections), 0) AS active_connections,
  avg(p99_latency_ms) AS p99_latency_ms, avg(qps) AS qps, avg(cache_hit_ratio) AS cache_hit_ratio FROM rated GROUP BY 1, 2),
series AS (SELECT database_id, ds, metric, y, (epoch_us(ds) - epoch_us(TIMESTAMP '2024-01-31 00:00:00')) / 1e6 AS t
  FROM minutes UNPIVOT (y FOR metric IN (active_connections, p99_latency_ms, qps, cache_hit_ratio))),
fit AS (SELECT database_id, metric, count(*) AS points, min(ds) AS first_ds, max(ds) AS last_ds, max_by(y, ds) AS current_value, stddev_samp(y) AS std,
  regr_slope(y, t) AS slope, regr_intercept(y, t) AS at_origin FROM series GROUP BY 1, 2),
grid AS (SELECT *, unnest(range(1, 673)) AS h FROM fit WHERE points >= 3),
line AS (SELECT *, last_ds + to_hours(h) AS ds, slope * (epoch_us(last_ds) / 1e6 - epoch_us(TIMESTAMP '2024-01-31 00:00:00') / 1e6 + h * 3600) + at_origin AS y FROM grid)"""


def _series(spark, sf):
    return rollups.minute_series(_rated(spark, sf), FORECAST_DEFAULT, AS_OF)


@query(with_views("health_metrics", more=SERIES) + " SELECT database_id, metric, points, first_ds, last_ds, round(current_value, 9) AS current_value, round(std, 6) AS std, round(slope, 12) AS slope FROM fit")
def series_trends(spark, sf):
    out = forecast.trends(_series(spark, sf), AS_OF).drop("intercept")
    return rounded(rounded(rounded(out, "current_value"), "std", digits=6), "slope", digits=12)


@query(with_views("health_metrics", more=SERIES) + """ SELECT database_id, metric, ds, round(greatest(0, y), 6) AS yhat,
  round(greatest(0, y - 1.5 * std), 6) AS yhat_lower, round(y + 1.5 * std, 6) AS yhat_upper, round(current_value, 9) AS current_value FROM line""")
def linear_forecast(spark, sf):
    out = forecast.linear_forecast(_series(spark, sf), AS_OF)
    return rounded(rounded(out, "current_value"), "yhat", "yhat_lower", "yhat_upper", digits=6)


BREACH = """, hits AS (SELECT database_id, metric, any_value(current_value) AS current_value,
  min(CASE WHEN metric = 'p99_latency_ms' AND greatest(0, y) >= 2000 THEN ds WHEN metric = 'qps' AND current_value > 0 AND greatest(0, y) >= current_value * 2 THEN ds {share} END) AS breach_date FROM line GROUP BY 1, 2)
SELECT database_id, metric, CASE metric WHEN 'active_connections' THEN 'connections' WHEN 'p99_latency_ms' THEN 'ms' WHEN 'qps' THEN 'queries/sec' ELSE '' END AS unit,
  round(current_value, 9) AS current_value, breach_date, CAST(CASE WHEN breach_date IS NOT NULL THEN greatest(0, floor((epoch_us(breach_date) - epoch_us(TIMESTAMP '2024-01-31 00:00:00')) / 86400e6)) END AS INTEGER) AS days_until_breach,
  CASE WHEN breach_date IS NOT NULL THEN CASE metric WHEN 'qps' THEN 'Consider read replicas or query caching layer' WHEN 'p99_latency_ms' THEN 'Review top slow queries and add missing indexes'
    ELSE 'Increase max_connections or add PgBouncer connection pooling' END END AS recommendation,
  coalesce(floor((epoch_us(breach_date) - epoch_us(TIMESTAMP '2024-01-31 00:00:00')) / 86400e6) <= 28, false) AS warn FROM hits"""


@query(with_views("health_metrics", more=SERIES) + BREACH.format(share=""))
def capacity_breaches(spark, sf):
    found = forecast.breaches(forecast.linear_forecast(_series(spark, sf), AS_OF), AS_OF)
    return rounded(found, "current_value")


@query(with_views("health_metrics", more=SERIES) + BREACH.format(share="WHEN metric = 'active_connections' AND greatest(0, y) >= 0.85::DOUBLE * 20 THEN ds"))
def capacity_share_breaches(spark, sf):
    """Limits declared as a share of a capacity, switched on: 85 % of a pool of 20."""
    series = _series(spark, sf)
    pools = series.select("database_id", "metric").distinct().where(F.col("metric") == "active_connections").withColumn(
        "capacity", F.lit(20.0))
    found = forecast.breaches(forecast.linear_forecast(series, AS_OF), AS_OF, capacity=pools)
    return rounded(found, "current_value")


@query(with_views("health_metrics", more=SERIES) + """,
rest AS (SELECT s.database_id, s.metric, dayofweek(s.ds) * 24 + hour(s.ds) AS slot, s.y - f.slope * s.t - f.at_origin AS r FROM series s JOIN fit f USING (database_id, metric)),
shape AS (SELECT database_id, metric, slot, avg(r) AS seasonal FROM rest GROUP BY 1, 2, 3),
spread AS (SELECT r.database_id, r.metric, quantile_cont(r.r - s.seasonal, 0.025) AS low, quantile_cont(r.r - s.seasonal, 0.975) AS high FROM rest r JOIN shape s USING (database_id, metric, slot) GROUP BY 1, 2),
full_line AS (SELECT l.database_id, l.metric, l.ds, l.current_value, l.y + coalesce(s.seasonal, 0) AS y FROM line l LEFT JOIN shape s ON s.database_id = l.database_id AND s.metric = l.metric
  AND s.slot = dayofweek(l.ds) * 24 + hour(l.ds))
SELECT database_id, metric, ds, round(y, 6) AS yhat, round(y + low, 6) AS yhat_lower, round(y + high, 6) AS yhat_upper,
  round(current_value, 9) AS current_value FROM full_line JOIN spread USING (database_id, metric)""")
def seasonal_forecast(spark, sf):
    out = forecast.seasonal_forecast(_series(spark, sf), AS_OF)
    return rounded(rounded(out, "current_value"), "yhat", "yhat_lower", "yhat_upper", digits=6)


CUTS = ["2024-01-14 00:00:00", "2024-01-18 12:00:00", "2024-01-23 00:00:00"]


@query(with_views("health_metrics", more=SERIES) + """,
cuts AS (SELECT unnest([""" + ", ".join(f"TIMESTAMP '{c}'" for c in CUTS) + """]) AS cut),
past AS (SELECT database_id, metric, cut, ds, y, (epoch_us(ds) - epoch_us(cut)) / 1e6 AS u FROM series, cuts WHERE ds < cut),
lines AS (SELECT database_id, metric, cut, max_by(y, ds) AS last_y, regr_slope(y, u) AS slope, regr_intercept(y, u) AS base FROM past GROUP BY 1, 2, 3 HAVING count(*) >= 3),
shape AS (SELECT database_id, metric, cut, dayofweek(ds) * 24 + hour(ds) AS slot, avg(y - slope * u - base) AS seasonal FROM past JOIN lines USING (database_id, metric, cut) GROUP BY 1, 2, 3, 4),
ahead AS (SELECT database_id, metric, cut, y, (epoch_us(ds) - epoch_us(cut)) / 1e6 AS u, dayofweek(ds) * 24 + hour(ds) AS slot FROM series, cuts WHERE ds >= cut AND ds < cut + INTERVAL 7 DAY),
judged AS (SELECT a.*, last_y, y - (slope * u + base + coalesce(seasonal, 0)) AS e FROM ahead a JOIN lines USING (database_id, metric, cut)
  LEFT JOIN shape USING (database_id, metric, cut, slot))
SELECT database_id, metric, CAST(floor(u / 86400) + 1 AS INTEGER) AS horizon, count(*) AS points, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse,
  round(avg(abs(y - last_y)), 6) AS naive_mae FROM judged GROUP BY 1, 2, 3""")
def forecast_backtest(spark, sf):
    """Errors of the seasonal forecast by days ahead, over three origins."""
    return rounded(forecast.backtest(_series(spark, sf), CUTS), "mae", "rmse", "naive_mae", digits=6)


@query("""WITH minutes AS (SELECT user_id, date_trunc('minute', ts) AS ds, avg(value) AS y FROM events GROUP BY 1, 2)
SELECT concat('user-', user_id) AS database_id, 'value' AS metric, count(*) AS points, round(max_by(y, ds), 9) AS current_value,
  CASE WHEN count(*) < 40 THEN 'short' END AS error FROM minutes GROUP BY user_id""")
def series_guard(spark, sf):
    """Short series give an error row and their last value."""
    series = table(spark, sf, "events").groupBy(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("database_id"), F.lit("value").alias("metric"),
        F.date_trunc("minute", "ts").alias("ds"),
    ).agg(F.avg("value").alias("y"))
    out = forecast.series_guard(series, min_points=40).withColumn("error", F.when(F.col("error").isNotNull(), "short"))
    return rounded(out, "current_value")


# --- workflow -------------------------------------------------------------------------------------

EDGES = """edges(source, trigger_name, target) AS (VALUES ('proposed', 'review', 'reviewed'), ('reviewed', 'approve', 'approved'), ('approved', 'start_test', 'testing'),
  ('testing', 'deploy', 'deploying'), ('deploying', 'monitor', 'monitoring'), ('monitoring', 'complete', 'completed'), ('reviewed', 'reject', 'rejected'),
  ('proposed', 'reject', 'rejected'), ('deploying', 'rollback', 'rolled_back'), ('monitoring', 'rollback', 'rolled_back'), ('testing', 'deploy_and_monitor', 'monitoring')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY seq, l_partkey, l_extendedprice) AS i FROM proposal_events),
walk AS (SELECT n.proposal_id, 0::BIGINT AS i, 'proposed' AS from_state, 'proposed' AS to_state, true AS legal FROM numbered n WHERE i = 1
  UNION ALL SELECT n.proposal_id, n.i, w.to_state, coalesce(e.target, w.to_state), e.target IS NOT NULL FROM walk w
  JOIN numbered n ON n.proposal_id = w.proposal_id AND n.i = w.i + 1 LEFT JOIN edges e ON e.source = w.to_state AND e.trigger_name = n.trigger_name),
judged AS (SELECT n.*, w.from_state, w.to_state, w.legal FROM walk w JOIN numbered n ON n.proposal_id = w.proposal_id AND n.i = w.i)"""
FLOW = with_views("proposal_events", more=EDGES).replace("WITH ", "WITH RECURSIVE ", 1)
PLACE = ["seq", "l_partkey", "l_extendedprice"]


def _judged(spark, sf):
    return workflow.judged_events(view(spark, sf, "proposal_events"), order=PLACE, keep=["ts"])


@query(FLOW + " SELECT proposal_id, seq, l_partkey, l_extendedprice, ts, trigger_name, from_state, to_state, legal FROM judged")
def workflow_events(spark, sf):
    return _judged(spark, sf)


@query(FLOW + """ SELECT proposal_id, max_by(to_state, i) AS state, count(*) AS events, count(*) FILTER (NOT legal) AS illegal_events,
  coalesce((SELECT string_agg(trigger_name, ', ' ORDER BY CASE trigger_name WHEN 'reject' THEN 'z' WHEN 'rollback' THEN 'z' WHEN 'deploy_and_monitor' THEN 'z' ELSE 'a' END) FROM edges WHERE source = max_by(to_state, i)), '') AS next_triggers
FROM judged GROUP BY 1""")
def proposal_states(spark, sf):
    return workflow.final_states(_judged(spark, sf), order=PLACE)


@query(FLOW + """ SELECT proposal_id, min(ts) FILTER (legal AND trigger_name = 'review') AS reviewed_at, min(ts) FILTER (legal AND trigger_name = 'approve') AS approved_at,
  min(ts) FILTER (legal AND trigger_name IN ('deploy', 'deploy_and_monitor')) AS deployed_at, min(ts) FILTER (legal AND trigger_name = 'rollback') AS rolled_back_at,
  min(ts) FILTER (legal AND trigger_name = 'reject') AS rejected_at, min(ts) FILTER (legal AND trigger_name = 'complete') AS completed_at,
  count(*) FILTER (legal) AS steps FROM judged GROUP BY 1""")
def lifecycle_stamps(spark, sf):
    return workflow.lifecycle_stamps(_judged(spark, sf))


WHO = """, said AS (SELECT *, concat('dba', l_partkey % 9) AS actor, concat('because ', l_extendedprice) AS comment FROM judged WHERE legal)
 SELECT proposal_id, max_by(actor, i) FILTER (trigger_name = 'review') AS reviewed_by, max_by(comment, i) FILTER (trigger_name IN ('review', 'approve')) AS review_comment,
  max_by(actor, i) FILTER (trigger_name = 'approve') AS approved_by, max_by(actor, i) FILTER (trigger_name = 'reject') AS rejected_by,
  max_by(comment, i) FILTER (trigger_name = 'reject') AS rejection_reason, max_by(comment, i) FILTER (trigger_name = 'rollback') AS rollback_reason
 FROM (SELECT j.proposal_id, s.i, s.trigger_name, s.actor, s.comment FROM (SELECT DISTINCT proposal_id FROM judged) j LEFT JOIN said s USING (proposal_id)) GROUP BY 1"""


@query(FLOW + WHO)
def lifecycle_people(spark, sf):
    """Reviewer, approver, rejecter, and the words that went with it."""
    told = _judged(spark, sf).withColumns({
        "actor": F.concat(F.lit("dba"), F.col("l_partkey") % 9), "comment": F.concat(F.lit("because "), F.col("l_extendedprice").cast("string")),
    })
    return workflow.lifecycle_people(told, order=PLACE)


PROPOSALS = """proposals AS (SELECT o_orderkey AS proposal_id, concat('db-', CAST(o_custkey % 8 AS VARCHAR)) AS database_id FROM orders)"""


def _proposals(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("proposal_id"), F.concat(F.lit("db-"), (F.col("o_custkey") % 8).cast("string")).alias("database_id"))


@query(FLOW + f""", {PROPOSALS}, ended AS (SELECT proposal_id, max_by(to_state, i) AS state FROM judged GROUP BY 1)
SELECT database_id, count(*) AS open_proposals FROM proposals LEFT JOIN ended USING (proposal_id)
WHERE coalesce(state NOT IN ('completed', 'rolled_back', 'rejected'), true) GROUP BY 1""")
def open_proposals(spark, sf):
    return workflow.open_proposals(_proposals(spark, sf), workflow.final_states(_judged(spark, sf), order=PLACE))


@query(with_views("proposal_events", more=PROPOSALS) + """ SELECT proposal_id, database_id, count(ts) AS entries, min(ts) AS first_entry_at, max(ts) AS last_entry_at
FROM proposals LEFT JOIN proposal_events USING (proposal_id) GROUP BY 1, 2""")
def proposal_audit(spark, sf):
    return workflow.proposal_audit(_proposals(spark, sf), view(spark, sf, "proposal_events"))


@query(FLOW + """, moves AS (SELECT *, epoch_ms(lead(ts) OVER (PARTITION BY proposal_id ORDER BY i)) // 1000 - epoch_ms(ts) // 1000 AS s FROM judged WHERE legal)
SELECT to_state AS state, count(*) AS entered, count(s) AS "left", round(avg(s), 6) AS avg_seconds FROM moves GROUP BY 1""")
def state_dwell(spark, sf):
    return rounded(workflow.dwell_times(_judged(spark, sf), order=PLACE), "avg_seconds", digits=6)


@query("""SELECT l_orderkey AS proposal_id, max_by(CASE WHEN l_quantity > 25 THEN concat('dba', l_suppkey) END, (l_linenumber, l_partkey, l_extendedprice)) FILTER (l_quantity > 25) AS reviewed_by,
  max_by(l_extendedprice, (l_linenumber, l_partkey, l_extendedprice)) FILTER (l_returnflag = 'R') AS replay_after_p99_ms FROM lineitem GROUP BY 1""")
def proposal_fields(spark, sf):
    """Latest value of each field from a stream of partial updates."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("proposal_id"), "l_linenumber", "l_partkey", "l_extendedprice",
        F.when(F.col("l_quantity") > 25, F.concat(F.lit("dba"), F.col("l_suppkey").cast("string"))).alias("reviewed_by"),
        F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).alias("replay_after_p99_ms"),
    )
    return workflow.apply_updates(rows, "proposal_id", ["reviewed_by", "replay_after_p99_ms"],
                                  ["l_linenumber", "l_partkey", "l_extendedprice"])


PROPOSALS = """SELECT o_orderkey AS proposal_id, concat('db-', CAST(o_custkey % 8 AS VARCHAR)) AS database_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'O' THEN 'proposed' WHEN 'F' THEN 'reviewed' ELSE 'approved' END AS state FROM orders"""


@query(f"""WITH proposals AS ({PROPOSALS}) SELECT * FROM (SELECT * FROM proposals WHERE database_id = 'db-3' ORDER BY created_at DESC, proposal_id LIMIT 50) WHERE state = 'reviewed'""")
def proposal_page(spark, sf):
    """The page is cut first and filtered by state afterwards."""
    status = F.when(F.col("o_orderstatus") == "O", "proposed").when(F.col("o_orderstatus") == "F", "reviewed").otherwise("approved")
    proposals = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("proposal_id"), F.concat(F.lit("db-"), (F.col("o_custkey") % 8).cast("string")).alias("database_id"),
        F.col("o_orderdate").alias("created_at"), status.alias("state"))
    return workflow.list_proposals(proposals, "db-3", 50, "reviewed")


CONTENT = """concat('{"action": "proposal.', lower(o_orderstatus), '", "actor": ', CASE WHEN o_custkey % 5 = 0 THEN 'null' ELSE concat('"dba ', o_custkey, '"') END,
  ', "created_at": "', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '", "database_id": null, "details": {"comment": "', o_orderpriority, '"}, "proposal_id": "', o_orderkey, '"}')"""


def _audit(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("proposal_id"), F.lit(None).cast("string").alias("database_id"),
        F.concat(F.lit("proposal."), F.lower("o_orderstatus")).alias("action"),
        F.when(F.col("o_custkey") % 5 != 0, F.concat(F.lit("dba "), F.col("o_custkey").cast("string"))).alias("actor"),
        F.concat(F.lit('{"comment": "'), "o_orderpriority", F.lit('"}')).alias("details"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("total"),
    )


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS proposal_id, sha256({CONTENT}) AS row_checksum FROM orders")
def audit_checksums(spark, sf):
    return workflow.audit_checksum(_audit(spark, sf)).select("proposal_id", "row_checksum")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS proposal_id FROM orders WHERE o_totalprice > 400000 AND o_custkey % 5 <> 0")
def audit_tampering(spark, sf):
    """Rows whose actor was changed after the checksum was taken."""
    stored = workflow.audit_checksum(_audit(spark, sf))
    changed = stored.withColumn(
        "actor", F.when((F.col("total") > 400000) & F.col("actor").isNotNull(), F.lit("mallory")).otherwise(F.col("actor")))
    return workflow.tampered_rows(changed).select("proposal_id")


# --- reconciliation -------------------------------------------------------------------------------

DAMAGED = "SELECT * REPLACE (CASE WHEN l_orderkey % 1000 = 7 THEN l_tax + 0.01 ELSE l_tax END AS l_tax) FROM lineitem"
CHECKED = ["customer", "supplier", "part", "orders", "nation"]


def _damaged(spark, sf):
    return table(spark, sf, "lineitem").withColumn(
        "l_tax", F.when(F.col("l_orderkey") % 1000 == 7, F.col("l_tax") + 0.01).otherwise(F.col("l_tax")))


def _copies(spark, sf):
    live = {t: table(spark, sf, t) for t in [*CHECKED, "lineitem"]}
    restored = dict(live, lineitem=_damaged(spark, sf))
    restored["orders"] = live["orders"].where(F.col("o_orderkey") % 50 != 3)
    restored["extra"] = live["nation"]
    del restored["nation"]
    return live, restored


@query("""WITH live AS (SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part
  UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'lineitem', count(*) FROM lineitem),
restored AS (SELECT * FROM live WHERE t IN ('customer', 'supplier', 'part', 'lineitem') UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey % 50 <> 3 UNION ALL SELECT 'extra', count(*) FROM nation),
damage AS (SELECT count(*) AS d FROM lineitem WHERE l_orderkey % 1000 = 7)
SELECT coalesce(l.t, r.t) AS table_name, l.n AS live_rows, r.n AS restored_rows, l.n IS NOT DISTINCT FROM r.n AS counts_match,
  l.n IS NOT DISTINCT FROM r.n AND NOT (l.t = 'lineitem' AND (SELECT d FROM damage) > 0) AS content_match,
  CASE WHEN l.n IS NOT NULL AND l.n IS DISTINCT FROM r.n THEN concat(l.t, ': live=', l.n, ' restored=', coalesce(CAST(r.n AS VARCHAR), 'None')) END AS mismatch
FROM live l FULL JOIN restored r ON l.t = r.t""")
def backup_reconciliation(spark, sf):
    """Counts and whole-content digests of a live and a damaged restored set."""
    return reconcile.reconcile(*_copies(spark, sf))


@query("""SELECT 'db-0' AS database_id, 'p1' AS severity, 'backup_verification_failed' AS anomaly_type, 'Backup verification FAILED' AS title,
  concat('nation: live=', (SELECT count(*) FROM nation), ' restored=None; orders: live=', (SELECT count(*) FROM orders), ' restored=', (SELECT count(*) FROM orders WHERE o_orderkey % 50 <> 3)) AS description""")
def backup_alert(spark, sf):
    report = reconcile.reconcile(*_copies(spark, sf))
    verdict = reconcile.verification(report, "db-0", AS_OF).withColumn("error_message", F.col("mismatched_tables"))
    return reconcile.backup_alerts(verdict).select("database_id", "severity", "anomaly_type", "title", "description")


@query(f"""WITH damaged AS ({DAMAGED}), diff AS ((SELECT * FROM lineitem EXCEPT SELECT * FROM damaged) UNION ALL (SELECT * FROM damaged EXCEPT SELECT * FROM lineitem))
SELECT count(*) = 0 AS is_valid, CASE WHEN count(*) = 0 THEN 'Result sets identical' ELSE concat('Result sets differ: ', count(*), ' rows different') END AS reason, count(*) AS differing_rows FROM diff""")
def result_equivalence(spark, sf):
    return reconcile.result_difference(table(spark, sf, "lineitem"), _damaged(spark, sf))


@query("""WITH a AS (SELECT l_returnflag, l_linestatus FROM lineitem), b AS (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity < 40),
counted AS (SELECT l_returnflag, l_linestatus, sum(x) AS d FROM (SELECT *, 1 AS x FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY 1, 2)
SELECT sum(abs(d)) = 0 AS is_valid, concat('Result sets differ: ', sum(abs(d)), ' rows different') AS reason, CAST(sum(abs(d)) AS BIGINT) AS differing_rows FROM counted""")
def multiset_equivalence(spark, sf):
    """Same distinct rows, different multiplicities."""
    a = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    b = table(spark, sf, "lineitem").where(F.col("l_quantity") < 40).select("l_returnflag", "l_linestatus")
    return reconcile.result_difference(a, b, multiset=True)


@query("""WITH a AS (SELECT * FROM lineitem), b AS (SELECT * REPLACE (CASE WHEN l_orderkey % 1000 = 7 THEN l_tax + 0.01 ELSE l_tax END AS l_tax) FROM lineitem),
apart AS (SELECT DISTINCT l_orderkey % 1024 AS bucket FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)))
SELECT bucket, (SELECT count(*) FROM a WHERE a.l_orderkey % 1024 = bucket) AS live_rows, (SELECT count(*) FROM b WHERE b.l_orderkey % 1024 = bucket) AS restored_rows FROM apart""")
def drifted_buckets(spark, sf):
    """Buckets of the key in which two copies differ."""
    return reconcile.differing_buckets(table(spark, sf, "lineitem"), _damaged(spark, sf), "l_orderkey")
