"""Detectors, alert routing, lists, rules, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import alerts, detectors
from suite.health import AS_OF, SKEWED, rounded, skewed
from suite.views import RULES, table, view, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

METRICS = ["active_connections", "lock_waits", "deadlocks", "replication_lag_seconds"]


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn

    return add


def _health(spark, sf):
    return view(spark, sf, "health_metrics")


# --- detectors ------------------------------------------------------------------------------------

FRAME = "OVER (PARTITION BY database_id ORDER BY time, event_id ROWS BETWEEN 359 PRECEDING AND CURRENT ROW)"
SCORED = "scored AS (" + " UNION ALL ".join(
    f"""SELECT event_id, database_id, time, '{m}' AS metric, CAST({m} AS DOUBLE) AS value, avg(CAST({m} AS DOUBLE)) {FRAME} AS mean,
  stddev_samp(CAST({m} AS DOUBLE)) {FRAME} AS dev, count(*) {FRAME} AS n FROM health_metrics""" for m in METRICS
) + """),
spikes AS (SELECT event_id, database_id, time, metric, value, abs(value - mean) / dev AS zscore FROM scored
  WHERE n >= 30 AND dev >= 0.001 AND abs(value - mean) / dev > 3)"""


@query(with_views("health_metrics", more=SCORED) + " SELECT event_id, database_id, time, metric, value, round(zscore, 9) AS zscore FROM spikes")
def zscore_spikes(spark, sf):
    return rounded(detectors.rolling_zscore(_health(spark, sf), tie="event_id"), "zscore")


@query(SKEWED + "," + SCORED + " SELECT event_id, database_id, time, metric, value, round(zscore, 6) AS zscore FROM spikes")
def skewed_zscore_spikes(spark, sf):
    """Rolling scores where one database and one time stamp hold most rows."""
    return rounded(detectors.rolling_zscore(skewed(spark, sf), tie="event_id"), "zscore", digits=6)


@query(with_views("health_metrics", more="framed AS (" + " UNION ALL ".join(
    f"""SELECT event_id, database_id, time, '{m}' AS metric, CAST({m} AS DOUBLE) AS value,
  list_sort(list(CAST({m} AS DOUBLE)) {FRAME}) AS s FROM health_metrics""" for m in METRICS) + """),
quart AS (SELECT *, s[len(s) // 4 + 1] AS q1, s[3 * len(s) // 4 + 1] AS q3 FROM framed WHERE len(s) >= 30)""") + """
SELECT event_id, database_id, time, metric, value, round((value - q3) / (q3 - q1), 9) AS iqr_score FROM quart
WHERE q3 - q1 >= 0.001 AND (value > q3 + 3 * (q3 - q1) OR value < q1 - 3 * (q3 - q1))""")
def iqr_outliers(spark, sf):
    return rounded(detectors.rolling_iqr(_health(spark, sf), tie="event_id"), "iqr_score")


POOL = """SELECT database_id, 'critical' AS severity, 'connection_pool_exhaustion' AS anomaly_type,
  'Connection pool near exhaustion' AS title, CAST(active_connections AS DOUBLE) / max_connections AS metric_value, time AS detected_at
FROM health_metrics WHERE max_connections > 0 AND CAST(active_connections AS DOUBLE) / max_connections > 0.9"""
LAG = """SELECT database_id, CASE WHEN replication_lag_seconds > 300 THEN 'critical' ELSE 'high' END AS severity,
  'replication_lag' AS anomaly_type, concat('Replication lag: ', printf('%.0f', replication_lag_seconds), 's') AS title,
  replication_lag_seconds AS metric_value, time AS detected_at FROM health_metrics WHERE replication_lag_seconds > 30"""
SPIKE = """SELECT database_id, 'high' AS severity, concat('statistical_spike_', metric) AS anomaly_type,
  concat('Unusual ', replace(metric, '_', ' '), ' spike') AS title, value AS metric_value, time AS detected_at FROM spikes"""
ALL_ALERTS = SCORED + f", alerts AS ({SPIKE} UNION ALL {POOL} UNION ALL {LAG})"
SHOWN = ["database_id", "severity", "anomaly_type", "title", "metric_value", "detected_at"]


@query(with_views("health_metrics") + " " + POOL)
def pool_exhaustion(spark, sf):
    return detectors.pool_exhaustion(_health(spark, sf)).select(*SHOWN)


@query(with_views("health_metrics") + " " + LAG)
def replication_lag_alerts(spark, sf):
    return detectors.replication_lag(_health(spark, sf)).select(*SHOWN)


def _alerts(spark, sf):
    return detectors.health_alerts(_health(spark, sf), tie="event_id")


@query(with_views("health_metrics", more=ALL_ALERTS) + " SELECT * FROM alerts")
def health_alerts(spark, sf):
    return _alerts(spark, sf).select(*SHOWN)


@query(with_views("health_metrics", more=SCORED) + """
SELECT event_id, concat('Unusual ', replace(metric, '_', ' '), ' spike') AS title,
  concat(metric, ' is ', printf('%.1f', value), ', z-score = ', printf('%.2f', round(zscore, 9)), ' (threshold: 3.0)') AS description FROM spikes
UNION ALL SELECT event_id, concat('Replication lag: ', printf('%.0f', replication_lag_seconds), 's'),
  concat('Replica is ', printf('%.0f', replication_lag_seconds), ' seconds behind primary') FROM health_metrics WHERE replication_lag_seconds > 30""")
def alert_texts(spark, sf):
    """Alert wording, digit for digit."""
    scored = rounded(detectors.rolling_zscore(_health(spark, sf), tie="event_id"), "zscore")
    spikes = detectors.zscore_alerts(scored, keep=("event_id",))
    lag = detectors.replication_lag(_health(spark, sf), keep=("event_id",))
    return spikes.unionByName(lag).select("event_id", "title", "description")


# --- routing and lists ----------------------------------------------------------------------------

# Severities of all kinds, spread over the events table.
SPREAD = """spread AS (SELECT event_id, concat('db-', CAST(user_id % 8 AS VARCHAR)) AS database_id,
  CASE event_id % 8 WHEN 0 THEN 'p1' WHEN 1 THEN 'critical' WHEN 2 THEN 'p2' WHEN 3 THEN 'high' WHEN 4 THEN 'medium'
    WHEN 5 THEN 'p3' WHEN 6 THEN 'low' ELSE 'other' END AS severity,
  CASE event_id % 5 WHEN 0 THEN 'sql_injection_stacked_query' WHEN 1 THEN 'privilege_escalation_attempt'
    WHEN 2 THEN 'sensitive_table_full_scan' WHEN 3 THEN 'replication_lag' ELSE 'connection_pool_exhaustion' END AS anomaly_type,
  value AS metric_value, ts AS detected_at FROM events)"""


def _spread(spark, sf):
    def names(by, listed, other):
        out = F.lit(other)
        for i, n in listed:
            out = F.when(by == i, n).otherwise(out)
        return out

    i = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("db-"), (F.col("user_id") % 8).cast("string")).alias("database_id"),
        names(i % 8, enumerate(["p1", "critical", "p2", "high", "medium", "p3", "low"]), "other").alias("severity"),
        names(i % 5, enumerate(["sql_injection_stacked_query", "privilege_escalation_attempt", "sensitive_table_full_scan",
                                "replication_lag"]), "connection_pool_exhaustion").alias("anomaly_type"),
        F.col("value").alias("metric_value"), F.col("ts").alias("detected_at"),
    )


ROUTE = """CASE WHEN severity IN ('p1', 'critical') THEN 'page' WHEN severity IN ('p2', 'high') THEN 'chat' ELSE 'digest' END"""


@query(f"""WITH {SPREAD} SELECT *, {ROUTE} AS route, CASE WHEN severity IN ('p1', 'critical') THEN '#FF0000'
  WHEN severity IN ('p2', 'high') THEN '#FFA500' WHEN severity = 'medium' THEN '#FFD700' WHEN severity IN ('p3', 'low') THEN '#36A64F'
  ELSE '#808080' END AS color FROM spread""")
def alert_routes(spark, sf):
    return alerts.route(_spread(spark, sf))


@query(f"WITH {SPREAD} SELECT severity, anomaly_type, count(*) AS n FROM spread GROUP BY 1, 2")
def alert_counts(spark, sf):
    return alerts.alert_counts(_spread(spark, sf))


@query(f"WITH {SPREAD} SELECT * FROM (SELECT * FROM spread ORDER BY detected_at DESC LIMIT 50) WHERE severity = 'high'")
def alert_page(spark, sf):
    """The newest 50 first, the severity filter second."""
    return alerts.alert_page(_spread(spark, sf), 50, "high")


@query(f"""WITH {SPREAD} SELECT * FROM (SELECT * FROM spread ORDER BY detected_at DESC LIMIT 200)
  WHERE NOT (anomaly_type LIKE 'rep%' OR anomaly_type LIKE 'conn%') ORDER BY detected_at DESC LIMIT 50""")
def security_alert_page(spark, sf):
    return alerts.security_page(_spread(spark, sf), 50)


@query(f"""WITH {SPREAD} SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY database_id ORDER BY detected_at DESC, event_id DESC) AS rn
  FROM spread) WHERE rn <= 200""")
def recent_alerts(spark, sf):
    return alerts.recent_per_database(_spread(spark, sf), 200, tie="event_id")


@query(f"WITH {SPREAD} SELECT date_trunc('hour', detected_at) AS hour, count(*) AS n FROM spread WHERE {ROUTE} = 'digest' GROUP BY 1")
def alert_digest(spark, sf):
    return alerts.digest(_spread(spark, sf))


@query("""WITH marks AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'created' WHEN 1 THEN 'approved' WHEN 2 THEN 'deployed'
  WHEN 3 THEN 'rolled_back' WHEN 4 THEN 'rejected' ELSE 'other' END AS event FROM events)
SELECT event_id, event, CASE event WHEN 'created' THEN '🔍' WHEN 'approved' THEN '✅' WHEN 'deployed' THEN '🚀'
  WHEN 'rolled_back' THEN '⏮️' WHEN 'rejected' THEN '❌' ELSE 'ℹ️' END AS mark FROM marks""")
def proposal_marks(spark, sf):
    names = F.array(*map(F.lit, ["created", "approved", "deployed", "rolled_back", "rejected", "other"]))
    event = F.get(names, (F.col("event_id") % 6).cast("int")).alias("event")
    return table(spark, sf, "events").select("event_id", event).withColumn("mark", alerts.proposal_mark(F.col("event")))


# --- rules ----------------------------------------------------------------------------------------

CONDITION = {"gt": ">", "lt": "<", "eq": "="}
JUDGED = "judged AS (" + " UNION ALL ".join(
    f"""SELECT event_id, database_id, time, {r['rule_id']} AS rule_id, '{r['severity']}' AS severity, {r['duration_seconds']} AS duration_seconds,
  CAST({r['metric']} AS DOUBLE) AS value, {r['metric']} {CONDITION[r['condition']]} {r['threshold']}::DOUBLE AS breach FROM health_metrics"""
    for r in RULES) + ")"


@query(with_views("health_metrics", more=JUDGED) + " SELECT * EXCLUDE breach FROM judged WHERE breach")
def rule_matches(spark, sf):
    return alerts.rule_matches(_health(spark, sf), RULES, tie="event_id")


RULE_TABLE = """rules AS (SELECT n_nationkey AS rule_id, CASE n_nationkey % 4 WHEN 0 THEN 'active_connections' WHEN 1 THEN 'cache_hit_ratio' WHEN 2 THEN 'replication_lag_seconds' ELSE 'no_such_metric' END AS metric,
  CASE n_nationkey % 3 WHEN 0 THEN 'gt' WHEN 1 THEN 'lt' ELSE 'eq' END AS condition, CAST(n_nationkey * 3 AS DOUBLE) AS threshold,
  CASE WHEN n_nationkey < 9 THEN 'high' ELSE 'low' END AS severity, n_nationkey % 5 <> 4 AS is_active FROM nation),
values_of AS (SELECT event_id, database_id, time, CAST(active_connections AS DOUBLE) AS active_connections, CAST(cache_hit_ratio AS DOUBLE) AS cache_hit_ratio,
  CAST(replication_lag_seconds AS DOUBLE) AS replication_lag_seconds FROM health_metrics),
longer AS (SELECT event_id, database_id, time, metric, value FROM values_of UNPIVOT (value FOR metric IN (active_connections, cache_hit_ratio, replication_lag_seconds))),
fired AS (SELECT rule_id, severity, database_id, time, event_id, value FROM longer JOIN rules USING (metric)
  WHERE is_active AND CASE condition WHEN 'gt' THEN value > threshold WHEN 'lt' THEN value < threshold ELSE value = threshold END)"""


def _rules(spark, sf):
    k = F.col("n_nationkey")
    names = F.array(*map(F.lit, ["active_connections", "cache_hit_ratio", "replication_lag_seconds", "no_such_metric"]))
    return table(spark, sf, "nation").select(
        k.alias("rule_id"), F.get(names, k % 4).alias("metric"), F.get(F.array(*map(F.lit, ["gt", "lt", "eq"])), k % 3).alias("condition"),
        (k * 3).cast("double").alias("threshold"), F.when(k < 9, "high").otherwise("low").alias("severity"), (k % 5 != 4).alias("is_active"),
    )


@query(with_views("health_metrics", more=RULE_TABLE) + " SELECT * FROM fired")
def rule_table_matches(spark, sf):
    """Rules that are rows of a table, whatever their number."""
    return alerts.rule_table_matches(_health(spark, sf), _rules(spark, sf), tie="event_id")


@query(with_views("health_metrics", more=RULE_TABLE) + """ SELECT rules.rule_id, metric, condition, threshold, rules.severity, is_active, count(fired.event_id) AS alerts, max(time) AS last_alert_at
FROM rules LEFT JOIN fired ON fired.rule_id = rules.rule_id GROUP BY ALL""")
def rule_alerts(spark, sf):
    rules = _rules(spark, sf)
    return alerts.rule_alerts(rules, alerts.rule_table_matches(_health(spark, sf), rules, tie="event_id"))


ISLANDS = JUDGED + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY rule_id, database_id ORDER BY time, event_id)
  - row_number() OVER (PARTITION BY rule_id, database_id, breach ORDER BY time, event_id) AS run,
  lead(time) OVER (PARTITION BY rule_id, database_id ORDER BY time, event_id) AS next_time FROM judged),
breached AS (SELECT rule_id, severity, duration_seconds, database_id, min(time) AS fired_at, max(time) AS last_breach_at,
  max(CASE WHEN next_time IS NULL THEN NULL ELSE next_time END) AS next_time, bool_or(next_time IS NULL) AS open, count(*) AS samples
  FROM numbered WHERE breach GROUP BY rule_id, severity, duration_seconds, database_id, run),
sustained AS (SELECT rule_id, severity, duration_seconds, database_id, fired_at, last_breach_at,
  CASE WHEN open THEN NULL ELSE next_time END AS resolved_at, samples FROM breached
  WHERE epoch_ms(date_trunc('second', last_breach_at)) - epoch_ms(date_trunc('second', fired_at)) >= duration_seconds * 1000)"""


@query(with_views("health_metrics", more=ISLANDS) + " SELECT * FROM sustained")
def sustained_breaches(spark, sf):
    return alerts.sustained_breaches(_health(spark, sf), RULES, tie="event_id")


@query(with_views("health_metrics", more=ISLANDS) + """, stamped AS (SELECT *, CASE WHEN samples % 3 = 0 THEN fired_at + INTERVAL 12 HOUR END AS silenced_until,
  CASE WHEN samples % 2 = 0 THEN 'dba' END AS acknowledged_by FROM sustained)
SELECT rule_id, database_id, fired_at, CASE WHEN resolved_at <= TIMESTAMP '2024-01-20 00:00:00' THEN 'resolved'
  WHEN silenced_until > TIMESTAMP '2024-01-20 00:00:00' THEN 'silenced' WHEN acknowledged_by IS NOT NULL THEN 'acknowledged' ELSE 'active' END AS status FROM stamped""")
def alert_lifecycle(spark, sf):
    runs = alerts.sustained_breaches(_health(spark, sf), RULES, tie="event_id")
    stamped = runs.withColumn(
        "silenced_until", F.when(F.col("samples") % 3 == 0, F.col("fired_at") + F.expr("INTERVAL 12 HOURS"))
    ).withColumn("acknowledged_by", F.when(F.col("samples") % 2 == 0, "dba"))
    return alerts.lifecycle(stamped, "2024-01-20 00:00:00").select("rule_id", "database_id", "fired_at", "status")


@query("""SELECT event_id, concat_ws('; ', CASE WHEN event_id % 7 = 0 THEN 'name is empty' END,
  CASE WHEN event_id % 4 = 3 THEN 'condition must be gt, lt or eq' END,
  CASE WHEN event_id % 5 = 0 THEN 'threshold is missing' END, CASE WHEN event_id % 9 = 0 THEN 'duration is negative' END) AS errors,
  length(props) >= 10 AS review_ok FROM events""")
def rule_validation(spark, sf):
    """Rule rows with what is wrong with each, and the review comment length rule."""
    i = F.col("event_id")
    rules = table(spark, sf, "events").select(
        "event_id", "props", F.when(i % 7 == 0, " ").otherwise("rule").alias("name"),
        F.get(F.array(*map(F.lit, ["gt", "lt", "eq", "ge"])), (i % 4).cast("int")).alias("condition"),
        F.when(i % 5 != 0, F.col("value")).alias("threshold"),
        F.when(i % 9 == 0, -1).otherwise(60).alias("duration_seconds"),
    )
    return alerts.valid_rules(rules).select(
        "event_id", F.array_join("errors", "; ").alias("errors"), alerts.valid_review(F.col("props")).alias("review_ok")
    )


@query("""WITH asked AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'metrics' WHEN 1 THEN 'capacity' WHEN 2 THEN 'alerts' WHEN 3 THEN 'queries' ELSE 'other' END AS kind,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id * 31) % 900 END AS hours, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id * 17) % 120 END AS days,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id * 13) % 250 END AS lim FROM events)
SELECT event_id, CASE WHEN kind = 'metrics' THEN coalesce(hours, 24) ELSE hours END AS hours, CASE WHEN kind = 'capacity' THEN coalesce(days, 28) ELSE days END AS lookahead_days,
  CASE kind WHEN 'alerts' THEN coalesce(lim, 50) WHEN 'queries' THEN coalesce(lim, 20) ELSE lim END AS "limit",
  CASE WHEN kind = 'other' THEN 'unknown kind' WHEN kind = 'metrics' AND NOT coalesce(hours, 24) BETWEEN 1 AND 720 THEN 'hours must be 1 to 720'
    WHEN kind = 'capacity' AND NOT coalesce(days, 28) BETWEEN 7 AND 90 THEN 'lookahead_days must be 7 to 90'
    WHEN kind = 'alerts' AND NOT coalesce(lim, 50) BETWEEN 1 AND 200 THEN 'limit must be 1 to 200'
    WHEN kind = 'queries' AND NOT coalesce(lim, 20) BETWEEN 1 AND 100 THEN 'limit must be 1 to 100' ELSE '' END AS errors FROM asked""")
def request_validation(spark, sf):
    """Requests with their defaults and what is out of range."""
    i = F.col("event_id")
    asked = table(spark, sf, "events").select(
        "event_id", F.get(F.array(*map(F.lit, ["metrics", "capacity", "alerts", "queries", "other"])), (i % 5).cast("int")).alias("kind"),
        *[F.when(i % 7 != 0, (i * k) % m).alias(c) for c, k, m in (("hours", 31, 900), ("lookahead_days", 17, 120), ("limit", 13, 250))],
    )
    out = alerts.valid_requests(asked)
    return out.select("event_id", "hours", "lookahead_days", "limit", F.array_join("errors", "; ").alias("errors"))


@query(with_views("databases", "health_metrics") + """ SELECT DISTINCT database_id FROM databases
WHERE database_id NOT IN (SELECT database_id FROM health_metrics WHERE replication_lag_seconds > 30)""")
def databases_without_alerts(spark, sf):
    names = view(spark, sf, "databases").select("database_id").distinct()
    return alerts.databases_without_alerts(names, detectors.replication_lag(_health(spark, sf)))


@query(with_views("health_metrics", "deployments", more="""means AS (SELECT d.proposal_id, d.database_id, d.deployed_at,
  avg(p99_latency_ms) FILTER (time < deployed_at) AS before_mean, avg(p99_latency_ms) FILTER (time >= deployed_at) AS after_mean
  FROM deployments d JOIN health_metrics h ON h.database_id = d.database_id AND h.time >= d.deployed_at - INTERVAL 24 HOUR
   AND h.time <= d.deployed_at + INTERVAL 24 HOUR GROUP BY 1, 2, 3)""") + """
SELECT proposal_id, database_id, deployed_at, round(before_mean, 9) AS before_mean, round(after_mean, 9) AS after_mean,
  coalesce(after_mean > before_mean * 1.1::DOUBLE, false) AS rollback_candidate FROM means""")
def post_deploy_regressions(spark, sf):
    out = detectors.post_deploy_regressions(_health(spark, sf), view(spark, sf, "deployments"))
    return rounded(out, "before_mean", "after_mean")
