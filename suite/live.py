"""Streaming jobs and the metric store, run to the end of the landed data and read back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import constants as K
from fleetlens.operators import alerts, detectors
from fleetlens.session import input_bytes, scratch
from fleetlens.sources import landing, store
from fleetlens.streaming import jobs, ordered
from suite.alerting import LAG, POOL, ROUTE, SCORED, SPIKE, SPREAD, _spread
from suite.health import QPS, RAW, rounded
from suite.statements import ENRICHED, NAMES, SLOW, _slow, _snapshots, quoted
from suite.views import VIEWS, table, view, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Micro-batches at least, so that state is carried from one to the next.
FILES = 3


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn

    return add


def _landed(df, order: str, closing: bool = False):
    """A stream of the table, landed once in the order of `order`; each file is a micro-batch.

    `closing` lands one more event, two days after the last: the watermark passes all that came before, so every
    buffered row and open window comes out. Its id is -1 and no answer shows it.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "landed")
    landing.land(df, path, order, max(FILES, input_bytes(df) // landing.FILE_BYTES))
    if closing:
        last = df.orderBy(F.desc("ts")).limit(1)
        landing.land(last.withColumns({"ts": F.col("ts") + F.expr("INTERVAL 2 DAYS"), "event_id": F.lit(-1).cast("bigint")}), path, order, 1)
    return landing.stream_landed(spark, path, df.schema, files_per_trigger=1)


def _read(spark, path: str, schema):
    """What a stream wrote; without any batch, no rows."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _samples(stream):
    """Health samples over a stream of events."""
    stream.createOrReplaceTempView("events")
    return stream.sparkSession.sql(VIEWS["health_metrics"])


def _drain(df, order: str, job, mode: str = "append", closing: bool = False):
    """Run a table through a streaming job and read what it wrote."""
    spark = df.sparkSession
    out, state = scratch(spark, "stream-out"), scratch(spark, "stream-state")
    made = job(_landed(df, order, closing))
    jobs.append_batches(made, out, state, mode, once=True).awaitTermination()
    return _read(spark, out, T.StructType([*made.schema.fields, T.StructField("batch", T.IntegerType())]))


def _naive(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# --- streams --------------------------------------------------------------------------------------


MEANS = ["avg_connections", "avg_cache_hit_ratio", "avg_p99_latency_ms", "avg_replication_lag", "avg_qps"]
ROLLED = """ SELECT database_id, date_trunc('UNIT', time) AS UNIT, round(avg(active_connections), 9) AS avg_connections, round(avg(qps), 9) AS avg_qps,
  round(avg(cache_hit_ratio), 9) AS avg_cache_hit_ratio, round(avg(p99_latency_ms), 9) AS avg_p99_latency_ms, round(avg(replication_lag_seconds), 9) AS avg_replication_lag,
  max(p99_latency_ms) AS max_p99_latency_ms, CAST(sum(deadlocks) AS BIGINT) AS total_deadlocks, count(*) AS samples FROM rated GROUP BY 1, 2"""


@query(with_views("health_metrics", more=QPS) + ROLLED.replace("UNIT", "hour"))
def live_hourly_rollup(spark, sf):
    """Rates, then windows, in one stream: equal to the batch rollup."""
    out = _drain(table(spark, sf, "events"), "ts", lambda s: jobs.hourly_rollup(_samples(s)), closing=True)
    return _naive(rounded(out.drop("batch"), *MEANS), "hour")


@query(with_views("health_metrics", more=QPS) + ROLLED.replace("date_trunc('UNIT', time)", "CAST(date_trunc('day', time) AS TIMESTAMP)").replace("UNIT", "day"))
def live_daily_rollup(spark, sf):
    out = _drain(table(spark, sf, "events"), "ts", lambda s: jobs.daily_rollup(_samples(s)), closing=True)
    return _naive(rounded(out.drop("batch"), *MEANS), "day")


@query(with_views("health_metrics", more=QPS) + " SELECT event_id, database_id, time, qps FROM rated")
def live_counter_rate(spark, sf):
    out = _drain(table(spark, sf, "events"), "ts", lambda s: ordered.counter_rate(_samples(s)), closing=True)
    return _naive(out.select("event_id", "database_id", "time", "qps"), "time")


@query(with_views("health_metrics", more=QPS) + " SELECT event_id, database_id, time, qps FROM rated")
def live_late_samples(spark, sf):
    """Samples arrive up to nine minutes late and out of order, and count where they belong."""
    late = F.make_dt_interval(secs=F.pmod(F.xxhash64("event_id"), F.lit(540)).cast("decimal(18,6)"))
    shuffled = table(spark, sf, "events").withColumn("arrival", F.col("ts") + late)
    out = _drain(shuffled, "arrival", lambda s: ordered.counter_rate(_samples(s)), closing=True)
    return _naive(out.select("event_id", "database_id", "time", "qps"), "time")


@query(with_views("health_metrics", more=SCORED) + " SELECT event_id, database_id, time, metric, value, round(zscore, 6) AS zscore FROM spikes")
def live_zscore_spikes(spark, sf):
    out = _drain(table(spark, sf, "events"), "ts", lambda s: ordered.rolling_zscore(_samples(s)), closing=True)
    return _naive(rounded(out.drop("batch"), "zscore", digits=6), "time")


@query(with_views("health_metrics") + f", raised AS ({POOL} UNION ALL {LAG}) SELECT database_id, severity, anomaly_type, title, metric_value, detected_at, {ROUTE} AS route FROM raised")
def live_alert_routes(spark, sf):
    """Alerts of each micro-batch in one folder per route."""
    out, state = scratch(spark, "routes"), scratch(spark, "routes-state")
    raised = detectors.threshold_alerts(_samples(_landed(table(spark, sf, "events"), "ts")))
    jobs.route_alerts(raised, out, state, once=True).awaitTermination()
    found = _read(spark, out, alerts.route(raised).schema)
    return found.select("database_id", "severity", "anomaly_type", "title", "metric_value", "detected_at", "route")


def _polls(spark, sf):
    return _slow(spark, sf).withColumn("day", F.datediff("poll_time", F.lit("1970-01-01").cast("date")))


SECURITY = " UNION ALL ".join([
    *(f"SELECT database_id, 'critical' AS severity, 'sql_injection_{n}' AS anomaly_type, poll_date FROM slow WHERE regexp_matches(query, '{quoted(p)}', 'i')" for n, p in K.INJECTION_PATTERNS.items()),
    *(f"SELECT database_id, 'high' AS severity, 'privilege_escalation_attempt' AS anomaly_type, poll_date FROM slow WHERE regexp_matches(query, '{quoted(p)}', 'i')" for p in K.PRIVILEGE_PATTERNS),
    rf"""SELECT database_id, 'medium' AS severity, 'sensitive_table_full_scan' AS anomaly_type, poll_date
  FROM (SELECT *, unnest(regexp_extract_all(query, '\bFROM\s+(\w+)\b', 1, 'i')) AS t FROM slow)
  WHERE lower(t) IN ({NAMES}) AND regexp_matches(trim(query), '^SELECT\s+\*', 'i')"""])


@query(with_views("health_metrics", "statement_stats", more=f"{SCORED}, {SLOW.strip()}, raised AS (SELECT database_id, severity, anomaly_type, metric_value, detected_at FROM ({SPIKE} UNION ALL {POOL} UNION ALL {LAG}) UNION ALL SELECT database_id, severity, anomaly_type, NULL, CAST(poll_date AS TIMESTAMP) FROM ({SECURITY}))")
       + f" SELECT database_id, severity, anomaly_type, metric_value, detected_at, {ROUTE} AS route FROM raised")
def live_all_alerts(spark, sf):
    """Every kind of alert, routed: thresholds and spikes of the samples, security events of the statements."""
    out, state = scratch(spark, "routes"), scratch(spark, "routes-state")
    raised = jobs.sample_alerts(_samples(_landed(table(spark, sf, "events"), "ts", closing=True)))
    jobs.route_alerts(raised, f"{out}/samples", f"{state}/samples", once=True).awaitTermination()
    polls = _landed(_polls(spark, sf).withColumn("poll_time", F.col("poll_time").cast("timestamp")), "day")
    jobs.watch_statements(polls, f"{out}/snapshots", f"{out}/statements", f"{state}/statements", once=True).awaitTermination()
    routed = alerts.route(raised).schema
    shown = ["database_id", "severity", "anomaly_type", "metric_value", "detected_at", "route"]
    both = [_read(spark, f"{out}/{part}", routed).select(*shown) for part in ("samples", "statements")]
    # the closing event is two days behind the last
    last = table(spark, sf, "events").agg(F.max("ts").alias("last"))
    found = both[0].join(last, F.col("detected_at") <= F.col("last").cast("timestamp")).drop("last")
    return _naive(found.unionByName(both[1]), "detected_at")


@query(with_views("statement_stats", more=ENRICHED) + """ SELECT fingerprint, database_id, normalized_sql, sample_sql, access_pattern, call_count,
  round(mean_time_ms, 9) AS mean_time_ms, round(total_time_ms, 9) AS total_time_ms, CAST(poll_date AS VARCHAR) AS last_seen FROM merged""")
def live_query_snapshots(spark, sf):
    """The snapshot table after all micro-batches were merged equals one batch merge."""
    path, state = scratch(spark, "snapshots"), scratch(spark, "snapshots-state")
    jobs.watch_statements(_landed(_polls(spark, sf), "day"), path, f"{path}-alerts", state, once=True).awaitTermination()
    stored = store.read_snapshots(spark, path)
    if stored is None:  # no slow statement at all: the same columns, no rows
        stored = _snapshots(spark, sf).limit(0)
    out = stored.withColumn("last_seen", F.col("last_seen_at").cast("string"))
    return rounded(out.drop("first_rank", "last_rank", "queryid", "last_seen_at"), "mean_time_ms", "total_time_ms")


# --- ingest ---------------------------------------------------------------------------------------

# Every 17th line is cut off, and one database sends no time.
BROKEN = "event_id % 17 = 0"


def _lines(stream):
    """Events as JSON lines of raw samples, as `normalized_snapshots` has them; numbers of one engine are text."""
    stream.createOrReplaceTempView("events")
    return stream.sparkSession.sql(f"""
        WITH raw AS (SELECT event_id, CASE WHEN user_id % 8 = 3 THEN 'soon' ELSE date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") END AS time,
          concat('db-', CAST(user_id % 8 AS STRING)) AS database_id, CASE WHEN user_id % 8 < 5 THEN 'postgresql' ELSE 'mysql' END AS db_type,
          CAST(floor(value / 5) AS BIGINT) AS active_connections, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0 ELSE 200 END AS max_connections,
          CASE WHEN event_id % 7 <> 0 AND user_id % 8 < 5 THEN (event_id * 37) % 200000 END AS total_xacts,
          CASE WHEN event_type = 'error' THEN CAST(floor(value / 50) AS BIGINT) END AS lock_waits,
          CASE WHEN event_type = 'error' THEN value END AS replication_lag_seconds, event_id % 3 AS deadlocks FROM events)
        SELECT CASE WHEN {BROKEN} THEN substr(line, 1, 40) ELSE line END AS line FROM (
          SELECT event_id, to_json(struct(*)) AS line FROM raw)""")


def _ingested(spark, sf):
    events = table(spark, sf, "events")
    out, state = scratch(spark, "ingest"), scratch(spark, "ingest-state")
    for q in jobs.ingest(_lines(_landed(events, "ts", closing=True)), f"{out}/health", f"{out}/quarantine", state, once=True):
        q.awaitTermination()
    return out


@query("WITH " + RAW.strip() + f""", kept AS (SELECT * FROM raw WHERE NOT ({BROKEN}) AND user_id <> 3),
counted AS (SELECT *, last_value(CASE WHEN xacts IS NOT NULL THEN event_id END IGNORE NULLS) OVER w AS prev_id
  FROM kept WINDOW w AS (PARTITION BY database_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rated AS (SELECT c.*, CASE WHEN NOT c.is_pg OR c.xacts IS NULL OR p.xacts IS NULL OR epoch_us(c.ts) <= epoch_us(p.ts) THEN 0.0
   ELSE greatest(0.0, (c.xacts - p.xacts) / ((epoch_us(c.ts) - epoch_us(p.ts)) / 1e6)) END AS qps
  FROM counted c LEFT JOIN kept p ON p.event_id = c.prev_id)
SELECT database_id, ts AS time, CAST(active AS INTEGER) AS active_connections,
  CAST(CASE WHEN maximum IS NULL OR maximum = 0 THEN 100 ELSE maximum END AS INTEGER) AS max_connections, round(qps, 2) AS qps,
  CAST(CASE WHEN is_pg THEN coalesce(waits, 0) ELSE 0 END AS INTEGER) AS lock_waits, CAST(deadlocks AS INTEGER) AS deadlocks,
  CASE WHEN is_pg THEN coalesce(lag, 0.0) ELSE 0.0 END AS replication_lag_seconds
FROM rated""".replace("user_id <> 3", "database_id <> 'db-3'"))
def live_ingest(spark, sf):
    """Normalised, rated samples of all databases but the broken one, from lines some of which are cut off."""
    out = spark.read.parquet(f"{_ingested(spark, sf)}/health")
    return _naive(out.select("database_id", "time", "active_connections", "max_connections", "qps", "lock_waits", "deadlocks", "replication_lag_seconds"), "time")


@query(f"""SELECT CASE WHEN {BROKEN} THEN 'unreadable' ELSE 'no time' END AS fault, count(*) AS n FROM events
WHERE {BROKEN} OR user_id % 8 = 3 GROUP BY 1""")
def live_quarantine(spark, sf):
    """Lines that were no samples, by reason."""
    out = spark.read.parquet(f"{_ingested(spark, sf)}/quarantine")
    # the closing event may be of the broken database
    return out.where(~F.coalesce(F.col("line").contains('"event_id":-1,'), F.lit(False))).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SPREAD} SELECT date_trunc('hour', detected_at) AS hour, count(*) AS n FROM spread WHERE {ROUTE} = 'digest' GROUP BY 1")
def live_digest(spark, sf):
    updates = _drain(_spread(spark, sf), "event_id", jobs.hourly_digest, "update")
    return _naive(jobs.latest_of(updates, ("hour",)), "hour")


@query("SELECT event_id, user_id, ts AS time FROM events")
def live_deduplication(spark, sf):
    """Every sample lands twice and comes out once."""
    events = table(spark, sf, "events")
    twice = events.unionByName(events).select("event_id", "user_id", F.col("ts").alias("time"))
    twice = twice.withColumn("database_id", F.col("user_id"))
    out = _drain(twice, "event_id", jobs.deduplicated)
    return _naive(out.select("event_id", "user_id", "time"), "time")


# --- store ----------------------------------------------------------------------------------------

DATES = "SELECT CAST(CAST(time AS DATE) AS VARCHAR) AS date, count(*) AS n, CAST(sum(active_connections) AS BIGINT) AS connections FROM health_metrics"


def _stored(spark, sf):
    path = scratch(spark, "health")
    store.append(view(spark, sf, "health_metrics"), path)
    return path


def _by_date(spark, path):
    rows = spark.read.parquet(path)
    return rows.groupBy(F.col("date").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("active_connections").alias("connections"))


@query(with_views("health_metrics") + f" {DATES} GROUP BY 1")
def stored_health(spark, sf):
    """Append, then compact all dates older than two days: same rows, fewer files."""
    path = _stored(spark, sf)
    store.compact(spark, path, "2024-01-31")
    return _by_date(spark, path)


@query(with_views("health_metrics") + f" {DATES} WHERE time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1")
def retained_health(spark, sf):
    """Seven days remain after retention."""
    path = _stored(spark, sf)
    store.retain(spark, path, store.RETENTION_DAYS["health_metrics"], "2024-01-31")
    return _by_date(spark, path)
