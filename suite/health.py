"""Health samples, rollups, storage statistics, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import quantiles, rollups, snapshots, storage_stats, topn
from fleetlens.sources import registry
from suite.views import TABLES, table, view, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AS_OF = "2024-01-31 00:00:00"


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Averages end in noise digits; both engines drop them."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- samples --------------------------------------------------------------------------------------

RAW = """
raw AS (
  SELECT event_id, ts, concat('db-', CAST(user_id % 8 AS VARCHAR(8))) AS database_id, user_id % 8 < 5 AS is_pg,
    CAST(floor(value / 5) AS BIGINT) AS active,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0 ELSE 200 END AS maximum,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id * 37) % 200000 END AS xacts,
    CASE WHEN event_type = 'error' THEN CAST(floor(value / 50) AS BIGINT) ELSE NULL END AS waits,
    CASE WHEN event_type = 'error' THEN value ELSE NULL END AS lag, event_id % 3 AS deadlocks,
    round(CAST(event_id % 500 AS DECIMAL(10,0)) / nullif(CAST(event_id % 500 + event_id % 3 AS DECIMAL(10,0)), 0) * 100, 2) AS hits
  FROM events)"""


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    i = F.col("event_id")
    return e.select(
        "event_id", F.col("ts").alias("time"),
        F.concat(F.lit("db-"), (F.col("user_id") % 8).cast("string")).alias("database_id"),
        F.floor(F.col("value") / 5).cast("bigint").alias("active_connections"),
        F.when(i % 11 == 0, None).when(i % 13 == 0, 0).otherwise(200).alias("max_connections"),
        F.when(i % 7 == 0, None).otherwise((i * 37) % 200000).alias("total_xacts"),
        F.when(F.col("event_type") == "error", F.floor(F.col("value") / 50).cast("bigint")).alias("lock_waits"),
        F.when(F.col("event_type") == "error", F.col("value")).alias("replication_lag_seconds"),
        (i % 3).alias("deadlocks"),
        (i % 500).alias("_hit"), (i % 3).alias("_read"),
    )


@query(f"""WITH {RAW.strip()},
counted AS (SELECT *, last_value(CASE WHEN xacts IS NOT NULL THEN event_id END IGNORE NULLS) OVER w AS prev_id
  FROM raw WINDOW w AS (PARTITION BY database_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rated AS (SELECT c.*, CASE WHEN NOT c.is_pg OR c.xacts IS NULL OR p.xacts IS NULL OR epoch_us(c.ts) <= epoch_us(p.ts) THEN 0.0
   ELSE greatest(0.0, (c.xacts - p.xacts) / ((epoch_us(c.ts) - epoch_us(p.ts)) / 1e6)) END AS qps
  FROM counted c LEFT JOIN raw p ON p.event_id = c.prev_id)
SELECT database_id, ts AS time, CAST(active AS INTEGER) AS active_connections,
  CAST(CASE WHEN maximum IS NULL OR maximum = 0 THEN 100 ELSE maximum END AS INTEGER) AS max_connections,
  CAST(coalesce(hits, 0) AS DOUBLE) AS cache_hit_ratio, round(qps, 2) AS qps,
  CAST(0 AS DOUBLE) AS p50_latency_ms, CAST(0 AS DOUBLE) AS p95_latency_ms, CAST(0 AS DOUBLE) AS p99_latency_ms,
  CAST(CASE WHEN is_pg THEN coalesce(waits, 0) ELSE 0 END AS INTEGER) AS lock_waits, CAST(deadlocks AS INTEGER) AS deadlocks,
  CASE WHEN is_pg THEN coalesce(lag, 0.0) ELSE 0.0 END AS replication_lag_seconds
FROM rated""")
def normalized_snapshots(spark, sf):
    """Raw samples of both engines (text values on one side) in the unified snapshot form."""
    from fleetlens.functions.snapshot import ratio_pct

    raw = _raw(spark, sf).withColumn(
        "cache_hit_ratio", ratio_pct(F.col("_hit"), F.col("_hit") + F.col("_read"))
    ).drop("_hit", "_read")
    engine = F.substring("database_id", 4, 1).cast("int") < 5
    postgres = raw.where(engine)
    mysql = raw.where(~engine).select(
        "event_id", "time", "database_id",
        *[F.col(c).cast("string").alias(c) for c in ("active_connections", "max_connections", "cache_hit_ratio", "deadlocks")],
    )
    both = snapshots.union_samples(postgres, mysql)
    return snapshots.normalize_snapshots(snapshots.counter_rate(both, tie="event_id"))


QPS = """
steps AS (SELECT *, lag(time) OVER w AS pt, lag(total_xacts) OVER w AS pn FROM health_metrics
  WINDOW w AS (PARTITION BY database_id ORDER BY time, event_id)),
rated AS (SELECT * EXCLUDE (pt, pn), round(CASE WHEN pt IS NULL OR epoch_us(time) <= epoch_us(pt) THEN 0.0
  ELSE greatest(0.0, (total_xacts - pn) / ((epoch_us(time) - epoch_us(pt)) / 1e6)) END, 2) AS qps FROM steps)"""


def _rated(spark, sf):
    return snapshots.counter_rate(view(spark, sf, "health_metrics"), tie="event_id")


@query(with_views("health_metrics", more=QPS) + " SELECT event_id, database_id, time, qps FROM rated")
def counter_rate(spark, sf):
    return _rated(spark, sf).select("event_id", "database_id", "time", "qps")


@query("""SELECT concat('db-', CAST(user_id % 8 AS VARCHAR)) AS database_id,
  count(*) FILTER (event_type = 'click') AS active_connections,
  count(*) FILTER (event_type = 'error') AS lock_wait_sessions,
  count(*) FILTER (value <= 100) AS lock_waits, count(*) AS sessions FROM events GROUP BY 1""")
def session_counts(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("db-"), (F.col("user_id") % 8).cast("string")).alias("database_id"),
        F.when(F.col("event_type") == "click", "active").otherwise("idle").alias("state"),
        F.when(F.col("event_type") == "error", "Lock").alias("wait_event_type"),
        (F.col("value") > 100).alias("granted"),
    )
    return snapshots.sample_counts(rows)


@query(with_views("health_metrics") + """ SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER
  (PARTITION BY database_id ORDER BY time DESC, event_id DESC) AS rn FROM health_metrics) WHERE rn = 1""")
def latest_snapshot(spark, sf):
    return snapshots.latest_snapshot(view(spark, sf, "health_metrics"), tie="event_id")


@query(with_views("databases", "health_metrics") + """, latest AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY database_id ORDER BY time DESC, event_id DESC) AS rn FROM health_metrics) WHERE rn = 1)
SELECT d.database_id, d.url, l.time, l.active_connections, l.max_connections, l.cache_hit_ratio, l.lock_waits, l.deadlocks
FROM databases d LEFT JOIN latest l USING (database_id)""")
def fleet_overview(spark, sf):
    out = snapshots.fleet_overview(
        view(spark, sf, "databases"), view(spark, sf, "health_metrics"), tie="event_id"
    )
    return out.select("database_id", "url", "time", "active_connections", "max_connections", "cache_hit_ratio",
                      "lock_waits", "deadlocks")


@query(with_views("health_metrics") + """ SELECT event_id, database_id,
  CAST(active_connections AS DOUBLE) / max_connections * 100 AS connection_pct, max_connections * 0.85::DOUBLE AS connection_line,
  CASE WHEN active_connections > 85 THEN 'red' WHEN active_connections > 60 THEN 'yellow' ELSE 'green' END AS connection_band,
  CASE WHEN active_connections > 80 THEN 'up' ELSE 'neutral' END AS connection_trend,
  CASE WHEN p99_latency_ms > 1000 THEN 'red' ELSE 'white' END AS latency_band,
  CASE WHEN p99_latency_ms > 1000 THEN 'up' ELSE 'neutral' END AS latency_trend,
  CASE WHEN cache_hit_ratio < 90 THEN 'orange' ELSE 'green' END AS cache_band,
  CASE WHEN cache_hit_ratio < 90 THEN 'down' ELSE 'neutral' END AS cache_trend,
  CASE WHEN lock_waits > 5 THEN 'orange' ELSE 'white' END AS lock_band,
  CASE WHEN lock_waits > 0 THEN 'up' ELSE 'neutral' END AS lock_trend FROM health_metrics""")
def kpi_bands(spark, sf):
    out = snapshots.kpi_bands(view(spark, sf, "health_metrics"))
    names = [f"{k}_{s}" for k in ("connection", "latency", "cache", "lock") for s in ("band", "trend")]
    return out.select("event_id", "database_id", "connection_pct", "connection_line", *names)


@query(with_views("health_metrics") + """ SELECT * EXCLUDE rn FROM (SELECT event_id, database_id, time, active_connections,
  row_number() OVER (PARTITION BY database_id ORDER BY time DESC, event_id DESC) AS rn FROM health_metrics) WHERE rn <= 121""")
def recent_samples(spark, sf):
    from fleetlens.operators.alerts import recent_per_database

    rows = view(spark, sf, "health_metrics").select("event_id", "database_id", "time", "active_connections")
    return recent_per_database(rows, 121, time="time", tie="event_id")


# --- rollups --------------------------------------------------------------------------------------


@query(with_views("health_metrics") + """ SELECT database_id, time_bucket(INTERVAL 5 MINUTE, time) AS ts,
  round(coalesce(avg(active_connections), 0), 9) AS value FROM health_metrics
  WHERE time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 720 HOUR GROUP BY 1, 2""")
def metric_timeseries(spark, sf):
    out = rollups.bucketed(view(spark, sf, "health_metrics"), "active_connections", 300, AS_OF, hours=720)
    return rounded(out, "value")


@query(with_views("health_metrics") + """ SELECT database_id, time_bucket(INTERVAL 5 MINUTE, time) AS ts,
  round(coalesce(avg(active_connections), 0), 9) AS value FROM health_metrics
  WHERE time >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 24 HOUR AND time <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1, 2""")
def timeseries_as_of(spark, sf):
    """As of a moment inside the data, later samples stay out; an unknown metric means active connections."""
    return rounded(rollups.bucketed(view(spark, sf, "health_metrics"), "no_such_metric", 300, "2024-01-15 12:00:00"), "value")


@query(with_views("health_metrics") + """ SELECT database_id, time_bucket(INTERVAL 7 DAY, time) AS ts,
  round(avg(p99_latency_ms), 9) AS value FROM health_metrics GROUP BY 1, 2""")
def weekly_timeseries(spark, sf):
    """Seven-day buckets start on Mondays."""
    return rounded(rollups.bucketed(view(spark, sf, "health_metrics"), "p99_latency_ms", 7 * 86400), "value")


@query(with_views("health_metrics", more=QPS) + """ SELECT database_id, date_trunc('hour', time) AS hour,
  round(avg(active_connections), 9) AS avg_connections, round(avg(cache_hit_ratio), 9) AS avg_cache_hit_ratio,
  round(avg(qps), 9) AS avg_qps, round(avg(p99_latency_ms), 9) AS avg_p99_latency_ms, max(p99_latency_ms) AS max_p99_latency_ms,
  round(avg(replication_lag_seconds), 9) AS avg_replication_lag, CAST(sum(deadlocks) AS BIGINT) AS total_deadlocks
FROM rated GROUP BY 1, 2""")
def hourly_rollup(spark, sf):
    out = rollups.hourly(_rated(spark, sf))
    return rounded(out, "avg_connections", "avg_cache_hit_ratio", "avg_qps", "avg_p99_latency_ms", "avg_replication_lag")


@query(with_views("health_metrics", more=QPS) + """ SELECT database_id, date_trunc('day', time)::TIMESTAMP AS day,
  round(avg(active_connections), 9) AS avg_connections, round(avg(qps), 9) AS avg_qps,
  max(p99_latency_ms) AS max_p99_latency_ms, round(avg(cache_hit_ratio), 9) AS avg_cache_hit_ratio FROM rated GROUP BY 1, 2""")
def daily_rollup(spark, sf):
    return rounded(rollups.daily(_rated(spark, sf)), "avg_connections", "avg_qps", "avg_cache_hit_ratio")


# One database with 80 % of the samples, one time stamp with 20 % of them.
SKEWED = with_views("health_metrics").replace("health_metrics AS (", "plain AS (") + """, health_metrics AS (SELECT * REPLACE (
  CASE WHEN event_id % 5 < 4 THEN 'hot' ELSE database_id END AS database_id, CASE WHEN event_id % 5 = 1 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE time END AS time) FROM plain)"""


def skewed(spark, sf):
    i = F.col("event_id")
    return view(spark, sf, "health_metrics").withColumns({
        "database_id": F.when(i % 5 < 4, "hot").otherwise(F.col("database_id")),
        "time": F.when(i % 5 == 1, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).otherwise(F.col("time"))})


@query(SKEWED + "," + QPS + " SELECT event_id, database_id, time, qps FROM rated")
def skewed_counter_rate(spark, sf):
    """The same rates where one database and one time stamp hold most rows."""
    rated = snapshots.counter_rate(skewed(spark, sf), tie="event_id")
    return rated.select("event_id", "database_id", "time", "qps")


@query(with_views("health_metrics", more="""deltas AS (SELECT database_id, time, greatest(0, deadlocks - lag(deadlocks) OVER
  (PARTITION BY database_id ORDER BY time, event_id)) AS d FROM health_metrics)""") + """
SELECT database_id, date_trunc('hour', time) AS hour, CAST(coalesce(sum(d), 0) AS BIGINT) AS deadlock_delta FROM deltas GROUP BY 1, 2""")
def deadlock_growth(spark, sf):
    """New deadlocks per hour from the cumulative counter."""
    from fleetlens.functions.common import bucket_start
    from fleetlens.operators import scan

    df = view(spark, sf, "health_metrics")
    seen = scan.previous(df, ["database_id"], ["time", "event_id"], F.col("deadlocks"), "prev")
    grown = F.greatest(F.lit(0), F.col("deadlocks") - F.col("prev"))
    return seen.withColumn("d", F.when(F.col("prev").isNotNull(), grown)).groupBy(
        "database_id", bucket_start(F.col("time"), 3600).alias("hour")
    ).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("deadlock_delta"))


@query(with_views("health_metrics", more=QPS) + """, minutes AS (SELECT database_id, date_trunc('minute', time) AS ds,
  coalesce(avg(active_connections), 0) AS active_connections, avg(p99_latency_ms) AS p99_latency_ms, avg(qps) AS qps,
  avg(cache_hit_ratio) AS cache_hit_ratio FROM rated GROUP BY 1, 2)
SELECT database_id, ds, metric, round(y, 9) AS y FROM minutes UNPIVOT (y FOR metric IN (active_connections, p99_latency_ms, qps, cache_hit_ratio))""")
def minute_series(spark, sf):
    from fleetlens.constants import FORECAST_DEFAULT

    return rounded(rollups.minute_series(_rated(spark, sf), FORECAST_DEFAULT, AS_OF), "y")


@query(with_views("query_log") + """ SELECT database_id, date_trunc('quarter', ts)::TIMESTAMP AS bucket, count(*) AS n,
  round(quantile_cont(exec_ms, 0.50), 9) AS p50, round(quantile_cont(exec_ms, 0.95), 9) AS p95, round(quantile_cont(exec_ms, 0.99), 9) AS p99
FROM query_log GROUP BY 1, 2""")
def latency_percentiles(spark, sf):
    log = view(spark, sf, "query_log").withColumn("bucket", F.date_trunc("quarter", "ts"))
    out = quantiles.inclusive_percentiles(log, ["database_id", "bucket"], "exec_ms")
    return rounded(out, "p50", "p95", "p99").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def workload_status_counts(spark, sf):
    return rollups.status_counts(table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"))


@query("""SELECT 'pending' AS workload, count(*) AS n FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'big', count(*) FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'
UNION ALL SELECT 'joined', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'""")
def workload_counts(spark, sf):
    """The demo workload: filtered counts and a filtered join count."""
    orders = table(spark, sf, "orders")
    one = orders.agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("pending"),
        F.count_if((F.col("o_totalprice") > 250000) & (F.col("o_orderstatus") == "F")).alias("big"),
    ).unpivot([], ["pending", "big"], "workload", "n")
    facts = orders.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    joined = rollups.matched_count(facts, table(spark, sf, "customer"), "c_custkey")
    return one.unionByName(joined.select(F.lit("joined").alias("workload"), "n"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def table_row_counts(spark, sf):
    return rollups.table_row_counts({t: table(spark, sf, t) for t in TABLES})


# --- storage statistics ---------------------------------------------------------------------------


def _pretty(c: str) -> str:
    return f"""CASE WHEN {c} < 10240 THEN concat({c}, ' bytes')
  WHEN ({c} >> 9) < 20479 THEN concat(((({c} >> 9) + 1) >> 1), ' kB')
  WHEN ({c} >> 19) < 20479 THEN concat(((({c} >> 19) + 1) >> 1), ' MB')
  WHEN ({c} >> 29) < 20479 THEN concat(((({c} >> 29) + 1) >> 1), ' GB')
  ELSE concat(((({c} >> 39) + 1) >> 1), ' TB') END"""


@query(with_views("table_stats", more="""ranked AS (SELECT *, row_number() OVER (PARTITION BY database_id
  ORDER BY dead_tuples DESC, table_name) AS rn FROM table_stats WHERE dead_tuples > 1000)""") + f"""
SELECT database_id, table_name, {_pretty('total_bytes')} AS total_size, total_bytes, dead_tuples, live_tuples,
  CAST(round(CAST(dead_tuples AS DECIMAL(18,0)) * 100 / (live_tuples + dead_tuples), 2) AS DOUBLE) AS dead_ratio_pct
FROM ranked WHERE rn <= 20""")
def table_bloat(spark, sf):
    return storage_stats.table_bloat(view(spark, sf, "table_stats"))


LEAST = """ranked AS (SELECT *, row_number() OVER (PARTITION BY database_id ORDER BY index_scans ASC NULLS LAST, index_name) AS rn
  FROM index_stats)"""


@query(with_views("index_stats", more=LEAST) + f""" SELECT database_id, table_name, index_name, index_scans,
  {_pretty('index_bytes')} AS index_size, index_bytes FROM ranked WHERE rn <= 50""")
def index_usage(spark, sf):
    return storage_stats.index_usage(view(spark, sf, "index_stats"))


@query(with_views("index_stats", more=LEAST) + """ SELECT database_id, count(*) AS unused_count,
  array_to_string(list_slice(list(index_name ORDER BY index_scans, index_name), 1, 5), ', ') AS first_names
FROM ranked WHERE rn <= 50 AND index_scans < 10 AND index_bytes > 10485760 GROUP BY 1""")
def unused_indexes(spark, sf):
    return storage_stats.unused_indexes(view(spark, sf, "index_stats"))


@query("""SELECT CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat('public.t', CAST(p_partkey AS VARCHAR)) END AS table_name,
  concat('db-', CAST(p_size % 8 AS VARCHAR)) AS database_id, p_partkey * 100000 AS total_bytes,
  CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey * 7 % 5000 END AS dead_tuples, CAST(p_size AS BIGINT) AS live_tuples,
  CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_retailprice END AS dead_ratio_pct FROM part""")
def stored_table_stats(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        F.lit(AS_OF).cast("timestamp_ntz").alias("time"),
        F.concat(F.lit("db-"), (F.col("p_size") % 8).cast("string")).alias("database_id"),
        F.when(k % 17 != 0, F.concat(F.lit("public.t"), k.cast("string"))).alias("full_table_name"),
        (k * 100000).alias("total_bytes"), F.when(k % 5 != 0, k * 7 % 5000).alias("n_dead_tup"),
        F.col("p_size").alias("n_live_tup"), F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice")).alias("dead_ratio_pct"),
    )
    return storage_stats.table_stat_rows(rows).drop("time")


@query("""SELECT concat('db-', CAST(p_size % 8 AS VARCHAR)) AS database_id, '' AS table_name,
  concat('idx_', CAST(p_partkey AS VARCHAR)) AS index_name, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 40 END AS index_scans,
  p_partkey * 50000 AS index_bytes FROM part""")
def stored_index_stats(spark, sf):
    k = F.col("p_partkey")
    rows = view(spark, sf, "index_stats").select(
        F.lit(AS_OF).cast("timestamp_ntz").alias("time"), "database_id", F.lit(None).cast("string").alias("table_name"),
        "index_name", F.when(F.substring("index_name", 5, 20).cast("bigint") % 5 != 0, F.col("index_scans")).alias("index_scans"),
        "index_bytes",
    )
    return storage_stats.index_stat_rows(rows).drop("time")


# --- registry -------------------------------------------------------------------------------------


@query("""WITH entries AS (SELECT s_suppkey AS source_id, unnest([
    concat(CASE WHEN s_suppkey % 2 = 0 THEN 'postgresql' ELSE 'mysql' END, '://u:p@Host', CAST(s_suppkey AS VARCHAR),
      CASE WHEN s_suppkey % 3 = 0 THEN ':6000' ELSE '' END, '/app'),
    CASE WHEN s_suppkey % 5 = 0 THEN 'postgres://h:bad/x' ELSE 'postgres:///only' END]) AS url FROM supplier),
parts AS (SELECT source_id, CASE WHEN starts_with(url, 'postgres') THEN 'postgresql' ELSE 'mysql' END AS db_type,
  coalesce(nullif(lower(regexp_extract(bare, '^([^:/]*)', 1)), ''), 'localhost') AS host,
  regexp_extract(bare, '^[^:/]*:([^/]*)', 1) AS p, regexp_extract(bare, '^[^/]*/+(.*)$', 1) AS database_name,
  regexp_extract(url, '^[a-z]+://([^:@/]*):[^@/]*@', 1) AS username
  FROM (SELECT *, regexp_replace(url, '^[a-z]+://([^@/]*@)?', '') AS bare FROM entries)),
ported AS (SELECT * EXCLUDE p, CAST(CASE WHEN p <> '' THEN TRY_CAST(p AS INTEGER) WHEN db_type = 'postgresql' THEN 5432 ELSE 3306 END AS INTEGER) AS port
  FROM parts WHERE p = '' OR TRY_CAST(p AS INTEGER) IS NOT NULL)
SELECT source_id, substr(sha256(concat(db_type, ':', host, ':', port, ':', database_name)), 1, 16) AS id,
  CASE WHEN database_name <> '' THEN database_name ELSE host END AS name, db_type, host, port, database_name, username FROM ported""")
def database_registry(spark, sf):
    k = F.col("s_suppkey")
    lists = table(spark, sf, "supplier").select(
        k.alias("source_id"),
        F.concat(
            F.when(k % 2 == 0, "postgresql").otherwise("mysql"), F.lit("://u:p@Host"), k.cast("string"),
            F.when(k % 3 == 0, ":6000").otherwise(""), F.lit("/app , ,"),
            F.when(k % 5 == 0, "postgres://h:bad/x").otherwise("postgres:///only"),
        ).alias("urls"),
    )
    out = registry.parse_urls(registry.explode_urls(lists, "urls"))
    return out.select("source_id", "id", "name", "db_type", "host", "port", "database_name", "username")


CATALOG = """cols AS (SELECT p_brand AS catalog, concat('t', lpad(CAST(p_partkey // 10 AS VARCHAR), 12, '0')) AS table_name,
  p_partkey % 10 AS ordinal, concat('c', CAST(p_partkey AS VARCHAR)) AS column_name, lower(p_type) AS data_type FROM part)"""


@query(f"""WITH {CATALOG}, kept AS (SELECT catalog, table_name FROM (SELECT *, row_number() OVER (PARTITION BY catalog ORDER BY table_name) AS rn
  FROM (SELECT DISTINCT catalog, table_name FROM cols)) WHERE rn <= 40)
SELECT catalog, table_name, concat(table_name, '(', string_agg(concat(column_name, ' ', data_type), ', ' ORDER BY ordinal), ')') AS line
FROM cols JOIN kept USING (catalog, table_name) GROUP BY 1, 2""")
def schema_summary(spark, sf):
    """Column catalogue rows (here: ten parts make a table) as one line per table."""
    k = F.col("p_partkey")
    cols = table(spark, sf, "part").select(
        F.col("p_brand").alias("catalog"),
        F.concat(F.lit("t"), F.lpad(F.floor(k / 10).cast("string"), 12, "0")).alias("table_name"),
        (k % 10).alias("ordinal_position"), F.concat(F.lit("c"), k.cast("string")).alias("column_name"),
        F.lower("p_type").alias("data_type"),
    )
    return registry.schema_summary(cols, keys=("catalog",))
