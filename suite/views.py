"""Telemetry-shaped views over the given tables, as SQL both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Declared schemas of the given tables: reading them needs no inference job.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, "
        "p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
        "o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, "
        "event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}
TABLES = list(SCHEMAS)

VIEWS = {
    "health_metrics": """
SELECT event_id, ts AS time, concat('db-', CAST(user_id % 8 AS VARCHAR(8))) AS database_id,
  CAST(floor(value / 5) AS INT) AS active_connections, 100 AS max_connections,
  100.0 - value / 10 AS cache_hit_ratio, (event_id * 37) % 200000 AS total_xacts,
  value AS p50_latency_ms, value * 5 AS p95_latency_ms, value * 10 AS p99_latency_ms,
  CASE WHEN event_type = 'error' THEN value ELSE 0.0 END AS replication_lag_seconds,
  CAST(CASE WHEN event_type = 'error' THEN floor(value / 50) ELSE 0 END AS INT) AS lock_waits,
  CAST(floor(event_id / 1000) AS INT) AS deadlocks
FROM events""",
    "query_log": """
SELECT o_orderkey AS log_id, concat('db-', CAST(o_custkey % 8 AS VARCHAR(8))) AS database_id, o_orderdate AS ts,
  o_totalprice / 1000 AS exec_ms, o_custkey % 500 AS row_count,
  CASE o_orderkey % 10
   WHEN 0 THEN concat('SELECT count(*) FROM orders WHERE status = ''', o_orderstatus, '''')
   WHEN 1 THEN concat('select *  from users where id=', CAST(o_custkey AS VARCHAR(20)), ' -- point lookup')
   WHEN 2 THEN 'SELECT status, count(*) FROM orders GROUP BY status ORDER BY status'
   WHEN 3 THEN concat('SELECT SUM(total) FROM orders o JOIN users u ON o.uid=u.id JOIN items i ON i.oid=o.id WHERE o.total > ', CAST(o_totalprice AS VARCHAR(30)))
   WHEN 4 THEN concat('SELECT * FROM accounts WHERE 1=1; DROP TABLE t', CAST(o_orderkey AS VARCHAR(20)))
   WHEN 5 THEN 'SELECT name FROM parts WHERE id=7 UNION ALL SELECT NULL'
   WHEN 6 THEN 'GRANT ALL ON orders TO app'
   WHEN 7 THEN concat('SELECT a FROM t WHERE name LIKE ''%x'' AND id IN (', CAST(o_custkey AS VARCHAR(20)), ', 2, 3) ORDER BY a')
   WHEN 8 THEN concat('/* job */ INSERT INTO t (a, b) VALUES (', CAST(o_orderkey AS VARCHAR(20)), ', ''x'')')
   ELSE 'CREATE INDEX i ON orders (status)' END AS sql_text
FROM orders""",
    "proposal_events": """
SELECT l_orderkey AS proposal_id, l_linenumber AS seq, l_shipdate AS ts, l_partkey, l_extendedprice,
  CASE l_partkey % 6 WHEN 0 THEN 'review' WHEN 1 THEN 'review' WHEN 2 THEN 'approve' WHEN 3 THEN 'start_test'
    WHEN 4 THEN 'deploy_and_monitor' ELSE 'reject' END AS trigger_name
FROM lineitem""",
    "replay_latencies": """
SELECT l_suppkey AS session_id, CASE WHEN l_linestatus = 'F' THEN 'before' ELSE 'after' END AS phase,
  l_extendedprice / 1000 AS latency_ms FROM lineitem""",
    "plan_docs": """
SELECT o_orderkey AS plan_id, concat('{"Plan":{"Node Type":"Hash Join","Total Cost":', CAST(o_custkey AS VARCHAR(20)),
  ',"Plan Rows":10,"Actual Rows":', CAST(o_custkey AS VARCHAR(20)),
  ',"Actual Loops":1,"Plans":[{"Node Type":"Seq Scan","Relation Name":"orders","Total Cost":', CAST(o_custkey % 700 AS VARCHAR(20)),
  ',"Plan Rows":20,"Actual Rows":', CAST(o_custkey * 2 AS VARCHAR(20)),
  ',"Filter":"(status = ''x''::text)","Rows Removed by Filter":', CAST(o_orderkey % 400 AS VARCHAR(20)),
  '},{"Node Type":"Hash","Total Cost":5,"Plans":[{"Node Type":"Index Scan","Relation Name":"users","Total Cost":4,"Actual Rows":1,"Plan Rows":1}]}]},"Planning Time":0.5,"Execution Time":',
  CAST(o_totalprice AS VARCHAR(30)), '}') AS plan_json FROM orders""",
    "databases": """
SELECT concat('db-', CAST(s_suppkey % 10 AS VARCHAR(8))) AS database_id, s_suppkey,
  concat(CASE WHEN s_suppkey % 3 = 0 THEN 'mysql' ELSE 'postgresql' END, '://u:p@host', CAST(s_suppkey AS VARCHAR(8)),
    CASE WHEN s_suppkey % 2 = 0 THEN ':6000' ELSE '' END, '/app') AS url
FROM supplier""",
    "statement_stats": """
SELECT database_id, CAST(date_trunc('quarter', ts) AS DATE) AS poll_date, log_id % 10 AS queryid,
  min(sql_text) AS query, count(*) AS calls, sum(exec_ms) AS total_exec_time, sum(row_count) AS row_count
FROM query_log GROUP BY database_id, CAST(date_trunc('quarter', ts) AS DATE), log_id % 10""",
    "table_stats": """
SELECT concat('db-', CAST(p_size % 8 AS VARCHAR(8))) AS database_id, concat('public.t', CAST(p_partkey AS VARCHAR(20))) AS table_name,
  p_partkey * 100000 AS total_bytes, p_partkey * 7 % 5000 AS dead_tuples, CAST(floor(p_retailprice) AS BIGINT) * 10 AS live_tuples
FROM part""",
    "index_stats": """
SELECT concat('db-', CAST(p_size % 8 AS VARCHAR(8))) AS database_id, concat('public.t', CAST(p_partkey AS VARCHAR(20))) AS table_name,
  concat('idx_', CAST(p_partkey AS VARCHAR(20))) AS index_name, p_partkey % 40 AS index_scans, p_partkey * 50000 AS index_bytes
FROM part""",
    "deployments": """
SELECT event_id AS proposal_id, concat('db-', CAST(user_id % 8 AS VARCHAR(8))) AS database_id, ts AS deployed_at
FROM events WHERE event_type = 'purchase'""",
}

NEEDS = {
    "health_metrics": ["events"], "query_log": ["orders"], "proposal_events": ["lineitem"],
    "replay_latencies": ["lineitem"], "plan_docs": ["orders"], "databases": ["supplier"],
    "statement_stats": ["query_log"], "table_stats": ["part"], "index_stats": ["part"],
    "deployments": ["events"],
}

RULES = [
    {"rule_id": 1, "name": "conn high", "metric": "active_connections", "condition": "gt", "threshold": 30.0, "duration_seconds": 600, "severity": "p1"},
    {"rule_id": 2, "name": "cache low", "metric": "cache_hit_ratio", "condition": "lt", "threshold": 85.0, "duration_seconds": 600, "severity": "p2"},
    {"rule_id": 3, "name": "lag", "metric": "replication_lag_seconds", "condition": "gt", "threshold": 30.0, "duration_seconds": 0, "severity": "p2"},
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table or derived view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf, name)
    for need in NEEDS[name]:
        view(spark, sf, need).createOrReplaceTempView(need)
    return spark.sql(VIEWS[name])


def with_views(*names: str, more: str = "") -> str:
    """WITH clause that defines the views (and what they need) for the oracle."""
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in TABLES or n in seen:
            return
        for need in NEEDS[n]:
            visit(need)
        seen.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in seen]
    return "WITH " + ",\n".join(parts + ([more.strip()] if more else []))
