"""Registered queries beside their DuckDB statements at the smallest scale.

A sample by default; FULL_ORACLE=1 runs every query.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fleetlens.operators import statements
from suite.statements import NORMED, PATTERN
from suite.views import TABLES, with_views
from tools.check_oracle import compare

SAMPLE = [
    "normalized_snapshots", "daily_rollup", "latency_percentiles", "unused_indexes", "database_registry", "zscore_spikes",
    "sustained_breaches", "post_deploy_regressions", "security_scan", "statement_lint", "query_snapshots", "query_batches",
    "json_recovery", "plan_summaries", "replay_comparison", "capacity_breaches", "proposal_states", "audit_checksums",
    "backup_reconciliation", "live_counter_rate", "live_query_snapshots",
]
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(ORACLE) if os.environ.get("FULL_ORACLE") else SAMPLE)
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    at = [names.index(c) for c in columns]
    found = compare(
        [tuple(r[c] for c in columns) for r in df.collect()], [tuple(r[i] for i in at) for r in cursor.fetchall()]
    )
    assert found is None or found[0].startswith("loose"), found


def test_contract(spark):
    queries = entry.queries()
    assert set(ORACLE) <= set(queries)
    df = entry.entry(spark)
    assert df.count() > 0 and "alerts" in df.columns


def test_every_statement_is_answered(spark, sf, duck):
    rows = {r.access_pattern: r for r in entry.queries()["statement_patterns"](spark, sf).collect()}
    ruled = dict(duck.execute(with_views("query_log", more=NORMED) + f" SELECT {PATTERN}, count(*) FROM normed WHERE coalesce(sql_text, '') <> '' GROUP BY 1").fetchall())
    unknown = ruled.pop("unknown", 0)
    assert unknown > 0 and {k: r.by_rule for k, r in rows.items() if r.by_rule} == ruled
    assert sum(r.by_model for r in rows.values()) == unknown and "unknown" not in rows
    assert all(r.statements == r.by_rule + r.by_model for r in rows.values())


def test_boosted_trees_answer_what_no_rule_covers(spark):
    said = [("SELECT a FROM t WHERE id = 1", "oltp_point"), ("DROP TABLE t", "ddl"), ("SELECT a, count(*) FROM t GROUP BY a", "olap_scan")]
    taught = spark.createDataFrame(said * 5, "sql_text string, access_pattern string")
    model = statements.fit_classifier(statements.labelled_features(taught, "sql_text", "access_pattern"), "boosted", trees=2, depth=2)
    asked = spark.createDataFrame([*[(s,) for s, _ in said], ("SELECT a FROM t",)], "sql_text string")
    got = {r.sql_text: r.access_pattern for r in statements.classify_unknown(asked, "sql_text", model).collect()}
    assert all(got[s] == p for s, p in said) and got["SELECT a FROM t"] in ("oltp_point", "ddl", "olap_scan")
