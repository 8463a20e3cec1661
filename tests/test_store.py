"""Store: append, retention, compaction, versioned upsert; plans; reconciliation."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fleetlens.operators import reconcile, statements
from fleetlens.plans import corpus
from fleetlens.session import scratch
from fleetlens.sources import adhoc, store
from suite.views import table, view


def test_append_retain_compact(spark, sf):
    path = scratch(spark, "health")
    samples = view(spark, sf, "health_metrics")
    store.append(samples.where("event_id % 2 = 0"), path)
    store.append(samples.where("event_id % 2 = 1"), path)
    before = spark.read.parquet(path).count()
    assert before == samples.count()
    assert store.compact(spark, path, "2024-01-31") > 20
    assert spark.read.parquet(path).count() == before
    assert store.compact(spark, path, "2024-01-31") == 0  # nothing left to rewrite
    gone = store.retain(spark, path, 7, "2024-01-31")
    assert "2024-01-23" in gone and "2024-01-24" not in gone
    assert spark.read.parquet(path).agg(F.min("date").cast("string")).first()[0] == "2024-01-24"


def snapshot(fp, text, calls, day):
    return (fp, "db", text, text, calls, 1.0, 1.0, "unknown", day, "1")


def test_upsert_keeps_first_text_and_last_numbers(spark):
    names = "fingerprint string, database_id string, normalized_sql string, sample_sql string, call_count bigint, " \
            "mean_time_ms double, total_time_ms double, access_pattern string, last_seen_at string, queryid string"
    path = scratch(spark, "upsert")
    store.upsert_snapshots(spark.createDataFrame([snapshot("a", "first", 1, "2024-01-01"), snapshot("b", "only", 9, "2024-01-01")], names), path)
    store.upsert_snapshots(spark.createDataFrame([snapshot("a", "second", 7, "2024-01-02")], names), path)
    got = {r.fingerprint: (r.sample_sql, r.call_count) for r in store.read_snapshots(spark, path).collect()}
    assert got == {"a": ("first", 7), "b": ("only", 9)}
    assert store.versions(spark, path) == [0, 1]


def test_upsert_batches_of_streams(spark):
    names = "fingerprint string, database_id string, normalized_sql string, sample_sql string, call_count bigint, " \
            "mean_time_ms double, total_time_ms double, access_pattern string, last_seen_at string, queryid string"
    path = scratch(spark, "upsert")

    def put(calls, stream, batch):
        row = snapshot("a", "text", calls, f"2024-01-{calls:02d}")
        store.upsert_snapshots(spark.createDataFrame([row], names), path, stream, batch)
        return store.read_snapshots(spark, path).first().call_count

    assert put(1, "s", 0) == 1 and put(2, "s", 1) == 2
    assert put(9, "s", 1) == 2  # a repeated batch changes nothing
    assert put(3, "t", 0) == 3 and put(4, "t", 1) == 4  # a new stream counts from 0 again
    for i in range(2, 2 + store.FOLD_AFTER):
        assert put(5 + i, "t", i) == 5 + i
    assert put(28, "s", 1) == 5 + i  # also known after deltas were folded
    layers, note = store._layers(spark, path)
    assert len(layers) < store.FOLD_AFTER and note["streams"] == {"s": 1, "t": 1 + store.FOLD_AFTER}


def test_adhoc_gate(spark):
    spark.range(500).createOrReplaceTempView("numbers")
    assert adhoc.run_readonly(spark, "select id from numbers where id >= :low;", {"low": 10}).count() == 100
    with pytest.raises(ValueError):
        adhoc.run_readonly(spark, "drop table numbers")
    with pytest.raises(ValueError):
        adhoc.run_readonly(spark, "select `reflect`('java.lang.System', 'getProperty', 'user.home')")
    path = scratch(spark, "files")
    spark.range(3).write.parquet(path)
    with pytest.raises(AnalysisException):
        adhoc.run_readonly(spark, f"select * from parquet.`{path}`")


def test_plans_of_any_depth(spark):
    node = {"Node Type": "Leaf", "Total Cost": 1}
    for i in range(12):
        node = {"Node Type": f"N{i}", "Total Cost": i, "Plans": [node, {"Node Type": "Side", "Total Cost": 0.5}]}
    docs = [(1, json.dumps({"Plan": node})), (2, json.dumps([{"Plan": node}])), (3, "{broken"), (4, "{}"), (5, '"Plan":{}}')]
    parsed = corpus.parse_plans(spark.createDataFrame(docs, "plan_id int, plan_json string"))
    nodes = corpus.flatten_plans(parsed)
    count = {r.plan_id: r["count"] for r in nodes.groupBy("plan_id").count().collect()}
    assert count == {1: 25, 2: 25, 4: 1}
    assert nodes.where("plan_id = 1").agg(F.max("depth")).first()[0] == 12
    assert {r.plan_id for r in parsed.where("parse_error").collect()} == {3, 5}
    assert nodes.where("plan_id = 4").first().node_type == "Unknown"


def test_reconcile_finds_any_one_cell(spark, sf):
    live = {"customer": table(spark, sf, "customer")}
    same = reconcile.reconcile(live, live).first()
    assert same.counts_match and same.content_match
    for edited in (
        live["customer"].withColumn("c_acctbal", F.when(F.col("c_custkey") == 7, None).otherwise(F.col("c_acctbal"))),
        live["customer"].withColumn("c_name", F.when(F.col("c_custkey") == 7, "x").otherwise(F.col("c_name"))),
    ):
        row = reconcile.reconcile(live, {"customer": edited}).first()
        assert row.counts_match and not row.content_match
        assert reconcile.differing_buckets(live["customer"], edited, "c_custkey").count() == 1


def test_validate_rewrite(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    ok, reason = reconcile.validate_rewrite(spark, "select o_orderkey from orders", "select distinct o_orderkey from orders")
    assert ok and reason == "Result sets identical"
    ok, reason = reconcile.validate_rewrite(spark, "select 1 as a", "select 2 as a")
    assert not ok and reason == "Result sets differ: 2 rows different"
    ok, reason = reconcile.validate_rewrite(spark, "select 1", "select nothing from nowhere")
    assert not ok and reason.startswith("Validation error")


def test_classifier_learns_the_rules(spark, sf):
    log = view(spark, sf, "query_log").select("sql_text")
    labelled = statements.enrich(log, "sql_text").select("sql_text", "access_pattern")
    training = statements.labelled_features(labelled, "sql_text", "access_pattern")
    model = statements.fit_classifier(training, trees=10)
    scored = model.transform(training)
    right = scored.agg(F.sum(F.when(F.col("prediction") == F.col("label"), F.col("weight")).otherwise(0)) / F.sum("weight")).first()[0]
    assert right > 0.95
