"""Streams: repeated batches, late and broken rows."""

import json
import pickle
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import detectors, snapshots
from fleetlens.session import scratch
from fleetlens.sources import landing, store
from fleetlens.streaming import jobs, ordered
from suite.views import view


def test_a_repeated_batch_changes_nothing(spark):
    rows = [("db-1", i, f"SELECT * FROM accounts WHERE 1=1 OR id = {i}; DROP TABLE t", 10 + i, 900.0 * i, "2024-01-01 00:00:00") for i in range(1, 6)]
    polls = spark.createDataFrame(rows, "database_id string, queryid bigint, query string, calls bigint, total_exec_time double, t string")
    polls = polls.withColumn("poll_time", F.col("t").cast("timestamp")).withColumn("mean_time_ms", F.col("total_exec_time") / F.col("calls")).drop("t")
    path = scratch(spark, "repeat")

    def state():
        kept = store.read_snapshots(spark, f"{path}/snapshots").collect()
        return sorted(map(str, kept)), sorted(map(str, spark.read.parquet(f"{path}/alerts").collect()))

    jobs.write_statements(polls, 0, f"{path}/snapshots", f"{path}/alerts", "s")
    first = state()
    jobs.write_statements(polls, 0, f"{path}/snapshots", f"{path}/alerts", "s")
    assert state() == first and len(first[1]) >= 5
    jobs.write_statements(polls.limit(0), 1, f"{path}/snapshots", f"{path}/alerts", "s")
    assert state() == first


def test_faults_of_lines(spark):
    good = {"event_id": 1, "time": "2024-01-01T00:00:00Z", "database_id": "a", "db_type": "mysql", "active_connections": "7", "deadlocks": "x"}
    lines = [json.dumps(good), json.dumps(good)[:30], None, "", "[]", json.dumps(good | {"database_id": ""}), json.dumps(good | {"time": "soon"}), json.dumps(good | {"db_type": None}),
             json.dumps({k: v for k, v in good.items() if k != "time"})]
    got = jobs.read_samples(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    faults = {r.line: r.fault for r in got}
    assert faults[lines[0]] is None and faults[lines[1]] == faults[None] == "unreadable"
    assert faults[lines[5]] == "no database" and faults[lines[6]] == faults[lines[8]] == "no time" and faults[lines[7]] == "unknown engine"
    assert all(f is not None for line, f in faults.items() if line != lines[0])
    ok = next(r for r in got if r.line == lines[0])
    assert ok.active_connections == 7 and ok.deadlocks is None


@pytest.fixture(scope="module")
def arrived(spark, sf):
    """Health samples in an order up to nine minutes off, some twice at one time, some without a counter, and a last one that closes."""
    rng = random.Random(3)
    df = view(spark, sf, "health_metrics").where("event_id < 600").withColumn(
        "total_xacts", F.when(F.col("event_id") % 9 != 0, F.col("total_xacts"))).withColumn(
        "time", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(event_id div 2 * 20 as decimal(18, 6)))"))
    rows = df.collect()
    late = {r.event_id: rng.random() * 540 for r in rows}
    delay = spark.createDataFrame([(i, s) for i, s in late.items()], "event_id bigint, delay double")
    spoiled = df.join(delay, "event_id").withColumn("arrival", F.unix_micros(F.col("time").cast("timestamp")) / 1e6 + F.col("delay")).drop("delay")
    path = scratch(spark, "late")
    landing.land(spoiled, path, "arrival", 5)
    last = spoiled.limit(1).withColumns({"time": F.lit("2024-02-01").cast("timestamp_ntz"), "event_id": F.lit(-1).cast("bigint"), "arrival": F.lit(1e12)})
    landing.land(last, path, "arrival", 1)
    return df, landing.stream_landed(spark, path, spoiled.schema, files_per_trigger=1)


def drained(spark, made):
    out, state = scratch(spark, "out"), scratch(spark, "state")
    jobs.append_batches(made, out, state, once=True).awaitTermination()
    return spark.read.parquet(out).where("event_id >= 0")


def test_late_rates_equal_sorted_ones(spark, arrived):
    df, stream = arrived
    got = {r.event_id: r.qps for r in drained(spark, ordered.counter_rate(stream)).collect()}
    assert got == {r.event_id: r.qps for r in snapshots.counter_rate(df, tie="event_id").collect()}


def test_late_scores_equal_sorted_ones(spark, arrived):
    df, stream = arrived
    got = drained(spark, ordered.rolling_zscore(stream, frame=40, min_rows=10, threshold=1.5)).collect()
    want = detectors.rolling_zscore(df, frame=40, min_rows=10, threshold=1.5, tie="event_id").collect()
    assert want and sorted((r.event_id, r.metric, round(r.zscore, 6)) for r in got) == sorted((r.event_id, r.metric, round(r.zscore, 6)) for r in want)


def test_thresholds_in_one_pass(spark, sf):
    df = view(spark, sf, "health_metrics").withColumn("active_connections", F.when(F.col("event_id") % 5 == 0, 95).otherwise(F.col("active_connections")))
    two = detectors.pool_exhaustion(df).unionByName(detectors.replication_lag(df))
    assert sorted(map(str, detectors.threshold_alerts(df).collect())) == sorted(map(str, two.collect()))


def test_waiting_rows_are_opened_by_the_block():
    rows = [(i // 3 * 10, i, str(i)) for i in range(1000)]
    blocks = [(part[0][0], part[-1][0], pickle.dumps(part)) for part in (rows[i:i + 50] for i in range(0, 1000, 50))]
    rest = []
    merged = ordered._merged(blocks, 3000, rest)
    assert next(merged) == rows[0] and sum(b is None for b in blocks) <= 2
    got = [rows[0], *merged]
    assert got == [r for r in rows if r[0] <= 3000] and rest == [r for r in rows if r[0] > 3000] and rest
    rng = random.Random(1)
    mixed = rng.sample(rows, len(rows))
    parts = [sorted(mixed[i:i + 50]) for i in range(0, 1000, 50)]
    shuffled = sorted(((p[0][0], p[-1][0], pickle.dumps(p)) for p in parts), key=lambda b: b[0])
    rest = []
    assert list(ordered._merged(shuffled, 2000, rest)) + sorted(rest) == rows
