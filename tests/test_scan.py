"""Scans over pieces give what whole keys give, for any number of pieces."""

from collections import deque

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens import constants as K
from fleetlens.operators import detectors, scan, snapshots, workflow
from suite.views import RULES, view

PIECES = [1, 17]


@pytest.fixture(scope="module")
def samples(spark, sf):
    """One database holds 80 % of the rows, one time stamp 20 %; counters have gaps, a few rows have no database."""
    df = view(spark, sf, "health_metrics")
    i = F.col("event_id")
    return df.withColumn("database_id", F.when(i % 5 < 4, "hot").when(i % 50 == 4, None).otherwise(F.col("database_id"))).withColumn(
        "time", F.when(i % 5 == 1, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).otherwise(F.col("time"))).withColumn(
        "total_xacts", F.when(i % 11 != 0, F.col("total_xacts"))
    )


def rows(df, digits=9):
    def tidy(v):
        return (v is not None, round(v, digits) if isinstance(v, float) else v)

    return sorted((tuple(tidy(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_hot_keys_and_times_span_pieces(samples):
    laid = scan.lay_out(samples, ["database_id"], ["time", "event_id"], 17)
    sizes = [r["count"] for r in laid.groupBy("_piece").count().collect()]
    assert len(sizes) > 12 and max(sizes) < 3 * sum(sizes) / len(sizes)
    assert laid.where("database_id = 'hot'").select("_piece").distinct().count() > 10


@pytest.mark.parametrize("pieces", PIECES)
def test_ordinal(samples, pieces):
    order = [F.asc("time"), F.asc("event_id")]
    got = scan.ordinal(samples, ["database_id"], order, pieces).select("event_id", "_pos")
    assert rows(got) == rows(samples.select("event_id", F.row_number().over(Window.partitionBy("database_id").orderBy(*order)).alias("_pos")))


@pytest.mark.parametrize("pieces", PIECES)
def test_running_totals(samples, pieces):
    got = scan.running(samples, ["database_id"], ["time", F.desc("event_id")], {"s": ("sum", "deadlocks"), "x": ("bit_xor", "event_id")}, pieces)
    w = Window.partitionBy("database_id").orderBy("time", F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    want = samples.select("event_id", F.coalesce(F.sum("deadlocks").over(w), F.lit(0)).alias("s"), F.bit_xor("event_id").over(w).alias("x"))
    assert rows(got.select(*want.columns)) == rows(want)


@pytest.mark.parametrize("pieces", PIECES)
def test_counter_rate_equals_a_loop(samples, pieces):
    got = {r.event_id: r.qps for r in snapshots.counter_rate(samples, tie="event_id", pieces=pieces).collect()}
    last = {}
    for r in samples.orderBy("time", "event_id").collect():
        want = 0.0
        if r.total_xacts is not None:
            if r.database_id in last:
                t, n = last[r.database_id]
                seconds = (r.time - t).total_seconds()
                want = max(0.0, (r.total_xacts - n) / seconds) if seconds > 0 else 0.0
            last[r.database_id] = (r.time, r.total_xacts)
        assert abs(got[r.event_id] - want) <= 0.0051


@pytest.mark.parametrize("pieces", [1, 17, 150])
def test_rolling_moments_equal_plain_frames(samples, pieces):
    w = Window.partitionBy("database_id").orderBy("time", "event_id").rowsBetween(-49, 0)
    value = F.col("p50_latency_ms")
    want = samples.select(
        "event_id", F.avg(value).over(w).alias("mean_p50_latency_ms"), F.stddev_samp(value).over(w).alias("dev_p50_latency_ms"),
        F.count(F.lit(1)).over(w).alias("_seen"),
    )
    got = scan.rolling_moments(samples, ["database_id"], ["time", "event_id"], 50, ["p50_latency_ms"], pieces)
    assert rows(got.select(*want.columns), 7) == rows(want, 7)


@pytest.mark.parametrize("pieces", [1, 17, 150])
def test_iqr_outliers_equal_a_sorted_deque(samples, pieces):
    metrics = ["active_connections", "lock_waits"]
    samples = samples.withColumn("lock_waits", F.when(F.col("event_id") % 7 != 0, F.col("lock_waits")))
    got = detectors.rolling_iqr(samples, metrics, frame=100, width=0.5, tie="event_id", pieces=pieces)
    want, recent = [], {}
    for r in samples.orderBy("time", "event_id").collect():
        for m in metrics:
            frame = recent.setdefault((r.database_id, m), deque(maxlen=100))
            v = None if r[m] is None else float(r[m])
            frame.append(v)
            ranked = sorted(x for x in frame if x is not None)
            n = len(ranked)
            if n >= 30 and v is not None:
                q1, q3 = ranked[n // 4], ranked[3 * n // 4]
                if q3 - q1 >= 0.001 and (v > q3 + 0.5 * (q3 - q1) or v < q1 - 0.5 * (q3 - q1)):
                    want.append((r.event_id, m, round((v - q3) / (q3 - q1), 9)))
    assert want and sorted((r.event_id, r.metric, round(r.iqr_score, 9)) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("pieces", PIECES)
def test_sustained_breaches(samples, pieces):
    from fleetlens.operators.alerts import sustained_breaches

    one, many = (sustained_breaches(samples, RULES, tie="event_id", pieces=n) for n in (3, pieces))
    assert one.count() and rows(one) == rows(many)


@pytest.mark.parametrize("pieces", PIECES)
def test_workflow_fold(spark, sf, pieces):
    events = view(spark, sf, "proposal_events").withColumn(
        "proposal_id", F.when(F.col("proposal_id") % 3 == 0, 0).when(F.col("proposal_id") % 50 == 1, None).otherwise(F.col("proposal_id"))
    )
    order = ["seq", "l_partkey", "l_extendedprice"]
    judged = workflow.judged_events(events, order=order, pieces=pieces).collect()
    assert len(judged) == events.count()
    state = {}
    for r in sorted(judged, key=lambda r: (r.proposal_id is not None, r.proposal_id or 0, r.seq, r.l_partkey, r.l_extendedprice, r.trigger_name)):
        before = state.get(r.proposal_id, "proposed")
        target = K.TRANSITIONS.get((before, r.trigger_name))
        assert (r.from_state, r.to_state, r.legal) == (before, target or before, target is not None)
        state[r.proposal_id] = target or before


def test_a_million_events_of_one_proposal(spark):
    """Every event walks or is illegal; the last piece starts where a plain loop ends."""
    triggers = sorted({t for _, t in K.TRANSITIONS})
    names = ", ".join(f"'{t}'" for t in triggers)
    events = spark.range(1_000_000).select(F.lit(7).alias("proposal_id"), F.col("id").alias("seq"), F.expr(f"element_at(array({names}), CAST(abs(hash(id)) % {len(triggers)} AS INT) + 1)").alias("trigger_name"))
    judged = workflow.judged_events(events, pieces=12)
    state, moves = "proposed", []
    for r in events.orderBy("seq").limit(1000).collect():
        target = K.TRANSITIONS.get((state, r.trigger_name))
        if target:
            moves.append((r.seq, state, target))
            state = target
    assert state in K.CLOSED_STATES
    assert sorted(map(tuple, judged.where("legal").select("seq", "from_state", "to_state").collect())) == moves
    assert judged.where("seq >= 1000").select("from_state").distinct().collect()[0][0] == state
