"""Structured Streaming jobs: ingest, rollups, alerts with their routes, snapshot upserts, digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators import alerts as A
from fleetlens.operators import detectors as D
from fleetlens.operators import security
from fleetlens.operators import statements as S
from fleetlens.operators.snapshots import SNAPSHOT_COLUMNS, normalize_snapshots
from fleetlens.sources import store
from fleetlens.streaming import ordered

LATE = "10 minutes"
TICK = "10 seconds"


def start(df: DataFrame, checkpoint: str, mode: str = "append", once: bool = False, tick: str = TICK):
    """A writer with checkpoint and trigger; `once` drains what is there and stops."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=tick)


def event_time(df: DataFrame, time: str = "time") -> DataFrame:
    """Watermarks need TIMESTAMP, not TIMESTAMP_NTZ."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def deduplicated(df: DataFrame, keys: tuple[str, ...] = ("database_id", "time"), late: str = LATE) -> DataFrame:
    """Samples that arrive twice within the watermark count once."""
    return event_time(df).withWatermark("time", late).dropDuplicatesWithinWatermark(list(keys))


def rollup(df: DataFrame, window: str, late: str = LATE) -> DataFrame:
    """Streaming form of `rollups.hourly` and `rollups.daily`; sums and counts stay in state, one row per open
    window. Samples that carry `qps` also give its mean."""
    return _windows(event_time(df).withWatermark("time", late), window)


def rated_rollup(df: DataFrame, window: str, tie: str = "event_id", late: str = LATE) -> DataFrame:
    """Counter rates, then windows over them, in one query: samples leave the first state in the order of time, and the watermark
    that released them closes the windows."""
    return _windows(ordered.counter_rate(df, tie=tie, keep=ROLLED, late=late), window)


ROLLED = ("active_connections", "cache_hit_ratio", "p99_latency_ms", "replication_lag_seconds", "deadlocks")


def _windows(df: DataFrame, window: str) -> DataFrame:
    means = {
        "avg_connections": "active_connections", "avg_cache_hit_ratio": "cache_hit_ratio", "avg_p99_latency_ms": "p99_latency_ms",
        "avg_replication_lag": "replication_lag_seconds", **({"avg_qps": "qps"} if "qps" in df.columns else {}),
    }
    return (
        df.groupBy(F.window("time", window).alias("w"), "database_id")
        .agg(
            *[F.avg(c).alias(n) for n, c in means.items()],
            F.max("p99_latency_ms").alias("max_p99_latency_ms"),
            F.sum("deadlocks").alias("total_deadlocks"),
            F.count(F.lit(1)).alias("samples"),
        )
        .select(F.col("w.start").alias("start"), "database_id", *means, "max_p99_latency_ms", "total_deadlocks", "samples")
    )


def hourly_rollup(df: DataFrame, late: str = LATE) -> DataFrame:
    return rated_rollup(df, "1 hour", late=late).withColumnRenamed("start", "hour")


def daily_rollup(df: DataFrame, late: str = LATE) -> DataFrame:
    return rated_rollup(df, "1 day", late=late).withColumnRenamed("start", "day")


def append_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = False) -> StreamingQuery:
    """Write each micro-batch under `batch=`; a repeated batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return start(df, checkpoint, mode, once).foreachBatch(write).start()


def latest_of(batches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Newest version of each key among updates written batch by batch."""
    values = [c for c in batches.columns if c not in (*keys, "batch")]
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def snapshots(raw: DataFrame, tie: str = "event_id", late: str = LATE) -> DataFrame:
    """Raw samples of both engines (`db_type`) in the unified form, with `qps` from their counters, in the order of time."""
    keep = ["db_type", *[c for c in SNAPSHOT_COLUMNS if c in raw.columns and c not in ("database_id", "time", "qps")]]
    rated = ordered.counter_rate(raw, tie=tie, keep=keep, late=late)
    return normalize_snapshots(rated)


#: A raw sample as a line of JSON; numbers may be text, as one of the engines sends them.
SAMPLE = T.StructType([T.StructField(c, T.StringType()) for c in (
    "event_id", "time", "database_id", "db_type", "total_xacts", "active_connections", "max_connections", "cache_hit_ratio", "lock_waits", "deadlocks",
    "replication_lag_seconds")])
WHOLE = ("event_id", "total_xacts", "active_connections", "max_connections", "lock_waits", "deadlocks")
ENGINES = ("postgresql", "mysql")


def read_samples(lines: DataFrame, line: str = "line") -> DataFrame:
    """Raw samples from JSON lines, with `fault`: why a line is none, or null. No line stops the others."""
    read = lines.select(line, F.from_json(line, T.StructType([*SAMPLE.fields, T.StructField("_broken", T.StringType())]), {"columnNameOfCorruptRecord": "_broken"}).alias("s")).select(line, "s.*")
    typed = {c: F.col(c).try_cast("bigint" if c in WHOLE else "double") for c in SAMPLE.names if c in WHOLE or c in ("cache_hit_ratio", "replication_lag_seconds")}
    fault = (
        F.when(F.col("_broken").isNotNull() | F.col(line).isNull(), "unreadable")
        .when(F.coalesce("database_id", F.lit("")) == "", "no database")
        .when(F.col("time").try_cast("timestamp").isNull(), "no time")
        .when(~F.coalesce(F.col("db_type").isin(*ENGINES), F.lit(False)), "unknown engine")
    )
    return read.withColumn("fault", fault).withColumns(typed).withColumn("time", F.col("time").try_cast("timestamp")).drop("_broken")


def ingest(lines: DataFrame, path: str, quarantine: str, checkpoint: str, once: bool = False) -> list[StreamingQuery]:
    """Land samples: normalised and rated ones in `path`, lines that are no sample in `quarantine` with the reason.

    Broken lines never reach the keyed state, so a database that only sends rubbish, or half of its rows, holds up no other.
    """
    read = read_samples(lines)
    good = snapshots(read.where(F.col("fault").isNull()))
    bad = read.where(F.col("fault").isNotNull()).select("line", "database_id", "fault")
    return [append_batches(good, path, f"{checkpoint}/good", once=once), append_batches(bad, quarantine, f"{checkpoint}/bad", once=once)]


# --- sinks ----------------------------------------------------------------------------------------


def route_alerts(alerts: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Fan alerts out to one folder per delivery route."""
    def write(batch: DataFrame, number: int) -> None:
        A.route(batch).write.mode("overwrite").partitionBy("route").parquet(f"{path}/batch={number}")

    return start(alerts, checkpoint, "append", once).foreachBatch(write).start()


def sample_alerts(df: DataFrame, tie: str = "event_id", late: str = LATE) -> DataFrame:
    """All alerts of health samples: thresholds, and spikes against each database's own past."""
    spikes = D.zscore_alerts(ordered.rolling_zscore(df, tie=tie, late=late))
    return D.threshold_alerts(event_time(df)).unionByName(spikes)


def write_statements(batch: DataFrame, number: int, snapshots: str, alerts: str, stream: str) -> None:
    """One pass over a batch of slow statements for both of its sinks: the snapshot table and the routed security events.

    A batch that comes again leaves the snapshots alone and replaces its own alerts.
    """
    enriched = S.enrich(batch).persist()
    try:
        store.upsert_snapshots(S.snapshot_rows(enriched), snapshots, stream=stream, batch=number)
        events = A.route(security.scan_statements(enriched))
        events.write.mode("overwrite").partitionBy("route").parquet(f"{alerts}/batch={number}")
    finally:
        enriched.unpersist()


def watch_statements(stats: DataFrame, snapshots: str, alerts: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Slow statements into the snapshot table and, from the same pass, security events into the alert routes.

    The checkpoint folder names the stream: another one counts its batches from 0 again.
    """
    def write(batch: DataFrame, number: int) -> None:
        write_statements(batch, number, snapshots, alerts, checkpoint)

    return start(stats, checkpoint, "append", once).foreachBatch(write).start()


def hourly_digest(alerts: DataFrame, late: str = LATE, time: str = "detected_at") -> DataFrame:
    """Alerts per hour that wait for the digest."""
    routed = A.route(event_time(alerts, time)).where(F.col("route") == "digest")
    return routed.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("hour"), "n")
