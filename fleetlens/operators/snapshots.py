"""Health samples: unified form, counter rate, latest state, utilisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import snapshot as S
from fleetlens.functions.common import or_default
from fleetlens.operators import scan

SNAPSHOT_COLUMNS = [
    "database_id", "time", "active_connections", "max_connections", "cache_hit_ratio", "qps",
    "p50_latency_ms", "p95_latency_ms", "p99_latency_ms", "lock_waits", "deadlocks",
    "replication_lag_seconds",
]


def union_samples(postgres: DataFrame, mysql: DataFrame) -> DataFrame:
    """Both engines' raw samples in one table. MySQL values arrive as text."""
    numbers = {f.name: f.dataType for f in postgres.schema.fields}
    typed = [
        F.col(c).try_cast(numbers[c]).alias(c) if c in numbers else F.col(c) for c in mysql.columns
    ]
    return postgres.withColumn("db_type", F.lit("postgresql")).unionByName(
        mysql.select(*typed).withColumn("db_type", F.lit("mysql")), allowMissingColumns=True
    )


def counter_rate(
    df: DataFrame, counter: str = "total_xacts", out: str = "qps", tie: str | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Per-second growth of a cumulative counter against the previous non-null sample.

    The first sample, a reset, a NULL counter and a non-advancing clock all give 0.
    """
    order = ["time", tie] if tie else ["time"]
    seen = F.when(
        F.col(counter).isNotNull(),
        F.struct(F.unix_micros(F.col("time").cast("timestamp")).alias("t"), F.col(counter).alias("n")),
    )
    df = scan.previous(df, ["database_id"], order, seen, "_prev", pieces)
    seconds = (F.unix_micros(F.col("time").cast("timestamp")) - F.col("_prev.t")) / 1e6
    rate = (F.col(counter) - F.col("_prev.n")) / seconds
    value = F.when(F.col(counter).isNotNull() & (seconds > 0), F.greatest(F.lit(0.0), rate))
    return df.withColumn(out, F.round(F.coalesce(value, F.lit(0.0)), 2)).drop("_prev")


def normalize_snapshots(raw: DataFrame) -> DataFrame:
    """Unified 12-column snapshot. Expects `qps` from `counter_rate` and the engine in `db_type`."""
    have = set(raw.columns)

    def number(name: str, kind: str, default=0):
        if name not in have:
            return F.lit(default).cast(kind).alias(name)
        return or_default(F.col(name).cast(kind), default).cast(kind).alias(name)

    postgres = F.col("db_type") == "postgresql"
    waits = F.when(postgres, number("lock_waits", "int")).otherwise(0).alias("lock_waits")
    lag = F.when(postgres, number("replication_lag_seconds", "double")).otherwise(0.0)
    return raw.select(
        "database_id", "time",
        number("active_connections", "int"),
        number("max_connections", "int", 100),
        number("cache_hit_ratio", "double"),
        number("qps", "double"),
        number("p50_latency_ms", "double"),
        number("p95_latency_ms", "double"),
        number("p99_latency_ms", "double"),
        waits,
        number("deadlocks", "int"),
        lag.alias("replication_lag_seconds"),
    )


def sample_counts(sessions: DataFrame) -> DataFrame:
    """Active sessions and lock waits per database in one pass over session rows."""
    return sessions.groupBy("database_id").agg(
        F.count_if(F.col("state") == "active").alias("active_connections"),
        F.count_if(F.col("wait_event_type") == "Lock").alias("lock_wait_sessions"),
        F.count_if(~F.col("granted")).alias("lock_waits"),
        F.count(F.lit(1)).alias("sessions"),
    )


def latest_snapshot(df: DataFrame, tie: str | None = None) -> DataFrame:
    """Newest row per database. `max_by` keeps one row per map task, whatever the key's size."""
    order = F.struct("time", tie) if tie else F.col("time")
    return (
        df.groupBy("database_id")
        .agg(F.max_by(F.struct(*[c for c in df.columns if c != "database_id"]), order).alias("s"))
        .select("database_id", "s.*")
    )


def fleet_overview(registry: DataFrame, samples: DataFrame, tie: str | None = None) -> DataFrame:
    """Every registered database with its newest sample; databases without samples stay."""
    return registry.join(latest_snapshot(samples, tie), "database_id", "left")


def kpi_bands(df: DataFrame) -> DataFrame:
    """Dashboard bands and trends of each snapshot."""
    pct = S.utilisation_pct(F.col("active_connections"), F.col("max_connections"))
    return df.select(
        "*",
        pct.alias("connection_pct"),
        (F.col("max_connections") * 0.85).alias("connection_line"),
    ).select(
        "*",
        S.connection_band(F.col("connection_pct")).alias("connection_band"),
        S.connection_trend(F.col("connection_pct")).alias("connection_trend"),
        S.latency_band(F.col("p99_latency_ms")).alias("latency_band"),
        S.latency_trend(F.col("p99_latency_ms")).alias("latency_trend"),
        S.cache_band(F.col("cache_hit_ratio")).alias("cache_band"),
        S.cache_trend(F.col("cache_hit_ratio")).alias("cache_trend"),
        S.lock_band(F.col("lock_waits")).alias("lock_band"),
        S.lock_trend(F.col("lock_waits")).alias("lock_trend"),
    )
