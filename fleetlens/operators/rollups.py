"""Time-bucketed aggregates. All are algebraic, so map tasks shrink a hot database first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.constants import FORECASTABLE
from fleetlens.functions.common import bucket_start


def metric_name(name: str) -> str:
    """A metric from the allow-list; anything else means active_connections."""
    return name if name in FORECASTABLE else "active_connections"


def since(df: DataFrame, as_of: str, **interval: int) -> DataFrame:
    """Rows from the interval that ends at `as_of`; prunes `date` partitions where there are any."""
    [(unit, n)] = interval.items()
    end = F.expr(f"TIMESTAMP_NTZ '{as_of}'")
    start = F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {int(n)} {unit}")
    df = df.where(F.col("time").between(start, end))
    return df.where(F.col("date").between(start.cast("date"), end.cast("date"))) if "date" in df.columns else df


def bucketed(
    df: DataFrame, metric: str, bucket_seconds: int = 300, as_of: str | None = None, hours: int = 24
) -> DataFrame:
    """Mean of one metric per database and bucket; a NULL mean reads 0, empty buckets are absent."""
    if as_of is not None:
        df = since(df, as_of, hours=hours)
    return df.groupBy("database_id", bucket_start(F.col("time"), bucket_seconds).alias("ts")).agg(
        F.coalesce(F.avg(metric_name(metric)), F.lit(0.0)).alias("value")
    )


def hourly(df: DataFrame) -> DataFrame:
    return df.groupBy("database_id", bucket_start(F.col("time"), 3600).alias("hour")).agg(
        F.avg("active_connections").alias("avg_connections"),
        F.avg("cache_hit_ratio").alias("avg_cache_hit_ratio"),
        F.avg("qps").alias("avg_qps"),
        F.avg("p99_latency_ms").alias("avg_p99_latency_ms"),
        F.max("p99_latency_ms").alias("max_p99_latency_ms"),
        F.avg("replication_lag_seconds").alias("avg_replication_lag"),
        F.sum("deadlocks").alias("total_deadlocks"),
    )


def daily(df: DataFrame) -> DataFrame:
    return df.groupBy("database_id", bucket_start(F.col("time"), 86400).alias("day")).agg(
        F.avg("active_connections").alias("avg_connections"),
        F.avg("qps").alias("avg_qps"),
        F.max("p99_latency_ms").alias("max_p99_latency_ms"),
        F.avg("cache_hit_ratio").alias("avg_cache_hit_ratio"),
    )


def minute_series(
    df: DataFrame, metrics: Sequence[str], as_of: str | None = None, days: int = 90
) -> DataFrame:
    """Per-minute means of several metrics in one shuffle, in long form (database_id, metric, ds, y)."""
    metrics = list(dict.fromkeys(metric_name(m) for m in metrics))
    if as_of is not None:
        df = since(df, as_of, days=days)
    wide = df.groupBy("database_id", F.date_trunc("minute", F.col("time")).alias("ds")).agg(
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics]
    )
    return wide.unpivot(["database_id", "ds"], metrics, "metric", "y")


def status_counts(orders: DataFrame, status: str = "status") -> DataFrame:
    return orders.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def matched_count(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows of `facts` with a partner in `dimension`, counted per key before the join."""
    per_key = facts.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.join(dimension.select(key), key).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, all tables in one job. Each scan reads no columns."""
    counts = [
        t.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, t in tables.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def workload_summary(snapshots: DataFrame) -> DataFrame:
    """Calls, time and share of time per database and access pattern."""
    from pyspark.sql import Window

    per_pattern = snapshots.groupBy("database_id", "access_pattern").agg(
        F.sum("call_count").alias("calls"),
        F.sum("total_time_ms").alias("total_time_ms"),
        F.count(F.lit(1)).alias("statements"),
    )
    # At most five patterns per database reach this window.
    whole = F.sum("total_time_ms").over(Window.partitionBy("database_id"))
    return per_pattern.withColumn(
        "time_share", F.coalesce(F.try_divide(F.col("total_time_ms"), whole), F.lit(0.0))
    )
