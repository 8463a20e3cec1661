"""All registered queries and their oracle statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import detectors, rollups, snapshots
from suite import alerting, analysis, health, live, statements
from suite.views import view

MODULES = [health, alerting, statements, analysis, live]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    samples = view(spark, sf, "health_metrics")
    days = rollups.daily(snapshots.counter_rate(samples, tie="event_id"))
    events = detectors.health_alerts(samples, tie="event_id")
    counts = events.groupBy("database_id", F.date_trunc("day", "detected_at").alias("day")).agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("severity") == "critical").alias("critical_alerts")
    )
    return days.join(counts, ["database_id", "day"], "left").fillna(0, ["alerts", "critical_alerts"])
