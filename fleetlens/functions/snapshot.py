"""Health sample columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_pct(part: Column, whole: Column) -> Column:
    """part / whole * 100 with two digits, NULL for an empty whole."""
    share = part.cast("decimal(20,0)") / F.nullif(whole.cast("decimal(20,0)"), F.lit(0))
    return F.round(share * 100, 2).cast("double")


def pretty_size(size: Column) -> Column:
    """Bytes as text; the next unit starts at 10240 of the one before, halves round up."""
    size = size.cast("bigint")
    out = F.when(F.abs(size) < 10240, F.concat(size.cast("string"), F.lit(" bytes")))
    for power, unit in enumerate(["kB", "MB", "GB", "TB", "PB"], start=1):
        # Values are halved down one bit at a time, then rounded at the last bit.
        shifted = F.shiftright(size, 10 * power - 1)
        value = F.floor((shifted + F.lit(1)) / 2).cast("bigint")
        text = F.concat(value.cast("string"), F.lit(" " + unit))
        out = out.otherwise(text) if unit == "PB" else out.when(F.abs(shifted) < 2 * 10240 - 1, text)
    return out


def utilisation_pct(active: Column, maximum: Column) -> Column:
    return F.when(maximum > 0, active / maximum * 100).otherwise(F.lit(0.0))


def connection_band(pct: Column) -> Column:
    return F.when(pct > 85, "red").when(pct > 60, "yellow").otherwise("green")


def connection_trend(pct: Column) -> Column:
    return F.when(pct > 80, "up").otherwise("neutral")


def latency_band(p99: Column) -> Column:
    return F.when(F.coalesce(p99, F.lit(0)) > 1000, "red").otherwise("white")


def latency_trend(p99: Column) -> Column:
    return F.when(F.coalesce(p99, F.lit(0)) > 1000, "up").otherwise("neutral")


def cache_band(ratio: Column) -> Column:
    return F.when(F.coalesce(ratio, F.lit(100)) < 90, "orange").otherwise("green")


def cache_trend(ratio: Column) -> Column:
    return F.when(F.coalesce(ratio, F.lit(100)) < 90, "down").otherwise("neutral")


def lock_band(waits: Column) -> Column:
    return F.when(F.coalesce(waits, F.lit(0)) > 5, "orange").otherwise("white")


def lock_trend(waits: Column) -> Column:
    return F.when(F.coalesce(waits, F.lit(0)) > 0, "up").otherwise("neutral")


def statement_band(mean_ms: Column) -> Column:
    return F.when(mean_ms > 2000, "red").when(mean_ms > 500, "orange").otherwise("green")
