"""Capacity forecasts for all series at once: trend, seasonal shape, breach dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as K
from fleetlens.operators import quantiles

SERIES = ["database_id", "metric"]
#: Percentiles of the residuals between which a seasonal forecast's band lies.
BAND = (2.5, 97.5)
MIN_POINTS = 3
TOO_SHORT = "Collecting data — a forecast will appear within a few minutes."


def _seconds(time: Column, origin: Column) -> Column:
    micros = F.unix_micros(time.cast("timestamp")) - F.unix_micros(origin.cast("timestamp"))
    return micros / 1e6


def trends(series: DataFrame, as_of: str) -> DataFrame:
    """Least squares line of each series (database_id, metric, ds, y) in seconds from its first point."""
    origin = F.lit(as_of).cast("timestamp_ntz")
    t = _seconds(F.col("ds"), origin)
    fit = series.where(F.col("y").isNotNull()).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
        F.max_by("y", "ds").alias("current_value"),
        F.stddev_samp("y").alias("std"),
        F.regr_slope("y", t).alias("slope"), F.regr_intercept("y", t).alias("_at_origin"),
    )
    return fit.withColumn(
        "intercept", F.col("_at_origin") + F.col("slope") * _seconds(F.col("first_ds"), origin)
    ).drop("_at_origin")


def series_guard(series: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Points, current value and an error for series too short to fit."""
    return series.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("points"),
        F.coalesce(F.max_by("y", "ds"), F.lit(0.0)).alias("current_value"),
    ).withColumn("error", F.when(F.col("points") < min_points, TOO_SHORT))


def _grid(df: DataFrame, days: int) -> DataFrame:
    hours = F.explode(F.sequence(F.lit(1), F.lit(days * 24))).alias("_h")
    return df.where(F.col("points") >= MIN_POINTS).select("*", hours).withColumn(
        "ds", F.col("last_ds") + F.make_interval(hours=F.col("_h"))
    )


def linear_forecast(series: DataFrame, as_of: str, days: int = 28) -> DataFrame:
    """Hourly trend values after the last point, with a band of 1.5 standard deviations."""
    grid = _grid(trends(series, as_of), days)
    t = _seconds(F.col("last_ds"), F.col("first_ds")) + F.col("_h") * 3600
    y = F.col("slope") * t + F.col("intercept")
    zero = F.lit(0.0)
    return grid.select(
        *SERIES, "ds", F.greatest(zero, y).alias("yhat"),
        F.greatest(zero, y - F.col("std") * 1.5).alias("yhat_lower"),
        (y + F.col("std") * 1.5).alias("yhat_upper"), "current_value",
    )


def _slot(time: Column) -> Column:
    """Hour of the week."""
    return (F.dayofweek(time) - 1) * 24 + F.hour(time)


def _shape(series: DataFrame, trend: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What is left of the points after the trend, and its mean for each hour of the week: at most 168 rows a series."""
    slim = trend.select(*keys, "first_ds", "slope", "intercept")
    rest = series.where(F.col("y").isNotNull()).join(slim, keys).select(
        *keys, _slot(F.col("ds")).alias("slot"),
        (F.col("y") - F.col("slope") * _seconds(F.col("ds"), F.col("first_ds")) - F.col("intercept")).alias("r"),
    )
    return rest, rest.groupBy(*keys, "slot").agg(F.avg("r").alias("seasonal"))


def seasonal_forecast(series: DataFrame, as_of: str, days: int = 28) -> DataFrame:
    """Trend plus the mean deviation of each hour of the week, between the 2.5 and 97.5 percentiles of what neither explains."""
    trend = trends(series, as_of)
    rest, shape = _shape(series, trend, SERIES)
    left = rest.join(shape, [*SERIES, "slot"]).withColumn("rest", F.col("r") - F.col("seasonal"))
    band = quantiles.inclusive_percentiles(left, SERIES, "rest", BAND).select(*SERIES, F.col(f"`p{BAND[0]}`").alias("low"), F.col(f"`p{BAND[1]}`").alias("high"))
    grid = _grid(trend, days).withColumn("slot", _slot(F.col("ds")))
    t = _seconds(F.col("last_ds"), F.col("first_ds")) + F.col("_h") * 3600
    y = F.col("slope") * t + F.col("intercept") + F.coalesce("seasonal", F.lit(0.0))
    return grid.join(shape, [*SERIES, "slot"], "left").join(band, SERIES).select(
        *SERIES, "ds", y.alias("yhat"), (y + F.col("low")).alias("yhat_lower"), (y + F.col("high")).alias("yhat_upper"), "current_value",
    )


def backtest(series: DataFrame, cuts: Sequence[str], horizon_days: int = 7) -> DataFrame:
    """Errors of the seasonal forecast by days ahead, from rolling origins: (database_id, metric, horizon, points, mae, rmse, naive_mae).

    Each origin in `cuts` is fitted on what lies before it and judged on the `horizon_days` after it; `naive_mae` is the error of
    staying at the last value. A point counts for every origin at or after it, so all origins are fitted in one
    pass, by sums per (series, origin). Series too short at an origin are left out there.
    """
    keys = [*SERIES, "cut"]
    origins = F.array(*[F.lit(c).cast("timestamp_ntz") for c in cuts])
    known = series.where(F.col("y").isNotNull()).select(*SERIES, "ds", "y", F.explode(origins).alias("cut"))
    past = known.where(F.col("ds") < F.col("cut"))
    t = _seconds(F.col("ds"), F.col("cut"))
    fit = past.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.max_by("y", "ds").alias("last_y"), F.regr_slope("y", t).alias("slope"),
        F.regr_intercept("y", t).alias("intercept")).where(F.col("points") >= MIN_POINTS).withColumn("first_ds", F.col("cut"))
    _, shape = _shape(past, fit, keys)
    ahead = known.where((F.col("ds") >= F.col("cut")) & (F.col("ds") < F.col("cut") + F.make_interval(days=F.lit(horizon_days))))
    judged = ahead.withColumn("slot", _slot(F.col("ds"))).join(fit.drop("points", "first_ds"), keys).join(shape, [*keys, "slot"], "left")
    error = F.col("y") - (F.col("slope") * t + F.col("intercept") + F.coalesce("seasonal", F.lit(0.0)))
    horizon = F.floor(t / 86400).cast("int") + 1
    return judged.groupBy(*SERIES, horizon.alias("horizon")).agg(
        F.count(F.lit(1)).alias("points"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(F.col("y") - F.col("last_y"))).alias("naive_mae"))


def _threshold_columns(df: DataFrame) -> DataFrame:
    """Thresholds as literals: four fixed entries need no join."""
    def pick(i: int, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for row in K.CAPACITY_THRESHOLDS:
            if row[i] is not None:
                out = F.when(F.col("metric") == row[0], F.lit(row[i]).cast(kind)).otherwise(out)
        return out

    return df.select(
        "*", pick(1, "double").alias("absolute"), pick(2, "double").alias("growth"),
        pick(3, "double").alias("share"), F.coalesce(pick(4, "string"), F.lit("")).alias("unit"),
        pick(5, "string").alias("advice"),
    )


def breaches(
    forecast: DataFrame, as_of: str, warn_days: int = K.CAPACITY_WARNING_DAYS,
    capacity: DataFrame | None = None,
) -> DataFrame:
    """First forecast hour at or over the metric's limit, per series.

    The absolute limit decides first, growth over the current value next. `capacity`
    (database_id, metric, capacity) switches on limits declared as a share of it.
    """
    f = _threshold_columns(forecast)
    if capacity is not None:
        f = f.join(capacity, SERIES, "left")
    else:
        f = f.withColumn("capacity", F.lit(None).cast("double"))

    def first(limit: Column, on: Column) -> Column:
        return F.min(F.when(on & (F.col("yhat") >= limit), F.col("ds")))

    grown = F.col("current_value") > 0
    result = f.groupBy(*SERIES, "unit", "advice").agg(
        F.first("current_value").alias("current_value"),
        F.coalesce(
            first(F.col("absolute"), F.col("absolute").isNotNull()),
            first(F.col("current_value") * F.col("growth"), grown),
            first(F.col("capacity") * F.col("share"), F.col("capacity").isNotNull()),
        ).alias("breach_date"),
    )
    now = F.lit(as_of).cast("timestamp_ntz")
    days = F.greatest(F.lit(0), F.floor(_seconds(F.col("breach_date"), now) / 86400).cast("int"))
    return result.select(
        *SERIES, "unit", "current_value", "breach_date",
        F.when(F.col("breach_date").isNotNull(), days).alias("days_until_breach"),
        F.when(F.col("breach_date").isNotNull(), F.col("advice")).alias("recommendation"),
    ).withColumn("warn", F.coalesce(F.col("days_until_breach") <= warn_days, F.lit(False)))
