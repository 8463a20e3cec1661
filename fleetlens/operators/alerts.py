"""Alert routing, lists, rules and lifecycle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as K
from fleetlens.functions.common import bucket_start
from fleetlens.operators import scan
from fleetlens.operators.topn import newest_then_filter, top_n


def _lookup(values: dict[str, str], key: Column, default: str) -> Column:
    """A fixed dictionary of a few entries as a literal map: no join needed."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def route(alerts: DataFrame) -> DataFrame:
    """Delivery route and colour of each alert by severity."""
    severity = F.col("severity")
    return alerts.withColumn("route", _lookup(K.SEVERITY_ROUTES, severity, K.DEFAULT_ROUTE)).withColumn(
        "color", _lookup(K.SEVERITY_COLORS, severity, K.DEFAULT_COLOR)
    )


def proposal_mark(event: Column) -> Column:
    return _lookup(K.PROPOSAL_MARKS, event, K.DEFAULT_MARK)


def is_security(kind: Column) -> Column:
    return reduce(lambda a, b: a | b, [kind.startswith(p) for p in K.SECURITY_PREFIXES])


def _newest(alerts: DataFrame) -> list[Column]:
    rest = [c for c in ("database_id", "anomaly_type", "metric_value", "sql_sample") if c in alerts.columns]
    return [F.desc("detected_at"), *[F.asc(c) for c in rest]]


def alert_page(alerts: DataFrame, limit: int = 50, severity: str | None = None) -> DataFrame:
    """Newest `limit` alerts; the severity filter applies to that page."""
    keep = F.col("severity") == severity if severity else None
    return newest_then_filter(alerts, _newest(alerts), min(limit, 200), keep)


def security_page(alerts: DataFrame, limit: int = 50) -> DataFrame:
    """Security alerts among the newest 200, newest `limit` of them."""
    page = newest_then_filter(alerts, _newest(alerts), 200, is_security(F.col("anomaly_type")))
    return page.orderBy(*_newest(alerts)).limit(limit)


def recent_per_database(df: DataFrame, n: int, time: str = "detected_at", tie: str | None = None) -> DataFrame:
    return top_n(df, ["database_id"], [F.desc(time), *([F.desc(tie)] if tie else [])], n)


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity", "anomaly_type").agg(F.count(F.lit(1)).alias("n"))


def digest(alerts: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Alerts per hour that wait for the digest."""
    return (
        route(alerts).where(F.col("route") == "digest")
        .groupBy(bucket_start(F.col("detected_at"), bucket_seconds).alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- declared rules -------------------------------------------------------------------------------


def valid_rules(rules: DataFrame) -> DataFrame:
    """Rules with the list of what is wrong with each."""
    errors = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "name is empty"),
        F.when(~F.coalesce(F.col("condition").rlike("^(gt|lt|eq)$"), F.lit(False)), "condition must be gt, lt or eq"),
        F.when(F.col("threshold").isNull(), "threshold is missing"),
        F.when(F.coalesce("duration_seconds", F.lit(0)) < 0, "duration is negative"),
    ))
    return rules.withColumn("errors", errors)


def valid_review(comment: Column) -> Column:
    """A review comment needs ten characters."""
    return F.length(F.coalesce(comment, F.lit(""))) >= 10


# Parameter -> (default, least, most) of each kind of request.
PARAMETERS = {
    "metrics": {"hours": (24, 1, 720)},
    "capacity": {"lookahead_days": (28, 7, 90)},
    "alerts": {"limit": (50, 1, 200)},
    "queries": {"limit": (20, 1, 100)},
}


def valid_requests(requests: DataFrame, kind: str = "kind") -> DataFrame:
    """Requests (kind and parameter columns) with defaults filled in and the list of what is wrong with each.

    A parameter that its kind does not know is ignored; a request of an unknown kind is an error.
    """
    names = sorted({name for ranges in PARAMETERS.values() for name in ranges} & set(requests.columns))
    filled = requests
    for name in names:
        default = F.lit(None)
        for k, ranges in PARAMETERS.items():
            if name in ranges:
                default = F.when(F.col(kind) == k, ranges[name][0]).otherwise(default)
        filled = filled.withColumn(name, F.coalesce(name, default.cast(requests.schema[name].dataType)))
    wrong = [F.when(~F.coalesce(F.col(kind).isin(*PARAMETERS), F.lit(False)), "unknown kind")]
    for k, ranges in PARAMETERS.items():
        for name, (_, least, most) in ranges.items():
            if name in names:
                wrong.append(F.when((F.col(kind) == k) & ~F.col(name).between(least, most), f"{name} must be {least} to {most}"))
    return filled.withColumn("errors", F.array_compact(F.array(*wrong)))


def breaches(value: Column, condition: Column, threshold: Column) -> Column:
    return (
        F.when(condition == "gt", value > threshold)
        .when(condition == "lt", value < threshold)
        .when(condition == "eq", value == threshold)
        .otherwise(False)
    )


def rule_samples(samples: DataFrame, rules: list[dict], tie: str | None = None) -> DataFrame:
    """Every sample judged by every rule: (rule_id, database_id, time, value, breach).

    Rules are a short configuration list. They become literals of one projection, so samples are
    read once and nothing is joined.
    """
    one = [
        F.struct(
            F.lit(r["rule_id"]).alias("rule_id"),
            F.lit(r["severity"]).alias("severity"),
            F.lit(int(r.get("duration_seconds", 60))).alias("duration_seconds"),
            F.col(r["metric"]).cast("double").alias("value"),
            F.coalesce(
                breaches(F.col(r["metric"]).cast("double"), F.lit(r["condition"]), F.lit(float(r["threshold"]))),
                F.lit(False),
            ).alias("breach"),
        )
        for r in rules if r.get("is_active", True)
    ]
    order = ["time", tie] if tie else ["time"]
    return samples.select("database_id", *order, F.inline(F.array(*one)))


def rule_table_matches(samples: DataFrame, rules: DataFrame, tie: str | None = None) -> DataFrame:
    """Breaches of rules that are rows (rule_id, metric, condition, threshold, severity, is_active).

    Samples turn into one row per metric some active rule may name, and meet the rules on it; any number of
    rules plans the same. Rules on a metric that samples lack match nothing.
    """
    order = ["time", tie] if tie else ["time"]
    names = [c for c, kind in samples.dtypes if c not in ("database_id", *order) and kind in ("int", "bigint", "double", "float", "smallint")]
    long = samples.select("database_id", *order, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        ["database_id", *order], names, "metric", "value"
    )
    met = long.join(rules.where(F.coalesce("is_active", F.lit(True))), "metric")
    breach = F.coalesce(breaches(F.col("value"), F.col("condition"), F.col("threshold")), F.lit(False))
    return met.where(breach).select("rule_id", "severity", "database_id", *order, "value")


def rule_alerts(rules: DataFrame, alerts: DataFrame, time: str = "time") -> DataFrame:
    """Every rule with how often it fired and when last, fired or not."""
    fired = alerts.groupBy("rule_id").agg(F.count(F.lit(1)).alias("alerts"), F.max(time).alias("last_alert_at"))
    return rules.join(fired, "rule_id", "left").fillna(0, ["alerts"])


def rule_matches(samples: DataFrame, rules: list[dict], tie: str | None = None) -> DataFrame:
    return rule_samples(samples, rules, tie).where("breach").drop("breach")


def sustained_breaches(
    samples: DataFrame, rules: list[dict], tie: str | None = None, pieces: int | None = None
) -> DataFrame:
    """Runs of breaching samples that last at least the rule's duration, with the time they ended.

    The latest quiet sample before a row names the run the row belongs to; the next quiet sample
    carries the same name and closes it. Runs are then plain aggregates.
    """
    judged = rule_samples(samples, rules, tie)
    order = ["time", tie] if tie else ["time"]
    quiet = F.when(~F.col("breach"), F.struct(*order))
    named = scan.previous(judged, ["rule_id", "database_id"], order, quiet, "_run", pieces)
    runs = named.groupBy("rule_id", "severity", "duration_seconds", "database_id", "_run").agg(
        F.min(F.when(F.col("breach"), F.col("time"))).alias("fired_at"),
        F.max(F.when(F.col("breach"), F.col("time"))).alias("last_breach_at"),
        F.min(F.when(~F.col("breach"), F.col("time"))).alias("resolved_at"),
        F.count_if("breach").alias("samples"),
    )
    lasted = F.unix_seconds(F.col("last_breach_at").cast("timestamp")) - F.unix_seconds(F.col("fired_at").cast("timestamp"))
    return runs.where((F.col("samples") > 0) & (lasted >= F.col("duration_seconds"))).drop("_run")


def lifecycle(alerts: DataFrame, as_of: str) -> DataFrame:
    """Status of each alert at `as_of` from its own time stamps."""
    now = F.lit(as_of).cast("timestamp_ntz")
    status = (
        F.when(F.col("resolved_at") <= now, "resolved")
        .when(F.col("silenced_until") > now, "silenced")
        .when(F.col("acknowledged_by").isNotNull(), "acknowledged")
        .otherwise("active")
    )
    return alerts.withColumn("status", status)


def databases_without_alerts(databases: DataFrame, alerts: DataFrame) -> DataFrame:
    return databases.join(alerts.select("database_id").distinct(), "database_id", "left_anti")
