"""Statistical and threshold detectors over health samples."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.constants import ZSCORE_METRICS
from fleetlens.functions.common import fixed_text
from fleetlens.operators import scan
from fleetlens.session import map_arrow

ALERT_COLUMNS = [
    "database_id", "severity", "anomaly_type", "title", "description", "sql_sample", "client_ip",
    "metric_value", "detected_at",
]


def alert_rows(
    df: DataFrame, severity: Column, kind: Column, title: Column, description: Column,
    value: Column | None = None, sql: Column | None = None, client_ip: Column | None = None,
    at: str = "time", keep: Sequence[str] = (),
) -> DataFrame:
    """Rows in the shared alert shape."""
    return df.select(
        "database_id", severity.alias("severity"), kind.alias("anomaly_type"),
        title.alias("title"), description.alias("description"),
        (F.substring(sql, 1, 500) if sql is not None else F.lit(None).cast("string")).alias("sql_sample"),
        (client_ip if client_ip is not None else F.lit(None).cast("string")).alias("client_ip"),
        (value if value is not None else F.lit(None)).cast("double").alias("metric_value"),
        F.col(at).alias("detected_at"), *keep,
    )


def _order(tie: str | None) -> list[str]:
    return ["time", tie] if tie else ["time"]


def rolling_zscore(
    df: DataFrame, metrics: Sequence[str] = tuple(ZSCORE_METRICS), frame: int = 360, min_rows: int = 30,
    threshold: float = 3.0, tie: str | None = None, pieces: int | None = None,
) -> DataFrame:
    """Samples whose |z| against the last `frame` samples, themselves included, exceeds `threshold`.

    Metrics stay wide through the window (one shuffle) and turn long afterwards.
    """
    order = _order(tie)
    slim = df.select("database_id", *order, *[F.col(m).cast("double").alias(m) for m in metrics])
    scored = scan.rolling_moments(slim, ["database_id"], order, frame, metrics, pieces)
    long = scored.where(F.col("_seen") >= min_rows).select(
        "database_id", *order,
        F.inline(F.array(*[
            F.struct(
                F.lit(m).alias("metric"), F.col(m).alias("value"),
                F.col(f"mean_{m}").alias("mean"), F.col(f"dev_{m}").alias("dev"),
            )
            for m in metrics
        ])),
    )
    z = F.abs(F.col("value") - F.col("mean")) / F.col("dev")
    return (
        long.where(F.col("dev") >= 0.001)
        .withColumn("zscore", z)
        .where(F.col("zscore") > threshold)
        .drop("mean", "dev")
    )


def zscore_alerts(scored: DataFrame, threshold: float = 3.0, keep: Sequence[str] = ()) -> DataFrame:
    return alert_rows(
        scored, F.lit("high"), F.concat(F.lit("statistical_spike_"), "metric"),
        F.concat(F.lit("Unusual "), F.replace("metric", F.lit("_"), F.lit(" ")), F.lit(" spike")),
        F.concat("metric", F.lit(" is "), fixed_text(F.col("value"), 1), F.lit(", z-score = "), fixed_text(F.col("zscore"), 2),
                 F.lit(f" (threshold: {threshold})")),
        F.col("value"), keep=keep,
    )


def rolling_iqr(
    df: DataFrame, metrics: Sequence[str] = tuple(ZSCORE_METRICS), frame: int = 360, min_rows: int = 30,
    width: float = 3.0, tie: str | None = None, pieces: int | None = None,
) -> DataFrame:
    """Samples outside the quartiles of the last `frame` samples by `width` quartile ranges."""
    order = _order(tie)
    slim = df.select("database_id", *order, *[F.nanvl(F.col(m).cast("double"), F.lit(None)).alias(m) for m in metrics])
    rows, by = scan.with_tails(slim, ["database_id"], order, frame - 1, pieces)
    sent = rows.repartition(*by).sortWithinPartitions(*by, *order)
    found = map_arrow(sent, _Quartiles(by, ["database_id", *order], list(metrics), frame, min_rows, width), T.StructType(
        [slim.schema[c] for c in ("database_id", *order)] + [T.StructField("metric", T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in ("value", "q1", "q3")]))
    return found.select("database_id", *order, "metric", "value", ((F.col("value") - F.col("q3")) / (F.col("q3") - F.col("q1"))).alias("iqr_score"))


@dataclass(frozen=True)
class _Quartiles:
    """Values outside the quartiles of their frame, from rows in order; a row inserts one value into a sorted window and takes one out."""

    by: list[str]
    keep: list[str]
    metrics: list[str]
    frame: int
    min_rows: int
    width: float

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in self.by)))
            halo = batch.column("_halo").to_pylist()
            values = [batch.column(m).to_pylist() for m in self.metrics]
            at, metric, value, low, high = [], [], [], [], []
            for i, now in enumerate(keys):
                if now != key:
                    key, windows = now, [(deque(), []) for _ in self.metrics]
                for name, column, (recent, ranked) in zip(self.metrics, values, windows):
                    v = column[i]
                    recent.append(v)
                    if v is not None:
                        insort(ranked, v)
                    if len(recent) > self.frame:
                        old = recent.popleft()
                        if old is not None:
                            del ranked[bisect_left(ranked, old)]
                    n = len(ranked)
                    if v is None or halo[i] or n < self.min_rows:
                        continue
                    q1, q3 = ranked[n // 4], ranked[3 * n // 4]
                    if q3 - q1 >= 0.001 and (v > q3 + self.width * (q3 - q1) or v < q1 - self.width * (q3 - q1)):
                        at.append(i)
                        metric.append(name)
                        value.append(v)
                        low.append(q1)
                        high.append(q3)
            taken = [batch.column(c).take(pa.array(at, pa.int64())) for c in self.keep]
            made = [pa.array(metric, pa.string()), *(pa.array(x, pa.float64()) for x in (value, low, high))]
            yield pa.RecordBatch.from_arrays([*taken, *made], names=[*self.keep, "metric", "value", "q1", "q3"])


# Titles and descriptions of the alerts.
POOL_TITLE, POOL_TEXT = "Connection pool near exhaustion", "%d/%d connections used ("
LAG_TITLE, LAG_TEXT, LAG_END = "Replication lag: ", "Replica is ", " seconds behind primary"


def _pool(share: float) -> tuple[Column, list[Column]]:
    """When a pool is nearly full, and the alert's severity, kind, title, description and value."""
    used = F.col("active_connections") / F.nullif(F.col("max_connections"), F.lit(0))
    return (F.col("max_connections") > 0) & (used > share), [
        F.lit("critical"), F.lit("connection_pool_exhaustion"), F.lit(POOL_TITLE),
        F.concat(F.format_string(POOL_TEXT, "active_connections", "max_connections"), fixed_text(used * 100, 1), F.lit("%)")),
        used,
    ]


def _lag(high: float, critical: float) -> tuple[Column, list[Column]]:
    lag = F.col("replication_lag_seconds").cast("double")
    return lag > high, [
        F.when(lag > critical, "critical").otherwise("high"), F.lit("replication_lag"),
        F.concat(F.lit(LAG_TITLE), fixed_text(lag, 0), F.lit("s")),
        F.concat(F.lit(LAG_TEXT), fixed_text(lag, 0), F.lit(LAG_END)), lag,
    ]


def pool_exhaustion(df: DataFrame, share: float = 0.9) -> DataFrame:
    full, (severity, kind, title, description, value) = _pool(share)
    return alert_rows(df.where(full), severity, kind, title, description, value)


def replication_lag(
    df: DataFrame, high: float = 30.0, critical: float = 300.0, keep: Sequence[str] = ()
) -> DataFrame:
    behind, (severity, kind, title, description, value) = _lag(high, critical)
    return alert_rows(df.where(behind), severity, kind, title, description, value, keep=keep)


def threshold_alerts(df: DataFrame) -> DataFrame:
    """Pool and lag alerts from one pass over the samples."""
    names = ["severity", "kind", "title", "description", "value"]
    found = [(on, F.struct(*[c.cast("double" if n == "value" else "string").alias(n) for c, n in zip(parts, names)])) for on, parts in (_pool(0.9), _lag(30.0, 300.0))]
    either = found[0][0] | found[1][0]
    rows = df.where(either).select("database_id", "time", F.inline(F.array_compact(F.array(*[F.when(on, alert) for on, alert in found]))))
    return alert_rows(rows, F.col("severity"), F.col("kind"), F.col("title"), F.col("description"), F.col("value"))


def health_alerts(df: DataFrame, tie: str | None = None, pieces: int | None = None) -> DataFrame:
    """All detectors' alerts in one table."""
    spikes = zscore_alerts(rolling_zscore(df, tie=tie, pieces=pieces))
    return spikes.unionByName(threshold_alerts(df))


def post_deploy_regressions(
    samples: DataFrame, deployments: DataFrame, metric: str = "p99_latency_ms", hours: int = 24,
    worse_by: float = 0.10,
) -> DataFrame:
    """Mean of a metric in the window before and after each deployment; worse ones are candidates
    for rollback.

    Samples shrink to one sum and count per (database, hour) and per (database, minute). An edge of a window reads running
    sums: of its hour's minutes before it and, within its own minute, of the samples, among which edges are merged in time
    order. The hours between are one frame of hourly sums. So a deployment is three rows and two hours whatever the window,
    and neither a hot hour nor many deployments in one hour multiply rows. No side of a join is sent to every executor.
    """
    span = F.make_interval(hours=F.lit(hours))
    start, stop = F.col("deployed_at") - span, F.col("deployed_at") + span
    trunc = lambda c: F.date_trunc("hour", c)
    key = ["proposal_id", "database_id", "deployed_at"]
    points = samples.select(
        "database_id", F.col("time").alias("_at"), F.lit(1).alias("_rank"),
        F.col(metric).cast("double").alias("_v"), F.when(F.col(metric).isNotNull(), 1).otherwise(0).cast("bigint").alias("_c"),
    ).withColumns({"_minute": F.date_trunc("minute", "_at"), "_hour": trunc(F.col("_at"))})
    whole = points.groupBy("database_id", "_hour").agg(F.sum("_v").alias("_sum"), F.sum("_c").alias("_cnt"))
    # What lies before an edge: samples up to `start` and `deployed_at` exclusive, up to `stop` inclusive.
    edges = deployments.select(*key, F.explode(F.array(
        F.struct(start.alias("_at"), F.lit(0).alias("_rank"), F.lit("start").alias("_edge")),
        F.struct(F.col("deployed_at").alias("_at"), F.lit(0).alias("_rank"), F.lit("mid").alias("_edge")),
        F.struct(stop.alias("_at"), F.lit(2).alias("_rank"), F.lit("stop").alias("_edge")),
    )).alias("_e")).select(*key, "_e.*").withColumns({"_minute": F.date_trunc("minute", "_at"), "_hour": trunc(F.col("_at"))})
    # Of the edge's hour: its whole minutes as a running sum, and of its own minute a running sum of the samples.
    sums = [F.sum("_sum").alias("_sum"), F.sum("_cnt").alias("_cnt")]
    minutes = points.groupBy("database_id", "_hour", "_minute").agg(F.sum("_v").alias("_sum"), F.sum("_c").alias("_cnt"))
    minutes = minutes.unionByName(edges.select("database_id", "_hour", "_minute").distinct(), allowMissingColumns=True)
    earlier = Window.partitionBy("database_id", "_hour").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    passed = minutes.groupBy("database_id", "_hour", "_minute").agg(*sums).select(
        "database_id", "_minute", *[F.sum(c).over(earlier).alias(c) for c in ("_sum", "_cnt")])
    early = edges.join(passed.where("_cnt IS NOT NULL").hint("merge"), ["database_id", "_minute"]).select(*key, "_edge", "_sum", "_cnt")
    own = points.join(edges.select("database_id", "_minute").distinct().hint("merge"), ["database_id", "_minute"], "left_semi")
    so_far = Window.partitionBy("database_id", "_minute").orderBy("_at", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    read = (
        own.unionByName(edges, allowMissingColumns=True)
        .withColumns({"_sum": F.coalesce(F.sum("_v").over(so_far), F.lit(0.0)), "_cnt": F.coalesce(F.sum("_c").over(so_far), F.lit(0))})
        .where(F.col("_edge").isNotNull()).select(*key, "_edge", "_sum", "_cnt")
    ).unionByName(early)
    # Of the hours between: a frame of `hours` rows of sums, read at the deployment's own hour.
    marks = deployments.select("database_id", trunc(F.col("deployed_at")).alias("_hour")).distinct()
    hourly = whole.unionByName(marks, allowMissingColumns=True).groupBy("database_id", "_hour").agg(*sums)
    frames = {
        "before": f"INTERVAL '{hours}' HOUR PRECEDING AND INTERVAL '1' HOUR PRECEDING",
        "after": f"CURRENT ROW AND INTERVAL '{hours - 1}' HOUR FOLLOWING",
    }
    over = "sum({}) OVER (PARTITION BY database_id ORDER BY _hour RANGE BETWEEN {})"
    framed = hourly.select("database_id", "_hour", F.array(*[
        F.struct(F.lit(edge).alias("_edge"), *[F.expr(over.format(c, frame)).alias(c) for c in ("_sum", "_cnt")]) for edge, frame in frames.items()
    ]).alias("_e")).hint("merge")
    inner = deployments.select(*key, trunc(F.col("deployed_at")).alias("_hour")).join(framed, ["database_id", "_hour"]).select(*key, F.inline("_e"))

    def total(column: str, whole_hours: str, until: str, since: str) -> Column:
        of = lambda edge: F.sum(F.when(F.col("_edge") == edge, F.col(column)).otherwise(F.lit(0)))
        return of(whole_hours) + of(until) - of(since)

    def mean(whole_hours: str, until: str, since: str) -> Column:
        n = total("_cnt", whole_hours, until, since)
        return F.when(n > 0, total("_sum", whole_hours, until, since) / n)

    found = inner.unionByName(read).groupBy(*key).agg(
        mean("before", "mid", "start").alias("before_mean"), mean("after", "stop", "mid").alias("after_mean"),
        (total("_cnt", "before", "mid", "start") + total("_cnt", "after", "stop", "mid")).alias("_n"),
    )
    worse = F.col("after_mean") > F.col("before_mean") * (1 + worse_by)
    return found.where("_n > 0").drop("_n").withColumn("rollback_candidate", F.coalesce(worse, F.lit(False)))
