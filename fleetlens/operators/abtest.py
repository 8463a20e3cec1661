"""Before/after latency comparison from sample rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.common import fixed_text
from fleetlens.operators.quantiles import exclusive_percentiles

# Fixed values: |t| beyond which a two-sided normal test exceeds 95 % confidence.
T_95 = 1.959963984540054
# Error function approximation 7.1.26 of Abramowitz and Stegun.
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def erf(x: Column) -> Column:
    """Error function for x >= 0, within 1.5e-7."""
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return 1 - poly * F.exp(-x * x)


def phase_stats(samples: DataFrame, keys: Sequence[str], phase: str = "phase", value: str = "latency_ms") -> DataFrame:
    """Mean, variance and size of both phases in one row per key."""
    def pick(name: str) -> Column:
        return F.when(F.col(phase) == name, F.col(value))

    return samples.groupBy(*keys).agg(*[
        agg(pick(p)).alias(f"{p}_{label}")
        for p in ("before", "after")
        for label, agg in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
    ])


def compare_phases(
    samples: DataFrame, keys: Sequence[str], phase: str = "phase", value: str = "latency_ms",
    min_rows: int = 30, min_gain: float = 5.0,
) -> DataFrame:
    """Percentiles of both phases, gain, Welch t, confidence and verdict per key."""
    pct = exclusive_percentiles(samples, [*keys, phase], value)
    wide = pct.groupBy(*keys).agg(*[
        F.max(F.when(F.col(phase) == p, F.col(f"p{q}"))).alias(f"{p}_p{q}")
        for p in ("before", "after") for q in (50, 95, 99)
    ])
    joined = wide.join(phase_stats(samples, keys, phase, value), list(keys))

    def gain(q: int) -> Column:
        old, new = F.col(f"before_p{q}"), F.col(f"after_p{q}")
        return F.when(old > 0, (old - new) / old * 100).otherwise(0.0)

    error = F.sqrt(F.col("before_var") / F.col("before_n") + F.col("after_var") / F.col("after_n"))
    t = (F.col("before_mean") - F.col("after_mean")) / F.nullif(error, F.lit(0.0))
    enough = (F.col("before_n") >= min_rows) & (F.col("after_n") >= min_rows)
    confidence = F.when(~enough, 0.5).when(F.col("welch_t").isNull(), 0.0).otherwise(
        erf(F.abs("welch_t") / F.sqrt(F.lit(2.0)))
    )
    certain = enough & (F.abs("welch_t") > T_95)
    return (
        joined.withColumn("welch_t", t)
        .withColumn("p99_improvement_pct", gain(99))
        .withColumn("p95_improvement_pct", gain(95))
        .withColumn("statistical_confidence", confidence)
        .withColumn(
            "is_improvement",
            F.coalesce((F.col("p99_improvement_pct") > min_gain) & certain, F.lit(False)),
        )
        .withColumn("summary", F.concat(
            F.lit("p99: "), fixed_text(F.col("before_p99"), 1), F.lit("ms → "), fixed_text(F.col("after_p99"), 1), F.lit("ms ("),
            F.when(F.col("p99_improvement_pct") >= 0, "+").otherwise(""), fixed_text(F.col("p99_improvement_pct"), 1),
            F.lit("%), confidence: "), fixed_text(F.col("statistical_confidence") * 100, 1), F.lit("%"),
        ))
    )
