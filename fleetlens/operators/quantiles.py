"""Exact order statistics per group, whatever the groups' sizes.

Equal values are counted first, combined in the map tasks. A running total of the counts, in the order of
the values and cut into pieces, gives each value the ranks it covers; the value at a wanted rank is the one that covers it.
Infinities are values like others, NaN is the largest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import scan


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], pieces: int | None = None
) -> DataFrame:
    """One row per group with `n` and, for each name in `ranks`, the value at that 1-based rank.

    A rank is an expression over `n`, the size of the group. Ranks outside 1..n give NULL.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counted = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = scan.running(counted, keys, ["_v"], {"_last": ("sum", "_c")}, pieces)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes.select(*keys, "n", *[rank.alias(f"_r_{name}") for name, rank in ranks.items()])
    placed = scan.attach(ranked, wanted, keys)
    first = F.col("_last") - F.col("_c")
    picks = [F.max(F.when((F.col(f"_r_{n}") > first) & (F.col(f"_r_{n}") <= F.col("_last")), F.col("_v"))).alias(n) for n in ranks]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def exclusive_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int] = (50, 95, 99),
    pieces: int | None = None,
) -> DataFrame:
    """Percentiles by the exclusive method (rank p(n+1)/100); NULL with fewer than two values."""
    def place(p: int) -> Column:
        return F.greatest(
            F.lit(1).cast("bigint"),
            F.least(F.col("n") - 1, F.floor((F.col("n") + 1) * p / F.lit(100)).cast("bigint")),
        )

    ranks = {}
    for p in percents:
        ranks[f"lo_{p}"], ranks[f"hi_{p}"] = place(p), place(p) + 1
    stats = order_statistics(df, keys, value, ranks, pieces)

    def blend(p: int) -> Column:
        delta = (F.col("n") + 1) * p - place(p) * 100
        mixed = (F.col(f"lo_{p}") * (100 - delta) + F.col(f"hi_{p}") * delta) / 100
        return F.when(F.col("n") >= 2, mixed).alias(f"p{p}")

    return stats.select(*keys, "n", *[blend(p) for p in percents])


def inclusive_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float] = (50, 95, 99),
    pieces: int | None = None,
) -> DataFrame:
    """Percentiles by linear interpolation over rank p(n-1)/100 + 1, as columns `p<percent>`."""
    def place(p: float) -> Column:
        return (F.col("n") - 1) * F.lit(p) / F.lit(100)

    def low(p: float) -> Column:
        return F.floor(place(p)).cast("bigint")

    ranks = {}
    for i, p in enumerate(percents):
        ranks[f"lo_{i}"] = low(p) + 1
        ranks[f"hi_{i}"] = F.least(F.col("n"), low(p) + 2)
    stats = order_statistics(df, keys, value, ranks, pieces)

    def blend(i: int, p: float) -> Column:
        return (F.col(f"lo_{i}") + (F.col(f"hi_{i}") - F.col(f"lo_{i}")) * (place(p) - low(p))).alias(f"p{p}")

    return stats.select(*keys, "n", *[blend(i, p) for i, p in enumerate(percents)])
