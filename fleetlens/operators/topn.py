"""Top-n per group. `row_number() <= n` prunes inside every map task before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def newest_then_filter(
    df: DataFrame, order: Sequence[Column], limit: int, keep: Column | None = None
) -> DataFrame:
    """Newest `limit` rows of the whole table, filtered only afterwards."""
    page = df.orderBy(*order).limit(limit)
    return page.where(keep) if keep is not None else page
