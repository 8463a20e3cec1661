"""Table bloat and index usage reports from catalog statistics rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.snapshot import pretty_size, ratio_pct
from fleetlens.operators.topn import top_n


def table_bloat(
    stats: DataFrame, keys: Sequence[str] = ("database_id",), min_dead: int = 1000, n: int = 20
) -> DataFrame:
    """The `n` tables with most dead rows per key (a poll of a database)."""
    worst = top_n(
        stats.where(F.col("dead_tuples") > min_dead), keys, [F.desc("dead_tuples"), F.asc("table_name")], n
    )
    return worst.select(
        *keys, "table_name", pretty_size(F.col("total_bytes")).alias("total_size"), "total_bytes",
        "dead_tuples", "live_tuples",
        ratio_pct(F.col("dead_tuples"), F.col("live_tuples") + F.col("dead_tuples")).alias("dead_ratio_pct"),
    )


def index_usage(stats: DataFrame, keys: Sequence[str] = ("database_id",), n: int = 50) -> DataFrame:
    """The `n` least scanned indexes per key."""
    order = [F.asc_nulls_last("index_scans"), F.asc("index_name")]
    return top_n(stats, keys, order, n).select(
        *keys, "table_name", "index_name", "index_scans",
        pretty_size(F.col("index_bytes")).alias("index_size"), "index_bytes",
    )


def unused_indexes(
    stats: DataFrame, keys: Sequence[str] = ("database_id",), n: int = 50, max_scans: int = 10,
    min_bytes: int = 10 * 1024 * 1024,
) -> DataFrame:
    """Count and first five names of big, rarely scanned indexes among the `n` least scanned."""
    listed = index_usage(stats, keys, n).where(
        (F.coalesce("index_scans", F.lit(0)) < max_scans)
        & (F.coalesce("index_bytes", F.lit(0)) > min_bytes)
    )
    # At most n rows per key are left here, so the list is bounded.
    names = F.array_sort(F.collect_list(F.struct("index_scans", "index_name")))
    return listed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unused_count"),
        F.array_join(F.slice(names, 1, 5).getField("index_name"), ", ").alias("first_names"),
    )


def table_stat_rows(stats: DataFrame) -> DataFrame:
    """Bloat rows in the stored shape: missing names become '', missing numbers 0."""
    def number(name: str, out: str, kind: str):
        return F.coalesce(F.col(name), F.lit(0)).cast(kind).alias(out)

    return stats.select(
        "time", "database_id",
        F.coalesce("full_table_name", F.lit("")).alias("table_name"),
        number("total_bytes", "total_bytes", "bigint"),
        number("n_dead_tup", "dead_tuples", "bigint"),
        number("n_live_tup", "live_tuples", "bigint"),
        number("dead_ratio_pct", "dead_ratio_pct", "double"),
    )


def index_stat_rows(stats: DataFrame) -> DataFrame:
    """Index rows in the stored shape."""
    return stats.select(
        "time", "database_id",
        F.coalesce("table_name", F.lit("")).alias("table_name"),
        F.coalesce("index_name", F.lit("")).alias("index_name"),
        F.coalesce("index_scans", F.lit(0)).cast("bigint").alias("index_scans"),
        F.coalesce("index_bytes", F.lit(0)).cast("bigint").alias("index_bytes"),
    )
