"""Whole-table comparison: digests, backup verification, result equivalence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.detectors import alert_rows


def _row_hash(columns: list[str], seed: int) -> Column:
    """64-bit hash of a row. NULL flags enter too, so a value cannot trade places with a NULL."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(F.lit(seed), nulls, *columns)


def table_digest(df: DataFrame, name: str) -> DataFrame:
    """Rows and an order-free content digest of a whole table, combined in the map tasks."""
    columns = sorted(df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(_row_hash(columns, 1).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor(_row_hash(columns, 2)), F.lit(0)).alias("hash_xor"),
    ).select(F.lit(name).alias("table_name"), "rows", "hash_sum", "hash_xor")


def bucket_digests(df: DataFrame, key: str, buckets: int = 1024) -> DataFrame:
    """Digest per bucket of the key, to find where two copies part: by remainder for whole numbers, else by hash."""
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    place = F.pmod(F.col(key).cast("bigint") if whole else F.xxhash64(key), F.lit(buckets))
    columns = sorted(df.columns)
    return df.groupBy(place.alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(_row_hash(columns, 1).cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor(_row_hash(columns, 2)).alias("hash_xor"),
    )


def differing_buckets(live: DataFrame, restored: DataFrame, key: str, buckets: int = 1024) -> DataFrame:
    a, b = (bucket_digests(d, key, buckets) for d in (live, restored))
    names = [c for c in a.columns if c != "bucket"]
    other = b.select("bucket", *[F.col(c).alias(f"r_{c}") for c in names])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in names])
    return a.join(other, "bucket", "full_outer").where(~same).select(
        "bucket", F.col("rows").alias("live_rows"), F.col("r_rows").alias("restored_rows")
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def reconcile(live: dict[str, DataFrame], restored: dict[str, DataFrame]) -> DataFrame:
    """One row per table: counts, whether they and the contents match, and the mismatch line.

    Mismatch lines exist for live tables only; a table found only in the restored copy still fails
    the counts.
    """
    a = _union([table_digest(d, n) for n, d in live.items()])
    b = _union([table_digest(d, n) for n, d in restored.items()]).select(
        "table_name", F.col("rows").alias("r_rows"), F.col("hash_sum").alias("r_sum"), F.col("hash_xor").alias("r_xor")
    )
    both = a.join(b, "table_name", "full_outer")
    counts = F.col("rows").eqNullSafe(F.col("r_rows"))
    content = counts & F.col("hash_sum").eqNullSafe(F.col("r_sum")) & F.col("hash_xor").eqNullSafe(F.col("r_xor"))
    line = F.concat(
        "table_name", F.lit(": live="), F.col("rows").cast("string"),
        F.lit(" restored="), F.coalesce(F.col("r_rows").cast("string"), F.lit("None")),
    )
    return both.select(
        "table_name", F.col("rows").alias("live_rows"), F.col("r_rows").alias("restored_rows"),
        counts.alias("counts_match"), content.alias("content_match"),
        F.when(F.col("rows").isNotNull() & ~counts, line).alias("mismatch"),
    )


def verification(report: DataFrame, database_id: str, at: str) -> DataFrame:
    """Verdict over all tables of a `reconcile` report; tables are few, rows were counted before."""
    passed = F.bool_and(F.col("counts_match") & F.col("content_match"))
    return report.agg(
        F.when(passed, "passed").otherwise("failed").alias("status"),
        F.count(F.lit(1)).alias("tables"),
        F.array_join(F.array_sort(F.array_compact(F.collect_list("mismatch"))), "; ").alias("mismatched_tables"),
    ).select(F.lit(database_id).alias("database_id"), "*", F.lit(at).cast("timestamp_ntz").alias("time"))


def backup_alerts(verifications: DataFrame) -> DataFrame:
    """A p1 alert per failed verification."""
    failed = verifications.where(F.col("status") == "failed")
    error = F.col("error_message") if "error_message" in verifications.columns else F.lit(None).cast("string")
    return alert_rows(
        failed, F.lit("p1"), F.lit("backup_verification_failed"), F.lit("Backup verification FAILED"),
        F.coalesce(error, F.lit("Unknown error")),
    )


def result_difference(a: DataFrame, b: DataFrame, multiset: bool = False) -> DataFrame:
    """Whether two results hold the same rows, and how many differ.

    Both sides are counted per distinct row in one shuffle with map-side combine, so a row repeated
    a billion times travels once per task. Sets by default; `multiset` also compares multiplicity.
    """
    names = a.columns
    tagged = a.select(*names, F.lit(1).alias("_a"), F.lit(0).alias("_b")).union(
        b.select(*names, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    counted = tagged.groupBy(*names).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    gap = F.abs(F.col("_a") - F.col("_b")) if multiset else (
        ((F.col("_a") > 0) != (F.col("_b") > 0)).cast("bigint")
    )
    n = F.coalesce(F.sum(gap), F.lit(0))
    return counted.agg(n.alias("differing_rows")).select(
        (F.col("differing_rows") == 0).alias("is_valid"),
        F.when(F.col("differing_rows") == 0, "Result sets identical").otherwise(
            F.format_string("Result sets differ: %d rows different", "differing_rows")
        ).alias("reason"),
        "differing_rows",
    )


def validate_rewrite(spark, original_sql: str, rewritten_sql: str, multiset: bool = False) -> tuple[bool, str]:
    """Run both statements and compare whole results; an error is a negative answer."""
    try:
        row = result_difference(spark.sql(original_sql), spark.sql(rewritten_sql), multiset).first()
    except Exception as error:  # noqa: BLE001
        return False, f"Validation error: {error}"
    return row["is_valid"], row["reason"]
