"""Registry of monitored databases from connection URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default ports.
PORTS = {"postgresql": 5432, "mysql": 3306}
URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^:/?#]*)(?::([^/?#]*))?@)?([^:/?#@]*)(?::([^/?#]*))?([^?#]*)"


def explode_urls(df: DataFrame, listing: str) -> DataFrame:
    """One row per non-empty entry of comma-separated lists."""
    return df.withColumn("url", F.explode(F.split(listing, ","))).withColumn("url", F.trim("url")).where(F.col("url") != "")


def database_id(kind: Column, host: Column, port: Column, database: Column) -> Column:
    """First 16 hex digits of the SHA-256 of type, host, port and database."""
    return F.substring(F.sha2(F.concat_ws(":", kind, host, port.cast("string"), database), 256), 1, 16)


def parse_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Add id, name, db_type, host, port, database_name, username. Rows with a broken port are dropped."""
    def part(i: int) -> Column:
        return F.regexp_extract(F.col(url), URL, i)

    parsed = df.where(F.col(url).isNotNull() & ((part(5) == "") | part(5).rlike(r"^\d{1,5}$")))
    parsed = (
        parsed.withColumn("db_type", F.when(F.lower(F.col(url)).startswith("postgres"), "postgresql").otherwise("mysql"))
        .withColumn("host", F.coalesce(F.nullif(F.lower(part(4)), F.lit("")), F.lit("localhost")))
        .withColumn("_p", F.coalesce(F.nullif(part(5), F.lit("")).try_cast("int"), F.lit(0)))
        .where(F.col("_p") <= 65535)
        .withColumn("port", F.when(F.col("_p") > 0, F.col("_p")).when(
            F.col("db_type") == "postgresql", PORTS["postgresql"]).otherwise(PORTS["mysql"]))
        .withColumn("database_name", F.regexp_replace(part(6), "^/+", ""))
        .withColumn("username", part(2))
        .drop("_p")
    )
    return parsed.withColumn(
        "id", database_id(F.col("db_type"), F.col("host"), F.col("port"), F.col("database_name"))
    ).withColumn("name", F.coalesce(F.nullif("database_name", F.lit("")), F.col("host")))


def schema_summary(columns: DataFrame, keys: tuple[str, ...] = (), max_tables: int = 40) -> DataFrame:
    """A `table(col type, …)` line per table, first `max_tables` tables by name.

    Expects one row per column: table_name, ordinal_position, column_name, data_type. The table cut
    comes before columns are listed, and a table's columns are few.
    """
    from fleetlens.operators.topn import top_n

    names = columns.select(*keys, "table_name").distinct()
    if keys:
        kept = top_n(names, keys, [F.asc("table_name")], max_tables)
    else:
        kept = names.orderBy("table_name").limit(max_tables)
    listed = F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name", "data_type")))
    lines = F.transform(listed, lambda c: F.concat(c["column_name"], F.lit(" "), c["data_type"]))
    return columns.join(kept, [*keys, "table_name"], "left_semi").groupBy(*keys, "table_name").agg(
        F.concat(F.first("table_name"), F.lit("("), F.array_join(lines, ", "), F.lit(")")).alias("line")
    )
