"""Heuristic statement review: issues, index advice, impact score, change proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as K


def lint(
    df: DataFrame, sql: str = "query", db_type: str = "postgresql", seq_scan: Column | None = None,
    fixed: bool = False,
) -> DataFrame:
    """Add `issues`, `index_columns`, `index_ddl`, `impact_score`, `confidence`.

    `seq_scan` is a boolean column: the statement's plan holds a reported sequential scan.
    `fixed` reads operators that are followed by a blank or a quote, which the default pattern skips.
    """
    low = F.lower(F.col(sql))
    pattern = K.LINT_COLUMN_FIXED if fixed else K.LINT_COLUMN
    df = df.withColumn("_table", F.nullif(F.regexp_extract(low, "(?U)" + K.LINT_FROM, 1), F.lit("")))
    clause = F.get(F.regexp_extract_all(low, F.lit("(?Ud)" + K.LINT_WHERE), 1), F.lit(0))
    named = F.regexp_extract_all(clause, F.lit("(?U)" + pattern), 1)
    columns = F.filter(named, lambda c: ~c.isin(K.LINT_NOT_COLUMNS))
    df = df.withColumn(
        "index_columns", F.coalesce(F.slice(F.array_distinct(columns), 1, 3), F.array().cast("array<string>"))
    )
    listed = F.array_join("index_columns", ", ")
    name = F.concat(
        F.lit("idx_"), F.replace("_table", F.lit("."), F.lit("_")), F.lit("_"), F.array_join("index_columns", "_")
    )
    mode = "CONCURRENTLY " if db_type == "postgresql" else ""
    ddl = F.when(
        F.col("_table").isNotNull() & (F.size("index_columns") > 0),
        F.concat(F.lit(f"CREATE INDEX {mode}"), name, F.lit(" ON "), F.col("_table"), F.lit(" ("), listed, F.lit(")")),
    )
    star = low.rlike("(?U)" + K.LINT_STAR)
    unlimited = low.contains("order by") & ~low.contains("limit")
    wildcard = low.rlike("(?U)" + K.LINT_LEADING_WILDCARD)
    scan = F.coalesce(seq_scan, F.lit(False)) if seq_scan is not None else F.lit(False)
    issues = F.array_compact(F.array(
        F.when(star, K.LINT_STAR_TEXT), F.when(unlimited, K.LINT_ORDER_TEXT),
        F.when(wildcard, K.LINT_WILDCARD_TEXT), F.when(scan, K.LINT_SEQ_SCAN_TEXT),
    ))

    def points(on: Column, rule: str) -> Column:
        return F.when(on, K.LINT_SCORES[rule]).otherwise(0)

    df = df.withColumn("index_ddl", ddl)
    score = (
        points(star, "select_star") + points(F.col("index_ddl").isNotNull(), "index")
        + points(unlimited, "order_by") + points(wildcard, "wildcard") + points(scan, "seq_scan")
    )
    return (
        df.withColumn("issues", F.when(F.size(issues) > 0, issues).otherwise(F.array(F.lit(K.LINT_NOTHING_TEXT))))
        .withColumn("impact_score", F.least(F.lit(K.LINT_CAP), score))
        .withColumn("confidence", F.lit(K.LINT_CONFIDENCE))
        .drop("_table")
    )


def proposals_from_lint(linted: DataFrame, sql: str = "query", time: str = "poll_time") -> DataFrame:
    """A change proposal per reviewed statement."""
    indexed = F.col("index_ddl").isNotNull()
    return linted.select(
        "database_id",
        F.format_string("Optimization for query (impact %d/100)", "impact_score").alias("title"),
        F.when(indexed, "index").otherwise("query_rewrite").alias("proposal_type"),
        F.lit("proposed").alias("state"),
        F.col(sql).alias("original_sql"),
        F.when(indexed, F.array("index_ddl")).otherwise(F.array().cast("array<string>")).alias("ddl_statements"),
        F.when(indexed, F.lit(float(K.LINT_IMPROVEMENT))).alias("estimated_improvement_pct"),
        F.col("impact_score").cast("double").alias("estimated_impact_score"),
        F.col(time).alias("created_at"),
    )
