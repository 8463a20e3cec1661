"""Security scan of statements: one pass, one event per matching pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as K
from fleetlens.functions.sqltext import strip
from fleetlens.operators.detectors import alert_rows

FLAGS = "(?iU)"


def _findings(values: list[Column]) -> Column:
    return F.array_compact(F.array(*values))


def injection_findings(sql: Column) -> Column:
    """Array of findings: names of the injection patterns that match."""
    return _findings([
        F.when(sql.rlike(FLAGS + p), F.struct(
            F.lit("critical").alias("severity"),
            F.lit("sql_injection_" + name).alias("kind"),
            F.lit("Potential SQL injection detected").alias("title"),
            F.lit(f"Pattern '{name}' matched in query").alias("description"),
        ))
        for name, p in K.INJECTION_PATTERNS.items()
    ])


def privilege_findings(sql: Column) -> Column:
    """One finding per matching privilege pattern; duplicates stay."""
    return _findings([
        F.when(sql.rlike(FLAGS + p), F.struct(
            F.lit("high").alias("severity"),
            F.lit("privilege_escalation_attempt").alias("kind"),
            F.lit("Privilege escalation attempt").alias("title"),
            F.lit("DDL affecting users/roles detected").alias("description"),
        ))
        for p in K.PRIVILEGE_PATTERNS
    ])


def sensitive_findings(sql: Column) -> Column:
    """One finding per sensitive table read by a SELECT * statement."""
    tables = F.regexp_extract_all(sql, F.lit(FLAGS + r"\bFROM\s+(\w+)\b"), 1)
    hits = F.filter(tables, lambda t: F.lower(t).isin(K.SENSITIVE_TABLES))
    found = F.transform(hits, lambda t: F.struct(
        F.lit("medium").alias("severity"),
        F.lit("sensitive_table_full_scan").alias("kind"),
        F.concat(F.lit("SELECT * on sensitive table '"), t, F.lit("'")).alias("title"),
        F.concat(F.lit("Unrestricted read on '"), t, F.lit("' — potential data exfiltration")).alias("description"),
    ))
    none = F.filter(found, lambda _: F.lit(False))
    return F.when(strip(sql).rlike(r"^(?iU)SELECT\s+\*"), found).otherwise(none)


def scan_statements(
    df: DataFrame, sql: str = "query", time: str = "poll_time", client_ip: str | None = None,
    keep: tuple[str, ...] = (), kinds: tuple[str, ...] = ("injection", "privilege", "sensitive"),
) -> DataFrame:
    """Security events of every statement in the shared alert shape. A single scan, no join."""
    text = F.col(sql)
    makers = {"injection": injection_findings, "privilege": privilege_findings, "sensitive": sensitive_findings}
    found = F.concat(*[makers[k](text) for k in kinds])
    # The outer form keeps the optimizer from matching every pattern twice to drop clean rows early.
    hits = df.where(F.coalesce(text, F.lit("")) != "").withColumn("_f", F.explode_outer(found))
    hits = hits.where(F.col("_f").isNotNull())
    return alert_rows(
        hits, F.col("_f.severity"), F.col("_f.kind"), F.col("_f.title"), F.col("_f.description"),
        sql=text, client_ip=F.col(client_ip) if client_ip else None, at=time, keep=keep,
    )
