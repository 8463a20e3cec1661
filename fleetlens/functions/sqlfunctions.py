"""The statement functions as SQL-callable temporary functions with expression bodies."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fleetlens import constants as K


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, {_text(pattern)}, {_text(to)})"


def _canonical(text: str) -> str:
    out = _replaced(text, r"(?U)^\s+|\s+$", "")
    for pattern, to in (
        (K.LINE_COMMENT, ""), (K.BLOCK_COMMENT, ""), (K.STRING_LITERAL, "?"), (K.IN_LIST, "IN (?)"),
        (K.NUMBER_LITERAL, "?"), (r"(?U)\s+", " "),
    ):
        out = _replaced(out, pattern, to)
    return f"upper({_replaced(out, r'(?U)^\s+|\s+$', '')})"


def _pattern(s: str) -> str:
    def has(p: str) -> str:
        return f"{s} RLIKE {_text(p)}"

    values = f"(length({s}) - length(replace({s}, '(?) ', ''))) / 4 > 5"
    return (
        f"CASE WHEN {has(K.DDL_HEAD)} THEN 'ddl' WHEN {has(K.INSERT_HEAD)} AND {values} THEN 'batch_insert' "
        f"WHEN {has(K.POINT_HEAD)} AND {has(K.WHERE_WORD)} AND NOT {has(K.GROUPING_WORD)} AND NOT {has(K.TWO_JOINS)} "
        f"THEN 'oltp_point' WHEN {has(K.AGGREGATE_WORD)} THEN 'olap_scan' ELSE 'unknown' END"
    )


def functions() -> dict[str, str]:
    """Name and body of each function."""
    return {
        "normalize_sql(stmt STRING) RETURNS STRING": _canonical("stmt"),
        "access_pattern(canonical STRING) RETURNS STRING": _pattern("canonical"),
        "fingerprint_distance(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
        "fingerprint_similar(a BIGINT, b BIGINT) RETURNS BOOLEAN": "bit_count(a ^ b) < 8",
        "fingerprint_hex(a BIGINT) RETURNS STRING": "lower(lpad(hex(a), 16, '0'))",
        "utilisation_pct(active DOUBLE, maximum DOUBLE) RETURNS DOUBLE":
            "CASE WHEN maximum > 0 THEN active / maximum * 100 ELSE 0D END",
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for head, body in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in functions()]
