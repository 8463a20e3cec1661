"""Free text as columns: JSON recovery, question intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.common import whole_json


def json_text(raw: Column) -> Column:
    """Text from the first brace or bracket on, code fences dropped; NULL without one."""
    text = F.regexp_replace(F.regexp_replace(raw, r"(?U)```json\s*", ""), r"(?U)```\s*", "")
    start = F.least(
        F.nullif(F.locate("{", text), F.lit(0)), F.nullif(F.locate("[", text), F.lit(0))
    )
    return F.when(start.isNotNull(), F.substring(text, start, F.length(text)))


def json_from_text(raw: Column) -> Column:
    """The JSON value inside free text as a VARIANT, NULL where none parses (keep the raw text then)."""
    return whole_json(json_text(raw))


# Intent words in order of precedence.
ALERT_WORDS = ["alert", "security", "injection", "anomal", "suspicious"]
SECURITY_WORDS = ["security", "injection", "suspicious"]
HEALTH_WORDS = ["health", "summary", "status", "how is", "overview"]
WHAT_IF_WORDS = ["what would happen", "what if", "simulate", "predict"]


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def intent(question: Column) -> Column:
    """Which stored answer a question asks for; "none" when it asks for none of them."""
    q = F.lower(question)
    slow = (q.contains("slow") & (q.contains("quer") | q.contains("sql"))) | q.contains("slowest")
    return (
        F.when(slow, "slow_queries")
        .when(q.contains("connection"), "connections")
        .when(q.contains("cache"), "cache")
        .when(q.contains("lock"), "locks")
        .when(_any(q, SECURITY_WORDS), "security_alerts")
        .when(_any(q, ALERT_WORDS), "alerts")
        .when(_any(q, HEALTH_WORDS), "health")
        .otherwise("none")
    )


def is_what_if(question: Column) -> Column:
    return _any(F.lower(question), WHAT_IF_WORDS)


def requested_rows(question: Column) -> Column:
    """First whole number in the question held within 1..25, default 5."""
    digits = F.regexp_extract(F.lower(question), r"(?U)\b(\d+)\b", 1)
    significant = F.regexp_replace(digits, "^0+", "")
    number = F.when(F.length(significant) > 2, 25).otherwise(
        F.coalesce(F.nullif(significant, F.lit("")), F.lit("0")).try_cast("int")
    )
    return F.when(digits == "", 5).otherwise(F.greatest(F.lit(1), F.least(F.lit(25), number)))
