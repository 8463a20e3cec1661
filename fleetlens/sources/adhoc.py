"""Ad-hoc read-only SQL over the store's tables."""

from __future__ import annotations

import re
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.sqltext import safe_select

#: Calls take turns at the session's setting, so that none puts back what another has set.
TURN = threading.Lock()
#: Functions that reach into the JVM; no statement may name one.
REACHING = re.compile(r"\b(reflect|try_reflect|java_method)\b", re.I)


def run_readonly(spark: SparkSession, sql: str, args: dict | None = None, limit: int = 100) -> DataFrame:
    """Run one SELECT that passes the gate; at most `limit` rows come back."""
    # The gate is a column expression; one literal row asks it about this statement.
    safe = spark.range(1).select(safe_select(F.lit(sql), limit).alias("s")).first()["s"]
    if safe is None:
        raise ValueError("not a single read-only SELECT")
    if REACHING.search(sql):
        raise ValueError("functions that reach into the JVM are not allowed")
    # Only registered tables may be read: a path in place of a name does not resolve.
    with TURN:
        files = spark.conf.get("spark.sql.runSQLOnFiles", "true")
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
        try:
            return spark.sql(safe, args=args or {}).limit(limit)
        finally:
            spark.conf.set("spark.sql.runSQLOnFiles", files)
