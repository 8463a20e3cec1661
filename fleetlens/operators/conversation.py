"""Questions and requests as tables: batches, memoised evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import scan


def batch_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], text: Callable[[Column], Column],
    size: int = 20, pieces: int | None = None,
) -> DataFrame:
    """Groups of `size` consecutive rows per key; `text` gets the number of a row within its group."""
    placed = scan.ordinal(df, keys, order, pieces)
    place = F.col("_pos") - 1
    numbered = placed.select(
        *keys, F.floor(place / size).cast("bigint").alias("batch"), (place % size + 1).cast("int").alias("_i"),
        text((place % size + 1).cast("int").cast("string")).alias("_t"),
    )
    lines = F.array_sort(F.collect_list(F.struct("_i", "_t")))  # `size` entries at most
    return numbered.groupBy(*keys, "batch").agg(
        F.count(F.lit(1)).cast("int").alias("rows"),
        F.array_join(F.transform(lines, lambda x: x["_t"]), "\n").alias("body"),
    )


def number_text(value: Column) -> Column:
    """A positive double as its shortest decimal text, without an exponent."""
    long_form = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"0{1,5}$", "")
    return F.coalesce(F.when(value >= 1e7, long_form).otherwise(value.cast("string")), F.lit("?"))


# The texts of a batch.
QUERY_HEAD, QUERY_MEAN, QUERY_OPEN, QUERY_SHUT = "QUERY ", " (avg ", "ms):\n```sql\n", "\n```"
BATCH_HEAD, BATCH_KIND = "Analyze these ", " slow {} queries as a batch.\n\n"
BATCH_TAIL = "\n\nReturn a JSON array with one optimization object per query, same schema as single-query analysis."


def query_text(number: Column, mean_ms: Column, normalized: Column) -> Column:
    """One statement of a batch."""
    return F.concat(
        F.lit(QUERY_HEAD), number, F.lit(QUERY_MEAN), number_text(mean_ms), F.lit(QUERY_OPEN), F.coalesce(normalized, F.lit("")), F.lit(QUERY_SHUT)
    )


def query_batch_text(n: Column, body: Column, db_type: str = "postgresql") -> Column:
    """Heading and closing line around a batch body."""
    return F.concat(F.lit(BATCH_HEAD), n.cast("string"), F.lit(BATCH_KIND.format(db_type)), body, F.lit(BATCH_TAIL))


def request_key(system: Column, prompt: Column) -> Column:
    return F.md5(F.concat(system, F.lit(":"), prompt))


def evaluate_once(
    df: DataFrame, system: Column, prompt: Column, evaluate: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Evaluate each distinct request once and hand the answer to all its copies.

    `evaluate` gets (request_key, system, prompt) and returns (request_key, answer). Copies of one
    request meet a single answer row, which the skew join splits freely.
    """
    keyed = df.withColumn("request_key", request_key(system, prompt))
    distinct = keyed.groupBy("request_key").agg(
        F.any_value(system).alias("system"), F.any_value(prompt).alias("prompt")
    )
    return keyed.join(evaluate(distinct), "request_key", "left")
