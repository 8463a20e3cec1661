"""Small column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside `body`."""
    return F.transform(F.array(value), body)[0]


def or_default(value: Column, default) -> Column:
    """`default` for NULL and for zero alike."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


def occurrences(text: Column, piece: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece)))) / len(piece)).cast("int")


def json_string(text: Column) -> Column:
    """A JSON string literal with ASCII-safe common escapes; NULL gives null."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(code))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def week_aligned_start(bucket_seconds: int) -> int:
    """Offset from 1970-01-01 of buckets aligned to Monday 2000-01-03."""
    return 946_857_600 % bucket_seconds


def bucket_start(time: Column, bucket_seconds: int) -> Column:
    """Start of the bucket that holds `time`, aligned to Monday 2000-01-03."""
    window = F.window(
        time, f"{bucket_seconds} seconds", None, f"{week_aligned_start(bucket_seconds)} seconds"
    )
    return window.getField("start")


def fixed_text(value: Column, digits: int) -> Column:
    """`value` with a fixed number of digits, rounded half to even on its exact binary value.

    `format_string` rounds the shortest decimal form half up, which differs for values such as 0.25
    and 0.35. The fraction is scaled by 2**60 (exact), so the rest decides the rounding exactly.
    """
    whole = F.floor(F.abs(value))
    part = ((F.abs(value) - whole) * float(2**60)).cast("bigint").cast("decimal(38,0)") * 10**digits
    unit, half = F.lit(2**60).cast("decimal(38,0)"), F.lit(2**59).cast("decimal(38,0)")
    low = F.floor(part / unit).cast("bigint") if digits else F.lit(0).cast("bigint")
    rest = part - low.cast("decimal(38,0)") * unit
    down = whole.cast("bigint") * 10**digits + low
    up = (rest > half) | ((rest == half) & (down % 2 == 1))
    scaled = down + F.when(up, 1).otherwise(0)
    text = F.floor(scaled / 10**digits).cast("bigint").cast("string") if digits else scaled.cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((scaled % 10**digits).cast("string"), digits, "0"))
    return F.concat(F.when(value < 0, "-").otherwise(""), text)


END_MARK = "end-of-fleetlens-document"


def whole_json(text: Column) -> Column:
    """The text as a VARIANT if all of it is one JSON value, else NULL.

    The parser itself stops after a first complete value and ignores the rest. So the text is parsed
    as the first of two entries, and only a parse that also reaches the second has read all of it.
    """
    wrapped = F.try_parse_json(F.concat(F.lit('[{"v":'), text, F.lit('},"' + END_MARK + '"]')))

    def value(v: Column) -> Column:
        complete = F.try_variant_get(v, "$[1]", "string") == END_MARK
        return F.when(complete, F.try_variant_get(v, "$[0].v", "variant"))

    return bind(wrapped, value)
