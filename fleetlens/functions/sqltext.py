"""Statement text as columns: canonical form, fingerprint, access pattern, features, safety gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens import constants as K
from fleetlens.functions.common import bind, occurrences


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_sql(sql: Column) -> Column:
    """Canonical statement: no comments, literals or runs of white space, in capitals.

    The order of the steps is part of the result: comments go before string literals.
    """
    text = F.regexp_replace(strip(sql), K.LINE_COMMENT, "")
    text = F.regexp_replace(text, K.BLOCK_COMMENT, "")
    text = F.regexp_replace(text, K.STRING_LITERAL, "?")
    text = F.regexp_replace(text, K.IN_LIST, "IN (?)")
    text = F.regexp_replace(text, K.NUMBER_LITERAL, "?")
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.upper(strip(text))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def token_hash(token: Column) -> Column:
    """Low 64 bits of the token's MD5 as a signed long."""
    def half(at: int) -> Column:
        return F.conv(F.substring(F.md5(token), at, 8), 16, 10).cast("bigint")

    return F.shiftleft(half(17), 32).bitwiseOR(half(25))


# Two 32-bit counters share one long: bit j counts in the low half, bit j + 32 in the high half.
LANES = 0x0000000100000001
LOW_LANE = 0xFFFFFFFF


def simhash64(normalized: Column) -> Column:
    """SimHash of a canonical statement as a signed long; repeated tokens count each time.

    A bit is set where more than half of the token hashes have it.
    """
    def lanes(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda j: F.aggregate(
                hashes,
                F.lit(0).cast("bigint"),
                lambda a, h: a + F.call_function("shiftright", h, j).bitwiseAND(F.lit(LANES)),
            ),
        )

    def bit(ones: Column, total: Column, at: Column) -> Column:
        place = F.call_function("shiftleft", F.lit(1).cast("bigint"), at)
        return F.when(ones * 2 > total, place).otherwise(F.lit(0).cast("bigint"))

    def bits(hashes: Column) -> Column:
        n = F.size(hashes).cast("bigint")
        pairs = F.transform(lanes(hashes), lambda lane, j: bit(lane.bitwiseAND(F.lit(LOW_LANE)), n, j).bitwiseOR(
            bit(F.shiftrightunsigned(lane, 32), n, j + F.lit(32))
        ))
        return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))

    return bind(F.transform(tokens(normalized), token_hash), bits)


def lane_sums(hashed: str = "_h") -> list[str]:
    """SQL aggregates _l0 … _l31 over token hash rows: 32 sums that hold 64 bit counters."""
    return [f"sum(shiftright({hashed}, {j}) & {LANES}L) AS _l{j}" for j in range(32)]


def lane_bits(total: str = "_n") -> str:
    """SQL expression of the SimHash over columns _l0 … _l31 and the number of hashes."""
    low = [f"if((_l{j} & {LOW_LANE}L) * 2 > {total}, shiftleft(1L, {j}), 0L)" for j in range(32)]
    high = [f"if(shiftrightunsigned(_l{j}, 32) * 2 > {total}, shiftleft(1L, {j + 32}), 0L)" for j in range(32)]
    return " | ".join(low + high)


def hex16(fingerprint: Column) -> Column:
    """Fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similar(a: Column, b: Column, threshold: int = 8) -> Column:
    return hamming(a, b) < threshold


def access_pattern(normalized: Column, fallback: Column | None = None, canonical: bool = False) -> Column:
    """First rule that applies; `fallback` (a model's answer) replaces "unknown" where given.

    `canonical` says that the text comes from `normalize_sql` and is trimmed and in capitals already.
    """
    sql = normalized if canonical else F.upper(strip(normalized))
    many_values = occurrences(sql, "(?) ") > 5
    point = (
        sql.rlike(K.POINT_HEAD) & sql.rlike(K.WHERE_WORD)
        & ~sql.rlike(K.GROUPING_WORD) & ~sql.rlike(K.TWO_JOINS)
    )
    return (
        F.when(sql.rlike(K.DDL_HEAD), "ddl")
        .when(sql.rlike(K.INSERT_HEAD) & many_values, "batch_insert")
        .when(point, "oltp_point")
        .when(sql.rlike(K.AGGREGATE_WORD), "olap_scan")
        .otherwise(F.coalesce(fallback, F.lit("unknown")) if fallback is not None else F.lit("unknown"))
    )


FEATURES = [
    "is_select", "is_insert", "is_update", "is_delete", "is_ddl", "n_join", "n_where", "n_group_by",
    "n_order_by", "n_limit", "n_having", "n_distinct", "n_union", "n_nested", "n_chars",
]


def features(normalized: Column) -> list[Column]:
    """The 15 numeric features of a canonical statement, in the order of FEATURES."""
    def head(pattern: str) -> Column:
        return normalized.rlike("^" + pattern).cast("double")

    heads = [head(w) for w in ("SELECT", "INSERT", "UPDATE", "DELETE", "(CREATE|DROP|ALTER)")]
    words = ["JOIN", "WHERE", "GROUP BY", "ORDER BY", "LIMIT", "HAVING", "DISTINCT", "UNION"]
    counts = [occurrences(normalized, w).cast("double") for w in words]
    tail = F.substring(normalized, F.lit(2), F.length(normalized))
    nested = occurrences(normalized, "SUBQUERY") + occurrences(tail, "SELECT")
    columns = [*heads, *counts, nested.cast("double"), F.length(normalized).cast("double")]
    return [c.alias(n) for c, n in zip(columns, FEATURES)]


def safe_select(sql: Column, limit: int = 100) -> Column:
    """The statement, with a row limit, if it is one read-only SELECT; else NULL."""
    text = strip(F.regexp_replace(strip(sql), ";+$", ""))
    low = F.lower(text)
    forbidden = r"(?iU)\b(" + "|".join(K.FORBIDDEN_WORDS) + r")\b"
    ok = (
        (text != "") & ~text.contains(";")
        & (low.startswith("select") | low.startswith("with")) & ~text.rlike(forbidden)
    )
    limited = F.when(low.rlike(r"(?U)\blimit\s+\d+"), text).otherwise(
        F.concat(text, F.lit(f" LIMIT {limit}"))
    )
    return F.when(ok, limited)
