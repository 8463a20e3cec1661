"""Ordered work per key by a scan over pieces: one plan, whatever the keys and their sizes.

A window over a key sorts the whole key in one task. Here rows are dealt by range of (key, order, tie), so
every piece has about the same number of rows and a hot key, or a hot time stamp, simply spans more pieces.
The dealt rows are written once, each with the number of its piece. Then

1. one small summary row is aggregated for each key in a piece,
2. a carry runs over the summaries of a key, in the order of the pieces,
3. one local pass per (piece, key) starts from the carry; frames read the tails of the pieces before.

A key has as many summaries as pieces, so the carry stays small. There is no size to choose by and no limit on
the number of pieces; it follows from the bytes read. `order` has to tell all rows of a key apart, but for rows
that may trade places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage, input_bytes

#: Input bytes a piece is dealt for.
PIECE_BYTES = 64 << 20


def lay_out(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], pieces: int | None = None) -> DataFrame:
    """`df`, dealt by range of key and order and written, with `_piece`: pieces follow each other in that order."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = pieces or max(least, input_bytes(df) // PIECE_BYTES + 1)
    by = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in (*keys, *order)]
    return cut_lineage(df.repartitionByRange(n, *by).withColumn("_piece", F.spark_partition_id()), "pieces")


def local(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy("_piece", *keys).orderBy(*order)


def earlier(keys: Sequence[str]) -> WindowSpec:
    """Over summaries: the pieces of the key before this one."""
    return Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)


def attach(rows: DataFrame, summaries: DataFrame, by: Sequence[str]) -> DataFrame:
    """`rows` with the columns of their summary; null keys have theirs too."""
    renamed = summaries.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = [F.col(f"_at.{c}").eqNullSafe(F.col(f"_of_{c}")) for c in by]
    return rows.alias("_at").join(renamed, same, "left").drop(*[f"_of_{c}" for c in by])


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], pieces: int | None = None) -> DataFrame:
    """Add `_pos`: the 1-based place of the row inside its key."""
    laid = lay_out(df, keys, order, pieces)
    sizes = laid.groupBy("_piece", *keys).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_piece", *keys, F.coalesce(F.sum("_size").over(earlier(keys)), F.lit(0)).alias("_before"))
    numbered = attach(laid.withColumn("_rn", F.row_number().over(local(keys, order))), before, ["_piece", *keys])
    return numbered.withColumn("_pos", F.col("_rn") + F.col("_before")).drop("_rn", "_before", "_piece")


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, pieces: int | None = None) -> DataFrame:
    """Add `out`: the latest non-null `value` on an earlier row of the key."""
    laid = lay_out(df.withColumn("_v", value), keys, order, pieces)
    spot = F.when(F.col("_v").isNotNull(), F.struct(*order))
    ends = laid.groupBy("_piece", *keys).agg(F.max_by("_v", spot).alias("_last"))
    carry = ends.select("_piece", *keys, F.last("_last", True).over(earlier(keys)).alias("_carry"))
    w = local(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    joined = attach(laid.withColumn("_in", F.last("_v", True).over(w)), carry, ["_piece", *keys])
    return joined.withColumn(out, F.coalesce("_in", "_carry")).drop("_v", "_in", "_carry", "_piece")


#: Running totals: how a window makes them, and what two of them give.
TOTALS = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0),
}


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], totals: dict[str, tuple[str, str]], pieces: int | None = None,
) -> DataFrame:
    """Add for each name a running total over the key, the row included: (kind of `TOTALS`, whole-number column)."""
    laid = lay_out(df, keys, order, pieces)
    ends = laid.groupBy("_piece", *keys).agg(*[TOTALS[kind][0](c).alias(f"_t_{name}") for name, (kind, c) in totals.items()])
    carry = ends.select("_piece", *keys, *[
        F.coalesce(TOTALS[kind][0](f"_t_{name}").over(earlier(keys)), F.lit(TOTALS[kind][2])).alias(f"_c_{name}")
        for name, (kind, _) in totals.items()
    ])
    w = local(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = laid.select("*", *[F.coalesce(TOTALS[kind][0](c).over(w), F.lit(TOTALS[kind][2])).alias(f"_i_{name}") for name, (kind, c) in totals.items()])
    joined = attach(inside, carry, ["_piece", *keys])
    made = {name: TOTALS[kind][1](F.col(f"_c_{name}"), F.col(f"_i_{name}")) for name, (kind, _) in totals.items()}
    return joined.withColumns(made).drop("_piece", *[f"{x}{name}" for name in totals for x in ("_c_", "_i_")])


def with_tails(df: DataFrame, keys: Sequence[str], order: Sequence[str], reach: int, pieces: int | None = None) -> tuple[DataFrame, list[str]]:
    """Rows and the columns to group them by, where each group also has the `reach` rows before it, marked `_halo`.

    A tail row at place p is read by the pieces that start in (p, p + reach]. Starts and tails meet on blocks of
    `reach` places, so a row meets the few pieces it may reach, however many its key has.
    """
    laid = lay_out(df, keys, order, pieces)
    sizes = laid.groupBy("_piece", *keys).agg(F.count(F.lit(1)).alias("_size"))
    spans = sizes.select("_piece", *keys, F.coalesce(F.sum("_size").over(earlier(keys)), F.lit(0)).alias("_start"), "_size")
    rows = laid.withColumn("_halo", F.lit(False))
    if reach < 1:
        return rows, ["_piece", *keys]
    back = Window.partitionBy("_piece", *keys).orderBy(*[F.desc(c) for c in order])
    tails = attach(laid.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= reach), spans, ["_piece", *keys])
    tails = tails.withColumn("_p", F.col("_start") + F.col("_size") - F.col("_back"))
    tails = tails.withColumn("_block", F.explode(F.array(F.expr(f"_p div {reach}"), F.expr(f"_p div {reach} + 1"))))
    starts = spans.where("_start > 0").select(
        F.col("_piece").alias("_target"), *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_start").alias("_s"), F.expr(f"_start div {reach}").alias("_of_block"))
    near = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_block") == F.col("_of_block")]
    met = tails.join(starts, near).where((F.col("_s") > F.col("_p")) & (F.col("_s") - F.col("_p") <= reach))
    halo = met.withColumn("_piece", F.col("_target")).withColumn("_halo", F.lit(True)).select(*rows.columns)
    return rows.unionByName(halo), ["_piece", *keys]


def rolling_moments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], frame: int, columns: Sequence[str], pieces: int | None = None,
) -> DataFrame:
    """Add `mean_<c>`, `dev_<c>` (sample deviation) and `_seen` over the last `frame` rows of the key.

    Rows are cut into blocks of `frame`. A frame is the tail of one block and the head of the next:
    running aggregates up and down each block give both, and their moments merge. A row costs a few
    steps instead of `frame`, and nothing is ever subtracted, so no digits cancel.
    """
    rows, by = with_tails(df, keys, order, frame - 1, pieces)
    key, up, down = ", ".join(by), ", ".join(order), ", ".join(f"{c} DESC" for c in order)
    whole = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

    def moments(c: str, direction: str) -> str:
        over = f"OVER (PARTITION BY {key}, _block ORDER BY {direction} {whole})"
        return f"named_struct('n', cast(count({c}) {over} AS double), 'm', avg({c}) {over}, 'v', var_pop({c}) {over})"

    # Head and tail of the frame, missing parts as zeros.
    def part(c: str, name: str, field: str) -> str:
        return f"coalesce({name}{c}.{field}, 0D) AS {field}{1 if name == '_head_' else 2}_{c}"

    rows = rows.selectExpr("*", f"row_number() OVER (PARTITION BY {key} ORDER BY {up}) - 1 AS _rn")
    rows = rows.selectExpr("*", f"_rn div {frame} AS _block")
    rows = rows.selectExpr("*", "named_struct('block', _block, " + ", ".join(f"'{c}', {moments(c, down)}" for c in columns) + ") AS _tail")
    rows = rows.selectExpr("*", *[f"{moments(c, up)} AS _head_{c}" for c in columns])
    rows = rows.selectExpr("* EXCEPT (_tail)", f"lag(_tail, {frame - 1}) OVER (PARTITION BY {key} ORDER BY {up}) AS _lag")
    rows = rows.selectExpr("*", "CASE WHEN _lag.block <> _block THEN _lag END AS _tail")
    rows = rows.selectExpr("*", *[
        part(c, name, field) for c in columns for name in ("_head_", "_tail.") for field in ("n", "m", "v")
    ])
    out = rows.selectExpr(
        "*", f"least(_rn + 1, {frame}) AS _seen",
        *[f"try_divide(m1_{c} * n1_{c} + m2_{c} * n2_{c}, n1_{c} + n2_{c}) AS mean_{c}" for c in columns],
        *[
            f"sqrt(try_divide(v1_{c} * n1_{c} + v2_{c} * n2_{c}"
            f" + coalesce(try_divide((m1_{c} - m2_{c}) * (m1_{c} - m2_{c}) * n1_{c} * n2_{c}, n1_{c} + n2_{c}), 0D),"
            f" nullif(greatest(n1_{c} + n2_{c} - 1, 0D), 0D))) AS dev_{c}"
            for c in columns
        ],
    )
    added = ["_seen", *[f"{m}_{c}" for m in ("mean", "dev") for c in columns]]
    return out.where(~F.col("_halo")).select(*df.columns, *added)
