"""Corpora of EXPLAIN documents: nodes, totals, findings, index candidates, summaries.

A document is one row, and so is its tree: one Arrow pass reads each document and walks its nodes with a stack, so
the whole analysis is a single narrow pass without a shuffle, linear in the text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import constants as K
from fleetlens.functions.common import fixed_text
from fleetlens.session import map_arrow

# Field of a plan document -> (column, type, default).
FIELDS = [
    ("Node Type", "node_type", "string", "Unknown"),
    ("Relation Name", "relation_name", "string", None),
    ("Alias", "alias", "string", None),
    ("Index Name", "index_name", "string", None),
    ("Join Type", "join_type", "string", None),
    ("Startup Cost", "startup_cost", "double", 0.0),
    ("Total Cost", "total_cost", "double", 0.0),
    ("Plan Rows", "plan_rows", "bigint", 0),
    ("Actual Rows", "actual_rows", "bigint", 0),
    ("Actual Total Time", "actual_time_ms", "double", 0.0),
    ("Actual Loops", "loops", "bigint", 1),
    ("Shared Hit Blocks", "shared_hit_blocks", "bigint", 0),
    ("Shared Read Blocks", "shared_read_blocks", "bigint", 0),
    ("Temp Read Blocks", "temp_read_blocks", "bigint", 0),
    ("Temp Written Blocks", "temp_written_blocks", "bigint", 0),
    ("I/O Read Time", "io_read_ms", "double", 0.0),
    ("I/O Write Time", "io_write_ms", "double", 0.0),
    ("Filter", "filter_condition", "string", None),
    ("Rows Removed by Filter", "rows_removed_by_filter", "bigint", 0),
]
#: Fields that findings, index candidates and summaries read.
FOR_FINDINGS = ("node_type", "relation_name", "total_cost", "plan_rows", "actual_rows")
FOR_CANDIDATES = ("node_type", "relation_name", "actual_rows", "rows_removed_by_filter", "filter_condition")
FOR_SUMMARIES = tuple(dict.fromkeys((*FOR_FINDINGS, *FOR_CANDIDATES, "shared_hit_blocks", "shared_read_blocks")))
#: Text bytes of documents that a task works on at a time; one longer document is worked on alone.
PIECE_BYTES = 4 << 20
ARROW = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}
KINDS = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType()}


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def _double(v) -> float | None:
    try:
        return None if v is None or isinstance(v, (bool, dict, list)) else float(v)
    except (ValueError, OverflowError):
        return None


def _whole(v) -> int | None:
    try:
        n = None if v is None or isinstance(v, (bool, dict, list)) else int(v)
    except (ValueError, OverflowError):
        return None
    return n if n is None or -(1 << 63) <= n < 1 << 63 else None


READ = {"string": _text, "double": _double, "bigint": _whole}


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


class _Walk:
    """Nodes of each document in document order, each visited once with a stack of its own; a row is one document."""

    def __init__(self, doc: str, kept: list[str], fields: list[tuple]):
        self.doc, self.kept, self.fields = doc, kept, fields

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size = 0, 0
            texts = batch.column(self.doc).to_pylist()
            for i, text in enumerate(texts):
                size += len(text or "")
                if size > PIECE_BYTES and i > start:
                    yield self.piece(batch.slice(start, i - start), texts[start:i])
                    start, size = i, len(text or "")
            yield self.piece(batch.slice(start), texts[start:])

    def piece(self, batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        ends, paths, parents, depths = [0], [], [], []
        values = [[] for _ in self.fields]
        planning, execution, broken = [], [], []
        readers = [(name, READ[kind], default, column.append) for (name, _, kind, default), column in zip(self.fields, values)]
        for text in texts:
            try:
                whole = json.loads(text, parse_constant=_no_number) if text is not None else None
            except (ValueError, RecursionError):
                text = None
            broken.append(text is None)
            if text is None:
                planning.append(None)
                execution.append(None)
                ends.append(len(paths))
                continue
            if isinstance(whole, list):
                whole = whole[0] if whole else None
            top = whole if isinstance(whole, dict) else {}
            times = [_double(top.get(name)) for name in ("Planning Time", "Execution Time")]
            planning.append(times[0] or 0.0)
            execution.append(times[1] or 0.0)
            stack = [("0", None, 0, top.get("Plan"))]
            while stack:
                path, parent, depth, node = stack.pop()
                if not isinstance(node, dict):
                    node = {}
                paths.append(path)
                parents.append(parent)
                depths.append(depth)
                for name, read, default, add in readers:
                    v = read(node.get(name))
                    add(default if v is None else v)
                below = node.get("Plans")
                if isinstance(below, list):
                    stack += [(f"{path}.{i}", path, depth + 1, below[i]) for i in range(len(below) - 1, -1, -1)]
            ends.append(len(paths))
        columns = {"path": pa.array(paths, pa.string()), "parent_path": pa.array(parents, pa.string()), "depth": pa.array(depths, pa.int32())}
        columns |= {column: pa.array(v, ARROW[kind]) for (_, column, kind, _), v in zip(self.fields, values)}
        nodes = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)), mask=pa.array(broken, pa.bool_()))
        made = [nodes, pa.array(planning, pa.float64()), pa.array(execution, pa.float64()), pa.array(broken, pa.bool_())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in self.kept), *made], names=[*self.kept, *MADE])


MADE = ["nodes", "planning_time_ms", "execution_time_ms", "parse_error"]


def parse_plans(df: DataFrame, doc: str = "plan_json", fields: Sequence[str] | None = None) -> DataFrame:
    """Add `nodes` (in document order), `planning_time_ms`, `execution_time_ms`, `parse_error`.

    A document is an object or a list whose first element counts; it is parsed once and each of its nodes is visited once,
    so the work grows with the document, however deep or wide it is. Only `fields` (columns of `FIELDS`, all by
    default) are read. Broken JSON gives no nodes and `parse_error`.
    """
    read = [f for f in FIELDS if fields is None or f[1] in fields]
    kept = [c for c in df.columns if c not in MADE]
    node = T.StructType([T.StructField("path", T.StringType()), T.StructField("parent_path", T.StringType()), T.StructField("depth", T.IntegerType())])
    for _, column, kind, _ in read:
        node.add(column, KINDS[kind])
    schema = T.StructType([df.schema[c] for c in kept] + [
        T.StructField("nodes", T.ArrayType(node)), T.StructField("planning_time_ms", T.DoubleType()), T.StructField("execution_time_ms", T.DoubleType()),
        T.StructField("parse_error", T.BooleanType())])
    return map_arrow(df.select(*kept), _Walk(doc, kept, read), schema)


def estimate_error(n: Column) -> Column:
    gap = F.abs(n["actual_rows"] - n["plan_rows"])
    return F.coalesce(gap / F.nullif(n["plan_rows"], F.lit(0)), F.lit(0.0))


def is_seq_scan(n: Column) -> Column:
    return n["node_type"] == "Seq Scan"


def flatten_plans(parsed: DataFrame, key: str = "plan_id") -> DataFrame:
    """One row per node with the metrics that the parsed fields allow; `root_cost` is the cost of the node's whole plan."""
    costs = "total_cost" in {f.name for f in parsed.schema["nodes"].dataType.elementType.fields}
    root = [F.get("nodes", F.lit(0))["total_cost"].alias("root_cost")] if costs else []
    flat = parsed.where(~F.col("parse_error")).select(key, *root, F.explode("nodes").alias("n"))
    n = F.col("n")
    have = {f.name for f in parsed.schema["nodes"].dataType.elementType.fields}
    derived = {
        "cost_score": (("total_cost", "loops"), lambda: n["total_cost"] * F.greatest(F.lit(1), n["loops"])),
        "row_estimate_error": (("plan_rows", "actual_rows"), lambda: estimate_error(n)),
        "is_seq_scan": (("node_type",), lambda: is_seq_scan(n)),
        "is_problematic": (("node_type", "plan_rows", "actual_rows", "rows_removed_by_filter", "shared_read_blocks"), lambda: (
            is_seq_scan(n) | (estimate_error(n) > 10) | (n["rows_removed_by_filter"] > 1000) | (n["shared_read_blocks"] > 1000))),
    }
    return flat.select(
        key, *(["root_cost"] if "total_cost" in have else []),
        *[n[c].alias(c) for c in ("path", "parent_path", "depth")],
        *[n[c].alias(c) for _, c, _, _ in FIELDS if c in have],
        *[make().alias(name) for name, (needs, make) in derived.items() if have.issuperset(needs)],
    )


def plan_totals(parsed: DataFrame, key: str = "plan_id") -> DataFrame:
    """Whole-plan figures from the root node."""
    root = F.get("nodes", F.lit(0))
    return parsed.where(~F.col("parse_error")).select(
        key, root["total_cost"].alias("total_cost"),
        (root["actual_time_ms"] * root["loops"]).alias("total_time_ms"),
        "planning_time_ms", "execution_time_ms",
        root["shared_hit_blocks"].alias("shared_hit_blocks"),
        root["shared_read_blocks"].alias("shared_read_blocks"),
        F.size("nodes").alias("node_count"),
    )


def _reported_scan(n: Column) -> Column:
    return is_seq_scan(n) & (n["actual_rows"] > 500)


def _bad_estimate(n: Column) -> Column:
    return (estimate_error(n) > 10) & (n["actual_rows"] > 100)


def plan_findings(nodes: DataFrame) -> DataFrame:
    """Rows of `flatten_plans` that are a finding, one row per finding kind."""
    n = {c: F.col(c) for c in nodes.columns}
    kinds = F.array_compact(F.array(
        F.when(_reported_scan(n), "seq_scan"),
        F.when(_bad_estimate(n), "bad_estimate"),
        F.when(F.col("total_cost") > F.col("root_cost") * 0.5, "high_cost"),
    ))
    return nodes.withColumn("finding", F.explode_outer(kinds)).where(F.col("finding").isNotNull())


def filter_columns(condition: Column, fixed: bool = False) -> Column:
    """Up to four column names of a plan filter, duplicates kept."""
    pattern = K.PLAN_COLUMN_FIXED if fixed else K.PLAN_COLUMN
    names = F.regexp_extract_all(condition, F.lit("(?iU)" + pattern), 1)
    return F.slice(F.filter(names, lambda c: ~F.lower(c).isin(K.PLAN_NOT_COLUMNS)), 1, 4)


def _candidate_columns(n: Column, fixed: bool) -> Column:
    on = _reported_scan(n) & (n["rows_removed_by_filter"] > 100) & n["filter_condition"].isNotNull()
    return F.when(on, filter_columns(n["filter_condition"], fixed))


def index_candidates(nodes: DataFrame, key: str = "plan_id", fixed: bool = False) -> DataFrame:
    """Scans whose filter drops many rows, with the columns an index would need."""
    n = {c: F.col(c) for c in nodes.columns}
    return nodes.withColumn("columns", _candidate_columns(n, fixed)).where(F.size("columns") > 0).select(
        key, "path", F.col("relation_name").alias("table_name"), "columns",
        F.concat(F.lit("Filter removes "), F.col("rows_removed_by_filter").cast("string"), F.lit(" rows")).alias("reason"),
    )


def candidate_rollup(candidates: DataFrame) -> DataFrame:
    """How often the corpus asks for each (table, columns) index."""
    return candidates.groupBy("table_name", F.array_join("columns", ", ").alias("columns")).agg(
        F.count(F.lit(1)).alias("plans")
    )


def plan_summaries(parsed: DataFrame, key: str = "plan_id", fixed: bool = False) -> DataFrame:
    """A short text per plan, built inside the row from its own nodes."""
    nodes = F.col("nodes")
    totals = parsed.where(~F.col("parse_error")).select(
        key, "planning_time_ms", "execution_time_ms",
        F.get(nodes, F.lit(0)).alias("root"),
        F.filter(nodes, _reported_scan).alias("scans"),
        F.filter(nodes, _bad_estimate).alias("bad"),
        F.filter(
            F.transform(nodes, lambda n: F.struct(
                n["relation_name"].alias("t"),
                F.coalesce(_candidate_columns(n, fixed), F.array().cast("array<string>")).alias("c"),
            )),
            lambda x: F.size(x["c"]) > 0,
        ).alias("wanted"),
    )
    # The lines of a summary, here and below.
    name = lambda c: F.coalesce(c, F.lit("None"))
    scan_lines = F.transform(F.slice("scans", 1, 5), lambda n: F.format_string(
        "  - %s (actual_rows=%d, cost=%s, filter_removed=%d)",
        name(n["relation_name"]), n["actual_rows"], fixed_text(n["total_cost"], 1), n["rows_removed_by_filter"],
    ))
    bad_lines = F.transform(F.slice("bad", 1, 3), lambda n: F.format_string(
        "  - %s on %s: estimated=%d actual=%d",
        n["node_type"], name(n["relation_name"]), n["plan_rows"], n["actual_rows"],
    ))
    index_lines = F.transform(F.slice("wanted", 1, 5), lambda x: F.concat(
        F.lit("  - "), name(x["t"]), F.lit(".("), F.array_join(x["c"], ", "), F.lit(")")
    ))
    none = F.array().cast("array<string>")

    def section(items: str, title: Column, lines: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.array(title), lines)).otherwise(none)

    lines = F.concat(
        F.array(
            F.concat(F.lit("Execution time: "), fixed_text(F.col("execution_time_ms"), 1), F.lit("ms")),
            F.concat(F.lit("Planning time: "), fixed_text(F.col("planning_time_ms"), 1), F.lit("ms")),
            F.concat(F.lit("Total cost: "), fixed_text(F.col("root.total_cost"), 1)),
            F.format_string("Buffer hits: %d, reads: %d", F.col("root.shared_hit_blocks"), F.col("root.shared_read_blocks")),
            F.lit(""),
        ),
        section("scans", F.format_string("SEQ SCANS (%d):", F.size("scans")), scan_lines),
        section("bad", F.format_string("\nBAD ROW ESTIMATES (%d):", F.size("bad")), bad_lines),
        section("wanted", F.lit("\nINDEX CANDIDATES:"), index_lines),
    )
    summary = totals.select(key, F.array_join(lines, "\n").alias("summary"))
    # The summary's own words decide: a scan among the bad estimates counts, and so does a table of that name.
    return summary.withColumn("has_seq_scan", F.lower("summary").contains("seq scan"))
