"""Arrow batch helpers shared by the operators that run Python inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.session import map_arrow

#: Text bytes a task works on at a time; one longer text is worked on alone.
PIECE_BYTES = 1 << 20


def text_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text, 0 for null."""
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    return np.diff(offsets)


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most `limit` text bytes each, or one row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(text_lengths(batch.column(text)))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def strings(column: pa.Array) -> list[str]:
    """Texts as Python strings, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as the empty string."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def annotate(
    docs: DataFrame, text: str, fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list | None]], keep: list[str] | None = None,
) -> DataFrame:
    """`keep` (or all) columns of `docs` plus `fields`, computed from slices of Arrow batches in one narrow pass.

    `make()` runs once in each task and returns a function from a slice to one array or list per
    field, or (mask, lists) to keep only some rows. Input columns that bear the name of a new field
    are replaced by it.
    """
    new = {f.name for f in fields}
    kept = [c for c in (keep or docs.columns) if c not in new]
    source = docs.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([source.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in pieces(batch, text):
                made = work(piece)
                mask = None
                if isinstance(made, tuple):
                    mask, made = made
                names = [*kept, *(f.name for f in fields)]
                arrays = [piece.column(c) for c in kept]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, ARROW[f.dataType.simpleString()]) for x, f in zip(made, fields)]
                out = pa.RecordBatch.from_arrays(arrays, names=names)
                yield out.filter(pa.array(mask, pa.bool_())) if mask is not None else out

    return map_arrow(source, run, schema)


def aside(df: DataFrame, taken: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """`df` with the columns that bear one of the `taken` names renamed, and the new name of every column."""
    taken = {c.lower() for c in taken}
    used, names = taken | {c.lower() for c in df.columns}, {}
    for c in df.columns:
        fresh = c
        while fresh.lower() in taken or fresh != c and fresh.lower() in used:
            fresh += "_"
        used.add(fresh.lower())
        names[c] = fresh
    return df.withColumnsRenamed({c: n for c, n in names.items() if c != n}), names


def named_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that `aside` was given, under their own names."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def boolean(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType())
