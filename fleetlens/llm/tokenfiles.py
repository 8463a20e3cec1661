"""Token files: Parquet list columns of token ids that can be read in parts.

Documents are put in ascending id order by one range partitioning, encoded, and written with one row
per document: id, length, place within its file, and the ids as a list. The ids are delta or
dictionary encoded (the writer's version 2 pages use delta encoding where a dictionary does not pay),
row groups and pages are kept small, and the writer's page indexes let a reader fetch the metadata
columns, or the tokens of a range of ids, without the rest.

The place of a document in the whole stream is the sum of what the files before it hold. Those sums
come from the length column alone, one row per file.

Defined results: a null text is an empty one and has just the end id; documents with a null id come
first; rows with equal ids are ordered by text, then as they come; an empty table gives no rows; texts are read whole; other
columns are ignored. The number of files follows the bytes of the table.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.batches import map_arrow, pieces, strings
from fleetlens.llm.chunks import Memory, encode_chunks, library, marked_cuts, specials
from fleetlens.session import input_bytes, scratch, writing

END = 0
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: Text bytes meant for one file, and how many of them a byte of a compressed table holds.
FILE_BYTES, UNPACKED = 32 << 20, 2
#: Chunks that no text holds: the end of a text, and (before its number) a text that is not cut.
STOP, WHOLE = "\1", "\2"


@lru_cache(maxsize=1)
def encoder(path: str, end: int = END):
    """Function from texts to (values, lengths): all ids one after another, the end id after each text.

    The chunks of all texts are numbered in one pass, so each is looked up once however often it occurs. A Python worker
    keeps the function, with the chunks it has met, from one task to the next.
    """
    t = library(path)

    def whole(text: str) -> bytes:
        return np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    memory = Memory(lambda words: encode_chunks(t, words), {"": b"", "\n": whole("\n"), STOP: np.array([end], "<u4").tobytes()})
    marked = specials(t)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        uncut, lines = {}, []
        for i, x in enumerate(texts):
            line = None if any(s in x for s in marked) else marked_cuts(x)
            if line is None:
                line = f"{WHOLE}{i}"
                uncut[line] = whole(x)
            lines.append(f"{line}\0{STOP}")
        parted = pc.split_pattern(pa.array(lines, pa.large_string()), "\0")
        words = parted.values.dictionary_encode()
        cells = memory.values(words.dictionary.to_numpy(zero_copy_only=False).tolist(), uncut)
        ids = np.frombuffer(b"".join(cells), "<i4")
        sizes = np.fromiter(map(len, cells), np.int64, len(cells)) // 4
        at = words.indices.to_numpy()
        many = sizes[at]
        ends = np.cumsum(many)
        # The ids of each chunk stand together in `ids`, those before it in the texts make up the rest of its place.
        values = ids[np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - many), many) + np.arange(ends[-1])]
        return values, np.diff(np.concatenate([[0], ends])[parted.offsets.to_numpy()])

    return encode


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, doc: str = "doc_id", text: str = "text", end: int = END,
    files: int | None = None,
) -> None:
    """Encode `docs` and write the token files to `path`."""
    spark = docs.sparkSession
    files = files or max(spark.sparkContext.defaultParallelism, UNPACKED * input_bytes(docs) // FILE_BYTES)
    dealt = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    dealt = dealt.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    dealt = dealt.withColumn("file", F.spark_partition_id())
    schema = T.StructType([
        T.StructField("file", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("place", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])

    def run(batches):
        encode = encoder(vocabulary, end)
        place = 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                values, lengths = encode(strings(piece.column("text")))
                ends = np.cumsum(lengths)
                ids = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values)
                )
                yield pa.RecordBatch.from_arrays([
                    piece.column("file"), piece.column("doc_id"), pa.array(place + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()), ids,
                ], names=schema.names)
                place += int(ends[-1])

    writer = map_arrow(dealt, run, schema).write.mode("overwrite").options(**{
        "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES), "parquet.page.write-checksum.enabled": "false",
        "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "compression": "zstd",
    })
    with writing(spark):
        writer.parquet(path)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """First position of each file in the whole stream, from the length column alone. One row per file."""
    held = spark.read.parquet(path).groupBy("file").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return held.select("file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, tokens: bool = True) -> DataFrame:
    """Documents of a token file with their position, optionally only ids first..last, or only the metadata."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    rows = rows.join(F.broadcast(file_starts(spark, path)), "file")  # one row per file
    columns = ["doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens"]
    return rows.select(*columns, "ids") if tokens else rows.select(*columns)


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches):
        encoder.cache_clear()  # a worker that has encoded gives its memory of chunks back
        for batch in batches:
            ids = batch.column("ids")
            values, offsets = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B"), ids.offsets.to_numpy()
            found = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start")), pa.array(np.diff(offsets), pa.int64()), pa.array(found, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return map_arrow(tokens.select("doc_id", "start", "n_tokens", "ids"), run, schema)


def encode_and_read(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write token files to the shared folder and read them back as checksums."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, vocabulary)
    return checksums(read_tokens(spark, path))
