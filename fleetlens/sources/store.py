"""The metric store: date-partitioned Parquet tables, upsert by version, retention, compaction."""

from __future__ import annotations

import json
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.statements import merge_snapshots

# Days each table is kept, and the age from which files are compacted.
RETENTION_DAYS = {"health_metrics": 7, "table_stats": 90, "index_stats": 90}
COMPACT_AFTER_DAYS = 2
#: Bytes meant for a compacted file.
FILE_BYTES = 256 << 20


def append(df: DataFrame, path: str, time: str = "time") -> None:
    """Append rows under `date=` folders. One shuffle by date and database keeps files few; it is rebalanced by
    bytes, so a hot database is written by as many tasks as it fills and small ones share one."""
    out = df.withColumn("date", F.to_date(time))
    out.hint("rebalance", "date", "database_id").write.mode("append").partitionBy("date").parquet(path)


def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def partition_dates(spark: SparkSession, path: str) -> list[str]:
    """Dates a table holds, from its folder names."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith("date="))


def retain(spark: SparkSession, path: str, days: int, as_of: str) -> list[str]:
    """Drop whole `date=` folders older than `days` before `as_of`; no data is read or rewritten."""
    oldest = str(date.fromisoformat(as_of[:10]) - timedelta(days=days))
    gone = [d for d in partition_dates(spark, path) if d < oldest]
    for d in gone:
        fs, p = _folder(spark, f"{path}/date={d}")
        fs.delete(p, True)
    return gone


def _sizes(spark: SparkSession, path: str) -> tuple[int, int]:
    """Data files of a folder, and their bytes."""
    fs, p = _folder(spark, path)
    held = [f.getLen() for f in fs.listStatus(p) if not f.getPath().getName().startswith(("_", "."))]
    return len(held), sum(held)


def compact(spark: SparkSession, path: str, as_of: str, older_than: int = COMPACT_AFTER_DAYS, file_bytes: int = FILE_BYTES) -> int:
    """Rewrite old dates that lie in more files than their bytes need, as sorted zstd files of about
    `file_bytes`. Dates that are compact already are left alone. Only the rewritten partitions are
    replaced, and the swap happens when the whole write has succeeded."""
    limit = str(date.fromisoformat(as_of[:10]) - timedelta(days=older_than))
    pieces = {}
    for d in partition_dates(spark, path):
        files, size = _sizes(spark, f"{path}/date={d}") if d < limit else (0, 0)
        if files > max(1, -(-size // file_bytes)):
            pieces[d] = max(1, -(-size // file_bytes))
    if pieces:
        rows = spark.read.parquet(path).where(F.col("date").isin([date.fromisoformat(d) for d in pieces]))
        wanted = F.create_map(*[F.lit(x) for d, k in pieces.items() for x in (d, k)])[F.col("date").cast("string")]
        (
            rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), wanted)).repartition(sum(pieces.values()), "date", "_salt")
            .sortWithinPartitions("date", "database_id", "time").drop("_salt")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd").partitionBy("date").parquet(path)
        )
    return len(pieces)


# --- query snapshots: keyed upsert ----------------------------------------------------------------

#: Deltas on top of a base before they are folded into a new one.
FOLD_AFTER = 16
APPLIED = "_applied"


def _applied(spark: SparkSession, path: str, version: int) -> dict | None:
    """What a version says of itself: whether it is a base, and the last batch taken from each stream."""
    fs, p = _folder(spark, f"{path}/v={version}/{APPLIED}")
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return json.loads(bytes(source.readAllBytes()))
    finally:
        source.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of an upserted table; the note in a version's folder makes it visible."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(p)]
    found = [n for n in found if n.startswith("v=") and fs.exists(_folder(spark, f"{path}/{n}/{APPLIED}")[1])]
    return sorted(int(n[2:]) for n in found)


def _layers(spark: SparkSession, path: str) -> tuple[list[int], dict]:
    """The latest base with the deltas on top of it, and the note of the last."""
    layers, last = [], {}
    for v in reversed(versions(spark, path)):
        note = _applied(spark, path, v)
        last = last or note
        layers.append(v)
        if note["base"]:
            break
    return layers[::-1], last


def read_snapshots(spark: SparkSession, path: str) -> DataFrame | None:
    """The table: its base, merged with the deltas of later batches."""
    layers, _ = _layers(spark, path)
    if not layers:
        return None
    held = spark.read.parquet(*[f"{path}/v={v}" for v in layers])
    return held if len(layers) == 1 else merge_snapshots(held)


def upsert_snapshots(rows: DataFrame, path: str, stream: str | None = None, batch: int | None = None) -> int:
    """Merge snapshot rows into the table by (fingerprint, database_id) and publish a new version.

    A batch is written as a delta, so its cost does not grow with the table; every `FOLD_AFTER` deltas
    become a new base. Versions only rise. Each carries the last batch of every stream, so a batch that a
    stream repeats is left alone while a new stream starts from any number. The base before the current one is
    kept for readers.
    """
    spark = rows.sparkSession
    layers, note = _layers(spark, path)
    done = dict(note.get("streams", {}))
    if stream is not None and batch is not None:
        if done.get(stream, -1) >= batch:
            return layers[-1]
        done[stream] = batch
    new = layers[-1] + 1 if layers else 0
    base = not layers or len(layers) > FOLD_AFTER
    fresh = merge_snapshots(rows)
    merged = merge_snapshots(read_snapshots(spark, path).unionByName(fresh)) if layers and base else fresh
    merged.write.mode("overwrite").parquet(f"{path}/v={new}")
    fs, p = _folder(spark, f"{path}/v={new}/{APPLIED}")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps({"base": base, "streams": done}).encode()))
    out.close()
    if base and layers:
        for v in versions(spark, path):
            if v < layers[0]:
                fs, p = _folder(spark, f"{path}/v={v}")
                fs.delete(p, True)
    return new
