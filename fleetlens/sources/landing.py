"""Readers for landed samples and, where a driver is configured, for the monitored databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import input_bytes

#: Input bytes meant for one landed file.
FILE_BYTES = 16 << 20


def land(df: DataFrame, path: str, order: str, files: int | None = None) -> None:
    """Write `df` once, as files that follow each other in `order`, behind those that are there.

    A file stream reads files by the time they were last changed. So the files get rising times, which only
    touches their entries in the file system.
    """
    spark = df.sparkSession
    parts = files or max(1, input_bytes(df) // FILE_BYTES)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())

    def held() -> dict[str, int]:
        found = fs.listStatus(place) if fs.exists(place) else []
        return {f.getPath().getName(): f.getModificationTime() for f in found if f.getPath().getName().startswith("part-")}

    before = held()
    df.repartitionByRange(parts, order).sortWithinPartitions(order).write.mode("append").parquet(path)
    last = max(before.values(), default=0)
    for i, name in enumerate(sorted(held().keys() - before.keys())):
        last = max(last + 1000, 1_000_000_000_000)
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), last, -1)


def stream_landed(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = 1000,
    **options: str,
) -> DataFrame:
    """The same files as a stream; `files_per_trigger` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def read_database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """One read-only query on a monitored database over JDBC. The driver jar is the cluster's."""
    return (
        spark.read.format("jdbc").option("url", url).option("query", query)
        .option("queryTimeout", 10).options(**options).load()
    )
