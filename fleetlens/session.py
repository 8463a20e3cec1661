"""Session settings and shared scratch storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app: str = "fleetlens", **extra: str) -> SparkSession:
    """A session with the settings above. `master` is left to spark-submit when not given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, named by spark.checkpoint.dir. A local session may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "fleetlens-" + spark.sparkContext.applicationId)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under the shared root."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


#: Settings of a write into the shared folder: its shuffle files go with its end, nothing reads them again, and
#: Python workers get rows in batches of this size, whatever one row holds.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """The settings of `WRITING`, for the writes made inside."""
    before = {key: spark.conf.get(key, None) for key in WRITING}
    try:
        for key, value in WRITING.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def save(df: DataFrame, path: str) -> None:
    """Write `df` as Parquet under the settings of `WRITING`."""
    with writing(df.sparkSession):
        df.write.mode("overwrite").parquet(path)


def cut_lineage(df: DataFrame, label: str, paths: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back, so a lost executor never replays its history.

    The folder is noted in `paths`, for a caller that can `discard` it after the last use.
    """
    path = scratch(df.sparkSession, label)
    save(df, path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders whose readers have all been written out."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that `df` reads, by the planner's statistics; nothing is run for it.

    Leaves the planner knows no size of, such as local rows, count nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(size for size in sizes if size < 1 << 60)


#: Bytes of a table, as the planner counts them, meant for one task of heavy work.
SPREAD_BYTES = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table out to tasks that each do a like share of them, every core at least one.

    Meant for heavy per-row work right above the scan, beside which one shuffle of the columns read costs little. A scan
    is cut by row groups, a few for millions of rows, so tasks of its own would grow with the table.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, size // SPREAD_BYTES))


#: Where this package is; workers of a local session find it there, a cluster has it installed or shipped.
HOME = str(Path(__file__).resolve().parents[1])


def show_package(spark: SparkSession) -> None:
    """Put this package on the path of the Python workers."""
    environment = spark.sparkContext.environment
    path = environment.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in path:
        environment["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, path)])


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """`mapInArrow` with this package on the path of the Python workers, which give Arrow's free memory back after each task."""
    show_package(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(tidy, schema)
