"""Keyed state in event time: rows wait in a buffer until the watermark has passed them.

A row that arrives late, but within the watermark's delay, takes its place in the order of time, so any arrival gives
what sorted arrival gives. Spark drops rows behind the watermark. A key holds the rows of one delay and one micro-batch, the buffer,
and what its computation carries on: two numbers, or the samples of a frame. One timer a key stands at its oldest row.

Results bear the event time, so that another stateful operator, such as a windowed rollup, can follow in the same query.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.constants import ZSCORE_METRICS
from fleetlens.session import SETTINGS, show_package


class InOrder(StatefulProcessor):
    """Base of processors that see the rows of a key in the order of (at, tie), `at` being microseconds.

    Rows wait as pickled blocks, each sorted, with the times of its first and last row. A block is read when the merge comes to it,
    so a task holds a few blocks as rows and the rest as bytes, and state is read and written by the block.
    """

    def __init__(self, made: Sequence[str]):
        self.made = list(made)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "low bigint, high bigint, block binary")
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            # without the key and the time, which `at` holds
            self._hold([(int(at), None if tie is None else int(tie), *others) for at, tie, *others in zip(*map(_column, map(part.iloc.__getitem__, _places(part))))])
        return iter([])

    def _hold(self, rows: list[tuple]) -> None:
        rows.sort(key=_place)
        self.held.appendValue((rows[0][0], rows[-1][0], pickle.dumps(rows, 5)))
        self._wait(rows[0][0])

    def _wait(self, at: int) -> None:
        """See to a timer at the millisecond of `at`, if none stands earlier."""
        now = self.due.get()[0] if self.due.exists() else None
        due = at // 1000 + 1
        if now is None or due < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(due)
            self.due.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = sorted((tuple(b) for b in self.held.get()), key=lambda b: b[0])
        self.held.clear()
        self.due.clear()
        late = [b for b in blocks if b[0] > passed]
        for low, high, block in late:
            self.held.appendValue((low, high, block))
            self._wait(low)
        rest: list[tuple] = []
        for made in self.compute(key[0], _merged(blocks[:len(blocks) - len(late)], passed, rest)):
            if made:
                yield self._frame(made)
        for start in range(0, len(rest), BLOCK):
            self._hold(rest[start:start + BLOCK])

    def _frame(self, made: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame({name: list(values) for name, values in zip(self.made, zip(*made))})
        return out.assign(time=pd.to_datetime(out["time"], unit="us", utc=True))

    def compute(self, key, rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        """Some made rows at a time."""
        raise NotImplementedError

    def close(self) -> None:
        pass


#: Rows of a block, and made rows that leave at a time.
BLOCK = 4096


def _places(part: pd.DataFrame) -> list[tuple]:
    return [(slice(None), i) for i in range(1, part.shape[1] - 1)]


def _column(values: pd.Series) -> list:
    """Values as Python objects; what is missing among texts is None."""
    return values.tolist() if values.dtype.kind in "if" else [v if isinstance(v, str) else None for v in values]


def _place(row: tuple) -> tuple:
    return row[0], row[1] is not None, row[1] or 0


def _merged(blocks: list[tuple], passed: int, rest: list[tuple]) -> Iterator[tuple]:
    """Rows of blocks (low, high, block), sorted by `low`, in order up to the time `passed`; later ones go to `rest`."""
    waiting = [(b[0], i) for i, b in enumerate(blocks)]
    opened: list[tuple] = []  # (place, block, row number, rows)
    at = 0
    while at < len(waiting) or opened:
        while at < len(waiting) and (not opened or waiting[at][0] <= opened[0][0][0]):
            rows = pickle.loads(blocks[at][2])
            blocks[at] = None
            heapq.heappush(opened, (_place(rows[0]), at, 0, rows))
            at += 1
        place, block, i, rows = opened[0]
        if place[0] > passed:
            heapq.heappop(opened)
            rest += rows[i:]
            continue
        yield rows[i]
        if i + 1 < len(rows):
            heapq.heapreplace(opened, (_place(rows[i + 1]), block, i + 1, rows))
        else:
            heapq.heappop(opened)


ROCKS = SETTINGS["spark.sql.streaming.stateStore.providerClass"]
#: Rows whose frames are laid out at a time.
SLICE = 1024


class CounterRate(InOrder):
    """The growth of a counter a second against the latest sample that has one; rows are (at, tie, counter, others ...)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at bigint, n bigint")

    def compute(self, key, rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        last = tuple(self.last.get()) if self.last.exists() else None
        made = []
        for at, tie, n, *others in rows:
            rate = 0.0
            if n is not None:
                n = int(n)
                if last is not None and at > last[0]:
                    rate = max(0.0, (n - last[1]) / ((at - last[0]) / 1e6))
                last = (at, n)
            made.append((key, tie if tie is None else str(tie), at, rate, *others))
            if len(made) == BLOCK:
                yield made
                made = []
        yield made
        if last is not None:
            self.last.update(last)


class RollingScore(InOrder):
    """z-scores over a `threshold` against the last `frame` samples; rows are (at, tie, metrics ...)."""

    def __init__(self, made: Sequence[str], metrics: Sequence[str], frame: int, min_rows: int, threshold: float):
        super().__init__(made)
        self.metrics, self.frame, self.min_rows, self.threshold = list(metrics), frame, min_rows, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getValueState("recent", "samples binary")

    def compute(self, key, rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        past = np.empty((0, len(self.metrics)))
        if self.recent.exists():
            past = np.frombuffer(self.recent.get()[0], np.float64).reshape(-1, len(self.metrics))
        while part := list(islice(rows, SLICE)):
            values = np.concatenate([past, np.array([r[2:] for r in part], np.float64)])
            at = np.arange(len(past), len(values))
            padded = np.concatenate([np.full((max(0, self.frame - 1 - len(past)), values.shape[1]), np.nan), values])
            frames = np.lib.stride_tricks.sliding_window_view(padded, self.frame, 0)[-len(at):]
            n = (~np.isnan(frames)).sum(2)
            mean = np.nansum(frames, 2) / np.maximum(n, 1)
            dev = np.sqrt(np.nansum((frames - mean[:, :, None]) ** 2, 2) / np.maximum(n - 1, 1))
            with np.errstate(invalid="ignore", divide="ignore"):
                z = np.abs(values[at] - mean) / dev
            hit = (z > self.threshold) & (dev >= 0.001) & (n > 1) & (at + 1 >= self.min_rows)[:, None]
            yield [(key, None if part[i][1] is None else str(part[i][1]), part[i][0], self.metrics[j], float(part[i][2 + j]), float(z[i, j])) for i, j in zip(*np.nonzero(hit))]
            past = values[max(0, len(values) - self.frame + 1):]
        self.recent.update((past.tobytes(),))


def _slim(df: DataFrame, tie: str, columns: Sequence, late: str) -> DataFrame:
    """The columns a processor needs, the key first; the time itself stays last, for the watermark.

    Whole numbers that may be missing travel as text, since pandas would make them floating point.
    """
    timed = df.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late)
    return timed.select("database_id", F.unix_micros("time").alias("at"), F.col(tie).cast("bigint").cast("string").alias(tie), *columns, "time")


def counter_rate(df: DataFrame, counter: str = "total_xacts", tie: str = "event_id", keep: Sequence[str] = (), late: str = "10 minutes") -> DataFrame:
    """database_id, `tie`, time, qps and the columns `keep` of each sample, as `snapshots.counter_rate` has them on the whole table.

    `keep` are columns of types that text gives back as they were: numbers, texts, booleans, dates and times.
    """
    kept = [F.to_json(F.array(*[F.col(c).cast("string") for c in keep])).alias("_kept")] if keep else []
    slim = _slim(df, tie, [F.col(counter).cast("bigint").cast("string").alias(counter), *kept], late)
    schema = T.StructType([
        T.StructField("database_id", T.StringType()), T.StructField(tie, T.StringType()), T.StructField("time", T.TimestampType()),
        T.StructField("qps", T.DoubleType()), *([T.StructField("_kept", T.StringType())] if keep else [])])
    rated = _by_database(slim, CounterRate(schema.names), schema)
    if keep:
        rated = rated.withColumn("_kept", F.from_json("_kept", "array<string>"))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return rated.select(
        "database_id", F.col(tie).cast("bigint").alias(tie), "time", F.round("qps", 2).alias("qps"),
        *[F.get("_kept", F.lit(i)).cast(kinds[c]).alias(c) for i, c in enumerate(keep)])


def rolling_zscore(
    df: DataFrame, metrics: Sequence[str] = tuple(ZSCORE_METRICS), frame: int = 360, min_rows: int = 30, threshold: float = 3.0,
    tie: str = "event_id", late: str = "10 minutes",
) -> DataFrame:
    """database_id, `tie`, time, metric, value, zscore of each spike, as `detectors.rolling_zscore` has them on the whole table."""
    slim = _slim(df, tie, [F.col(m).cast("double").alias(m) for m in metrics], late)
    schema = T.StructType([
        T.StructField("database_id", T.StringType()), T.StructField(tie, T.StringType()), T.StructField("time", T.TimestampType()),
        T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("zscore", T.DoubleType())])
    return _by_database(slim, RollingScore(schema.names, metrics, frame, min_rows, threshold), schema).withColumn(tie, F.col(tie).cast("bigint"))


def _by_database(slim: DataFrame, processor: InOrder, schema: T.StructType) -> DataFrame:
    show_package(slim.sparkSession)
    slim.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # keyed state with timers needs it
    return slim.groupBy("database_id").transformWithStateInPandas(processor, schema, "Append", "EventTime", eventTimeColumnName="time")
