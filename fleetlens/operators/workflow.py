"""Proposal workflow: state fold, stamps, dwell time, field updates, audit checksums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import constants as K
from fleetlens.functions.common import json_string
from fleetlens.operators import scan
from fleetlens.operators.topn import newest_then_filter
from fleetlens.session import map_arrow

def next_state(state: Column, trigger: Column) -> Column:
    """Target of a trigger, NULL where it is not allowed."""
    pairs = [F.lit(x) for (s, t), target in K.TRANSITIONS.items() for x in (f"{s}|{t}", target)]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws("|", state, trigger))


def valid_triggers(state: Column) -> Column:
    """Triggers allowed in a state, as an array."""
    by_state = {s: [t for (source, t) in K.TRANSITIONS if source == s] for s in K.STATES}
    none = F.array().cast("array<string>")
    out = none
    for s, triggers in by_state.items():
        out = F.when(state == s, F.array(*map(F.lit, triggers)) if triggers else none).otherwise(out)
    return out


#: Transitions by number: row = state, and a number for each trigger.
CODES = {state: i for i, state in enumerate(K.STATES)}


class _Events:
    """Runs over events in order of (piece, key): a fold of the transitions from a start state, a row at a time."""

    def __init__(self, key: str, initial: str):
        self.key, self.initial = key, initial

    def groups(self, batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
        return zip(*(batch.column(c).to_pylist() for c in ("_piece", self.key, *columns)))


class _Exits(_Events):
    """(piece, key, exits): the state a piece ends in for each state it may begin in."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states = None, []
        for batch in batches:
            done = []
            for piece, key, trigger in self.groups(batch, "trigger_name"):
                if (piece, key) != now:
                    if now is not None:
                        done.append((now, states))
                    now, states = (piece, key), list(K.STATES)
                states = [K.TRANSITIONS.get((s, trigger), s) for s in states]
            yield self.rows(batch, done)
        if now is not None:
            yield self.rows(batch, [(now, states)])

    def rows(self, like: pa.RecordBatch, done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([p for (p, _), _ in done], pa.int32()), pa.array([k for (_, k), _ in done], like.column(self.key).type),
            pa.array([s for _, s in done], pa.list_(pa.string()))], names=["_piece", self.key, "_exits"])


class _Starts(_Events):
    """(piece, key, start) from exits in order of (key, piece)."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, self.initial
        for batch in batches:
            starts = []
            for _, key, exits in self.groups(batch, "_exits"):
                if now != (key,):
                    now, state = (key,), self.initial
                starts.append(state)
                state = exits[CODES[state]]
            yield pa.RecordBatch.from_arrays([batch.column("_piece"), batch.column(self.key), pa.array(starts, pa.string())], names=["_piece", self.key, "_start"])


class _Judged(_Events):
    """Events with the state before and after each and whether it was legal, from the start state of their piece."""

    def __init__(self, key: str, initial: str, names: list[str]):
        super().__init__(key, initial)
        self.names = names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, self.initial
        for batch in batches:
            before, after, legal = [], [], []
            for piece, key, trigger, start in self.groups(batch, "trigger_name", "_start"):
                if (piece, key) != now:
                    now, state = (piece, key), start or self.initial
                target = K.TRANSITIONS.get((state, trigger))
                before.append(state)
                state = target or state
                after.append(state)
                legal.append(target is not None)
            made = [pa.array(before, pa.string()), pa.array(after, pa.string()), pa.array(legal, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in self.names] + made, names=[*self.names, "from_state", "to_state", "legal"])


def judged_events(
    events: DataFrame, key: str = "proposal_id", order: Sequence[str] = ("seq",), keep: Sequence[str] = (),
    initial: str = "proposed", pieces: int | None = None,
) -> DataFrame:
    """Every event with the state before and after it and whether it was legal. An illegal trigger leaves the state unchanged.

    Events are laid out in ordered pieces, so many events of one proposal span several. Such a piece is first
    folded into a map from each state it may begin in to the one it ends in, a row a piece; the maps are chained
    in order, and every piece then runs from its true state. Events stream; none are gathered.
    """
    names = [*order, *[k for k in keep if k not in order], "trigger_name"]
    laid = scan.lay_out(events.select(key, *names), [key], names, pieces)
    met = laid.groupBy("_piece", key).agg(F.count(F.lit(1)).alias("_n"))
    cut = met.groupBy(key).agg(F.count(F.lit(1)).alias("_pieces")).where("_pieces > 1").select(F.col(key).alias("_cut"))
    spanning = laid.join(cut, F.col(key).eqNullSafe(F.col("_cut")), "left_semi").select("_piece", key, *names)
    kind = laid.schema[key]
    piece = T.StructField("_piece", T.IntegerType())

    def placed(df: DataFrame) -> DataFrame:
        return df.repartition("_piece", key).sortWithinPartitions("_piece", key, *names)

    exits = map_arrow(placed(spanning), _Exits(key, initial), T.StructType([piece, kind, T.StructField("_exits", T.ArrayType(T.StringType()))]))
    starts = map_arrow(exits.repartition(key).sortWithinPartitions(key, "_piece"), _Starts(key, initial), T.StructType([piece, kind, T.StructField("_start", T.StringType())]))
    run = placed(scan.attach(laid, starts, ["_piece", key]))
    schema = T.StructType([kind, *[laid.schema[c] for c in names]] + [
        T.StructField("from_state", T.StringType()), T.StructField("to_state", T.StringType()), T.StructField("legal", T.BooleanType())])
    return map_arrow(run, _Judged(key, initial, [key, *names]), schema)


def final_states(judged: DataFrame, key: str = "proposal_id", order: Sequence[str] = ("seq",)) -> DataFrame:
    """Current state, event and illegal event counts, and what may come next."""
    return judged.groupBy(key).agg(
        F.max_by("to_state", F.struct(*order)).alias("state"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(~F.col("legal")).alias("illegal_events"),
    ).withColumn("next_triggers", F.array_join(valid_triggers(F.col("state")), ", "))


def lifecycle_stamps(judged: DataFrame, key: str = "proposal_id", time: str = "ts") -> DataFrame:
    """When each lifecycle step legally happened, with the number of steps taken."""
    def at(*triggers: str) -> Column:
        return F.min(F.when(F.col("legal") & F.col("trigger_name").isin(*triggers), F.col(time)))

    return judged.groupBy(key).agg(
        at("review").alias("reviewed_at"),
        at("approve").alias("approved_at"),
        at("deploy", "deploy_and_monitor").alias("deployed_at"),
        at("rollback").alias("rolled_back_at"),
        at("reject").alias("rejected_at"),
        at("complete").alias("completed_at"),
        F.count_if("legal").alias("steps"),
    )


def lifecycle_people(
    judged: DataFrame, key: str = "proposal_id", order: Sequence[str] = ("seq",), actor: str = "actor", comment: str = "comment",
) -> DataFrame:
    """Who took each lifecycle step last, and why: reviewer and comment, approver, rejecter and reason, reason of a rollback.

    An approval's comment replaces the review's.
    """
    def last(column: str, *triggers: str) -> Column:
        return F.max_by(column, F.when(F.col("legal") & F.col("trigger_name").isin(*triggers), F.struct(*order)))

    return judged.groupBy(key).agg(
        last(actor, "review").alias("reviewed_by"), last(comment, "review", "approve").alias("review_comment"),
        last(actor, "approve").alias("approved_by"), last(actor, "reject").alias("rejected_by"),
        last(comment, "reject").alias("rejection_reason"), last(comment, "rollback").alias("rollback_reason"),
    )


def open_proposals(proposals: DataFrame, states: DataFrame, closed: Sequence[str] = K.CLOSED_STATES, key: str = "proposal_id") -> DataFrame:
    """Proposals of each database that have not come to an end."""
    joined = proposals.select(key, "database_id").join(states.select(key, "state"), key, "left")
    still = joined.where(F.coalesce(~F.col("state").isin(*closed), F.lit(True)))
    return still.groupBy("database_id").agg(F.count(F.lit(1)).alias("open_proposals"))


def proposal_audit(proposals: DataFrame, trail: DataFrame, key: str = "proposal_id", time: str = "ts") -> DataFrame:
    """Every proposal with the size and span of its audit trail, also those without any entry."""
    found = trail.groupBy(key).agg(
        F.count(F.lit(1)).alias("entries"), F.min(time).alias("first_entry_at"), F.max(time).alias("last_entry_at")
    )
    return proposals.join(found, key, "left").fillna(0, ["entries"])


def dwell_times(judged: DataFrame, key: str = "proposal_id", order: Sequence[str] = ("seq",), time: str = "ts") -> DataFrame:
    """Seconds between entering a state and leaving it, over all proposals, by state.

    Only legal moves are kept before the window, so no proposal holds more than eight rows.
    """
    w = Window.partitionBy(key).orderBy(*order)
    left = F.unix_seconds(F.lead(time).over(w).cast("timestamp"))
    moves = judged.where("legal").withColumn("_s", left - F.unix_seconds(F.col(time).cast("timestamp")))
    return moves.groupBy(F.col("to_state").alias("state")).agg(
        F.count(F.lit(1)).alias("entered"),
        F.count("_s").alias("left"),
        F.avg("_s").alias("avg_seconds"),
    )


def apply_updates(updates: DataFrame, key: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest non-null value of each field per key."""
    spot = F.struct(*order)
    return updates.groupBy(key).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), spot)).alias(f) for f in fields]
    )


def list_proposals(
    proposals: DataFrame, database_id: str | None = None, limit: int = 50, state: str | None = None,
    tie: str = "proposal_id",
) -> DataFrame:
    """Newest proposals of a database; the state filter applies to the page, after the limit."""
    rows = proposals.where(F.col("database_id") == database_id) if database_id else proposals
    keep = F.col("state") == state if state else None
    return newest_then_filter(rows, [F.desc("created_at"), F.asc(tie)], limit, keep)


# --- audit ----------------------------------------------------------------------------------------


def audit_content(df: DataFrame) -> Column:
    """The checksummed text of an audit row: six fields as JSON, names in order.

    `details` holds JSON text already; `created_at` enters as it is stored.
    """
    def pair(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}": '), value)

    stamp = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    fields = [
        pair("action", json_string(F.col("action"))),
        pair("actor", json_string(F.col("actor"))),
        pair("created_at", json_string(stamp)),
        pair("database_id", json_string(F.col("database_id").cast("string"))),
        pair("details", F.coalesce(F.col("details"), F.lit("null"))),
        pair("proposal_id", json_string(F.col("proposal_id").cast("string"))),
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))


def audit_checksum(df: DataFrame, out: str = "row_checksum") -> DataFrame:
    return df.withColumn(out, F.sha2(audit_content(df), 256))


def tampered_rows(df: DataFrame) -> DataFrame:
    """Rows whose stored checksum no longer fits their content."""
    return audit_checksum(df, "_now").where(~F.col("_now").eqNullSafe(F.col("row_checksum"))).drop("_now")
