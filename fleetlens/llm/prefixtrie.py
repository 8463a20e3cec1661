"""Trie of the conversations' common beginnings, by digests of blocks of turns.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. Turns have
128-bit digests of (place, role, text) that are combined by exclusive or, so the digest of a beginning is a running
total and any task may add its part.

Blocks. Conversations are grouped by the digests of their successive blocks of `BLOCK` turns. Where all that
continue from a block's beginning take the same next block, no one leaves inside it: its turns are nodes with the
same members, and nothing else is computed for them. Only in blocks where siblings diverge, turn boundaries are
refined, once for each distinct block and not for each conversation.

Paths. A node belongs to its smallest member. The nodes of one owner are a path down to that conversation's end, and
paths hang on nodes of paths with smaller owners. Sums over subtrees are sums of whole paths, added up by pointer
doubling in as many rounds as the logarithm of the height, then a running sum up each path. Places, block
digests and path sums come from `operators.scan`, so a conversation with a third of all turns is cut like any other; only the
digest of the identifiers that end at one node is made in one task, since it is defined by their order; it streams.

Defined results: turns sort by turn (null first), then role, then text; null role or text is empty; repeated rows are
repeated turns; rows without a conversation id take no part; no conversations give no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.batches import map_arrow
from fleetlens.operators import scan
from fleetlens.session import cut_lineage

#: Turns of a block.
BLOCK = 4
NODE = ["depth", "a", "b"]
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text of the turns."""
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return scan.ordinal(turns, ["conv_id"], ["turn", "role", "text"]).select("conv_id", F.col("_pos").alias("pos"), "role", "text")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation with its first crc32(id) % `most` turns replaced by those of the last id before it that `every` divides."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % every
    lenders = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), F.col("pos").alias("place"), F.col("role").alias("r"), F.col("text").alias("t"))
    lent = conversations(turns).withColumn("base", base).join(lenders, "base").where(F.col("place") <= head)
    have = lenders.groupBy("base").agg(F.max("place").alias("have"))
    own = turns.where(F.col("pos") > head).withColumn("base", base).join(have, "base", "left")
    place = F.col("pos") - head + F.least(head, F.coalesce("have", F.lit(0)))
    return lent.select("conv_id", F.col("place").cast("bigint").alias("pos"), F.col("r").alias("role"), F.col("t").alias("text")).unionByName(
        own.select("conv_id", place.cast("bigint").alias("pos"), "role", "text"))


def conversations(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id").distinct()


def _half(hexes: Column, start: int) -> Column:
    return F.conv(F.substring(hexes, start, 15), 16, 10).cast("bigint")


def _xor(*parts: Column) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseXOR(F.coalesce(part, F.lit(0)))
    return out


def edges(turns: DataFrame, pieces: int | None = None) -> DataFrame:
    """One row per distinct block after a distinct beginning: digests before and after it, its turns, its smallest and number of members."""
    slots = range(BLOCK)
    blocks = turns.withColumn("block", F.expr(f"(pos - 1) div {BLOCK}")).withColumn("slot", (F.col("pos") - 1) % BLOCK).groupBy("conv_id", "block").agg(
        F.count(F.lit(1)).alias("k"), F.bit_xor("a").alias("wa"), F.bit_xor("b").alias("wb"),
        *[F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"{c}{i}") for i in slots for c in ("a", "b", "chars")])
    chained = scan.running(blocks, ["conv_id"], ["block"], {"after_a": ("bit_xor", "wa"), "after_b": ("bit_xor", "wb")}, pieces)
    chained = chained.withColumns({"before_a": _xor(F.col("after_a"), F.col("wa")), "before_b": _xor(F.col("after_b"), F.col("wb"))})
    return chained.groupBy("block", "before_a", "before_b", "after_a", "after_b", "k").agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n"), *[F.min(f"{c}{i}").alias(f"{c}{i}") for i in slots for c in ("a", "b", "chars")])


def nodes(found: DataFrame, members: DataFrame) -> DataFrame:
    """depth, a, b, chars, owner, n, parent_owner of every node; `found` are edges, `members` all conversations."""
    at = ["block", "before_a", "before_b"]
    forks = found.groupBy(*at).agg(F.count(F.lit(1)).alias("ways"))
    turns, a, b = [], F.col("before_a"), F.col("before_b")
    for i in range(BLOCK):
        na, nb = _xor(a, F.col(f"a{i}")), _xor(b, F.col(f"b{i}"))
        turns.append(F.struct(F.lit(i).alias("slot"), na.alias("a"), nb.alias("b"), a.alias("pa"), b.alias("pb"), F.col(f"chars{i}").alias("chars")))
        a, b = na, nb
    opened = found.join(forks, at).select("block", "owner", "n", "ways", F.inline(F.slice(F.array(*turns), F.lit(1), F.col("k").cast("int"))))
    opened = cut_lineage(opened.withColumn("depth", F.col("block") * BLOCK + F.col("slot") + 1), "turns")
    shared = opened.where("ways = 1").select(*NODE, "pa", "pb", "chars", "owner", "n", (F.col("slot") > 0).alias("inner"))
    refined = opened.where("ways > 1").groupBy(*NODE, "pa", "pb").agg(F.min("chars").alias("chars"), F.min("owner").alias("owner"), F.sum("n").alias("n"))
    root = members.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 0").select(
        F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(None).cast("bigint").alias("pa"),
        F.lit(None).cast("bigint").alias("pb"), F.lit(0).cast("bigint").alias("chars"), "owner", "n", F.lit(False).alias("inner"))
    every = cut_lineage(shared.unionByName(refined.withColumn("inner", F.lit(False))).unionByName(root.select(*shared.columns)), "nodes")
    parents = every.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("parent_owner"))
    looked = every.where(~F.col("inner")).join(parents, ["depth", "pa", "pb"], "left")
    known = every.where("inner").withColumn("parent_owner", F.col("owner"))
    return looked.unionByName(known.select(*looked.columns)).drop("pa", "pb", "inner")


def ends(turns: DataFrame, members: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 of the nodes at which conversations end."""
    last = turns.groupBy("conv_id").agg(F.max("pos").alias("depth"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    zero = F.lit(0).cast("bigint")
    full = members.join(last, "conv_id", "left").select(*[F.coalesce(c, zero).alias(c) for c in NODE], "conv_id")
    sent = full.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain, done = None, None, []
        for batch in batches:
            for depth, a, b, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id"))):
                if (depth, a, b) != now:
                    if now is not None:
                        done.append((*now, chain.hexdigest()))
                    now, chain = (depth, a, b), hashlib.sha256(str(conv).encode())
                else:
                    chain.update(f",{conv}".encode())
            yield _digests(done)
            done = []
        if now is not None:
            yield _digests([(*now, chain.hexdigest())])

    return map_arrow(sent, run, "depth bigint, a bigint, b bigint, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*NODE, "ends_sha256"])


def whole_paths(paths: DataFrame) -> DataFrame:
    """owner, whole_saved, whole_leaves: sums over each path and all that hang on it, from (owner, up, saved, leaves).

    After round k a path holds the sums of those fewer than 2^k steps below it, and knows the one 2^k steps above.
    """
    now = cut_lineage(paths, "paths")
    while not now.where("up IS NOT NULL").isEmpty():
        gain = now.where("up IS NOT NULL").groupBy(F.col("up").alias("owner")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        above = now.select(F.col("owner").alias("up"), F.col("up").alias("next"))
        step = now.join(gain, "owner", "left").join(above, "up", "left")
        now = cut_lineage(step.select(
            "owner", F.col("next").alias("up"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")), "paths")
    return now.select("owner", F.col("saved").alias("whole_saved"), F.col("leaves").alias("whole_leaves"))


def trie(turns: DataFrame, members: DataFrame, pieces: int | None = None) -> DataFrame:
    """One row per node of the conversations `members` (conv_id) with `turns` (conv_id, pos from 1, role, text).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: smallest member, turns,
    smallest member of the parent, members, children, childless nodes in the subtree, code points that the subtree's
    members need not repeat, digest of the members that end here.
    """
    hexes = F.md5(F.concat_ws(":", F.col("pos"), F.length("role"), "role", "text").cast("binary"))
    turns = cut_lineage(turns.select("conv_id", "pos", F.length("text").cast("bigint").alias("chars"), _half(hexes, 1).alias("a"), _half(hexes, 16).alias("b")), "turns")
    members = cut_lineage(members, "members")
    found = cut_lineage(edges(turns, pieces), "edges")
    tree = cut_lineage(nodes(found, members), "nodes").withColumn("own", (F.col("n") - 1) * F.col("chars"))
    spans = tree.groupBy("owner").agg(F.max("depth").alias("last"), F.sum("own").alias("saved"))
    tops = tree.where("depth = 0 OR parent_owner <> owner").select("owner", F.col("parent_owner").alias("up"), (F.col("depth") - 1).alias("depth"))
    held = tops.where("up IS NOT NULL").select(F.col("up").alias("owner"), F.col("depth").alias("last")).distinct().withColumn("held", F.lit(True))
    paths = spans.join(held, ["owner", "last"], "left").join(tops.select("owner", "up"), "owner").select(
        "owner", "up", "saved", F.when(F.col("held"), 0).otherwise(1).cast("bigint").alias("leaves"))
    hung = tops.where("up IS NOT NULL").join(whole_paths(paths), "owner").groupBy(F.col("up").alias("owner"), "depth").agg(
        F.count(F.lit(1)).alias("kids"), F.sum("whole_saved").alias("hung_saved"), F.sum("whole_leaves").alias("hung_leaves"))
    full = tree.join(hung, ["owner", "depth"], "left").join(spans.select("owner", "last"), "owner")
    full = full.withColumn("n_children", F.coalesce("kids", F.lit(0)) + F.when(F.col("depth") < F.col("last"), 1).otherwise(0))
    full = full.select(
        *NODE, "owner", "parent_owner", "n", "n_children", (F.col("own") + F.coalesce("hung_saved", F.lit(0))).alias("s"),
        (F.when(F.col("n_children") == 0, 1).otherwise(0) + F.coalesce("hung_leaves", F.lit(0))).cast("bigint").alias("l"))
    summed = scan.running(full, ["owner"], [F.desc("depth")], {"saved_tokens": ("sum", "s"), "n_leaves": ("sum", "l")}, pieces)
    return summed.join(ends(turns, members), NODE, "left").select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent_owner").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("n_children").cast("bigint").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
