"""Fingerprint similarity: long texts, groups of near fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import sqltext as T
from fleetlens.operators.graphs import components
from fleetlens.session import cut_lineage, map_arrow

BANDS = 8
#: Fingerprints of a band that are compared rather than cut again. A cut costs eight rows each; comparing costs a nanosecond a pair.
HOT_ROWS = 1 << 15
#: Pairs compared in one step, few enough to stay in the cache.
STEP = 1 << 16


def simhash_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash) of whole texts of any length.

    Tokens are exploded and counted per text. All tokens of a text start in one task, so the map
    side already reduces them to one row: 32 sums, each carrying two bit counters.
    """
    words = df.select(key, F.explode_outer(T.tokens(T.normalize_sql(F.col(text)))).alias("_t"))
    hashed = words.select(key, T.token_hash(F.col("_t")).alias("_h"))
    counted = hashed.groupBy(key).agg(F.count("_h").alias("_n"), *[F.expr(x) for x in T.lane_sums()])
    # A text without tokens has no sums; every comparison with NULL is false, which leaves 0.
    return counted.selectExpr(key, f"{T.lane_bits()} AS simhash")


def _bands(value: Column, used: int, width: int, count: int) -> list[Column]:
    """`count` slices of `width` bits from bit `used` on; the last takes what is left of 64."""
    out = []
    for i in range(count):
        at = used + i * width
        bits = width if i < count - 1 else 64 - at
        out.append(F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << bits) - 1)))
    return out


def _rotate(value: Column, by: Column) -> Column:
    left = F.call_function("shiftleft", value, by)
    return F.when(by == 0, value).otherwise(
        left.bitwiseOR(F.call_function("shiftrightunsigned", value, F.lit(64) - by))
    )


def band_keys(fingerprints: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(simhash, band key) rows such that any two values less than 8 bits apart share a key.

    Two values at most 7 bits apart agree on one of 8 slices. A slice value held by more than
    `hot_rows` fingerprints is cut again: its members agree on those 8 bits, so their 7 differences
    lie in the other 56, and one of 8 slices of 7 bits agrees there too; and again on the 49 left.
    Every cut is exact; no member or partner is dropped. Keys are hashes; bands that share one by chance are compared together.
    """
    first = fingerprints.select(
        "simhash",
        F.posexplode(F.array(*[b.cast("bigint") for b in _bands(F.col("simhash"), 0, 8, BANDS)])).alias("_b", "_v"),
    ).select(
        "simhash",
        F.xxhash64("_b", "_v").alias("band"),
        # Turn the shared slice to the low end, so the bits still open are always the high ones.
        _rotate(F.col("simhash"), (F.lit(64) - F.col("_b") * 8) % 64).alias("_turned"),
    )

    def split(level: DataFrame, used: int, width: int) -> tuple[DataFrame, DataFrame]:
        hot = level.groupBy("band").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > hot_rows).select("band")
        marked = level.join(hot.withColumn("_hot", F.lit(True)), "band", "left")
        slices = F.array(*[b.cast("bigint") for b in _bands(F.col("_turned"), used, width, BANDS)])
        finer = marked.where("_hot").select(
            "simhash", "_turned", "band", F.posexplode(slices).alias("_b", "_v")
        ).select(
            "simhash", F.xxhash64("band", "_b", "_v").alias("band"),
            # Bring the newly agreed slice next to the earlier ones, keeping the low bits.
            _swap(F.col("_turned"), used, width, F.col("_b")).alias("_turned"),
        )
        return marked.where(F.col("_hot").isNull()).select("simhash", "band", "_turned"), finer

    done1, second = split(first, 8, 7)
    done2, third = split(second, 15, 6)
    keys = done1.unionByName(done2).unionByName(third)
    return keys.select("simhash", "band")


def _swap(value: Column, used: int, width: int, slot: Column) -> Column:
    """Move slice `slot` (of `width` bits, counted from bit `used`) to bit `used`; the slice that was
    there takes its place. Bits below `used` stay."""
    at = F.lit(used) + slot * width
    mask = F.lit((1 << width) - 1).cast("bigint")
    there = F.call_function("shiftrightunsigned", value, at).bitwiseAND(mask)
    here = F.shiftrightunsigned(value, used).bitwiseAND(mask)
    both = there.bitwiseXOR(here)
    flip = F.shiftleft(both, used).bitwiseOR(F.call_function("shiftleft", both, at))
    return F.when(slot == 0, value).otherwise(value.bitwiseXOR(flip))


def _met(front: np.ndarray, rest: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(members of `rest` near to any of `front`, the others)."""
    found, step = [], 0
    while step < len(front) and len(rest):
        some = front[step:step + max(1, STEP // len(rest))]
        step += len(some)
        near = (np.bitwise_count(some[:, None] ^ rest) < threshold).any(0)
        if near.any():
            found.append(rest[near])
            rest = rest[~near]
    return np.concatenate(found) if found else rest[:0], rest


def connected(values: np.ndarray, blocks: np.ndarray, first: int, second: int, threshold: int) -> list[tuple[int, int]]:
    """(smallest, member) of each tree of near values; between blocks `first` and `second` if they differ.

    A tree grows from a seed and takes what it meets out of the rest, so members of one crowd are hardly compared with each other.
    """
    v = values.view(np.uint64)
    cross = first != second
    rest = [v[blocks == first], v[blocks == second]] if cross else [v]
    out = []
    while len(rest[0]) and len(rest[-1]):
        seeds = rest[0][:max(1, STEP // len(rest[-1]))]
        count = (np.bitwise_count(seeds[:, None] ^ rest[-1]) < threshold).sum(1)
        seeds, alone = seeds[count > (0 if cross else 1)], len(seeds)
        if not len(seeds):
            rest[0] = rest[0][alone:]
            continue
        rest[0] = np.concatenate([seeds[1:], rest[0][alone:]])  # values that are near to none of the rest are done
        tree, fronts = [seeds[:1]], [seeds[:1], v[:0]][:len(rest)]
        while any(map(len, fronts)):
            after = []
            for side in range(len(rest)):
                met, rest[side] = _met(fronts[side - 1], rest[side], threshold)
                after.append(met)
            fronts = after
            tree += after
        members = np.concatenate(tree).view(np.int64)
        low = int(members.min())
        out += [(low, m) for m in members.tolist() if m != low]
    return out


def linking_pairs(nodes: DataFrame, threshold: int = 8, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all that are near, a star for each tree of a band.

    All near values of a band are compared in one task, which gives out only what connects them: fewer
    pairs than members, whichever value happens to be the smallest. A band that `band_keys` could not cut
    below `hot_rows` is split into blocks that meet in pairs.
    """
    if threshold > BANDS:
        raise ValueError(f"band keys are exact for thresholds up to {BANDS}")
    keys = band_keys(nodes.where("simhash IS NOT NULL"), hot_rows)
    sizes = keys.groupBy("band").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
    parts = F.ceil(F.col("_k") / max(hot_rows, 2)).cast("int")
    dealt = keys.join(sizes, "band").select("band", "simhash", parts.alias("_p")).withColumns({
        "block": F.pmod(F.xxhash64("simhash"), F.col("_p")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("_p") - 1)),
    }).select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "simhash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def pairs() -> list[tuple[int, int]]:
            block, value = (np.concatenate([h[x] for h in held]) for x in (0, 1))
            return connected(value, block, key[1], key[2], threshold) if len(value) > 1 else []

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[x] for f in found], pa.int64()) for x in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            band, i, j, block, value = (batch.column(c).to_numpy() for c in ("band", "i", "j", "block", "simhash"))
            borders = np.flatnonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            found = []
            for a, b in pairwise([0, *borders.tolist(), len(band)]):
                if (band[a], i[a], j[a]) != key:
                    if held:
                        found += pairs()
                    key, held = (band[a], i[a], j[a]), []
                held.append((block[a:b], value[a:b]))
            yield out(found)
        if held:
            yield out(pairs())

    together = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return map_arrow(together, run, "a bigint, b bigint").distinct()


def clusters(fingerprints: DataFrame, threshold: int = 8, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(simhash, cluster): connected groups of near fingerprints, named by their smallest member; nothing is kept on one node."""
    nodes = cut_lineage(fingerprints.select("simhash").distinct(), "cluster-nodes")
    roots = components(linking_pairs(nodes, threshold, hot_rows))
    return nodes.join(roots, nodes["simhash"] == roots["node"], "left").select("simhash", F.coalesce("root", "simhash").alias("cluster"))
