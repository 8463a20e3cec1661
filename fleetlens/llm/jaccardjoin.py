"""N-gram Jaccard join by universe partition and the pigeonhole principle; links are exact.

A document's set holds its distinct shingles of `words` consecutive words (lower-cased A-Z, cut at
ASCII white space), as 64-bit hashes. Two sets link if their Jaccard similarity is at least `num/den`.

Signatures. Sets of similar size share a band. In a band linked sets differ in at most H shingles. The
universe of hashes is cut into n equal ranges; the part of a set in a range is a segment. A plain
segment is indexed by a hash of its content, so it tells nothing only if it differs at all; a segment
with its one-deletion neighbourhood is indexed by its content and by its content less each element, so
it tells nothing only if it differs twice. With t of the latter, and z segments that may be left out,
n + t - z > H makes every linked pair share an index entry. Only empty segments are left out, the first
z of a set, since their entries would be shared by strangers. `scheme` picks n, t and z for each band
at the least cost: entries to shuffle plus pairs of strangers expected to meet.

A larger set may link to one in a lower band, so it is indexed under each band that holds sizes it may
link to. Bands widen by 1.4, so that is one or two.

Work. Copies are collapsed within tasks, then by fingerprint. Entries with one set go, and buckets of the same sets are
collapsed to one. In a bucket the sets meet as sketches first: parity bitmaps of a bit a shingle, whose exclusive or has no more
bits than the sets differ in. Strangers that share an entry by chance fail that bound; what passes it connects sets to
families. No link leaves its family, so a family is verified as a whole: each set is read again from its text and sent once. A bucket or
family over `BUCKET_BYTES` is split into blocks that meet in pairs. Only a star for each tree of links leaves a group, so a crowd of near copies yields
one row per member. Components come from alternating star contraction.

Defined results: null, empty and blank texts have no shingles and link to nothing; a text with fewer
words than a shingle has one shingle, the whole; rows with null ids take part, and a component without
any id has a null one; repeated rows are copies of each other; texts are read whole; `join` ignores other columns, `keep_one`
gives all back as they came, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.batches import annotate, aside, long, map_arrow, named_back, pieces, utf8
from fleetlens.operators.graphs import components
from fleetlens.session import cut_lineage, discard

WORDS, NUM, DEN = 5, 8, 10
#: Names that `keep_one` uses beside the columns of the documents; theirs are set aside meanwhile.
OWN = ["_n", "_f1", "_f2", "_doc", "_m", "_g1", "_g2", "_root", "_many", "_rows", "_row", "_kept"]
BAND_RATIO = 1.4
#: Chance that a shingle of one document is also in an unrelated one, for the cost of a scheme.
SHARED = 0.1
#: Bytes of sets or sketches of a block; a task holds two at a time.
BUCKET_BYTES = 4 << 20
#: Fingerprints of sets a task remembers in order to index copies once.
REMEMBERED = 200_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    found = text.translate(LOWER).split(b" ")
    if b"" in found:
        found = [w for w in found if w]
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        total = mix(total * K[4] + h[i:len(h) - width + 1 + i])
    return np.unique(total)


@dataclass(frozen=True)
class Scheme:
    """A band of sizes lowest..highest and its segments: `segments` in all, the first `deletions` with neighbourhoods."""

    band: int
    lowest: int
    highest: int
    segments: int
    deletions: int
    spare: int

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return _keys(self.band, self.segments)


@lru_cache(maxsize=256)
def _keys(band: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    borders = np.array([(i << 64) // segments for i in range(1, segments)], np.uint64)
    return borders, mix(np.arange(segments, dtype=np.uint64) + np.uint64(band << 32) + K[0])


def most_differing(small: int, num: int, den: int) -> int:
    """Shingles in which a set of `small` shingles and a linked one of at least that size may differ at most."""
    return (small + small * den // num) * (den - num) // (den + num)


def _tail(mean: float, least: int) -> float:
    """Chance that a Poisson variable exceeds `least`."""
    return max(0.0, 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(least + 1)))


def scheme(band: int, lowest: int, highest: int, num: int, den: int, docs: int) -> Scheme:
    """The cheapest n, t, z for a band in a corpus of `docs` documents."""
    differ = most_differing(highest, num, den)
    best = None
    for spare in range(0, 40):
        for deletions in range(0, 5):
            n = differ + 1 + spare - deletions
            if n < max(1, deletions):
                continue
            width = lowest / n
            strangers = n * SHARED**width + _tail(min(n * math.exp(-width), 300.0), spare) ** 2
            cost = n - deletions + deletions * (1 + width) + docs * strangers
            if best is None or cost < best[0]:
                best = (cost, n, deletions, spare)
    return Scheme(band, lowest, highest, *best[1:])


def schemes(num: int, den: int, docs: int) -> list[Scheme]:
    """All bands, from the smallest size that may link to a different set."""
    low = next(a for a in range(1, 10**6) if most_differing(a, num, den) > 0)
    out = []
    while low < 1 << 31:
        high = max(low, int(low * BAND_RATIO) - 1)
        out.append(scheme(len(out), low, high, num, den, docs))
        low = high + 1
    return out


def entries(s: np.ndarray, plan: Scheme) -> np.ndarray:
    """Index entries of a set under a scheme."""
    borders, keys = plan.keys()
    cuts = np.searchsorted(s, borders)
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(s)]])
    value = mix(s + K[1])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    content = sums[ends] - sums[starts]
    out = mix(content + keys)
    empty = starts == ends
    empty[:plan.deletions] = False
    if empty.any():
        out = out[~(empty & (np.cumsum(empty) <= plan.spare))]
    parts = [out]
    for i in range(plan.deletions):
        parts.append(mix(content[i] - value[starts[i]:ends[i]] + keys[i]))
    return np.unique(np.concatenate(parts))


def all_entries(s: np.ndarray, plans: list[Scheme], num: int, den: int) -> np.ndarray:
    """Entries under every band that holds a size to which the set may link from above, or its own."""
    least = -(-len(s) * num // den)
    return np.concatenate([np.empty(0, np.uint64), *(entries(s, p) for p in plans if p.lowest <= len(s) and p.highest >= least)])


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(s + K[i]).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for i in (2, 3))


def sketch(s: np.ndarray) -> bytes:
    """Parity bitmap of a set, about a bit a shingle: bit i says whether an odd number of shingles fall on it.

    The exclusive or of two sketches is the sketch of the sets' difference, so it has no more bits than they differ in.
    """
    bits = max(64, 1 << (len(s) - 1).bit_length())
    at = (mix(s + K[0]) >> np.uint64(32)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def index(docs: DataFrame, doc: str, text: str, words: int, num: int, den: int) -> DataFrame:
    """One row per document: row id, hash of the text, size and fingerprint of its set, and sketch and entries of the first copy a task sees."""
    plans = docs.sparkSession.sparkContext.broadcast(schemes(num, den, max(docs.count(), 1)))
    fields = [long("row"), long("n"), long("f1"), long("f2"), T.StructField("sketch", T.BinaryType()), T.StructField("entries", T.ArrayType(T.LongType()))]

    def make():
        bands = plans.value
        seen: set[tuple[int, int]] = set()
        row = TaskContext.get().partitionId() << 40

        def work(piece: pa.RecordBatch) -> list:
            nonlocal row
            rows, sizes, f1, f2, sketches, found = [], [], [], [], [], []
            for raw in utf8(piece.column(text)):
                s = shingles(raw, words)
                a, b = fingerprint(s)
                e = drawn = None
                if (a, b) not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add((a, b))
                    e, drawn = all_entries(s, bands, num, den).view(np.int64), sketch(s)
                rows.append(row)
                row += 1
                sizes.append(len(s))
                f1.append(a)
                f2.append(b)
                sketches.append(drawn)
                found.append(e if e is not None and len(e) else None)
            held = [x for x in found if x is not None]
            lengths = np.array([0 if x is None else len(x) for x in found])
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()),
                pa.array(np.concatenate(held) if held else np.empty(0, np.int64)),
            )
            return [rows, sizes, f1, f2, sketches, lists]

        return work

    source = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    return annotate(source, "text", fields, make, ["doc_id", "hash"])


def buckets(rows: DataFrame, classes: DataFrame, paths: list[str]) -> DataFrame:
    """(bucket, rep, n, weight): the sets behind entries that several share, one bucket for each group of sets."""
    held = rows.where(F.size("entries") > 0).select("row", F.explode("entries").alias("entry"))
    shared = held.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("entry"))).where("k > 1").drop("k")
    member = rows.where(F.size("entries") > 0).select("row", "f1", "f2", "n").join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"])
    met = shared.join(member.select("row", "rep", "n"), "row").select("entry", "rep", "n").distinct()
    whole = Window.partitionBy("entry")
    tagged = met.withColumns({
        "k": F.count(F.lit(1)).over(whole), "weight": F.sum("n").over(whole),
        "same1": F.sum(F.shiftright(F.xxhash64("rep"), 16)).over(whole), "same2": F.sum(F.shiftright(F.xxhash64("rep", F.lit(1)), 16)).over(whole),
    }).where("k > 1")
    tagged = cut_lineage(tagged, "met", paths)
    first = tagged.groupBy("k", "weight", "same1", "same2").agg(F.min("entry").alias("entry"))
    return tagged.join(first.select("entry"), "entry").select(F.col("entry").alias("bucket"), "rep", "n", "weight")


def _dealt(found: DataFrame, size: Column) -> DataFrame:
    """Each row of `found` (rep, bucket, weight ...) in the pairs of blocks (i, j) of its bucket that hold its own block; `size` is the bytes of a bucket."""
    parts = F.greatest(F.lit(1), F.ceil(size / BUCKET_BYTES)).cast("int")
    dealt = found.withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("parts", "other")


def _trees(sent: DataFrame, columns: list[str], solve: Callable) -> DataFrame:
    """(a, b) of each group (bucket, i, j): what `solve(rows, i, j)` gives for its rows, which come next to each other."""
    keys = ["bucket", "i", "j"]
    rows = sent.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            out = []
            for bucket, i, j, *row in zip(*(batch.column(c).to_pylist() for c in (*keys, *columns))):
                if (bucket, i, j) != key:
                    if len(group) > 1:
                        out += solve(group, key[1], key[2])
                    key, group = (bucket, i, j), []
                group.append(row)
            yield _pairs(out)
        if len(group) > 1:
            yield _pairs(solve(group, key[1], key[2]))

    return map_arrow(rows, run, "a bigint, b bigint").distinct()


def alike(rows: list[tuple[int, int, int, bytes]], first: int, second: int, num: int, den: int) -> list[tuple[int, int]]:
    """(member, smallest member) of each tree of sets (rep, block, n, sketch) whose sketches leave a link possible.

    Sketches are folded to the shortest one's width, which keeps their bound.
    """
    rows = list({r[0]: r for r in rows}.values())
    width = min(len(r[3]) for r in rows)
    drawn = np.empty((len(rows), width // 8), np.uint64)
    for i, r in enumerate(rows):
        x = np.frombuffer(r[3], np.uint64)
        while len(x) * 8 > width:
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        drawn[i] = x
    sizes, blocks = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])

    def near(x: int) -> np.ndarray:
        differ = np.bitwise_count(drawn ^ drawn[x]).sum(1, dtype=np.int64)
        fits = den * np.minimum(sizes, sizes[x]) >= num * np.maximum(sizes, sizes[x])
        return fits & (differ * (den + num) <= (sizes + sizes[x]) * (den - num))

    return _joined([r[0] for r in rows], blocks, first, second, near)


def families(found: DataFrame, drawn: DataFrame, num: int, den: int, paths: list[str]) -> DataFrame:
    """(bucket, rep, weight): groups of sets that may be linked, over any number of steps; each set is in one.

    Sets that share an entry meet as sketches (rep, n, sketch), a sixty-fourth of their size. A linked pair shares an entry and passes the
    sketches' bound, so no link leaves its group.
    """
    met = _dealt(found.drop("n").join(drawn, "rep"), F.col("weight") / 4)
    roots = cut_lineage(components(_trees(met, ["rep", "block", "n", "sketch"], lambda rows, i, j: alike(rows, i, j, num, den)), paths), "roots", paths)
    placed = roots.select(F.col("node").alias("rep"), F.col("root").alias("bucket")).unionByName(
        roots.select(F.col("root").alias("rep"), F.col("root").alias("bucket")).distinct()).distinct().join(drawn.select("rep", "n"), "rep")
    sizes = placed.groupBy("bucket").agg(F.sum("n").alias("weight"))
    return placed.join(sizes, "bucket").select("bucket", "rep", "weight")


def sets_in_groups(docs: DataFrame, doc: str, text: str, places: DataFrame, words: int) -> DataFrame:
    """(bucket, i, j, rep, block, set): the set of each class in each of its places, read again from one document's text.

    `places` has one row per class: its document's id and text hash, its fingerprint and the places to go. Texts move once, to meet
    their places; from there sets move once, to their groups. Of copies under one id, one is read.
    """
    source = docs.select(F.col(doc).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    met = source.join(places, source["id"].eqNullSafe(places["doc_id"]) & (source["hash"] == places["text_hash"]))
    met = met.select("text", "rep", "f1", "f2", "n", "places")
    names = ["bucket", "i", "j", "rep", "block", "set"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in pieces(batch, "text"):
                out, held = [], 0
                for raw, rep, f1, f2, n, where in zip(utf8(piece.column("text")), *(piece.column(c).to_pylist() for c in ("rep", "f1", "f2", "n", "places"))):
                    if rep in seen:
                        continue
                    s = shingles(raw, words)
                    if (*fingerprint(s), len(s)) != (f1, f2, n):
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(rep)
                    content = s.tobytes()
                    for p in where:
                        out.append((p["bucket"], p["i"], p["j"], rep, p["block"], content))
                        held += len(content)
                        if held > BUCKET_BYTES:
                            yield _columns(out, names, kinds)
                            out, held = [], 0
                yield _columns(out, names, kinds)

    return map_arrow(met, run, "bucket bigint, i int, j int, rep bigint, block int, set binary")


def _columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def verified(rows: list[tuple[int, int, bytes]], first: int, second: int, num: int, den: int) -> list[tuple[int, int]]:
    """(member, smallest member) of each tree of links among (rep, block, set), between blocks `first` and `second` if they differ."""
    rows = list({r[0]: r for r in rows}.values())
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]

    def linked(x: int) -> np.ndarray:
        low, high = np.searchsorted(tokens, sets[x], "left"), np.searchsorted(tokens, sets[x], "right")
        many = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        both = np.bincount(owner[at], minlength=len(rows))
        return den * both >= num * (sizes[x] + sizes - both)

    return _joined([r[0] for r in rows], np.array([r[1] for r in rows]), first, second, linked)


def _joined(reps: list[int], blocks: np.ndarray, first: int, second: int, near: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """(member, smallest member) of each tree that `near`, a mask of all for each, connects; between two blocks if they differ."""
    parent = list(range(len(reps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    trees = len(reps)
    for x in range(len(reps)):
        if trees == 1:
            break
        if first != second and blocks[x] != first:
            continue
        mask = near(x)
        if first != second:
            mask &= blocks == second
        mask[x] = False
        for y in np.flatnonzero(mask):
            a, b = root(x), root(int(y))
            if a != b:
                parent[a] = b
                trees -= 1
    roots = [root(x) for x in range(len(reps))]
    low: dict[int, int] = {}
    for r, rep in zip(roots, reps):
        low[r] = min(low.get(r, rep), rep)
    return [(rep, low[r]) for r, rep in zip(roots, reps) if rep != low[r]]


def links(found: DataFrame, wanted: DataFrame, docs: DataFrame, doc: str, text: str, words: int, num: int, den: int) -> DataFrame:
    """(a, b): stars over what the links of each group connect."""
    place = F.struct("bucket", "i", "j", "block")
    places = _dealt(found, F.col("weight") * 8).groupBy("rep").agg(F.collect_list(place).alias("places"))  # as many as its group has blocks
    sets = sets_in_groups(docs, doc, text, wanted.join(places, "rep"), words)
    return _trees(sets, ["rep", "block", "set"], lambda rows, i, j: verified(rows, i, j, num, den))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def place(docs: DataFrame, doc: str, text: str, words: int, num: int, den: int) -> DataFrame:
    """doc_id, n, f1, f2 of every row, and if it has shingles the `root` of its component and the smallest doc_id in it."""
    spark, entries, used = docs.sparkSession, [], []
    full = cut_lineage(index(docs, doc, text, words, num, den), "index", entries)
    rows = cut_lineage(full.drop("entries"), "rows")
    classes = rows.where("n > 0").groupBy("f1", "f2", "n").agg(
        F.min("row").alias("rep"), F.min("doc_id").alias("doc_id"), F.min(F.struct("row", "doc_id", "hash", "sketch")).alias("first")
    )
    found = cut_lineage(buckets(full, classes, entries), "buckets", used)
    discard(spark, *entries)  # nothing that follows reads the entries
    met = classes.join(found.select("rep").distinct(), "rep").select(
        "rep", "f1", "f2", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.hash").alias("text_hash"), F.col("first.sketch").alias("sketch"))
    met = cut_lineage(met, "wanted", used)  # the first row of a set is the first of its task, so it has a sketch
    groups = cut_lineage(families(found, met.select("rep", "n", "sketch"), num, den, used), "families", used)
    edges = links(groups, met.drop("sketch"), docs, doc, text, words, num, den)
    roots = components(edges)
    discard(spark, *used)
    placed = classes.drop("first").join(roots, classes["rep"] == roots["node"], "left").withColumn("root", F.coalesce("root", "rep"))
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = placed.select("f1", "f2", "n", "root").join(smallest, "root")
    return rows.select("doc_id", "n", "f1", "f2").join(known, ["f1", "f2", "n"], "left")


def join(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable over links."""
    out = place(docs, doc, text, words, num, den)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row of each component, in the columns of `docs`: the smallest by id (null ids last), text and place.

    Rows are told apart by id and set, so unlinked texts under one id, or without an id, do not touch each
    other. Rows without shingles link to nothing and stay. What stays is decided on ids and fingerprints; texts move
    once, to meet the decision, and only rows that share the head's id and component move again.
    """
    docs, names = aside(docs, OWN)
    doc, text = names[doc], names[text]
    placed = place(docs, doc, text, words, num, den).where("root IS NOT NULL")
    # A component without any id has a null component_id, so only there null ids are heads.
    heads = placed.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(
        F.col("doc_id").alias("_doc"), F.col("n").alias("_m"), F.col("f1").alias("_g1"), F.col("f2").alias("_g2"), F.col("root").alias("_root")).agg(F.count(F.lit(1)).alias("_rows"))
    several = heads.groupBy("_root").agg((F.sum("_rows") > 1).alias("_many"))
    heads = cut_lineage(heads.join(several, "_root"), "heads").drop("_rows")

    def make():
        def work(piece: pa.RecordBatch) -> list:
            sets = [shingles(x, words) for x in utf8(piece.column(text))]
            prints = [fingerprint(s) for s in sets]
            return [[len(s) for s in sets], [a for a, _ in prints], [b for _, b in prints]]

        return work

    printed = annotate(docs, text, [long("_n"), long("_f1"), long("_f2")], make)
    same = printed[doc].eqNullSafe(heads["_doc"]) & (F.col("_n") == F.col("_m")) & (F.col("_f1") == F.col("_g1")) & (F.col("_f2") == F.col("_g2"))
    found = printed.join(heads, same, "left").where("_n = 0 OR _root IS NOT NULL").select(*docs.columns, "_root", "_many")
    found = cut_lineage(found, "kept").withColumn("_row", F.monotonically_increasing_id())
    alone = found.where("_many IS NULL OR NOT _many").select(*docs.columns)
    first = F.min_by(F.struct(*docs.columns), F.struct(text, "_row")).alias("_kept")
    return named_back(alone.unionByName(found.where("_many").groupBy("_root").agg(first).select("_kept.*")), names)
