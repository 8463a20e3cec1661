"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items in documents.

Texts are lower-cased (A-Z only) and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is a
run of `width` consecutive item words; an item with fewer words, but not none, is one window. Both
sides are searched as bytes ` w1 w2 ... wn `, so a match always covers whole words.

The windows are bounded in number only by the benchmark. It is cut into blocks of at most
`block_bytes` of normalised text; documents pass over one block at a time, and with more than one
block the pass is written to the shared folder in between. No document is shuffled.

Defined results: null or wordless texts have no words and no hits; a null item text has no window; an
item with null id takes part in hits but not in the list of items; items with equal ids are one item;
repeated documents are each answered; an empty benchmark hits nothing; an empty table stays empty; very long texts are
searched whole. `find_hits` replaces columns named as its own; `drop_contaminated` gives all columns back as they came.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.batches import annotate, aside, named_back, utf8
from fleetlens.session import cut_lineage

WIDTH = 10
#: Bytes of benchmark text held by a task at a time; the matcher takes up to 60 times as much.
BLOCK_BYTES = 4 << 20
#: Pattern classes by shortest length in bytes, with the block length whose hash gives the shift.
CLASSES = ((32, 8), (16, 6), (8, 4), (0, 3))

#: Separators become a space, A-Z become a-z, everything else stays.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass
class Matcher:
    """Windows of one length class.

    `shift` is indexed by the masked CRC of a block of `block` bytes and says how far the search may
    jump. Where it is 0 the block may end a window; the windows with that suffix hash are
    `order[first:last]`, found by bisection in `suffix`, and are compared byte by byte.
    """

    block: int
    mask: int
    shift: bytes
    suffix: np.ndarray
    windows: list[bytes]
    items: list[tuple[int, ...]]
    least: int

    def find(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, window) of every occurrence."""
        found = []
        at, block, mask, shift, crc = self.least, self.block, self.mask, self.shift, zlib.crc32
        end = len(text)
        while at <= end:
            key = crc(text[at - block:at]) & mask
            step = shift[key]
            if step:
                at += step
                continue
            first = int(np.searchsorted(self.suffix, key, "left"))
            while first < len(self.suffix) and self.suffix[first] == key:
                window = self.windows[first]
                if text.startswith(window, max(at - len(window), 0)) and at >= len(window):
                    found.append((at - len(window), at, first))
                first += 1
            at += 1
        return found


def build(items: list[tuple[str | None, bytes]], width: int = WIDTH) -> list[Matcher]:
    """Matchers, one for each class of window lengths, over (item id, text)."""
    holders: dict[bytes, set[str | None]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            holders.setdefault(b" " + b" ".join(w[i:i + width]) + b" ", set()).add(item)
    matchers = []
    above = 1 << 60
    for shortest, block in CLASSES:
        windows = [x for x in holders if shortest <= len(x) < above]
        above = shortest
        if windows:
            matchers.append(_matcher(windows, holders, block))
    return matchers


def _matcher(windows: list[bytes], holders: dict[bytes, set[str | None]], block: int) -> Matcher:
    least = min(map(len, windows))
    jump = min(least - block + 1, 255)
    size = 1 << max(12, (4 * sum(map(len, windows)) // 8).bit_length())
    shift = bytearray([jump]) * size
    keys = []
    for x in windows:
        for back in range(jump):
            end = len(x) - back
            key = zlib.crc32(x[end - block:end]) & size - 1
            if not back:
                keys.append(key)
            if back < shift[key]:
                shift[key] = back
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return Matcher(
        block, size - 1, bytes(shift), np.array(keys, np.int64)[order], [windows[i] for i in order],
        [tuple(i for i in holders[windows[k]] if i is not None) for k in order], least,
    )


def scan(matchers: list[Matcher], text: bytes) -> tuple[int, list[int], set[str]]:
    """Words of a text, hit word ranges as a flat list (first, end, first, end, ...), and the item ids met."""
    found = words(text)
    flat = b" " + b" ".join(found) + b" "
    spans, items = [], set()
    for m in matchers:
        for start, end, k in m.find(flat):
            spans.append((start, end))
            items.update(m.items[k])
    ranges: list[int] = []
    at = count = 0
    for start, end in sorted(spans):
        count += flat.count(b" ", at, start)
        at = start
        last = count + flat.count(b" ", start, end) - 1
        if ranges and count <= ranges[-1]:
            ranges[-1] = max(ranges[-1], last)
        else:
            ranges += [count, last]
    return len(found), ranges, items


def merge(a: list[int], b: list[int]) -> list[int]:
    """Union of two flat lists of ranges."""
    out: list[int] = []
    for first, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [first, end]
    return out


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """Items as lists of at most `block_bytes` of text each (or one item), read one block at a time."""
    sized = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= block_bytes:
        yield [(r.item, r.text.encode()) for r in sized.collect()]
        return
    parts = 2 * -(-total // block_bytes)
    dealt = cut_lineage(sized.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts))), "benchmark")
    for part in range(parts):
        block, held = [], 0
        for r in dealt.where(F.col("part") == part).toLocalIterator():
            if block and held + len(r.text) > block_bytes:
                yield block
                block, held = [], 0
            block.append((r.item, r.text.encode()))
            held += len(block[-1][1])
        if block:
            yield block


ARRAY = T.ArrayType(T.LongType())


def find_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = WIDTH, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None,
) -> DataFrame:
    """`docs` with `n_words`, `hit_ranges` (flat first, end word positions) and sorted `hit_items`."""
    spark = docs.sparkSession
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("hit_ranges", ARRAY),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
    keep = [c for c in keep or docs.columns if c not in {f.name for f in fields}]
    out = None
    for block in benchmark_blocks(benchmark, item, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(build(block, width))
        carried = out is not None
        source = cut_lineage(out, "hits") if carried else docs.select(*dict.fromkeys([*keep, text]))
        out = _pass(source, text, fields, shared, carried)
    if out is None:
        nothing = spark.sparkContext.broadcast([])
        out = _pass(docs.select(*dict.fromkeys([*keep, text])), text, fields, nothing, False)
    return out.select(*keep, *(f.name for f in fields))


def _pass(source: DataFrame, text: str, fields: list[T.StructField], shared, carried: bool) -> DataFrame:
    if carried:
        source = source.drop("_ranges", "_items").withColumnsRenamed({"hit_ranges": "_ranges", "hit_items": "_items"})

    def make():
        matchers = shared.value

        def work(piece: pa.RecordBatch) -> list:
            rows = [scan(matchers, x) for x in utf8(piece.column(text))]
            ranges, items = [r for _, r, _ in rows], [i for _, _, i in rows]
            if carried:
                ranges = [merge(a, b) for a, b in zip(ranges, piece.column("_ranges").to_pylist())]
                items = [a.union(b) for a, b in zip(items, piece.column("_items").to_pylist())]
            return [[n for n, _, _ in rows], ranges, [sorted(i) for i in items]]

        return work

    return annotate(source, text, fields, make)


def digest(hits: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row per document: words, hit words, items and their digest."""
    size = F.size("hit_ranges")
    hit = F.aggregate(
        F.sequence(F.lit(0), F.greatest(size - 2, F.lit(0)), F.lit(2)), F.lit(0).cast("bigint"),
        lambda s, i: s + F.get(F.col("hit_ranges"), i + 1) - F.get(F.col("hit_ranges"), i),
    )
    n_hit = F.when(size == 0, F.lit(0).cast("bigint")).otherwise(hit)
    return hits.select(
        doc, "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (size > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """Documents without any benchmark window, with the columns they came with, whatever their names."""
    moved, names = aside(docs, ["n_words", "hit_ranges", "hit_items", "_ranges", "_items"])
    return named_back(find_hits(moved, benchmark, names[text], width=width).where(F.size("hit_ranges") == 0), names)
