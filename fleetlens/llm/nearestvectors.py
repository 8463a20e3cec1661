"""Nearest vectors by largest inner product: multiprobe p-stable hashing, then exact reranking.

Geometry. Every vector x gets one more coordinate, sqrt(M^2 - |x|^2), M being the largest norm of all; a question is
scaled to norm M and gets a zero. Then the nearest by distance is the largest by inner product.

Index. In each of `TABLES` tables a vector falls into the bucket (floor((a_i x + b_i) / w)), i = 1..m, with Gaussian a_i
(the 2-stable distribution). m grows with the logarithm of the number of vectors, so that buckets keep their size. All vectors are
indexed; identical ones are indexed once, with the `TOP` + 1 smallest of their ids: no answer can hold more of them.

Probes. A question's neighbour at distance d has a projection that is off by a normal deviate of deviation d, so the chance that it lies
in a bucket is a product of normal interval probabilities. A question visits buckets in the order of that chance, the perturbed
ones after its own, until they add up to what is needed for `RECALL` over all tables. d is the distance of the last
neighbour wanted, as estimated on a documented sample (`SAMPLE` vectors, `ASKED` of them as questions, its `FAR` quantile). There is no cap on
probes. A question that has found fewer vectors than wanted is compared with all of them, in blocks.

Work. Vectors and questions meet in the bucket's task, vectors as a matrix of at most `BLOCK_ROWS` rows; a larger bucket is dealt over
blocks, each visited by all its questions, and questions stream past it in slices. A task merges the candidates of a
question over its buckets in a bounded table before they leave, `TOP` + 1 of each at most; then candidates of all tables are merged and reranked by the exact
inner product in double precision, ties to the smaller id. What leaves a task grows with its questions, not with pairs.

Uniformly random directions have no near neighbours: there nearly half of the buckets have to be visited for the promised recall,
whatever the index. On clustered vectors d is small and few are. Buckets are large, so that a visit is worth the vector it sends:
comparing with a few thousand rows costs less than sending the question once more.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an
id; shorter vectors count as filled up with zeros; identical rows count once; rows of one id with different vectors are
separate candidates, and none of them is a neighbour of its own id; no vectors give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.batches import map_arrow
from fleetlens.session import cut_lineage, spread

TOP, RECALL, TABLES = 20, 0.97, 2
#: Vectors that a bucket should hold, and rows of a matrix that a task holds.
BUCKET_ROWS, BLOCK_ROWS = 4096, 8192
#: Of the sample for the distance d: vectors, questions among them, quantile.
SAMPLE, ASKED, FAR = 8192, 512, 0.9
#: Slot width, as a multiple of the deviation of the projections.
WIDTH = 1.5
#: Questions of a slice, and of a task's table of candidates.
SLICE, MERGED = 512, 20_000


@dataclass(frozen=True)
class Index:
    """Parameters of the hash tables; `norm` is the largest norm, `reach` the distance to expect of the last neighbour wanted."""

    dim: int
    hashes: int
    width: float
    norm: float
    reach: float
    seed: int = 20

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """Directions (tables, hashes, dim + 1) and offsets."""
        rng = np.random.default_rng(self.seed)
        a = rng.standard_normal((TABLES, self.hashes, self.dim + 1))
        return a, rng.random((TABLES, self.hashes)) * self.width

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1)

    def asked(self, q: np.ndarray) -> np.ndarray:
        scaled = q * (self.norm / np.sqrt((q * q).sum(1)))[:, None]
        return np.concatenate([scaled, np.zeros((len(q), 1))], 1)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows in double precision, filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


def usable(vectors: DataFrame, vec: str, embedding: str) -> DataFrame:
    """(id, x) of the vectors that take part, x without trailing zeros, identical rows once."""
    x = F.col(embedding).cast("array<double>")
    whole = vectors.select(F.col(vec).cast("bigint").alias("id"), x.alias("x")).where("id IS NOT NULL AND x IS NOT NULL AND NOT exists(x, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity'))")
    # -0.0 + 0.0 is 0.0
    whole = whole.select("id", F.transform("x", lambda v: v + 0.0).alias("x"))
    last = F.array_max(F.transform("x", lambda v, i: F.when(v != 0, i + 1).otherwise(0)))
    return whole.select("id", F.slice("x", F.lit(1), F.coalesce(last, F.lit(0))).alias("x")).where("size(x) > 0")


def distinct_vectors(rows: DataFrame, top: int) -> DataFrame:
    """(x, first, ids): each vector once, with the `top` + 1 smallest ids that bear it; ranks are cut within the map tasks too."""
    by = Window.partitionBy("x").orderBy("id")
    few = rows.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= top + 1)
    return few.groupBy("x").agg(F.min("id").alias("first"), F.array_sort(F.collect_set("id")).alias("ids"))


def fit(vectors: DataFrame, top: int = TOP) -> Index | None:
    """Parameters for distinct vectors (x): counts and the largest norm over all, the distance from a sample of at most `SAMPLE`."""
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    n, dim, norm = vectors.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(F.sqrt(square))).first()
    if not n:
        return None
    share = min(1.0, 1.5 * SAMPLE / n)
    # the first by a hash, so the sample is the same whatever the partitions
    drawn = vectors.where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.xxhash64("x")).limit(SAMPLE).collect()
    x = np.zeros((len(drawn), dim))
    for i, row in enumerate(drawn):
        x[i, :len(row.x)] = row.x
    plain = Index(dim, 1, 1.0, norm, 1.0)
    points, asked = plain.lifted(x), plain.asked(x[:ASKED])
    rank = max(1, math.ceil(top * len(x) / n))
    far = np.sqrt(np.maximum(2 * norm**2 - 2 * asked @ points.T, 0))
    far[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    kept = np.sort(far, 1)[:, min(rank, len(x) - 1) - 1] if len(x) > 1 else np.array([norm])
    reach = float(np.quantile(kept, FAR)) or norm * 1e-6
    deviation = float((points @ np.random.default_rng(1).standard_normal((dim + 1, 64))).std(0).mean()) or norm
    # a slot as wide as WIDTH deviations leaves about 1.7 bits a hash; the exact number only moves the size of buckets
    hashes = max(1, round(math.log2(max(2, n / BUCKET_ROWS)) / 1.3))
    return Index(dim, hashes, WIDTH * deviation, norm, reach)


def chances(place: float, width: float, reach: float) -> list[tuple[float, int]]:
    """(log chance, slot) of the slots in which a neighbour of something at `place` may fall, best first."""
    out, own = [], math.floor(place / width)
    for way in (range(own, own + 1000), range(own - 1, own - 1000, -1)):
        for slot in way:
            p = 0.5 * (math.erf(((slot + 1) * width - place) / reach / math.sqrt(2)) - math.erf((slot * width - place) / reach / math.sqrt(2)))
            if p < 1e-9:
                break
            out.append((math.log(p), slot))
    return sorted(out, reverse=True) or [(0.0, own)]


def probes(places: np.ndarray, width: float, reach: float, need: float) -> Iterator[tuple[int, ...]]:
    """Buckets in the order of their chance, until it adds up to `need`.

    A state is the rank of the slot of every hash. Its successors raise one rank at or behind the last one raised, so each comes up once.
    """
    slots = [chances(p, width, reach) for p in places]
    heap = [(-sum(s[0][0] for s in slots), (0,) * len(slots), 0)]
    done = 0.0
    while heap and done < need:
        cost, ranks, last = heapq.heappop(heap)
        done += math.exp(-cost)
        yield tuple(s[r][1] for s, r in zip(slots, ranks))
        for i in range(last, len(slots)):
            r = ranks[i]
            if r + 1 < len(slots[i]):
                heapq.heappush(heap, (cost + slots[i][r][0] - slots[i][r + 1][0], (*ranks[:i], r + 1, *ranks[i + 1:]), i))


def _key(slots: np.ndarray) -> np.ndarray:
    """64-bit keys of rows of slots."""
    out = np.full(slots.shape[:-1], 0x9E3779B97F4A7C15, np.uint64)
    for i in range(slots.shape[-1]):
        out = (out ^ slots[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def indexed(vectors: DataFrame, index: Index) -> DataFrame:
    """(slot_table, bucket, first) and the vector, one row per table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = index.functions()
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(start, BLOCK_ROWS)
                points = index.lifted(matrix(piece.column("x"), index.dim))
                for t in range(TABLES):
                    keys = _key(np.floor((points @ a[t].T + b[t]) / index.width))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys), *piece.columns], names=["slot_table", "bucket", *piece.schema.names])

    return map_arrow(vectors.select("first", "ids", "x"), run, "slot_table int, bucket bigint, first bigint, ids array<bigint>, x array<double>")


def visits(questions: DataFrame, index: Index) -> DataFrame:
    """(slot_table, bucket, first, x): the buckets each question visits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = index.functions()
        need = 1 - (1 - RECALL) ** (1 / TABLES)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                asked = index.asked(matrix(piece.column("x"), index.dim))
                for t in range(TABLES):
                    places = asked @ a[t].T + b[t]
                    found = [_key(np.array(list(probes(p, index.width, index.reach, need)))) for p in places]
                    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(owner), t, np.int32)), pa.array(np.concatenate(found)), *(c.take(pa.array(owner)) for c in piece.columns)],
                        names=["slot_table", "bucket", *piece.schema.names])

    return map_arrow(questions.select("first", "x"), run, "slot_table int, bucket bigint, first bigint, x array<double>")


def candidates(points: DataFrame, asked: DataFrame, index: Index, top: int) -> DataFrame:
    """(question, first, ids, score): what questions find in the buckets they visit."""
    at = ["slot_table", "bucket"]
    sizes = points.groupBy(*at).agg(F.count(F.lit(1)).alias("rows"))
    blocks = sizes.select(*at, F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"))
    large = blocks.where("blocks > 1")
    held = points.join(large, at, "left").withColumn("block", F.pmod(F.xxhash64("first"), F.coalesce("blocks", F.lit(1))).cast("int"))
    # what no vector lies in is not visited
    going = asked.join(blocks, at).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met(held, going, index.dim, top)


def from_all(vectors: DataFrame, asked: DataFrame, n: int, index: Index, top: int) -> DataFrame:
    """`candidates` of questions that visit all `n` vectors, in blocks."""
    none = {"slot_table": F.lit(0), "bucket": F.lit(0).cast("bigint")}
    blocks = -(-n // BLOCK_ROWS)
    held = vectors.withColumns(none).withColumn("block", F.pmod(F.xxhash64("first"), F.lit(blocks)).cast("int"))
    return met(held, asked.withColumns(none).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), index.dim, top)


def met(held: DataFrame, going: DataFrame, dim: int, top: int) -> DataFrame:
    """(question, first, ids, score) of the vectors and questions of a block: up to `top` + 1 best for a question in each task."""
    at = ["slot_table", "bucket"]
    both = held.select(*at, "block", F.lit(0).alias("kind"), "first", "ids", "x").unionByName(
        going.select(*at, "block", F.lit(1).alias("kind"), "first", F.lit(None).cast("array<bigint>").alias("ids"), "x"))
    sent = both.repartition(*at, "block").sortWithinPartitions(*at, "block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, dict[int, tuple]] = {}
        key, rows, firsts, ids = None, None, None, []

        def ask(who: np.ndarray, q: np.ndarray) -> None:
            scores = q @ rows.T
            # one more than wanted, and a few in case the last digits change the order
            many = min(top + 5, scores.shape[1])
            best = np.argpartition(scores, -many, axis=1)[:, -many:]
            # the sum of a row of products is made in the same order wherever it is made
            exact = (q[:, None, :] * rows[best]).sum(2)
            # of scores that tie with the last one taken, those with the smaller ids
            lowest = exact.min(1) - 1e-9 * np.abs(exact).max(1)
            tied = (scores >= lowest[:, None]).sum(1) > many
            for i, question in enumerate(who.tolist()):
                table = merged.setdefault(question, {})
                spots, values = best[i], exact[i]
                if tied[i]:
                    spots = np.flatnonzero(scores[i] >= lowest[i])
                    values = (q[i] * rows[spots]).sum(1)
                    order = np.lexsort((firsts[spots], -values))[:top + 1]
                    spots, values = spots[order], values[order]
                for j, score in zip(spots.tolist(), values.tolist()):
                    table[int(firsts[j])] = (score, ids[j])
                if len(table) > 4 * top:
                    _shorten(table, top)

        parts: list[tuple] = []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*at, "block", "kind"))))
            start = 0
            while start < len(keys):
                stop = start + 1
                while stop < len(keys) and keys[stop] == keys[start] and (keys[start][3] == 0 or stop - start < SLICE):
                    stop += 1
                piece = batch.slice(start, stop - start)
                x, who = matrix(piece.column("x"), dim), piece.column("first").to_numpy()
                if keys[start][:3] != key:
                    key, rows, parts = keys[start][:3], None, []
                if keys[start][3] == 0:
                    parts.append((x, who, piece.column("ids").to_pylist()))
                else:
                    if parts:
                        more = [(rows, firsts, ids)] if rows is not None else []
                        groups = [*more, *parts]
                        rows, firsts = np.concatenate([g[0] for g in groups]), np.concatenate([g[1] for g in groups])
                        ids = [i for g in groups for i in g[2]]
                        parts = []
                    ask(who, x)
                    if len(merged) > MERGED:
                        yield _found(merged, top)
                        merged = {}
                start = stop
        yield _found(merged, top)

    return map_arrow(sent, run, "question bigint, first bigint, ids array<bigint>, score double")


def _shorten(table: dict[int, tuple], top: int) -> None:
    """Keep the best `top` + 1 vectors; of equal ones those with the smaller id."""
    best = heapq.nsmallest(top + 1, table.items(), key=lambda x: (-x[1][0], x[0]))
    table.clear()
    table.update(best)


def _found(merged: dict[int, dict[int, tuple]], top: int) -> pa.RecordBatch:
    rows = []
    for question, table in merged.items():
        _shorten(table, top)
        rows += [(question, first, ids, score) for first, (score, ids) in table.items()]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["question", "first", "ids", "score"])


def search(vectors: DataFrame, questions: DataFrame, vec: str = "vec_id", embedding: str = "embedding", top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: up to `top` nearest vectors of each question, nearest first.

    `questions` are rows like those of `vectors`, usually some of them; a row's own id is no answer to it.
    """
    rows = cut_lineage(distinct_vectors(usable(vectors, vec, embedding), top), "vectors")
    own = usable(questions, vec, embedding).distinct()
    asked = cut_lineage(own.groupBy("x").agg(F.min("id").alias("first")), "questions")
    index = fit(rows, top)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    found = cut_lineage(candidates(indexed(rows, index), visits(spread(asked), index), index, top).dropDuplicates(["question", "first"]), "candidates")
    # what the probes leave short is compared with all, so an answer is only short if the table is
    n, ids = rows.agg(F.count(F.lit(1)), F.sum(F.size("ids"))).first()
    full = found.groupBy("question").agg(F.sum(F.size("ids")).alias("ids")).where(F.col("ids") >= min(top + 1, ids))
    short = asked.join(full, F.col("first") == F.col("question"), "left_anti")
    if not short.isEmpty():
        found = found.unionByName(from_all(rows, short, n, index, top)).dropDuplicates(["question", "first"])
    nearest = Window.partitionBy("question").orderBy(F.desc("score"), "first")
    best = found.withColumn("_rank", F.row_number().over(nearest)).where(F.col("_rank") <= top + 1)
    # each question of a vector: its list less itself
    answers = best.select("question", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("question").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top + 1)
    listed = answers.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("_place", "vec_id", "score"))).alias("found"))
    known = listed.join(asked.select(F.col("first").alias("question"), "x"), "question")
    each = own.join(known, "x").select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda v: v["vec_id"] != F.col("id")), 1, top).alias("found"))
    return each.select("query_id", F.posexplode("found").alias("_at", "hit")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
