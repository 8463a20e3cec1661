"""Nearest vectors beside brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import nearestvectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, asked, top=20):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = {(i, tuple(np.float32(x) for x in v)) for i, v, _ in rows if i is not None and usable(v)}
    out = []
    for q, v in sorted(good):
        if q % asked == 0:
            scored = sorted((-math.fsum(float(a) * float(b) for a, b in zip(v, w)), i) for i, w in good if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:top])]
    return out


def run(df, asked=20):
    found = nearestvectors.search(df, df.where(F.col("vec_id") % asked == 0)).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found)


def recall(got, want):
    pairs = {(q, i) for q, _, i, _ in got}
    return sum((q, i) in pairs for q, _, i, _ in want) / len(want)


@pytest.mark.parametrize("kind", ["random", "clusters", "norms"])
def test_recall(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24))
    if kind == "clusters":
        x = rng.standard_normal((40, 24))[rng.integers(0, 40, 3000)] + 0.1 * x
    if kind != "norms":
        x /= np.linalg.norm(x, axis=1)[:, None]
    else:
        x *= rng.lognormal(0, 1, 3000)[:, None]
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    got, want = run(spark.createDataFrame(rows, SCHEMA)), brute(rows, 20)
    assert len(got) == len(want) and recall(got, want) >= 0.9
    exact = {(q, i): s for q, _, i, s in want}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, _, i, s in got if (q, i) in exact)
    for (q, r, i, s), (p, t, j, u) in zip(got, got[1:]):
        assert p != q or (t == r + 1 and (-s, i) < (-u, j))


def test_copies_ties_and_rows_that_take_no_part(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)], 1) for i in range(150)]
    rows += [(10_000 - i, [1.0, 1.0, -0.5 + i / 4096], 1) for i in range(800)]  # as near to [1, -1, 0] and others, all of them
    rows += [(i, [1.0, 1.0, 0.5], 1) for i in range(150, 400)]
    rows += [(400, None, 1), (401, [], 1), (420, [0.0, 0.0, 0.0], 1), (440, [1.0, None, 0.0], 1), (460, [math.nan, 1.0, 1.0], 1), (480, [math.inf, 1.0, 1.0], 1),
             (None, [1.0, 1.0, 1.0], 1), (500, [2.0], 1), (500, [2.0], 1), (501, [0.5, -0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"first": F.lit(1), "x": F.lit("other"), "bucket": F.lit(0)})
    got, want = run(df), brute([(i, v and v + [0.0] * (3 - len(v)) if v is None or None not in v else v, k) for i, v, k in rows], 20)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert recall(got, want) >= 0.9
    mine = [g for g in got if g[0] in (160, 180)]
    assert mine == [w for w in want if w[0] in (160, 180)]


def test_few(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)) == []
    assert run(spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], SCHEMA)) == [(0, 1, 1, 2.0)]


def test_blocks_and_merging_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(rng.standard_normal((900, 8)))]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = run(df)
    points = nearestvectors.distinct_vectors(nearestvectors.usable(df, "vec_id", "embedding"), 20)
    index = nearestvectors.fit(points)
    asked = points.where("first % 20 = 0")
    whole = nearestvectors.candidates(nearestvectors.indexed(points, index), nearestvectors.visits(asked, index), index, 20)
    monkeypatch.setattr(nearestvectors, "BLOCK_ROWS", 16)
    cut = nearestvectors.candidates(nearestvectors.indexed(points, index), nearestvectors.visits(asked, index), index, 20)

    def best(df):
        met = {}
        for r in df.collect():
            met.setdefault(r.question, set()).add((-r.score, r.first))
        return {q: sorted(v)[:20] for q, v in met.items()}

    assert best(whole) == best(cut)
    assert len(plain) == 45 * 20


def test_probes_come_in_order_of_chance_and_once():
    places = np.array([0.3, 1.9, -2.2])
    seen = list(nearestvectors.probes(places, 1.0, 0.8, 0.995))
    p = [math.prod(math.exp(dict((s, c) for c, s in nearestvectors.chances(x, 1.0, 0.8))[k]) for x, k in zip(places, slots)) for slots in seen]
    assert len(set(seen)) == len(seen) and p == sorted(p, reverse=True) and 0.995 <= sum(p) < 1
