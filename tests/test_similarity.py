"""Near fingerprints and clusters against brute force, with buckets cut down to the last level."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import similarity


def signed(v):
    return v - 2**64 if v >= 2**63 else v


@pytest.fixture(scope="module")
def values():
    rng = random.Random(5)
    out = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(10):
            v = base
            for bit in rng.sample(range(64), rng.randint(0, 9)):
                v ^= 1 << bit
            out.add(v)
    shared = rng.getrandbits(16)
    out |= {shared << 48 | rng.getrandbits(48) for _ in range(60)}
    return sorted(signed(v) for v in out)


def distance(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def test_far_off_smallest_values_cost_no_pairs(spark):
    rng = random.Random(2)
    base = rng.getrandbits(62) | 1 << 61
    crowd = {base ^ sum(1 << b for b in rng.sample(range(60), 3)) for _ in range(500)}
    # Eight values, each the smallest of one of the crowd's slices and far from all of it.
    strangers = {base & (0xFF << 8 * i) for i in range(7)} | {base & (0xFF << 56)}
    df = spark.createDataFrame([(v,) for v in crowd | strangers], "simhash bigint")
    assert similarity.linking_pairs(df).count() < 12 * len(crowd)


@pytest.mark.parametrize("hot", [4096, 12, 2])
def test_near_values_share_a_band(spark, values, hot):
    df = spark.createDataFrame([(v,) for v in values], "simhash bigint")
    keys = {}
    for r in similarity.band_keys(df, hot).collect():
        keys.setdefault(r.simhash, set()).add(r.band)
    near = [(a, b) for a in values for b in values if a < b and distance(a, b) < 8]
    assert near and all(keys[a] & keys[b] for a, b in near)


def test_a_crowd_of_copies_stays_linear(spark):
    base = random.Random(1).getrandbits(63)
    crowd = sorted({base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)})
    df = spark.createDataFrame([(v,) for v in crowd], "simhash bigint")
    assert similarity.linking_pairs(df).count() < 12 * len(crowd)
    assert similarity.clusters(df).select("cluster").distinct().count() == 1


@pytest.mark.parametrize("hot", [4096, 12, 2])
def test_clusters_equal_union_find(spark, values, hot):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and distance(a, b) < 8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    df = spark.createDataFrame([(v,) for v in values], "simhash bigint")
    got = {r.simhash: r.cluster for r in similarity.clusters(df, hot_rows=hot).collect()}
    assert got == {v: find(v) for v in values}


def test_long_texts_equal_statements(spark, sf):
    from fleetlens.functions import sqltext
    from suite.views import table

    docs = table(spark, sf, "documents").unionByName(
        spark.createDataFrame([(-1, "", None, None, 0)], table(spark, sf, "documents").schema)
    )
    whole = similarity.simhash_texts(docs, "doc_id", "text")
    each = docs.select("doc_id", sqltext.simhash64(sqltext.normalize_sql(F.col("text"))).alias("s"))
    assert whole.join(each, "doc_id").where(F.col("simhash") != F.col("s")).isEmpty()
    assert whole.where("doc_id = -1").first().simhash == 0


def test_a_crowd_is_joined_with_fewer_steps_than_members(monkeypatch):
    """Members of one crowd are hardly compared with each other, and a tree grown over blocks finds every link between them."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    crowd = sorted({signed(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))) for _ in range(3000)})
    apart = [signed(rng.getrandbits(64)) for _ in range(300)]
    values = np.array(crowd + apart, np.int64)
    compared, count = [], np.bitwise_count

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        def bitwise_count(self, x):
            compared.append(x.size)
            return count(x)

    monkeypatch.setattr(similarity, "np", Counted())
    whole = similarity.connected(values, np.zeros(len(values), int), 0, 0, 8)
    assert sum(compared) < len(values) ** 2 / 3
    assert {m for _, m in whole} | {a for a, _ in whole} >= set(crowd)
    blocks = np.array([hash(v) % 2 for v in values.tolist()])
    parent = {v: v for v in values.tolist()}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, j in ((0, 0), (0, 1), (1, 1)):
        here = (blocks == i) | (blocks == j)
        for a, b in similarity.connected(values[here], blocks[here], i, j, 8):
            parent[find(b)] = find(a)
    tree = {}
    for v in parent:
        tree.setdefault(find(v), set()).add(v)
    want = {}
    for a, m in whole:
        want.setdefault(a, {a}).add(m)
    assert sorted(map(sorted, want.values())) == sorted(sorted(t) for t in tree.values() if len(t) > 1)


def test_bands_of_a_few_thousand_are_not_cut(spark):
    """Every cut makes eight rows of one, so it waits until comparing would cost more."""
    rng = random.Random(6)
    df = spark.createDataFrame([(signed(rng.getrandbits(56) << 8),) for _ in range(5000)], "simhash bigint")
    assert similarity.band_keys(df).count() == 8 * 5000
