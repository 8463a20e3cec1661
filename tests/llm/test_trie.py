"""Prefix trie beside a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import prefixtrie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, every=100, most=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = own.get(c - c % every, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, below = defaultdict(int), {}
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key in sorted(members, key=len, reverse=True):
        leaves, saved = below.get(key, (0, 0))
        leaves += not children[key]
        saved += (len(members[key]) - 1) * len(key[-1][1]) if key else 0
        below[key] = leaves, saved
        if key:
            x = below.get(key[:-1], (0, 0))
            below[key[:-1]] = x[0] + leaves, x[1] + saved
    out = []
    for key, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        out.append((min(convs), len(key), parent, len(convs), children[key], *below[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(rows, pieces=None):
    turns = prefixtrie.rebuilt(prefixtrie.numbered(rows))
    found = prefixtrie.trie(turns, prefixtrie.conversations(rows.where("conv_id IS NOT NULL")), pieces)
    return sorted(map(tuple, found.collect()), key=str)


def some(rng, n, longest):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(0, longest)):
            rows.append((c * rng.choice([1, 1, 7]), rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "où", "", None, "long text"])))
    return rows


@pytest.mark.parametrize("pieces", [None, 13])
def test_nodes_equal_a_dictionary_of_prefixes(spark, pieces):
    rng = random.Random(4)
    rows = some(rng, 260, 9) + some(rng, 130, 3)
    rows += [(300, t, "user", "same") for t in range(40)] + [(c, t, "user", "same") for c in (301, 302, 399) for t in range(40)]
    rows += [(None, 0, "user", "nobody"), (500, 0, "user", "x" * 100_000), (501, 0, "user", "x" * 100_000), (501, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"pos": F.lit(7), "a": F.lit("other"), "owner": F.lit(1), "_piece": F.lit(2)})
    assert run(df, pieces) == brute(rows)


def test_few_conversations(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, None, None, None)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_deep_and_branching_at_every_turn(spark):
    rows = [(c, t, "user", "same" if t < 5 + 3 * c else f"own {c}") for c in range(20) for t in range(5 + 3 * c + 2)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
