"""Spelling variants beside all pairs of words."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from fleetlens.llm import spellings


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs, plant=True):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{i}:{run}".encode()) if plant and i is not None else 1
            counts[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    met = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if near(a, b):
            met[a].append(b)
            met[b].append(a)
    form = {}
    for w, others in met.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(met[w]), form[w], words.get(form[w]), root))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_equal_all_pairs(spark, docs_of, seed):
    rng = random.Random(seed)
    letters = "abé" if seed == 1 else "abcdeèÿ×"
    base = ["".join(rng.choices(letters, k=rng.randrange(4, 9))) for _ in range(60)]
    pool = list(base)
    for w in base:
        i = rng.randrange(len(w))
        pool += [w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]]
    docs = [(i, rng.choice([" ", "1", "."]).join(x.upper() if rng.random() < 0.1 else x for x in rng.choices(pool, weights=range(1, len(pool) + 1), k=200))) for i in range(40)]
    docs += [(41, None), (42, ""), (43, "aaaaa " * 4 + "aaaaaa " * 9 + "aaaaaaa " * 30), (43, "aaaaa bbbbb"), (None, "bbbbb bbbbb bbbbc"), (None, "bbbbc bbbbc")]
    assert sorted(map(tuple, spellings.variants(docs_of(docs), plant=True).collect())) == brute(docs)


def test_edges(spark, docs_of):
    assert spellings.variants(docs_of([])).collect() == []
    assert spellings.variants(docs_of([(1, None), (2, "ab cd")])).collect() == []
    long = "qwerty " * 3 + "x" * 300 + " " + "qwertz " * 7
    docs = [(i, long) for i in range(3)]
    assert sorted(map(tuple, spellings.variants(docs_of(docs)).collect())) == brute(docs, plant=False)


def test_slices_cut_between_words(monkeypatch):
    monkeypatch.setattr(spellings, "SLICE", 7)
    text = "some words, and one verylongword indeed " * 5
    assert "".join(spellings.slices(text)) == text
    assert [w for s in spellings.slices(text) for w in spellings.RUN.findall(s)] == spellings.RUN.findall(text)


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(6)
    for _ in range(300):
        word = "".join(rng.choices("abc", k=rng.randrange(5, 12)))
        cost = {a + b: rng.randrange(9) for a in "abc" for b in "abc"}
        chosen = spellings.prefix(word, lambda g: (cost[g], g))
        a, b = spellings.pivots(chosen)
        places = {i for _, i in chosen}
        assert {a, b} <= places and b - a >= 2
        least = min(cost[word[i:i + 2]] + cost[word[j:j + 2]] for i in places for j in places if j - i >= 2)
        assert cost[word[a:a + 2]] + cost[word[b:b + 2]] == least
