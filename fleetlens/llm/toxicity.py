"""Toxicity through a noisy channel: texts are restored from obfuscation, then scored.

A writer's letters pass a channel that swaps them for look-alikes, sets blanks between them or repeats them.
Every odd stretch of a text becomes a lattice of the letters each sign may stand for, and Viterbi's search
takes the likeliest path under the channel's costs and a character trigram model. A stretch without odd
signs has one path, so only words with look-alikes, runs or unlikely doubled letters are decoded, and rows of three or more single
signs, where each gap is either closed or a word's border. Long stretches are decoded in overlapping pieces.
Words that are parted into longer fragments ("id iot") stay parted.

The language model counts trigrams over all documents; the alphabet bounds its table. The label model is fitted on
a bounded sample, about `SAMPLE` rows of each label: character n-grams of restored words, kept if they are
far likelier in toxic documents, and a logistic regression on their presence.

Defined results: null and empty texts score as a text without any of the n-grams; rows with a null label
teach nothing, several labels of one id all count; without labels every score is 0; repeated rows are
each answered; texts are read whole. `score` replaces a column of its name; other columns stay as they came.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.batches import annotate, double, map_arrow, pieces, strings

SAMPLE = 1500
FEATURES = 1500
LEAST_DOCS = 8
LENGTHS = (3, 4, 5, 6)
#: Restored words that a task remembers.
REMEMBERED = 300_000

# ---- alphabet and language model ------------------------------------------------------------------------------

#: Classes: 0 for anything but a letter, a-z, the lower-case letters of Latin-1, and one for all other letters.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [0xDF, *range(0xE0, 0xF7), *range(0xF8, 0x100)]))
OTHER = len(LETTERS) + 1
K = OTHER + 1
CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}
_TABLE = np.array([CLASS.get(chr(i).lower(), OTHER if chr(i).isalpha() else 0) for i in range(0x10000)], np.int64)
#: Weight of the shorter context in a trigram's probability.
BACKOFF = 20.0


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.where(points < 0x10000, _TABLE[np.minimum(points, 0xFFFF)], OTHER)


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n) of the trigrams of all texts; each task adds up its own first."""

    def run(batches):
        total = np.zeros(K**3, np.int64)
        for batch in batches:
            for piece in pieces(batch, text):
                c = classes("\n\n".join(strings(piece.column(text))) + "\n\n")
                c = c[(c != 0) | np.concatenate([[True], c[:-1] != 0])]
                if len(c) > 2:
                    total += np.bincount((c[:-2] * K + c[1:-1]) * K + c[2:], minlength=K**3)
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(total[codes])], names=["code", "n"])

    counted = map_arrow(docs.select(text), run, "code bigint, n bigint")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-probabilities of the third class after two, from at most K ** 3 counts."""
    n = np.zeros(K**3)
    for r in trigram_counts(docs, text).toLocalIterator():
        n[r.code] = r.n
    n = n.reshape(K, K, K)
    single = n.sum((0, 1)) + 1
    single /= single.sum()
    pair = n.sum(0)
    pair = (pair + BACKOFF * single) / (pair.sum(1, keepdims=True) + BACKOFF)
    return np.log((n + BACKOFF * pair) / (n.sum(2, keepdims=True) + BACKOFF)).astype(np.float32)


# ---- channel and decoding -------------------------------------------------------------------------------------

# What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou", "#": "h", "%": "", "&": "",
}
#: Costs, in nats: a sign taken for a letter, a sign taken for itself (a border), a letter of a run dropped or kept twice.
SWAP, BORDER, DROPPED, TWICE = 1.0, 3.0, 0.2, 1.5
#: What stands for a gap between spaced-out letters, and the costs, in nats, of closing one up: a blank or mark, or more than one.
GAP, CLOSED, CLOSED_WIDE = "\x1f", 0.1, 2.0
#: A doubled letter less likely than this, as a log-probability, is in doubt.
UNLIKELY = -6.0
#: Characters of a long stretch that are decoded at a time, and how far the next piece reaches back.
PIECE, OVERLAP = 60, 15

ODD = re.compile("[" + re.escape("".join(LOOKALIKES)) + r"]|(.)\1\1")
WORD = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*][^\W_]){3,}(?![^\W_])")
#: A row of single signs, of which the lattice decides what belongs together.
ROW = re.compile(r"(?<!\S)[^\s.,;:?\"'\-_/](?:[\s.\-_*/]{1,3}[^\s.,;:?\"'\-_/]){2,}(?!\S)")
#: Parts that every match of `SPACED` and of `ROW` holds, quick to look for.
IN_SPACED = re.compile(r"[ .\-_*][^\W_][ .\-_*][^\W_][ .\-_*]")
IN_ROW = re.compile(r"[\s.\-_*/][^\s.,;:?\"'\-_/][\s.\-_*/]{1,3}[^\s.,;:?\"'\-_/](?!\S)")
SEPARATORS = re.compile(r"[\s.\-_*/]+")
DOUBLED = re.compile(r"([^\W\d_])\1")


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each place of a word the texts it may stand for, with their costs."""
    out: list[list[tuple[str, float]]] = []
    for sign, group in itertools.groupby(word):
        n = len(list(group))
        if sign == GAP:
            out.append([(" ", 0.0), ("", CLOSED if n == 1 else CLOSED_WIDE)])
        elif sign in CLASS or (sign.isalpha() and sign not in LOOKALIKES):
            out.append([(sign, 0.0)] if n == 1 else [(sign, 0.0 if n == 1 else DROPPED * (n - 1)), (sign * 2, 0.0 if n == 2 else TWICE)])
        else:
            choices = [(" ", BORDER)] + [(c, SWAP * n) for c in LOOKALIKES.get(sign, "")]
            out.append(choices + [(c * 2, SWAP * n) for c in LOOKALIKES.get(sign, "") if n == 2])
    return out


def best_path(word: str, model: np.ndarray) -> tuple[float, str]:
    """Cost and text of the likeliest path: Viterbi over the lattice, the last two letters as state."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for choices in [*lattice(word), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, said) in states.items():
            for letters, price in choices:
                x, y, total = a, b, cost + price
                for c in letters:
                    k = CLASS.get(c, OTHER if c.isalpha() else 0)
                    if not k and not y:
                        continue
                    total -= float(model[x, y, k])
                    x, y = y, k
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, said + letters)
        states = after
    return min(states.values())


def decode(word: str, model: np.ndarray) -> str:
    """The likeliest text for a stretch, decoded in overlapping pieces if it is long."""
    starts = range(0, max(1, len(word) - OVERLAP), PIECE - OVERLAP) if len(word) > PIECE else [0]
    return " ".join(best_path(word[i:i + PIECE], model)[1].strip() for i in starts)


def doubtful(token: str, model: np.ndarray) -> bool:
    """Whether some letter is doubled where the language model does not expect it."""
    for m in DOUBLED.finditer(token):
        k = CLASS.get(m[1])
        before = CLASS.get(token[m.start() - 1], 0) if m.start() else 0
        if k and model[before, k, k] < UNLIKELY:
            return True
    return False


def restore(token: str, model: np.ndarray) -> list[str]:
    """The words of a lower-case token: as written, and as decoded where it looks odd."""
    if GAP in token:
        return [w for w in decode(token, model).split(" ") if w]
    if token.isalpha() and not DOUBLED.search(token):
        return [token]  # a word, and nothing odd in it
    found = WORD.findall(token)
    if not found:
        return found
    if ODD.search(token):
        # Marks around a word are borders; inside it, every sign is in doubt.
        for part in re.findall(r"[^\s.,;:?\"']+", token):
            core = part.rstrip("!|*#%&$+(@")
            for written in {part, core}:
                if written and (ODD.search(written) or doubtful(written, model)):
                    found += decode(written, model).split(" ")
    elif doubtful(token, model):
        for word in list(found):
            if doubtful(word, model):
                found += decode(word, model).split(" ")
    return [w for w in found if w]


def tokens(text: str) -> list[str]:
    """Lower-case tokens of a whole text; rows of single letters are tokens as they are, closed up, and with their gaps in doubt."""
    lowered = text.lower()
    closed = [re.sub(r"[ .\-_*]", "", m[0]) for m in SPACED.finditer(lowered)] if IN_SPACED.search(lowered) else []
    rows = [SEPARATORS.sub(lambda g: GAP * min(len(g[0]), 2), m[0]) for m in ROW.finditer(lowered)] if IN_ROW.search(lowered) else []
    return lowered.split() + closed + [r for r in rows if WORD.search(r)]


def grams(word: str) -> set[str]:
    w = f"^{word}$"
    return {w[i:i + n] for n in LENGTHS for i in range(len(w) - n + 1)}


#: Known n-grams with their numbers, and before them the first characters that each starts with, as many as the shortest n-gram has.
Known = tuple[frozenset[str], dict[str, int]]


def by_head(known: dict[str, int]) -> Known:
    return frozenset(g[:LENGTHS[0]] for g in known), known


def held(word: str, known: Known) -> list[int]:
    """Numbers of the known n-grams in a word: those of `grams(word)` that are known."""
    heads, numbers = known
    w = f"^{word}$"
    starts = [i for i in range(len(w) - LENGTHS[0] + 1) if w[i:i + LENGTHS[0]] in heads]
    return [numbers[g] for i in starts for n in LENGTHS if (g := w[i:i + n]) in numbers]


# ---- label model ----------------------------------------------------------------------------------------------

def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """About `rows` labelled texts of each label, drawn by hash: (text, label, share of its label that was drawn)."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc).isNotNull()).select(doc, F.col(label).cast("int").alias("label"))
    share = known.groupBy("label").agg(F.least(F.lit(1.0), F.lit(float(rows)) / F.count(F.lit(1))).alias("share"))
    drawn = known.join(F.broadcast(share), "label")  # two rows
    drawn = drawn.where(F.pmod(F.xxhash64(doc, F.lit(7)), F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    # About 2 * rows ids, whatever the size of the corpus.
    return docs.select(doc, text).join(F.broadcast(drawn), doc).select(F.col(text).alias("text"), "label", "share")


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, label: str = "toxic", rows: int = SAMPLE, doc: str = "doc_id", text: str = "text") -> tuple[dict[str, float], float]:
    """Weights of n-grams and the intercept."""
    drawn = sample(docs, labels, label, rows, doc, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def presence(batches):
        """(gram, positive, negative) documents of a task, and the numbers of documents under the empty gram."""
        lm, seen = shared.value, ({}, {})
        counts = (Counter(), Counter())
        for batch in batches:
            for x, y in zip(strings(batch.column("text")), batch.column("label").to_pylist()):
                counts[y][""] += 1
                counts[y].update(set().union(*(_known(w, lm, seen[0]) for w in set(tokens(x)))))
        # Also n-grams without a positive here: other tasks may hold one, and the sample bounds them.
        both = sorted(counts[1].keys() | counts[0].keys())
        yield pa.RecordBatch.from_arrays([
            pa.array(both, pa.string()), pa.array([counts[1][g] for g in both], pa.int64()), pa.array([counts[0][g] for g in both], pa.int64())
        ], names=["gram", "pos", "neg"])

    counted = map_arrow(drawn, presence, "gram string, pos bigint, neg bigint").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = drawn.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("share").alias("share")).collect()
    drawn_of = {r.label: (r.n, r.share) for r in total}
    if set(drawn_of) != {0, 1}:
        return {}, (4.0 if 1 in drawn_of else -40.0)
    p, q = drawn_of[1][0], drawn_of[0][0]
    lift = (F.col("pos") + 0.5) / (p + 1) / ((F.col("neg") + 0.5) / (q + 1))
    best = counted.where((F.col("gram") != "") & (F.col("pos") >= min(LEAST_DOCS, max(2, p // 20))) & (lift > 4)).orderBy(
        (F.log(lift) * F.col("pos")).desc(), "gram").limit(FEATURES)
    chosen = {r.gram: i for i, r in enumerate(best.collect())}
    names = docs.sparkSession.sparkContext.broadcast(chosen)

    def rows_of(batches):
        lm, heads, seen = shared.value, by_head(names.value), {}
        for batch in batches:
            found = [sorted(_features(x, lm, heads, seen)) for x in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["label", "found"])

    data = map_arrow(drawn, rows_of, "label int, found array<int>").collect()
    weights, bias = regress([r.found for r in data], np.array([r.label for r in data], float), len(chosen))
    # The two labels were drawn at different rates.
    bias += math.log(drawn_of[0][1] / drawn_of[1][1])
    return {g: float(weights[i]) for g, i in chosen.items()}, float(bias)


def regress(found: list[list[int]], y: np.ndarray, size: int, rounds: int = 800, ridge: float = 5e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on presence by gradient descent with momentum; weights stay at or above 0."""
    x = np.zeros((len(found), size + 1), np.float32)
    for i, f in enumerate(found):
        x[i, f] = 1 / math.sqrt(max(len(f), 1))
        x[i, size] = 1
    w, v = np.zeros(size + 1, np.float32), np.zeros(size + 1, np.float32)
    w[size] = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        v = 0.9 * v + x.T @ (y - p) / len(y) * 4 - ridge * np.append(w[:size], 0)
        w = w + v
        w[:size] = np.maximum(w[:size], 0)
    return w[:size], float(w[size])


def _known(token: str, model: np.ndarray, seen: dict) -> frozenset:
    found = seen.get(token)
    if found is None:
        if len(seen) > REMEMBERED:
            seen.clear()
        found = seen[token] = frozenset().union(*map(grams, restore(token, model)))
    return found


def _features(text: str, model: np.ndarray, known: Known, seen: dict) -> set[int]:
    """Numbers of the known n-grams in a whole text."""
    out: set[int] = set()
    words = set(tokens(text))
    new = [w for w in words if w not in seen]
    if len(seen) + len(new) > REMEMBERED:
        seen.clear()
        new = list(words)
    for w in new:
        hit = frozenset(n for r in restore(w, model) for n in held(r, known))
        seen[w] = hit or None
    for hit in filter(None, map(seen.__getitem__, words)):
        out |= hit
    return out


def score(docs: DataFrame, model: np.ndarray, weights: dict[str, float], bias: float, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with `score`, in one narrow pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast((model, {g: i for i, g in enumerate(weights)}, np.array([*weights.values(), 0.0]), bias))

    def make() -> Callable:
        lm, known, values, start = shared.value
        heads, seen = by_head(known), {}

        def one(x: str) -> float:
            found = list(_features(x, lm, heads, seen)) if known else []
            total = start + (float(values[found].sum()) / math.sqrt(len(found)) if found else 0.0)
            return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))

        return lambda piece: [list(map(one, strings(piece.column(text))))]

    return annotate(docs, text, [double("score")], make, keep)
