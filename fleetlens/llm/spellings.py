"""Spelling variants of the words of a corpus: pairs at edit distance one, by pivotal grams.

Words and their counts are collected in bounded tables within tasks, then summed. For the join, each word's bigrams
are ordered from the rarest (by the number of words with a bigram of the same class, then by text). Its prefix holds the
three first of them, and every bigram equal to the third; its pivots are the two disjoint bigrams of the prefix with the
fewest words in all, found by dynamic programming. One edit spoils at most one of two disjoint bigrams. So of two near
words, the one whose prefix ends earlier has a pivot that stays whole in the other, and there it is in the prefix: that is
the pivotal prefix filter for edit distance one.

Position limits. An edit outside a bigram lies on one side of it, so the other side stays letter for letter: the two
words share the text up to the bigram's end, or the text from its start, and their lengths differ by at most one. Index
entries are these texts of each prefix bigram with the word's length; pivots ask for them at three lengths.
Meeting words are verified by their exact distance.

A word's form is its near word with the most occurrences, if it has at least twice the word's own. Forms have
growing counts, so chains are shorter than the logarithm of the largest; roots are found by pointer doubling.

Defined results: a null text has no words; rows with a null id take part; repeated rows count again; words under
`LEAST` code points or `OFTEN` occurrences are no words at all; ties go to the smallest word in code-point order; no
documents give no rows; other columns are ignored. Texts are read whole, in slices between words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.batches import map_arrow
from fleetlens.session import cut_lineage

LEAST, OFTEN = 5, 3
RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
#: Distinct words a task counts before it passes them on, and characters of a text it takes at a time.
HELD, SLICE = 400_000, 1 << 22
#: Bigrams share counts by class, so their table has a fixed size.
CLASSES = 1 << 16
#: Bigrams that stay, and bigrams a distance of one may cost at most.
EDITS = 1


def blemished(doc_id: int | None, word: str, h: Callable = zlib.crc32) -> str:
    """The run as a planted misspelling has it: one code point less, in one of 97 of the pairs of document and run."""
    at = h(f"{doc_id}:{word}".encode())
    return word if at % 97 else word[:at % len(word)] + word[at % len(word) + 1:]


def slices(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + SLICE) if start + SLICE < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end


def counted(docs: DataFrame, doc: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """(word, n) of all texts, A-Z in lower case, with the misspellings of `blemished` if `plant`."""
    source = docs.select(F.col(doc).cast("string").alias("doc"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc").to_pylist(), batch.column("text")):
                raw = raw.as_py()
                if not raw:
                    continue
                start = None if doc_id is None or not plant else zlib.crc32(f"{doc_id}:".encode())
                # bytes.lower touches A-Z only; a text is cut into slices only if it is very long
                text = raw.lower().decode()
                found: Counter[str] = Counter()
                for part in slices(text):
                    found.update(RUN.findall(part))
                if start is None:
                    total.update({w: n for w, n in found.items() if len(w) >= LEAST})
                else:
                    for w, n in found.items():
                        at = zlib.crc32(w.encode(), start)
                        if not at % 97:
                            w = w[:at % len(w)] + w[at % len(w) + 1:]
                        if len(w) >= LEAST:
                            total[w] += n
                if len(total) > HELD:
                    yield _counts(total)
                    total = Counter()
        yield _counts(total)

    return map_arrow(source, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])


def gram_class(gram: str) -> int:
    return zlib.crc32(gram.encode()) % CLASSES


def prefix(word: str, rank: Callable[[str], tuple]) -> list[tuple[tuple, int]]:
    """(rank, place) of the rarest bigrams: 2 * `EDITS` + 1 of them, and all others equal to the last."""
    grams = sorted((rank(word[i:i + 2]), i) for i in range(len(word) - 1))
    size = 2 * EDITS + 1
    while size < len(grams) and grams[size][0] == grams[size - 1][0]:
        size += 1
    return grams[:size]


def pivots(chosen: list[tuple[tuple, int]]) -> list[int]:
    """Places of `EDITS` + 1 disjoint bigrams of the prefix with the fewest words in all.

    best[k] holds the cheapest k disjoint bigrams among those seen so far, by place; a bigram can only extend what ends two places before it.
    """
    grams = sorted((place, rank[0]) for rank, place in chosen)
    rows: list[list[tuple[int, tuple]]] = []
    for j, (place, cost) in enumerate(grams):
        last = j - 1
        while last >= 0 and grams[last][0] > place - 2:
            last -= 1
        before = rows[last] if last >= 0 else [(0, ())]
        row = list(rows[j - 1]) if j else [(0, ())]
        for k, (spent, places) in enumerate(before[:EDITS + 1]):
            made = (spent + cost, (*places, place))
            if k + 1 == len(row):
                row.append(made)
            elif made < row[k + 1]:
                row[k + 1] = made
        rows.append(row)
    return list(rows[-1][EDITS + 1][1])


def sides(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index entries and questions of the words (word, n): (side, part, length, word, n, last), `last` being where the prefix ends."""
    grams = words.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2))))).alias("gram"))
    counts = grams.groupBy(F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(CLASSES)).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    rows = words.sparkSession.sparkContext.broadcast({r["class"]: r["n"] for r in counts.collect()})  # `CLASSES` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class, ranks = rows.value, {}

        def rank(gram: str) -> tuple:
            if gram not in ranks:
                if len(ranks) > CLASSES:
                    ranks.clear()
                ranks[gram] = (by_class[gram_class(gram)], gram)
            return ranks[gram]

        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                chosen = prefix(word, rank)
                asked = pivots(chosen)
                last = f"{chosen[-1][0][0]:016x}{chosen[-1][0][1]}"
                for _, i in chosen:
                    pivot = i in asked
                    out.append((0, word[:i + 2], len(word), word, n, last, pivot))
                    out.append((1, word[i:], len(word), word, n, last, pivot))
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.bool_())
            names = ["side", "part", "length", "word", "n", "last", "pivot"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    found = cut_lineage(map_arrow(words.select("word", "n"), run, "side int, part string, length int, word string, n bigint, last string, pivot boolean"), "grams")
    entries = found.drop("pivot")
    lengths = F.array(*[F.col("length") + d for d in range(-EDITS, EDITS + 1)])
    asked = found.where("pivot").withColumn("length", F.explode(lengths)).drop("pivot")
    return entries, asked


def near(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all ordered pairs of words at edit distance one."""
    entries, asked = sides(words)
    asked = asked.select("side", "part", "length", F.col("word").alias("w"), F.col("n").alias("m"), F.col("last").alias("l"))
    met = entries.join(asked, ["side", "part", "length"]).where(
        (F.col("l") <= F.col("last")) & (F.col("w") != F.col("word")) & (F.levenshtein("w", "word", EDITS) == EDITS))
    pairs = met.select(F.least("w", "word").alias("a"), F.greatest("w", "word").alias("b"), F.when(F.col("w") < F.col("word"), F.col("m")).otherwise(F.col("n")).alias("an"),
                       F.when(F.col("w") < F.col("word"), F.col("n")).otherwise(F.col("m")).alias("bn")).distinct()
    def seen(word: str, n: str, other: str, other_n: str) -> Column:
        return F.struct(F.col(word).alias("word"), F.col(n).alias("n"), F.col(other).alias("other"), F.col(other_n).alias("other_n"))

    return pairs.select(F.inline(F.array(seen("a", "an", "b", "bn"), seen("b", "bn", "a", "an"))))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form (word, form), by doubling: after round k, `root` is up to 2^k forms away."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def grouped(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word (word, n) of at least `LEAST` code points."""
    words = cut_lineage(words, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    met = near(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = -F.col("best.minus") >= 2 * F.col("n")
    met = cut_lineage(met.select("word", "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n")), "near")
    full = words.join(met, "word", "left").join(roots(met.where("form IS NOT NULL")), "word", "left")
    return full.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame, doc: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """`grouped` for the words of documents with at least `OFTEN` occurrences."""
    return grouped(counted(docs, doc, text, plant).where(F.col("n") >= OFTEN))
