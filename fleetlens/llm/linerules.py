"""Quality rules, line first: judge every line, drop the failing ones, reject documents that lose too much.

Only DataFrame functions, one narrow pass, no shuffle. A line fails if it
* lacks an end mark (`END_MARKS`),
* holds filler text (`FILLER`), or is short (`SHORT_LINE` words at most) and holds a phrase of navigation or boilerplate
  (`BOILERPLATE`), both as whole words; longer lines that only mention such a phrase are prose,
* is made of symbols: over one of `[#*$%&|<>]` in ten words,
* shouts: over one `!!` in three words.
Blank lines neither fail nor count. A document is kept if it passes the base rules (20 words, and not
over 30 % of its words in 8-word windows that occur twice) and the kept lines hold at least
`KEPT_SHARE` of the code points of its lines.

Defined results: a null text has no words, fails and is cleaned to the empty text; rows are judged one
by one, so repeated rows, ids and ties do not matter; windows are compared by a 64-bit hash within one
text; columns of the input with the name of a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.common import bind
from fleetlens.llm.batches import aside, named_back

WIDTH = 8
KEPT_SHARE = 0.5
# Fixed values.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
END_MARKS = [".", "!", "?", "…", "\"", "”", "»", ":", ")"]
WHOLE = r"(?i)(?<![\p{L}\p{N}_])(?:%s)(?![\p{L}\p{N}_])"
FILLER = WHOLE % "lorem ipsum"
BOILERPLATE = WHOLE % (
    "javascript|cookie policy|cookie settings|terms of use|terms of service|privacy policy|all rights reserved|"
    "skip to content|sign in|log in|subscribe to our|share this|read more|click here|back to top"
)
SHORT_LINE = 15
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def repeated_words(found: Column, width: int = WIDTH) -> Column:
    """Words inside windows of `width` words that occur at least twice; `found` is the array of words."""

    def covered(windows: Column) -> Column:
        by_value = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(twin(x, j), F.lit(False))), lambda x: x["i"]))

        start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(
            bind(by_value, places), start,
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(covered(windows))

    n = F.size(found) - width + 1
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(found, i, width)))
    return F.when(n < 2, F.lit(0).cast("bigint")).otherwise(bind(hashes, count))


def good_line(line: Column) -> Column:
    """Whether a line that has a word passes every rule."""
    n = F.regexp_count(line, F.lit(WORD))
    return (
        F.right(F.rtrim(line, F.lit(BLANKS)), F.lit(1)).isin(END_MARKS)
        & ~line.rlike(FILLER)
        & ~((n <= SHORT_LINE) & line.rlike(BOILERPLATE))
        & (F.regexp_count(line, F.lit(SYMBOLS)) * 10 <= n)
        & (F.regexp_count(line, F.lit("!!")) * 3 <= n)
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_chars", "kept_chars", "cleaned", "kept"]


def judge(docs: DataFrame, text: str = "text", kept_share: float = KEPT_SHARE) -> DataFrame:
    """`docs` with the measures, the cleaned text (also of rejected documents) and the verdict `kept`."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(
        *(c for c in docs.columns if c not in MEASURES), words(whole).alias("_words"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
    )
    measures = F.struct(
        "n_symbols", F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.length(F.array_join("_lines", "")).cast("bigint").alias("line_chars"),
        F.array_join(F.filter("_lines", good_line), "\n").alias("cleaned"),
    )
    # Through a generator, so that no filter on a measure is pushed below it and computes it again.
    measured = found.select(*(c for c in found.columns if c not in ("_words", "_lines", "n_symbols")), F.inline(F.array(measures)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept_chars = F.length(F.replace("cleaned", F.lit("\n"), F.lit(""))).cast("bigint")
    judged = measured.withColumn("base_failed", failed).withColumn("kept_chars", kept_chars)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= kept_share * F.col("line_chars")))


def clean(docs: DataFrame, text: str = "text", kept_share: float = KEPT_SHARE) -> DataFrame:
    """The kept documents with their cleaned text, in the columns they came with."""
    moved, names = aside(docs, [*MEASURES, "_words", "_lines"])
    kept = judge(moved, names[text], kept_share).where("kept")
    return named_back(kept.withColumn(names[text], F.col("cleaned")), names)
