"""Language identification by compression.

For each language some raw text serves as zstandard dictionaries. A text is cut into even blocks of at most
`BLOCK` bytes, each block is compressed on its own with every dictionary of every language, and the language
with the smallest sum over the whole text wins. No block has earlier ones as history, so the last
block counts like the first and the gap between languages grows with the text. Where the runner-up is
nearly as small the answer is marked as rejected.

The dictionaries are fitted on a bounded, documented sample: about `ROWS` labelled rows a language,
chosen by a hash of id and text, and `PIECE` characters from the middle of each. Everything else runs
on whole texts, in one narrow pass. Texts are lower-cased and their runs of other characters than
letters become blanks before they are compressed; a text that leaves nothing is `und`.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected; rows with
a null label teach nothing; if no row teaches, every answer is `und`; ties go to the first language by
name; repeated rows are each answered; texts are read whole. Columns that bear the name of an answer are replaced by it in
`identify`; `keep_identified` gives all back as they came.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.batches import annotate, boolean, double, strings, string

ROWS = 600
PIECE = 400
DICTIONARY_BYTES = 64 << 10
#: Dictionaries a language.
SHARDS = 2
#: Bytes of normalised text that are compressed at a time.
BLOCK = 8 << 10
#: Put before each block: it compresses well, so that the block is not stored as it is and each match shows.
PAD = bytes(64) + b" "
#: Rejected if the runner-up is not larger by this part of the smallest size.
MARGIN = 0.002
UNKNOWN = "und"

#: Greedy matching from 4 bytes on: faster strategies miss the short matches that tell languages apart.
PARAMETERS = dict(
    window_log=18, hash_log=15, chain_log=15, search_log=3, min_match=4, target_length=0,
    strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0,
)
#: What counts as a word character but is no letter: digits and numbers of every script.
NUMBERS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha())
OTHERS = re.compile(rf"[{NUMBERS} ]+")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """What is compressed: lower case letters, and one blank for each run of anything else."""
    found = NOT_LETTERS.sub(" ", text.lower())
    if not found.isascii() and not found.replace(" ", "").isalpha():
        found = OTHERS.sub(" ", found)
    return found.strip(" ").encode()


def blocks(raw: bytes, size: int = BLOCK) -> list[bytes]:
    """All of a normalised text in even blocks of at most `size` bytes."""
    n = -(-len(raw) // size)
    return [raw[i * len(raw) // n:(i + 1) * len(raw) // n] for i in range(n)]


def sample(docs: DataFrame, label: str, doc: str, text: str, rows: int = ROWS) -> DataFrame:
    """About `rows` labelled rows of each language, by hash; columns `lang`, `piece`."""
    labelled = docs.where(F.col(label).isNotNull() & (F.length(text) > 0))
    share = labelled.groupBy(F.col(label).alias("lang")).agg((F.lit(float(rows)) / F.count(F.lit(1))).alias("share"))
    unit = F.pmod(F.xxhash64(F.col(doc), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    start = F.greatest(F.lit(1), (F.length(text) - PIECE) / 2).cast("int")
    drawn = labelled.select(F.col(label).alias("lang"), unit.alias("unit"), F.substring(F.col(text), start, F.lit(PIECE)).alias("piece"))
    return drawn.join(F.broadcast(share), "lang").where(F.col("unit") < F.col("share"))  # one row a language


def fit(docs: DataFrame, label: str = "lang", doc: str = "doc_id", text: str = "text", rows: int = ROWS) -> dict[str, list[bytes]]:
    """Raw dictionary contents for each language."""
    pieces: dict[str, list[tuple[float, str]]] = {}
    for r in sample(docs, label, doc, text, rows).collect():
        pieces.setdefault(r.lang, []).append((r.unit, r.piece))
    model = {}
    for lang, drawn in pieces.items():
        texts = [x for x in (letters(p) for _, p in sorted(drawn)) if x]
        shards = [b" ".join(texts[i::SHARDS])[:DICTIONARY_BYTES] for i in range(SHARDS)] if texts else []
        if shards:
            model[lang] = [x or shards[0] for x in shards]
    return model


def classifier(model: dict[str, list[bytes]], margin: float = MARGIN) -> Callable[[str], tuple[str, float, bool]]:
    """Function from a text to (language, score, rejected)."""
    parameters = zstandard.ZstdCompressionParameters(**PARAMETERS)

    def compressor(raw: bytes) -> zstandard.ZstdCompressor:
        content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=content, compression_params=parameters)

    languages = {lang: [compressor(x) for x in model[lang]] for lang in sorted(model)}

    def classify(text: str) -> tuple[str, float, bool]:
        raw = letters(text)
        if not raw or not languages:
            return UNKNOWN, 0.0, True
        parts = [PAD + b + b" " for b in blocks(raw)]
        sizes = {lang: sum(len(z.compress(b)) for z in zs for b in parts) / len(zs) for lang, zs in languages.items()}
        best = min(sizes, key=sizes.get)
        rest = [s for lang, s in sizes.items() if lang != best]
        # Sizes are code lengths: with equal priors a language's weight is 2 to minus its bits.
        score = 1 / (1 + sum(math.exp(max(-700.0, 8 * math.log(2) * (sizes[best] - s))) for s in rest))
        return best, score, bool(rest) and min(rest) - sizes[best] <= margin * sizes[best]

    return classify


def identify(docs: DataFrame, model: dict[str, list[bytes]], text: str = "text", margin: float = MARGIN, keep: list[str] | None = None) -> DataFrame:
    """`docs` with `lang_pred`, `score` and `rejected`, in one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        classify = classifier(shared.value, margin)
        return lambda piece: [list(x) for x in zip(*map(classify, strings(piece.column(text))))]

    return annotate(docs, text, [string("lang_pred"), double("score"), boolean("rejected")], make, keep)


def keep_identified(docs: DataFrame, model: dict[str, list[bytes]], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Documents whose language is not rejected, with the columns they came with."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        classify = classifier(shared.value, margin)
        return lambda piece: ([not classify(x)[2] for x in strings(piece.column(text))], [])

    return annotate(docs, text, [], make)


def fold(doc: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null ids count as remainder 0."""
    return F.coalesce(F.crc32(doc.cast("string")) % folds, F.lit(0))
