"""Token counts by the whole-token shortcut, for byte-level BPE vocabularies of the tokenizers library.

Offline, every vocabulary string is encoded once; those that come out as one token are the whole
tokens. Texts are cut into chunks that are encoded independently (`chunks`); a chunk that is a whole
token counts 1 without any merging, and only the remaining distinct chunks go through the library. A text that `chunks`
does not cut, for its runs of white space or its script, is cut into pre-tokens by the library itself, and the same holds for
those. Only texts with special strings, and vocabularies with a normaliser, go through the library whole.

Defined results: null and empty texts have no bytes and no tokens; rows are answered one by one, so repeated rows and ids do
not matter; texts are read whole; columns named as the answers are replaced by them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame

from fleetlens.llm.batches import annotate, boolean, long, strings, text_lengths
from fleetlens.llm.chunks import Memory, encode_chunks, library, specials, spread

LIMIT = 512


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that the library encodes to exactly one token."""
    t = library(path)
    texts = [x for x in (t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size())) if x and "�" not in x]
    encoded = t.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(x for x, e in zip(texts, encoded) if len(e.ids) == 1)


@lru_cache(maxsize=1)
def counter(path: str, shortcut: frozenset[str]) -> Callable[[list[str]], list[int]]:
    """Function from texts to their token counts; a Python worker keeps it from one task to the next."""
    t = library(path)

    def whole(texts: list[str]) -> list[int]:
        return [len(t.encode_batch_fast([x], add_special_tokens=False)[0].ids) for x in texts]

    marked = specials(t)
    memory = Memory(lambda words: [len(x) // 4 for x in encode_chunks(t, words)], {w: 1 for w in shortcut} | {"": 0})
    # Pre-tokens are written in the vocabulary's own letters; a vocabulary string that no merge parts is one token.
    model, split = t.model, t.pre_tokenizer
    ones = {w: 1 for w in t.get_vocab(with_added_tokens=False) if len(model.tokenize(w)) == 1}
    parts = Memory(lambda words: [len(model.tokenize(w)) for w in words], ones)

    def in_parts(texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            if t.normalizer is not None or split is None or any(m in text for m in marked):
                out += whole([text])
                continue
            words = [w for w, _ in split.pre_tokenize_str(text)]
            out.append(sum(map(parts.learn(words), words)))
        return out

    return lambda texts: list(map(sum, spread(texts, marked, memory, in_parts)))


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with `n_bytes`, `n_tokens` and `over_limit`, in one narrow pass.

    Null and empty texts have no bytes and no tokens. Whole texts are counted, however long; rows are
    answered one by one, so repeated rows and ids do not matter. The vocabulary bounds what is shipped.
    """
    shortcut = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def make():
        counts = counter(path, shortcut.value)

        def work(piece):
            found = counts(strings(piece.column(text)))
            return [text_lengths(piece.column(text)).tolist(), found, [n > limit for n in found]]

        return work

    return annotate(docs, text, [long("n_bytes"), long("n_tokens"), boolean("over_limit")], make, keep)
