"""Texts cut into chunks that a byte-level BPE tokenizer encodes independently, and a memory of chunks.

The library cuts a text into pre-tokens, each encoded alone. These places are always borders between
pre-tokens of the byte-level pattern, and matching starts afresh at each, so a chunk between two of
them gives the same ids alone as inside its text:
* before a single blank or line feed that follows anything else: no branch takes white space after
  another character;
* after a single line feed before anything but white space: the only branch that takes it stops there;
* before `.` or `,` after a letter or digit: letters, digits and other characters have branches of
  their own.
Texts with runs of white space, or with characters outside `PLAIN`, are not cut at all, so nothing
depends on two regular expression engines agreeing about rare characters.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
from collections.abc import Callable

import numpy as np

#: Chunks in each of the two generations that a Python worker remembers.
REMEMBERED = 450_000
#: Characters joined for one call of the library.
CALL = 16 << 10

PLAIN = re.compile("[\x21-\x7e\xa1-ɏ€‐-‧ \n]*").fullmatch
RUNS = ("  ", " \n", "\n ", "\n\n")
LETTERED = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-ɏ \n]*").fullmatch
ODD_STOP = re.compile("(?<![A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-ɏ])[.,]").search
#: UTF-8 bytes of letters and digits become "a", stops ".", the rest a blank; only for texts whose other characters are ASCII.
KINDS = bytes(97 if c >= 128 or chr(c).isalnum() else 46 if c in b".," else 32 for c in range(256))

#: Chunks of letters, with or without a blank before them: one pre-token each.
ALONE = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]+").fullmatch
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = sorted(set(range(256)) - _SHOWN)
#: What a byte-level vocabulary writes for each byte.
SIGNS = "".join(chr(b) if b in _SHOWN else chr(256 + _HIDDEN.index(b)) for b in range(256))


def odd_stop(text: str) -> bool:
    """Whether a stop stands behind anything but a letter or digit."""
    if not LETTERED(text):
        return ODD_STOP(text) is not None
    kinds = text.encode().translate(KINDS)
    return b" ." in kinds or b".." in kinds or kinds[:1] == b"."


def marked_cuts(text: str) -> str | None:
    """The text with "\\0" at every cut, or None if it must stay whole. A text that is cut holds no control character but line feeds."""
    if any(r in text for r in RUNS) or text[-1:] in (" ", "\n") or not PLAIN(text):
        return None
    marked = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
    if not odd_stop(text):
        marked = marked.replace(".", "\0.").replace(",", "\0,")
    return marked


def cut(text: str) -> list[str] | None:
    """Chunks whose concatenation is the text, or None if it must stay whole."""
    marked = marked_cuts(text)
    return None if marked is None else marked.split("\0")


def library(path: str):
    """The tokenizer, single-threaded: an executor's cores each run a task of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def specials(tokenizer) -> tuple[str, ...]:
    return tuple(a.content for a in tokenizer.get_added_tokens_decoder().values())


def encode_chunks(tokenizer, words: list[str]) -> list[bytes]:
    """Ids of each chunk (none of them empty or a line feed) as little-endian 32-bit integers.

    A chunk of letters is one pre-token, so the model merges it without the cutting before it; the others go through the whole tokenizer.
    """
    rule = tokenizer.pre_tokenizer
    if tokenizer.normalizer is not None or type(rule).__name__ != "ByteLevel" or rule.add_prefix_space or not rule.use_regex:
        return _joined(tokenizer, words)
    alone = [w for w in words if ALONE(w)]
    written = codecs.charmap_decode("\n".join(alone).encode(), "strict", SIGNS)[0].split(SIGNS[10])
    merge, known = tokenizer.model.tokenize, {}
    for w, signs in zip(alone, written):
        ids = [x.id for x in merge(signs)]
        known[w] = struct.pack(f"<{len(ids)}I", *ids)
    others = [w for w in words if w not in known]
    known.update(zip(others, _joined(tokenizer, others)))
    return list(map(known.__getitem__, words))


def _joined(tokenizer, words: list[str]) -> list[bytes]:
    """Ids of each chunk by the whole tokenizer; chunks are joined by line feeds, each an id of its own."""
    feed = tokenizer.encode("\n", add_special_tokens=False).ids
    assert len(feed) == 1
    out: list[bytes] = []
    start, size = 0, 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= CALL or i == len(words) - 1:
            ids = np.array(tokenizer.encode_batch_fast(["\n".join(words[start:i + 1])], add_special_tokens=False)[0].ids, "<u4")
            raw = ids.tobytes()
            ends = (np.flatnonzero(ids == feed[0]) * 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *(x + 4 for x in ends)], [*ends, len(raw)])]
            start, size = i + 1, 0
    assert len(out) == len(words)
    return out


class Cells(dict):
    """Ids of chunks, in two generations of bounded size. A lookup of an unknown chunk gives a cell that `fill` fills."""

    def __init__(self, value: Callable[[list[str]], list[bytes]], fixed: dict[str, bytes]):
        super().__init__(fixed)
        self.value, self.fixed, self.old, self.missing = value, fixed, {}, {}

    def __missing__(self, word: str) -> bytearray:
        cell = self.old.get(word)
        if cell is None:
            cell = self.missing[word] = bytearray()
        self[word] = cell
        return cell

    def fill(self) -> None:
        for cell, ids in zip(self.missing.values(), self.value(list(self.missing))):
            cell += ids
        self.missing = {}
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)


class Memory:
    """What is known of chunks: `fixed` for good, the rest in two generations of bounded size."""

    def __init__(self, value: Callable[[list[str]], list], fixed: dict | None = None):
        self.value, self.fixed = value, fixed or {}
        self.young, self.old = dict(self.fixed), {}

    def learn(self, words: list[str]) -> Callable[[str], object]:
        """A lookup that knows all of `words`."""
        new = set(words).difference(self.young)
        if new:
            if len(self.young) > REMEMBERED + len(self.fixed):
                self.old, self.young = self.young, dict(self.fixed)
                new = set(words).difference(self.young)
            missing = []
            for w in new:
                known = self.old.get(w)
                if known is None:
                    missing.append(w)
                else:
                    self.young[w] = known
            self.young.update(zip(missing, self.value(missing)))
        return self.young.__getitem__

    def values(self, words: list[str], given: dict) -> list:
        """What is known of each of `words`, all different; `given` are values of this call alone."""
        found = [given.get(w, x) for w, x in zip(words, map(self.young.get, words))] if given else list(map(self.young.get, words))
        new = [w for w, x in zip(words, found) if x is None]
        get = self.learn(new)
        return [get(w) if x is None else x for w, x in zip(words, found)]


def spread(texts: list[str], marked: tuple[str, ...], memory: Memory, whole: Callable[[list[str]], list]) -> list[list]:
    """For each text the remembered values of its chunks, or the one value of a text that stays whole."""
    parts = [None if any(s in x for s in marked) else cut(x) for x in texts]
    uncut = iter(whole([x for x, p in zip(texts, parts) if p is None]))
    get = memory.learn([w for p in parts if p is not None for w in p])
    return [[next(uncut)] if p is None else list(map(get, p)) for p in parts]
