"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf message; it is parsed here field by field. From it the library's tokenizer
is rebuilt: the normaliser with its character map, the metaspace marker, unigram scores or the merges
that a BPE vocabulary implies, and byte fallback. Batches are encoded by the library on `THREADS` threads, or
as many as a task has cores if that is more.

Pieces never hold a blank marker after another character, nor a line feed (`Model.cuts` proves that from the
vocabulary). So a text may be cut before single blanks and around line feeds, equal chunks are encoded once, and
each new chunk is checked against the sentencepiece library. The ids are the rebuilt model's; `mismatches` counts where
sentencepiece has others. Texts with runs of blanks, or of a model that does not cut, are encoded and checked whole.

Defined results: a null or empty text has no ids; repeated rows are each answered; ids decode to the text
as the model normalises it (`round_trip`); texts are read whole; columns named as the answers are replaced by them.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetlens.llm.batches import annotate, boolean, long, map_arrow, strings
from fleetlens.llm.chunks import Cells

MARK = "▁"
# Kinds of pieces and of models in the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters joined for one text of a batch of chunks.
CALL = 8 << 10
#: Threads of the library in a worker, at least.
THREADS = 2


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire)
        if size is None:
            if wire != 2:
                raise ValueError(f"wire type {wire} is not in use")
            size = varint()
        yield number, raw[at:at + size]
        at += size


@dataclass(frozen=True)
class Model:
    """What a model file says: pieces (text, score, kind), model kind and normalisation."""

    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    remove_extra: bool
    escape: bool

    @cached_property
    def cuts(self) -> bool:
        """Whether texts may be cut before blanks and around line feeds."""
        plain = [p for p, _, kind in self.pieces if kind in (NORMAL, USER)]
        inner = any(MARK in p.lstrip(MARK) or "\n" in p for p in plain)
        return not inner and not self.charsmap and not self.remove_extra and self.dummy_prefix and self.escape and self.byte_fallback


def parse(path: str) -> Model:
    with open(path, "rb") as f:
        top = list(fields(f.read()))
    pieces = []
    for raw in (v for n, v in top if n == 1):
        p = dict(fields(raw))
        pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
    trainer = dict(fields(next((v for n, v in top if n == 2), b"")))
    normal = dict(fields(next((v for n, v in top if n == 3), b"")))
    return Model(
        tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normal.get(2, b""),
        bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)),
    )


def merges(model: Model) -> list[tuple[str, str]]:
    """Merges of a BPE vocabulary, best piece first; the splits of one piece from the left."""
    rank = {p: (-score, i) for i, (p, score, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    found = []
    for p in rank:
        found += [(rank[p], cut, p[:cut], p[cut:]) for cut in range(1, len(p)) if p[:cut] in rank and p[cut:] in rank]
    return [(a, b) for _, _, a, b in sorted(found)]


def rebuild(model: Model, prefix: bool = True):
    """The library's tokenizer for a model; without `prefix`, texts are taken as already marked."""
    from tokenizers import Regex, Tokenizer, decoders, normalizers, pre_tokenizers
    from tokenizers.models import BPE as Merging
    from tokenizers.models import Unigram

    unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
    if model.kind == UNIGRAM:
        core = Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        core = Merging(
            {p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model), unk_token=model.pieces[unknown][0],
            fuse_unk=True, byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError(f"model kind {model.kind} is neither unigram nor BPE")
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if prefix and model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if model.cuts:
        # Proven not to part what a piece could join; keeps the library's words, and its memory of them, short.
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"\\n|{MARK}*[^{MARK}\\n]+|{MARK}+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if prefix and model.dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return t


class Codec:
    """Encoder and decoder of a task."""

    def __init__(self, path: str, threads: int = 1):
        # Read by the library when its threads first start, in this worker.
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece

        self.model = parse(path)
        self.full, self.bare = rebuild(self.model), rebuild(self.model, prefix=False)
        self.truth = sentencepiece.SentencePieceProcessor(model_file=path)
        self.wrong: set[str] = set()
        self.unlike: set[str] = set()
        self.known = Cells(self._chunks, {"": b""})
        if self.model.cuts:
            self.feed = self.bare.encode("\n", add_special_tokens=False).ids
            self.known = Cells(self._chunks, {"": b"", "\n": np.array(self.feed, "<u4").tobytes()})

    def _chunks(self, words: list[str]) -> list[bytes]:
        """Ids of new chunks, each led by its marker if it has one, checked against sentencepiece."""
        texts, start, size = [], 0, 0
        for i, w in enumerate(words):
            size += len(w) + 1
            if size >= CALL or i == len(words) - 1:
                texts.append("\n".join(words[start:i + 1]))
                start, size = i + 1, 0
        out: list[bytes] = []
        for e in self.bare.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            raw, ends = ids.tobytes(), (np.flatnonzero(ids == self.feed[0]) * 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *(x + 4 for x in ends)], [*ends, len(raw)])]
        # sentencepiece puts its marker before a text: off with the chunk's own, or with the marker and a line feed.
        asked = [w[1:] if w[0] == MARK else "\n" + w for w in words]
        for i, (w, ids) in enumerate(zip(words, self.truth.encode(asked, num_threads=1))):
            right = struct.pack(f"<{len(ids)}I", *ids) if w[0] == MARK else struct.pack(f"<{len(ids) - 2}I", *ids[2:])
            if right != out[i]:
                self.wrong.add(w)
        self.unlike.update(w for w, back in zip(words, self._decode(self.bare, out)) if back != w.replace(MARK, " "))
        return out

    def cut(self, text: str) -> list[str] | None:
        if not self.model.cuts or not text or any(x in text for x in ("  ", " \n", "\n ", MARK, "\0")) or text[0] in " \n" or text[-1] == " ":
            return None
        return (MARK + text).replace(" ", "\0" + MARK).replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[tuple[bytes, int, bool]]:
        """For each text its ids as little-endian 32-bit integers, in how many places sentencepiece differs, and whether it decodes to itself.

        What a text decodes to is what its chunks decode to, one after another.
        """
        get = self.known.__getitem__
        parts = [self.cut(x) for x in texts]
        cells = [None if p is None else list(map(get, p)) for p in parts]
        self.known.fill()
        whole = [x for x, p in zip(texts, parts) if p is None]
        mine = [np.array(e.ids, "<u4").tobytes() for e in self.full.encode_batch_fast(whole, add_special_tokens=False)]
        right = [struct.pack(f"<{len(ids)}I", *ids) for ids in self.truth.encode(whole, num_threads=1)]
        encoded = iter(zip(whole, mine, right, self.decode(mine)))
        out = []
        for c, p in zip(cells, parts):
            if c is None:
                text, ids, theirs, back = next(encoded)
                out.append((ids, int(ids != theirs), text == back))
            else:
                out.append((b"".join(c), sum(w in self.wrong for w in p) if self.wrong else 0, not self.unlike or self.unlike.isdisjoint(p)))
        return out

    @staticmethod
    def _decode(tokenizer, ids: list[bytes]) -> list[str]:
        return tokenizer.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids], skip_special_tokens=False)

    def decode(self, ids: list[bytes]) -> list[str]:
        return self._decode(self.full, ids)


@lru_cache(maxsize=1)
def codec_of(path: str, threads: int) -> Codec:
    """A Python worker keeps its codec from one task to the next."""
    return Codec(path, threads)


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """`docs` with `n_tokens`, `ids_crc32`, `round_trip`, `mismatches` and, if asked, the `ids`, in one narrow pass."""
    threads = max(THREADS, int(docs.sparkSession.conf.get("spark.task.cpus", "1")))
    added = [long("n_tokens"), long("ids_crc32"), boolean("round_trip"), long("mismatches")]
    added += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []

    def make():
        codec = codec_of(path, threads)

        def work(piece):
            made = codec.encode(strings(piece.column(text)))
            ids = [x for x, _, _ in made]
            out = [[len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], [same for _, _, same in made], [n for _, n, _ in made]]
            return out + ([[np.frombuffer(x, "<i4") for x in ids]] if with_ids else [])

        return work

    return annotate(docs, text, added, make, keep)


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`tokens` with `text` decoded from a list of ids, in one narrow pass; a null list gives a null text."""
    threads = max(THREADS, int(tokens.sparkSession.conf.get("spark.task.cpus", "1")))
    kept = [c for c in tokens.columns if c != "text"]
    schema = T.StructType([tokens.schema[c] for c in kept] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, threads)
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            texts = codec.decode([np.array(x or [], "<u4").tobytes() for x in lists])
            texts = [None if x is None else t for x, t in zip(lists, texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=schema.names)

    return map_arrow(tokens.select(*kept), run, schema)
