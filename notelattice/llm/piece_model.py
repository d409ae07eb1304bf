"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here, by its wire format; from it a tokenizers pipeline is rebuilt:
normaliser (character map, dummy prefix, white space as the metaspace mark), the model (unigram
scores, or the merges that BPE scores imply), byte fallback and decoder. Batches are encoded by the
library's threads. Parity is verified against the sentencepiece library.

A text is cut into units that no piece of the vocabulary reaches out of, which is read off the
vocabulary; the library encodes each distinct unit once while a worker holds it. The sentencepiece
library gets every distinct whole text of a batch; only one of more than BLOCK characters goes in
parts, cut at spaces. Models without such places have whole texts encoded by both libraries.

Defined results: a null or empty text has no ids and decodes to the empty text; equal rows get equal
ids; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_type, map_arrow, span_hashes, text_blocks

MARK = "▁"
#: Piece types of the protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters taken at once, and from which a text goes in parts; bounds a worker's memory.
BLOCK = 600_000
#: Characters of the texts that are encoded at once; a longer text is alone.
ROWS = 150_000
THREADS = 2
#: Units that a worker holds the ids of; when full it forgets them all.
KNOWN = 1_000_000
#: A space after something else.
SPACE = re.compile(f"[^ {MARK}] ")


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + n]
            at += n


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> PieceModel:
        model = cls()
        for number, value in fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                model.pieces.append((piece, score, kind))
            elif number == 2:
                spec = dict(fields(value))
                model.kind = spec.get(3, UNIGRAM)
                model.byte_fallback = bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        return model

    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def cuttable(self) -> bool:
        """No piece holds a mark after something else."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))

    def classes(self) -> np.ndarray:
        """The class of each code point (see Units): letters and other characters apart if no piece
        has one beside the other."""
        out = np.fromiter((1 + chr(c).isalpha() for c in range(0x30000)), np.int8, 0x30000)
        out[[ord(" "), ord(MARK)]] = 0
        pieces = [out[np.minimum([ord(c) for c in p], len(out) - 1)] for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED)]
        if any(((k[1:] != k[:-1]) & (k[:-1] > 0)).any() for k in pieces):
            out[out > 1] = 1
        return out

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best score first."""
        live = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        out = []
        for p, i in live.items():
            pairs = [(live[p[:k]], live[p[k:]], k) for k in range(1, len(p)) if p[:k] in live and p[k:] in live]
            out += [(-self.pieces[i][1], i, a, b, p[:k], p[k:]) for a, b, k in pairs]
        return [(x[4], x[5]) for x in sorted(out)]

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

        names = [p for p, _, _ in self.pieces]
        unk = self.unknown()
        if self.kind == UNIGRAM:
            tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], unk, self.byte_fallback))
        else:
            tok = Tokenizer(models.BPE({p: i for i, p in enumerate(names)}, self.merges(), unk_token=names[unk], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=60_000))
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        tok.normalizer = normalizers.Sequence(steps)
        if self.cuttable():
            tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        tok.decoder = self.decoder()
        return tok

    def decoder(self):
        from tokenizers import decoders

        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        return decoders.Sequence(steps + [decoders.Strip(" ", 1, 0)] * self.dummy_prefix)


class Units:
    """Ids of the units of texts: stretches that no piece of the vocabulary reaches out of, so that
    each distinct one is encoded once, by the library's threads, while it is held.

    Characters are of classes: 0 the mark and the space, and one or two more. A unit ends where a
    character other than the mark is followed by one of another class. Units are known by a 64-bit
    hash; two with one hash would show as a text without parity.
    """

    def __init__(self, model: PieceModel, classes: np.ndarray):
        self.classes, self.tokenizer = classes, model.tokenizer()
        self.tokenizer.normalizer = None
        self.tokenizer.pre_tokenizer = None
        self.forget()

    def forget(self) -> None:
        self.hashes, self.codes = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.first = np.empty(0, np.int32), np.zeros(1, np.int64)

    def learn(self, hashes: np.ndarray, units: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        at = np.searchsorted(self.hashes, hashes)
        self.codes = np.insert(self.codes, at, np.arange(len(ids)) + len(self.first) - 1)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their bounds); the texts are not empty, and a space goes before each."""
        joined = " " + " ".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[np.minimum(cp, len(self.classes) - 1)]
        cut = np.ones(len(cp) + 1, bool)
        np.logical_and(kind[1:] != kind[:-1], kind[:-1] > 0, out=cut[1:-1])
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cut[bounds] = True
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        h = span_hashes(np.where(kind > 0, cp, 32), start, end)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        new = self.hashes[at] != h if len(self.hashes) else np.ones(len(h), bool)
        fresh, where, back = np.unique(h[new], return_index=True, return_inverse=True)
        if len(self.hashes) + len(fresh) > KNOWN:
            self.forget()
            new[:] = True
            fresh, where, back = np.unique(h, return_index=True, return_inverse=True)
        code = np.empty(len(h), np.int64)
        code[~new] = self.codes[at[~new]]
        code[new] = back + len(self.first) - 1
        if len(fresh):
            marked = joined.replace(" ", MARK)
            spans = zip(start[new][where].tolist(), end[new][where].tolist(), strict=True)
            self.learn(fresh, [marked[x:y] for x, y in spans])
        size = self.first[code + 1] - self.first[code]
        ahead = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.first[code] - ahead[:-1], size) + np.arange(ahead[-1])]
        return ids, ahead[np.searchsorted(edge, bounds)]


class Codec:
    """Encodes and decodes batches of whole texts, each distinct one of a batch once; with `verify`
    the sentencepiece library encodes the same whole texts too."""

    def __init__(self, path: str):
        import sentencepiece

        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        with open(path, "rb") as f:
            self.model = PieceModel.parse(f.read())
        m = self.model
        self.tokenizer = m.tokenizer()
        self.peer = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = m.cuttable() and m.dummy_prefix and m.escape and m.byte_fallback and not m.squeeze and not m.charsmap
        classes = m.classes() if plain else None
        self.units = Units(m, classes) if classes is not None else None
        spelled = [bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in m.pieces]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.cumsum([0, *map(len, spelled)])

    def parts(self, text: str, chars: int) -> list[str]:
        """The text, or pieces of it that are encoded alone without changing an id: no piece spans a
        space after something else, and the dummy prefix stands in for the space that is cut out."""
        out, at = [], 0
        while self.units and len(text) - at > chars:
            found = SPACE.search(text, at + chars)
            if found is None or found.end() == len(text):
                break
            out.append(text[at : found.end() - 1])
            at = found.end()
        return [*out, text[at:]]

    def peer_ids(self, texts: list[str], chars: int = BLOCK) -> list[list[int]]:
        """What the sentencepiece library gives."""
        split = [self.parts(t, chars) for t in texts]
        got = iter(self.peer.encode([p for s in split for p in s], num_threads=1))
        return [next(got) if len(s) == 1 else [i for _ in s for i in next(got)] for s in split]

    def batch(self, texts: list[str], verify: bool = True, chars: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(ids of all texts, their bounds, parity of each text, the texts that the ids decode to)."""
        full = [t for t in dict.fromkeys(texts) if t]
        if self.units and full:
            flat, bounds = self.units.encode(full)
        else:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(full, add_special_tokens=False)]
            flat, bounds = np.fromiter(chain.from_iterable(ids), np.int32), np.cumsum([0, *map(len, ids)])
        back = self.spell(flat, bounds) if self.units else self.decode([flat[a:b].tolist() for a, b in pairwise(bounds)])
        held = {t: (flat[a:b], d) for t, a, b, d in zip(full, bounds[:-1], bounds[1:], back, strict=True)}
        held[""] = (np.empty(0, np.int32), "")
        agree = {"": True} | dict.fromkeys(full, True)
        if verify:
            agree |= {t: array("i", x).tobytes() == held[t][0].tobytes() for t, x in zip(full, self.peer_ids(full, chars), strict=True)}
        if len(full) < len(texts):
            bounds = np.cumsum([0, *(len(held[t][0]) for t in texts)])
            flat = np.concatenate([held[""][0], *(held[t][0] for t in texts)])
        return flat, bounds, np.array([agree[t] for t in texts], bool), [held[t][1] for t in texts]

    def spell(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """What ids of whole texts decode to: the bytes of their pieces, without the dummy prefix."""
        size = self.spelled_at[ids + 1] - self.spelled_at[ids]
        ahead = np.concatenate(([0], np.cumsum(size)))
        raw = self.spelled[np.repeat(self.spelled_at[ids] - ahead[:-1], size) + np.arange(ahead[-1])].tobytes()
        return [raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in pairwise(ahead[bounds].tolist())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, bounds, _, _ = self.batch(texts, verify=False)
        return [ids[a:b].tolist() for a, b in pairwise(bounds)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    return _CODECS.get(path) or _CODECS.setdefault(path, Codec(path))


def encode_texts(docs: DataFrame, path: str, verify: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids, round_trip (the ids decode to the text) and, with `verify`,
    parity (the sentencepiece library gives the whole text the same ids)."""
    kinds = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("round_trip", T.BooleanType())]
    kinds += [("parity", T.BooleanType())] * verify
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in kinds)])
    id_type = arrow_type(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = codec(path)
        for ids, texts in text_blocks(batches, ROWS):
            flat, bounds, same, back = mine.batch(texts, verify)
            columns = [
                pa.array(ids, id_type), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(np.diff(bounds), pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)), pa.array([a == b for a, b in zip(back, texts, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(same)] * verify, schema.names)

    return map_arrow(docs.select("doc_id", "text"), run, schema)
