"""Byte-level BPE: a sentencepiece model made straight from a rank file, and its inverse.

Each byte becomes one character, chr(256 + byte), so that any byte string is a piece without
spaces or control characters. A piece's score is its negative rank: sentencepiece then merges
the pair of least rank first, leftmost on ties, as rank-file tokenizers do.
"""

from __future__ import annotations

import base64
import contextlib
import struct
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, slices

#: Pre-tokens whose ids a worker remembers; then it starts afresh. Longer ones aren't remembered.
REMEMBERED, LONGEST_REMEMBERED = 250_000, 48
_FIRST = 256
_MAP = {b: chr(_FIRST + b) for b in range(256)}


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks have to be 0, 1, 2, ... without gaps."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_MAP)


def mapped_all(texts: list[str]) -> list[str]:
    """mapped() of each text's UTF-8 bytes; byte 255, which UTF-8 never has, stands between them on the way."""
    return mapped("\udcff".join(texts).encode("utf-8", "surrogateescape")).split(_MAP[255])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protocol-buffer field: a varint or a length-delimited one."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose piece i is token i, with <unk> after the last.

    Field numbers are those of the public sentencepiece_model.proto: pieces 1 (piece 1,
    score 2, type 3), trainer_spec 2 (model_type 3, ids 40 to 43), normalizer_spec 3.
    """

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))

    normal, unknown, bpe, none = 1, 2, 2, (1 << 64) - 1
    pieces = b"".join(piece(mapped(t), -float(i), normal) for i, t in enumerate(tokens)) + piece("<unk>", 0.0, unknown)
    trainer = _field(3, bpe) + _field(40, len(tokens)) + b"".join(_field(n, none) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encodes and decodes texts; travels to executors as the tokens and the pattern alone."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self._pieces = self._bytes = None

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "_pieces": None, "_bytes": None}

    def _model(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))

    def _prepare(self) -> None:
        self._split = regex.compile(self.pattern).findall
        self._pieces = self._model()
        self._whole = {}  # tokens that are texts, as pre-tokens all are
        for i, t in enumerate(self.tokens):
            with contextlib.suppress(UnicodeDecodeError):
                self._whole[t.decode()] = i
        self._ids: dict[str, bytes] = {}  # of pre-tokens
        self._words: dict[str, bytes] = {}  # of what stands between two spaces, with the first of them

    def _learn(self, pretokens: set[str]) -> dict[str, bytes]:
        """The ids of pre-tokens, as bytes of 32-bit integers."""
        found, rest, whole = {}, [], self._whole.get
        for p in pretokens:
            i = whole(p)  # a pre-token that is a token stays whole
            if i is None:
                rest.append(p)
            else:
                found[p] = i.to_bytes(4, sys.byteorder)
        if rest:
            for p, ids in zip(rest, self._pieces.encode(mapped_all(rest), num_threads=1), strict=True):
                found[p] = array("i", ids).tobytes()
        return found

    def _of_pretokens(self, words: list[str], heads: list[list[str]]) -> tuple[list[bytes], list[bytes]]:
        """(the ids of each word after a space, of each list of pre-tokens)."""
        ids, split = self._ids, self._split
        # a space parts the words, and each of them begins with the only space that it has
        pre = split(" " + " ".join(words)) if words else []
        if sum(p[0] == " " for p in pre) != len(words):
            heads = [*heads, *(split(" " + w) for w in words)]
            pre, words = [], []
        needed = set(pre).union(*heads)
        new = needed.difference(ids)
        if len(ids) + len(new) > REMEMBERED:
            ids.clear()
            new = needed
        ids.update(self._learn(new))
        learnt: list[bytes] = []
        for p in pre:
            if p[0] == " ":
                learnt.append(ids[p])
            else:
                learnt[-1] += ids[p]
        out = [b"".join(map(ids.__getitem__, h)) for h in heads]
        for p in new:
            if len(p) > LONGEST_REMEMBERED:
                del ids[p]
        return learnt, out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text; special tokens are never made, null counts as empty.

        Texts are cut at spaces between two characters that aren't white space. The pattern
        has to begin a match at each of these, as those of byte-level tokenizers do; then
        the matches of the parts are those of the text, and the ids of a part can be kept.
        """
        if self._pieces is None:
            self._prepare()
        words = self._words
        cut = [t.split(" ") if t else [] for t in texts]
        later = set().union(*(c[1:] for c in cut))
        new = later.difference(words)
        if len(words) + len(new) > REMEMBERED:
            words.clear()
            new = later
        plain = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
        odd = new.difference(plain) if len(plain) < len(new) else ()
        heads, whole = [], []
        for t, c in zip(texts, cut, strict=True):
            is_whole = bool(odd) and not odd.isdisjoint(c[1:]) or bool(c) and c[0] != c[0].strip()
            whole.append(is_whole)
            heads.append(self._split(t) if is_whole else self._split(c[0]) if c else [])
        learnt, found = self._of_pretokens(plain, heads)
        words.update(zip(plain, learnt or found[len(heads) :], strict=True))
        out = []
        for c, head, is_whole in zip(cut, found, whole, strict=False):
            out.append(np.frombuffer(head if is_whole else head + b"".join(map(words.__getitem__, c[1:])), np.int32))
        for w in plain:
            if len(w) > LONGEST_REMEMBERED:
                del words[w]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        if self._bytes is None:
            # the inverse mapping, from the pieces of the model itself
            model = self._model()
            self._bytes = [bytes(ord(c) - _FIRST for c in model.id_to_piece(i)) for i in range(len(self.tokens))]
        return b"".join(map(self._bytes.__getitem__, ids))


_IDS = pa.list_(pa.field("element", pa.int32(), False))


def encode_documents(docs: DataFrame, coder: ByteBpe, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids) of each row of docs: the token ids of its whole text, an empty array for null and empty texts.

    With `decoded`, a column of that name has the bytes that the ids decode to, made in the
    same task, so that the ids needn't go to another one. Each row stands by itself:
    repeated rows and ids give as many rows, an empty table none; other columns of docs
    play no part.
    """
    held = docs.sparkSession.sparkContext.broadcast(coder)  # as large as the vocabulary, which no table sways
    names = ["id", "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held.value

        def made() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, found)], dtype=np.int64).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)), type=_IDS)
            raw = [pa.array([coder.decode(ids.tolist()) for ids in found], pa.binary())] if decoded else []
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), lists, *raw], names=names)

        rows, found, size = [], [], 0
        for part in slices(batches):
            for row, ids in zip(part.column(0).to_pylist(), coder.encode_all(part.column(1).to_pylist()), strict=True):
                rows.append(row)
                found.append(ids)
                size += ids.nbytes * (2 if decoded else 1)
                if size >= BATCH_BYTES:
                    yield made()
                    rows, found, size = [], [], 0
        if rows:
            yield made()

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, "id long, ids array<int>" + ", decoded binary" * decoded)


def decode_documents(encoded: DataFrame, coder: ByteBpe) -> DataFrame:
    """(id, ids, decoded) of each row of (id, ids): the bytes that the ids stand for; null ids count as none."""
    held = encoded.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held.value
        for part in slices(batches):
            raw = [coder.decode(ids.values.to_numpy() if ids.is_valid else ()) for ids in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], names=["id", "ids", "decoded"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, ids array<int>, decoded binary")
