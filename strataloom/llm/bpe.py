"""Byte-level BPE through a sentencepiece model made from a rank file (operator 4).

The rank file (``base64 rank`` lines) is written as a sentencepiece BPE model: each byte string
becomes a piece of mapped characters, its score is the negative rank, and normalisation is the
identity.  Texts are split by the vocabulary's pattern and each match is encoded by itself; the
inverse mapping of the pieces decodes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, sliced

#: Matches held at once of one very long text.
CHUNK = 1 << 18
#: Distinct matches that a task remembers before it starts over.
REMEMBERED = 1 << 17


def byte_characters() -> list[str]:
    """A visible character for each byte: itself where visible in Latin-1, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def read_ranks(lines: list[bytes]) -> list[bytes]:
    """Byte strings in the order of their ranks, which must be 0, 1, 2, ..."""
    pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(r): base64.b64decode(b) for b, r in pairs}
    if sorted(ranks) != list(range(len(ranks))) or len(set(ranks.values())) != len(ranks):
        raise ValueError("ranks must run from 0 without gaps, for distinct byte strings")
    if missing := [b for b in range(256) if bytes([b]) not in set(ranks.values())]:
        raise ValueError(f"bytes without a rank: {missing}")
    return [ranks[k] for k in range(len(ranks))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(tag: int, n: int) -> bytes:
    return _varint(tag << 3) + _varint(n)


def _block(tag: int, data: bytes) -> bytes:
    return _varint(tag << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(pieces: list[bytes]) -> bytes:
    """The serialised model: piece k has id k, the unknown piece comes last."""
    chars = byte_characters()
    out = bytearray()
    for rank, data in enumerate(pieces):
        text = "".join(chars[b] for b in data).encode()
        out += _block(1, _block(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
    out += _block(1, _block(1, b"<unk>") + _number(3, 2))
    # trainer: model type BPE, the size, the unknown id and no begin, end or padding piece
    out += _block(2, _number(3, 2) + _number(4, len(pieces) + 1) + _number(40, len(pieces)) + _number(41, -1) + _number(42, -1) + _number(43, -1))
    # normaliser: identity, no added prefix, white space kept as it is
    out += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Vocabulary:
    """Model, pattern and byte strings; what tasks receive is the serialised model (about 1 MB)."""

    def __init__(self, lines: list[bytes], pattern: str):
        self.pieces, self.pattern = read_ranks(lines), pattern
        self.model = sentencepiece_model(self.pieces)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read().splitlines(), pattern)


class Encoder:
    """Encodes texts one pattern match at a time; lives within a task."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        self.mapped = {b: c for b, c in enumerate(byte_characters())}
        size = self.processor.get_piece_size() - 1
        self.whole = {self.processor.id_to_piece(k): struct.pack("<I", k) for k in range(size)}
        self.known: dict[str, bytes] = {}

    def _learn(self, parts: set[str]) -> None:
        rest = []
        for part in parts:
            text = part.encode().decode("latin-1").translate(self.mapped)
            if (data := self.whole.get(text)) is not None:  # a match that is a piece is never cut
                self.known[part] = data
            else:
                rest.append((part, text))
        for (part, _), ids in zip(rest, self.processor.encode([t for _, t in rest], out_type=int, num_threads=1), strict=True):
            self.known[part] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        matches, out = (m.group() for m in self.pattern.finditer(text)) if len(text) > 4 * CHUNK else iter(self.pattern.findall(text)), []
        while parts := list(islice(matches, CHUNK)):
            if new := set(parts).difference(self.known):
                if len(self.known) > REMEMBERED:  # start over, with all that this chunk needs
                    self.known.clear()
                    new = set(parts)
                self._learn(new)
            out.append(b"".join(map(self.known.__getitem__, parts)))
        return b"".join(out)


def _encode(vocabulary: Vocabulary):
    model, pattern = vocabulary.model, vocabulary.pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, pattern)
        for batch in sliced(batches, "text"):
            ids = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], [*batch.schema.names, "ids", "n_tokens"])

    return run


def _decode(vocabulary: Vocabulary, name: str):
    model = vocabulary.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {c: b for b, c in enumerate(byte_characters())}
        pieces = [bytes(back[c] for c in processor.id_to_piece(k)) for k in range(processor.get_piece_size() - 1)]
        del processor
        for batch in sliced(batches, "ids", 1 << 20):
            out = [None if x is None else b"".join(map(pieces.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, name])

    return run


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` with ids (binary, 4 bytes a token, little-endian) and n_tokens.

    A null or empty text gives no token.  Every row stays, repeated ones too, and other columns
    are kept (ids and n_tokens replace columns of these names).  One pass without a shuffle.
    """
    docs = docs.drop("ids", "n_tokens")
    schema = docs.select("*", F.lit(b"").alias("ids"), F.lit(0).cast("long").alias("n_tokens")).schema
    return docs.mapInArrow(lean(_encode(vocabulary)), schema)


def decoded(df: DataFrame, vocabulary: Vocabulary, name: str = "decoded") -> DataFrame:
    """``df`` with the column ``name``, the bytes that the ids stand for (null ids: null); it replaces one of that name."""
    df = df.drop(name)
    return df.mapInArrow(lean(_decode(vocabulary, name)), df.select("*", F.lit(b"").alias(name)).schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, name: str = "decoded") -> DataFrame:
    """``decoded(encoded(docs))`` in one Python step, so that each task needs one worker only."""
    docs = docs.drop("ids", "n_tokens", name)
    encode, decode = _encode(vocabulary), _decode(vocabulary, name)
    schema = docs.select("*", F.lit(b"").alias("ids"), F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").alias(name)).schema
    return docs.mapInArrow(lean(lambda batches: decode(encode(batches))), schema)
