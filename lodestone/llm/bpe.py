"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Each byte stands for one printable character, each vocabulary entry becomes a piece of such characters with the score
-rank, and the normaliser is the identity. Within one pre-token, sentencepiece then merges the pair of least rank first,
the leftmost of equals, which is what a rank-based byte-level encoder does. Decoding maps ids to their bytes.

Edge cases: null and empty texts give no ids; ids are kept per row, so repeated rows and ties need no rule; an empty
table gives an empty table; only the id and text columns are read, so other columns never clash.
"""

from __future__ import annotations

import base64
import functools
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import documents, small_batches
from lodestone.llm.units import BoundedCache, SpaceSplit

def load_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


@functools.cache
def byte_characters() -> tuple[str, ...]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, others for U+0100 on."""
    plain = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b}
    spare = iter(range(256, 512))
    return tuple(chr(b if b in plain else next(spare)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece model: piece r is the entry of rank r, and <unk> comes last."""
    chars = byte_characters()
    unknown, normal, bpe = 2, 1, 2
    parts = []
    for rank, token in enumerate(vocabulary):
        piece = "".join(chars[b] for b in token).encode()
        parts.append(_field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _field(3, normal)))
    parts.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(vocabulary) + 1) + _field(40, len(vocabulary)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(parts) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder of one rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import sentencepiece

        self.vocabulary = load_ranks(ranks_path)
        self.whole = {token: rank for rank, token in enumerate(self.vocabulary)}
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.vocabulary))
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.ranks = BoundedCache()
        self.encode_texts = SpaceSplit(self._encode_all)

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: pre-tokens that the vocabulary has whole are their own id, others go to the model in one call."""
        tokens = [self.pattern.findall(t) for t in texts]
        known = self.ranks
        known.make_room()
        new = set().union(*tokens).difference(known)
        rest = []
        for t in new:
            rank = self.whole.get(data := t.encode())
            if rank is None:
                rest.append((t, data.decode("latin-1").translate(self.table)))
            else:
                known[t] = rank.to_bytes(4, "little")
        for (t, _), pieces in zip(rest, self.model.encode([x for _, x in rest], num_threads=1) if rest else [], strict=True):
            known[t] = array("I", pieces).tobytes()
        return [b"".join([known[t] for t in ts]) for ts in tokens]


@functools.cache
def _codec(ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks_path, pattern)


@functools.cache
def _vocabulary(ranks_path: str) -> list[bytes]:
    return load_ranks(ranks_path)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the token ids of each whole text as little-endian unsigned 32-bit integers."""

    def run(batches):
        codec = _codec(ranks_path, pattern)
        for b in small_batches(batches, 1024, 2 << 20):
            ids = codec.encode_texts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids, decoded: the bytes that the ids stand for. Takes what encode() returns; null ids: no bytes."""

    def run(batches):
        piece = _vocabulary(ranks_path).__getitem__
        for b in small_batches(batches, 1024, 2 << 20):
            out = [b"".join(map(piece, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """The result columns of the query: number of tokens and digests of ids and decoded bytes."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
