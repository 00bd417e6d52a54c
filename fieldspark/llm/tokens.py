"""Byte-level BPE encoding and decoding through a sentencepiece model built from the rank file.

The model is serialised straight from the vocabulary: every token's bytes are
written in the byte-to-character map of byte-level BPE, its score is its negative
rank, the normaliser is the identity, and no white space is touched.  Pre-tokens
are encoded one by one (a token of the vocabulary is itself, as rank-table encoders
have it); ids decode by the inverse map.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.packing import GPT_PATTERN, byte_symbols

_UNKNOWN, _NORMAL = 2, 1


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised model: piece 0 is the unknown piece, piece i + 1 the i-th token by rank."""
    symbol = byte_symbols()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, _UNKNOWN))]
    for token in by_rank:
        piece = "".join(map(symbol.__getitem__, token)).encode()
        out.append(_field(1, _field(1, piece) + _field(2, -float(ranks[token])) + _field(3, _NORMAL)))
    # trainer: BPE, vocabulary size, unknown 0, no other special pieces
    off = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, 0) + _field(41, off) + _field(42, off) + _field(43, off)
    # normaliser: identity; no dummy prefix, no white-space removal or escaping
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder over one rank file.  Encoded pre-tokens are remembered, up to ``remember`` of them."""

    def __init__(self, path: str, pattern: str = GPT_PATTERN, remember: int = 400_000):
        self.ranks = read_ranks(path)
        self.by_rank = sorted(self.ranks, key=self.ranks.__getitem__)
        self.ids = [self.ranks[t] for t in self.by_rank]
        self.bytes_of = {self.ranks[t]: t for t in self.by_rank}
        self.symbol = [byte_symbols()[b] for b in range(256)]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.find = regex.compile(pattern).findall
        self.remember = remember
        self.known: dict[str, bytes] = {}

    def _encode_new(self, words: list[str]) -> None:
        hard = []
        for w in words:
            r = self.ranks.get(w.encode())
            if r is None:
                hard.append(w)
            else:
                self.known[w] = struct.pack("<I", r)
        if hard:
            mapped = ["".join([self.symbol[b] for b in w.encode()]) for w in hard]
            ids = self.ids
            for w, pieces in zip(hard, self.model.encode(mapped, num_threads=1), strict=True):
                self.known[w] = struct.pack(f"<{len(pieces)}I", *[ids[p - 1] for p in pieces])

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = self.find(text)
        known = self.known
        if len(known) > self.remember:
            known.clear()
        new = set(words).difference(known)
        if new:
            self._encode_new(list(new))
        return b"".join(map(known.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str = GPT_PATTERN) -> ByteBpe:
    return ByteBpe(path, pattern)


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for x in batch.column(1):
        yield x.as_py() or ""


def _digest_pass(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in _texts(batch):
                packed = bpe.encode_packed(text)
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(np.frombuffer(packed, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids_pass(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.encode(t) for t in _texts(batch)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decode_pass(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str = GPT_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; a null or empty text has no ids.  Repeated and null ids stay as they are."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_ids_pass(ranks_path, pattern), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str = GPT_PATTERN) -> DataFrame:
    """(doc_id, bytes) of an encoded table; null ids decode to nothing.  An id outside the vocabulary is an error."""
    src = encoded.select("doc_id", "ids")
    return src.mapInArrow(_decode_pass(ranks_path, pattern), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip_digest(docs: DataFrame, ranks_path: str, pattern: str = GPT_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids, SHA-256 of the decoded bytes.  Nulls, ties and extras as in ``encode_documents``."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_digest_pass(ranks_path, pattern), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
