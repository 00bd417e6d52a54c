"""Best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best-fit: a fixed number of bins is open at a time; a bitset
(one Python integer) has a bit for every free space that some open bin has, so the
tightest bin that still takes a piece is the lowest set bit at or above its length.
When one bin too many is open the fullest closes.

Pieces are dealt out by hash, each partition packs its own; a partition's arrivals
come in blocks of ``block`` pieces, longest first inside a block.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import lean, partitions

#: The pre-token pattern of byte-level BPE vocabularies of this kind.
GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def byte_level_encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers JSON file as a rank table: ids are the file's, its added tokens are split off first."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    back = {c: b for b, c in byte_symbols().items()}
    ranks = {bytes(back[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added and all(c in back for c in piece)}
    return tiktoken.Encoding("json", pat_str=GPT_PATTERN, mergeable_ranks=ranks, special_tokens=added)


def pieces_of(n_ids: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces behind a first one that may be shorter."""
    if n_ids <= length:
        return [(0, n_ids)]
    head = n_ids % length or length
    return [(0, head)] + [(s, length) for s in range(head, n_ids, length)]


def _token_pass(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_level_encoding(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(np.asarray(enc.encode(text or "", allowed_special="all"), np.uint32), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(pieces_of(len(ids), length)):
                    for col, v in zip(out, (doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "n_ids"])

    return run


class BestFit:
    """Bounded-space best-fit.  ``put`` returns (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.n_open = 0
        self.n_bins = 0

    def put(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            free = size + ((fits & -fits).bit_length() - 1)
            held = self.by_free[free]
            b = held.pop()
            if not held:
                self.bits &= ~(1 << free)
            self.n_open -= 1
        else:
            free, b = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - size
        if left:
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.n_open += 1
            if self.n_open > self.open_bins:
                self._close_fullest()
        return b, self.capacity - free

    def _close_fullest(self) -> None:
        least = (self.bits & -self.bits).bit_length() - 1
        held = self.by_free[least]
        held.pop()
        if not held:
            self.bits &= ~(1 << least)
        self.n_open -= 1


def _pack_pass(length: int, open_bins: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        base = (ctx.partitionId() if ctx else 0) << 40
        fit = BestFit(length, open_bins)

        def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            size = rows.column("length").to_numpy()
            seq, off = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for i in np.argsort(-size, kind="stable"):
                seq[i], off[i] = fit.put(int(size[i]))
            yield from rows.append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(off)).combine_chunks().to_batches()

        # blocks are whole however the rows come in batches
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while n + batch.num_rows >= block:
                held.append(batch.slice(0, block - n))
                batch = batch.slice(block - n)
                yield from packed(pa.Table.from_batches(held))
                held, n = [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield from packed(pa.Table.from_batches(held))

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0, open_bins: int = 16384, block: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with the sequence and offset each is packed at.

    A document is its ids, as the tokenizers file gives them without special tokens of its own, and then ``end_id``; the
    text of an added token is that token.  Only longer ones than ``length`` are cut.  A null or empty text is the one
    id ``end_id``.  Null and repeated ids are packed like any others.  Columns: doc_id, piece, start, length, ids_crc32,
    n_ids, sequence_id, offset; other columns are not read.  An empty table gives an empty result.  ``open_bins`` bounds
    a task's memory; every piece is placed whatever its value.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, n_ids long"
    pieces = src.mapInArrow(lean(_token_pass(tokenizer_path, length, end_id)), schema)
    # with the task that made a piece, so that very many equal rows are not one task's
    spread = F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id())
    dealt = pieces.withColumn("_h", spread).repartition(max(1, partitions(spark) // 4), "_h").sortWithinPartitions("_h", "doc_id", "piece", "start").drop("_h")
    return dealt.mapInArrow(lean(_pack_pass(length, open_bins, block)), schema + ", sequence_id long, offset long")
