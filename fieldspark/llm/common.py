"""Shared helpers: Arrow text buffers, rolling hashes, written intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: ASCII white space that separates words: space and \t \n \v \f \r.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


# --------------------------------------------------------------------------- intermediate tables


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only where it is unset (tests), a local one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        got = sc._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        named = tempfile.mkdtemp(prefix="fieldspark-")
        sc.setCheckpointDir(named)
    return named


#: Whether a query's shuffle files go when it ends, and not only once the driver happens to collect its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and any executor may be lost.

    The shuffle files the writing needed go with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fieldspark/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    # results read it whenever they are computed, so what is not discarded goes when the driver ends
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    return out


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`written` once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_written_path", None)
        if path:
            fs, p = _file_system(df.sparkSession, path)
            fs.delete(p, True)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the unit by which packed buckets are dealt out."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def share_of(spark: SparkSession, rows: int) -> int:
    """A quarter of a partition's part of ``rows``: a key of more is frequent.  There are at most four such keys a partition."""
    return max(1, -(-rows // (4 * partitions(spark))))


def dealt_join(rows: DataFrame, counted: DataFrame, on: list[str], place: Column, share: int) -> DataFrame:
    """``rows`` with the columns of ``counted(on..., rows, ...)``, which has a row per key and how many ``rows`` there are of it.

    A key of more than ``share`` rows is dealt by ``place`` over as many slots as it fills shares.  ``share`` is a fixed
    part of all rows (``share_of``), so no more keys than there are shares can be as frequent as that: the broadcast that
    tells them is bounded by the number of partitions, whatever the data.
    """
    slots = F.ceil(F.col("rows") / share).cast("long")
    hot = counted.where(F.col("rows") > share).select(*on, slots.alias("_slots"))
    at = F.pmod(place, F.coalesce("_slots", F.lit(1).cast("long")))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_slot", at).drop("_slots")
    copies = counted.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)))
    return dealt.join(copies.hint("shuffle_hash"), [*on, "_slot"]).drop("_slot")


#: A row's identity where ids may be null or repeated: 128 bits of hashes of id and text.
ROW = ("_rk", "_rk2")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """The columns of ``ROW``.  Rows that repeat an id and a text have the same."""
    i, t = F.col(id_col), F.col(text_col)
    return [F.xxhash64(i, t).alias(ROW[0]), F.xxhash64(F.lit(0x5EED), t, i).alias(ROW[1])]


#: Bits by which rows are told that are none of a few: at most 65,536 words, whatever the tables.
FILTER_BITS = 1 << 22


def may_be_in(rows: DataFrame, few: DataFrame) -> DataFrame:
    """``rows`` with ``_may``: whether a row can be one of ``few``, by the first hash of ``ROW``, which both have.

    It is true for all that are and, as long as there is a small part of ``FILTER_BITS`` of them, for few others: the others
    need no shuffle to be joined with ``few``.  As the bits fill up more rows pass; none is ever lost.
    """
    bit = F.pmod(ROW[0], F.lit(FILTER_BITS).cast("long"))
    word, place = F.shiftright(bit, 6).alias("_word"), F.pmod(bit, F.lit(64)).cast("int")
    words = few.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    marked = rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    return marked.withColumn("_may", F.getbit(F.coalesce("_bits", F.lit(0).cast("long")), place) == 1).drop("_word", "_bits")


def struct_of(df: DataFrame) -> Column:
    """All columns of a row in one, so that no name of theirs can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


# --------------------------------------------------------------------------- passes


def give_back() -> None:
    """Freed memory that this process still holds goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass of mapInArrow whose worker, which stays for later tasks, holds no freed memory once its task has ended."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return passed


# --------------------------------------------------------------------------- text as bytes


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 buffer, offsets (n+1) and null mask of a string column, without making Python strings."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1 + col.offset)[col.offset :]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    null = np.asarray(col.is_null())
    return buf, offsets, null


def documents_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[np.ndarray]:
    """The bytes of each row's text; a null text is empty."""
    buf, offs, null = text_bytes(batch.column(batch.schema.get_field_index(column)))
    for i in range(len(null)):
        yield buf[0:0] if null[i] else buf[offs[i] : offs[i + 1]]


# --------------------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], U64))[0])


class Rolling:
    """Hashes of any substrings of a text from prefix sums: sum of T[byte] * B**i modulo 2**64, B odd.

    The power tables grow as needed to the longest text seen by the worker.
    """

    def __init__(self, seed: int):
        self.table = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
        self.base = mix_int(seed ^ 0x5851F42D4C957F2D) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.size = 0
        self.need(1 << 12)

    def need(self, n: int) -> None:
        if n >= self.size:
            size = 1 << int(n + 1).bit_length()
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.full(size, self.base, U64)) * U64(self.inverse)
                self.inv_power = np.cumprod(np.full(size, self.inverse, U64)) * U64(self.base)
            self.size = size

    def prefix(self, b: np.ndarray) -> np.ndarray:
        """Prefix sums with a leading zero."""
        n = len(b)
        self.need(n)
        out = np.empty(n + 1, U64)
        out[0] = 0
        np.cumsum(self.table[b] * self.power[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of text[start:end] for each pair."""
        return mix((prefix[end] - prefix[start]) * self.inv_power[start] + (end - start).astype(U64))


@lru_cache(maxsize=16)
def rolling(seed: int) -> Rolling:
    """One table of powers per seed and worker."""
    return Rolling(seed)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no white space."""
    if len(b) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(b) + 2, bool)
    edge[0] = edge[-1] = True
    np.take(_IS_SPACE, b, out=edge[1:-1])
    turn = np.flatnonzero(edge[1:] != edge[:-1])
    return turn[0::2], turn[1::2]


def ascii_lower(b: np.ndarray) -> np.ndarray:
    return _LOWER[b]


def pack_buckets(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Yield (bucket, rows, bytes): each bucket's rows, one column after the other in one value."""
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    cols = [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(sorted_bucket)) + 1
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(order)], strict=True):
        if hi > lo:
            yield int(sorted_bucket[lo]), int(hi - lo), b"".join(c[lo:hi].tobytes() for c in cols)


def unpack(rows: int, blob: bytes, *dtypes) -> list[np.ndarray]:
    out, at = [], 0
    for d in dtypes:
        d = np.dtype(d)
        out.append(np.frombuffer(blob, d, rows, at))
        at += rows * d.itemsize
    return out


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Group a partition sorted by ``bucket``: (bucket, [(kind, rows, blob), ...]).  Holds one bucket at a time."""
    at, held = None, []
    for batch in batches:
        for b, k, n, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "n", "blob")), strict=True):
            if b != at and held:
                yield at, held
                held = []
            at = b
            held.append((k, n, blob))
    if held:
        yield at, held
