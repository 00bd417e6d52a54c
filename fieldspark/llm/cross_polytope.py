"""Nearest neighbours by largest inner product, with cross-polytope hashing.

Vectors fall into bands by norm, each ``ratio`` of the one above, and are lifted to
the largest norm of their band (an extra coordinate makes up what a vector lacks),
which turns the largest inner product of a band into the smallest angle.  Each hash
table applies a pseudo-rotation - three rounds of random signs and a fast Hadamard
transform - and puts a vector at its nearest signed axis.  Where that would leave
buckets of more than ``bucket`` vectors on average, a second pseudo-rotation's nearest
axis, out of as many as are needed, cuts them further, so the hash grows with the table.

A query probes the cells (axis, second axis) of every table by the sum of its
coordinates along them, largest first.  How many it probes in each band is fitted: a
bounded sample of queries (``sample``) is answered exactly, the places of the
neighbours' cells in the probe order tell what share any number of probes would find,
and the cheapest numbers that find ``target`` of them are taken.

Buckets are dealt out as (table, band, cell, block); a block holds a bounded number
of vectors, so a bucket with a third of all vectors is many blocks, and the queries
that probe it stream past each.  In a block the exact inner products are one matrix
product and each query keeps its best ``k``; those bounded lists merge to the answer.
Queries with fewer than ``k`` candidates found see all vectors, in blocks as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import partitions, written


@dataclass(frozen=True)
class AnnParams:
    """Neighbours, hash tables, average vectors of a bucket, vectors of a block, ratio of norm bands, queries of the fitting sample and the share
    of their neighbours that the fitted probes find."""

    k: int = 20
    tables: int = 6
    bucket: int = 4096
    block: int = 4096
    seed: int = 17
    ratio: float = 0.8
    sample: int = 160
    target: float = 0.96


def padded(dim: int) -> int:
    """The power of two that holds ``dim`` coordinates."""
    return 1 << max(1, (dim - 1).bit_length())


def second_axes(total: int, dim: int, p: AnnParams) -> int:
    """Signed axes of the second rotation in use: 1 (none) until buckets of the first would exceed ``bucket`` vectors on average."""
    first = 2 * padded(dim + 1)
    return min(first, 1 << max(0, int(np.ceil(np.log2(max(total, 1) / (p.bucket * first))))))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, orthonormal."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """``tables`` pairs of pseudo-rotations of vectors padded to a power of two.

    Signed axes are 0..size-1 and, for negative ends, size on; a cell is axis * second + second axis.
    """

    def __init__(self, dim: int, second: int, p: AnnParams):
        self.size, self.second = padded(dim), second
        rng = np.random.default_rng(p.seed)
        self.signs = rng.integers(0, 2, (p.tables, 2, 3, self.size)) * 2.0 - 1.0

    def rotate(self, x: np.ndarray, table: int, which: int) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        for s in self.signs[table, which]:
            y = hadamard(y * s)
        return y

    def along(self, x: np.ndarray, table: int) -> np.ndarray:
        """Of each row and cell: the sum of the coordinates along the cell's axes."""
        y = self.rotate(x, table, 0)
        both = np.concatenate([y, -y], 1)
        if self.second == 1:
            return both
        z = self.rotate(x, table, 1)[:, : self.second // 2]
        return (both[:, :, None] + np.concatenate([z, -z], 1)[:, None, :]).reshape(len(x), -1)

    def cell(self, x: np.ndarray, table: int) -> np.ndarray:
        """The nearest cell of each row: the nearest axis of either rotation."""
        y = self.rotate(x, table, 0)
        axis = np.concatenate([y, -y], 1).argmax(1)
        if self.second == 1:
            return axis
        z = self.rotate(x, table, 1)[:, : self.second // 2]
        return axis * self.second + np.concatenate([z, -z], 1).argmax(1)

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The ``n`` first cells of each row's probe order."""
        out = []
        for lo in range(0, len(x), 256):
            near = self.along(x[lo : lo + 256], table)
            n = min(n, near.shape[1])
            part = np.argpartition(-near, n - 1, axis=1)[:, :n]
            order = np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable")
            out.append(np.take_along_axis(part, order, 1))
        return np.concatenate(out)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles (all have ``dim`` entries)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), np.float64).reshape(len(col), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _hash_pass(dim: int, second: int, p: AnnParams):
    """Of (vec_id, embedding, band, share of the band's largest norm): each vector's cell in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = CrossPolytope(dim + 1, second, p)
        for batch in batches:
            if not batch.num_rows:
                continue
            share = np.minimum(np.asarray(batch.column(3)), 1.0)[:, None]
            lift = np.concatenate([_unit(_matrix(batch.column(1), dim)) * share, np.sqrt(1 - share**2)], 1)
            cells = np.stack([hasher.cell(lift, t) for t in range(p.tables)], 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _lists(cells), batch.column(1)], ["vec_id", "band", "cells", "embedding"])

    return run


def _aim(x: np.ndarray) -> np.ndarray:
    return np.concatenate([_unit(x), np.zeros((len(x), 1))], 1)


def _probe_pass(dim: int, second: int, most: int, p: AnnParams):
    """Of (vec_id, embedding): the ``most`` first cells of each query's probe order in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = CrossPolytope(dim + 1, second, p)
        for batch in batches:
            if not batch.num_rows:
                continue
            aim = _aim(_matrix(batch.column(1), dim))
            for t in range(p.tables):
                cells = hasher.probes(aim, t, most).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), t, np.int32)), _lists(cells), batch.column(0), batch.column(1)], ["tab", "cells", "vec_id", "embedding"])

    return run


def _sample_pass(dim: int, ids: np.ndarray, x: np.ndarray, k: int):
    """Of (vec_id, band, cells, embedding): the best ``k`` rows of a task for each query of the sample, with their bands and cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple]] = [[] for _ in ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            own, band = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            score = x @ _matrix(batch.column(3), dim).T
            score[ids[:, None] == own[None, :]] = -np.inf
            n = min(k, len(own))
            for q, at in enumerate(np.argpartition(-score, n - 1, axis=1)[:, :n]):
                new = [(-score[q, j], int(own[j]), int(band[j]), batch.column(2)[int(j)].as_py()) for j in at if score[q, j] > -np.inf]
                kept[q] = sorted(kept[q] + new, key=lambda r: r[:2])[:k]
        rows = [(int(q), r[1], -r[0], r[2], r[3]) for q, own in zip(ids, kept, strict=True) for r in own]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["query_id", "vec_id", "score", "band", "cells"])

    return run


def fitted_probes(place: np.ndarray, band: np.ndarray, counts: dict[int, int], cells: int, target: float) -> dict[int, int]:
    """The probes of each band: of all choices that find ``target`` of the sample's neighbours one of the cheapest.

    ``place`` is where a neighbour's cell comes in the probe order (the best over the tables), ``band`` its band.  Work is
    the probes of a band times its vectors; at a price per unit of work every band takes what pays best, and the highest
    price that still finds enough is the answer.  A band without a neighbour in the sample gets one probe.
    """
    gain = {}
    for b in counts:
        own = np.sort(place[band == b])
        # options: one probe, or up to the place of a neighbour
        tried = np.unique(np.r_[0, own])
        gain[b] = (tried + 1, np.searchsorted(own, tried, side="right"))

    def choice(price: float) -> tuple[dict[int, int], int]:
        out, found = {}, 0
        for b, n in counts.items():
            probes, hits = gain[b]
            i = int(np.argmax(hits - price * n * probes))
            out[b], found = int(min(probes[i], cells)), found + int(hits[i])
        return out, found

    need = int(np.ceil(target * len(place)))
    low, high = 0.0, 1.0  # the price of 0 takes all, that of 1 next to nothing
    for _ in range(60):
        mid = (low + high) / 2 if low else high / 2**8
        if choice(mid)[1] >= need:
            low = mid
        else:
            high = mid
    return choice(low)[0]


_BEST = "query_id long, vec_id long, score double"


def best_in_block(q_id: np.ndarray, q: np.ndarray, x_id: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each query's best ``k`` of the block.  The product only shortlists; scores are summed row by row, so equal vectors tie."""
    out = []
    for lo in range(0, len(q), 512):
        rough = q[lo : lo + 512] @ x.T
        for i, row in enumerate(rough, lo):
            own = x_id != q_id[i]
            if not own.any():
                continue
            row = np.where(own, row, -np.inf)
            n = min(k, int(own.sum()))
            edge = np.partition(row, len(row) - n)[len(row) - n]
            near = np.flatnonzero((row >= edge - 1e-9 * max(1.0, np.abs(row[own]).max())) & own)
            score = (x[near] * q[i]).sum(1)
            ids = x_id[near]
            order = np.lexsort((ids, -score))
            order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]][:k] if len(order) else order
            out.append((np.full(len(order), q_id[i]), ids[order], score[order]))
    return out


def _reduced(found: list, k: int) -> pa.RecordBatch | None:
    """The best ``k`` distinct candidates of each query among what the blocks of this task gave so far."""
    if not found:
        return None
    a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (s[1:] != s[:-1])
    a, b, s = a[first], b[first], s[first]
    new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    rank = np.arange(len(a)) - np.repeat(new, np.diff(np.r_[new, len(a)]))
    keep = rank < k
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(s[keep])], ["query_id", "vec_id", "score"])


def _block_pass(dim: int, p: AnnParams, hold: int = 500_000):
    """Rows in order of bucket, block and, in a block, vectors before queries: the block is held, the queries stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, block, found, n = None, ([], []), None, [], 0
        for batch in batches:
            key = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(5)], 1)
            cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
            ids, x = batch.column(5).to_numpy(zero_copy_only=False), _matrix(batch.column(6), dim)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if tuple(key[lo, :4]) != at:
                    at, own, block = tuple(key[lo, :4]), ([], []), None
                if not key[lo, 4]:
                    own[0].append(ids[lo:hi])
                    own[1].append(x[lo:hi])
                elif own[0]:
                    block = block or tuple(np.concatenate(v) for v in own)
                    got = best_in_block(ids[lo:hi], x[lo:hi], *block, p.k)
                    found += got
                    n += sum(len(g[0]) for g in got)
                    if n > hold:
                        yield _reduced(found, p.k)
                        found, n = [], 0
        if (out := _reduced(found, p.k)) is not None:
            yield out

    return run


_BUCKET = ["tab", "band", "cell", "block"]


def _searched(own: DataFrame, asks: DataFrame, dim: int, p: AnnParams) -> DataFrame:
    """Queries ``asks`` against vectors ``own``, both (tab, band, cell, blocks, vec_id, embedding), bucket by bucket in blocks."""
    n = partitions(own.sparkSession)
    # a vector is in one block of its bucket, a query goes to all of them
    own = own.select("tab", "band", "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"), F.lit(False).alias("query"), "vec_id", "embedding")
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    asks = asks.select("tab", "band", "cell", F.explode(every).alias("block"), F.lit(True).alias("query"), "vec_id", "embedding")
    dealt = own.unionByName(asks).repartition(n, *_BUCKET).sortWithinPartitions(*_BUCKET, "query")
    return dealt.mapInArrow(_block_pass(dim, p), _BEST)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The best ``k`` distinct candidates of each query; every task keeps no more than ``k`` of a query before they are dealt."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a repeated id counts with its best vector; pairs that several tables found are the same
    once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # 0.0 + x turns a minus zero into zero
    return ranked.select("query_id", "rank", "vec_id", (F.lit(0.0) + F.col("score")).alias("score"))


def nearest_neighbours(vectors: DataFrame, params: AnnParams | None = None, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best candidates of every row whose id is divisible by ``every``.

    Vectors that are null, zero, of another length than most, or that hold null or non-finite entries take no part, nor
    do null ids.  A repeated id counts once among a query's neighbours, with its best vector; repeated query ids give the
    best over their vectors.  Ties go to the smaller id.  Extra columns are ignored; an empty table gives an empty result.
    """
    p = params or AnnParams()
    spark = vectors.sparkSession
    single = vectors.schema[vec_col].dataType.elementType.typeName() == "float"
    kind = "float" if single else "double"  # single precision is shipped as it is, and multiplied as double
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    src = src.where(sound)
    # logarithms, so that no norm overflows; the largest entry is bound once a row
    most = F.array(F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double")))))
    norm = F.transform(most, lambda m: F.log(m) + 0.5 * F.log(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + (v / m) * (v / m))))[0]
    facts = src.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), "dim").first()
    if facts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total, top = facts
    src = src.where(F.size("embedding") == dim)
    query = F.pmod("vec_id", F.lit(every)) == 0
    second = second_axes(total, dim, p)
    step = -float(np.log(p.ratio))
    banded = src.select("vec_id", "embedding", (F.lit(top) - norm).alias("below")).withColumn("band", F.floor(F.col("below") / step).cast("int"))
    shared = banded.select("vec_id", "embedding", "band", F.exp(F.col("band") * step - F.col("below")).alias("share"))
    indexed = written(shared.mapInArrow(_hash_pass(dim, second, p), f"vec_id long, band int, cells array<int>, embedding array<{kind}>"), "op9")

    # the range of doubles holds some thousands of bands at most
    counts = {r["band"]: r["count"] for r in indexed.groupBy("band").count().collect()}
    asked = indexed.where(query).select("vec_id", "embedding")
    n_asked = asked.count()
    if n_asked == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    draw = F.xxhash64(F.lit(p.seed), F.col("vec_id"))
    some = asked.where(F.pmod(draw, F.lit(1 << 30)) <= min(1.0, 2 * p.sample / n_asked) * (1 << 30)).orderBy(draw, "vec_id").limit(p.sample).collect()
    some = some or asked.limit(1).collect()
    probes = dict.fromkeys(counts, 1)
    if some:
        ids, x = np.array([r["vec_id"] for r in some]), np.array([r["embedding"] for r in some], float)
        ids, first = np.unique(ids, return_index=True)
        x = x[first]
        by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        near = indexed.mapInArrow(_sample_pass(dim, ids, x, p.k), "query_id long, vec_id long, score double, band int, cells array<int>")
        near = near.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") <= p.k).collect()
        if near:
            hasher, place = CrossPolytope(dim + 1, second, p), np.full(len(near), np.iinfo(np.int64).max)
            row = np.searchsorted(ids, [r["query_id"] for r in near])
            cells = np.array([r["cells"] for r in near])
            for q in range(len(ids)):
                mine = np.flatnonzero(row == q)
                for t in range(p.tables):
                    along = hasher.along(_aim(x[q : q + 1]), t)[0]
                    # cells that tie count as if all came before
                    before = len(along) - np.searchsorted(np.sort(along), along[cells[mine, t]], side="left") - 1
                    place[mine] = np.minimum(place[mine], before)
            probes = fitted_probes(place, np.array([r["band"] for r in near]), counts, 2 * padded(dim + 1) * second, p.target)

    hashed = indexed.select("vec_id", "band", "embedding", F.posexplode("cells").alias("tab", "cell"))
    probed = spark.createDataFrame(list(probes.items()), "band int, probes int")
    counted = hashed.groupBy("tab", "band", "cell").agg(F.ceil(F.count("*") / p.block).cast("long").alias("blocks"))
    # how many buckets there are grows with the table, so Spark decides by their size how they are joined
    blocks = written(counted.join(F.broadcast(probed), "band"), "op9")
    own = hashed.join(blocks.drop("probes"), ["tab", "band", "cell"])
    aimed = asked.mapInArrow(_probe_pass(dim, second, max(probes.values()), p), f"tab int, cells array<int>, vec_id long, embedding array<{kind}>")
    asks = aimed.select("tab", F.posexplode("cells").alias("place", "cell"), "vec_id", "embedding").join(blocks, ["tab", "cell"]).where("place < probes")
    found = written(_best(_searched(own, asks, dim, p), p.k), "op9")

    full = found.where(F.col("rank") == min(p.k, total - 1)).select(F.col("query_id").alias("vec_id"))
    short = asked.join(full, "vec_id", "left_anti")
    if short.limit(1).count() == 0:
        return found
    done = found.join(full.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi")
    whole = [F.lit(0).alias("tab"), F.lit(0).alias("band"), F.lit(0).alias("cell"), F.lit(-(-total // p.block)).cast("long").alias("blocks"), "vec_id", "embedding"]
    return done.unionByName(_best(_searched(indexed.select(*whole), short.select(*whole), dim, p), p.k))
