"""Sliding windows over sample numbers.

Window w of length L and advance A = L - overlap covers samples [w A, w A + L)
counted from the series' first.  A series is cut into blocks of some windows' advances,
each with the overlap that its last windows reach into: one long series is many groups
of bounded size, and a sample is moved once, or twice near a block's edge.  Windows are
slices of a block.  Only whole windows exist.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from fieldspark.functions.tapers import TaperFactors, taper
from fieldspark.operators.series import extent


@dataclass(frozen=True)
class WindowScheme:
    length: int = 128
    overlap: int = 32
    family: str = "boxcar"
    args: tuple[float, ...] = ()
    fs: float = 1.0
    custom: tuple[float, ...] | None = None

    def __post_init__(self):
        if not 0 <= self.overlap < self.length:
            raise ValueError("overlap lies between 0 and length - 1")
        if self.custom is not None and len(self.custom) != self.length:
            raise ValueError("a taper has as many values as the window")

    @property
    def advance(self) -> int:
        return self.length - self.overlap

    @property
    def dt(self) -> float:
        return 1 / self.fs

    @property
    def duration(self) -> float:
        return self.length * self.dt

    @property
    def duration_advance(self) -> float:
        return self.advance * self.dt

    @property
    def taper(self) -> tuple[float, ...]:
        return self.custom if self.custom is not None else tuple(taper(self.family, self.length, *self.args).tolist())

    @property
    def factors(self) -> TaperFactors:
        return TaperFactors(self.taper)

    @property
    def scale(self) -> float:
        return self.factors.spectral_density_scale(self.fs)

    def harmonics(self) -> list[float]:
        return [k * self.fs / self.length for k in range(self.length // 2)]

    def count(self, n_samples: int) -> int:
        return 0 if n_samples < self.length else (n_samples - self.length) // self.advance + 1


def window_count(n_samples: Column, length: Column | int, advance: Column | int) -> Column:
    length = length if isinstance(length, Column) else F.lit(length)
    advance = advance if isinstance(advance, Column) else F.lit(advance)
    return F.when(n_samples < length, F.lit(0)).otherwise(F.floor((n_samples - length) / advance) + 1).cast("long")


def assign_windows(df: DataFrame, keys: Sequence[str], s: WindowScheme) -> DataFrame:
    """Each sample with every window it lies in: columns ``w`` and ``j``, its place there."""
    span = extent(df, keys).withColumn("_n_win", window_count(F.col("n_last") - F.col("n_first") + 1, s.length, s.advance))
    rel = df.join(span, list(keys)).withColumn("_r", F.col("n") - F.col("n_first"))
    last = F.least(F.floor(F.col("_r") / s.advance), F.col("_n_win") - 1)
    first = F.greatest(F.ceil((F.col("_r") - s.length + 1) / s.advance), F.lit(0))
    rel = rel.withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long")).where("_first <= _last")
    out = rel.withColumn("w", F.explode(F.sequence("_first", "_last"))).withColumn("j", (F.col("_r") - F.col("w") * s.advance).cast("int"))
    return out.drop("_n_win", "_r", "_first", "_last", "n_last")


def _slice_pass(n_keys: int, names: list[str], per_block: int, length: int, advance: int):
    """Of (keys, block, first sample number, samples in order): the block's whole windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, first = (batch.column(n_keys + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(n_keys + 2)
            ends = np.cumsum(np.asarray(lists.value_lengths()))
            flat = lists.flatten()
            at = np.asarray(flat.field(0))
            row, w, place = [], [], []
            for i, end in enumerate(ends):
                begin = ends[i - 1] if i else 0
                number = block[i] * per_block + np.arange(per_block)
                start = begin + np.searchsorted(at[begin:end], number * advance)
                start, number = start[start + length <= end], number[start + length <= end]
                whole = (at[start] == number * advance) & (at[start + length - 1] == number * advance + length - 1)
                row.append(np.full(int(whole.sum()), i))
                w.append(number[whole])
                place.append(start[whole])
            row, w, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, w, place))
            take = pa.array((place[:, None] + np.arange(length)).ravel())
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * length)
            out = [batch.column(i).take(pa.array(row)) for i in range(n_keys)] + [pa.array(w), pa.array(first[row] + w * advance)]
            out += [pa.ListArray.from_arrays(offsets, flat.field(j + 1).take(take)) for j in range(len(names) - n_keys - 2)]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def sliding_windows(df: DataFrame, keys: Sequence[str], values: Sequence[str], s: WindowScheme, per_block: int = 64) -> DataFrame:
    """One row per (series, w): ``n0``, the first sample number, and an array per channel.  Incomplete windows are left out.

    ``per_block`` windows are cut from one block; it does not change the result.
    """
    per_block = max(per_block, -(-s.overlap // s.advance))
    size = per_block * s.advance
    at = F.col("n") - F.col("n_first")
    own = F.floor(at / size)
    reach = F.array_compact(F.array(own, F.when((F.pmod(at, F.lit(size)) < s.overlap) & (own > 0), own - 1)))
    placed = df.select(*keys, "n", *values).join(extent(df, keys).select(*keys, "n_first"), list(keys)).select(*keys, F.explode(reach).alias("_b"), "n_first", F.struct(at.alias("_r"), *values).alias("_s"))
    rows = placed.groupBy(*keys, "_b", "n_first").agg(F.sort_array(F.collect_list("_s")).alias("_x"))
    kinds = {f.name: f for f in df.schema.fields}
    fields = [*[kinds[k] for k in keys], StructField("w", LongType()), StructField("n0", LongType()), *[StructField(v, ArrayType(kinds[v].dataType)) for v in values]]
    return rows.select(*keys, "_b", "n_first", "_x").mapInArrow(_slice_pass(len(keys), [f.name for f in fields], per_block, s.length, s.advance), StructType(fields))


def window_edges(df: DataFrame, keys: Sequence[str], s: WindowScheme) -> DataFrame:
    """Left edges (``n0``) of a series' windows, from its extent alone."""
    span = extent(df, keys).withColumn("n_win", window_count(F.col("n_last") - F.col("n_first") + 1, s.length, s.advance))
    ws = span.where("n_win > 0").select(*keys, "n_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_win") - 1)).alias("w"))
    return ws.select(*keys, "w", (F.col("n_first") + F.col("w") * s.advance).alias("n0"))


def detrend(x: Column, length: int, kind: str = "linear") -> Column:
    """An array without its least-squares line or its mean; any other kind leaves it."""
    if kind not in ("linear", "constant"):
        return x
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / length
    if kind == "constant" or length == 1:
        return F.transform(x, lambda v: v - mean)
    mid = (length - 1) / 2
    slope = F.aggregate(F.transform(x, lambda v, j: v * (j - mid)), F.lit(0.0), lambda a, v: a + v) / (length * (length**2 - 1) / 12)
    return F.transform(x, lambda v, j: v - mean - slope * (j - mid))


def apply_taper(x: Column, values: Sequence[float]) -> Column:
    return F.zip_with(x, F.array(*[F.lit(float(v)) for v in values]), lambda a, b: a * b)
