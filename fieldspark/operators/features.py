"""Spectral features of windows and the weights made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.tapers import taper
from fieldspark.operators.spectra import _detrended, _matrix
from fieldspark.operators.windows import WindowScheme, sliding_windows

Kernel = Callable[[Column], Column]


def windowed_coherence(windows: DataFrame, a: str, b: str, length: int, share: float = 0.25, overlap: float = 0.5, family: str = "hann") -> DataFrame:
    """Squared coherence of two channels inside each window from its sub-windows: (keys, w, n0, k, value).

    Sub-windows are ``share`` of the window, ``overlap`` of one another; their harmonics are spread to the window's own
    by linear interpolation.  Where a power vanishes the coherence is 0.
    """
    sub = max(2, int(length * share))
    step = max(1, int(sub * (1 - overlap)))
    starts = np.arange(0, length - sub + 1, step)
    w = taper(family, sub)
    keys = [c for c in windows.columns if c not in (a, b)]
    kinds = {f.name: f.dataType.simpleString() for f in windows.schema.fields}
    at, ia, ib = [windows.columns.index(c) for c in keys], windows.columns.index(a), windows.columns.index(b)
    k = np.arange(length // 2)
    grid = k * sub / length

    def spectra(col: pa.Array) -> np.ndarray:
        x = _matrix(col, length)
        cut = np.stack([x[:, s : s + sub] for s in starts], 1)
        flat = _detrended(cut.reshape(-1, sub), "constant") * w
        return np.fft.rfft(flat, axis=1).reshape(len(x), len(starts), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x, y = spectra(part.column(ia)), spectra(part.column(ib))
                power = (np.abs(x) ** 2).sum(1) * (np.abs(y) ** 2).sum(1)
                coh = np.abs((x * y.conj()).sum(1)) ** 2 / np.where(power > 0, power, 1) * (power > 0)
                value = np.stack([np.interp(grid, np.arange(coh.shape[1]), row) for row in coh]) if len(coh) else coh
                row = pa.array(np.repeat(np.arange(part.num_rows), len(k)))
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(row) for i in at], pa.array(np.tile(k, part.num_rows).astype(np.int32)), pa.array(value.ravel())], [*keys, "k", "value"])

    return windows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "k int", "value double"]))


@dataclass(frozen=True)
class CoherenceFeature:
    """Coherence of channel_1 at station_1 with channel_2 at station_2, and the kernel that makes weights of it."""

    channel_1: str
    station_1: str
    channel_2: str
    station_2: str
    kernel: Kernel
    share: float = 0.25
    name: str = "striding_window_coherence"


def paired_windows(series: DataFrame, feature: CoherenceFeature, s: WindowScheme) -> DataFrame:
    """(station_1, [run_1,] w, n0, _a, _b): the windows of the two channels side by side.

    Runs that begin at the same sample belong together, and so do their windows of one number.
    """
    keys = [c for c in ("station", "run") if c in series.columns]
    side = lambda station, channel, name: sliding_windows(series.where(F.col("station") == station).select(*keys, "n", F.col(channel).alias(name)), keys, [name], s)
    one, other = side(feature.station_1, feature.channel_1, "_a"), side(feature.station_2, feature.channel_2, "_b")
    return one.join(other.select("w", "n0", "_b"), ["w", "n0"]).select(*keys, "w", "n0", "_a", "_b")


def feature_weight_table(series: DataFrame, features: Sequence[CoherenceFeature], s: WindowScheme) -> DataFrame:
    """(n0, weight) of one level's windows: the product over the features of their mean kernel values.

    A window that a feature has no value for (the other station has no such window) has no row.
    """
    out = None
    for f in features:
        windows = paired_windows(series, f, s)
        made = windowed_coherence(windows, "_a", "_b", s.length, f.share).withColumn("feature", F.lit(f.name))
        one = feature_weights(made, {f.name: f.kernel}, ["n0"])
        out = one if out is None else out.join(one.withColumnRenamed("weight", "_w"), "n0").withColumn("weight", F.col("weight") * F.col("_w")).drop("_w")
    if out is None:
        raise ValueError("no feature is given")
    return out




def threshold_kernel(at: float) -> Kernel:
    return lambda v: F.when(v >= at, 1.0).otherwise(0.0)


def ramp_kernel(low: float, high: float) -> Kernel:
    """Cosine step from 0 at ``low`` to 1 at ``high``."""
    return lambda v: 0.5 - 0.5 * F.cos(F.lit(np.pi) * F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0)))


def feature_weights(features: DataFrame, kernels: dict[str, Kernel], keys: Sequence[str], combine: str = "multiplication", per_band: DataFrame | None = None) -> DataFrame:
    """(keys, weight): the product over all features of the mean kernel value over a window's harmonics.

    ``features(keys..., feature, k, value)``; missing values count as 0.  With ``per_band`` (level, band, k_lo, k_hi) the
    mean is over the band's harmonics and the band is a key as well.
    """
    if combine != "multiplication":
        raise ValueError("weights combine by multiplication")
    value = F.coalesce(F.nanvl(F.col("value"), F.lit(0.0)), F.lit(0.0))
    expr = F.lit(None).cast("double")
    for name, kernel in kernels.items():
        expr = F.when(F.col("feature") == name, kernel(value)).otherwise(expr)
    made = features.withColumn("_w", expr).where(F.col("_w").isNotNull())
    by = list(keys)
    if per_band is not None:
        each = per_band.select("level", "band", F.explode(F.sequence("k_lo", "k_hi")).alias("k"))
        made, by = made.join(F.broadcast(each), "k"), [*by, "level", "band"]
    mean = made.groupBy(*by, "feature").agg(F.avg("_w").alias("_m"))
    return mean.groupBy(*by).agg(F.when(F.min("_m") <= 0, 0.0).otherwise(F.exp(F.sum(F.ln("_m")))).alias("weight"))
