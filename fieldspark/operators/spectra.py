"""Windows to Fourier coefficients, and what is done to coefficients.

The transform is one Arrow pass over rows of windows (a batch is a matrix for
numpy); nothing is shuffled for it.  Coefficients are wide: one row per (series,
window, harmonic) with a pair of columns per channel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.complexcol import C
from fieldspark.operators.series import first_difference, nan_to_mean
from fieldspark.operators.windows import WindowScheme, sliding_windows


def _detrended(x: np.ndarray, kind: str | None) -> np.ndarray:
    if kind not in ("linear", "constant"):
        return x
    x = x - x.mean(1, keepdims=True)
    if kind == "linear" and x.shape[1] > 1:
        t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
        x = x - (x @ t / (t @ t))[:, None] * t
    return x


def _matrix(col: pa.Array, length: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), np.float64).reshape(len(col), length)


def transform(windows: DataFrame, values: Sequence[str], s: WindowScheme, detrend: str = "linear", after_taper: str | None = "linear", k_lo: int = 0, k_hi: int | None = None) -> DataFrame:
    """Detrend, taper, detrend, FFT and scale: rows (keys, w, n0, k, <channel>_re, <channel>_im) for k in [k_lo, k_hi].

    One-sided, without the Nyquist harmonic.  Harmonics that no band needs are never sent back from the pass.
    """
    top = s.length // 2 - 1 if k_hi is None else min(k_hi, s.length // 2 - 1)
    k = np.arange(k_lo, top + 1)
    w = np.array(s.taper)
    scale = s.scale
    keys = [c for c in windows.columns if c not in values]
    kinds = {f.name: f.dataType.simpleString() for f in windows.schema.fields}
    names = [f"{v}_{part}" for v in values for part in ("re", "im")]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "k int", *[f"`{n}` double" for n in names]])
    at = [windows.columns.index(c) for c in keys], [windows.columns.index(v) for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                row = pa.array(np.repeat(np.arange(part.num_rows), len(k)))
                out = [part.column(i).take(row) for i in at[0]] + [pa.array(np.tile(k, part.num_rows).astype(np.int32))]
                for i in at[1]:
                    x = _detrended(_detrended(_matrix(part.column(i), s.length), detrend) * w, after_taper)
                    z = np.fft.rfft(x, axis=1)[:, k] * scale
                    out += [pa.array(np.ascontiguousarray(z.real).ravel()), pa.array(np.ascontiguousarray(z.imag).ravel())]
                yield pa.RecordBatch.from_arrays(out, [*keys, "k", *names])

    return windows.mapInArrow(run, schema)


def recolor(fcs: DataFrame, values: Sequence[str], s: WindowScheme) -> DataFrame:
    """Undoes the prewhitening: divides by i 2 pi f.  The zero harmonic has no answer and becomes NULL."""
    omega = 2 * math.pi * F.col("k") * s.fs / s.length
    out = {}
    for v in values:
        out[f"{v}_re"] = F.try_divide(F.col(f"{v}_im"), omega)
        out[f"{v}_im"] = F.try_divide(-F.col(f"{v}_re"), omega)
    return fcs.withColumns(out)


def stft(df: DataFrame, keys: Sequence[str], values: Sequence[str], s: WindowScheme, prewhiten: bool = True, detrend: str = "linear", k_lo: int = 0, k_hi: int | None = None) -> DataFrame:
    """Series to spectrogram: mean for missing, prewhiten, window, detrend, taper, detrend, FFT, recolor."""
    filled = nan_to_mean(df, keys, values)
    if prewhiten:
        filled = first_difference(filled, keys, values, s.dt)
    fcs = transform(sliding_windows(filled, keys, values, s), values, s, "linear", detrend, k_lo, k_hi)
    return recolor(fcs, values, s) if prewhiten else fcs


def calibrate(fcs: DataFrame, responses: DataFrame, values: Sequence[str], scale: dict[str, float] | None = None, borrow: dict[str, str] | None = None) -> DataFrame:
    """Divides coefficients by ``responses(channel, k, re, im)``; a channel without one stays, or borrows another's.

    Responses are bounded by channels times harmonics.  ``scale`` multiplies the calibrated values.  Where a response is
    zero (often at k = 0) the coefficient is NULL.
    """
    wide = responses.groupBy("k").agg(*[F.first(F.when(F.col("channel") == v, F.struct("re", "im")), ignorenulls=True).alias(f"_r_{v}") for v in values])
    joined = fcs.join(F.broadcast(wide), "k", "left")
    out = {}
    for v in values:
        own = F.col(f"_r_{v}")
        if borrow and v in borrow:
            own = F.coalesce(own, F.col(f"_r_{borrow[v]}"))
        r = C(own["re"], own["im"])
        gain = float((scale or {}).get(v, 1.0))
        z = C.of(v)
        q = z / r * gain
        out[f"{v}_re"] = F.when(own.isNull(), z.re * gain).otherwise(q.re)
        out[f"{v}_im"] = F.when(own.isNull(), z.im * gain).otherwise(q.im)
    return joined.withColumns(out).drop(*[f"_r_{v}" for v in values])


def align_local_remote(local: DataFrame, remote: DataFrame, reference: Sequence[str], on: Sequence[str] = ("n0", "k")) -> DataFrame:
    """Local coefficients with the remote station's reference channels as ``r_<channel>``: an equi-join on window and harmonic."""
    cols = [F.col(f"{c}_{p}").alias(f"r_{c}_{p}") for c in reference for p in ("re", "im")]
    return local.join(remote.select(*on, *cols), list(on))
