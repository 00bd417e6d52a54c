"""Anti-aliased decimation: a zero-phase Chebyshev low-pass, then every q-th sample.

The filter's memory is short, so a series is filtered in blocks with a halo that is
long enough for what lies outside to have died away; only at a series' own ends is
the signal extended by point reflection.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.series import extent, with_halo

ORDER, RIPPLE_DB = 8, 0.05


@lru_cache(maxsize=16)
def chebyshev_sections(factor: int) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a1 a2) of the type-I low-pass at 0.8 / factor of the Nyquist frequency."""
    eps = np.sqrt(10 ** (RIPPLE_DB / 10) - 1)
    mu = np.arcsinh(1 / eps) / ORDER
    theta = np.pi * (2 * np.arange(ORDER // 2) + 1) / (2 * ORDER)
    poles = -np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta)
    warped = 4 * np.tan(np.pi * 0.8 / factor / 2)
    z = (4 + poles * warped) / (4 - poles * warped)
    sections = []
    for p in z:
        a1, a2 = -2 * p.real, abs(p) ** 2
        gain = (1 + a1 + a2) / 4
        sections.append([gain, 2 * gain, gain, a1, a2])
    sections[0][:3] = [v * 10 ** (-RIPPLE_DB / 20) for v in sections[0][:3]]  # even order: the ripple's floor at zero frequency
    return np.array(sections)


def _response(factor: int, n: int) -> np.ndarray:
    """Squared magnitude on an FFT grid: forward and backward filtering together."""
    w = np.exp(-2j * np.pi * np.arange(n // 2 + 1) / n)
    h = np.ones(len(w), complex)
    for b0, b1, b2, a1, a2 in chebyshev_sections(factor):
        h *= (b0 + b1 * w + b2 * w**2) / (1 + a1 * w + a2 * w**2)
    return np.abs(h) ** 2


def halo_samples(factor: int, digits: float = 13.0) -> int:
    """Samples after which the filter has decayed by ``digits`` decades."""
    pole = max(np.sqrt(a2) for *_, a2 in chebyshev_sections(factor))
    return int(np.ceil(-digits * np.log(10) / np.log(pole)))


def zero_phase(x: np.ndarray, factor: int, left_end: bool, right_end: bool) -> np.ndarray:
    """Zero-phase filter of a block; at a true end the signal goes on as its point reflection."""
    pad = halo_samples(factor)
    left = 2 * x[0] - x[1 : pad + 1][::-1] if left_end and len(x) > 1 else np.zeros(0)
    right = 2 * x[-1] - x[-pad - 1 : -1][::-1] if right_end and len(x) > 1 else np.zeros(0)
    y = np.concatenate([np.full(pad, left[0] if len(left) else x[0]), left, x, right, np.full(pad, right[-1] if len(right) else x[-1])])
    n = 1 << int(len(y) + pad).bit_length()
    full = np.concatenate([y, np.linspace(y[-1], y[0], n - len(y))])
    out = np.fft.irfft(np.fft.rfft(full) * _response(factor, n), n)
    return out[pad + len(left) : pad + len(left) + len(x)]


def decimate(df: DataFrame, keys: Sequence[str], values: Sequence[str], factor: int, block: int = 65_536) -> DataFrame:
    """Every ``factor``-th sample of the filtered series, numbered anew from its first; series must be dense."""
    if factor == 1:
        return df
    halo = halo_samples(factor)
    block = max(block, 4 * halo)
    span = extent(df, keys)
    blocks = with_halo(df.select(*keys, "n", *values).join(span, list(keys)), block, halo, halo)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n long", *[f"`{v}` double" for v in values]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        first, last = pdf["n_first"].iloc[0], pdf["n_last"].iloc[0]
        n = pdf["n"].to_numpy()
        keep = pdf["core"].to_numpy() & ((n - first) % factor == 0)
        out = pdf.loc[keep, list(keys)].copy()
        out["n"] = (n[keep] - first) // factor
        for v in values:
            out[v] = zero_phase(pdf[v].to_numpy(float), factor, n[0] == first, n[-1] == last)[keep]
        return out

    return blocks.groupBy(*keys, "block").applyInPandas(run, schema)


def decimate_levels(df: DataFrame, keys: Sequence[str], values: Sequence[str], factors: Sequence[int], method: str = "iir") -> Iterator[DataFrame]:
    """The cascade: each level decimates the one before."""
    from fieldspark.operators.series import decimate_mean

    if method not in ("iir", "mean"):
        raise ValueError("the method is 'iir' or 'mean'")
    for factor in factors:
        df = df if factor == 1 else (decimate(df, keys, values, factor) if method == "iir" else decimate_mean(df, keys, values, factor))
        yield df.select(*keys, F.col("n"), *values)
