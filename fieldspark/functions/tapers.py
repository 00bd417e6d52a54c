"""Taper families in their periodic form, and the factors that go with a taper."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np


def _cosines(n: int, coefficients: Sequence[float]) -> np.ndarray:
    t = 2 * np.pi * np.arange(n) / (n - 1)
    return sum((-1) ** k * a * np.cos(k * t) for k, a in enumerate(coefficients))


def _general_gaussian(n: int, power: float, sigma: float) -> np.ndarray:
    return np.exp(-0.5 * np.abs(_centred(n) / sigma) ** (2 * power))


def _centred(n: int) -> np.ndarray:
    return np.arange(n) - (n - 1) / 2


def _triang(n: int) -> np.ndarray:
    return 1 - np.abs(_centred(n)) / ((n + n % 2) / 2 if n % 2 == 0 else (n + 1) / 2)


def _parzen(n: int) -> np.ndarray:
    x = np.abs(_centred(n)) / (n / 2)
    return np.where(x <= 0.5 * (n - 1) / n + 0.5 / n, np.where(x <= 0.5, 1 - 6 * x**2 * (1 - x), 2 * (1 - x) ** 3), 2 * (1 - x) ** 3)


def _bohman(n: int) -> np.ndarray:
    x = np.abs(_centred(n)) / ((n - 1) / 2)
    return np.maximum((1 - x) * np.cos(np.pi * x) + np.sin(np.pi * x) / np.pi, 0.0)


def _barthann(n: int) -> np.ndarray:
    x = np.abs(np.arange(n) / (n - 1) - 0.5)
    return 0.62 - 0.48 * x + 0.38 * np.cos(2 * np.pi * x)


def _tukey(n: int, share: float = 0.5) -> np.ndarray:
    if share <= 0:
        return np.ones(n)
    x = np.minimum(np.arange(n), n - 1 - np.arange(n)) / ((n - 1) / 2)
    return np.where(x < share, 0.5 * (1 - np.cos(np.pi * np.minimum(x / min(share, 1.0), 1))), 1.0)


def _chebwin(n: int, attenuation: float) -> np.ndarray:
    order = n - 1
    beta = math.cosh(math.acosh(10 ** (abs(attenuation) / 20)) / order)
    x = beta * np.cos(np.pi * np.arange(n) / n)
    big = np.abs(x) > 1
    p = np.cos(order * np.arccos(np.clip(x, -1, 1)))
    p[big] = np.sign(x[big]) ** order * np.cosh(order * np.arccosh(np.abs(x[big])))
    if n % 2:
        w = np.real(np.fft.fft(p))
        half = w[: (n + 1) // 2]
        w = np.concatenate([half[:0:-1], half])
    else:
        w = np.real(np.fft.fft(p * np.exp(1j * np.pi / n * np.arange(n))))
        w = np.concatenate([w[n // 2 : 0 : -1], w[1 : n // 2 + 1]])
    return w / w.max()


def _dpss(n: int, half_bandwidth: float) -> np.ndarray:
    """First discrete prolate spheroidal sequence, from the tridiagonal eigenproblem that shares its vectors."""
    w = half_bandwidth / n
    k = np.arange(n)
    diag = ((n - 1 - 2 * k) / 2) ** 2 * np.cos(2 * np.pi * w)
    off = k[1:] * (n - k[1:]) / 2
    v = np.linalg.eigh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))[1][:, -1]
    return np.abs(v) / np.abs(v).max()


#: family -> taper of n samples, symmetric; ``taper`` makes the periodic form.
FAMILIES: dict[str, Callable[..., np.ndarray]] = {
    "boxcar": lambda n: np.ones(n),
    "hann": lambda n: _cosines(n, (0.5, 0.5)),
    "hamming": lambda n: _cosines(n, (0.54, 0.46)),
    "blackman": lambda n: _cosines(n, (0.42, 0.5, 0.08)),
    "blackmanharris": lambda n: _cosines(n, (0.35875, 0.48829, 0.14128, 0.01168)),
    "nuttall": lambda n: _cosines(n, (0.3635819, 0.4891775, 0.1365995, 0.0106411)),
    "flattop": lambda n: _cosines(n, (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368)),
    "bartlett": lambda n: 1 - np.abs(_centred(n)) / ((n - 1) / 2),
    "triang": _triang,
    "parzen": _parzen,
    "bohman": _bohman,
    "barthann": _barthann,
    "kaiser": lambda n, beta: np.i0(beta * np.sqrt(np.maximum(0, 1 - (_centred(n) / ((n - 1) / 2)) ** 2))) / np.i0(beta),
    "gaussian": lambda n, sigma: _general_gaussian(n, 1.0, sigma),
    "general_gaussian": _general_gaussian,
    "tukey": _tukey,
    "chebwin": _chebwin,
    "dpss": _dpss,
    "slepian": _dpss,
}


def taper(family: str, n: int, *args: float) -> np.ndarray:
    """Periodic taper: one sample longer, the last cut off."""
    if family not in FAMILIES:
        raise ValueError(f"unknown taper family {family!r}; known: {', '.join(sorted(FAMILIES))}")
    if n < 1:
        raise ValueError("a taper has at least one sample")
    return np.ones(1) if n == 1 else FAMILIES[family](n + 1, *args)[:n]


@dataclass(frozen=True)
class TaperFactors:
    """Sums of a taper and what follows from them at sample rate ``fs``."""

    values: tuple[float, ...]

    @property
    def s1(self) -> float:
        return math.fsum(self.values)

    @property
    def s2(self) -> float:
        return math.fsum(v * v for v in self.values)

    @property
    def coherent_gain(self) -> float:
        return self.s1 / len(self.values)

    @property
    def nenbw(self) -> float:
        return len(self.values) * self.s2 / self.s1**2

    def enbw(self, fs: float) -> float:
        return fs * self.s2 / self.s1**2

    @property
    def apodization_factor(self) -> float:
        return math.sqrt(self.nenbw) * self.coherent_gain

    def spectral_density_scale(self, fs: float) -> float:
        return math.sqrt(2 / (fs * self.s2))
