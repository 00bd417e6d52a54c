"""Scalar functions of transfer functions and of the robust estimators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldspark.functions.complexcol import C


def apparent_resistivity(z: C, period: Column, units: str = "MT") -> Column:
    return _rho_scale(units) * period * z.abs2()


def apparent_resistivity_error(z: C, se: Column, period: Column, units: str = "MT") -> Column:
    err = 2 * F.sqrt(period * apparent_resistivity(z, period, units) / 5) * (se / math.sqrt(2))
    return err * 1e-3 if units == "SI" else err


def _rho_scale(units: str) -> float:
    scale = {"MT": 0.2, "SI": 2e-7}.get(units)
    if scale is None:
        raise ValueError("units are 'MT' or 'SI'")
    return scale


def phase_degrees(z: C) -> Column:
    """atan of the ratio, so in (-90, 90]; a real part of zero gives +-90."""
    ratio = F.degrees(F.atan(F.try_divide(z.im, z.re)))
    return F.when((z.re == 0) & (z.im != 0), F.signum(z.im) * 90.0).otherwise(ratio)


def phase_error_degrees(z: C, se: Column) -> Column:
    return F.degrees(F.try_divide(se, z.abs()))


def fold_phase(degrees: Column) -> Column:
    return F.when(degrees < 0, degrees + 180).otherwise(degrees)


def standard_error(cov_ss_inv: C, cov_nn: C) -> Column:
    return F.sqrt((cov_ss_inv * cov_nn).abs())


def rme_beta(r0: float) -> float:
    return 1.0 - math.exp(-r0)


def correction_factor(r0: float) -> float:
    return 1.0 / rme_beta(r0)


#: Leverage thresholds (p1 and p2 scale with the square root of n), ratio bound, and inlier bound.
EDF_P1, EDF_P2, EDF_P3, EDF_L1 = 2.0, 10.0, 5.0, 20.0


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def omega_to_hertz(omega: Column) -> Column:
    return omega / (2 * math.pi)


def hertz_to_period(f: Column) -> Column:
    return F.try_divide(F.lit(1.0), f)


def is_flat(values: Column, tolerance: float = 1e-8) -> Column:
    """Whether an array of amplitudes does not vary."""
    return (F.array_max(values) - F.array_min(values)) <= tolerance * F.greatest(F.abs(F.array_max(values)), F.lit(1e-300))
