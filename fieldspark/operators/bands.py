"""Bands: which harmonics belong to which, and the observations of a band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.series import drop_incomplete


def assign_bands(fcs: DataFrame, bands: DataFrame) -> DataFrame:
    """Each coefficient with its bands, by harmonic number.  ``bands(level, band, k_lo, k_hi, ...)`` is configuration.

    The band table is turned into one row per harmonic, so this is an equi-join with a small side.
    """
    each = bands.select("level", "band", F.explode(F.sequence("k_lo", "k_hi")).alias("k"))
    on = ["level", "k"] if "level" in fcs.columns else ["k"]
    return fcs.join(F.broadcast(each), on)


def assign_bands_by_frequency(fcs: DataFrame, bands: DataFrame, frequency: Column, closed: str = "left") -> DataFrame:
    """By frequency interval, closed on the left, the right, both or neither side."""
    lo, hi = F.col("f_lo"), F.col("f_hi")
    above = frequency >= lo if closed in ("left", "both") else frequency > lo
    below = frequency <= hi if closed in ("right", "both") else frequency < hi
    return fcs.join(F.broadcast(bands.select("level", "band", "f_lo", "f_hi")), above & below).drop("f_lo", "f_hi")


def widen_single(bands: DataFrame, rule: str = "min3") -> DataFrame:
    """Bands of one harmonic grow by one on either side, so that a coherence can be had."""
    if rule != "min3":
        raise NotImplementedError(f"no widening rule {rule!r}")
    one = F.col("k_lo") == F.col("k_hi")
    wide = {"k_lo": F.when(one, F.col("k_lo") - 1).otherwise(F.col("k_lo")), "k_hi": F.when(one, F.col("k_hi") + 1).otherwise(F.col("k_hi"))}
    if "df" in bands.columns:
        wide |= {"f_lo": F.when(one, F.col("f_lo") - F.col("df")).otherwise(F.col("f_lo")), "f_hi": F.when(one, F.col("f_hi") + F.col("df")).otherwise(F.col("f_hi"))}
    return bands.withColumns(wide)


def complete_observations(obs: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Observations with finite values on every channel."""
    return drop_incomplete(obs, [f"{c}_{p}" for c in channels for p in ("re", "im")], finite=True)


def apply_weights(obs: DataFrame, channels: Sequence[str], weight: str = "weight", drop_zero: bool = True) -> DataFrame:
    """All channels times the weight itself; a weight of zero (or none) takes the observation out."""
    scaled = obs.withColumns({f"{c}_{p}": F.col(f"{c}_{p}") * F.col(weight) for c in channels for p in ("re", "im")})
    return scaled.where(F.col(weight).isNotNull() & (F.col(weight) != 0)) if drop_zero else scaled
