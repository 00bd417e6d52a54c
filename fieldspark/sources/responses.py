"""Instrument responses: frequency-amplitude-phase tables, scale factors, and interpolation to harmonics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_fap(spark: SparkSession, path: str, channel: str) -> DataFrame:
    """CSV of frequency (Hz), amplitude and phase (degrees), header or not: (channel, f, re, im)."""
    rows = spark.read.csv(path, comment="#").select(*[F.expr(f"try_cast(trim(_c{i}) as double)").alias(c) for i, c in enumerate(("f", "amplitude", "phase"))])
    rows = rows.where("f is not null and amplitude is not null")
    phase = F.radians(F.coalesce("phase", F.lit(0.0)))
    return rows.select(F.lit(channel).alias("channel"), "f", (F.col("amplitude") * F.cos(phase)).alias("re"), (F.col("amplitude") * F.sin(phase)).alias("im"))


def at_harmonics(responses: DataFrame, length: int, fs: float) -> DataFrame:
    """(channel, k, re, im) by linear interpolation between table rows; harmonics outside the table have none.

    A range join of harmonics with the segments between neighbouring rows; both are configuration-sized.
    """
    w = W.partitionBy("channel").orderBy("f")
    seg = responses.select("channel", "f", "re", "im", *[F.lead(c).over(w).alias(f"{c}_1") for c in ("f", "re", "im")]).where("f_1 is not null")
    ks = responses.sparkSession.range(length // 2).select(F.col("id").cast("int").alias("k"), (F.col("id") * fs / length).alias("_f"))
    got = seg.join(F.broadcast(ks), (F.col("_f") >= F.col("f")) & (F.col("_f") < F.col("f_1")))
    t = (F.col("_f") - F.col("f")) / (F.col("f_1") - F.col("f"))
    return got.select("channel", "k", *[(F.col(c) + t * (F.col(f"{c}_1") - F.col(c))).alias(c) for c in ("re", "im")])


def pole_zero(spark: SparkSession, channel: str, poles: Sequence[complex], zeros: Sequence[complex], gain: float, length: int, fs: float) -> DataFrame:
    """(channel, k, re, im) of a pole-zero response in angular frequency."""
    rows = []
    for k in range(length // 2):
        s = 2j * math.pi * k * fs / length
        num, den = gain + 0j, 1 + 0j
        for z in zeros:
            num *= s - z
        for p in poles:
            den *= s - p
        r = num / den if den else 0j
        rows.append((channel, k, r.real, r.imag))
    return spark.createDataFrame(rows, "channel string, k int, re double, im double")
