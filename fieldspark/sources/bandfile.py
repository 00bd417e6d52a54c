"""Band-setup tables: text files of (level, first harmonic, last harmonic) and the packaged sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Bands = list[tuple[int, int, int]]

# Packaged band sets, (decimation level from 1, lowest harmonic, highest harmonic).
DEFAULT_BANDS: Bands = [
    (1, 25, 30), (1, 20, 24), (1, 16, 19), (1, 13, 15), (1, 10, 12), (1, 8, 9), (1, 6, 7), (1, 5, 5),
    (2, 14, 17), (2, 11, 13), (2, 9, 10), (2, 7, 8), (2, 6, 6), (2, 5, 5),
    (3, 14, 17), (3, 11, 13), (3, 9, 10), (3, 7, 8), (3, 6, 6), (3, 5, 5),
    (4, 18, 22), (4, 14, 17), (4, 10, 13), (4, 7, 9), (4, 5, 6),
]
FAST_BANDS: Bands = [(1, 6, 7), (1, 5, 5), (2, 6, 6), (2, 5, 5), (3, 6, 6), (3, 5, 5), (4, 7, 9), (4, 5, 6)]
BANDS_256_26: Bands = [
    (1, 47, 55), (1, 39, 46), (1, 31, 37), (1, 25, 30), (1, 20, 24), (1, 16, 19), (1, 13, 15), (1, 10, 12), (1, 8, 9), (1, 6, 7), (1, 5, 5),
    (2, 14, 17), (2, 11, 13), (2, 9, 10), (2, 7, 8), (2, 6, 6), (2, 5, 5),
    (3, 14, 17), (3, 11, 13), (3, 9, 10), (3, 7, 8), (3, 6, 6), (3, 5, 5),
    (4, 18, 22), (4, 14, 17), (4, 10, 13),
]
# the longer set goes on at the last level; the six-level set moves the levels apart
BANDS_256_29: Bands = [*BANDS_256_26, (4, 7, 9), (4, 5, 6), (4, 4, 4)]
BANDS_SIX_LEVEL: Bands = [
    (1, 10, 12), (1, 8, 9), (1, 6, 7), (1, 5, 5), (2, 9, 10), (2, 7, 8), (2, 6, 6), (2, 5, 5),
    (3, 14, 17), (3, 11, 13), (3, 9, 10), (3, 7, 8), (3, 6, 6), (3, 5, 5),
    (4, 18, 22), (4, 14, 17), (4, 10, 13), (4, 7, 9), (4, 5, 6),
    (5, 18, 22), (5, 14, 17), (5, 10, 13), (5, 7, 9), (5, 5, 6),
    (6, 18, 22), (6, 14, 17), (6, 10, 13), (6, 7, 9), (6, 5, 6),
]

PACKAGED: dict[str, Bands] = {"default": DEFAULT_BANDS, "fast": FAST_BANDS, "256_26": BANDS_256_26, "256_29": BANDS_256_29, "six_level": BANDS_SIX_LEVEL}


def parse_bands(lines: list[str]) -> Bands:
    """Rows of a band file; the first line must announce their number."""
    rows = [line.split() for line in lines if line.strip()]
    if not rows:
        raise ValueError("a band file begins with its number of bands")
    bands = [(int(a), int(b), int(c)) for a, b, c in rows[1:]]
    if int(rows[0][0]) != len(bands):
        raise ValueError(f"the band file announces {rows[0][0]} bands and has {len(bands)}")
    return bands


def read_band_file(spark: SparkSession, path: str) -> Bands:
    """Band tables are configuration: a few dozen lines, read through Spark so that any store will do."""
    return parse_bands([r["value"] for r in spark.read.text(path, wholetext=False).collect()])


def bands_of_level(bands: Bands, level: int, order: str = "ascending lower bound") -> Bands:
    if order != "ascending lower bound":
        return [b for b in bands if b[0] == level]
    return sorted((b for b in bands if b[0] == level), key=lambda b: b[1])


def band_table(spark: SparkSession, bands: Bands, fs: float, factors: list[int], lengths: list[int]) -> DataFrame:
    """(level from 0, band, k_lo, k_hi, f_lo, f_hi, f_center, period); edges lie half a harmonic outside."""
    levels = sorted({b[0] for b in bands})
    if not len(factors) == len(lengths) == len(levels):
        raise ValueError("one decimation factor and one window length per level of the band table")
    if fs <= 0:
        raise ValueError("a positive sample rate is needed")
    at, spacing = 1, {}
    for level, factor, n in zip(levels, factors, lengths, strict=True):
        at *= factor
        spacing[level] = fs / at / n
    rows = []
    for level in levels:
        for i, (_, lo, hi) in enumerate(bands_of_level(bands, level)):
            rows.append((levels.index(level), i, lo, hi, spacing[level]))
    df = spark.createDataFrame(rows, "level int, band int, k_lo int, k_hi int, df double")
    df = df.withColumn("f_lo", F.col("k_lo") * F.col("df") - F.col("df") / 2).withColumn("f_hi", F.col("k_hi") * F.col("df") + F.col("df") / 2)
    return df.withColumn("f_center", (F.col("k_lo") + F.col("k_hi")) / 2 * F.col("df")).withColumn("period", 1 / F.col("f_center"))


def log_bands(level: int, k_min: int, k_max: int, per_decade: int) -> Bands:
    """Adjoining bands of equal width in the logarithm of frequency: a rule in place of a table."""
    edges = [k_min]
    step = 10 ** (1 / per_decade)
    while edges[-1] < k_max:
        edges.append(min(k_max, max(edges[-1] + 1, round(edges[-1] * step))))
    return [(level, a, b - 1 if b < k_max else b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
