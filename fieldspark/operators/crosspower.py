"""Cross powers of channels, and transfer functions in closed form from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.complexcol import C


def cross_powers(obs: DataFrame, group: Sequence[str], pairs: Sequence[tuple[str, str]], average: bool = True) -> DataFrame:
    """One row per group with the mean (or sum) of a * conj(b) of each pair as ``a__b``, and ``n``: one aggregate."""
    made = []
    for a, b in pairs:
        z = C.of(a) * C.of(b).conj()
        made += (z.avg() if average else z.sum()).named(f"{a}__{b}")
    return obs.groupBy(*group).agg(F.count("*").alias("n"), *made)


def cross_power_matrix(obs: DataFrame, group: Sequence[str], channels: Sequence[str], join_char: str = "_", station: str | None = None) -> DataFrame:
    """The spectral density matrix as rows (group, a, b, re, im); labels are station and channel."""
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i:]]
    wide = cross_powers(obs, group, pairs)
    label = (lambda c: f"{station}{join_char}{c}") if station else (lambda c: c)
    rows = []
    for a, b in pairs:
        z = C.of(f"{a}__{b}")
        rows.append(F.struct(F.lit(label(a)).alias("a"), F.lit(label(b)).alias("b"), z.re.alias("re"), z.im.alias("im")))
        if a != b:
            rows.append(F.struct(F.lit(label(b)).alias("a"), F.lit(label(a)).alias("b"), z.re.alias("re"), (-z.im).alias("im")))
    return wide.select(*group, F.explode(F.array(*rows)).alias("e")).select(*group, "e.*")


def power(s: DataFrame | None, a: str, b: str, have: set[tuple[str, str]]) -> C:
    return C.of(f"{a}__{b}") if (a, b) in have else C.of(f"{b}__{a}").conj()


def tf_from_cross_powers(obs: DataFrame, group: Sequence[str], inputs: Sequence[str] = ("hx", "hy"), outputs: Sequence[str] = ("ex", "ey", "hz"), reference: Sequence[str] | None = None) -> DataFrame:
    """Impedance and tipper rows (group, output, input, re, im) by the determinant ratios of cross powers.

    With reference channels these take the conjugate side of every product; a group whose determinant vanishes is NULL.
    """
    a, b = inputs
    r = list(reference or inputs)
    pairs = [(x, q) for x in (a, b, *outputs) for q in r]
    s = cross_powers(obs, group, pairs)
    p = lambda x, q: C.of(f"{x}__{q}")
    det = p(a, r[0]) * p(b, r[1]) - p(a, r[1]) * p(b, r[0])
    rows = []
    for o in outputs:
        first = (p(o, r[0]) * p(b, r[1]) - p(o, r[1]) * p(b, r[0])) / det
        second = (p(o, r[1]) * p(a, r[0]) - p(o, r[0]) * p(a, r[1])) / det
        for i, z in ((a, first), (b, second)):
            rows.append(F.struct(F.lit(o).alias("output"), F.lit(i).alias("input"), z.re.alias("re"), z.im.alias("im"), F.col("n")))
    return s.select(*group, F.explode(F.array(*rows)).alias("e")).select(*group, "e.*")


def coherence(obs: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """Squared coherence |S_ab|^2 / (S_aa S_bb); 0 where a power vanishes."""
    s = cross_powers(obs, group, [(a, a), (b, b), (a, b)], average=False)
    num, den = C.of(f"{a}__{b}").abs2(), F.col(f"{a}__{a}_re") * F.col(f"{b}__{b}_re")
    return s.select(*group, "n", F.coalesce(F.try_divide(num, den), F.lit(0.0)).alias("coherence"))
