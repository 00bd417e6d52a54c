import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import physics
from fieldspark.functions.complexcol import C, solve2
from fieldspark.functions.tapers import FAMILIES, TaperFactors, taper

ARGS = {"kaiser": (8.0,), "gaussian": (16.0,), "general_gaussian": (1.5, 16.0), "tukey": (0.25,), "chebwin": (80.0,), "dpss": (2.5,), "slepian": (2.5,)}


@pytest.mark.parametrize("family", sorted(FAMILIES))
def test_tapers_are_periodic_and_bounded(family):
    w = taper(family, 64, *ARGS.get(family, ()))
    assert len(w) == 64 and np.isfinite(w).all()
    assert w.max() <= 1 + 1e-6 and w.min() > -0.1
    assert np.allclose(w[1:], w[1:][::-1])  # periodic: symmetric about its middle sample


def test_taper_factors():
    f = TaperFactors(tuple(taper("boxcar", 32)))
    assert f.s1 == f.s2 == 32 and f.coherent_gain == 1 and f.nenbw == 1 and f.apodization_factor == 1
    h = TaperFactors(tuple(taper("hann", 256)))
    assert h.nenbw == pytest.approx(1.5) and h.coherent_gain == pytest.approx(0.5)
    assert h.enbw(4.0) == pytest.approx(4.0 * h.s2 / h.s1**2)
    assert h.spectral_density_scale(2.0) == pytest.approx(math.sqrt(2 / (2.0 * h.s2)))
    with pytest.raises(ValueError):
        taper("no such", 8)


def test_complex_algebra(spark):
    df = spark.createDataFrame([(1.0, 2.0, -3.0, 0.5)], "a_re double, a_im double, b_re double, b_im double")
    a, b = C.of("a"), C.of("b")
    made = {"mul": a * b, "div": a / b, "add": a + b, "sub": a - b, "conj": a.conj()}
    row = df.select(*[c for k, z in made.items() for c in z.named(k)], a.abs().alias("abs"), a.angle().alias("angle")).first()
    x, y = 1 + 2j, -3 + 0.5j
    for k, z in {"mul": x * y, "div": x / y, "add": x + y, "sub": x - y, "conj": x.conjugate()}.items():
        assert complex(row[f"{k}_re"], row[f"{k}_im"]) == pytest.approx(z)
    assert row["abs"] == pytest.approx(abs(x)) and row["angle"] == pytest.approx(math.atan2(2, 1))


def test_division_by_zero_is_null(spark):
    row = spark.range(1).select(*(C.lit(1 + 1j) / C.lit(0j)).named("z")).first()
    assert row["z_re"] is None and row["z_im"] is None


def test_solve2(spark):
    a = np.array([[1 + 1j, 2], [3, 4 - 2j]])
    x = np.array([2 - 1j, 0.5 + 3j])
    y = a @ x
    lit = [[C.lit(v) for v in r] for r in a]
    got = solve2(lit, [C.lit(v) for v in y])
    row = spark.range(1).select(*got[0].named("p"), *got[1].named("q")).first()
    assert [complex(row["p_re"], row["p_im"]), complex(row["q_re"], row["q_im"])] == pytest.approx(list(x))


def test_half_space(spark):
    """A uniform half-space of 100 ohm metres: rho 100 and phase 45 degrees at every period."""
    t = [1.0, 10.0, 1000.0]
    rows = [(p, math.sqrt(100 / (0.2 * p)) / math.sqrt(2), math.sqrt(100 / (0.2 * p)) / math.sqrt(2)) for p in t]
    df = spark.createDataFrame(rows, "period double, re double, im double")
    z = C(F.col("re"), F.col("im"))
    for r in df.select(physics.apparent_resistivity(z, F.col("period")).alias("rho"), physics.phase_degrees(z).alias("phi")).collect():
        assert r["rho"] == pytest.approx(100) and r["phi"] == pytest.approx(45)


def test_phase_quadrants(spark):
    df = spark.createDataFrame([(-1.0, -1.0), (-1.0, 1.0), (0.0, 2.0), (0.0, 0.0)], "re double, im double")
    got = [r[0] for r in df.select(physics.phase_degrees(C(F.col("re"), F.col("im")))).collect()]
    assert got[0] == pytest.approx(45) and got[1] == pytest.approx(-45) and got[2] == 90 and got[3] is None
    fold = df.select(physics.fold_phase(physics.phase_degrees(C(F.col("re"), F.col("im"))))).collect()
    assert fold[1][0] == pytest.approx(135)


def test_beta():
    assert physics.rme_beta(1.5) == pytest.approx(1 - math.exp(-1.5))
    assert physics.correction_factor(1.5) * physics.rme_beta(1.5) == pytest.approx(1)
