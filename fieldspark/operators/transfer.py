"""Transfer-function tables: levels together, channels complete, resistivity and phase, comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.functions.complexcol import C
from fieldspark.functions.physics import apparent_resistivity, apparent_resistivity_error, phase_degrees, phase_error_degrees


def merge_levels(levels: Sequence[DataFrame]) -> DataFrame:
    """Whatever levels there are; the same period may occur at several and ``level`` stays a key."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), levels)


def pad_channels(tf: DataFrame, inputs: Sequence[str], outputs: Sequence[str], keys: Sequence[str] = ("level", "band")) -> DataFrame:
    """All (output, input) pairs of every band; a missing tipper is NULL, a missing electric channel an error."""
    have = {r["output"] for r in tf.select("output").distinct().collect()}
    lacking = [o for o in outputs if o not in have and o != "hz"]
    if lacking:
        raise NotImplementedError(f"no estimate for {', '.join(lacking)}")
    pairs = F.explode(F.array(*[F.struct(F.lit(o).alias("output"), F.lit(i).alias("input")) for o in outputs for i in inputs])).alias("p")
    grid = tf.select(*keys).distinct().select(*keys, pairs).select(*keys, "p.*")
    return grid.join(tf, [*keys, "output", "input"], "left")


def with_periods(tf: DataFrame, bands: DataFrame) -> DataFrame:
    return tf.join(F.broadcast(bands.select("level", "band", "period")), ["level", "band"])


def resistivity_phase(tf: DataFrame, units: str = "MT") -> DataFrame:
    """Impedance rows with rho, phi and, where there is a standard error ``se``, their errors.  ``tf`` has ``period``."""
    z, t = C(F.col("re"), F.col("im")), F.col("period")
    out = tf.where(F.col("output") != "hz").withColumns({"rho": apparent_resistivity(z, t, units), "phi": phase_degrees(z)})
    if "se" in tf.columns:
        out = out.withColumns({"rho_se": apparent_resistivity_error(z, F.col("se"), t, units), "phi_se": phase_error_degrees(z, F.col("se"))})
    return out


def standard_errors(tf: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Adds ``se`` from the noise covariance and the diagonal of the inverse signal covariance."""
    diag = F.coalesce(*[F.when(F.col("input") == x, F.hypot(F.col("cov_ss_re")[i], F.col("cov_ss_im")[i])) for i, x in enumerate(inputs)])
    return tf.withColumn("se", F.sqrt(diag * F.abs("cov_nn")))


def ascending_periods(tf: DataFrame) -> DataFrame:
    return tf.orderBy("period", "level", "output", "input")


def clip_bands(tf: DataFrame, n: int) -> DataFrame:
    """Without the ``n`` longest periods."""
    longest = tf.select("period").distinct().orderBy(F.desc("period")).limit(n)
    return tf.join(F.broadcast(longest), "period", "left_anti")


def period_limits(tf: DataFrame) -> tuple[float, float]:
    """Ends of a logarithmic axis for the table's periods: half decades, and 0.3 decades more where one is nearer than 0.15."""
    r = tf.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).first()
    return _axis(r["lo"], r["hi"], 2)


def resistivity_limits(tf: DataFrame) -> tuple[float, float]:
    """The same for ``rho``, by whole decades; what does not vary gets 0.01 to 10,000."""
    r = tf.agg(F.min("rho").alias("lo"), F.max("rho").alias("hi")).first()
    lo, hi = _axis(max(r["lo"], 1e-20), max(r["hi"], 1e-20), 1)
    return (0.01, 1e4) if abs(hi - lo) <= 1 else (lo, hi)


def _axis(lo: float, hi: float, per_decade: int) -> tuple[float, float]:
    a, b = math.log10(lo), math.log10(hi)
    down, up = math.floor(a * per_decade) / per_decade, math.ceil(b * per_decade) / per_decade
    return 10 ** (down - 0.3 * (a - down < 0.15)), 10 ** (up + 0.3 * (up - b < 0.15))


# --------------------------------------------------------------------------- comparison on common periods


def common_periods(a: DataFrame, b: DataFrame) -> DataFrame:
    """Logarithmic grid over the overlap of both tables' periods, as many points as the shorter one has."""
    span = lambda d: d.agg(F.min("period").alias("lo"), F.max("period").alias("hi"), F.countDistinct("period").alias("n"))
    both = span(a).unionAll(span(b)).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.min("n").alias("n")).where("lo <= hi and n > 0")
    grid = both.select("lo", "hi", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    step = F.when(F.col("n") > 1, (F.log10("hi") - F.log10("lo")) / (F.col("n") - 1)).otherwise(0.0)
    # first and last point are the ends themselves, free of rounding
    inner = F.pow(F.lit(10.0), F.log10("lo") + F.col("i") * step)
    return grid.select("i", F.when(F.col("i") == 0, F.col("lo")).when(F.col("i") == F.col("n") - 1, F.col("hi")).otherwise(inner).alias("period"))


def interpolate(tf: DataFrame, grid: DataFrame) -> DataFrame:
    """Linear interpolation of re and im at the grid's periods, and beyond the ends by the last two knots."""
    w = W.partitionBy("output", "input").orderBy("period")
    knots = tf.groupBy("output", "input", "period").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    ahead = {c: F.lead(c).over(w) for c in ("period", "re", "im")}
    seg = knots.select("output", "input", "period", "re", "im", *[v.alias(f"{c}_1") for c, v in ahead.items()], F.row_number().over(w).alias("r"), F.count("*").over(W.partitionBy("output", "input")).alias("m"))
    seg = seg.where("r < m")
    inside = (F.col("g") >= F.col("period")) & (F.col("g") < F.col("period_1"))
    before, after = (F.col("r") == 1) & (F.col("g") < F.col("period")), (F.col("r") == F.col("m") - 1) & (F.col("g") >= F.col("period_1"))
    got = seg.join(F.broadcast(grid.select("i", F.col("period").alias("g"))), inside | before | after)
    t = (F.col("g") - F.col("period")) / (F.col("period_1") - F.col("period"))
    return got.select("output", "input", "i", F.col("g").alias("period"), *[(F.col(c) + t * (F.col(f"{c}_1") - F.col(c))).alias(c) for c in ("re", "im")])


def compare(a: DataFrame, b: DataFrame, rtol: float = 0.1, phase_tolerance: float = 4.0) -> DataFrame:
    """Per component on common periods: median amplitude ratio, correlation of log amplitudes, phase difference in degrees."""
    grid = common_periods(a, b)
    x, y = interpolate(a, grid), interpolate(b, grid).select("output", "input", "i", F.col("re").alias("re_b"), F.col("im").alias("im_b"))
    both = x.join(y, ["output", "input", "i"])
    za, zb = C(F.col("re"), F.col("im")), C(F.col("re_b"), F.col("im_b"))
    turn = F.degrees((za * zb.conj()).angle())
    made = both.withColumns({"ratio": F.try_divide(za.abs(), zb.abs()), "la": F.ln(F.nullif(za.abs(), F.lit(0.0))), "lb": F.ln(F.nullif(zb.abs(), F.lit(0.0))), "dphi": turn})
    out = made.groupBy("output", "input").agg(
        F.count("*").alias("n"), F.median("ratio").alias("ratio_median"), F.stddev_pop("ratio").alias("ratio_std"), F.try_divide(F.covar_pop("la", "lb"), F.stddev_pop("la") * F.stddev_pop("lb")).alias("amplitude_corr"),
        F.avg("dphi").alias("phase_mean"), F.stddev_pop("dphi").alias("phase_std"),
        F.bool_and(F.abs(F.col("ratio") - 1) <= rtol).alias("amplitude_close"), F.bool_and(F.abs("dphi") <= phase_tolerance).alias("phase_close"),
    )
    return out


def nearly_equal(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("level", "band", "output", "input"), rtol: float = 1e-5, atol: float = 1e-8) -> bool:
    y = b.select(*keys, F.col("re").alias("re_b"), F.col("im").alias("im_b"))
    close = lambda p: F.abs(F.col(p) - F.col(f"{p}_b")) <= atol + rtol * F.abs(F.col(f"{p}_b"))
    row = a.join(y, list(keys), "full").agg(F.bool_and(F.coalesce(close("re") & close("im"), F.col("re").isNull() & F.col("re_b").isNull())).alias("ok")).first()
    return bool(row["ok"])
