"""Complex regression with two inputs: least squares, robust, and with a remote reference.

Observations stay where they are.  Every step of an estimator is one aggregate over
the observations, grouped by (level, band), for all outputs at once; what comes back
is a few numbers per band and output - bounded by the configuration, whatever the
amount of data - and the 2 x 2 algebra between the steps is done on those.  No group
is ever collected, so a band may hold any number of observations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.complexcol import C, solve2
from fieldspark.functions.physics import EDF_L1, EDF_P1, EDF_P2, EDF_P3, correction_factor
from fieldspark.operators.lineage import cut

GROUP = ("level", "band")
SINGULAR = 1e-12


@dataclass(frozen=True)
class RobustParams:
    """Iteration bounds, Huber and redescending parameters, tolerance on the relative change of the estimate."""

    max_iterations: int = 10
    max_redescending: int = 2
    r0: float = 1.5
    u0: float = 2.8
    tolerance: float = 0.005


# --------------------------------------------------------------------------- least squares, closed form


def least_squares(obs: DataFrame, inputs: Sequence[str], outputs: Sequence[str], reference: Sequence[str] | None = None, group: Sequence[str] = GROUP) -> DataFrame:
    """(group, output, input, re, im, n) from one aggregate: b = (R^H X)^-1 R^H Y with R the reference or the inputs.

    A group with fewer observations than inputs, or with a singular matrix, has NULL estimates.
    """
    r = list(reference or inputs)
    left = lambda a, b, name: (C.of(a).conj() * C.of(b)).sum().named(name)
    sums = [F.count("*").alias("n")]
    for i, ri in enumerate(r):
        for j, xj in enumerate(inputs):
            sums += left(ri, xj, f"g{i}{j}")
        for o in outputs:
            sums += left(ri, o, f"y{i}_{o}")
    s = obs.groupBy(*group).agg(*sums)
    rows = []
    for o in outputs:
        b = solve2([[C.of("g00"), C.of("g01")], [C.of("g10"), C.of("g11")]], [C.of(f"y0_{o}"), C.of(f"y1_{o}")])
        for x, z in zip(inputs, b, strict=True):
            ok = F.col("n") >= 2
            rows.append(F.struct(F.lit(o).alias("output"), F.lit(x).alias("input"), F.when(ok, z.re).alias("re"), F.when(ok, z.im).alias("im"), F.col("n")))
    return s.select(*group, F.explode(F.array(*rows)).alias("e")).select(*group, "e.*")


def residuals(obs: DataFrame, tf: DataFrame, inputs: Sequence[str], output: str) -> DataFrame:
    """Observations with ``res_re`` and ``res_im`` of one output."""
    wide = tf.where(F.col("output") == output).groupBy("level", "band").agg(*[F.first(F.when(F.col("input") == x, F.col(p)), ignorenulls=True).alias(f"b_{x}_{p}") for x in inputs for p in ("re", "im")])
    joined = obs.join(F.broadcast(wide), list(GROUP))
    fit = sum((C.of(x) * C.of(f"b_{x}") for x in inputs[1:]), C.of(inputs[0]) * C.of(f"b_{inputs[0]}"))
    z = C.of(output) - fit
    return joined.withColumns({"res_re": z.re, "res_im": z.im}).drop(*[f"b_{x}_{p}" for x in inputs for p in ("re", "im")])


# --------------------------------------------------------------------------- leverage


def _quadratic(a: str, b: str, h: dict[str, Column]) -> Column:
    """x^H H x of two channels with the Hermitian matrix H."""
    x, y = C.of(a), C.of(b)
    cross = (y.conj() * x * C(h["re"], h["im"])).re
    return x.abs2() * h["h00"] + y.abs2() * h["h11"] + 2 * cross


def _inverse(s00: float, s11: float, s10: complex) -> tuple[float, float, complex]:
    """Inverse of [[s00, conj(s10)], [s10, s11]]; a matrix that is singular but for rounding gives small constants."""
    det = s00 * s11 - abs(s10) ** 2
    if not np.isfinite(det) or det <= SINGULAR * s00 * s11:
        return 1e-4, 1e-4, 1e-4 + 0j
    return s11 / det, s00 / det, -s10 / det


def _leverage_frame(spark, rows: dict[tuple, tuple], names: str) -> DataFrame:
    kinds = ", ".join(f"{names}{c} double" for c in ("h00", "h11", "re", "im"))
    return spark.createDataFrame([(*k, float(a), float(b), float(c.real), float(c.imag)) for k, (a, b, c) in rows.items()], f"level int, band int, {kinds}")


def _moments(obs: DataFrame, inputs: Sequence[str]) -> dict[tuple, tuple]:
    a, b = inputs
    s10 = (C.of(b) * C.of(a).conj()).sum()
    got = obs.groupBy(*GROUP).agg(F.count("*").alias("n"), F.sum(C.of(a).abs2()).alias("s00"), F.sum(C.of(b).abs2()).alias("s11"), *s10.named("s10")).collect()
    return {(r["level"], r["band"]): (r["n"], r["s00"], r["s11"], complex(r["s10_re"], r["s10_im"])) for r in got}


def leverage(obs: DataFrame, inputs: Sequence[str], rounds: int = 50) -> tuple[DataFrame, dict[tuple, int]]:
    """Observations with ``edf``, their effective degrees of freedom under the covariance of the inliers.

    Points above the inlier bound leave the covariance until none does.  Each round is one aggregate.
    """
    spark = obs.sparkSession
    obs = cut(obs)
    first = _moments(obs, inputs)
    n_obs = {k: v[0] for k, v in first.items()}
    now, count = first, dict(n_obs)
    h = {k: _inverse(v[1] / v[0], v[2] / v[0], v[3] / v[0]) for k, v in now.items()}
    out = obs
    for _ in range(rounds):
        frame = _leverage_frame(spark, h, "_")
        out = obs.join(F.broadcast(frame), list(GROUP)).withColumn("edf", _quadratic(*inputs, {"h00": F.col("_h00"), "h11": F.col("_h11"), "re": F.col("_re"), "im": F.col("_im")})).drop("_h00", "_h11", "_re", "_im")
        now = _moments(out.where(F.col("edf") <= EDF_L1), inputs)
        fewer = {k: now.get(k, (0,))[0] for k in count}
        if fewer == count:
            break
        for k in count:
            if fewer[k] != count[k] and fewer[k] > 0:
                v = now[k]
                h[k] = _inverse(v[1] / v[0], v[2] / v[0], v[3] / v[0])
        count = fewer
    return out, n_obs


def _taper_weight(edf: Column, n: Column) -> Column:
    p1, p2 = EDF_P1 * F.sqrt(n), EDF_P2 * F.sqrt(n)
    return F.when(edf > p2, 0.0).when(edf > p1, F.sqrt(p1 / edf)).otherwise(1.0)


def leverage_weights(obs: DataFrame, inputs: Sequence[str], reference: Sequence[str] | None = None) -> DataFrame:
    """Observations with ``weight``: 1, tapered, or 0 by leverage; with a reference also by the reference's own leverage.

    Where the two weights differ by more than the ratio bound the observation gets 0.  An empty table stays empty.
    """
    spark = obs.sparkSession
    out, n_obs = leverage(obs, inputs)
    counts = spark.createDataFrame([(*k, n) for k, n in n_obs.items()], "level int, band int, _n long")
    out = out.join(F.broadcast(counts), list(GROUP)).withColumn("_wt", _taper_weight(F.col("edf"), F.col("_n")))
    if reference is None:
        return out.withColumn("weight", F.col("_wt")).drop("_wt", "_n", "edf")
    m = _moments(obs, reference)
    frame = _leverage_frame(spark, {k: _inverse(v[1] / v[0], v[2] / v[0], v[3] / v[0]) for k, v in m.items()}, "_q")
    out = out.join(F.broadcast(frame), list(GROUP))
    edf = _quadratic(*reference, {"h00": F.col("_qh00"), "h11": F.col("_qh11"), "re": F.col("_qre"), "im": F.col("_qim")})
    out = out.withColumn("_wr", _taper_weight(edf, F.col("_n")))
    apart = (F.col("_wr") > EDF_P3 * F.col("_wt")) | (F.col("_wt") > EDF_P3 * F.col("_wr"))
    return out.withColumn("weight", F.when(apart, 0.0).otherwise(F.col("_wt") * F.col("_wr"))).drop("_wt", "_wr", "_n", "edf", "_qh00", "_qh11", "_qre", "_qim")


# --------------------------------------------------------------------------- robust regression


@dataclass
class _State:
    """One band and output between the steps."""

    n: int
    xx: np.ndarray
    zx: np.ndarray
    stage: str = "start"
    b: np.ndarray = field(default_factory=lambda: np.zeros(2, complex))
    var: float = 0.0
    psi: float = 1.0
    steps: int = 0
    redescended: int = 0
    yy: float = 0.0
    ss: float = 0.0


def _weights(stage: Column, size: Column, sigma: Column, p: RobustParams) -> Column:
    """Weight of the data against the prediction for a residual of that size.  Nothing to divide by means weight 1."""
    huber = F.when(size <= p.r0 * sigma, 1.0).otherwise(p.r0 * sigma / F.nullif(size, F.lit(0.0)))
    r = F.try_divide(size, sigma)
    fall = F.exp(-F.exp(F.least(p.u0 * (r - p.u0), F.lit(700.0))))
    return F.when(stage == "huber", huber).when(stage == "redescend", F.coalesce(fall, F.when(size == 0, 1.0).otherwise(0.0))).otherwise(1.0)


def _psi(stage: Column, w: Column, size: Column, sigma: Column, p: RobustParams) -> Column:
    r = F.coalesce(F.try_divide(size, sigma), F.lit(0.0))
    t = -F.exp(F.least(p.u0 * (r - p.u0), F.lit(700.0)))
    slope = w * (1 + p.u0 * t * r)
    return F.when(stage == "huber", (w == 1).cast("double")).when(stage == "redescend", F.greatest(slope, F.lit(0.0))).otherwise(1.0)


def _steps_frame(spark, states: dict[tuple, dict[str, _State]], outputs: Sequence[str]) -> DataFrame:
    keys = list(states)
    cols = {"level": pa.array([k[0] for k in keys], pa.int32()), "band": pa.array([k[1] for k in keys], pa.int32())}
    for o in outputs:
        per = [states[k][o] for k in keys]
        cols[f"_{o}_stage"] = pa.array([s.stage for s in per], pa.string())
        cols[f"_{o}_sigma"] = pa.array([float(np.sqrt(max(s.var, 0.0))) for s in per], pa.float64())
        for i in (0, 1):
            cols |= {f"_{o}_b{i}_re": pa.array([float(s.b[i].real) for s in per], pa.float64()), f"_{o}_b{i}_im": pa.array([float(s.b[i].imag) for s in per], pa.float64())}
    # an Arrow table of this size is a local relation: no job is needed to broadcast it
    return spark.createDataFrame(pa.table(cols))


def _cleaning(inputs: Sequence[str], outputs: Sequence[str], p: RobustParams) -> list[dict[str, Column]]:
    """Columns to add one after the other: each output's weighted residuals ``_<o>_e`` and psi' ``_<o>_psi`` under its band's state.

    Cleaned data are the fit plus these.

    One projection a step, so that no expression is written out more than once; made once for all sweeps.
    """
    x0, x1 = C.of(inputs[0]), C.of(inputs[1])
    fit = {o: x0 * C.of(f"_{o}_b0") + x1 * C.of(f"_{o}_b1") for o in outputs}
    steps = [{f"_{o}_f_{q}": v for o in outputs for q, v in (("re", fit[o].re), ("im", fit[o].im))}]
    apart = {o: C.of(o) - C.of(f"_{o}_f") for o in outputs}
    steps.append({f"_{o}_d_{q}": v for o in outputs for q, v in (("re", apart[o].re), ("im", apart[o].im))})
    steps.append({f"_{o}_size": C.of(f"_{o}_d").abs() for o in outputs})
    of = lambda o: (F.col(f"_{o}_stage"), F.col(f"_{o}_size"), F.col(f"_{o}_sigma"))
    steps.append({f"_{o}_w": _weights(*of(o), p) for o in outputs})
    made = {}
    for o in outputs:
        stage, size, sigma = of(o)
        e = C.of(f"_{o}_d") * F.col(f"_{o}_w")
        made |= {f"_{o}_e_re": e.re, f"_{o}_e_im": e.im, f"_{o}_psi": _psi(stage, F.col(f"_{o}_w"), size, sigma, p)}
    return [*steps, made]


def _sweep_sums(inputs: Sequence[str], z: Sequence[str], outputs: Sequence[str]) -> list[Column]:
    sums = []
    for o in outputs:
        e = C.of(f"_{o}_e")
        sums += [F.sum((C.of(f"_{o}_f") + e).abs2()).alias(f"{o}_yy"), F.sum(e.abs2()).alias(f"{o}_ss"), F.sum(f"_{o}_psi").alias(f"{o}_psi")]
        for i in (0, 1):
            sums += (C.of(inputs[i]).conj() * e).sum().named(f"{o}_x{i}")
            if z[i] != inputs[i]:
                sums += (C.of(z[i]).conj() * e).sum().named(f"{o}_z{i}")
    return sums


def _sweep(obs: DataFrame, states, inputs, z, outputs, steps: list[dict[str, Column]], sums: list[Column]) -> dict[tuple, dict]:
    """One pass: for each band and output the sums over cleaned data and their residuals that the next step needs."""
    df = obs.join(F.broadcast(_steps_frame(obs.sparkSession, states, outputs)), list(GROUP))
    for columns in steps:
        df = df.withColumns(columns)
    got = df.groupBy(*GROUP).agg(*sums).collect()
    pair = lambda r, o, k: np.array([complex(r[f"{o}_{k if z[i] != inputs[i] else 'x'}{i}_re"], r[f"{o}_{k if z[i] != inputs[i] else 'x'}{i}_im"]) for i in (0, 1)])
    return {(r["level"], r["band"]): {o: {"yy": r[f"{o}_yy"], "ss": r[f"{o}_ss"], "psi": r[f"{o}_psi"], "xe": pair(r, o, "x"), "ze": pair(r, o, "z")} for o in outputs} for r in got}


def _advance(s: _State, got: dict, p: RobustParams) -> None:
    """Take the sums of one pass into the state: estimate, residual variance, and the stage that comes next.

    The estimate moves by what the residuals still hold, and their sum of squares follows from that move, which is small:
    nothing cancels, however good the fit.  Only the first estimate has the data themselves as residuals; the pass after
    it ("refine") gives it a variance that is as sound.
    """
    old = s.b
    move = np.linalg.solve(s.zx, got["ze"])
    s.b = old + move
    s.yy = got["yy"]
    s.ss = max(got["ss"] - 2 * np.real(np.vdot(move, got["xe"])) + np.real(np.vdot(move, s.xx @ move)), 0.0)
    s.var = s.ss / s.n
    if s.stage == "start":
        s.stage = "refine"
        return
    if s.stage == "refine":
        s.stage = "huber" if p.max_iterations > 0 else ("redescend" if p.max_redescending else "done")
        return
    s.psi = got["psi"] / s.n
    if s.stage == "huber":
        s.var *= correction_factor(p.r0)
        s.steps += 1
        change = np.max(np.abs(1 - s.b / np.where(old == 0, np.nan, old)))
        if change <= p.tolerance or s.steps >= p.max_iterations:
            s.stage = "redescend" if p.max_redescending else "done"
    elif s.stage == "redescend":
        s.redescended += 1
        if s.redescended >= p.max_redescending:
            s.stage, s.psi = "done", 2 * s.psi - 1


def robust(obs: DataFrame, inputs: Sequence[str], outputs: Sequence[str], reference: Sequence[str] | None = None, params: RobustParams | None = None) -> DataFrame:
    """Regression M-estimate per level, band and output, with a remote reference if there are reference channels.

    Rows (level, band, output, input, re, im, n, n_iterations, r2, cov_nn, cov_ss_re, cov_ss_im) - the last two are this
    input's row of the inverse signal covariance against each input, as arrays.  Bands with fewer observations than
    inputs, or singular ones, are flagged ``underdetermined`` and have NULL estimates.  ``obs`` is read once a step, so a
    checkpoint is made of it first.
    """
    p = params or RobustParams()
    spark = obs.sparkSession
    obs = cut(obs)
    z = list(reference or inputs)
    remote = reference is not None
    gram = [F.count("*").alias("n")]
    for i in (0, 1):
        for j in (0, 1):
            gram += (C.of(inputs[i]).conj() * C.of(inputs[j])).sum().named(f"xx{i}{j}") + (C.of(z[i]).conj() * C.of(inputs[j])).sum().named(f"zx{i}{j}")
    raw = [F.sum(C.of(o).abs2()).alias(f"{o}_raw") for o in outputs]
    for o in outputs:
        for i in (0, 1):
            raw += (C.of(inputs[i]).conj() * C.of(o)).sum().named(f"{o}_rawx{i}") + (C.of(z[i]).conj() * C.of(o)).sum().named(f"{o}_rawz{i}")
    base = {(r["level"], r["band"]): r for r in obs.groupBy(*GROUP).agg(*gram, *raw).collect()}
    states: dict[tuple, dict[str, _State]] = {}
    for key, r in base.items():
        m = {k: np.array([[complex(r[f"{k}{i}{j}_re"], r[f"{k}{i}{j}_im"]) for j in (0, 1)] for i in (0, 1)]) for k in ("xx", "zx")}
        solvable = r["n"] >= 2 and all(np.isfinite(v).all() and abs(np.linalg.det(v)) > 1e-14 * np.abs(v).max() ** 2 for v in m.values())
        if solvable:
            states[key] = {o: _State(r["n"], m["xx"], m["zx"]) for o in outputs}
            for o, s in states[key].items():  # least squares on the raw data, from the sums there are
                sums = {f"{k}e": np.array([complex(r[f"{o}_raw{k}{i}_re"], r[f"{o}_raw{k}{i}_im"]) for i in (0, 1)]) for k in ("x", "z")}
                _advance(s, {"yy": r[f"{o}_raw"], "ss": r[f"{o}_raw"], "psi": r["n"], **sums}, p)
    steps, sums = _cleaning(inputs, outputs, p), _sweep_sums(inputs, z, outputs)
    while any(s.stage != "done" for per in states.values() for s in per.values()):
        live = {k: per for k, per in states.items() if any(s.stage != "done" for s in per.values())}
        for key, got in _sweep(obs, live, inputs, z, outputs, steps, sums).items():
            for o, s in live[key].items():
                if s.stage != "done":
                    _advance(s, got[o], p)
    rows = []
    for key, r in base.items():
        for o in outputs:
            s = states.get(key, {}).get(o)
            if s is None:
                rows += [(*key, o, x, None, None, r["n"], 0, None, None, None, None, True) for x in inputs]
                continue
            # residuals of the raw data under the final estimate, from sums
            quad = np.real(np.vdot(s.b, s.xx @ s.b))
            raw_xy = np.array([complex(r[f"{o}_rawx{i}_re"], r[f"{o}_rawx{i}_im"]) for i in (0, 1)])
            ssr = max(r[f"{o}_raw"] - 2 * np.real(np.vdot(s.b, raw_xy)) + quad, 0.0)
            dof = s.n - 2
            cov_nn = float(s.ss / s.psi**2 / dof) if dof > 0 and s.psi else None
            inv = np.linalg.inv(s.zx)
            cov_ss = inv @ s.xx @ inv.conj().T if remote else np.linalg.inv(s.xx)
            r2 = max(0.0, float(1 - ssr / s.yy)) if s.yy > 0 else None
            for i, x in enumerate(inputs):
                rows.append((*key, o, x, float(s.b[i].real), float(s.b[i].imag), s.n, s.steps + s.redescended, r2, cov_nn, [float(v.real) for v in cov_ss[i]], [float(v.imag) for v in cov_ss[i]], False))
    schema = "level int, band int, output string, input string, re double, im double, n long, n_iterations int, r2 double, cov_nn double, cov_ss_re array<double>, cov_ss_im array<double>, underdetermined boolean"
    return spark.createDataFrame(rows, schema)


def huber_step(obs: DataFrame, inputs: Sequence[str], output: str, p: RobustParams | None = None) -> DataFrame:
    """One Huber step from least squares, all in expressions: (level, band, input, re, im, clean_share)."""
    p = p or RobustParams()
    tf = least_squares(obs, inputs, [output])
    res = residuals(obs, tf, inputs, output)
    size = C.of("res").abs()
    sigma = res.groupBy(*GROUP).agg(F.sqrt(F.avg(C.of("res").abs2())).alias("_sigma"))
    joined = res.join(F.broadcast(sigma), list(GROUP))
    w = _weights(F.lit("huber"), size, F.col("_sigma"), p)
    fit = C.of(output) - C.of("res")
    yc = fit + C.of("res") * w
    cleaned = joined.withColumns({f"{output}_re": yc.re, f"{output}_im": yc.im, "_one": (w == 1).cast("double")})
    share = cleaned.groupBy(*GROUP).agg(F.avg("_one").alias("clean_share"))
    return least_squares(cleaned, inputs, [output]).join(share, list(GROUP)).select("level", "band", "input", "re", "im", "clean_share")


ESTIMATORS = {
    "OLS": lambda obs, x, y, r, p: least_squares(obs, x, y),
    "RME": lambda obs, x, y, r, p: robust(obs, x, y, None, p),
    "RME_RR": lambda obs, x, y, r, p: robust(obs, x, y, r, p),
}


def estimator(name: str):
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; known: {', '.join(ESTIMATORS)}")
    return ESTIMATORS[name]
