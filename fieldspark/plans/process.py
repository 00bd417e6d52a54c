"""The whole chain: series and configuration to transfer functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.bands import apply_weights, assign_bands, complete_observations
from fieldspark.operators.decimate import decimate_levels
from fieldspark.operators.features import CoherenceFeature, feature_weight_table
from fieldspark.operators.lineage import cut
from fieldspark.operators.regression import estimator, leverage_weights
from fieldspark.operators.series import check_axes, clock_zero_clip, data_start, densify, extent, nan_to_mean
from fieldspark.operators.spectra import align_local_remote, calibrate, stft
from fieldspark.operators.transfer import resistivity_phase, standard_errors, with_periods
from fieldspark.operators.windows import window_count, window_edges
from fieldspark.plans.config import Processing
from fieldspark.plans.planning import saves_coefficients
from fieldspark.sources import zfile
from fieldspark.sources.spectra_store import load_coefficients, save_coefficients, stored_runs


@dataclass
class Plan:
    """What ``observations`` found out: levels, whether all coefficients were stored or some were saved, weights made of features."""

    config: Processing
    levels: list[int]
    skipped: list[int]
    stored: bool = False
    saved: bool = False
    weights: DataFrame | None = None


@dataclass(frozen=True)
class CoefficientStore:
    """Where coefficients are kept, whether new ones are saved, and a name for the responses they are calibrated with."""

    path: str
    save: bool = True
    responses: str | None = None


def spectrogram(series: DataFrame, config: Processing, level: int, station: str, responses: DataFrame | None = None) -> DataFrame:
    """Calibrated coefficients of a station's (already decimated) series at a level; only harmonics that bands need."""
    lv = config.levels[level]
    s = lv.scheme(config.rate(level))
    own = series.where(F.col("station") == station)
    channels = [c for c in series.columns if c not in ("station", "run", "n")]
    keys = [c for c in ("station", "run") if c in series.columns]
    if lv.clock_zero_type != "ignore":
        zero = data_start(series, s.dt) if lv.clock_zero_type == "data start" else lv.clock_zero
        own = clock_zero_clip(own, keys, lv.length, lv.overlap, F.lit(float(zero)), s.dt)
    ks = [b for b in config.bands if b[0] == sorted({x[0] for x in config.bands})[level]]
    fcs = stft(own, keys, channels, s, lv.prewhiten, lv.detrend, min(b[1] for b in ks), max(b[2] for b in ks))
    if responses is not None:
        fcs = calibrate(fcs, responses, channels, config.scale, {"hy": "hx"})
    elif config.scale:
        fcs = fcs.withColumns({f"{c}_{p}": F.col(f"{c}_{p}") * f for c, f in config.scale.items() if c in channels for p in ("re", "im")})
    return fcs.withColumn("level", F.lit(level))


def recipe(config: Processing, channels: Sequence[str], responses: str | None = None) -> dict:
    """What coefficients depend on: not on station, remote, bands beyond the harmonics they need, or estimators."""
    ks = {v.level: [b for b in config.bands if b[0] == sorted({x[0] for x in config.bands})[v.level]] for v in config.levels}
    levels = [(v.level, v.factor, v.length, v.overlap, v.family, list(v.args), v.clock_zero_type, v.clock_zero, v.prewhiten, v.recolor, v.detrend, min(b[1] for b in ks[v.level]), max(b[2] for b in ks[v.level])) for v in config.levels]
    return {"fs": config.fs, "levels": levels, "decimation": config.decimation, "scale": config.scale, "channels": list(channels), "responses": responses}


def needed_levels(series: DataFrame, config: Processing, keys: Sequence[str]) -> DataFrame:
    """(keys, level, windows) of every run and level that has a window."""
    spans = extent(series, keys).withColumn("_n", F.col("n_last") - F.col("n_first") + 1)
    levels = F.broadcast(config.level_table(series.sparkSession))
    each = spans.join(levels, F.col("level") >= 0)  # a handful of levels
    count = window_count(F.floor(F.col("_n") / F.col("total_factor")), F.col("length"), F.col("advance"))
    return each.select(*keys, "level", count.alias("windows")).where("windows > 0")


def observations(series: DataFrame, config: Processing, responses: DataFrame | None = None, store: CoefficientStore | None = None, features: Sequence[CoherenceFeature] = ()) -> tuple[DataFrame | None, Plan]:
    """Band observations of all levels, one below the other, with reference channels ``r_<channel>`` if there is a remote.

    Runs of a station may be several; windows never cross runs.  A level whose runs are too short for one window (or for
    ``min_windows``) is left out.  Runs all of whose levels are in the ``store`` are read from there and their samples are
    not touched; the coefficients of others are saved to it where ``saves_coefficients`` allows.  Every decimated level is
    a checkpoint, so that none is filtered twice.
    """
    spark = series.sparkSession
    channels = [c for c in series.columns if c not in ("station", "run", "n")]
    keys = [c for c in ("station", "run") if c in series.columns]
    wanted = [s for s in (config.station, config.remote) if s]
    own = series.where(F.col("station").isin(*wanted, *[s for f in features for s in (f.station_1, f.station_2)]))
    used = own.where(F.col("station").isin(wanted))
    need = needed_levels(used, config, keys)
    windows = {r["level"]: r["w"] for r in need.where(F.col("station") == config.station).groupBy("level").agg(F.sum("windows").alias("w")).collect()}
    done = [v.level for v in config.levels if windows.get(v.level, 0) >= max(1, v.min_windows)]
    plan = Plan(config, done, [v.level for v in config.levels if v.level not in done])
    if not done:
        return None, plan

    kept, fresh = None, own
    if store is not None:
        made = recipe(config, channels, store.responses)

        def load() -> DataFrame:
            got = load_coefficients(spark, store.path, made)
            # partition values come back as whatever they look like
            return got.select(*[F.col(k).cast(series.schema[k].dataType).alias(k) if k in keys else F.col(k) for k in got.columns])

        runs = cut(stored_runs(spark, store.path, made, need.select(*keys, "level")))
        missing = runs.where("not fc").limit(1).count() > 0
        plan.stored = not missing
        plan.saved = saves_coefficients(plan.stored, bool(config.remote), store.save)
        if runs.where("fc").limit(1).count():
            kept = load().join(F.broadcast(runs.where("fc").select(*keys)), keys)
        if not features:
            fresh = own.join(F.broadcast(runs.where("fc").select(*keys)), keys, "left_anti") if missing else None
    bands = config.band_table(spark)
    levels = _levels(fresh, config, keys, channels, max(done)) if fresh is not None else {}
    if plan.saved:
        for level in done:
            part = spectrogram(levels[level], config, level, config.station, responses)
            save_coefficients(part if kept is None else part.join(runs.where("fc").select(*keys), keys, "left_anti"), store.path, made)
        kept = load().join(F.broadcast(need.select(*keys).distinct()), keys)

    def coefficients(level: int, station: str) -> DataFrame:
        stored = kept is not None and (plan.saved or plan.stored)
        at = kept.where((F.col("station") == station) & (F.col("level") == level)) if kept is not None else None
        if stored:
            return at
        new = spectrogram(levels[level], config, level, station, responses)
        return new if at is None else new.join(runs.where("fc").select(*keys), keys, "left_anti").unionByName(at.select(*new.columns))

    out, weights = None, None
    for level in done:
        local = coefficients(level, config.station)
        if config.remote:
            local = align_local_remote(local, coefficients(level, config.remote), config.reference, ("n0", "k"))
        part = assign_bands(local, bands)
        out = part if out is None else out.unionByName(part)
        if features:
            lv = config.levels[level]
            made_of = feature_weight_table(nan_to_mean(levels[level], keys, channels), features, lv.scheme(config.rate(level))).withColumn("level", F.lit(level))
            weights = made_of if weights is None else weights.unionByName(made_of)
    plan.weights = weights
    need_channels = [*config.inputs, *config.outputs, *([f"r_{c}" for c in config.reference] if config.remote else [])]
    return complete_observations(out, need_channels), plan


def _levels(series: DataFrame, config: Processing, keys: Sequence[str], channels: Sequence[str], top: int) -> dict[int, DataFrame]:
    """The series at every level up to ``top``, each a checkpoint that the next is made from."""
    at = cut(densify(series, keys, channels))
    out = {}
    for v in config.levels[: top + 1]:
        at = at if v.factor == 1 else cut(next(decimate_levels(at, keys, channels, [v.factor], config.decimation)))
        out[v.level] = at
    return out


def check_windows(series: DataFrame, config: Processing) -> None:
    """Raises where local and remote windows do not begin at the same samples; by the runs' extents, without any coefficient."""
    if not config.remote:
        return
    keys = [c for c in ("station", "run") if c in series.columns]
    at = series.where(F.col("station").isin(config.station, config.remote))
    edges = window_edges(at, keys, config.levels[0].scheme(config.fs))
    check_axes(edges.where(F.col("station") == config.station), edges.where(F.col("station") == config.remote), ("n0",))


def process(
    series: DataFrame, config: Processing, responses: DataFrame | None = None, weights: DataFrame | None = None,
    store: CoefficientStore | None = None, features: Sequence[CoherenceFeature] = (), same_axes: bool = False,
) -> DataFrame:
    """Transfer functions per level, band, output and input, with periods, errors, rho and phi.

    ``series`` is (station[, run], n, <channels>).  ``weights(level, n0, weight)``, if given, multiply observations, and so
    do the weights made of ``features``.  A ``store`` keeps coefficients between calls.  ``same_axes`` demands that local
    and remote windows begin at the same samples; otherwise those that do are used.  Observations are a checkpoint, which
    the robust estimators read once a step.
    """
    config = config.with_engine_for(bool(config.remote))
    if same_axes:
        check_windows(series, config)
    obs, plan = observations(series, config, responses, store, features)
    if obs is None:
        raise ValueError("no level has enough windows")
    reference = [f"r_{c}" for c in config.reference] if config.remote else None
    channels = [*config.inputs, *config.outputs, *(reference or [])]
    used = cut(obs.select("level", "band", "n0", "k", *[f"{c}_{p}" for c in channels for p in ("re", "im")]))
    if config.leverage and config.engine != "OLS":
        used = apply_weights(leverage_weights(used, config.inputs, reference), channels)
    for table in (weights, plan.weights):
        if table is not None:
            used = apply_weights(used.drop("weight").join(table.select("level", "n0", "weight"), ["level", "n0"]), channels)
    tf = estimator(config.engine)(used, list(config.inputs), list(config.outputs), reference, config.robust)
    tf = with_periods(tf, config.band_table(series.sparkSession))
    if "cov_nn" in tf.columns:
        tf = standard_errors(tf, config.inputs)
    electric = resistivity_phase(tf)
    rest = tf.where(F.col("output") == "hz")
    out = electric.unionByName(rest, allowMissingColumns=True)
    # as many rows as bands, outputs and inputs: fixed by the configuration
    rows = out.collect()
    return series.sparkSession.createDataFrame(rows, out.schema)


def export(tf: DataFrame, config: Processing, path: str, kind: str | None = None) -> str:
    """Writes the transfer functions of ``process`` as z-file, EDI or XML (by ``kind`` or the path's ending); gives the text.

    Periods ascend; decimation levels count from 1 and carry their bands, number of points and sample rate.
    """
    spark = tf.sparkSession
    kind = kind or path.rsplit(".", 1)[-1].lower()
    bands = {(r["level"], r["band"]): r.asDict() | {"fs": config.rate(r["level"])} for r in config.band_table(spark).collect()}
    outputs = [o for o in ("hz", "ex", "ey") if o in config.outputs]
    title = "Robust Remote Reference" if config.engine == "RME_RR" else "Robust Single station"
    z = zfile.from_estimates(tf.collect(), bands, config.station, list(config.inputs), outputs, title)
    writers = {"edi": zfile.format_edi, "xml": zfile.format_xml}
    text = writers.get(kind, zfile.format_zfile)(z)
    zfile.write_text(spark, text, path)
    return text
