"""Operators on regularly sampled series.

A series is keyed (for instance station, run, channel) and indexed by the sample
number ``n``; index arithmetic, not time stamps, aligns samples.  Neighbourhood
operators cut series into blocks of samples with a halo, so that one long series is
many small groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 65_536


def null_if_nan(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def with_halo(df: DataFrame, block: int, before: int, after: int, n: str = "n") -> DataFrame:
    """Each sample in its block and, where it is near an edge, in the neighbour: columns ``block`` and ``core``."""
    if max(before, after) > block:
        raise ValueError("a halo does not reach beyond the neighbouring block")
    own = F.floor(F.col(n) / block).cast("long")
    at = F.pmod(F.col(n), F.lit(block))
    blocks = F.array_compact(F.array(own, F.when(at < after, own - 1), F.when(at >= block - before, own + 1)))
    return df.withColumn("block", F.explode(blocks)).withColumn("core", F.floor(F.col(n) / block).cast("long") == F.col("block"))


def extent(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("n").alias("n_first"), F.max("n").alias("n_last"))


def densify(df: DataFrame, keys: Sequence[str], values: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Every sample number between a series' first and last, with NULL where there was none."""
    span = extent(df, keys)
    lo, hi = F.floor(F.col("n_first") / block).cast("long"), F.floor(F.col("n_last") / block).cast("long")
    blocks = span.withColumn("b", F.explode(F.sequence(lo, hi))).repartition(*keys, "b")
    axis = blocks.select(*keys, F.explode(F.sequence(F.greatest("n_first", F.col("b") * block), F.least("n_last", (F.col("b") + 1) * block - 1))).alias("n"))
    return axis.join(df.select(*keys, "n", *values), [*keys, "n"], "left")


def nan_to_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """NULL and NaN become the series' mean; a series without any value becomes zero."""
    clean = df.select("*", *[null_if_nan(F.col(v)).alias(f"_{v}") for v in values])
    means = clean.groupBy(*keys).agg(*[F.avg(f"_{v}").alias(f"_m_{v}") for v in values])
    joined = clean.join(means, list(keys))
    return joined.select(*[F.coalesce(f"_{c}", f"_m_{c}", F.lit(0.0)).alias(c) if c in values else F.col(c) for c in df.columns])


def all_zero_runs(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    total = sum((F.sum(F.abs(F.coalesce(F.col(v), F.lit(0.0)))) for v in values[1:]), F.sum(F.abs(F.coalesce(F.col(values[0]), F.lit(0.0)))))
    return df.groupBy(*keys).agg(total.alias("total")).where("total = 0").select(*keys)


def drop_runs(df: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(runs, list(keys), "left_anti")


def keep_runs(df: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(runs, list(keys), "left_semi")


def slice_run(df: DataFrame, first: int, last: int) -> DataFrame:
    """Both ends belong to the slice."""
    return df.where(F.col("n").between(first, last))


def clock_zero_clip(df: DataFrame, keys: Sequence[str], length: int, overlap: int, clock_zero: Column | float, dt: float = 1.0) -> DataFrame:
    """Drops the samples before the first window start of the grid that ``clock_zero`` (seconds) anchors.

    The number dropped is the fractional part of the steps between a series' first sample and clock zero, in samples,
    halves rounded to even.
    """
    advance = length - overlap
    steps = (clock_zero - F.col("n_first") * dt) / (advance * dt)
    clip = F.bround((steps - F.floor(steps)) * advance).cast("long")
    span = extent(df, keys).withColumn("n_clip", clip)
    return df.join(span.select(*keys, (F.col("n_first") + F.col("n_clip")).alias("_from")), list(keys)).where("n >= _from").drop("_from")


def data_start(df: DataFrame, dt: float = 1.0) -> float:
    """Clock zero of the kind "data start": the least sample time over all series."""
    row = df.agg(F.min("n").alias("n")).first()
    return 0.0 if row["n"] is None else row["n"] * dt


def rename_channels(df: DataFrame, names: dict[str, str], column: str = "channel") -> DataFrame:
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    return df.withColumn(column, F.coalesce(F.try_element_at(mapping, F.col(column)), F.col(column))) if mapping is not None else df


def scale_channels(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Wide series: values of each channel times its factor, 1 where there is none."""
    return df.select(*[(F.col(c) * factors[c]).alias(c) if c in factors else F.col(c) for c in df.columns])


def time_axis_ns(n: Column, t0_ns: Column | int, fs: float, method: str | None = None) -> Column:
    """Time of sample ``n`` in nanoseconds.

    "grid" steps by a whole number of nanoseconds, "rounded" rounds each sample; without a method the grid is used where
    the sample interval is a whole number of nanoseconds.
    """
    dt = 1e9 / fs
    method = method or ("grid" if dt == int(dt) else "rounded")
    t0 = t0_ns if isinstance(t0_ns, Column) else F.lit(int(t0_ns))
    if method == "grid":
        return t0 + n * F.lit(int(dt)).cast("long")
    if method == "rounded":
        return t0 + F.bround(n.cast("double") * 1e9 / fs).cast("long")
    raise ValueError("the method is 'grid' or 'rounded'")


def first_difference(df: DataFrame, keys: Sequence[str], values: Sequence[str], dt: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Prewhitening: the derivative by central differences, one-sided at a series' ends."""
    w = W.partitionBy(*keys, "block").orderBy("n")
    halo = with_halo(df, block, 1, 1)

    def slope(v: str) -> Column:
        back, here, on = F.lag(v).over(w), F.col(v), F.lead(v).over(w)
        has_back, has_on = F.lag("n").over(w) == F.col("n") - 1, F.lead("n").over(w) == F.col("n") + 1
        both = F.coalesce(has_back, F.lit(False)) & F.coalesce(has_on, F.lit(False))
        one = F.when(F.coalesce(has_on, F.lit(False)), (on - here) / dt).when(F.coalesce(has_back, F.lit(False)), (here - back) / dt)
        return F.when(both, (on - back) / (2 * dt)).otherwise(one)

    out = halo.select(*[slope(c).alias(c) if c in values else F.col(c) for c in df.columns], "core")
    return out.where("core").drop("core")


def median_filter(df: DataFrame, keys: Sequence[str], value: str, width: int, order: str = "n", block: int = BLOCK) -> DataFrame:
    """Running median of odd width; beyond the ends the series counts as zero."""
    if width % 2 == 0:
        raise ValueError("the width of a median filter is odd")
    half = width // 2
    w = W.partitionBy(*keys, "block").orderBy(order).rowsBetween(-half, half)
    halo = with_halo(df, block, half, half, order)
    filled = halo.withColumn("_in", F.collect_list(F.coalesce(F.col(value), F.lit(0.0))).over(w))
    padded = F.concat("_in", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("_in")))
    return filled.withColumn(value, F.element_at(F.array_sort(padded), half + 1)).where("core").select(*df.columns)


def band_median(spectrum: DataFrame, keys: Sequence[str], value: str, width: int, f_lo: float, f_hi: float, frequency: str = "f", order: str = "k") -> DataFrame:
    """(keys, median): the median of a spectrum's amplitudes, smoothed by a running median, strictly between two frequencies.

    With two calibrations of one spectrum the ratio of their medians in a band of known strength (7.6 to 8 Hz) checks one
    against the other.
    """
    smooth = median_filter(spectrum, keys, value, width, order)
    return smooth.where((F.col(frequency) > f_lo) & (F.col(frequency) < f_hi)).groupBy(*keys).agg(F.median(value).alias("median"))


def overlap_trim(a: DataFrame, b: DataFrame, on: str = "n") -> tuple[DataFrame, DataFrame]:
    """Both tables restricted to the range that both cover."""
    span = lambda d: d.agg(F.min(on).alias("lo"), F.max(on).alias("hi"))
    both = span(a).unionAll(span(b)).agg(F.max("lo").alias("_lo"), F.min("hi").alias("_hi"))
    cut = lambda d: d.join(F.broadcast(both), F.col(on).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    return cut(a), cut(b)


def axes_match(a: DataFrame, b: DataFrame, on: Sequence[str] = ("n",)) -> DataFrame:
    """One row: how many positions only one of the tables has, and whether there is none."""
    left, right = a.select(*on).distinct().withColumn("_a", F.lit(1)), b.select(*on).distinct().withColumn("_b", F.lit(1))
    return left.join(right, list(on), "full").agg(F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("unmatched")).withColumn("match", F.col("unmatched") == 0)


def check_axes(a: DataFrame, b: DataFrame, on: Sequence[str] = ("n",)) -> None:
    if not axes_match(a, b, on).first()["match"]:
        raise ValueError("time axes do not match")


def merge_exact(x: DataFrame, y: DataFrame, on: Sequence[str], how: str = "exact") -> DataFrame:
    """Joins two tables that must cover the same positions; ``how="left"`` keeps what only the first has."""
    if how == "exact":
        check_axes(x, y, on)
        return x.join(y, list(on))
    if how == "left":
        return x.join(y, list(on), "left")
    raise ValueError("how is 'exact' or 'left'")


def merge_by_position(x: DataFrame, y: DataFrame, keys: Sequence[str], order: str = "n") -> DataFrame:
    """Pairs the i-th row of each series of ``x`` with the i-th of ``y``, whatever their ``order`` values.

    For series whose axes differ by a shift; the axis of ``x`` is kept.  Numbers within a series come from a window per
    block of the axis plus the counts of earlier blocks, so no series is one task.
    """
    return numbered(x, keys, order).join(numbered(y, keys, order).drop(order), [*keys, "_i"]).drop("_i")


def numbered(df: DataFrame, keys: Sequence[str], order: str = "n", block: int = BLOCK) -> DataFrame:
    """Rows with ``_i``, their place in their series from 0."""
    blocked = df.withColumn("_b", F.floor(F.col(order) / block).cast("long"))
    counts = blocked.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = blocked.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(order)) - 1)
    return inside.join(before.drop("_c"), [*keys, "_b"]).withColumn("_i", F.col("_before") + F.col("_r")).drop("_b", "_r", "_before")


def joint_incomplete(x: DataFrame, y: DataFrame, r: DataFrame | None, on: Sequence[str], channels: dict[str, Sequence[str]]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Inputs, outputs and reference at the positions where all of them have values on all channels (infinities stay).

    Reference columns get the prefix ``remote_`` for the join and lose it again; without a reference there is none back.
    """
    both = merge_exact(x.select(*on, *channels["x"]), y.select(*on, *channels["y"]), on)
    names = [*channels["x"], *channels["y"]]
    if r is not None:
        remote = r.select(*on, *[F.col(c).alias(f"remote_{c}") for c in channels["r"]])
        both, names = both.join(remote, list(on)), [*names, *[f"remote_{c}" for c in channels["r"]]]
    kept = drop_incomplete(both, names)
    back = None if r is None else kept.select(*on, *[F.col(f"remote_{c}").alias(c) for c in channels["r"]])
    return kept.select(*on, *channels["x"]), kept.select(*on, *channels["y"]), back


def drop_incomplete(df: DataFrame, columns: Sequence[str], finite: bool = False) -> DataFrame:
    """Rows whose columns are all there; ``finite`` also drops infinities."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
        if finite:
            ok = ok & (F.abs(c) < float("inf"))
    return df.where(ok)


def align_streams(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shifts every series to begin at sample 0."""
    return df.join(extent(df, keys).select(*keys, "n_first"), list(keys)).withColumn("n", F.col("n") - F.col("n_first")).drop("n_first")


def trim_to_common(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples at numbers that all series cover."""
    common = extent(df, keys).agg(F.max("n_first").alias("_lo"), F.min("n_last").alias("_hi"))
    return df.join(F.broadcast(common), F.col("n").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def decimate_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str], factor: int) -> DataFrame:
    """Coarsening: the mean of each ``factor`` samples; the last group may be shorter."""
    return df.groupBy(*keys, F.floor(F.col("n") / factor).cast("long").alias("n")).agg(*[F.avg(v).alias(v) for v in values])
