import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldspark.operators import decimate as D
from fieldspark.operators import series as S
from fieldspark.operators import spectra as SP
from fieldspark.operators import windows as WN

NAN = float("nan")


def series(spark, values, station="a", start=0):
    return spark.createDataFrame([(station, start + i, None if v is None else float(v)) for i, v in enumerate(values)], "station string, n long, v double")


@pytest.mark.parametrize("values,expect", [([1, NAN, 3, 4], [1, 8 / 3, 3, 4]), ([None, None], [0, 0]), ([1, 2], [1, 2]), ([NAN, 5], [5, 5])])
def test_nan_to_mean(spark, values, expect):
    got = [r["v"] for r in S.nan_to_mean(series(spark, values), ["station"], ["v"]).orderBy("n").collect()]
    assert got == pytest.approx(expect)


def test_densify_and_empty(spark):
    df = series(spark, [1, 2]).unionByName(series(spark, [9], start=5))
    got = S.densify(df, ["station"], ["v"], block=2).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(6)) and [r["v"] for r in got] == [1, 2, None, None, None, 9]
    assert S.densify(df.where("false"), ["station"], ["v"]).count() == 0


def test_fifteen_samples_windows_of_three_overlap_one(spark):
    w = WN.sliding_windows(series(spark, range(15)), ["station"], ["v"], WN.WindowScheme(3, 1)).orderBy("w").collect()
    assert [list(r["v"]) for r in w] == [[2 * i, 2 * i + 1, 2 * i + 2] for i in range(7)]
    assert [r["n0"] for r in w] == [0, 2, 4, 6, 8, 10, 12]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 300), st.integers(1, 40), st.integers(0, 39))
def test_window_count_formula(n, length, overlap):
    if overlap < length:
        s = WN.WindowScheme(length, overlap)
        assert s.count(n) == len([i for i in range(0, n, s.advance) if i + length <= n])


def test_short_series_has_no_window(spark):
    assert WN.sliding_windows(series(spark, range(5)), ["station"], ["v"], WN.WindowScheme(8, 2)).count() == 0
    with pytest.raises(ValueError):
        WN.WindowScheme(4, 4)


def test_blocks_do_not_show(spark):
    x = np.random.default_rng(0).normal(size=300)
    df = series(spark, x)
    got = [r["v"] for r in S.first_difference(df, ["station"], ["v"], 0.5, block=37).orderBy("n").collect()]
    assert got == pytest.approx(np.gradient(x, 0.5).tolist())
    med = [r["v"] for r in S.median_filter(df, ["station"], "v", 7, block=20).orderBy("n").collect()]
    pad = np.r_[np.zeros(3), x, np.zeros(3)]
    assert med == pytest.approx([np.median(pad[i : i + 7]) for i in range(300)])


@pytest.mark.parametrize("zero,clip", [(0.0, 0), (10.0, 2), (7.0, 3), (-1.0, 3)])
def test_clock_zero(spark, zero, clip):
    got = S.clock_zero_clip(series(spark, range(40)), ["station"], 5, 1, F.lit(zero)).agg(F.min("n")).first()[0]
    assert got == clip


def test_time_axis(spark):
    df = spark.range(5).select(F.col("id").alias("n"))
    assert [r[0] for r in df.select(S.time_axis_ns(F.col("n"), 10, 4.0)).collect()] == [10 + 250_000_000 * i for i in range(5)]
    assert [r[0] for r in df.select(S.time_axis_ns(F.col("n"), 0, 3.0)).collect()] == [0, 333333333, 666666667, 1000000000, 1333333333]


def test_alignment(spark):
    a, b = series(spark, range(10)), series(spark, range(10), start=3)
    x, y = S.overlap_trim(a, b)
    assert x.count() == y.count() == 7 and S.axes_match(x, y).first()["match"]
    assert S.axes_match(a, b).first()["unmatched"] == 6
    with pytest.raises(ValueError):
        S.merge_exact(a, b, ["n"])
    inf = spark.createDataFrame([(1.0,), (float("inf"),), (NAN,), (None,)], "v double")
    assert S.drop_incomplete(inf, ["v"]).count() == 2 and S.drop_incomplete(inf, ["v"], finite=True).count() == 1


def test_transform_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=512)
    s = WN.WindowScheme(64, 16, "hamming", (), 2.0)
    fc = SP.transform(WN.sliding_windows(series(spark, x), ["station"], ["v"], s), ["v"], s, "linear", None).orderBy("w", "k").collect()
    got = np.array([complex(r["v_re"], r["v_im"]) for r in fc]).reshape(-1, 32)
    t = np.arange(64)
    for i, row in enumerate(got):
        y = x[i * 48 : i * 48 + 64]
        y = (y - np.polyval(np.polyfit(t, y, 1), t)) * np.array(s.taper)
        assert np.allclose(row, np.fft.fft(y)[:32] * s.scale)


def test_column_detrend_matches_pass(spark):
    x = np.random.default_rng(2).normal(size=200) + np.arange(200)
    s = WN.WindowScheme(40, 10)
    w = WN.sliding_windows(series(spark, x), ["station"], ["v"], s)
    a = w.select("w", WN.detrend(F.col("v"), 40).alias("d")).orderBy("w").collect()
    for r in a:
        y = x[r["w"] * 30 : r["w"] * 30 + 40]
        assert list(r["d"]) == pytest.approx((y - np.polyval(np.polyfit(np.arange(40), y, 1), np.arange(40))).tolist(), abs=1e-9)


def test_recolor_undoes_prewhitening(spark):
    """A sine well inside a window: the central difference scales it by sin(w)/1, which recoloring divides by w."""
    k, length = 8, 256
    x = np.sin(2 * np.pi * k * np.arange(length) / length)
    s = WN.WindowScheme(length, 0)
    plain = SP.stft(series(spark, x), ["station"], ["v"], s, False).where(f"k = {k}").first()
    white = SP.stft(series(spark, x), ["station"], ["v"], s, True).where(f"k = {k}").first()
    w = 2 * np.pi * k / length
    assert complex(white["v_re"], white["v_im"]) == pytest.approx(complex(plain["v_re"], plain["v_im"]) * np.sin(w) / w, rel=2e-2)


def test_decimation_keeps_low_and_removes_high(spark):
    n = np.arange(6000)
    low, high = np.sin(2 * np.pi * n / 200), np.sin(2 * np.pi * n / 3)
    out = D.decimate(series(spark, low + high), ["station"], ["v"], 4, block=1500).orderBy("n").collect()
    assert [r["n"] for r in out] == list(range(1500))
    mid = np.array([r["v"] for r in out])[100:-100]
    assert np.abs(mid - low[::4][100:-100]).max() < 2e-2


def test_decimation_does_not_depend_on_blocks(spark):
    x = np.random.default_rng(3).normal(size=5000)
    a, b = (np.array([r["v"] for r in D.decimate(series(spark, x), ["station"], ["v"], 4, block=k).orderBy("n").collect()]) for k in (2000, 100_000))
    assert np.allclose(a, b, atol=1e-9)


def test_calibration(spark):
    fc = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, 1.0)], "k int, hx_re double, hx_im double")
    resp = spark.createDataFrame([("hx", 0, 0.0, 0.0), ("hx", 1, 0.0, 2.0)], "channel string, k int, re double, im double")
    got = {r["k"]: (r["hx_re"], r["hx_im"]) for r in SP.calibrate(fc, resp, ["hx"], {"hx": 3.0}).collect()}
    assert got[0] == (None, None) and complex(*got[1]) == pytest.approx((1 + 1j) / 2j * 3)


def test_joint_gaps(spark):
    """Values stay only where inputs, outputs and reference all have them."""
    mk = lambda c, v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], f"n long, {c} double")
    x, y, r = mk("hx", [1.0, NAN, 3.0, 4.0]), mk("ex", [1.0, 2.0, 3.0, 4.0]), mk("hx", [1.0, 2.0, None, 4.0])
    ch = {"x": ["hx"], "y": ["ex"], "r": ["hx"]}
    out = S.joint_incomplete(x, y, r, ["n"], ch)
    assert [[v[1] for v in d.orderBy("n").collect()] for d in out] == [[1.0, 4.0]] * 3
    a, b, none = S.joint_incomplete(x, y, None, ["n"], ch)
    assert a.count() == b.count() == 3 and none is None


def test_merge_by_position(spark):
    a, b = series(spark, [10, 20, 30]), series(spark, [1, 2, 3], start=100_000).withColumnRenamed("v", "u")
    got = S.merge_by_position(a, b, ["station"]).orderBy("n").collect()
    assert [(r["n"], r["v"], r["u"]) for r in got] == [(0, 10, 1), (1, 20, 2), (2, 30, 3)]
    wide = S.numbered(series(spark, range(50)), ["station"], block=7).orderBy("n").collect()
    assert [r["_i"] for r in wide] == list(range(50))
