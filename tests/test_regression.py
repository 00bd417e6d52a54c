import numpy as np
import pytest

from fieldspark.operators import bands as B
from fieldspark.operators import crosspower as X
from fieldspark.operators import regression as R


def obs_frame(spark, cols: dict[str, np.ndarray], level=0, band=0):
    names = [f"{c}_{p}" for c in cols for p in ("re", "im")]
    n = len(next(iter(cols.values())))
    rows = [(level, band, i, *[float(v) for z in cols.values() for v in (z[i].real, z[i].imag)]) for i in range(n)]
    return spark.createDataFrame(rows, "level int, band int, i int, " + ", ".join(f"{x} double" for x in names))


def noise(rng, n):
    return rng.normal(size=n) + 1j * rng.normal(size=n)


def problem(n=200, seed=0, noise_level=0.0):
    rng = np.random.default_rng(seed)
    x = {"hx": noise(rng, n), "hy": noise(rng, n)}
    b = np.array([1.5 + 0.5j, -0.8 + 1.2j])
    y = b[0] * x["hx"] + b[1] * x["hy"] + noise_level * noise(rng, n)
    return {**x, "ex": y}, b, rng


def estimate(df, output="ex"):
    rows = {r["input"]: complex(r["re"], r["im"]) for r in df.where(f"output = '{output}'").collect()}
    return np.array([rows["hx"], rows["hy"]])


def test_exact_recovery(spark):
    cols, b, _ = problem(20)
    obs = obs_frame(spark, cols)
    assert np.allclose(estimate(R.least_squares(obs, ["hx", "hy"], ["ex"])), b)
    assert np.allclose(estimate(R.robust(obs, ["hx", "hy"], ["ex"])), b)
    assert np.allclose(estimate(X.tf_from_cross_powers(obs, ["level", "band"], outputs=["ex"])), b)


def test_single_observation_is_underdetermined(spark):
    cols, _, _ = problem(1)
    got = R.robust(obs_frame(spark, cols), ["hx", "hy"], ["ex"]).collect()
    assert all(r["underdetermined"] and r["re"] is None for r in got)
    assert all(r["re"] is None for r in R.least_squares(obs_frame(spark, cols), ["hx", "hy"], ["ex"]).collect())


def _by_qr(cols, r0=1.5, u0=2.8, tol=0.005, most=10, fall=2, z=None):
    """The estimator over an orthogonal decomposition, one band, in memory."""
    x = np.stack([cols["hx"], cols["hy"]], 1)
    z = x if z is None else z
    y = cols["ex"]
    n = len(y)
    remote = z is not x
    q = np.linalg.qr(z)[0]

    def solve(yc):
        return np.linalg.solve(q.conj().T @ x, q.conj().T @ yc)

    def variance(yc, b):
        if remote:
            return np.mean(np.abs(yc - x @ b) ** 2)
        return (np.linalg.norm(yc) ** 2 - np.linalg.norm(q.conj().T @ yc) ** 2) / n

    b = solve(y)
    var = variance(y, b)
    for _ in range(most):
        res = np.abs(y - x @ b)
        w = np.minimum(r0 * np.sqrt(var) / res, 1)
        yc = w * y + (1 - w) * (x @ b)
        old, b = b, solve(yc)
        var = variance(yc, b) / (1 - np.exp(-r0))
        if np.max(np.abs(1 - b / old)) <= tol:
            break
    for _ in range(fall):
        r = np.abs(y - x @ b) / np.sqrt(var)
        w = np.exp(-np.exp(u0 * (r - u0)))
        yc = w * y + (1 - w) * (x @ b)
        b = solve(yc)
        var = variance(yc, b)
    return b


@pytest.mark.parametrize("remote", [False, True])
def test_aggregates_equal_orthogonal_decomposition(spark, remote):
    cols, _, rng = problem(300, 3, 0.3)
    hit = rng.integers(0, 300, 20)
    cols["ex"][hit] += 30 * noise(rng, 20)
    z = None
    if remote:
        cols |= {"r_hx": cols["hx"] + 0.2 * noise(rng, 300), "r_hy": cols["hy"] + 0.2 * noise(rng, 300)}
        z = np.stack([cols["r_hx"], cols["r_hy"]], 1)
    got = estimate(R.robust(obs_frame(spark, cols), ["hx", "hy"], ["ex"], ["r_hx", "r_hy"] if remote else None))
    assert np.allclose(got, _by_qr(cols, z=z), atol=1e-9)


def test_robust_resists_outliers(spark):
    cols, b, rng = problem(400, 5, 0.05)
    hit = rng.integers(0, 400, 40)
    cols["ex"][hit] += 50 * noise(rng, 40)
    obs = obs_frame(spark, cols)
    plain, robust = estimate(R.least_squares(obs, ["hx", "hy"], ["ex"])), estimate(R.robust(obs, ["hx", "hy"], ["ex"]))
    assert np.abs(robust - b).max() < 0.05 < np.abs(plain - b).max()


def test_remote_reference_has_no_bias_from_input_noise(spark):
    rng = np.random.default_rng(7)
    n = 6000
    h = [noise(rng, n), noise(rng, n)]
    b = np.array([2.0, -1 + 0.5j])
    cols = {"hx": h[0] + 0.7 * noise(rng, n), "hy": h[1] + 0.7 * noise(rng, n), "ex": b[0] * h[0] + b[1] * h[1], "r_hx": h[0] + 0.7 * noise(rng, n), "r_hy": h[1] + 0.7 * noise(rng, n)}
    obs = obs_frame(spark, cols)
    single, remote = estimate(R.least_squares(obs, ["hx", "hy"], ["ex"])), estimate(R.least_squares(obs, ["hx", "hy"], ["ex"], ["r_hx", "r_hy"]))
    assert np.abs(remote - b).max() < 0.1 < np.abs(single - b).max()


def test_leverage_weights(spark):
    cols, _, _ = problem(400, 9)
    cols["hx"][0] *= 1000
    w = {r["i"]: r["weight"] for r in R.leverage_weights(obs_frame(spark, cols), ["hx", "hy"]).collect()}
    assert w[0] == 0 and min(v for i, v in w.items() if i) > 0.9
    assert B.apply_weights(R.leverage_weights(obs_frame(spark, cols), ["hx", "hy"]), ["hx", "hy", "ex"]).count() == 399


def test_cross_power_matrix_is_hermitian(spark):
    cols, _, _ = problem(50, 11, 1.0)
    m = {(r["a"], r["b"]): complex(r["re"], r["im"]) for r in X.cross_power_matrix(obs_frame(spark, cols), ["band"], ["hx", "hy", "ex"], station="s").collect()}
    assert len(m) == 9
    for a, b in m:
        assert m[a, b] == pytest.approx(m[b, a].conjugate())
    assert m["s_hx", "s_ex"] == pytest.approx(np.mean(cols["hx"] * cols["ex"].conj()))


def test_unknown_estimator():
    with pytest.raises(ValueError):
        R.estimator("nothing")


def test_a_nearly_perfect_fit_keeps_its_variance(spark):
    """Residuals of a billionth of the data: sums of squares of the data could not tell them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 400)) + 1j * rng.normal(size=(2, 400))
    noise = 1e-9 * (rng.normal(size=400) + 1j * rng.normal(size=400))
    noise[::50] *= 100
    y = (2 - 1j) * x[0] + (0.5 + 3j) * x[1] + noise
    rows = [(0, 0, *[float(p) for v in (x[0][i], x[1][i], y[i]) for p in (v.real, v.imag)]) for i in range(400)]
    obs = spark.createDataFrame(rows, "level int, band int, " + ", ".join(f"{c}_{p} double" for c in ("hx", "hy", "ex") for p in ("re", "im")))
    got = {r["input"]: r for r in R.robust(obs, ["hx", "hy"], ["ex"]).collect()}
    assert abs(complex(got["hx"]["re"], got["hx"]["im"]) - (2 - 1j)) < 1e-9
    assert 0.5e-18 < got["hx"]["cov_nn"] < 2e-17 and got["hx"]["n_iterations"] >= 3
