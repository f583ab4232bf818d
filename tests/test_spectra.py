"""Spectra: aligned by place, refused on other grids; correlations and densities of long trajectories by blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halyard.operators import spectra as S
from halyard.plans.template import bind

BANDS, SPAN = [(0.0, 2.0), (2.0, 4.5)], (0.0, 5.0)


def spectrum(spark, **ys):
    """Spectra on 0, 0.5, ..., 5 whose values are given by name; a pair gives a grid of its own."""
    rows = []
    for k, y in enumerate(ys.values()):
        f, y = y if isinstance(y, tuple) else (np.arange(11) / 2, y)
        rows += [(k, float(a), float(b)) for a, b in zip(f, y)]
    return spark.createDataFrame(rows, "label int, f double, y double")


def test_shifted_and_shorter_grids_are_not_shared(spark):
    y, f = np.arange(11) + 1.0, np.arange(11) / 2
    table = spectrum(spark, a=y, b=y * 2, shifted=(f + 0.25, y), shorter=(f[:-1], y[:-1]), close=(f + 1e-8, y), moved=(np.r_[f[:5], f[5] + 0.1, f[6:]], y))
    found = {r["label"]: (r["shared"], r["n_points"], r["grid_difference"]) for r in S.shared_grid(table, reference_label=0).collect()}
    assert [found[k][0] for k in range(6)] == [True, True, False, False, True, False]
    assert found[2][2] == pytest.approx(0.25) and found[3][1] == 10
    # nothing is compared point by point where one grid differs
    assert S.compare(table, BANDS, SPAN, reference_label=0).count() == 0
    assert S.compare(table.filter("label < 2"), BANDS, SPAN, reference_label=0).count() == 2


def test_report_and_comparison(spark):
    f = np.arange(11) / 2
    ys = [np.sin(f) + 2, np.cos(f) + 3]
    table = spectrum(spark, a=ys[0], b=ys[1], negative=np.where(f == 1, -0.5, 1.0))

    def area(y, low, high, by=None):
        inside = (f >= low) & (f <= high)
        return np.trapezoid((y * by if by is not None else y)[inside], f[inside])

    report = {r["label"]: r for r in S.described(table, SPAN).collect()}
    for k in (0, 1):
        assert report[k]["range_integral"] == pytest.approx(area(ys[k], 0, 5)) and report[k]["centroid"] == pytest.approx(area(ys[k], 0, 5, f) / area(ys[k], 0, 5))
        assert (report[k]["n_points"], report[k]["f_least"], report[k]["f_most"], report[k]["resolution"]) == (11, 0.0, 5.0, 0.5)
    assert report[2]["n_negative"] == 1 and report[2]["centroid"] is None
    bands = {(r["label"], r["low"]): r for r in S.band_rows(table, [*BANDS, (0.1, 0.6), (7.0, 9.0)], SPAN).collect()}
    assert len(bands) == 12 and bands[0, 2.0]["integral"] == pytest.approx(area(ys[0], 2, 4.5)) and bands[1, 0.0]["fraction"] == pytest.approx(area(ys[1], 0, 2) / area(ys[1], 0, 5))
    # one point, or none, makes no integral
    assert bands[0, 0.1]["integral"] is None and bands[0, 7.0]["integral"] is None
    deltas = {r["low"]: r for r in S.compare(table.filter("label < 2"), BANDS, SPAN, reference_label=0).collect()}
    for low, high in BANDS:
        a, b = (area(y, low, high) for y in ys)
        assert deltas[low]["ratio_of_integral"] == pytest.approx(b / a)
        assert deltas[low]["delta_fraction"] == pytest.approx(b / area(ys[1], 0, 5) - a / area(ys[0], 0, 5))
    assert deltas[0.0]["ratio_range_integral"] == pytest.approx(area(ys[1], 0, 5) / area(ys[0], 0, 5))


# trajectories ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def walk():
    rnd = np.random.default_rng(3)
    return np.cumsum(rnd.normal(0, 0.05, (60, 4, 3)), 0) % 1.0


def table_of(spark, x, drop=()):
    rows = [(f + 1, a, *map(float, x[f, a])) for f in range(len(x)) for a in range(x.shape[1]) if (f, a) not in drop]
    return spark.createDataFrame(rows, "frame int, atom int, x double, y double, z double").repartition(3)


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_velocities_equal_window_form(spark, walk, width):
    traj = table_of(spark, walk)
    key = ["frame", "atom"]
    found, wanted = (d.toPandas().sort_values(key).reset_index(drop=True) for d in (S.velocities(traj, width=width), bind(S.VELOCITIES, traj=traj)))
    pd.testing.assert_frame_equal(found[wanted.columns], wanted)
    cells = spark.createDataFrame([(f, [2.0, 0.0, 0.0, 0.0, 3.0, 1.0, 0.0, 0.0, 4.0]) for f in range(1, 61)], "frame int, cell array<double>")
    turned = S.velocities(traj, width=width, cells=cells, dt=0.5).toPandas().sort_values(key).reset_index(drop=True)
    assert np.allclose(turned[["vx", "vy", "vz"]], wanted[["vx", "vy", "vz"]].to_numpy() @ np.array([[2, 0, 0], [0, 3, 1], [0, 0, 4]]) / 0.5)


@pytest.mark.parametrize("width", [3, 16, 59, None])
@pytest.mark.parametrize("max_lag", [1, 9, 80])
def test_blocks_equal_the_double_loop(spark, walk, width, max_lag):
    masses = [1.0, 2.0, 5.0, 1.5]
    atoms = spark.createDataFrame(list(enumerate(masses)), "atom int, mass double")
    v = np.diff(walk, axis=0)
    v = v - np.round(v)
    v = v - np.einsum("fai,a->fi", v, masses)[:, None, :] / sum(masses)
    n = len(v)
    wanted = [sum(m * np.mean([v[i, a] @ v[i + lag, a] for i in range(n - lag)]) for a, m in enumerate(masses)) / sum(masses) for lag in range(min(n, max_lag))]
    moved = S.moving(table_of(spark, walk), atoms, width=11)
    found = S.vacf_fft(moved, max_lag, width).orderBy("lag").collect()
    assert [r["vacf"] for r in found] == pytest.approx(wanted, abs=1e-12)


def test_missing_frames_leave_both_sums(spark, walk):
    atoms = spark.createDataFrame([(a, 1.0) for a in range(4)], "atom int, mass double")
    moved = S.moving(table_of(spark, walk), atoms, remove_com=False).filter("NOT (frame IN (20, 21, 40) AND atom = 1)")
    joined = {r["lag"]: r["vacf"] for r in S.vacf(moved, 6).collect()}
    assert {r["lag"]: r["vacf"] for r in S.vacf_fft(moved, 6, 8).collect()} == pytest.approx(joined)


def test_a_line_of_the_spectrum_is_where_the_atoms_swing(spark):
    n, dt, lag = 400, 1.0, 100
    t = np.arange(n)
    x = np.stack([np.stack([0.5 + 0.1 * np.cos(2 * np.pi * t / 20), 0 * t, 0 * t], 1), np.stack([0.5 - 0.1 * np.cos(2 * np.pi * t / 20), 0 * t, 0 * t], 1)], 1)
    atoms = spark.createDataFrame([(0, 1.0), (1, 1.0)], "atom int, mass double")
    for convention in ("cosine", "power"):
        correlation, found = S.trajectory_spectrum(table_of(spark, x), atoms, lag, dt=dt, convention=convention, width=150)
        rows = found.orderBy(F.desc("y")).collect()
        assert rows[0]["k"] == 5 and rows[0]["f"] == pytest.approx(33356.4095198152 / 20) and len(rows) == 50
    values = np.array([r["vacf"] for r in correlation.orderBy("lag").collect()])
    smooth = {r["k"]: r["y"] for r in S.density(correlation, lag, window="hamming", sigma=1.5).collect()}
    raw = 2 * np.fft.rfft(values * np.hamming(lag)).real
    kernel = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    wanted = np.convolve(np.pad(raw, 6, mode="symmetric"), kernel / kernel.sum(), mode="valid")
    assert [smooth[k] for k in range(1, 51)] == pytest.approx(wanted[1:], abs=1e-12)
    with pytest.raises(ValueError):
        S.density(correlation, lag, window="boxcar")
