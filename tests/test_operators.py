"""Known answers of the operators, on literals small enough to check by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import audit, character, ensemble, episodes, events, network, populations, spectra, transfer
from halyard.plans.template import bind


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def campaign(spark):
    """Two histories over four frames; bands 10 and 11 exchange their fragments after frame 2."""
    p10 = {1: np.linspace(0.9, 0.1, 4), 3: np.linspace(0.2, 0.8, 4)}
    pop = [(h, t, f"s{b}", b, float(p if b == 10 else 1 - p)) for h, ps in p10.items() for t, p in enumerate(ps) for b in (10, 11)]
    weights = []
    for frame in (1, 2, 3, 4):
        first = "alpha" if frame <= 2 else "beta"
        for band in (10, 11):
            own = first if band == 10 else ("beta" if first == "alpha" else "alpha")
            weights += [(frame, band, g, k, 1.0 if g == own else 0.0, 1.0, 1.0) for k, g in enumerate(("alpha", "beta"))]
    visits = [(h, t, (t + h) % 4 or 4) for h in p10 for t in range(4)]
    return (
        spark.createDataFrame(pop, "h int, t int, state string, band int, p double"),
        spark.createDataFrame(visits, "h int, t int, frame int"),
        spark.createDataFrame(weights, "frame int, band int, grp string, ord int, w double, captured double, total double"),
    )


def test_project_then_average(campaign):
    pop, visits, weights = campaign
    parts = character.split(pop, visits, weights)
    found = {(r["h"], r["t"]): r["pg"] for r in parts.filter("grp = 'alpha'").collect()}
    assert [found[1, t] for t in range(4)] == pytest.approx([0.9, 0.633333, 0.633333, 0.9], abs=1e-5)
    assert [found[3, t] for t in range(4)] == pytest.approx([0.8, 0.6, 0.6, 0.8], abs=1e-5)
    mean = {r["t"]: r for r in character.projected_mean(parts).filter("grp = 'alpha'").collect()}
    assert [mean[t]["mean"] for t in range(4)] == pytest.approx([0.85, 0.616667, 0.616667, 0.85], abs=1e-5)
    assert [mean[t]["sem"] for t in range(4)] == pytest.approx([0.05, 0.016667, 0.016667, 0.05], abs=1e-5)


def test_split_is_exact(campaign):
    pop, visits, weights = campaign
    parts = character.split(pop, visits, weights)
    assert max(r["residual"] for r in bind(character.RESIDUAL, split=parts).collect()) < 1e-15
    assert parts.filter("t = 0 and (occ <> 0 or chr <> 0)").count() == 0


def test_weights_normalise_and_count_all_ions(spark):
    ions = spark.createDataFrame([(1, 0, 1, 1.0), (1, 0, 2, 3.0), (1, 0, 3, 6.0)], "frame int, band int, ion int, tot double")
    groups = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "ion int, grp string, ord int")
    assert rows(character.fragment_weights(ions, groups), "grp") == [(1, 0, "a", 0, 0.25, 4.0, 10.0), (1, 0, "b", 1, 0.75, 4.0, 10.0)]


def test_dominance_ties_take_the_first_group(spark):
    weights = spark.createDataFrame([(1, 0, "z", 0, 0.5, 1.0, 1.0), (1, 0, "a", 1, 0.5, 1.0, 1.0)], "frame int, band int, grp string, ord int, w double, captured double, total double")
    assert bind(character.DOMINANT, weights=weights).first()["dominant"] == "z"


def test_group_error_keeps_covariance(spark):
    pop = spark.createDataFrame([(0, 0, "a", 0.2), (0, 0, "b", 0.3), (1, 0, "a", 0.3), (1, 0, "b", 0.2)], "h int, t int, state string, p double")
    groups = spark.createDataFrame([("a", "g"), ("b", "g")], "state string, grp string")
    assert rows(populations.group_series(pop, groups), "t") == [(0, "g", 0.5, 0.0)]


def test_error_of_one_history_is_null(spark):
    pop = spark.createDataFrame([(0, 0, "a", 1.0)], "h int, t int, state string, p double")
    assert populations.ensemble(pop).first()["sem"] is None


def test_window_is_cut_before_differences(spark):
    series = spark.createDataFrame([(t, "g", float(v)) for t, v in enumerate([9, 1, 3, 3, 2])], "t int, grp string, mean double")
    windows = spark.createDataFrame([("w", 0, 1, 4), ("one", 1, 2, 2)], "name string, ord int, lo int, hi int")
    (r,) = populations.window_metrics(series, windows).collect()
    assert (r["initial"], r["final"], r["peak"], r["peak_time"], r["least_time"], r["net"]) == (1, 2, 3, 2, 1, 1)
    assert r["integral"] == pytest.approx(2 + 3 + 2.5) and r["mean"] == pytest.approx(7.5 / 3)


def test_bad_populations_are_refused(spark):
    schema = "h int, t int, state string, p double"
    populations.check_population(spark.createDataFrame([(0, 0, "a", 0.5), (0, 0, "b", 0.5)], schema))
    for bad in ([(0, 0, "a", 1.5), (0, 0, "b", -0.5)], [(0, 0, "a", 0.7)], [(0, 0, "a", 1.0), (1, 1, "a", 1.0)]):
        with pytest.raises(ValueError):
            populations.check_population(spark.createDataFrame(bad, schema))


@pytest.mark.parametrize(
    "donor,acceptor,wanted",
    [
        ([0.95] * 20 + [0.09, 0.11, 0.08, 0.12, 0.07] + [0.05] * 20, None, 1),
        ([0.95] * 10 + [0.05] * 10 + [0.95] * 10 + [0.05] * 10, None, 2),
        ([0.95] * 10 + [0.02] * 10, [0.0] * 20, 0),
        ([0.95] * 20 + [0.25] * 20, None, 0),
    ],
)
def test_threshold_events(spark, donor, acceptor, wanted):
    acceptor = acceptor or [1 - d for d in donor]
    pairs = spark.createDataFrame([(0, t, float(d), float(a)) for t, (d, a) in enumerate(zip(donor, acceptor))], "h int, t int, d double, a double")
    levels = spark.createDataFrame([(0.9, 0.1)], "high double, low double")
    assert transfer.threshold_events(pairs, levels).first()["n_events"] == wanted
    with pytest.raises(ValueError):
        transfer.threshold_events(pairs, spark.createDataFrame([(0.1, 0.9)], "high double, low double"))


def test_cutoffs_decide(spark):
    donor = [0.95] * 20 + [0.25] * 20
    pairs = spark.createDataFrame([(0, t, d, 1 - d) for t, d in enumerate(donor)], "h int, t int, d double, a double")
    levels = spark.createDataFrame([(0.9, 0.1), (0.8, 0.2), (0.7, 0.3)], "high double, low double")
    assert [r["n_events"] for r in transfer.threshold_events(pairs, levels).orderBy(F.desc("high")).collect()] == [0, 0, 1]


def test_concomitant_change(spark):
    pairs = spark.createDataFrame([(0, 0, 1.0, 0.0), (0, 1, 0.6, 0.1), (0, 2, 0.7, 0.2)], "h int, t int, d double, a double")
    r = transfer.continuous_change(pairs).first()
    assert (r["donor_net"], r["acceptor_net"], r["max_step"], r["concomitant"]) == pytest.approx((-0.3, 0.2, 0.4, 0.1))


@pytest.fixture(scope="module")
def avoided(spark):
    """An avoided crossing: 41 frames, coupling 0.02, detuning -0.5 to 0.5."""
    v = 0.02
    energies, weights, nac = [], [], []
    for k, d in enumerate(np.linspace(-0.5, 0.5, 41)):
        theta, e = 0.5 * math.atan2(2 * v, d), math.sqrt((d / 2) ** 2 + v**2)
        energies += [(k + 1, 0, -e), (k + 1, 1, e)]
        for band, w in ((0, math.cos(theta) ** 2), (1, math.sin(theta) ** 2)):
            weights += [(k + 1, band, "ga", 0, w, 1.0, 1.0), (k + 1, band, "gb", 1, 1 - w, 1.0, 1.0)]
        nac += [(k + 1, 0, 1, v), (k + 1, 1, 0, -v)]
    return (
        spark.createDataFrame(weights, "frame int, band int, grp string, ord int, w double, captured double, total double"),
        spark.createDataFrame(energies, "frame int, state int, e double"),
        spark.createDataFrame(nac, "frame int, i int, j int, v double"),
    )


def test_avoided_crossing(avoided):
    weights, energies, nac = avoided
    found = events.frame_events(weights, energies, nac).collect()
    swaps = [r for r in found if r["swap"]]
    assert swaps and {r["frame"] for r in swaps} <= set(range(20, 24))
    assert all(r["classification"] == "character_swap_population_not_evaluated" for r in swaps)
    closest = min(found, key=lambda r: r["gap"])
    assert closest["gap"] == pytest.approx(0.04) and closest["strong_nac"]
    (episode,) = episodes.episodes(weights, energies, nac).collect()
    assert episode["min_gap"] == pytest.approx(0.04) and episode["before"] != episode["after"]


def test_there_and_back_is_one_episode(spark):
    weights, energies, nac = [], [], []
    for k in range(40):
        swapped = 15 <= k < 20
        for band in (0, 1):
            own = "ga" if (band == 0) != swapped else "gb"
            weights += [(k + 1, band, g, o, 0.9 if g == own else 0.1, 1.0, 1.0) for o, g in enumerate(("ga", "gb"))]
            energies.append((k + 1, band, band * 0.1))
        nac += [(k + 1, 0, 1, 0.01), (k + 1, 1, 0, -0.01)]
    found = episodes.episodes(
        spark.createDataFrame(weights, "frame int, band int, grp string, ord int, w double, captured double, total double"),
        spark.createDataFrame(energies, "frame int, state int, e double"),
        spark.createDataFrame(nac, "frame int, i int, j int, v double"),
    ).collect()
    assert len(found) == 1 and found[0]["before"] == found[0]["after"] == "ga" and found[0]["n_marks"] == 2


def test_couplings_must_be_antisymmetric(spark):
    schema = "frame int, i int, j int, v double"
    audit.checked(spark.createDataFrame([(1, 0, 1, 0.5), (1, 1, 0, -0.5)], schema))
    with pytest.raises(ValueError):
        audit.checked(spark.createDataFrame([(1, 0, 1, 0.5), (1, 1, 0, 0.5)], schema))


def test_velocity_takes_the_nearest_image(spark):
    traj = spark.createDataFrame([(1, 0, 0.95, 0.0, 0.0), (2, 0, 0.05, 0.5, 0.0)], "frame int, atom int, x double, y double, z double")
    r = spectra.velocities(traj).first()
    assert (r["vx"], r["vy"]) == pytest.approx((0.1, 0.5))


def test_vacf_of_an_oscillator(spark):
    n, period = 200, 20
    traj = [(t + 1, a, 0.5 + 0.01 * math.sin(2 * math.pi * t / period + a), 0.0, 0.0) for t in range(n) for a in range(3)]
    moved = spectra.velocities(spark.createDataFrame(traj, "frame int, atom int, x double, y double, z double")).withColumn("m", F.lit(1.0) + F.col("atom"))
    lag = {r["lag"]: r["vacf"] for r in spectra.vacf(moved).collect()}
    fft = {r["lag"]: r["vacf"] for r in spectra.vacf_fft(moved).collect()}
    assert lag.keys() == fft.keys()
    for k in lag:
        assert fft[k] == pytest.approx(lag[k], rel=1e-9, abs=1e-15)
        assert lag[k] / lag[0] == pytest.approx(math.cos(2 * math.pi * k / period), abs=0.05)


def test_passes_without_a_step_count(spark):
    split = spark.createDataFrame([(0, t, "ga", 0.0, 1.0, 0.0) for t in range(60)], "h int, t int, grp string, pg double, occ double, chr double")
    # frames 3 to 8 are visited in the first and third pass only
    visits = spark.createDataFrame([(0, t, (t % 20) + 1 if t // 20 != 1 else 20) for t in range(60)], "h int, t int, frame int")
    windows = spark.createDataFrame([("near", 3, 8), ("far", 7, 16)], "name string, lo int, hi int")
    found = {r["name"]: r for r in bind(ensemble.PER_PASS, split=split, rows_frames=visits, frame_windows=windows).collect()}
    assert found["near"]["occ"] == pytest.approx(12 / 3) and found["near"]["n_covering"] == 2


def test_parameters_replace_defaults(spark):
    pop = spark.createDataFrame([(0, 0, "a", 0.25), (0, 0, "b", 0.75)], "h int, t int, state string, p double")
    assert bind(populations.SURVIVAL, params={"recombined": "b"}, pop=pop).first()["survival"] == pytest.approx(0.25)
    with pytest.raises(ValueError):
        bind(populations.SURVIVAL, params={"recombind": "b"}, pop=pop)
