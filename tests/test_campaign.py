"""From written files to projected populations."""

import json

import numpy as np
import pytest

from halyard import campaign
from halyard.__main__ import main
from halyard.config import AtomGroups, StateMap


def projection_file(weights):
    """weights: band -> the total of each ion."""
    n = len(next(iter(weights.values())))
    lines = ["lm decomposed", f"# of k-points:    1         # of bands:   {len(weights)}         # of ions:    {n}", ""]
    for band, ions in weights.items():
        lines += [f"band   {band} # energy   -1.5 # occ.  2.0", "", "ion      s      tot"]
        lines += [f"  {k}  {x:.3f}  {x:.3f}" for k, x in enumerate(ions, 1)] + [f"tot  {sum(ions):.3f}  {sum(ions):.3f}", ""]
    return "\n".join(lines)


@pytest.fixture
def files(tmp_path):
    """Two histories over a cycle of four frames; bands 10 and 11 exchange their fragments after frame 2."""
    p10 = {1: np.linspace(0.9, 0.1, 4), 3: np.linspace(0.2, 0.8, 4)}
    for start, shares in p10.items():
        rows = [f"{t * 1000.0}  -1.0  {1 - p:.17g}  {p:.17g}" for t, p in enumerate(shares)]
        (tmp_path / f"SHPROP.{start}").write_text("# NSW = 5\n# BMIN = 10\n# BMAX = 11\n" + "\n".join(rows) + "\n")
    listed = []
    for frame in range(1, 6):
        folder = tmp_path / f"{frame:04d}"
        folder.mkdir()
        own, other = ([2.0, 0.0], [0.0, 4.0]) if frame <= 2 else ([0.0, 2.0], [4.0, 0.0])
        # no history visits frame 5, so its broken file is never opened
        (folder / "PROCAR").write_text(projection_file({10: own, 11: other}) if frame < 5 else "broken")
        listed.append({"frame": frame, "procar": f"{frame:04d}/PROCAR"})
    (tmp_path / "manifest.json").write_text(json.dumps({"frames": listed}))
    (tmp_path / "map.json").write_text(
        json.dumps({"name": "m", "time_column": 0, "time_unit": "fs", "population_columns": [2, 3], "groups": {"x": [2], "y": [3]}, "complete_population": True, "band_numbers": [11, 10]})
    )
    (tmp_path / "groups.json").write_text(json.dumps({"groups": {"alpha": [1], "beta": ["2"]}}))
    return tmp_path


def inputs(files):
    return [str(files / "SHPROP.1"), str(files / "SHPROP.3")], StateMap.from_json(str(files / "map.json")), AtomGroups.from_json(str(files / "groups.json")), str(files / "manifest.json")


def test_project_then_average(spark, files):
    out = campaign.character_populations(spark, *inputs(files))
    mean = {(r["t"], r["grp"]): r for r in out["mean"].collect()}
    assert [mean[t, "alpha"]["mean"] for t in range(4)] == pytest.approx([0.85, 0.616667, 0.616667, 0.85], abs=1e-5)
    assert [mean[t, "alpha"]["sem"] for t in range(4)] == pytest.approx([0.05, 0.016667, 0.016667, 0.05], abs=1e-5)
    assert [mean[t, "beta"]["time_ns"] for t in range(4)] == pytest.approx([0.0, 0.001, 0.002, 0.003])
    split = {(r["h"][-1], r["t"], r["grp"]): r for r in out["split"].collect()}
    for (h, t, g), r in split.items():
        before = split.get((h, t - 1, g))
        assert r["occ"] + r["chr"] == pytest.approx(r["pg"] - before["pg"] if before else 0.0, abs=1e-12)


def test_all_problems_are_told_together(spark, files):
    paths, _, atoms, manifest = inputs(files)
    (files / "SHPROP.3").write_text((files / "SHPROP.3").read_text().replace("BMAX = 11", "BMAX = 12"))
    (files / "manifest.json").write_text(json.dumps({"frames": [{"frame": 1, "procar": "0001/PROCAR"}]}))
    wrong = StateMap.from_dict({"name": "m", "time_column": 0, "time_unit": "fs", "population_columns": [2, 9], "groups": {"x": [2]}, "band_numbers": [10, 11]})
    with pytest.raises(ValueError) as e:
        campaign.character_populations(spark, paths, wrong, atoms, manifest)
    assert all(part in str(e.value) for part in ("beyond", "other bands", "not in the manifest"))


def test_shares_are_checked(spark, files):
    (files / "SHPROP.1").write_text((files / "SHPROP.1").read_text().replace("0.90000000000000002", "0.8"))
    with pytest.raises(ValueError, match="totals"):
        campaign.character_populations(spark, *inputs(files))


def test_command(spark, files, monkeypatch):
    main([
        "character-populations", "--histories", str(files / "SHPROP.1"), str(files / "SHPROP.3"), "--state-map", str(files / "map.json"),
        "--atom-groups", str(files / "groups.json"), "--manifest", str(files / "manifest.json"), "--out", str(files / "out"),
    ])
    assert (files / "out" / "report.md").exists()
    assert spark.read.csv(str(files / "out" / "mean"), header=True).count() == 8


@pytest.fixture
def tables(files):
    """Energies and couplings of the four frames for the two bands: close and coupled at frame 3."""
    (files / "EIGTXT").write_text("".join(f"-1.0 {-1.0 + g}\n" for g in (0.5, 0.5, 0.01, 0.5)))
    (files / "NATXT").write_text("".join(f"0.0 {c} {-c} 0.0\n" for c in (0.001, 0.001, 0.2, 0.001)))
    return files


def test_crossings_from_files(spark, tables):
    windows = spark.createDataFrame([("all", 0, 3), ("none", 50, 60)], "name string, lo int, hi int")
    out = campaign.character_crossings(spark, *inputs(tables), str(tables / "EIGTXT"), str(tables / "NATXT"), windows=windows)
    (r,) = [r for r in out["frame_events"].collect() if r["swap"]]
    assert (r["frame0"], r["frame"], r["a"], r["b"], r["before_a"], r["after_a"], r["small_gap"], r["strong_nac"]) == (2, 3, 10, 11, "alpha", "beta", True, True)
    # one history goes from frame 2 to 3; the other starts at 3 and wraps from 4 to 1
    found = {(r["h"][-1], r["t"]): r for r in out["history_events"].filter("swap").collect()}
    assert (found["1", 2]["frame"], found["3", 2]["frame"]) == (3, 1)
    assert sum(r["n"] for r in out["counts"].collect()) == out["history_events"].count() == sum(r["n"] for r in out["window_counts"].collect())
    none = campaign.character_crossings(spark, *inputs(tables), str(tables / "EIGTXT"), str(tables / "NATXT"), gap=0.001, coupling=1.0, exchange=1.5)
    assert {r["small_gap"] or r["strong_nac"] for r in none["frame_events"].collect()} <= {False}


def test_ensemble_from_files(spark, tables):
    windows = spark.createDataFrame([("w", 3, 3)], "name string, lo int, hi int")
    out = campaign.character_ensemble(spark, *inputs(tables), frame_windows=windows, donor="alpha", acceptor="beta", late_from=2)
    split = campaign.character_populations(spark, *inputs(tables))["split"].collect()
    for r in out["histories"].collect():
        own = sorted((s["t"], s["pg"], s["occ"], s["chr"]) for s in split if (s["h"], s["grp"]) == (r["h"], r["grp"]))
        assert r["net_full"] == pytest.approx(own[-1][1] - own[0][1]) and r["net_late"] == pytest.approx(own[-1][1] - own[2][1])
        assert (r["occ"], r["chr"]) == pytest.approx((sum(x[2] for x in own), sum(x[3] for x in own)))
    assert {r["n"] for r in out["summary"].collect()} == {2}
    steps = {(s["h"], s["grp"]): s["occ"] + s["chr"] for s in split if s["frame"] == 3}
    assert {(r["h"], r["grp"]): r["net"] for r in out["passes"].collect()} == pytest.approx(steps)
    assert out["verdicts"].count() == 2 and out["episodes"].count() == 2 and out["curve"].count() == 8


def test_linear_walks_need_their_frames(spark, tables):
    paths, states, atoms, manifest = inputs(tables)
    # from frame 1 the four rows end at frame 4, from frame 3 at frame 6
    with pytest.raises(ValueError, match=r"1 required frames are not in the manifest, the first \[6\]"):
        campaign.character_populations(spark, paths, states, atoms, manifest, mode="linear")
    out = campaign.character_populations(spark, paths[:1], states, atoms, manifest, mode="linear")
    assert {(r["t"], r["frame"]) for r in out["split"].collect()} == {(t, t + 1) for t in range(4)}


def test_commands_over_files(spark, tables):
    given = ["--histories", str(tables / "SHPROP.1"), str(tables / "SHPROP.3"), "--state-map", str(tables / "map.json"), "--atom-groups", str(tables / "groups.json"), "--manifest", str(tables / "manifest.json")]
    main(["character-crossings", *given, "--energies", str(tables / "EIGTXT"), "--couplings", str(tables / "NATXT"), "--window", "all:0:3", "--set", "gap=0.2", "--out", str(tables / "crossings")])
    assert spark.read.csv(str(tables / "crossings" / "window_counts"), header=True).count() > 0
    main(["character-ensemble", *given, "--frame-window", "w:3:3", "--set", "late_from=2", "--set", "donor=alpha", "--out", str(tables / "ensemble")])
    assert spark.read.csv(str(tables / "ensemble" / "passes"), header=True).count() == 4
    with pytest.raises(ValueError, match="no parameter"):
        main(["character-ensemble", *given, "--set", "nothing=1", "--out", str(tables / "other")])


def test_spectra_command(spark, tmp_path):
    for name, factor in (("a", 1), ("b", 2)):
        (tmp_path / f"spectral_density_{name}.txt").write_text("".join(f"{f} {factor * (1 + f % 3)}\n" for f in range(0, 101, 10)))
    main(["spectra", "--spectra", str(tmp_path / "spectral_density_a.txt"), str(tmp_path / "spectral_density_b.txt"), "--out", str(tmp_path / "out")])
    rows = spark.read.csv(str(tmp_path / "out" / "differences"), header=True, inferSchema=True).collect()
    assert {r["label"] for r in rows} == {"b"} and rows[0]["ratio_range_integral"] == pytest.approx(2.0)
