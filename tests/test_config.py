"""Declared configuration, preparation, provenance, reports and the command line."""

import json

import numpy as np
import pandas as pd
import pytest

from halyard import __main__ as cli
from halyard import config as C
from halyard import prepare as P
from halyard import provenance, report
from halyard.functions import kinetics as K
from halyard.functions import peaks
from halyard.sources import logs

MAP = {"name": "m", "time_column": 0, "time_unit": "fs", "population_columns": [2, 3], "groups": {"a": [2], "b": [3]}, "complete_population": True, "recombined_group": "b"}


def test_state_map(spark):
    m = C.StateMap.from_dict(MAP)
    assert m.ungrouped() == [] and m.frame(spark).filter("grp = 'b'").first()["column"] == 3
    for change in (
        {"groups": {"a": [2, 3], "b": [3]}}, {"groups": {"a": [2]}}, {"time_unit": "s"}, {"time_column": 2}, {"complete_population": 1},
        {"complete_population": False}, {"band_numbers": [1]}, {"population_columns": [2, 2]},
    ):
        with pytest.raises(ValueError):
            C.StateMap.from_dict(MAP | change)


def test_atoms():
    assert C.expand_atoms(["1-3", 7, "9"]) == [1, 2, 3, 7, 9]
    for bad in (["1-3", 2], ["3-1"], ["x"], [0]):
        with pytest.raises(ValueError):
            C.expand_atoms(bad)
    C.AtomGroups.from_dict({"groups": {"a": ["1-2"], "b": [3]}, "complete_atoms": True}, 3)
    for bad, n in (({"groups": {"a": [1], "b": [1]}}, 2), ({"groups": {"a": [5]}}, 2), ({"groups": {"a": [1]}, "complete_atoms": True}, 2)):
        with pytest.raises(ValueError):
            C.AtomGroups.from_dict(bad, n)


def test_windows_sweeps_sizes(spark):
    assert C.Window.parse("late=0.1:") == C.Window("late", 0.1, None)
    with pytest.raises(ValueError):
        C.Window.parse("2:1")
    with pytest.raises(ValueError):
        C.windows_frame(spark, [C.Window.parse("0:1"), C.Window.parse("0:2")])
    assert C.parse_sweep("1:100:3") == pytest.approx([1, 10, 100]) and C.parse_sweep("1,2") == [1, 2]
    assert C.parse_size("24G") == 24 << 30 and C.print_size(1536) == "1.5 KiB"
    policy = C.CouplingPolicy.from_dict({"numerical_limit": "hbar_over_dt", "action_above_limit": "clip"})
    assert policy.limit_ev(1.0) == pytest.approx(0.6582119569509066)
    with pytest.raises(ValueError):
        C.CouplingPolicy.from_dict({"action_above_limit": "hide"})


def test_resolvers():
    assert C.resolve_bands(None, None, [(3, 5), (3, 5)])[:2] == ([3, 4, 5], "headers")
    assert C.resolve_bands([3, 4], None, [(3, 5)])[1:] == ("state_map", [(3, 5)])
    assert C.resolve_start(None, "SHPROP.7") == (7, "name")
    assert C.resolve_period("cyclic", None, [2000, 2000]) == 1999 and C.resolve_period("linear", 5, []) is None
    for bad in (lambda: C.resolve_bands(None, None, [(1, 2), (1, 3)]), lambda: C.resolve_start(3, "SHPROP.7"), lambda: C.resolve_start(None, "x"), lambda: C.resolve_period("cyclic", None, [3, 4])):
        with pytest.raises(ValueError):
            bad()


def test_observables(spark):
    table = spark.range(1).toDF("a")
    tagged = C.Observables().uniform(["a"], C.INFERRED).tagged(table)
    assert tagged.schema["a"].metadata == {"known_as": "model_inferred"}
    with pytest.raises(ValueError):
        C.Observables().tagged(table)


def campaign(root, names):
    for n in names:
        (root / n).mkdir(parents=True)
        (root / n / "PROCAR").write_text("x")
    (root / "POSCAR").write_text("x\n1\n1 0 0\n0 1 0\n0 0 1\nC H\n2 1\n")


def test_preparation(spark, tmp_path):
    root = tmp_path / "c"
    campaign(root, ["0001", "0002", "0003"])
    groups = {"groups": {"a": ["1-2"], "b": [3]}, "complete_atoms": True}
    got = P.prepare(spark, str(root), str(tmp_path / "out"), groups, {4})
    assert got["problems"] == [] and got["cycle_length"] == 3 and got["ions"] == 3
    manifest = P.load_manifest(spark, str(tmp_path / "out" / "manifest.json"))
    assert manifest.count() == 3
    bad = P.prepare(spark, str(root), str(tmp_path / "none"), {"groups": {"a": [9]}}, set())
    assert bad["problems"] and not (tmp_path / "none").exists()
    campaign(tmp_path / "d", ["1", "3"])
    frames = P.discover_frames(spark, str(tmp_path / "d"))
    assert frames.gaps == (2,) and P.propose_cycle(frames, {4}) == (None, "not_covered")
    assert "frames" in P.build_manifest(frames, "x")
    campaign(tmp_path / "e", ["1", "01"])
    with pytest.raises(ValueError):
        P.discover_frames(spark, str(tmp_path / "e"))
    (tmp_path / "m.json").write_text(json.dumps({"frames": [{"frame": 1, "procar": "a"}, {"frame": 1, "procar": "b"}]}))
    with pytest.raises(ValueError):
        P.load_manifest(spark, str(tmp_path / "m.json"))


def test_column_inference():
    rows = [[float(t), -1.5, 0.25 + t / 10, 0.75 - t / 10] for t in range(4)]
    assert P.infer_columns(rows, 2) == 2
    with pytest.raises(ValueError):
        P.infer_columns([[0.0, 0.5, 0.5, 0.5]], 2)
    with pytest.raises(ValueError):
        P.infer_columns([[0.0, 2.0, 2.0]], 2)


def test_provenance(spark, tmp_path):
    assert provenance.canonical_hash({"b": 1, "a": 2}) == provenance.canonical_hash({"a": 2, "b": 1})
    assert provenance.environment(spark)["spark"] == spark.version
    (tmp_path / "x.json").write_text("[1]")
    with pytest.raises(ValueError):
        provenance.launcher_manifests([str(tmp_path / "x.json")])


def test_report_and_command_line(spark, sf_dir, tmp_path):
    table = spark.createDataFrame([(1, None), (2, 0.5)], "a int, b double")
    text = report.markdown("T", {"x": table}, ["note"], limit=1)
    assert "not evaluated" in text and "first 1 rows" in text
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "f").write_text("x")
    with pytest.raises(FileExistsError):
        report.prepare_output(str(tmp_path / "full"))
    cli.main(["transient-populations", "--data", sf_dir, "--out", str(tmp_path / "out")])
    assert (tmp_path / "out" / "report.md").read_text().startswith("# transient-populations")


def test_envelope(spark):
    table = spark.range(1000).selectExpr("cast(id as double) x", "cast(id % 7 as double) y")
    got = report.envelope(table, "x", "y", 10).collect()
    assert len(got) == 10 and all((r["low"], r["high"]) == (0, 6) for r in got)


def test_peaks(spark):
    x = np.arange(0, 60, 0.5)
    y = np.exp(-((x - 20) ** 2) / 8) + 0.5 * np.exp(-((x - 40) ** 2) / 2)
    frame = spark.createDataFrame(pd.DataFrame({"label": "s", "f": x, "y": y}))
    got = peaks.peak_table(frame, 0, 60).orderBy("f").collect()
    assert [r["f"] for r in got] == [20, 40]
    assert got[0]["width"] == pytest.approx(2.3548 * 2, rel=0.02) and got[1]["width"] == pytest.approx(2.3548, rel=0.05)
    assert peaks.find_peaks(np.array([0, 1, 1, 1, 0.0]), 0.5).tolist() == [2]


def test_sweeps_and_regimes():
    edges = [(0, 1)]
    time = np.linspace(0, 4, 41)
    observed = K.propagate(K.rate_matrix([1.0], edges, 2), np.array([1.0, 0.0]), time)
    fit = K.fit_rates(time, observed, ["a", "b"], edges)
    sweep = K.sink_sweep(fit, 0, np.array([0.1, 10.0]), time, observed[0])
    assert sweep[0]["extracted"] < sweep[1]["extracted"]
    assert K.branch(fit, 0, {1}, set())["value"] == pytest.approx(1)
    assert K.fit_regime("x", time, observed, ["a", "b"], edges, 0, 0.2)["reason"]
    two = np.where(time[:, None] <= 2, observed, 0)
    late = K.propagate(K.rate_matrix([0.05], edges, 2), observed[20], time[20:] - 2)
    two[20:] = late
    assert K.compare_piecewise(time, two, ["a", "b"], edges, 2.0)["preferred"] == "piecewise"


def test_logs(spark, tmp_path):
    osz = tmp_path / "OSZICAR"
    osz.write_text("DAV:   1    -0.10E+02   -0.10E+02\nDAV:   2    -0.11E+02   -0.1E-06\n   1 F= -.11E+02\nRMM:   1    -0.12E+02   -0.1E-07\n")
    steps = logs.electronic_steps(spark, str(osz))
    assert [(r["cycle"], r["step"]) for r in steps.orderBy("line_no").collect()] == [(0, 1), (0, 2), (1, 1)]
    assert logs.classify_steps(steps, 60, 1e-6).first()["verdict"] == "PASS"
    assert logs.classify_steps(steps, 1, 1e-9).first()["verdict"] == "FAIL"
    out = tmp_path / "OUTCAR"
    out.write_text("Iteration 1( 1)\n free  energy   TOTEN  = -5.0 eV\n E-fermi :  1.5 x\n Iteration 1( 2)\n free  energy   TOTEN  = -6.0 eV\n aborting loop because EDIFF is reached\n General timing and accounting\n")
    r = logs.run_summary(spark, str(out)).first()
    assert (r["toten"], r["e_fermi"], r["n_iterations"], r["verdict"]) == (-6.0, 1.5, 2, "PASS")
    root, frame = tmp_path / "INCAR", tmp_path / "f"
    root.write_text("NELM = 60\nEDIFF = 1E-5\n")
    frame.write_text("NELM = 10\nEDIFF = 1E-4\nENCUT = 400\n")
    got = {r["key"]: r["value"] for r in logs.settings(spark, str(root), [str(frame)], {"EDIFF": "1E-8"}).collect()}
    assert got == {"NELM": "60", "EDIFF": "1E-8", "ENCUT": "400"}
