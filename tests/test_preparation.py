"""Checks of a campaign on literals small enough to check by hand."""

import pytest
from pyspark.sql import functions as F

from halyard.config import CouplingPolicy
from halyard.operators import audit, preparation
from halyard.sources.tables import namelist_pairs


def test_unknown_elements_are_refused(spark):
    atoms = spark.createDataFrame([(0, "C"), (1, "H"), (2, "Pb")], "atom int, symbol string")
    assert {r["symbol"]: r["mass"] for r in preparation.masses(atoms).collect()} == {"C": 12.011, "H": 1.008, "Pb": 207.2}
    with pytest.raises(ValueError, match="Xx"):
        preparation.masses(atoms.union(spark.createDataFrame([(3, "Xx")], "atom int, symbol string")))


def test_scale_names_a_factor_or_a_volume(spark):
    cell = [2.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 4.0]
    rows = [(1.5, cell), (-192.0, cell), (0.0, cell), (1.0, [0.0] * 9)]
    found = spark.createDataFrame(rows, "s double, c array<double>").select(preparation.scale_factor(F.col("s"), F.col("c")).alias("f")).collect()
    assert [r["f"] for r in found] == [1.5, pytest.approx(2.0), None, None]


def test_specs(spark):
    specs = spark.createDataFrame([("a", "3"), ("b", " 5 - 7 "), ("c", "9-8"), ("d", "x")], "id string, spec string")
    assert sorted((r["id"], r["ion"]) for r in preparation.expanded(specs).collect()) == [("a", 3), ("b", 5), ("b", 6), ("b", 7)]


def test_band_windows(spark):
    lines = spark.createDataFrame([("a", "&X BMIN = 3, BMAX=7 /"), ("b", " bmin=3 bmax = 8 ! BMAX = 1"), ("c", "BMIN=3, BMAX=7.5"), ("d", "NSW = 4")], "file string, line string")
    sizes = preparation.basis_sizes(namelist_pairs(lines), "file")
    assert sorted(tuple(r) for r in sizes.collect()) == [("a", 3, 7, 5), ("b", 3, 8, 6), ("c", 3, None, None), ("d", None, None, None)]
    assert [r["file"] for r in preparation.band_conflicts(sizes, 3, 7).collect()] == ["b"]
    assert sum(r["n_files"] for r in preparation.band_windows(sizes).collect()) == 4


def test_start_frames(spark):
    files = spark.createDataFrame([("x/SHPROP.7", 7), ("x/SHPROP.8", 9), ("x/SHPROP.5", None), ("x/other", 2), ("x/none", None)], "name string, meta int")
    found = {r["name"]: (r["start"], r["source"], r["agree"]) for r in preparation.start_frames(files).collect()}
    assert found == {"x/SHPROP.7": (7, "metadata", True), "x/SHPROP.8": (9, "metadata", False), "x/SHPROP.5": (5, "name", True), "x/other": (2, "metadata", True), "x/none": (None, None, True)}


def test_groups_and_cycles(spark):
    groups = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, "b"), (5, "b")], "ion int, grp string")
    assert {r["ion"]: r["verdict"] for r in preparation.group_check(groups, 4).collect()} == {1: "ok", 2: "shared", 3: "missing", 4: "missing", 5: "beyond"}
    frames = spark.createDataFrame([(k, f) for k in "abc" for f in (1, 2, 3)] + [("d", 1), ("d", 3)], "run string, frame int")
    declared = spark.createDataFrame([("a", 4), ("b", 4), ("b", 5)], "run string, nsw int")
    found = {r["run"]: (r["proposal"], r["cycle"]) for r in preparation.cycle_proposals(frames, declared, "run").collect()}
    assert found == {"a": ("agreed", 3), "b": ("ambiguous", None), "c": ("unknown", None), "d": ("not_covered", None)}


def test_a_lower_bound_is_claimed_under_a_clip_policy_only(spark):
    rows = [(f, i, j, 0.6 if f < 4 else 0.1) for f in range(6) for i, j in ((0, 1), (1, 0))]
    nac = spark.createDataFrame(rows, "frame int, i int, j int, v double")
    claims = {a: audit.ceiling_claim(nac, CouplingPolicy(action=a)).first()["lower_bound"] for a in ("none", "clip", "reject", "warn")}
    assert claims == {"none": False, "clip": True, "reject": False, "warn": False}
    assert audit.ceiling_claim(nac, None).first()["claim"] == "ceiling_without_policy"
    alone = audit.ceiling_claim(nac.filter("frame >= 3 and i = 0").withColumn("v", F.col("v") + F.col("frame")), CouplingPolicy(action="clip")).first()
    assert (alone["claim"], alone["lower_bound"]) == ("no_ceiling", False)
