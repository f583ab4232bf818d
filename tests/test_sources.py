"""Readers, sinks and the stream, with what each must refuse."""

import json
import random

import pytest
from pyspark.sql import functions as F

from halyard.sources import blocks, sinks, tables
from halyard.streaming.histories import history_stream, running_ensemble


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_numeric_table(spark, tmp_path):
    path = write(tmp_path, "a", "# BMIN = 3\n! note\n 1.0D+00 2\n\n 3 4.5e1 # end\n")
    found = tables.numeric_table(spark, path).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["cols"]) for r in found] == [(0, [1.0, 2.0]), (1, [3.0, 45.0])]
    s = tables.structure(spark, path).first()
    assert (s["n_rows"], s["n_columns"], s["first_row"], s["last_row"]) == (2, 2, [1.0, 2.0], [3.0, 45.0])


def test_rows_keep_their_order_over_file_blocks(spark, tmp_path):
    path = write(tmp_path, "long", "".join(f"{k} {k * 2}\n" for k in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        table = tables.numeric_table(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        assert table.filter("cols[0] <> row_idx").count() == 0 and table.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ["1 2\n3\n", "1 x\n", "1 inf\n", "# only\n", "1 nan\n"])
def test_bad_tables_are_refused(spark, tmp_path, text):
    with pytest.raises(ValueError):
        tables.numeric_table(spark, write(tmp_path, "bad", text)).collect()


def test_metadata(spark, tmp_path):
    path = write(tmp_path, "m", "# BMIN = 3\n# potim = 1.5D-1\n# FLAG = T\n# NAME = abc\n1 2\n# LATE = 4\n")
    found = {r["key"]: (r["value"], r["kind"]) for r in tables.table_metadata(spark, path).collect()}
    assert found == {"BMIN": ("3", "int"), "POTIM": ("1.5D-1", "float"), "FLAG": ("T", "bool"), "NAME": ("abc", "string")}
    with pytest.raises(ValueError):
        tables.table_metadata(spark, write(tmp_path, "twice", "# A = 1\n# A = 2\n1\n"))


def test_histories_divide_time(spark, tmp_path):
    path = write(tmp_path, "SHPROP.1", "0 -1.5 0.25 0.75\n1000000 -1.5 0.5 0.5\n")
    found = tables.histories(spark, path, {2: "a", 3: "b"}).orderBy("t", "state").collect()
    assert [(r["t"], r["time_ns"], r["state"], r["p"]) for r in found] == [(0, 0, "a", 0.25), (0, 0, "b", 0.75), (1, 1, "a", 0.5), (1, 1, "b", 0.5)]


def test_matrices(spark, tmp_path):
    path = write(tmp_path, "NATXT", "0 1 -1 0\n")
    assert {(r["i"], r["j"], r["v"]) for r in tables.couplings(spark, path).collect()} == {(0, 0, 0.0), (0, 1, 1.0), (1, 0, -1.0), (1, 1, 0.0)}
    with pytest.raises(ValueError):
        tables.couplings(spark, write(tmp_path, "odd", "1 2 3\n"))
    assert tables.state_energies(spark, write(tmp_path, "EIGTXT", "1 2\n3 4\n")).filter("frame = 2 and state = 1").first()["e"] == 4


def test_namelist(spark, tmp_path):
    path = write(tmp_path, "inp", "&RUN\n BMIN = 1, BMAX=4 ! basis\n LHOLE = .TRUE.\n POTIM = 1.0\n/\n")
    found = {r["key"]: (r["value"], r["kind"]) for r in tables.namelist(spark, path).collect()}
    assert found == {"BMIN": ("1", "int"), "BMAX": ("4", "int"), "LHOLE": (".TRUE.", "bool"), "POTIM": ("1.0", "float")}


def test_spectrum(spark, tmp_path):
    found = tables.spectrum(spark, write(tmp_path, "s", "freq intensity\n1 2\n2 3\n"), "x").collect()
    assert [(r["f"], r["y"]) for r in found] == [(1, 2), (2, 3)]
    with pytest.raises(ValueError):
        tables.spectrum(spark, write(tmp_path, "back", "2 2\n1 3\n"), "x")


def test_character_table_must_be_full(spark, tmp_path):
    head = "frame,band,group,normalized_weight\n"
    assert tables.projection_character(spark, write(tmp_path, "full", head + "1,1,a,0.5\n1,1,b,0.5\n")).count() == 2
    for bad in ("1,1,a,0.5\n1,1,b,0.5\n2,1,a,1\n", "1,1,a,1\n1,1,a,1\n"):
        with pytest.raises(ValueError):
            tables.projection_character(spark, write(tmp_path, f"bad{len(bad)}", head + bad))


def projection_text(bands=(5, 6), ions=3, newline="\n", extra=""):
    lines = ["PROCAR lm decomposed", f"# of k-points:    1         # of bands:   {len(bands)}         # of ions:    {ions}", " k-point 1 : 0 0 0"]
    for b in bands:
        lines += [f"band     {b} # energy   {b / 10:.3f} # occ.  1.0", "", "ion      s      p      d    tot"]
        lines += [f"  {i}  0.0  0.1  0.0  {b * 0.01 + i * 0.1:.3f}" for i in range(1, ions + 1)]
        lines += ["tot 0.0 0.3 0.0 0.9", ""]
    return newline.join(lines) + extra


def test_projections(spark, tmp_path):
    paths = [write(tmp_path, f"P{k}", projection_text(newline="\r\n" if k else "\n")) for k in range(2)]
    write(tmp_path, "poison", "not a projection")
    manifest = spark.createDataFrame([(1, paths[0]), (2, paths[1])], "frame int, path string")
    found = blocks.projections(spark, manifest, [6]).collect()
    assert {(r["frame"], r["band"], r["ion"]) for r in found} == {(f, 6, i) for f in (1, 2) for i in (1, 2, 3)}
    assert {round(r["tot"], 3) for r in found} == {0.16, 0.26, 0.36} and {r["energy"] for r in found} == {0.6}


@pytest.mark.parametrize(
    "text",
    [
        "nothing", projection_text()[:-60], projection_text((5, 5)), projection_text().replace("  2  0.0", "  1  0.0"),
        projection_text().replace("k-points:    1", "k-points:    2"), projection_text().replace("0.150", "-0.15"), projection_text((5,)).replace("bands:   1", "bands:   2"),
    ],
)
def test_bad_projections_are_refused(text):
    with pytest.raises(ValueError):
        blocks.parse_projections(text)


def test_tiny_negatives_become_zero():
    rows = blocks.parse_projections(projection_text((5,)).replace("0.150", "-1e-13"))
    assert rows[0][3] == 0.0


TRAJECTORY = "x\n1.0\n2 0 0\n0 2 0\n0 0 2\nC H\n1 1\nDirect configuration=     1\n0 0 0\n0.5 0.5 0.5\nDirect configuration=     2\n0.1 0 0\n0.5 0.5 0.6\n"


def test_trajectory(spark, tmp_path):
    found = blocks.trajectory(spark, write(tmp_path, "X", TRAJECTORY)).orderBy("frame", "atom").collect()
    assert [(r["frame"], r["symbol"], r["x"]) for r in found] == [(1, "C", 0), (1, "H", 0.5), (2, "C", 0.1), (2, "H", 0.5)]
    again = blocks.parse_trajectory(TRAJECTORY + TRAJECTORY)
    assert len(again) == 8 and again[-1][0] == 4
    assert blocks.parse_trajectory(TRAJECTORY.replace("1.0", "-64.0", 1))[0][6][0] == pytest.approx(4.0)
    for bad in (TRAJECTORY[:-20], TRAJECTORY.replace("Direct configuration=     2", "Cartesian configuration=     2"), TRAJECTORY + TRAJECTORY.replace("C H", "C O"), TRAJECTORY.replace("1.0", "0.0", 1)):
        with pytest.raises(ValueError):
            blocks.parse_trajectory(bad)


def long_trajectory(frames, variable, seed=0):
    rnd = random.Random(seed)
    header = lambda k: f"title {k}\n {1 + k * variable / 10}\n 4.0 0 0\n 0 5.{k % 10 * variable} 0\n 0 0 6\n C H\n 3 2\n"
    out = header(0)
    for k in range(frames):
        if k and (variable and rnd.random() < 0.4):
            out += header(k)
        out += f"Direct configuration= {k + 1:5d}\n" + "".join("  ".join(f"{rnd.random():.6f}" for _ in range(3)) + "\n" for _ in range(5)) + "\n" * rnd.choice((0, 0, 1))
    return out


@pytest.mark.parametrize("size, variable", [(100, 0), (250, 1), (1 << 20, 1)])
def test_a_trajectory_file_is_read_in_splits(spark, tmp_path, size, variable):
    texts = {"A": long_trajectory(40, variable, 1), "B": long_trajectory(3, variable, 2)}
    paths = [write(tmp_path, n, t) for n, t in texts.items()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        found = blocks.trajectory(spark, paths, width=7)
        plain = [(r["path"][-1], *tuple(r)[1:]) for r in found.collect()]
        splits = spark.read.text(paths).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert splits >= sum(map(len, texts.values())) / max(size, 2000)
    wanted = [(n, *r[:6], [pytest.approx(x) for x in r[6]], r[7]) for n, t in texts.items() for r in blocks.parse_trajectory(t)]
    assert sorted(plain, key=lambda r: r[:3]) == sorted(wanted, key=lambda r: r[:3])


def test_bad_trajectory_files_are_refused(spark, tmp_path):
    good = long_trajectory(4, 1)
    for k, (bad, told) in enumerate((
        (good.rstrip()[:-40], "cut|no coordinates"), (good.replace("Direct configuration=     2", "Cartesian configuration=     2"), "kind of coordinates"), (good + long_trajectory(1, 0).replace("C H", "C O"), "atoms change"),
        (good.replace(" 4.0 0 0", " 0 0 0", 1), "degenerate"), (good.split("Direct")[0], "no frame"), ("Direct configuration= 1\n0 0 0\n", "no header"), (good.replace("Direct configuration=     3", "stray\nDirect configuration=     3"), "between frames"),
        (good.replace("0.", "x.", 3), "no coordinates"),
    )):
        with pytest.raises(ValueError, match=told):
            blocks.trajectory(spark, write(tmp_path, f"bad{k}", bad))


def test_inventory(spark, tmp_path):
    for d, names in (("a", ["EIGTXT"]), ("b", ["inp", "NATXT"]), ("c", ["inp"]), ("d", ["other"])):
        (tmp_path / d).mkdir()
        for n in names:
            write(tmp_path / d, n, "1\n")
    found = {r["dir"][-1]: r["is_run"] for r in blocks.inventory(spark, str(tmp_path)).collect()}
    assert found == {"a": True, "b": True, "c": False}
    assert blocks.fingerprints(spark, str(tmp_path / "a")).first()["length"] == 2


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([(1, 0.1, None), (2, float("nan"), "x")], "a int, b double, c string")
    sinks.write_csv(table, str(tmp_path / "csv"))
    with pytest.raises(Exception):
        sinks.write_csv(table, str(tmp_path / "csv"))
    sinks.write_json(table, str(tmp_path / "json"))
    lines = [json.loads(x["value"]) for x in spark.read.text(str(tmp_path / "json")).collect()]
    assert sorted((x["a"], x["b"]) for x in lines) == [(1, 0.1), (2, None)]
    master = spark.createDataFrame([(t, s, 0.1 + t / 3) for t in range(3) for s in ("a", "b")], "t int, state string, value double")
    sinks.write_master(master, str(tmp_path / "master"), ["a", "b"])
    back = sorted(spark.read.text(str(tmp_path / "master")).collect())
    assert [float(r["value"].split()[1]) for r in back] == [0.1, 0.1 + 1 / 3, 0.1 + 2 / 3]


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    pop = spark.createDataFrame([(h, t, s, (h + 1) * (t + 1) / 20 if s == "a" else 1 - (h + 1) * (t + 1) / 20) for h in range(3) for t in range(4) for s in ("a", "b")], "h int, t int, state string, p double")
    for h in range(3):
        pop.filter(F.col("h") == h).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = running_ensemble(history_stream(spark, str(tmp_path / "in")), 3)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    batch = running_ensemble(pop, 3)
    got = {(r["t"], r["state"]): r for r in spark.table("running").collect()}
    for r in batch.collect():
        s = got[r["t"], r["state"]]
        assert s["complete"] and s["mean"] == pytest.approx(r["mean"], abs=1e-12) and s["sem"] == pytest.approx(r["sem"], abs=1e-12)


def test_streamed_threshold_events_equal_batch(spark, tmp_path):
    from halyard.operators.transfer import threshold_events
    from halyard.streaming.events import running_threshold_events

    donor = ([0.95] * 4 + [0.05] * 3 + [0.5] * 2) * 3
    rows = [(h, t, d if h else 0.5, 1 - d if h else 0.5) for h in range(2) for t, d in enumerate(donor)]
    table = spark.createDataFrame(rows, "h int, t int, d double, a double")
    folder = str(tmp_path / "rows")
    query = None
    for k in range(3):
        table.filter(f"t div 9 = {k}").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(table.schema).parquet(folder)
        counted = running_threshold_events(stream, 0.9, 0.1)
        query = counted.writeStream.outputMode("update").format("memory").queryName(f"events{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        query.processAllAvailable()
        query.stop()
    last = {r["h"]: r["n_events"] for r in spark.table("events2").orderBy("t").collect()}
    batch = {r["h"]: r["n_events"] for r in threshold_events(table, spark.createDataFrame([(0.9, 0.1)], "high double, low double")).collect()}
    assert last == batch == {0: 0, 1: 3}
    with pytest.raises(ValueError):
        running_threshold_events(table, 0.1, 0.9)
