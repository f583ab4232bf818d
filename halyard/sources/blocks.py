"""Block formats, one file a frame or a trajectory: projections by ion, positions.

A projection file is one frame and is parsed whole; a trajectory file is read in splits, however large.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered
from ..session import ship_code
from .tables import _lines, _numbered

_COUNTS = re.compile(r"#\s*of\s*k-points:\s*(\d+)\s*#\s*of\s*bands:\s*(\d+)\s*#\s*of\s*ions:\s*(\d+)")
_BAND = re.compile(r"^\s*band\s+(\d+)\s*#\s*energy\s+(\S+)")
TINY = -1e-12


def parse_projections(text: str, bands: set[int] | None = None) -> list[tuple[int, float, int, float]]:
    """(band, energy, ion, tot) of the first ion table of each band."""
    lines = text.lstrip("﻿").splitlines()
    declared = [m for line in lines if (m := _COUNTS.search(line))]
    if not declared:
        raise ValueError("no counts line")
    if len(declared) > 1 or int(declared[0][1]) != 1:
        raise ValueError("one k-point and one spin are expected")
    n_bands, n_ions = int(declared[0][2]), int(declared[0][3])
    out, seen, band, energy, next_ion = [], set(), None, 0.0, 0
    for line in lines:
        if m := _BAND.match(line):
            if next_ion:
                raise ValueError(f"band {band} ends before ion {next_ion}")
            band, energy = int(m[1]), float(m[2])
            if band in seen:
                raise ValueError(f"band {band} is there twice")
            seen.add(band)
            state = "header"
        elif band is not None and line.split()[:1] == ["ion"] and state == "header":
            if line.split()[-1] != "tot":
                raise ValueError("an ion table without totals")
            state, next_ion = "ions", 1
        elif band is not None and next_ion and line.strip():
            parts = line.split()
            if int(parts[0]) != next_ion:
                raise ValueError(f"band {band}: ion {parts[0]} where {next_ion} is due")
            value = float(parts[-1])
            if not np.isfinite(value) or value < TINY:
                raise ValueError(f"band {band}, ion {next_ion}: {value}")
            if bands is None or band in bands:
                out.append((band, energy, next_ion, max(value, 0.0)))
            next_ion = next_ion + 1 if next_ion < n_ions else 0
            state = "done" if not next_ion else state
    if next_ion or len(seen) != n_bands:
        raise ValueError(f"{len(seen)} of {n_bands} bands, the last one {'cut off' if next_ion else 'whole'}")
    return out


def projections(spark: SparkSession, manifest: DataFrame, bands: list[int] | None = None) -> DataFrame:
    """frame, band, energy, ion, tot. manifest(frame, path): only its files are opened, so a
    semi join on the required frames before this prunes the rest."""
    ship_code(spark)
    wanted = set(bands) if bands is not None else None
    files = manifest.select("frame", "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for frame, content in zip(pdf["frame"], pdf["content"]):
                rows = parse_projections(bytes(content).decode("utf-8-sig"), wanted)
                yield pd.DataFrame([(frame, *r) for r in rows], columns=["frame", "band", "energy", "ion", "tot"])

    paths = [r["path"] for r in files.select("path").distinct().collect()]  # one name for each required file
    content = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), "content")
    return files.join(content, "path").select("frame", "content").mapInPandas(run, "frame int, band int, energy double, ion int, tot double")


def scaled_cell(cell: np.ndarray, scale: float) -> np.ndarray:
    """A positive scale multiplies, a negative one names the volume."""
    volume = abs(np.linalg.det(cell))
    if scale == 0 or volume < 1e-12:
        raise ValueError("a degenerate cell")
    return cell * (scale if scale > 0 else (-scale / volume) ** (1 / 3))


def parse_trajectory(text: str) -> list[tuple[int, int, str, float, float, float, list[float], bool]]:
    """(frame, atom, symbol, x, y, z, cell, direct) of a multi-frame file, with one header or
    one before each frame."""
    lines, at, out, frame = text.splitlines(), 0, [], 0
    cell, names, direct_first = None, [], None
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        if not re.match(r"\s*(Direct|Cartesian)\s+configuration", lines[at], re.I):
            if len(lines) < at + 7:
                raise ValueError("a cut header")
            scale = float(lines[at + 1])
            cell = scaled_cell(np.array([list(map(float, lines[at + k].split()[:3])) for k in (2, 3, 4)]), scale)
            symbols, counts = lines[at + 5].split(), list(map(int, lines[at + 6].split()))
            new = [s for s, n in zip(symbols, counts) for _ in range(n)]
            if names and new != names:
                raise ValueError("the atoms change")
            names, at = new, at + 7
            continue
        direct = lines[at].strip().lower().startswith("direct")
        if direct_first is None:
            direct_first = direct
        if direct != direct_first or cell is None:
            raise ValueError("the kind of coordinates changes" if cell is not None else "a frame without header")
        frame += 1
        block = lines[at + 1 : at + 1 + len(names)]
        if len(block) < len(names):
            raise ValueError(f"frame {frame} is cut off")
        for k, line in enumerate(block):
            x, y, z = map(float, line.split()[:3])
            out.append((frame, k, names[k], x, y, z, cell.ravel().tolist(), direct))
        at += 1 + len(names)
    return out


_FRAME_LINE = r"(?i)^\s*(Direct|Cartesian)\s+configuration"
#: Lines of a header: title, scale, three cell vectors, symbols, counts.
_HEADER = 7


def _numbers(line: str) -> str:
    """The first three words of a line as numbers, null where one is none."""
    return f"transform(slice(split(trim({line}), '\\\\s+'), 1, 3), x -> try_cast(x AS DOUBLE))"


def trajectory(spark: SparkSession, paths: str | list[str], width: int = ordered.WIDTH) -> DataFrame:
    """path, frame, atom, symbol, x, y, z, cell, direct of multi-frame files of any size.

    Lines are read as splittable text, so one file is many tasks' work. A line knows its frame by the last frame line
    before it, which is carried over the edges of the file's blocks; a frame knows its cell by the last
    header before it. Files whose frames are cut, whose atoms or kind of coordinates change, whose cell is degenerate or
    that hold no frame are errors, told by file."""
    lines = _lines(spark, paths).filter(~F.col("value").rlike(r"^\s*$"))
    numbered = _numbered(lines, "line_no", keep=["block"])
    starts = F.when(F.col("value").rlike(_FRAME_LINE), F.col("line_no"))
    # the file's own blocks are the blocks of the scan
    placed = ordered.last_seen(numbered.withColumn("start", starts), ["path"], "line_no", "start", "of_frame")
    placed = placed.select("path", "line_no", F.coalesce("of_frame", F.lit(-1)).alias("of_frame"), "value")
    first = placed.filter((F.col("of_frame") < 0) & (F.col("line_no") < _HEADER)).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("h"))
    atoms = first.filter(F.size("h") == _HEADER).select("path", F.expr("split(trim(h[5].value), '\\\\s+')").alias("symbols"), F.expr("transform(split(trim(h[6].value), '\\\\s+'), x -> try_cast(x AS INT))").alias("counts"))
    atoms = atoms.withColumn("names", F.expr("flatten(transform(arrays_zip(symbols, counts), x -> array_repeat(x.symbols, coalesce(x.counts, 0))))"))
    # one row a file, and as many names as a frame has atoms
    told = placed.join(atoms, "path").withColumn("k", (F.col("line_no") - F.col("of_frame") - 1).cast("int"))
    inside = (F.col("of_frame") >= 0) & (F.col("k") < F.size("names"))
    rows = told.filter(inside & (F.col("k") >= 0)).select("path", "of_frame", F.col("k").alias("atom"), F.col("names")[F.col("k")].alias("symbol"), F.expr(_numbers("value")).alias("at"))
    # a header stands before the first frame, or after the atoms of one
    held = told.filter(~inside).groupBy("path", "of_frame").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("h"))
    held = held.select(
        "path", "of_frame", (F.size("h") == _HEADER).alias("whole"),
        F.expr("try_cast(split(trim(h[1].value), '\\\\s+')[0] AS DOUBLE)").alias("scale"), F.expr(f"flatten(transform(slice(h, 3, 3), x -> {_numbers('x.value')}))").alias("vectors"),
        F.sha2(F.concat_ws(" ", F.expr("split(trim(h[5].value), '\\\\s+')"), F.expr("split(trim(h[6].value), '\\\\s+')")), 256).alias("atoms_as"),
    )
    held = held.select("path", "of_frame", "whole", "atoms_as", F.when(F.size("vectors") == 9, scaled("scale", "vectors")).alias("cell"))
    marks = placed.filter(F.col("of_frame") == F.col("line_no")).select("path", F.col("of_frame"), F.lower(F.trim("value")).startswith("direct").alias("direct"))
    blocks = ordered.dealt(marks, ["path"], "of_frame", width)
    counted = ordered.running_sum(blocks.withColumn("one", F.lit(1)), ["path"], "of_frame", "one", "frame")
    ahead = ordered.with_previous(counted, ["path"], "of_frame", ["of_frame"]).withColumn("header", F.coalesce("previous.of_frame", F.lit(-1)))
    headed = ahead.drop("previous").join(held.select("path", F.col("of_frame").alias("header"), F.col("cell").alias("own_cell")), ["path", "header"], "left")
    frames = ordered.last_seen(headed, ["path"], "of_frame", "own_cell", "cell").select("path", "of_frame", F.col("frame").cast("int").alias("frame"), "direct", "cell")
    _check_trajectory(placed, atoms, rows, held, frames)
    return rows.join(frames, ["path", "of_frame"]).select("path", "frame", "atom", "symbol", F.col("at")[0].alias("x"), F.col("at")[1].alias("y"), F.col("at")[2].alias("z"), "cell", "direct")


def scaled(scale: str, vectors: str):
    """The cell's nine numbers, scaled: a positive scale multiplies, a negative one names the volume; null where the
    cell is degenerate."""
    v = [F.col(vectors)[k] for k in range(9)]
    volume = F.abs(v[0] * (v[4] * v[8] - v[5] * v[7]) - v[1] * (v[3] * v[8] - v[5] * v[6]) + v[2] * (v[3] * v[7] - v[4] * v[6]))
    factor = F.when(F.col(scale) > 0, F.col(scale)).otherwise(F.pow(-F.col(scale) / volume, F.lit(1 / 3)))
    return F.when((F.col(scale) != 0) & (volume >= 1e-12), F.transform(vectors, lambda x: x * factor))


def _check_trajectory(placed: DataFrame, atoms: DataFrame, rows: DataFrame, held: DataFrame, frames: DataFrame) -> None:
    """One pass of counts, a row for each file."""
    size = F.count(F.lit(1))
    bad = F.exists("at", lambda x: x.isNull()) | (F.size("at") < 3)
    per_frame = rows.groupBy("path", "of_frame").agg(size.alias("n"), F.count_if(bad).alias("bad"))
    per_frame = frames.join(per_frame, ["path", "of_frame"], "left").join(atoms.select("path", F.size("names").alias("n_atoms"), F.exists("counts", lambda x: x.isNull()).alias("odd")), "path")
    a = per_frame.groupBy("path").agg(
        size.alias("frames"), F.count_if(F.coalesce("n", F.lit(0)) < F.col("n_atoms")).alias("cut"), F.sum("bad").alias("bad"), F.count_distinct("direct").alias("kinds"),
        F.count_if(F.col("cell").isNull()).alias("cells"), F.max((F.col("n_atoms") < 1) | F.col("odd")).alias("none"),
    )
    b = held.groupBy("path").agg(F.count_if(~F.col("whole")).alias("headers"), F.count_distinct("atoms_as").alias("atoms"), F.count_if(F.col("cell").isNull()).alias("flat"))
    found = {r["path"]: r for r in a.join(b, "path", "left").collect()}
    for path in sorted(r["path"] for r in placed.select("path").distinct().collect()):
        r = found.get(path)
        if r is None or r["none"]:
            raise ValueError(f"{path}: no header with symbols and counts, or no frame")
        for name, message in (("headers", "a header is cut or a line stands between frames"), ("cut", "frames are cut off"), ("bad", "lines hold no coordinates"), ("cells", "a cell is degenerate"), ("flat", "a cell is degenerate")):
            if r[name]:
                raise ValueError(f"{path}: {message} ({r[name]})")
        if r["kinds"] > 1 or r["atoms"] > 1:
            raise ValueError(f"{path}: the kind of coordinates or the atoms change")

def inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row for each folder with run files: its known files and whether it is a run."""
    known = ["EIGTXT", "NATXT", "inp", "INICON", "DEPHTIME"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(
        F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"), F.regexp_extract("path", r"/([^/]+)$", 1).alias("name"), "length"
    )
    return (
        files.filter(F.col("name").isin(known) & ~F.col("dir").contains("__MACOSX"))
        .groupBy("dir")
        .agg(F.sort_array(F.collect_set("name")).alias("files"), F.sum("length").alias("bytes"))
        .withColumn("is_run", F.array_contains("files", "EIGTXT") | (F.array_contains("files", "inp") & F.array_contains("files", "NATXT")))
    )


def fingerprints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))
