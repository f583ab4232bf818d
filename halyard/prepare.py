"""Campaign preparation: find frames and structures, propose a manifest, refuse what conflicts."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import AtomGroups


@dataclass(frozen=True)
class Frames:
    paths: dict[int, str]
    width: int | None
    gaps: tuple[int, ...]

    @property
    def regular(self) -> bool:
        return self.width is not None


def discover_frames(spark: SparkSession, root: str, name: str = "PROCAR") -> Frames:
    """Folders of digits that hold `name`; two spellings of one number are an error. Names are
    listed by Spark; one short row for each frame comes back."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    found = files.select(F.regexp_extract("path", rf"/(\d+)/{re.escape(name)}$", 1).alias("digits"), "path").filter("digits <> ''").collect()
    by: dict[int, str] = {}
    for r in found:
        if int(r["digits"]) in by:
            raise ValueError(f"frame {int(r['digits'])} is spelt twice")
        by[int(r["digits"])] = r["path"]
    widths = {len(r["digits"]) for r in found}
    numbers = sorted(by)
    gaps = tuple(sorted(set(range(numbers[0], numbers[-1] + 1)) - set(numbers))) if numbers else ()
    return Frames(dict(sorted(by.items())), widths.pop() if len(widths) == 1 else None, gaps)


def build_manifest(frames: Frames, root: str, name: str = "PROCAR", cycle_length: int | None = None) -> dict:
    """A pattern if the folders are regular and without gaps, an explicit list otherwise."""
    if cycle_length is not None and not set(range(1, cycle_length + 1)) <= set(frames.paths):
        raise ValueError(f"the cycle of {cycle_length} frames is not covered")
    if frames.regular and not frames.gaps and frames.paths:
        numbers = list(frames.paths)
        body = {"procar_pattern": os.path.join(root, f"{{frame:0{frames.width}d}}", name), "first": numbers[0], "last": numbers[-1]}
    else:
        body = {"frames": [{"frame": f, "procar": p} for f, p in frames.paths.items()]}
    return body | ({"cycle_length": cycle_length} if cycle_length is not None else {})


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """frame, path of a manifest, unique and positive; a declared cycle must be covered."""
    with open(path, encoding="utf-8") as f:
        body = json.load(f)
    if "procar_pattern" in body:
        rows = [(n, body["procar_pattern"].format(frame=n)) for n in range(body["first"], body["last"] + 1, body.get("step", 1))]
    else:
        base = os.path.dirname(path)
        rows = [(x["frame"], os.path.join(base, x["procar"])) for x in body["frames"]]
    numbers = [n for n, _ in rows]
    if len(set(numbers)) != len(numbers) or any(n < 1 for n in numbers):
        raise ValueError("frames are positive and unique")
    missing = set(range(1, body.get("cycle_length", 0) + 1)) - set(numbers)
    if missing:
        raise ValueError(f"the cycle lacks frames {sorted(missing)[:5]}")
    return spark.createDataFrame(rows, "frame int, path string")


def ion_count(text: str) -> int:
    """Ions of a structure file: the counts line is the sixth or the seventh."""
    lines = text.splitlines()
    for k in (5, 6):
        if k < len(lines) and lines[k].split() and all(x.isdigit() for x in lines[k].split()):
            return sum(map(int, lines[k].split()))
    raise ValueError("no counts line")


def find_structure(root: str, frames: Frames) -> str | None:
    """CONTCAR before POSCAR, the root before the first frame's folder."""
    first = os.path.dirname(next(iter(frames.paths.values()), "")).removeprefix("file:")
    for folder in filter(None, (root, first)):
        for name in ("CONTCAR", "POSCAR"):
            if os.path.exists(os.path.join(folder, name)):
                return os.path.join(folder, name)
    return None


def propose_cycle(frames: Frames, nsw: set[int]) -> tuple[int | None, str]:
    covered = max(frames.paths, default=0)
    if frames.gaps or not covered:
        return None, "not_covered"
    if not nsw:
        return None, "unknown"
    return (covered, "agreed") if nsw == {covered + 1} else (None, "ambiguous")


def infer_columns(rows: list[list[float]], n_states: int, time_column: int = 0) -> int:
    """The first column of the only block of n_states columns that holds shares of 1."""
    width = len(rows[0])
    fits = []
    for start in range(width - n_states + 1):
        if start <= time_column < start + n_states:
            continue
        part = [r[start : start + n_states] for r in rows]
        if all(abs(sum(p) - 1) <= 1e-5 and min(p) >= -1e-5 and max(p) <= 1 + 1e-5 for p in part):
            fits.append(start)
    if len(fits) != 1:
        raise ValueError(f"{len(fits)} blocks of {n_states} columns could be the populations")
    return fits[0]


def prepare(spark: SparkSession, root: str, out: str, groups: dict, nsw: set[int]) -> dict:
    """Write manifest, atom groups and a report, or nothing when they are not consistent."""
    frames = discover_frames(spark, root)
    structure = find_structure(root, frames)
    problems = [] if frames.paths else ["no frames"]
    ions = None
    if structure:
        with open(structure, encoding="utf-8") as f:
            ions = ion_count(f.read())
    try:
        AtomGroups.from_dict(groups, ions)
    except ValueError as e:
        problems.append(str(e))
    cycle, how = propose_cycle(frames, nsw)
    report = {"frames": len(frames.paths), "gaps": list(frames.gaps), "ions": ions, "cycle_length": cycle, "cycle": how, "problems": problems}
    if not problems:
        os.makedirs(out, exist_ok=False)
        for name, body in (("manifest.json", build_manifest(frames, root, cycle_length=cycle)), ("atom_groups.json", groups), ("report.json", report)):
            with open(os.path.join(out, name), "w", encoding="utf-8") as f:
                json.dump(body, f, indent=1)
    return report
