"""From a campaign's files to its projected populations.

Histories (text tables), the state map, the atom groups and the manifest of projection files
give the populations of each history projected on fragments, their exact split, and the mean
over histories. Rows keep their shares as one array from the file on, so nothing is multiplied
out; only the projection files of frames that some history visits are opened.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import AtomGroups, StateMap, resolve_bands, resolve_period, resolve_start
from .operators import character, ensemble, events
from .plans.template import bind
from .prepare import load_manifest
from .sources.blocks import projections
from .sources.tables import couplings, numeric_table, state_energies, table_metadata

#: How far a share may lie outside [0, 1] and a total from 1, and the least captured weight.
SHARE_TOLERANCE, LEAST_CAPTURED = 1e-5, 1e-14
PER_NS = {"fs": 1e6, "ps": 1e3, "ns": 1.0}


@dataclass
class Plan:
    """What a run will read and how it is aligned; nothing is read in full before it holds."""

    rows: DataFrame
    starts: dict[str, int]
    bands: list[int]
    bands_from: str
    period: int | None
    manifest: DataFrame
    n_rows: int
    #: frame: the frames that some history visits
    frames: DataFrame
    problems: list[str] = field(default_factory=list)


def _headers(spark: SparkSession, paths) -> dict[str, dict[str, str]]:
    """The header values of each history; one row for each file and key reaches the driver."""
    out: dict[str, dict[str, str]] = {}
    for r in table_metadata(spark, paths).collect():
        out.setdefault(r["path"], {})[r["key"]] = r["value"]
    return out


def plan(
    spark: SparkSession, paths, state_map: StateMap, manifest: str, *, mode: str = "cyclic", period: int | None = None,
) -> Plan:
    """Rows, starts, bands, period and required frames, with every problem found on the way."""
    problems: list[str] = []

    def attempt(f, default):
        try:
            return f()
        except ValueError as e:
            problems.append(str(e))
            return default

    table = numeric_table(spark, paths, keep=True)
    shapes = table.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("cols")).alias("width")).collect()
    if len({(r["n"], r["width"]) for r in shapes}) > 1:
        problems.append(f"histories differ in shape: {sorted({(r['n'], r['width']) for r in shapes})}")
    width, n_rows = min(r["width"] for r in shapes), min(r["n"] for r in shapes)
    columns = list(state_map.population_columns)
    if max(columns + [state_map.time_column]) >= width:
        problems.append(f"the state map names a column beyond the {width} of the histories")
    headers = _headers(spark, paths)
    number = lambda path, key: attempt(lambda: int(float(headers.get(path, {})[key])), None) if key in headers.get(path, {}) else None
    files = sorted(r["path"] for r in shapes)
    starts = {f: attempt(lambda f=f: resolve_start(number(f, "NAMDTINI"), f)[0], 1) for f in files}
    windows = [(a, b) for f in files if (a := number(f, "BMIN")) is not None and (b := number(f, "BMAX")) is not None]
    bands, bands_from, odd = attempt(lambda: resolve_bands(list(state_map.band_numbers) if state_map.band_numbers else None, None, windows), ([], "", []))
    if odd:
        problems.append(f"headers name other bands: {sorted(set(odd))}")
    if len(bands) != len(columns):
        problems.append(f"{len(bands)} bands for {len(columns)} population columns")
    rows_of = attempt(lambda: load_manifest(spark, manifest), spark.createDataFrame([], "frame int, path string"))
    if mode == "cyclic" and period is None:
        nsw = [number(f, "NSW") for f in files]
        period = attempt(lambda: resolve_period(mode, None, nsw), None) if any(nsw) else rows_of.agg(F.max("frame")).first()[0]
    # the steps of one cycle, or all rows, from each start: as many as that, however many histories there are
    steps = spark.range(min(n_rows, period or n_rows)).withColumn("start", F.explode(F.array(*(F.lit(s) for s in sorted(set(starts.values()))))))
    at = F.col("start") + F.col("id")
    frames = steps.select((F.pmod(at - 1, F.lit(period)) + 1 if period else at).cast("int").alias("frame")).distinct()
    missing = frames.join(rows_of.select("frame"), "frame", "left_anti")
    n_missing = missing.count()
    if n_missing:
        problems.append(f"{n_missing} required frames are not in the manifest, the first {[r[0] for r in missing.orderBy('frame').limit(5).collect()]}")
    # shares in order of the bands, as the weights will be
    order = [c for _, c in sorted(zip(bands, columns))]
    # one row for each file
    begun = F.broadcast(spark.createDataFrame(sorted(starts.items()), "path string, start int"))
    at = F.col("start") + F.col("row_idx")
    rows = table.join(begun, "path").select(
        F.col("path").alias("h"), F.col("row_idx").alias("t"), (F.col("cols")[state_map.time_column] / F.lit(PER_NS[state_map.time_unit])).alias("time_ns"),
        F.array(*[F.col("cols")[c] for c in order]).alias("p"), (F.pmod(at - 1, F.lit(period)) + 1 if period else at).cast("int").alias("frame"),
    )
    return Plan(rows, starts, bands, bands_from, period, rows_of, n_rows, frames, problems)


def checked(rows: DataFrame, complete: bool) -> list[str]:
    """What is wrong with the shares and times of the histories: one pass, a few numbers back."""
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    r = rows.agg(
        F.min(F.array_min("p")).alias("least"), F.max(F.array_max("p")).alias("most"), F.max(F.abs(total - 1)).alias("off"), F.count_distinct("t", "time_ns").alias("points"), F.count_distinct("t").alias("ts")
    ).first()
    out = []
    if r["least"] < -SHARE_TOLERANCE or r["most"] > 1 + SHARE_TOLERANCE:
        out.append(f"shares from {r['least']} to {r['most']}")
    if complete and r["off"] > SHARE_TOLERANCE:
        out.append(f"totals off by {r['off']}")
    if r["points"] != r["ts"]:
        out.append("the histories are not on one grid of times")
    return out


def weights(spark: SparkSession, made: Plan, atoms: AtomGroups) -> DataFrame:
    """Normalised fragment weights of the required frames and bands."""
    needed = made.manifest.join(made.frames, "frame", "left_semi")
    out = character.fragment_weights(projections(spark, needed, made.bands), atoms.frame(spark)).persist()
    low = out.filter(F.col("captured") <= max(LEAST_CAPTURED, atoms.min_projection_weight)).select("frame", "band").distinct().limit(5).collect()
    if low:
        raise ValueError(f"hardly any weight on the atom groups: {[tuple(r) for r in low]}")
    return out


def _prepared(spark: SparkSession, paths, state_map: StateMap, atoms: AtomGroups, manifest: str, mode: str, period: int | None) -> tuple[Plan, DataFrame, DataFrame]:
    """The plan, the weights and the rows with their frames of a campaign's files; all problems are raised together."""
    made = plan(spark, paths, state_map, manifest, mode=mode, period=period)
    problems = made.problems or checked(made.rows, state_map.complete_population)
    if problems:
        raise ValueError("; ".join(problems))
    table = weights(spark, made, atoms)
    return made, table, made.rows.select("h", "t", "p", "frame")


def character_populations(
    spark: SparkSession, paths, state_map: StateMap, atoms: AtomGroups, manifest: str, *, mode: str = "cyclic", period: int | None = None,
) -> dict[str, DataFrame]:
    """weights, split and mean (t, time_ns, grp, mean, sem, occ, chr) of a campaign's files."""
    made, table, rows = _prepared(spark, paths, state_map, atoms, manifest, mode, period)
    parts = character.split_blocks(rows, None, table)
    times = made.rows.filter(F.col("h") == min(made.starts)).select("t", "time_ns")
    mean = character.projected_mean(parts).join(times, "t").select("t", "time_ns", "grp", "mean", "sem", "occ", "chr")
    return {"weights": table, "split": parts, "mean": mean}


def _of_bands(table: DataFrame, bands: list[int], *columns: str) -> DataFrame:
    """The columns' places as band numbers; places beyond the bands are left out."""
    listed = F.array(*(F.lit(b) for b in sorted(bands)))
    for c in columns:
        table = table.filter(F.col(c) < len(bands)).withColumn(c, listed[F.col(c)])
    return table


def character_crossings(
    spark: SparkSession, paths, state_map: StateMap, atoms: AtomGroups, manifest: str, energies: str, nac: str, *, mode: str = "cyclic", period: int | None = None, windows: DataFrame | None = None,
    **params,
) -> dict[str, DataFrame]:
    """Crossing events of the frames and of each history's own walk, their counts by history and by
    window of rows (windows: name, lo, hi), descriptors, swaps and the sensitivity to the thresholds.

    energies and nac: text tables of a row for each frame, columns in order of the bands. params: thresholds, as in
    plans/template.py."""
    made, table, rows = _prepared(spark, paths, state_map, atoms, manifest, mode, period)
    e = _of_bands(state_energies(spark, energies), made.bands, "state")
    v = _of_bands(couplings(spark, nac), made.bands, "i", "j")
    found = events.history_events(character.split_arrays(rows, None, table), table, e, v, **params).persist()
    out = {
        "frame_events": events.frame_events(table, e, v, **params), "history_events": found, "counts": bind(events.COUNTS, params=params, events=found),
        "descriptors": bind(events.DESCRIPTORS, params=params, events=found), "sensitivity": bind(events.SENSITIVITY, params=params, weights=table, energies=e, nac=v),
        "swaps": bind(character.SWAPS, params={"period": made.period or 0} | params, weights=table),
    }
    if windows is not None:
        out["window_counts"] = found.join(F.broadcast(windows), found["t"].between(windows["lo"], windows["hi"])).groupBy("name", "classification").agg(F.count(F.lit(1)).alias("n"))
    return out


def character_ensemble(
    spark: SparkSession, paths, state_map: StateMap, atoms: AtomGroups, manifest: str, *, mode: str = "cyclic", period: int | None = None, frame_windows: DataFrame | None = None, **params,
) -> dict[str, DataFrame]:
    """What each history does and what they do together: net and late changes, their statistics,
    the term that dominates, curves of quantiles and, with frame_windows(name, lo, hi), the
    response of each pass through them, its verdict and summary."""
    made, table, rows = _prepared(spark, paths, state_map, atoms, manifest, mode, period)
    parts = character.split_blocks(rows, None, table)
    each = ensemble.histories(parts, **params).persist()
    out = {
        "histories": each, "summary": bind(ensemble.STATS, params=params, quantities=bind(ensemble.QUANTITIES, histories=each)),
        "dominant_term": bind(ensemble.DOMINANT_TERM, params=params, histories=each), "curve": bind(ensemble.CURVE, params=params, split=parts),
    }
    if frame_windows is not None:
        if made.period is None:
            raise ValueError("passes need a period")
        walk = made.rows.select("h", "t", "frame")
        passes = bind(ensemble.PER_PASS, params=params | {"period": made.period}, split=parts.select("h", "t", "grp", "occ", "chr"), rows_frames=walk, frame_windows=F.broadcast(frame_windows)).persist()
        out |= {"passes": passes, "verdicts": bind(ensemble.STEP_VERDICT, params=params, passes=passes), "episodes": bind(ensemble.EPISODE_SUMMARY, params=params, passes=passes)}
    return out
