"""Trajectories and spectra: velocities, autocorrelations, tapers, spectral densities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.template import bind
from ..session import ship_code
from . import ordered
from .audit import INV_FS_TO_CM1

MAX_LAG = 10

# minimum image: the step minus its nearest whole cell, halves to even; as windows over whole
# trajectories, which velocities must equal
VELOCITIES = """
SELECT frame, atom, dx - EVEN(dx) AS vx, dy - EVEN(dy) AS vy, dz - EVEN(dz) AS vz
FROM (SELECT frame, atom, lead(x) OVER (PARTITION BY atom ORDER BY frame) - x AS dx, lead(y) OVER (PARTITION BY atom ORDER BY frame) - y AS dy,
             lead(z) OVER (PARTITION BY atom ORDER BY frame) - z AS dz FROM {traj}) a WHERE dx IS NOT NULL"""

COM_REMOVED = """
SELECT frame, atom, m, vx - sum(m * vx) OVER (PARTITION BY frame) / sum(m) OVER (PARTITION BY frame) AS vx,
       vy - sum(m * vy) OVER (PARTITION BY frame) / sum(m) OVER (PARTITION BY frame) AS vy, vz - sum(m * vz) OVER (PARTITION BY frame) / sum(m) OVER (PARTITION BY frame) AS vz
FROM (SELECT v.*, a.mass AS m FROM {velocities} v JOIN {atoms} a ON a.atom = v.atom) x"""

VACF = """
SELECT CAST(lag AS INT) AS lag, sum(m * c) / sum(m) AS vacf
FROM (SELECT a.atom, max(a.m) AS m, b.lag, avg(a.vx * b.vx + a.vy * b.vy + a.vz * b.vz) AS c
      FROM {moving} a JOIN {shifted} b ON a.atom = b.atom AND a.frame = b.frame0 GROUP BY a.atom, b.lag) x GROUP BY lag"""

# each row once for each lag, at the frame that many before its own: the join is on atom and frame
SHIFTED = "SELECT atom, frame, vx, vy, vz, lag, frame - lag AS frame0 FROM {moving} LATERAL VIEW explode(sequence(0, :max_lag)) AS lag"

SEGMENTED = """
SELECT lag, avg(c) AS vacf, count(*) AS n_segments
FROM (SELECT segment, CAST(b_frame - a_frame AS INT) AS lag, avg(c) AS c
      FROM (SELECT CAST(floor((a.frame - 1) / :segment) AS INT) AS segment, a.frame AS a_frame, b.frame AS b_frame, a.vx * b.vx + a.vy * b.vy + a.vz * b.vz AS c
            FROM {moving} a JOIN {shifted} b ON a.atom = b.atom AND a.frame = b.frame0 AND floor((a.frame - 1) / :segment) = floor((b.frame - 1) / :segment)) y
      GROUP BY segment, b_frame - a_frame) z GROUP BY lag"""

TAPERED = """
SELECT lag, vacf, vacf * (0.5 - 0.5 * cos(2 * pi() * lag / CAST(:max_lag AS DOUBLE))) AS hann, vacf * (0.54 - 0.46 * cos(2 * pi() * lag / CAST(:max_lag AS DOUBLE))) AS hamming FROM {vacf}"""

DIAGNOSTICS = """
SELECT min(CASE WHEN vacf <= 0 THEN lag END) AS zero_crossing, sum(coalesce(0.5 * (norm + norm0), 0)) AS correlation_time
FROM (SELECT lag, vacf, vacf / first_value(vacf) OVER (ORDER BY lag) AS norm, lag(vacf) OVER (ORDER BY lag) / first_value(vacf) OVER (ORDER BY lag) AS norm0 FROM {vacf}) a"""

COSINE = f"""
SELECT k, k * {INV_FS_TO_CM1}D / CAST(:max_lag + 1 AS DOUBLE) AS f_cm1, 2 * sum(vacf * cos(2 * pi() * k * lag / CAST(:max_lag + 1 AS DOUBLE))) - min_by(vacf, lag) AS intensity
FROM {{vacf}} CROSS JOIN (SELECT DISTINCT lag AS k FROM {{vacf}} WHERE lag BETWEEN 1 AND (:max_lag + 1) / 2) f GROUP BY k"""

BAND_INTEGRAL = """
SELECT label, CASE WHEN count(*) < 2 THEN NULL ELSE sum(coalesce(0.5 * (y + y0) * (f - f0), 0)) END AS integral,
       CASE WHEN min(y) < 0 OR sum(y) <= 0 THEN NULL ELSE sum(coalesce(0.5 * (y * f + y0 * f0) * (f - f0), 0)) / sum(coalesce(0.5 * (y + y0) * (f - f0), 0)) END AS centroid,
       count_if(y < 0) AS n_negative
FROM (SELECT label, f, y, lag(y) OVER (PARTITION BY label ORDER BY f) AS y0, lag(f) OVER (PARTITION BY label ORDER BY f) AS f0 FROM {spectrum} WHERE f BETWEEN :low AND :high) a GROUP BY label"""

# trapezoids between neighbouring points that both lie in a range; a range with fewer than two points has none.
# A range is a row of ranges(low, high), so the join is on ranges; they are a few and broadcast
RANGE_INTEGRALS = """
SELECT label, low, high, CASE WHEN count(*) >= 2 THEN sum(coalesce(0.5 * (y + y0) * (f - f0), 0)) END AS integral,
       CASE WHEN count(*) >= 2 AND min(y) >= 0 AND sum(coalesce(0.5 * (y + y0) * (f - f0), 0)) > 0
            THEN sum(coalesce(0.5 * (y * f + y0 * f0) * (f - f0), 0)) / sum(coalesce(0.5 * (y + y0) * (f - f0), 0)) END AS centroid,
       count_if(y < 0) AS n_negative
FROM (SELECT s.label, r.low, r.high, s.f, s.y, CASE WHEN s.f0 >= r.low THEN s.f0 END AS f0, CASE WHEN s.f0 >= r.low THEN s.y0 END AS y0
      FROM (SELECT label, f, y, lag(f) OVER (PARTITION BY label ORDER BY f) AS f0, lag(y) OVER (PARTITION BY label ORDER BY f) AS y0 FROM {spectrum}) s
      JOIN {ranges} r ON s.f BETWEEN r.low AND r.high) a GROUP BY label, low, high"""

SHAPE = """
SELECT label, count(*) AS n_points, min(f) AS f_least, max(f) AS f_most, max(CASE WHEN place = 2 THEN f END) - min(f) AS resolution
FROM (SELECT label, f, row_number() OVER (PARTITION BY label ORDER BY f) AS place FROM {spectrum}) a GROUP BY label"""

DESCRIBED = """
SELECT s.label, s.n_points, s.f_least, s.f_most, s.resolution, w.integral AS range_integral, coalesce(w.n_negative, 0) AS n_negative, w.centroid
FROM {shape} s LEFT JOIN {whole} w ON w.label = s.label"""

BANDS = """
SELECT s.label, b.low, b.high, i.integral, i.integral / nullif(w.integral, 0) AS fraction
FROM {shape} s CROSS JOIN {bands} b LEFT JOIN {inside} i ON i.label = s.label AND i.low = b.low AND i.high = b.high LEFT JOIN {whole} w ON w.label = s.label"""

# points meet by their place in their own spectrum, not by frequency: a shifted grid must show
SHARED_GRID = """
SELECT p.label, max(p.n) AS n_points, max(r.n) AS n_reference, max(abs(p.f - r.f)) AS grid_difference, max(p.n) = max(r.n) AND max(abs(p.f - r.f)) <= :grid AS shared
FROM (SELECT label, f, row_number() OVER (PARTITION BY label ORDER BY f) AS place, count(*) OVER (PARTITION BY label) AS n FROM {spectrum}) p
LEFT JOIN (SELECT f, row_number() OVER (ORDER BY f) AS place, count(*) OVER () AS n FROM {spectrum} WHERE label = :reference_label) r ON r.place = p.place GROUP BY p.label"""

# nothing is compared unless all spectra share one grid
COMPARED = """
SELECT d.label, b.low, b.high, b.fraction - rb.fraction AS delta_fraction, b.integral / nullif(rb.integral, 0) AS ratio_of_integral,
       d.centroid - rd.centroid AS delta_centroid, d.range_integral / nullif(rd.range_integral, 0) AS ratio_range_integral
FROM {described} d JOIN {band_rows} b ON b.label = d.label JOIN {band_rows} rb ON rb.low = b.low AND rb.high = b.high AND rb.label = :reference_label
JOIN {described} rd ON rd.label = :reference_label CROSS JOIN (SELECT min(CASE WHEN shared THEN 1 ELSE 0 END) AS every FROM {grids}) g
WHERE d.label <> :reference_label AND g.every = 1"""

PEAKS = """
SELECT label, f, y FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY y DESC, f) AS place
  FROM (SELECT label, f, y, lag(y) OVER (PARTITION BY label ORDER BY f) AS before, lead(y) OVER (PARTITION BY label ORDER BY f) AS after, max(y) OVER (PARTITION BY label) AS top FROM {spectrum}) a
  WHERE y > before AND y > after AND y >= :rel_height * top) b WHERE place <= :max_peaks"""

SMOOTH = """
SELECT s.label, s.idx, sum(r.y * k.weight) / sum(k.weight) AS y
FROM {indexed} s CROSS JOIN {kernel} k
JOIN {indexed} r ON r.label = s.label AND r.idx = CASE WHEN s.idx + k.offset < 0 THEN -(s.idx + k.offset) - 1 WHEN s.idx + k.offset >= :length THEN 2 * :length - 1 - (s.idx + k.offset) ELSE s.idx + k.offset END
GROUP BY s.label, s.idx"""


#: Ranges of the default report in wave numbers: fixed values.
DEFAULT_BANDS = [(0.0, 50.0), (50.0, 100.0), (100.0, 200.0), (200.0, 400.0), (400.0, 800.0)]
DEFAULT_RANGE = (0.0, 800.0)


def ranges(spark, bands: list[tuple[float, float]]) -> DataFrame:
    """low, high: a few ranges, broadcast."""
    return F.broadcast(spark.createDataFrame([(float(a), float(b)) for a, b in bands], "low double, high double"))


def band_rows(spectrum: DataFrame, bands: list[tuple[float, float]] = DEFAULT_BANDS, span: tuple[float, float] = DEFAULT_RANGE) -> DataFrame:
    """label, low, high, integral, fraction (of the integral over span) for each spectrum and band."""
    spark = spectrum.sparkSession
    inside = bind(RANGE_INTEGRALS, spectrum=spectrum, ranges=ranges(spark, bands))
    whole = bind(RANGE_INTEGRALS, spectrum=spectrum, ranges=ranges(spark, [span]))
    return bind(BANDS, shape=bind(SHAPE, spectrum=spectrum), bands=ranges(spark, bands), inside=inside, whole=whole)


def described(spectrum: DataFrame, span: tuple[float, float] = DEFAULT_RANGE) -> DataFrame:
    """label, n_points, f_least, f_most, resolution, range_integral, n_negative, centroid of each spectrum."""
    whole = bind(RANGE_INTEGRALS, spectrum=spectrum, ranges=ranges(spectrum.sparkSession, [span]))
    return bind(DESCRIBED, shape=bind(SHAPE, spectrum=spectrum), whole=whole)


def shared_grid(spectrum: DataFrame, **params) -> DataFrame:
    """label, n_points, n_reference, grid_difference, shared: is each spectrum on the reference's grid?
    It is if it has as many points and each lies within :grid of the reference's at the same place."""
    return bind(SHARED_GRID, params=params, spectrum=spectrum)


def compare(spectrum: DataFrame, bands: list[tuple[float, float]] = DEFAULT_BANDS, span: tuple[float, float] = DEFAULT_RANGE, **params) -> DataFrame:
    """Each spectrum's bands against the reference's; no rows unless all spectra share its grid."""
    reference = {k: v for k, v in params.items() if k == "reference_label"}
    return bind(
        COMPARED, params=reference, described=described(spectrum, span), band_rows=band_rows(spectrum, bands, span), grids=shared_grid(spectrum, **params)
    )


def velocities(traj: DataFrame, *, dt: float = 1.0, unwrap: bool = True, cells: DataFrame | None = None, width: float = ordered.WIDTH) -> DataFrame:
    """frame, atom, vx, vy, vz of traj(frame, atom, x, y, z): each frame's step to the next, over dt.

    Positions are fractional; unwrap takes the step's minimum image. cells(frame, cell), nine numbers row by row, makes the
    velocities Cartesian."""
    if dt <= 0:
        raise ValueError("a time step is above 0")
    axes = ["x", "y", "z"]
    # the row before is the frame a step starts from
    blocks = ordered.dealt(traj.select("frame", "atom", *axes), ["atom"], "frame", width)
    steps = ordered.with_previous(blocks, ["atom"], "frame", ["frame", *axes]).filter("previous IS NOT NULL")
    moved = [F.col(c) - F.col(f"previous.{c}") for c in axes]
    moved = [d - F.bround(d) for d in moved] if unwrap else moved
    out = steps.select(F.col("previous.frame").alias("frame"), "atom", *(d.alias(c) for d, c in zip(moved, axes)))
    if cells is not None:
        out = out.join(cells.select("frame", "cell"), "frame")
        turned = [sum((F.col(c) * F.col("cell")[3 * i + j] for i, c in enumerate(axes)), F.lit(0.0)) for j in range(3)]
        out = out.select("frame", "atom", *(v.alias(c) for v, c in zip(turned, axes)))
    return out.select("frame", "atom", *((F.col(c) / dt).alias(f"v{c}") for c in axes))


def moving(traj: DataFrame, atoms: DataFrame, *, remove_com: bool = True, **options) -> DataFrame:
    """Velocities with each atom's mass, without the centre of mass; atoms(atom, mass), one row each, is broadcast."""
    moved = velocities(traj, **options)
    if not remove_com:
        return moved.join(F.broadcast(atoms), "atom").select("frame", "atom", F.col("mass").alias("m"), "vx", "vy", "vz")
    return bind(COM_REMOVED, velocities=moved, atoms=F.broadcast(atoms))


def vacf(moved: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """Mass-weighted velocity autocorrelation by a lag join on the atom."""
    params = {"max_lag": max_lag - 1}
    return bind(VACF, moving=moved, shifted=bind(SHIFTED, params=params, moving=moved))


#: Frames of a block of a correlation, unless max_lag asks for more.
CORRELATED = 8_192


def vacf_fft(moved: DataFrame, max_lag: int = MAX_LAG, width: int | None = None) -> DataFrame:
    """The same by overlap-save blocks: lag, vacf.

    An atom's frames are dealt in blocks of `width`; a block takes along the max_lag - 1 frames after it, so that its
    rows meet all they must. Two transforms give a block's sums of products for all lags at once, and sums of blocks
    add up; two more count the pairs, so frames that are missing are left out of both. No task holds a trajectory."""
    if max_lag < 1:
        raise ValueError("at least lag 0")
    width = int(width or max(CORRELATED, 4 * max_lag))
    ship_code(moved.sparkSession)

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * width
        at = pdf["frame"].to_numpy() - first
        v = np.zeros((width + max_lag - 1, 4))
        v[at, :3] = pdf[["vx", "vy", "vz"]].to_numpy()
        # the fourth column counts
        v[at, 3] = 1
        size = 1 << (len(v) + max_lag - 1).bit_length()
        own = np.fft.rfft(v[:width], size, axis=0)
        found = np.fft.irfft(own.conj() * np.fft.rfft(v, size, axis=0), size, axis=0)[:max_lag]
        return pd.DataFrame({"atom": key[0], "m": pdf["m"].iloc[0], "lag": np.arange(max_lag), "s": found[:, :3].sum(1), "n": np.rint(found[:, 3]).astype(int)})

    block = F.floor(F.col("frame") / width).cast("long")
    into = F.sequence(F.floor((F.col("frame") - (max_lag - 1)) / width).cast("long"), block)
    rows = moved.select("atom", "m", "frame", "vx", "vy", "vz", F.explode(into).alias("block"))
    # a block before the first has overlap rows only; it counts no pairs
    sums = rows.groupBy("atom", "block").applyInPandas(one, "atom int, m double, lag int, s double, n long")
    each = sums.groupBy("atom", "lag").agg(F.max("m").alias("m"), F.sum("s").alias("s"), F.sum("n").alias("n")).filter("n > 0")
    return each.groupBy("lag").agg((F.sum(F.col("m") * F.col("s") / F.col("n")) / F.sum("m")).alias("vacf"))


def density(correlation: DataFrame, max_lag: int, *, dt: float = 1.0, convention: str = "cosine", window: str = "hann", sigma: float = 0.0) -> DataFrame:
    """k, f, y of vacf(lag, vacf): its transform on wave numbers above 0, `cosine` (2 dt Re) or `power` (|dt ...|^2),
    under a taper, smoothed by a Gaussian of sigma bins. The input has max_lag rows, one task's work."""
    if convention not in ("cosine", "power") or window not in ("hann", "hamming", "none"):
        raise ValueError(f"no convention {convention!r} or window {window!r}")
    ship_code(correlation.sparkSession)

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros(max_lag)
        values[pdf["lag"]] = pdf["vacf"]
        taper = {"hann": np.hanning, "hamming": np.hamming, "none": np.ones}[window](max_lag)
        transform = np.fft.rfft(values * taper)
        y = 2 * dt * transform.real if convention == "cosine" else np.abs(dt * transform) ** 2
        if sigma > 0:
            reach = int(4 * sigma + 0.5)
            kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
            y = np.convolve(np.pad(y, reach, mode="symmetric"), kernel / kernel.sum(), mode="valid")
        k = np.arange(1, len(y))
        return pd.DataFrame({"k": k, "f": k * INV_FS_TO_CM1 / (max_lag * dt), "y": y[1:]})

    return correlation.groupBy(F.lit(0).alias("all")).applyInPandas(one, "k int, f double, y double")


def trajectory_spectrum(
    traj: DataFrame, atoms: DataFrame, max_lag: int = MAX_LAG, *, dt: float = 1.0, convention: str = "cosine", window: str = "hann", sigma: float = 0.0,
    remove_com: bool = True, unwrap: bool = True, cells: DataFrame | None = None, width: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(lag, vacf) and (k, f, y): from positions to the spectral density in one call.

    atoms(atom, mass): equal masses leave the correlation unweighted."""
    moved = moving(traj, atoms, remove_com=remove_com, dt=dt, unwrap=unwrap, cells=cells, width=width or ordered.WIDTH)
    correlation = vacf_fft(moved, max_lag, width)
    return correlation, density(correlation, max_lag, dt=dt, convention=convention, window=window, sigma=sigma)
