"""Projection character: fragment weights, dominance, swaps, and populations projected on
fragments before they are averaged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.template import bind
from ..session import settle
from . import ordered

# partial sums per group leave the map side; the windows then see one row for each group
WEIGHTS = """
SELECT frame, band, grp, ord, raw / captured AS w, captured, total
FROM (SELECT *, sum(raw) OVER (PARTITION BY frame, band) AS total,
             sum(CASE WHEN grp IS NOT NULL THEN raw END) OVER (PARTITION BY frame, band) AS captured
      FROM (SELECT i.frame, i.band, g.grp, g.ord, sum(i.tot) AS raw FROM {ions} i LEFT JOIN {ion_groups} g ON i.ion = g.ion
            GROUP BY i.frame, i.band, g.grp, g.ord) a) b
WHERE grp IS NOT NULL"""

PROJECTED = """
SELECT p.h, p.t, w.grp, sum(p.p * w.w) AS pg
FROM {pop} p JOIN {rows_frames} f ON p.h = f.h AND p.t = f.t JOIN {weights} w ON w.frame = f.frame AND w.band = p.band
GROUP BY p.h, p.t, w.grp"""

# the midpoint split: what moved between states at fixed character, and the reverse; as windows over
# whole histories, which split_blocks must equal
SPLIT = """
SELECT h, t, grp, sum(p * w) AS pg,
       sum(coalesce((p - p0) * 0.5 * (w + w0), 0)) AS occ, sum(coalesce(0.5 * (p + p0) * (w - w0), 0)) AS chr
FROM (SELECT p.h, p.t, p.band, w.grp, p.p, w.w,
             lag(p.p) OVER (PARTITION BY p.h, p.band, w.grp ORDER BY p.t) AS p0, lag(w.w) OVER (PARTITION BY p.h, p.band, w.grp ORDER BY p.t) AS w0
      FROM {pop} p JOIN {rows_frames} f ON p.h = f.h AND p.t = f.t JOIN {weights} w ON w.frame = f.frame AND w.band = p.band) a
GROUP BY h, t, grp"""

PROJECTED_MEAN = """
SELECT t, grp, avg(pg) AS mean, stddev_samp(pg) / sqrt(count(*)) AS sem, avg(occ) AS occ, avg(chr) AS chr
FROM {split} GROUP BY t, grp"""

RESIDUAL = "SELECT h, max(abs((pg - pg0) - (occ + chr))) AS residual FROM {split} WHERE pg0 IS NOT NULL GROUP BY h"

DOMINANT = """
SELECT frame, band, grp AS dominant, w AS dominant_w, captured
FROM (SELECT *, row_number() OVER (PARTITION BY frame, band ORDER BY w DESC, ord) AS place FROM {weights}) a WHERE place = 1"""

TABLE_ROWS = f"""
SELECT w.frame, w.band, w.grp, w.w, w.captured, w.total, d.dominant, d.dominant_w
FROM {{weights}} w JOIN ({DOMINANT}) d ON w.frame = d.frame AND w.band = d.band"""

TRANSITIONS = """
SELECT frame0, frame, CASE WHEN frame - frame0 = 1 THEN 'adjacent' ELSE 'across_gap' END AS resolution
FROM (SELECT frame, lag(frame) OVER (ORDER BY frame) AS frame0 FROM (SELECT DISTINCT frame FROM {weights} WHERE frame <= :period) f) a WHERE frame0 IS NOT NULL
UNION ALL SELECT :period AS frame0, 1 AS frame, 'cycle_wrap' AS resolution"""

SWAPS = f"""
SELECT a.band, x.frame0, x.frame, x.resolution, a.dominant AS before, b.dominant AS after, a.dominant_w AS before_w, b.dominant_w AS after_w,
       a.dominant_w >= :dominance AND b.dominant_w >= :dominance AS confident
FROM ({TRANSITIONS}) x JOIN ({DOMINANT}) a ON a.frame = x.frame0 JOIN ({DOMINANT}) b ON b.frame = x.frame AND a.band = b.band
WHERE a.dominant <> b.dominant"""

SWAP_SUMMARY = f"""
SELECT band, resolution, count(*) AS n_swaps, count_if(confident) AS n_confident FROM ({SWAPS}) s GROUP BY band, resolution"""

OCCUPANCY = f"""
SELECT band, dominant, count(*) / CAST(sum(count(*)) OVER (PARTITION BY band) AS DOUBLE) AS share FROM ({DOMINANT}) d GROUP BY band, dominant"""

# of equally common characters the first group counts
DOMINANCE = f"""
SELECT d.band, m.grp AS most_common, d.median_w, d.n_mixed, d.mixed_fraction, coalesce(s.n_swaps, 0) AS n_swaps, coalesce(s.n_adjacent, 0) AS n_adjacent,
       coalesce(s.n_across_gap, 0) AS n_across_gap, coalesce(s.n_wrap, 0) AS n_wrap
FROM (SELECT band, PCT(dominant_w, 0.5) AS median_w, count_if(dominant_w < :dominance) AS n_mixed, count_if(dominant_w < :dominance) / CAST(count(*) AS DOUBLE) AS mixed_fraction
      FROM ({DOMINANT}) a GROUP BY band) d
JOIN (SELECT band, grp FROM (SELECT band, grp, row_number() OVER (PARTITION BY band ORDER BY n DESC, ord) AS place
      FROM (SELECT w.band, w.grp, w.ord, count_if(o.dominant = w.grp) AS n FROM {{weights}} w JOIN ({DOMINANT}) o ON o.frame = w.frame AND o.band = w.band GROUP BY w.band, w.grp, w.ord) x) y WHERE place = 1) m
  ON m.band = d.band
LEFT JOIN (SELECT band, count(*) AS n_swaps, count_if(resolution = 'adjacent') AS n_adjacent, count_if(resolution = 'across_gap') AS n_across_gap, count_if(resolution = 'cycle_wrap') AS n_wrap
           FROM ({SWAPS}) z GROUP BY band) s ON s.band = d.band"""

QUALITY = """
SELECT band, n, least, median, frame_of_least, n_below, n_below / CAST(n AS DOUBLE) AS fraction_below
FROM (SELECT band, count(*) AS n, min(captured) AS least, PCT(captured, 0.5) AS median, max(CASE WHEN place = 1 THEN frame END) AS frame_of_least, count_if(captured < :least_captured) AS n_below
      FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY captured, frame) AS place FROM (SELECT DISTINCT frame, band, captured FROM {weights}) c) x GROUP BY band) y"""

QUALITY_TOTAL = """
SELECT count(*) AS n, count(DISTINCT frame) AS n_frames, min(captured) AS least, PCT(captured, 0.01) AS p01, PCT(captured, 0.05) AS p05, PCT(captured, 0.5) AS median,
       PCT(captured, 0.95) AS p95, max(captured) AS most, count_if(captured < :least_captured) AS n_below
FROM (SELECT DISTINCT frame, band, captured FROM {weights}) c"""

WORST = "SELECT DISTINCT frame, band, captured FROM {weights} ORDER BY captured, frame, band LIMIT :worst"

WORST_FRAMES = """
SELECT frame, min(captured) AS least, count_if(captured < :least_captured) AS n_below FROM (SELECT DISTINCT frame, band, captured FROM {weights}) c
GROUP BY frame HAVING count_if(captured < :least_captured) > 0"""

FLAGGED = "SELECT DISTINCT frame, band, captured, captured < :least_captured AS flagged FROM {weights}"

CONSUMPTION = """
SELECT count(DISTINCT w.frame) AS declared, count(DISTINCT f.frame) AS required, count(DISTINCT w.frame) - count(DISTINCT f.frame) AS skipped
FROM {weights} w LEFT JOIN {rows_frames} f ON w.frame = f.frame"""

REQUIRED = "SELECT DISTINCT w.frame, w.band FROM {weights} w LEFT SEMI JOIN {rows_frames} f ON w.frame = f.frame"
MISSING = """
SELECT DISTINCT f.frame FROM {required} f
WHERE NOT EXISTS (SELECT 1 FROM {weights} w WHERE w.frame = f.frame)"""
EXCEPT = "SELECT frame FROM {weights} EXCEPT SELECT frame FROM {rows_frames}"
ALL_FRAMES = "SELECT DISTINCT frame FROM {rows_frames} UNION SELECT frame FROM {weights}"

LINEAR = "SELECT g.h, g.t, s.start + g.t AS frame FROM (SELECT DISTINCT h, t FROM {pop}) g JOIN {starts} s ON s.h = g.h"

CYCLIC = """
SELECT g.h, g.t, CASE WHEN (g.t + s.start) % :period = 0 THEN :period ELSE (g.t + s.start) % :period END AS frame
FROM (SELECT DISTINCT h, t FROM {pop}) g JOIN {starts} s ON s.h = g.h"""

# walk(h, t, frame, frame0): the rows of each history with the frame of the row before
ALIGNMENT = """
SELECT h, min_by(frame, t) AS first_frame, max_by(frame, t) AS last_frame, count(DISTINCT frame) AS n_frames,
       count_if(frame - frame0 <> 1) AS n_wraps
FROM {walk} GROUP BY h"""

WRAPPED = "SELECT count(DISTINCT h) AS n_histories, count(*) AS n_steps FROM {walk} WHERE frame0 = :period AND frame = 1"

WRAP_STATUS = """
SELECT h, CASE WHEN n_frames < 2 THEN 'degenerate_period' WHEN n_wraps = 0 THEN 'not_traversed' WHEN NOT loaded THEN 'frames_not_loaded' ELSE 'examined' END AS status
FROM (SELECT a.h, count(DISTINCT a.frame) AS n_frames, count_if(a.frame0 = :period AND a.frame = 1) AS n_wraps, max(l.n) = 2 AS loaded
      FROM {walk} a CROSS JOIN (SELECT count(DISTINCT frame) AS n FROM {weights} WHERE frame IN (1, :period)) l GROUP BY a.h) s"""

# as windows over whole groups: what fixed_vs_projected must equal
FIXED_VS_PROJECTED = """
SELECT grp, max(abs(d)) AS most, max(CASE WHEN place = 1 THEN t END) AS most_time, sqrt(avg(d * d)) AS rms, avg(d) AS mean_d,
       sum(coalesce(0.5 * (abs(d) + abs(d0)) * (t - t0), 0)) AS integral,
       max(CASE WHEN place = 1 THEN projected END) AS projected_there, max(CASE WHEN place = 1 THEN fixed END) AS fixed_there
FROM (SELECT *, lag(d) OVER (PARTITION BY grp ORDER BY t) AS d0, lag(t) OVER (PARTITION BY grp ORDER BY t) AS t0,
             row_number() OVER (PARTITION BY grp ORDER BY abs(d) DESC, t) AS place
      FROM (SELECT a.grp, a.t, a.mean AS projected, b.mean AS fixed, a.mean - b.mean AS d
            FROM {projected} a JOIN {fixed} b ON a.t = b.t AND a.grp = b.grp) x) y GROUP BY grp"""

FIXED_VS_DYNAMIC = """
SELECT a.grp, max_by(a.mean, a.t) - min_by(a.mean, a.t) AS dynamic_net, max_by(b.mean, b.t) - min_by(b.mean, b.t) AS fixed_net,
       max(a.mean) - min(a.mean) AS dynamic_range, max(b.mean) - min(b.mean) AS fixed_range, avg(a.mean) AS dynamic_mean, avg(b.mean) AS fixed_mean,
       regr_slope(a.mean, CAST(a.t AS DOUBLE)) AS dynamic_slope, regr_slope(b.mean, CAST(b.t AS DOUBLE)) AS fixed_slope
FROM {projected} a JOIN {fixed} b ON a.t = b.t AND a.grp = b.grp WHERE a.t >= :late_from GROUP BY a.grp"""

#: The populations at the first frame's character: what a fixed assignment would give.
FIXED = """
SELECT t, grp, avg(pg) AS mean FROM (SELECT p.h, p.t, w.grp, sum(p.p * w.w) AS pg FROM {pop} p JOIN {weights} w ON w.band = p.band AND w.frame = :reference_frame
 GROUP BY p.h, p.t, w.grp) a GROUP BY t, grp"""


def fragment_weights(ions: DataFrame, ion_groups: DataFrame, **params) -> DataFrame:
    """frame, band, grp, ord, w, captured, total. The groups are broadcast: one row an ion."""
    return bind(WEIGHTS, params=params, ions=ions, ion_groups=F.broadcast(ion_groups))


def split(pop: DataFrame, rows_frames: DataFrame, weights: DataFrame) -> DataFrame:
    """The split of shares that come a row each."""
    return split_blocks(packed(pop), rows_frames, weights)


def walk(rows_frames: DataFrame, width: float = ordered.WIDTH) -> DataFrame:
    """h, t, frame, frame0: the frame of each row and of the one before."""
    blocks = ordered.dealt(rows_frames.select("h", "t", "frame"), ["h"], "t", width)
    return ordered.with_previous(blocks, ["h"], "t", ["frame"]).select("h", "t", "frame", F.col("previous.frame").alias("frame0"))


def driven(parts: DataFrame, width: float = ordered.WIDTH) -> DataFrame:
    """h, t, grp, driven: where occupation alone would have taken each group from its first value."""
    start = F.when(F.col("pg0").isNull(), F.col("pg")).otherwise(F.lit(0.0))
    rows = parts.select("h", "grp", "t", (start + F.col("occ")).alias("step"))
    return ordered.running_sum(ordered.dealt(rows, ["h", "grp"], "t", width), ["h", "grp"], "t", "step", "driven").select("h", "t", "grp", "driven")


def fixed_vs_projected(projected: DataFrame, fixed: DataFrame, width: float = ordered.WIDTH) -> DataFrame:
    """How far two series of means are apart, by group: the largest distance and where, rms, mean, and
    the distance integrated over time."""
    both = projected.select("t", "grp", F.col("mean").alias("projected")).join(fixed.select("t", "grp", F.col("mean").alias("fixed")), ["t", "grp"])
    both = both.withColumn("d", F.col("projected") - F.col("fixed")).withColumn("apart", F.abs("d"))
    blocks = ordered.dealt(both, ["grp"], "t", width)
    state = ordered.summary(blocks, ["grp"], "t", "apart", carry=["projected", "fixed"], sums={"squares": F.col("d") * F.col("d"), "signed": F.col("d")})
    return state.select(
        "grp", F.col("peak.y").alias("most"), F.col("peak.at").cast(projected.schema["t"].dataType).alias("most_time"), F.sqrt(F.col("squares") / F.col("n")).alias("rms"),
        (F.col("signed") / F.col("n")).alias("mean_d"), "integral", F.col("peak.projected").alias("projected_there"), F.col("peak.fixed").alias("fixed_there"),
    )


def projected_mean(parts: DataFrame, **params) -> DataFrame:
    """Histories are projected first and averaged then."""
    return bind(PROJECTED_MEAN, params=params, split=parts)


def flagship(pop: DataFrame, rows_frames: DataFrame, weights: DataFrame) -> DataFrame:
    return projected_mean(split(pop, rows_frames, weights))


def packed(pop: DataFrame) -> DataFrame:
    """h, t, p, bands: one row of the grid with all shares, and the bands that they belong to, in order."""
    listed = pop.groupBy("h", "t").agg(F.array_sort(F.collect_list(F.struct("band", "p"))).alias("x"))
    return listed.select("h", "t", F.col("x.p").alias("p"), F.col("x.band").alias("bands"))


#: Weights of at most so many cells (frames by bands by groups) are broadcast: 32 MB of doubles.
BROADCAST_CELLS = 4_000_000


def weight_arrays(weights: DataFrame) -> DataFrame:
    """frame, groups, bands, ws: all weights of a frame, an array over the bands for each group.
    Reading a frame whose groups don't all have the same bands is an error."""
    each = weights.groupBy("frame", "grp").agg(F.array_sort(F.collect_list(F.struct("band", "w"))).alias("x"))
    frames = each.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("grp", F.col("x.band").alias("bands"), F.col("x.w").alias("w")))).alias("g"))
    even = F.forall("g", lambda x: x["bands"] == F.col("g")[0]["bands"])
    told = F.raise_error(F.concat(F.lit("the groups of frame "), F.col("frame").cast("string"), F.lit(" have weights of different bands")))
    return frames.select("frame", F.col("g.grp").alias("groups"), F.when(even, F.col("g")[0]["bands"]).otherwise(told).alias("bands"), F.col("g.w").alias("ws"))


#: Up to so many products a frame (groups by bands), the sums of a split are written out, so that they stay in generated code.
WRITTEN_OUT = 64


def _products(rows: DataFrame, rows_frames: DataFrame | None, weights: DataFrame, width: float) -> tuple[DataFrame, str]:
    """Rows h, t, frame, frame0, and the expression over them that gives each group's products of shares and weights of a
    row and of the one before: an array of (grp, now, ahead, behind, then).

    rows: h, t, p and, where known, bands (as `packed` gives them), with their frame where rows_frames is None. A row's
    shares are one array and its frame's weights one array for each group, so rows are not multiplied before
    the arithmetic: occ and chr are half sums and differences of four products of shares and weights
    of this row and the one before. A history is dealt in blocks of rows
    (`ordered`), so no task holds a history.

    A row whose frame has no weights, whose bands are not those of its frame's weights, or whose frame has
    other groups than the one before is an error, as is a null share: nothing is paired by position alone and nothing unknown
    becomes 0. Rows without `bands` must have as many shares as their frame has bands.

    The weights are settled once; they are broadcast if they have no more than BROADCAST_CELLS cells. Where all frames have the
    same groups and bands, no more than WRITTEN_OUT pairs of them, the sums are written out term by term; otherwise they are
    sums over arrays. The expression is handed on unevaluated, because Spark would evaluate a column of it again in a filter of
    empty arrays.
    """
    table = settle(weight_arrays(weights))
    shape = F.struct("groups", "bands")
    cells, least, most = table.agg(F.sum(F.size("bands") * F.size("groups")), F.min(shape), F.max(shape)).first()
    alike = least is not None and least == most and len(least["groups"]) * len(least["bands"]) <= WRITTEN_OUT
    if (cells or 0) <= BROADCAST_CELLS:
        table = F.broadcast(table)
    walked = rows if rows_frames is None else rows.join(rows_frames.select("h", "t", "frame"), ["h", "t"])
    known = ["bands"] if "bands" in rows.columns else []
    blocks = ordered.dealt(walked.select("h", "t", "p", "frame", *known), ["h"], "t", width)
    moved = ordered.with_previous(blocks, ["h"], "t", ["p", "frame"])
    moved = moved.select("h", "t", "p", "frame", *(F.col(c).alias("own_bands") for c in known), F.col("previous.p").alias("p0"), F.col("previous.frame").alias("frame0"))
    same = "own_bands = bands" if known else "size(p) = size(bands)"

    def checked(null_share: str, like_before: str) -> str:
        return f"""CASE WHEN ws IS NULL THEN raise_error(concat('frame ', frame, ' has no weights'))
        WHEN NOT ({same}) THEN raise_error(concat('history ', h, ', row ', t, ': its bands are not those of frame ', frame))
        WHEN {null_share} THEN raise_error(concat('history ', h, ', row ', t, ': a share is missing'))
        WHEN frame0 IS NOT NULL AND NOT ({like_before}) THEN raise_error(concat('frames ', frame0, ' and ', frame, ' have other bands or groups'))
        ELSE groups END"""

    if alike:
        n_groups, n_bands = len(least["groups"]), len(least["bands"])
        before = table.select(F.col("frame").alias("frame0"), F.col("ws").alias("ws0"))
        placed = moved.join(table, "frame", "left").join(before, "frame0", "left")
        shares = [f"get({x}, {j}) AS {x}_{j}" for x in ("p", "p0") for j in range(n_bands)]
        cells = [f"get(get({x}, {k}), {j}) AS {x}_{k}_{j}" for x in ("ws", "ws0") for k in range(n_groups) for j in range(n_bands)]
        told = checked(" OR ".join(f"get(p, {j}) IS NULL" for j in range(n_bands)), "ws0 IS NOT NULL")
        terms = placed.selectExpr("h", "t", "frame", "frame0", f"{told} AS groups", *shares, *cells)
        pairs = {"now": ("p", "ws"), "ahead": ("p", "ws0"), "behind": ("p0", "ws"), "then": ("p0", "ws0")}
        sums = [f"0D + {' + '.join(f'{p}_{j} * {w}_{k}_{j}' for j in range(n_bands))} AS {name}_{k}" for k in range(n_groups) for name, (p, w) in pairs.items()]
        out = terms.selectExpr("h", "t", "frame", "frame0", "groups", *sums)
        # asking for groups keeps the checks in every plan, whatever columns are read
        return out, "CASE WHEN groups IS NOT NULL THEN array({}) END".format(", ".join(f"struct(get(groups, {k}) AS grp, {', '.join(f'{name}_{k} AS {name}' for name in pairs)})" for k in range(n_groups)))

    before = table.select(F.col("frame").alias("frame0"), F.col("groups").alias("groups0"), F.col("bands").alias("bands0"), F.col("ws").alias("ws0"))
    placed = moved.join(table, "frame", "left").join(before, "frame0", "left")

    def product(left: str, right: str) -> str:
        return f"aggregate(zip_with({left}, {right}, (a, b) -> a * b), 0D, (s, v) -> s + v)"

    return placed, f"""transform({checked("exists(p, x -> x IS NULL)", "groups = groups0 AND bands = bands0")}, (x, k) -> struct(x AS grp, {product("p", "ws[k]")} AS now,
        {product("p", "ws0[k]")} AS ahead, {product("p0", "ws[k]")} AS behind, {product("p0", "ws0[k]")} AS then))"""


#: The halves of a change, from the four products of shares and weights of a row and the one before.
_OCC, _CHR = "0.5D * (({x}now - {x}behind) + ({x}ahead - {x}then))", "0.5D * (({x}now - {x}ahead) + ({x}behind - {x}then))"


def split_arrays(rows: DataFrame, rows_frames: DataFrame | None, weights: DataFrame, width: float = ordered.WIDTH) -> DataFrame:
    """h, t, frame, frame0, parts: the split of each row (see `_products`), an array of (grp, pg, occ, chr, pg0) in order of
    the groups; occ and chr are 0 at a history's first row."""
    placed, each = _products(rows, rows_frames, weights, width)
    parts = f"""transform({each}, x -> struct(x.grp AS grp, x.now AS pg, if(frame0 IS NULL, 0D, {_OCC.format(x="x.")}) AS occ, if(frame0 IS NULL, 0D, {_CHR.format(x="x.")}) AS chr, x.then AS pg0))"""
    return placed.selectExpr("h", "t", "frame", "frame0", f"{parts} AS parts")


def split_blocks(rows: DataFrame, rows_frames: DataFrame | None, weights: DataFrame, block_rows: float = ordered.WIDTH) -> DataFrame:
    """h, t, grp, pg, occ, chr, frame, frame0, pg0: the split (see `_products`), a row for each group; frame0 and pg0 are
    the frame and the projected share of the row before, occ and chr are 0 at a history's first row."""
    placed, products = _products(rows, rows_frames, weights, block_rows)
    each = placed.selectExpr("h", "t", "frame", "frame0", f"inline({products})")
    return each.selectExpr(
        "h", "t", "grp", "now AS pg", f"if(frame0 IS NULL, 0D, {_OCC.format(x='')}) AS occ", f"if(frame0 IS NULL, 0D, {_CHR.format(x='')}) AS chr", "frame", "frame0", "then AS pg0"
    )
