"""Ensembles: what a run's histories do, without pooling passes, episodes or runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.template import bind
from . import ordered

HISTORY = """
SELECT s.h, s.grp, max_by(s.pg, s.t) - min_by(s.pg, s.t) AS net_full,
       max_by(s.pg, s.t) - min_by(CASE WHEN s.t >= :late_from THEN s.pg END, CASE WHEN s.t >= :late_from THEN s.t END) AS net_late,
       max(CASE WHEN s.t >= :late_from THEN s.pg END) - min(CASE WHEN s.t >= :late_from THEN s.pg END) AS range_late, sum(s.occ) AS occ, sum(s.chr) AS chr
FROM {split} s GROUP BY s.h, s.grp"""

STATS = """
SELECT grp, quantity, count(value) AS n, avg(value) AS mean, PCT(value, 0.5) AS median, stddev_samp(value) AS std, min(value) AS least, max(value) AS most,
       count_if(value > :sign) AS n_gain, count_if(value < -:sign) AS n_loss, count_if(abs(value) <= :sign) AS n_flat,
       count_if(value > :sign) / CAST(count(value) AS DOUBLE) AS fraction_gain, count_if(value < -:sign) / CAST(count(value) AS DOUBLE) AS fraction_loss,
       PCT(value, 0.05) AS q05, PCT(value, 0.25) AS q25, PCT(value, 0.75) AS q75, PCT(value, 0.95) AS q95
FROM {quantities} GROUP BY grp, quantity"""

# one pass over the histories, five rows of each
QUANTITIES = """
SELECT grp, stack(5, 'net_full', net_full, 'net_late', net_late, 'range_late', range_late, 'occ', occ, 'chr', chr) AS (quantity, value) FROM {histories}"""

DOMINANT_TERM = """
SELECT grp, CASE WHEN abs(o) + abs(c) = 0 THEN 'none' WHEN abs(o) / (abs(o) + abs(c)) >= :mostly THEN 'occupation' WHEN abs(o) / (abs(o) + abs(c)) <= :hardly THEN 'character' ELSE 'mixed' END AS term
FROM (SELECT grp, PCT(occ, 0.5) AS o, PCT(chr, 0.5) AS c FROM {histories} GROUP BY grp) x"""

CURVE = """
SELECT t, grp, PCT(pg, 0.5) AS median, PCT(pg, 0.25) AS q25, PCT(pg, 0.75) AS q75, min(pg) AS least, max(pg) AS most FROM {split} GROUP BY t, grp"""

# the rows of each history whose frame lies in a window of frames
EPISODE_ROWS = """
SELECT f.h, w.name, count(*) AS n_rows, count(DISTINCT f.frame) AS n_frames, min(f.t) AS first_t, max(f.t) AS last_t
FROM {rows_frames} f JOIN {frame_windows} w ON f.frame BETWEEN w.lo AND w.hi GROUP BY f.h, w.name"""

# passes of one period; passes without a step in the window count up to the last pass that has one
PER_PASS = """
SELECT x.h, x.name, x.grp, sum(x.occ) / (max(x.pass) + 1) AS occ, sum(x.chr) / (max(x.pass) + 1) AS chr, (sum(x.occ) + sum(x.chr)) / (max(x.pass) + 1) AS net,
       count(DISTINCT x.pass) AS n_covering
FROM (SELECT s.h, w.name, s.grp, CAST(floor(s.t / :period) AS INT) AS pass, s.occ, s.chr
      FROM {split} s JOIN {rows_frames} f ON s.h = f.h AND s.t = f.t
      JOIN {frame_windows} w ON f.frame BETWEEN w.lo AND w.hi) x GROUP BY x.h, x.name, x.grp"""

STEP_VERDICT = """
SELECT h, name, CASE WHEN d IS NULL OR a IS NULL THEN 'not_classified' WHEN abs(d) <= :step_tolerance AND abs(a) <= :step_tolerance THEN 'essentially_reversible'
       WHEN a > :step_tolerance AND d < -:step_tolerance THEN 'persistent_acceptor_gain' WHEN a < -:step_tolerance AND d > :step_tolerance THEN 'persistent_donor_gain' ELSE 'no_clear_direction' END AS verdict
FROM (SELECT h, name, max(CASE WHEN grp = :donor THEN net END) AS d, max(CASE WHEN grp = :acceptor THEN net END) AS a FROM {passes} GROUP BY h, name) x"""

EPISODE_SUMMARY = """
SELECT name, grp, count(*) AS n, avg(net) AS mean, PCT(net, 0.5) AS median, stddev_samp(net) AS std, count_if(net > :sign) AS n_gain, count_if(net < -:sign) AS n_loss
FROM {passes} GROUP BY name, grp"""

RUN_TABLE = """
SELECT state, max(CASE WHEN run = 'A' THEN net END) AS net_a, max(CASE WHEN run = 'B' THEN net END) AS net_b, max(CASE WHEN run = 'C' THEN net END) AS net_c
FROM (SELECT run, state, PCT(net, 0.5) AS net FROM (SELECT run, h, state, max_by(p, t) - min_by(p, t) AS net FROM {runs} GROUP BY run, h, state) a GROUP BY run, state) b GROUP BY state"""

EPISODE_TABLE = """
SELECT run, name, state, avg(last - first) AS net FROM (
  SELECT r.run, w.name, r.h, r.state, min_by(r.p, r.t) AS first, max_by(r.p, r.t) AS last FROM {runs} r JOIN {windows} w ON r.t BETWEEN w.lo AND w.hi GROUP BY r.run, w.name, r.h, r.state) a
GROUP BY run, name, state"""

REVIEWER = """
SELECT run, concat(CAST(count_if(net > :sign) AS VARCHAR(10)), '/', CAST(count(*) AS VARCHAR(10))) AS gains, PCT(net, 0.5) AS median
FROM (SELECT run, h, max_by(p, t) - min_by(p, t) AS net FROM {runs} WHERE state = :target_state GROUP BY run, h) a GROUP BY run"""

# exact times that every run has, by set intersection over two runs at a time
SHARED_TIMES = "SELECT t FROM {first_run} INTERSECT SELECT t FROM {second_run}"

# as windows over whole series: what differences must equal
DIFFERENCES = """
SELECT run, state, min_by(d, t) AS initial, max_by(d, t) AS final, max(abs(d)) AS largest, sum(coalesce(0.5 * (d + d0) * (t - t0), 0)) AS integral
FROM (SELECT run, state, t, d, lag(d) OVER (PARTITION BY run, state ORDER BY t) AS d0, lag(t) OVER (PARTITION BY run, state ORDER BY t) AS t0
      FROM (SELECT x.run, x.state, x.t, x.p - r.p AS d FROM (SELECT run, state, t, avg(p) AS p FROM {runs} GROUP BY run, state, t) x
            JOIN (SELECT state, t, avg(p) AS p FROM {runs} WHERE run = :reference_run GROUP BY state, t) r ON r.state = x.state AND r.t = x.t WHERE x.run <> :reference_run) y) z GROUP BY run, state"""

ENVELOPE = """
SELECT state, bucket, avg(t) AS centre, min(mean) AS low, max(mean) AS high FROM (SELECT state, t, mean, CAST(floor(t * :buckets / CAST(:points AS DOUBLE)) AS INT) AS bucket FROM {series} ) a GROUP BY state, bucket"""

THINNED = "SELECT t, state, mean FROM {series} WHERE t % :stride = 0"


def histories(parts, **params):
    return bind(HISTORY, params=params, split=parts)


def differences(runs, reference: str, width: float = ordered.WIDTH):
    """run, state, initial, final, largest, integral: each run's mean series less that of the reference run."""
    means = runs.groupBy("run", "state", "t").agg(F.avg("p").alias("p"))
    other = runs.filter(F.col("run") == reference).groupBy("state", "t").agg(F.avg("p").alias("p_ref"))
    rows = means.filter(F.col("run") != reference).join(other, ["state", "t"]).select("run", "state", "t", (F.col("p") - F.col("p_ref")).alias("d"))
    keys = ["run", "state"]
    state = ordered.summary(ordered.dealt(rows, keys, "t", width), keys, "t", "d")
    return state.select(
        *keys, F.col("first.y").alias("initial"), F.col("last.y").alias("final"), F.greatest(F.abs("peak.y"), F.abs("least.y")).alias("largest"), "integral"
    )
