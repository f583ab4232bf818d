"""The rate network as relations: edges, matrices, reachability, branching, preparation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Edges of a small directed network with rates, from how often one event type follows another.
EDGES = """
SELECT src, dst, n / CAST(sum(n) OVER (PARTITION BY src) AS DOUBLE) AS k
FROM (SELECT src, dst, count(*) AS n FROM (SELECT band AS src, lead(band) OVER (PARTITION BY h ORDER BY t) AS dst
      FROM (SELECT h, t, band, row_number() OVER (PARTITION BY h, t ORDER BY p DESC, band) AS place FROM {pop}) a WHERE place = 1) b
      WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst) c"""

NAMES = "SELECT src, dst, concat(CAST(src AS VARCHAR(9)), '->', CAST(dst AS VARCHAR(9))) AS name FROM {edges}"

MATRIX = """
SELECT i, j, sum(v) AS v FROM (SELECT dst AS i, src AS j, k AS v FROM {edges} UNION ALL SELECT src, src, -k FROM {edges}) a GROUP BY i, j"""

# states with a path into the target, and states that the source reaches without it, for the independent engine
BACKWARD = """
WITH RECURSIVE r(s) AS (SELECT :target AS s UNION SELECT e.src FROM {edges} e JOIN r ON e.dst = r.s) SELECT DISTINCT s AS state FROM r"""
FORWARD = """
WITH RECURSIVE r(s) AS (SELECT :source AS s UNION SELECT e.dst FROM {edges} e JOIN r ON e.src = r.s WHERE e.src <> :target) SELECT DISTINCT s AS state FROM r WHERE s <> :target"""

#: A network's distinct edges are searched on the driver up to so many.
MOST_EDGES = 1_000_000


def reachable(edges: DataFrame, start: int, *, backward: bool = False, blocked: int | None = None) -> DataFrame:
    """state: all states that start reaches along the edges (src, dst), or that reach it if
    backward, start itself included; a path ends at `blocked`, which is left out.

    A network's states are declared, so its distinct edges are few; each is looked at once,
    whatever the number of paths and hops."""
    pairs = [(r["src"], r["dst"]) for r in edges.select("src", "dst").distinct().limit(MOST_EDGES + 1).collect()]
    if len(pairs) > MOST_EDGES:
        raise ValueError(f"a network of over {MOST_EDGES} edges")
    after: dict[int, list[int]] = {}
    for a, b in pairs:
        after.setdefault(b if backward else a, []).append(a if backward else b)
    seen, left = {start}, [start]
    while left:
        here = left.pop()
        if here != blocked:
            new = [x for x in after.get(here, []) if x not in seen]
            seen.update(new)
            left += new
    return edges.sparkSession.createDataFrame([(x,) for x in sorted(seen - {blocked})], "state int")


LOCAL_RATIO = """
SELECT src, CASE WHEN sum(CASE WHEN dst IN (:target, :other) THEN 0 ELSE k END) > 0 THEN NULL ELSE sum(CASE WHEN dst = :target THEN k ELSE 0 END) / sum(k) END AS ratio,
       CASE WHEN sum(CASE WHEN dst IN (:target, :other) THEN 0 ELSE k END) > 0 THEN 'other_exits' ELSE 'local' END AS reason
FROM {edges} WHERE src NOT IN (:target, :other) GROUP BY src"""

RESIDUAL_COUNT = """
SELECT h, (count(DISTINCT t) - 1) * (count(DISTINCT state) - CASE WHEN max(total) - min(total) <= 1e-5 THEN 1 ELSE 0 END) AS n_independent
FROM (SELECT h, t, state, sum(p) OVER (PARTITION BY h, t) AS total FROM {pop}) a GROUP BY h"""

# contrasts between states hold all but the mean direction
CONTRAST_RSS = """
SELECT h, sum(s2 - s1 * s1 / n) AS rss, sum(s2) AS plain
FROM (SELECT h, t, sum(r * r) AS s2, sum(r) AS s1, count(*) AS n FROM (SELECT p.h, p.t, p.p - m.mean AS r FROM {pop} p JOIN {mean_series} m ON m.t = p.t AND m.state = p.state WHERE p.t > 0) a
      GROUP BY h, t) b GROUP BY h"""

CRITERIA = """
SELECT h, n, k, n * ln(greatest(rss / n, 4.930380657631324e-32)) + 2 * k AS aic, n * ln(greatest(rss / n, 4.930380657631324e-32)) + k * ln(n) AS bic,
       CASE WHEN n > k + 1 THEN n * ln(greatest(rss / n, 4.930380657631324e-32)) + 2 * k + 2.0 * k * (k + 1) / (n - k - 1) END AS aicc
FROM (SELECT h, sum(r * r) AS rss, count(*) AS n, 5 AS k FROM (SELECT p.h, p.p - m.mean AS r FROM {pop} p JOIN {mean_series} m ON m.t = p.t AND m.state = p.state WHERE p.t > 0) a GROUP BY h) b"""

NARRATIVE = """
SELECT grp, early_net, late_net, early_peak, CASE WHEN abs(early_net) + abs(late_net) = 0 THEN NULL ELSE abs(early_net) / (abs(early_net) + abs(late_net)) END AS early_share,
       CASE WHEN abs(early_net) >= :mostly * (abs(early_net) + abs(late_net)) THEN 'early' WHEN abs(early_net) <= :hardly * (abs(early_net) + abs(late_net)) THEN 'late' ELSE 'both' END AS when_it_moves,
       early_peak > late_peak AS overshoots
FROM {regimes}"""

# the tests that come before a decay is fitted, in their order
FIT_STATUS = """
SELECT h, CASE WHEN max(CASE WHEN k = 1 THEN p END) <= 0 THEN 'not_positive' WHEN max(n) < 5 THEN 'too_few_points'
       WHEN avg(CASE WHEN k > n - floor(n / 5.0D) THEN p END) >= avg(CASE WHEN k <= floor(n / 5.0D) THEN p END) THEN 'refused_rise' ELSE 'fit' END AS status
FROM (SELECT h, p, row_number() OVER (PARTITION BY h ORDER BY t) AS k, count(*) OVER (PARTITION BY h) AS n FROM {pop} WHERE state = :target_state) a GROUP BY h"""

# preparation -------------------------------------------------------------------------------

#: Rows of an unlabelled table: time, energy, then five shares.
UNLABELLED = """
SELECT h, t, c, CASE c WHEN 0 THEN CAST(t AS DOUBLE) WHEN 1 THEN -1.5 ELSE p END AS v
FROM (SELECT h, t, band + 2 AS c, p FROM {pop} UNION ALL SELECT DISTINCT h, t, 0, 0.0D FROM {pop} UNION ALL SELECT DISTINCT h, t, 1, 0.0D FROM {pop}) a"""

COLUMN_BLOCKS = """
SELECT s.c AS start, count_if(abs(x.total - 1) > 1e-5 OR x.low < -1e-5 OR x.high > 1 + 1e-5) = 0 AND s.c > 0 AS fits
FROM (SELECT DISTINCT c FROM {unlabelled} WHERE c <= 2) s
JOIN (SELECT b.c AS start, u.h, u.t, sum(u.v) AS total, min(u.v) AS low, max(u.v) AS high FROM {unlabelled} u JOIN (SELECT DISTINCT c FROM {unlabelled} WHERE c <= 2) b ON u.c BETWEEN b.c AND b.c + 4
      GROUP BY b.c, u.h, u.t) x ON x.start = s.c GROUP BY s.c"""

SURVEY = """
SELECT count(DISTINCT n_rows) = 1 AND count(DISTINCT n_states) = 1 AS alike, min(n_rows) AS n_rows, min(n_states) AS n_states, count(*) AS n_histories
FROM (SELECT h, count(DISTINCT t) AS n_rows, count(DISTINCT state) AS n_states FROM {pop} GROUP BY h) a"""


# text ------------------------------------------------------------------------------------------

LINES = "SELECT event_id, concat('  ', CAST(event_id AS VARCHAR(20)), '.5D-0', CAST(user_id % 7 AS VARCHAR(2)), '  1d+2 ! ', event_type, ' # x') AS line, concat(' ', CASE WHEN user_id % 4 = 0 THEN 'T' WHEN user_id % 4 = 1 THEN '42' WHEN user_id % 4 = 2 THEN '1.5D-3' ELSE event_type END, ' ') AS raw FROM {events_table}"

MASS = f"""
SELECT atom, CASE WHEN atom % 3 = 0 THEN 'C' WHEN atom % 3 = 1 THEN 'H' ELSE 'O' END AS symbol, CASE WHEN atom % 3 = 0 THEN 12.011D WHEN atom % 3 = 1 THEN 1.008D ELSE 15.999D END AS mass
FROM (SELECT DISTINCT atom FROM {{traj}}) a"""

# checks of single steps in files, as relations ---------------------------------------------------

JUMPS = """
SELECT band, frame, de FROM (SELECT state AS band, frame, e - lag(e) OVER (PARTITION BY state ORDER BY frame) AS de, frame - lag(frame) OVER (PARTITION BY state ORDER BY frame) AS step FROM {energies}) a
WHERE step = 1 AND abs(de) >= :jump"""

SHIFT_SCORE = """
SELECT frame, PCT(abs(de), 0.5) AS median_shift, max(abs(de)) AS most_shift, greatest(count_if(de > 1e-6), count_if(de < -1e-6)) / CAST(nullif(count_if(abs(de) > 1e-6), 0) AS DOUBLE) AS same_sign
FROM (SELECT frame, e - lag(e) OVER (PARTITION BY state ORDER BY frame) AS de FROM {energies}) a WHERE de IS NOT NULL GROUP BY frame"""

COMMON_MODE = f"SELECT frame, median_shift, same_sign FROM ({SHIFT_SCORE}) s WHERE median_shift >= :common_shift AND same_sign >= :common_share"

CENTROID = """
SELECT w.frame, w.grp, sum(e.e * w.w) / sum(w.w) AS centroid, sqrt(greatest(sum(e.e * e.e * w.w) / sum(w.w) - pow(sum(e.e * w.w) / sum(w.w), 2), 0)) AS spread
FROM {weights} w JOIN {energies} e ON e.frame = w.frame AND e.state = w.band GROUP BY w.frame, w.grp"""

GAP_SUMMARY = """
SELECT a.state AS i, b.state AS j, min(abs(a.e - b.e)) * 1000 AS gap_mev, min_by(a.frame, abs(a.e - b.e)) AS frame
FROM {energies} a JOIN {energies} b ON a.frame = b.frame AND b.state = a.state + 1 WHERE a.frame BETWEEN :first AND :last GROUP BY a.state, b.state"""

FRAGMENT_RULE = """
SELECT atom, symbol, CASE WHEN symbol = 'C' AND place <= 3 THEN 'lattice' WHEN symbol = 'C' AND place <= 5 THEN 'donor' WHEN symbol IN ('C', 'O') THEN 'acceptor' ELSE 'lattice' END AS fragment
FROM (SELECT atom, symbol, row_number() OVER (PARTITION BY symbol ORDER BY atom) AS place FROM {atoms}) a"""

NEIGHBOURHOOD = """
SELECT w.frame, w.band, w.grp, (w.w + 1e-15) / sum(w.w + 1e-15) OVER (PARTITION BY w.frame, w.band) AS w FROM {weights} w WHERE w.frame BETWEEN :first AND :last"""
