"""Crossing events: where two bands come close, couple, or exchange their character.

A null flag or a null change means "not evaluated" and never false or zero.
"""

from __future__ import annotations

from ..plans.template import bind
from .character import DOMINANT

BAND_PAIRS = "SELECT band AS a, next AS b FROM (SELECT band, lead(band) OVER (ORDER BY band) AS next FROM (SELECT DISTINCT band FROM {weights}) x) y WHERE next IS NOT NULL"

STEPS = f"""
SELECT band, frame, frame0, max(abs(w - w0)) AS change, max(dominant) AS after, max(dominant0) AS before
FROM (SELECT w.band, w.frame, w.grp, w.w, lag(w.w) OVER (PARTITION BY w.band, w.grp ORDER BY w.frame) AS w0,
             lag(w.frame) OVER (PARTITION BY w.band, w.grp ORDER BY w.frame) AS frame0, d.dominant,
             lag(d.dominant) OVER (PARTITION BY w.band, w.grp ORDER BY w.frame) AS dominant0
      FROM {{weights}} w JOIN ({DOMINANT}) d ON w.frame = d.frame AND w.band = d.band) s
WHERE frame0 IS NOT NULL GROUP BY band, frame, frame0"""

FLAGS = f"""
SELECT a.frame0, a.frame, p.a, p.b, a.before AS before_a, a.after AS after_a, b.before AS before_b, b.after AS after_b,
       greatest(a.change, b.change) AS change, abs(ea.e - eb.e) AS gap, abs(n.v) AS nac,
       abs(ea.e - eb.e) <= :gap * factor AS small_gap, abs(n.v) >= :coupling * factor AS strong_nac,
       a.before <> a.after OR b.before <> b.after OR greatest(a.change, b.change) >= :exchange * factor AS swap, factor
FROM ({BAND_PAIRS}) p CROSS JOIN (SELECT 1.0D AS factor) z JOIN ({STEPS}) a ON a.band = p.a JOIN ({STEPS}) b ON b.band = p.b AND b.frame = a.frame
LEFT JOIN {{energies}} ea ON ea.frame = a.frame AND ea.state = p.a LEFT JOIN {{energies}} eb ON eb.frame = a.frame AND eb.state = p.b
LEFT JOIN {{nac}} n ON n.frame = a.frame AND n.i = p.a AND n.j = p.b"""

FRAME_EVENTS = f"""
SELECT frame0, frame, a, b, before_a, after_a, before_b, after_b, change, gap, nac, small_gap, strong_nac, swap,
       CASE WHEN swap THEN 'character_swap_population_not_evaluated' WHEN small_gap AND strong_nac THEN 'close_and_coupled_without_character_swap'
            ELSE 'flagged_metric_only' END AS classification
FROM ({FLAGS}) f WHERE swap OR small_gap OR strong_nac"""

# a history's steps: the split of the group that moves most decides what the event means
HISTORY_STEPS = """
SELECT h, t, frame, frame0, m.grp, m.occ, m.chr, m.pg - m.pg0 AS dp
FROM (SELECT h, t, frame, frame0, array_max(transform(parts, (x, k) -> struct(abs(x.occ + x.chr) AS size, -k AS place, x AS m))).m AS m FROM {arrays})
WHERE frame0 IS NOT NULL AND frame <> frame0"""

CLASSIFIED = f"""
SELECT h, t, a, b, frame, grp, occ, chr, dp, change, gap, nac, swap, coalesce(small_gap, false) AS small_gap, coalesce(strong_nac, false) AS strong_nac,
       CASE WHEN swap AND dp IS NULL THEN 'character_swap_population_not_evaluated'
            WHEN swap AND abs(dp) <= :moved THEN 'character_swap_without_projected_fragment_change'
            WHEN swap THEN 'character_swap_with_projected_fragment_change'
            WHEN abs(dp) > :moved THEN 'fragment_population_change_without_character_swap'
            WHEN small_gap AND strong_nac THEN 'close_and_coupled_without_character_swap' ELSE 'flagged_metric_only' END AS classification,
       CASE WHEN abs(occ) + abs(chr) <= :moved THEN 'no_movement' WHEN abs(occ) / (abs(occ) + abs(chr)) >= :mostly THEN 'occupation_dominated'
            WHEN abs(occ) / (abs(occ) + abs(chr)) <= :hardly THEN 'character_dominated' ELSE 'mixed' END AS descriptor
FROM (SELECT s.h, s.t, p.a, p.b, s.frame, s.grp, s.occ, s.chr, s.dp, greatest(x.change, y.change) AS change, abs(ea.e - eb.e) AS gap, abs(n.v) AS nac,
             x.dominant <> x.dominant0 OR y.dominant <> y.dominant0 OR greatest(x.change, y.change) >= :exchange AS swap,
             abs(ea.e - eb.e) <= :gap AS small_gap, abs(n.v) >= :coupling AS strong_nac
      FROM {{steps}} s CROSS JOIN ({BAND_PAIRS}) p
      JOIN {{moves}} x ON x.frame0 = s.frame0 AND x.frame = s.frame AND x.band = p.a JOIN {{moves}} y ON y.frame0 = s.frame0 AND y.frame = s.frame AND y.band = p.b
      LEFT JOIN {{energies}} ea ON ea.frame = s.frame AND ea.state = p.a LEFT JOIN {{energies}} eb ON eb.frame = s.frame AND eb.state = p.b
      LEFT JOIN {{nac}} n ON n.frame = s.frame AND n.i = p.a AND n.j = p.b) z
WHERE swap OR small_gap OR strong_nac OR abs(dp) > :moved"""

#: How each band's character differs between the two frames of every step that some history takes.
MOVES = f"""
SELECT k.frame0, k.frame, a.band, max(abs(a.w - b.w)) AS change, max(da.dominant) AS dominant, max(db.dominant) AS dominant0
FROM (SELECT DISTINCT frame0, frame FROM {{steps}}) k JOIN {{weights}} a ON a.frame = k.frame JOIN {{weights}} b ON b.frame = k.frame0 AND b.band = a.band AND b.grp = a.grp
JOIN ({DOMINANT}) da ON da.frame = k.frame AND da.band = a.band JOIN ({DOMINANT}) db ON db.frame = k.frame0 AND db.band = a.band
GROUP BY k.frame0, k.frame, a.band"""

COUNTS = "SELECT h, classification, count(*) AS n FROM {events} GROUP BY h, classification"
DESCRIPTORS = "SELECT descriptor, count(*) AS n FROM {events} WHERE classification = 'character_swap_with_projected_fragment_change' GROUP BY descriptor"

TOTALS = """
SELECT h, name, classification, count(*) AS n
FROM (SELECT e.h, e.classification, w.name FROM {events} e JOIN {named_rows} w ON w.t = e.t) x
GROUP BY GROUPING SETS ((h, classification), (classification), (name, classification))"""

EARLY_LATE = """
SELECT coalesce(e.classification, l.classification) AS classification, coalesce(e.n, 0) AS early, coalesce(l.n, 0) AS late, coalesce(l.n, 0) - coalesce(e.n, 0) AS change
FROM (SELECT e.classification, count(*) AS n FROM {events} e JOIN {windows} w ON w.name = :early AND e.t BETWEEN w.lo AND w.hi GROUP BY e.classification) e
FULL OUTER JOIN (SELECT e.classification, count(*) AS n FROM {events} e JOIN {windows} w ON w.name = :late AND e.t BETWEEN w.lo AND w.hi GROUP BY e.classification) l ON e.classification = l.classification"""

FACTORS = "(SELECT 0.5D AS factor UNION ALL SELECT 0.75D UNION ALL SELECT 1.0D UNION ALL SELECT 1.5D UNION ALL SELECT 2.0D) z"
SENSITIVITY = (
    "SELECT factor, count(*) AS n, count_if(swap) AS n_swap, (max(count(*)) OVER () - min(count(*)) OVER ()) / CAST(greatest(1, max(count(*)) OVER ()) AS DOUBLE) AS spread FROM ("
    + FLAGS.replace("(SELECT 1.0D AS factor) z", FACTORS)
    + ") f WHERE swap OR small_gap OR strong_nac GROUP BY factor"
)

DELTAS = "SELECT h, t, grp, pg - pg0 AS dp FROM {split}"

# Does the population move as the characters do? Undecided where no dominant changes, where both
# bands move to different fragments, and where one band's target is the other's source.
DIRECTION = """
SELECT e.h, e.t, e.a, e.b, e.n_moves, e.target,
       CASE WHEN e.n_moves = 0 OR e.n_targets > 1 OR e.target_is_source OR g.dp IS NULL THEN NULL
            ELSE g.dp > :moved AND coalesce(sa.dp < -:moved, true) AND coalesce(sb.dp < -:moved, true) END AS agrees
FROM (SELECT h, t, a, b, CASE WHEN before_a <> after_a THEN 1 ELSE 0 END + CASE WHEN before_b <> after_b THEN 1 ELSE 0 END AS n_moves,
             CASE WHEN before_a <> after_a AND before_b <> after_b AND after_a <> after_b THEN 2 ELSE 1 END AS n_targets,
             before_a <> after_a AND before_b <> after_b AND (after_a = before_b OR after_b = before_a) AS target_is_source,
             CASE WHEN before_a <> after_a THEN after_a WHEN before_b <> after_b THEN after_b END AS target,
             CASE WHEN before_a <> after_a THEN before_a END AS source_a, CASE WHEN before_b <> after_b THEN before_b END AS source_b
      FROM (SELECT c.h, c.t, c.a, c.b, x.dominant0 AS before_a, x.dominant AS after_a, y.dominant0 AS before_b, y.dominant AS after_b
            FROM {events} c JOIN {steps} s ON s.h = c.h AND s.t = c.t
            JOIN {moves} x ON x.frame0 = s.frame0 AND x.frame = s.frame AND x.band = c.a
            JOIN {moves} y ON y.frame0 = s.frame0 AND y.frame = s.frame AND y.band = c.b) m) e
LEFT JOIN {deltas} g ON g.h = e.h AND g.t = e.t AND g.grp = e.target
LEFT JOIN {deltas} sa ON sa.h = e.h AND sa.t = e.t AND sa.grp = e.source_a
LEFT JOIN {deltas} sb ON sb.h = e.h AND sb.t = e.t AND sb.grp = e.source_b"""


def frame_events(weights, energies, nac, **params):
    return bind(FRAME_EVENTS, params=params, weights=weights, energies=energies, nac=nac)


def history_events(arrays, weights, energies, nac, **params):
    """Events of each history's own walk over the frames; a step that stays on its frame is none.
    arrays: of character.split_arrays."""
    steps = bind(HISTORY_STEPS, params=params, arrays=arrays)
    moves = bind(MOVES, params=params, steps=steps, weights=weights)
    return bind(CLASSIFIED, params=params, steps=steps, moves=moves, weights=weights, energies=energies, nac=nac)
