"""SQL for an independent engine, written from the definitions and not from the plans.

Where a plan lags, these number rows and join each to the one before; where a plan ranks,
these order a list and take its head; where a plan counts blocks, these walk the states one
row at a time. Inputs in braces are the base views, and the inputs of INPUTS.
"""

from __future__ import annotations

#: Derived inputs that have a text of their own here.
INPUTS = {
    "numbered": "SELECT h, t, frame, row_number() OVER (PARTITION BY h ORDER BY t) AS k FROM {rows_frames}",
    "split": """
SELECT a.h, a.t, a.grp, sum(a.p * a.w) AS pg, sum(coalesce((a.p - b.p) * (a.w + b.w) / 2, 0)) AS occ, sum(coalesce((a.p + b.p) / 2 * (a.w - b.w), 0)) AS chr
FROM (SELECT r.h, r.t, r.k, p.band, p.p, w.grp, w.w FROM {numbered} r JOIN {pop} p ON p.h = r.h AND p.t = r.t JOIN {weights} w ON w.frame = r.frame AND w.band = p.band) a
LEFT JOIN (SELECT r.h, r.k, p.band, p.p, w.grp, w.w FROM {numbered} r JOIN {pop} p ON p.h = r.h AND p.t = r.t JOIN {weights} w ON w.frame = r.frame AND w.band = p.band) b
  ON b.h = a.h AND b.k = a.k - 1 AND b.band = a.band AND b.grp = a.grp GROUP BY a.h, a.t, a.grp""",
    "shifted": "SELECT atom, frame, vx, vy, vz, CAST(l AS INT) AS lag, frame - l AS frame0 FROM {moving}, generate_series(0, :max_lag) g(l)",
    "tops": "SELECT frame, band, (list(grp ORDER BY w DESC, ord))[1] AS top FROM {weights} GROUP BY frame, band",
    "marks": """
SELECT DISTINCT x.frame FROM (SELECT a.frame, bool_or(a.top <> b.top) AS moved, bool_or(a.top IN (:donor, :acceptor) AND b.top IN (:donor, :acceptor)) AS between_both
  FROM {tops} a JOIN {tops} b ON b.band = a.band AND b.frame = a.frame - 1 WHERE a.band IN (:band_a, :band_b) GROUP BY a.frame) x WHERE moved AND between_both""",
    "spread": """
SELECT e.*, f.frame FROM (
  SELECT s.episode, greatest(1, min(m.frame) - :pad) AS first_frame, least((SELECT max(frame) FROM {weights}), max(m.frame) + :pad) AS last_frame, count(*) AS n_marks
  FROM {marks} m JOIN (SELECT frame, row_number() OVER (ORDER BY frame) AS episode, lead(frame, 1, 2147483647) OVER (ORDER BY frame) AS until
       FROM {marks} a WHERE NOT EXISTS (SELECT 1 FROM {marks} b WHERE b.frame < a.frame AND b.frame >= a.frame - 2 * :pad)) s ON m.frame >= s.frame AND m.frame < s.until
  GROUP BY s.episode) e JOIN (SELECT DISTINCT frame FROM {weights}) f ON f.frame BETWEEN e.first_frame AND e.last_frame""",
    "histories": """
SELECT h, grp, l[-1] - l[1] AS net_full, l[-1] - late[1] AS net_late, list_max(late) - list_min(late) AS range_late, occ, chr
FROM (SELECT h, grp, list(pg ORDER BY t) AS l, list(pg ORDER BY t) FILTER (t >= :late_from) AS late, sum(occ) AS occ, sum(chr) AS chr FROM {split} GROUP BY h, grp) x""",
    "quantities": """
SELECT grp, 'net_full' AS quantity, net_full AS value FROM {histories} UNION ALL SELECT grp, 'net_late', net_late FROM {histories} UNION ALL
SELECT grp, 'range_late', range_late FROM {histories} UNION ALL SELECT grp, 'occ', occ FROM {histories} UNION ALL SELECT grp, 'chr', chr FROM {histories}""",
    "event_rows": """
SELECT a.h, a.t, a.frame, b.frame AS frame0, b.t AS t0 FROM {numbered} a JOIN {numbered} b ON a.h = b.h AND a.k = b.k + 1 WHERE a.frame <> b.frame""",
    "movers": "SELECT h, t, (list({{'grp': grp, 'occ': occ, 'chr': chr, 'pg': pg}} ORDER BY abs(occ + chr) DESC, grp))[1] AS m FROM {split} GROUP BY h, t".replace("{{", "{ ").replace("}}", " }"),
}

SPLIT = "SELECT * FROM {split}"

# as windows over whole histories
STEPS = """
SELECT h, t, frame, frame0, grp, occ, chr, dp
FROM (SELECT s.h, s.t, f.frame, lag(f.frame) OVER (PARTITION BY s.h, s.grp ORDER BY s.t) AS frame0, s.grp, s.occ, s.chr,
             s.pg - lag(s.pg) OVER (PARTITION BY s.h, s.grp ORDER BY s.t) AS dp,
             row_number() OVER (PARTITION BY s.h, s.t ORDER BY abs(s.occ + s.chr) DESC, s.grp) AS place
      FROM {split} s JOIN {rows_frames} f ON s.h = f.h AND s.t = f.t) x
WHERE place = 1 AND frame0 IS NOT NULL AND frame <> frame0"""

RESIDUAL = """
SELECT h, max(abs((pg - pg0) - (occ + chr))) AS residual
FROM (SELECT h, t, grp, pg, occ, chr, lag(pg) OVER (PARTITION BY h, grp ORDER BY t) AS pg0 FROM {split}) a WHERE pg0 IS NOT NULL GROUP BY h"""

# lists: the first value and all steps up to each row
CUMULATIVE = """
SELECT h, ts[k] AS t, grp, pgs[1] + list_sum(occs[1:k]) AS driven
FROM (SELECT h, grp, ts, pgs, occs, unnest(range(1, len(ts) + 1)) AS k
      FROM (SELECT h, grp, list(t ORDER BY t) AS ts, list(pg ORDER BY t) AS pgs, list(occ ORDER BY t) AS occs FROM {split} GROUP BY h, grp) a) b"""

PROJECTED_MEAN = """
SELECT s.t, s.grp, m.mean, sqrt(sum(pow(s.pg - m.mean, 2)) / nullif(m.n - 1, 0) / m.n) AS sem, sum(s.occ) / m.n AS occ, sum(s.chr) / m.n AS chr
FROM {split} s JOIN (SELECT t, grp, sum(pg) / count(*) AS mean, count(*) AS n FROM {split} GROUP BY t, grp) m ON m.t = s.t AND m.grp = s.grp GROUP BY s.t, s.grp, m.mean, m.n"""

RUN_SUMMARY = """
SELECT grp, quantity, len(l) AS n, list_sum(l) / len(l) AS mean, quantile_cont(v, 0.5) AS median, CASE WHEN len(l) > 1 THEN stddev_samp(v) END AS std, list_min(l) AS least, list_max(l) AS most,
       len([x FOR x IN l IF x > :sign]) AS n_gain, len([x FOR x IN l IF x < -:sign]) AS n_loss, len([x FOR x IN l IF abs(x) <= :sign]) AS n_flat,
       len([x FOR x IN l IF x > :sign]) / CAST(len(l) AS DOUBLE) AS fraction_gain, len([x FOR x IN l IF x < -:sign]) / CAST(len(l) AS DOUBLE) AS fraction_loss,
       quantile_cont(v, 0.05) AS q05, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.95) AS q95
FROM (SELECT grp, quantity, value AS v, list(value) OVER (PARTITION BY grp, quantity) AS l FROM {quantities} WHERE value IS NOT NULL) x GROUP BY grp, quantity, l"""

CLASSIFIED = """
SELECT h, t, a, b, frame, grp, occ, chr, dp, change, gap, nac, swap, small_gap, strong_nac,
       CASE WHEN swap THEN CASE WHEN dp IS NULL THEN 'character_swap_population_not_evaluated' WHEN abs(dp) > :moved THEN 'character_swap_with_projected_fragment_change' ELSE 'character_swap_without_projected_fragment_change' END
            WHEN abs(dp) > :moved THEN 'fragment_population_change_without_character_swap'
            WHEN small_gap AND strong_nac THEN 'close_and_coupled_without_character_swap' ELSE 'flagged_metric_only' END AS classification,
       CASE WHEN abs(occ) + abs(chr) <= :moved THEN 'no_movement' WHEN abs(occ) >= :mostly * (abs(occ) + abs(chr)) THEN 'occupation_dominated'
            WHEN abs(occ) <= :hardly * (abs(occ) + abs(chr)) THEN 'character_dominated' ELSE 'mixed' END AS descriptor
FROM (SELECT e.h, e.t, p.a, p.b, e.frame, m.m.grp AS grp, m.m.occ AS occ, m.m.chr AS chr, m.m.pg - before.pg AS dp, greatest(ca.change, cb.change) AS change, abs(ea.e - eb.e) AS gap, abs(n.v) AS nac,
             ta.top <> ta0.top OR tb.top <> tb0.top OR ca.change >= :exchange OR cb.change >= :exchange AS swap,
             coalesce(abs(ea.e - eb.e) <= :gap, false) AS small_gap, coalesce(abs(n.v) >= :coupling, false) AS strong_nac
      FROM {event_rows} e CROSS JOIN (VALUES (0, 1), (1, 2), (2, 3), (3, 4)) p(a, b) JOIN {movers} m ON m.h = e.h AND m.t = e.t
      LEFT JOIN {split} before ON before.h = e.h AND before.t = e.t0 AND before.grp = m.m.grp
      JOIN (SELECT x.frame, y.frame AS frame0, x.band, max(abs(x.w - y.w)) AS change FROM {weights} x JOIN {weights} y ON x.band = y.band AND x.grp = y.grp
            JOIN (SELECT DISTINCT frame, frame0 FROM {event_rows}) k ON k.frame = x.frame AND k.frame0 = y.frame GROUP BY ALL) ca ON ca.frame = e.frame AND ca.frame0 = e.frame0 AND ca.band = p.a
      JOIN (SELECT x.frame, y.frame AS frame0, x.band, max(abs(x.w - y.w)) AS change FROM {weights} x JOIN {weights} y ON x.band = y.band AND x.grp = y.grp
            JOIN (SELECT DISTINCT frame, frame0 FROM {event_rows}) k ON k.frame = x.frame AND k.frame0 = y.frame GROUP BY ALL) cb ON cb.frame = e.frame AND cb.frame0 = e.frame0 AND cb.band = p.b
      JOIN {tops} ta ON ta.frame = e.frame AND ta.band = p.a JOIN {tops} ta0 ON ta0.frame = e.frame0 AND ta0.band = p.a
      JOIN {tops} tb ON tb.frame = e.frame AND tb.band = p.b JOIN {tops} tb0 ON tb0.frame = e.frame0 AND tb0.band = p.b
      LEFT JOIN {energies} ea ON ea.frame = e.frame AND ea.state = p.a LEFT JOIN {energies} eb ON eb.frame = e.frame AND eb.state = p.b
      LEFT JOIN {nac} n ON n.frame = e.frame AND n.i = p.a AND n.j = p.b) z
WHERE swap OR small_gap OR strong_nac OR abs(dp) > :moved"""

EPISODES = """
SELECT CAST(x.episode AS INT) AS episode, CAST(x.first_frame AS INT) AS first_frame, CAST(x.last_frame AS INT) AS last_frame, x.n_marks, min(abs(a.e - b.e)) AS min_gap, max(abs(n.v)) AS max_nac,
       (list(ta.top ORDER BY x.frame))[1] AS before, (list(ta.top ORDER BY x.frame))[-1] AS after, (list(tb.top ORDER BY x.frame))[1] AS before_b, (list(tb.top ORDER BY x.frame))[-1] AS after_b
FROM {spread} x, {energies} a, {energies} b, {nac} n, {tops} ta, {tops} tb
WHERE a.frame = x.frame AND a.state = :band_a AND b.frame = x.frame AND b.state = :band_b AND n.frame = x.frame AND n.i = :band_a AND n.j = :band_b
  AND ta.frame = x.frame AND ta.band = :band_a AND tb.frame = x.frame AND tb.band = :band_b GROUP BY x.episode, x.first_frame, x.last_frame, x.n_marks"""

# the counter itself: armed, one row after the other
THRESHOLDS = """
WITH RECURSIVE rows_in_order AS (SELECT h, d, a, row_number() OVER (PARTITION BY h ORDER BY t) AS k FROM {pairs}),
 walk(h, high, low, k, armed, n) AS (
  SELECT DISTINCT p.h, l.high, l.low, CAST(0 AS BIGINT), false, CAST(0 AS BIGINT) FROM {pairs} p CROSS JOIN {levels} l
  UNION ALL
  SELECT w.h, w.high, w.low, r.k, CASE WHEN r.d >= w.high THEN true WHEN w.armed AND r.d <= w.low AND r.a >= w.low THEN false ELSE w.armed END,
         w.n + CASE WHEN w.armed AND r.d < w.high AND r.d <= w.low AND r.a >= w.low THEN 1 ELSE 0 END
  FROM walk w JOIN rows_in_order r ON r.h = w.h AND r.k = w.k + 1)
SELECT h, high, low, max(n) AS n_events FROM walk GROUP BY h, high, low"""

VACF = """
SELECT CAST(lag AS INT) AS lag, sum(mass * total / n) / sum(mass) AS vacf
FROM (SELECT a.atom, l AS lag, any_value(a.m) AS mass, sum(a.vx * b.vx) + sum(a.vy * b.vy) + sum(a.vz * b.vz) AS total, count(*) AS n
      FROM generate_series(0, :max_lag) g(l) JOIN {moving} a ON true JOIN {moving} b ON b.atom = a.atom AND b.frame = a.frame + l GROUP BY a.atom, l) x GROUP BY lag"""

PAIRS = """
SELECT i, j, list_sum(g) / n AS mean_gap, sqrt(list_sum([x * x FOR x IN g]) / n) AS rms_gap, list_sum(v) / n AS mean_nac, sqrt(list_sum([x * x FOR x IN v]) / n) AS rms_nac,
       p95 AS p95_nac, list_max(v) AS max_nac, CAST(len([x FOR x IN v IF x > :nac_threshold]) AS BIGINT) AS n_above, n_at_max,
       list_max(v) * :dt / CAST(0.6582119569509066 AS DOUBLE) AS max_over_scale, len([x FOR x IN v IF x * :dt / CAST(0.6582119569509066 AS DOUBLE) > 0.8]) / CAST(n AS DOUBLE) AS above_80,
       len([x FOR x IN v IF x * :dt / CAST(0.6582119569509066 AS DOUBLE) > 0.9]) / CAST(n AS DOUBLE) AS above_90, list_sum(v) AS total, :dt * list_sum(v) AS integral
FROM (SELECT i, j, count(*) AS n, list(gap) AS g, list(size) AS v, quantile_cont(size, 0.95) AS p95, count(*) FILTER (size = most) AS n_at_max
      FROM (SELECT n.i, n.j, abs(n.v) AS size, abs(x.e - y.e) AS gap, (SELECT max(abs(v)) FROM {nac} WHERE i <> j) AS most
            FROM {nac} n, {energies} x, {energies} y WHERE n.j > n.i AND x.frame = n.frame AND y.frame = n.frame AND x.state = n.i AND y.state = n.j) a GROUP BY i, j) b"""

REPEATED = """
SELECT magnitude, n, n > 10 AND n > 0.001 * total AS is_ceiling
FROM (SELECT round(abs(v), 12) AS magnitude, count(*) AS n, (SELECT count(*) FROM {nac} WHERE i < j) AS total FROM {nac} WHERE i < j AND round(abs(v), 12) > 0 GROUP BY 1) a
ORDER BY n DESC, magnitude LIMIT 1"""

WINDOW_METRICS = """
SELECT grp, name, l[1] AS initial, l[-1] AS final, list_max(l) AS peak, ts[list_position(l, list_max(l))] AS peak_time, list_min(l) AS least, ts[list_position(l, list_min(l))] AS least_time,
       l[-1] - l[1] AS net, area AS integral, area / (ts[-1] - ts[1]) AS mean
FROM (SELECT *, list_sum([(l[i] + l[i + 1]) / 2 * (ts[i + 1] - ts[i]) FOR i IN range(1, len(l))]) AS area
      FROM (SELECT s.grp, w.name, list(s.mean ORDER BY s.t) AS l, list(s.t ORDER BY s.t) AS ts FROM {series} s, {windows} w WHERE s.t >= w.lo AND s.t <= w.hi GROUP BY s.grp, w.name) a) b"""

# lists of a spectrum's points, cut to a range, and summed over their neighbours
_POINTS = "SELECT label, list(f ORDER BY f) AS fs, list(y ORDER BY f) AS ys FROM {spectrum} GROUP BY label"
_AREA = "CASE WHEN len(fs) > 1 THEN list_sum([(ys[i] + ys[i + 1]) / 2 * (fs[i + 1] - fs[i]) FOR i IN range(1, len(fs))]) END"
_MOMENT = "list_sum([(ys[i] * fs[i] + ys[i + 1] * fs[i + 1]) / 2 * (fs[i + 1] - fs[i]) FOR i IN range(1, len(fs))])"


def _cut(low: str, high: str, points: str, ranges: str = "") -> str:
    return f"""SELECT label, fs AS every, {low} AS low, {high} AS high, [f FOR f IN fs IF f >= {low} AND f <= {high}] AS fs, [ys[i] FOR i IN range(1, len(fs) + 1) IF fs[i] >= {low} AND fs[i] <= {high}] AS ys
FROM ({points}) points{ranges}"""


DESCRIBED = f"""
SELECT label, CAST(len(every) AS BIGINT) AS n_points, every[1] AS f_least, every[-1] AS f_most, every[2] - every[1] AS resolution, {_AREA} AS range_integral,
       CAST(len([y FOR y IN ys IF y < 0]) AS BIGINT) AS n_negative, CASE WHEN list_min(ys) >= 0 AND {_AREA} > 0 THEN {_MOMENT} / {_AREA} END AS centroid
FROM ({_cut("0", "64", _POINTS)}) a"""

_RANGES = ", (VALUES (0.0, 8.0), (8.0, 16.0), (16.0, 32.0), (32.5, 33.2), (33.0, 80.0)) r(a, b)"


def _bands(points: str) -> str:
    return f"""SELECT x.label, CAST(x.low AS DOUBLE) AS low, CAST(x.high AS DOUBLE) AS high, x.integral, x.integral / nullif(w.integral, 0) AS fraction
FROM (SELECT label, low, high, {_AREA} AS integral FROM ({_cut("a", "b", points, _RANGES)}) a) x
JOIN (SELECT label, {_AREA} AS integral FROM ({_cut("0", "64", points)}) b) w ON w.label = x.label"""


BANDS = _bands(_POINTS.replace("{spectrum}", "{uneven}"))

COMPARED = f"""
WITH bands AS ({_bands(_POINTS)}), whole AS ({DESCRIBED})
SELECT b.label, b.low, b.high, b.fraction - r.fraction AS delta_fraction, b.integral / nullif(r.integral, 0) AS ratio_of_integral, w.centroid - v.centroid AS delta_centroid, w.range_integral / nullif(v.range_integral, 0) AS ratio_range_integral
FROM bands b JOIN bands r ON r.label = 0 AND r.low = b.low JOIN whole w ON w.label = b.label JOIN whole v ON v.label = 0
WHERE b.label <> 0 AND (SELECT count(DISTINCT fs) FROM ({_POINTS}) g) = 1"""

SHARED_GRID = """
SELECT s.label, CAST(len(s.fs) AS BIGINT) AS n_points, CAST(len(r.fs) AS BIGINT) AS n_reference, list_max([abs(s.fs[i] - r.fs[i]) FOR i IN range(1, least(len(s.fs), len(r.fs)) + 1)]) AS grid_difference,
       len(s.fs) = len(r.fs) AND coalesce(list_max([abs(s.fs[i] - r.fs[i]) FOR i IN range(1, least(len(s.fs), len(r.fs)) + 1)]) <= :grid, false) AS shared
FROM (SELECT label, list(f ORDER BY f) AS fs FROM {uneven} GROUP BY label) s JOIN (SELECT label, list(f ORDER BY f) AS fs FROM {uneven} GROUP BY label) r ON r.label = 0"""
