"""Episodes: runs of crossings of a band pair, their verdicts, isolation and alignment."""

from __future__ import annotations

from ..plans.template import bind
from .character import DOMINANT

MARKS = f"""
SELECT p.frame FROM (SELECT frame, band, dominant, lag(dominant) OVER (PARTITION BY band ORDER BY frame) AS before FROM ({DOMINANT}) d WHERE band IN (:band_a, :band_b)) p
GROUP BY p.frame
HAVING count_if(p.before <> p.dominant) > 0 AND count_if(p.before IN (:donor, :acceptor) AND p.dominant IN (:donor, :acceptor)) > 0"""

# gaps and islands: a mark more than twice the pad after the last one opens an episode
ISLANDS = f"""
SELECT episode, greatest(1, min(frame) - :pad) AS first_frame, least(max(m.last), max(frame) + :pad) AS last_frame, count(*) AS n_marks
FROM (SELECT frame, sum(CASE WHEN frame - prev <= 2 * :pad THEN 0 ELSE 1 END) OVER (ORDER BY frame) AS episode
      FROM (SELECT frame, lag(frame) OVER (ORDER BY frame) AS prev FROM ({MARKS}) m) a) b CROSS JOIN (SELECT max(frame) AS last FROM {{weights}}) m
GROUP BY episode"""

EPISODES = f"""
SELECT CAST(x.episode AS INT) AS episode, CAST(x.first_frame AS INT) AS first_frame, CAST(x.last_frame AS INT) AS last_frame, x.n_marks, min(abs(a.e - b.e)) AS min_gap, max(abs(n.v)) AS max_nac,
       min_by(d.dominant, d.frame) AS before, max_by(d.dominant, d.frame) AS after, min_by(o.dominant, o.frame) AS before_b, max_by(o.dominant, o.frame) AS after_b
FROM {{spread}} x JOIN {{energies}} a ON a.state = :band_a AND a.frame = x.frame JOIN {{energies}} b ON b.state = :band_b AND b.frame = a.frame
JOIN {{nac}} n ON n.i = :band_a AND n.j = :band_b AND n.frame = a.frame JOIN ({DOMINANT}) d ON d.band = :band_a AND d.frame = a.frame
JOIN ({DOMINANT}) o ON o.band = :band_b AND o.frame = a.frame
GROUP BY x.episode, x.first_frame, x.last_frame, x.n_marks"""

# each episode once for each of its frames: all joins are on the frame
SPREAD = f"SELECT *, explode(sequence(first_frame, last_frame)) AS frame FROM ({ISLANDS}) i"

# the donor gives, the acceptor takes
VERDICT = """
SELECT h, name, d_occ + d_chr AS donor_net, a_occ + a_chr AS acceptor_net,
       CASE WHEN abs(a_occ + a_chr) <= :moved AND abs(d_occ + d_chr) <= :moved THEN 'no_net_fragment_transfer'
            WHEN abs(a_occ) / nullif(abs(a_occ) + abs(a_chr), 0) >= :mostly THEN 'occupation_redistribution_dominated'
            WHEN abs(a_occ) / nullif(abs(a_occ) + abs(a_chr), 0) <= :hardly THEN 'character_following_transfer' ELSE 'mixed' END AS verdict,
       CASE WHEN a_occ + a_chr > 0 AND d_occ + d_chr < 0 THEN 'donor_to_acceptor' WHEN a_occ + a_chr < 0 AND d_occ + d_chr > 0 THEN 'acceptor_to_donor' ELSE 'undetermined' END AS direction
FROM (SELECT s.h, w.name, sum(CASE WHEN grp = :donor THEN occ ELSE 0 END) AS d_occ, sum(CASE WHEN grp = :donor THEN chr ELSE 0 END) AS d_chr,
             sum(CASE WHEN grp = :acceptor THEN occ ELSE 0 END) AS a_occ, sum(CASE WHEN grp = :acceptor THEN chr ELSE 0 END) AS a_chr
      FROM {split} s JOIN {windows} w ON s.t BETWEEN w.lo AND w.hi GROUP BY s.h, w.name) a"""

ISOLATION = """
SELECT n.state AS neighbour, p.min_gap, p.median_gap, min(least(abs(n.e - a.e), abs(n.e - b.e))) AS separation, PCT(least(abs(n.e - a.e), abs(n.e - b.e)), 0.5) AS median_separation, min(least(abs(n.e - a.e), abs(n.e - b.e))) / p.min_gap AS ratio
FROM {energies} n JOIN {energies} a ON a.frame = n.frame AND a.state = :band_a JOIN {energies} b ON b.frame = n.frame AND b.state = :band_b
CROSS JOIN (SELECT min(abs(x.e - y.e)) AS min_gap, PCT(abs(x.e - y.e), 0.5) AS median_gap FROM {energies} x JOIN {energies} y ON x.frame = y.frame WHERE x.state = :band_a AND y.state = :band_b AND x.frame BETWEEN :first AND :last) p
WHERE n.state NOT IN (:band_a, :band_b) AND n.frame BETWEEN :first AND :last GROUP BY n.state, p.min_gap, p.median_gap"""

# a passage there and back ends as it began, so a sign that turns anywhere inside counts
RAW_WEIGHT = """
SELECT band, min(w_d) < 0 AND max(w_d) > 0 AS normalized_swaps, min(raw_d) < 0 AND max(raw_d) > 0 AS raw_swaps,
       (min(w_d) < 0 AND max(w_d) > 0) = (min(raw_d) < 0 AND max(raw_d) > 0) AS agree,
       max(CASE WHEN w_place = 1 THEN frame END) AS normalized_frame, max(CASE WHEN raw_place = 1 THEN frame END) AS raw_frame, max(abs(raw_d - raw_first)) AS excursion,
       min(captured) AS captured_least, max(captured) AS captured_most, (max(captured) - min(captured)) / avg(captured) AS captured_range
FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY abs(raw_d - raw_first) DESC, frame) AS raw_place, row_number() OVER (PARTITION BY band ORDER BY abs(w_d - w_first) DESC, frame) AS w_place
      FROM (SELECT band, frame, captured, raw_d, w_d, first_value(raw_d) OVER (PARTITION BY band ORDER BY frame) AS raw_first, first_value(w_d) OVER (PARTITION BY band ORDER BY frame) AS w_first
            FROM (SELECT band, frame, max(captured) AS captured, sum(CASE WHEN grp = :donor THEN w WHEN grp = :acceptor THEN -w ELSE 0 END) AS w_d,
                         sum(CASE WHEN grp = :donor THEN w * captured WHEN grp = :acceptor THEN -w * captured ELSE 0 END) AS raw_d
                  FROM {weights} WHERE frame BETWEEN :first AND :last GROUP BY band, frame) a) b) c GROUP BY band"""

PARTICIPATION = f"""
SELECT s.band, s.separation, s.pair_gap, f.n_fragments, f.n_other,
       CASE WHEN f.n_other = 0 AND f.n_fragments > 1 THEN 'participates_in_fragment_transfer' WHEN s.separation < s.pair_gap THEN 'energetically_involved_only' ELSE 'not_involved' END AS verdict
FROM (SELECT n.state AS band, min(least(abs(n.e - a.e), abs(n.e - b.e))) AS separation, min(min(abs(a.e - b.e))) OVER () AS pair_gap
      FROM {{energies}} n JOIN {{energies}} a ON a.frame = n.frame AND a.state = :band_a JOIN {{energies}} b ON b.frame = n.frame AND b.state = :band_b
      WHERE n.state NOT IN (:band_a, :band_b) AND n.frame BETWEEN :first AND :last GROUP BY n.state) s
JOIN (SELECT band, count(DISTINCT dominant) AS n_fragments, count_if(dominant NOT IN (:donor, :acceptor)) AS n_other FROM ({DOMINANT}) d WHERE frame BETWEEN :first AND :last GROUP BY band) f ON f.band = s.band"""

ALIGNMENT = """
SELECT shift, score, n, score = max(score) OVER () AS best
FROM (SELECT s.shift, corr(m.mix, -ln(g.gap + 1e-12)) AS score, count(*) AS n
      FROM (SELECT frame, least(max(CASE WHEN grp = :donor THEN w END), max(CASE WHEN grp = :acceptor THEN w END)) AS mix FROM {weights} WHERE band = :band_a GROUP BY frame) m
      CROSS JOIN {shifts} s
      JOIN (SELECT a.frame, abs(a.e - b.e) AS gap FROM {energies} a JOIN {energies} b ON a.frame = b.frame WHERE a.state = :band_a AND b.state = :band_b) g ON g.frame = m.frame + s.shift
      GROUP BY s.shift HAVING count(*) >= :overlap) x"""

LOCAL_TABLE = f"""
SELECT w.frame, max(abs(a.e - b.e)) AS gap, max(abs(n.v)) AS nac, max(CASE WHEN w.band = :band_a AND w.grp = :donor THEN w.w END) AS a_ga, max(CASE WHEN w.band = :band_a AND w.grp = :acceptor THEN w.w END) AS a_gb,
       max(CASE WHEN w.band = :band_b AND w.grp = :donor THEN w.w END) AS b_ga, max(CASE WHEN w.band = :band_b AND w.grp = :acceptor THEN w.w END) AS b_gb,
       max(CASE WHEN d.band = :band_a THEN d.dominant END) AS dominant_a, max(CASE WHEN d.band = :band_b THEN d.dominant END) AS dominant_b
FROM {{weights}} w JOIN ({DOMINANT}) d ON d.frame = w.frame AND d.band = w.band JOIN {{energies}} a ON a.frame = w.frame AND a.state = :band_a JOIN {{energies}} b ON b.frame = w.frame AND b.state = :band_b
JOIN {{nac}} n ON n.frame = w.frame AND n.i = :band_a AND n.j = :band_b WHERE w.frame BETWEEN :first AND :last AND w.band IN (:band_a, :band_b) GROUP BY w.frame"""

MANIFOLD = """
SELECT a.frame, max(CASE WHEN a.state = 0 THEN a.e END) AS e0, max(CASE WHEN a.state = 1 THEN a.e END) AS e1, max(CASE WHEN a.state = 2 THEN a.e END) AS e2,
       max(CASE WHEN a.state = 0 AND b.state = 1 THEN abs(a.e - b.e) END) AS gap01, max(CASE WHEN a.state = 0 AND b.state = 2 THEN abs(a.e - b.e) END) AS gap02,
       max(CASE WHEN a.state = 1 AND b.state = 2 THEN abs(a.e - b.e) END) AS gap12, max(CASE WHEN n.i = 0 AND n.j = 1 THEN abs(n.v) END) AS nac01
FROM {energies} a JOIN {energies} b ON a.frame = b.frame LEFT JOIN {nac} n ON n.frame = a.frame AND n.i = a.state AND n.j = b.state
WHERE a.frame BETWEEN :first AND :last AND a.state <= 2 AND b.state <= 2 GROUP BY a.frame"""


def episodes(weights, energies, nac, **params):
    spread = bind(SPREAD, params=params, weights=weights)
    return bind(EPISODES, params=params, spread=spread, weights=weights, energies=energies, nac=nac)
