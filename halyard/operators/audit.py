"""Audits of energies and couplings: statistics of each pair of states, ceilings, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.template import bind

#: Reduced Planck constant in eV fs, wave numbers per inverse femtosecond.
HBAR = 0.6582119569509066
INV_FS_TO_CM1 = 33356.4095198152

SCALES = f"""
SELECT DISTINCT state, {HBAR}D / (state + 1) AS ev, 1000.0D * {HBAR}D / (state + 1) AS mev, (state + 1) * {INV_FS_TO_CM1}D AS cm1 FROM {{energies}}"""

TO_MEV = f"""
SELECT frame, i, j, CASE WHEN (i + j) % 3 = 0 THEN v * 1000.0D WHEN (i + j) % 3 = 1 THEN v ELSE v * {HBAR}D * 1000.0D END AS mev FROM {{nac}}"""

PAIRS = f"""
SELECT a.i, a.j, avg(abs(a.gap)) AS mean_gap, sqrt(avg(a.gap * a.gap)) AS rms_gap, avg(a.v) AS mean_nac, sqrt(avg(a.v * a.v)) AS rms_nac,
       PCT(a.v, 0.95) AS p95_nac, max(a.v) AS max_nac, count_if(a.v > :nac_threshold) AS n_above, count_if(a.v = m.most) AS n_at_max,
       max(a.v) / ({HBAR}D / :dt) AS max_over_scale, count_if(a.v > 0.8D * {HBAR}D / :dt) / CAST(count(*) AS DOUBLE) AS above_80,
       count_if(a.v > 0.9D * {HBAR}D / :dt) / CAST(count(*) AS DOUBLE) AS above_90, sum(a.v) AS total, sum(a.v) * :dt AS integral
FROM (SELECT n.frame, n.i, n.j, abs(n.v) AS v, ei.e - ej.e AS gap FROM {{nac}} n JOIN {{energies}} ei ON ei.frame = n.frame AND ei.state = n.i
      JOIN {{energies}} ej ON ej.frame = n.frame AND ej.state = n.j WHERE n.i < n.j) a
CROSS JOIN (SELECT max(abs(v)) AS most FROM {{nac}} WHERE i <> j) m
GROUP BY a.i, a.j"""

TOP_PAIRS = """
SELECT i, j, mean_nac FROM (SELECT i, j, avg(abs(v)) AS mean_nac FROM {nac} WHERE i < j GROUP BY i, j) a ORDER BY mean_nac DESC, i, j LIMIT :top"""

CEILING = """
SELECT m.most, count(*) AS n_shared, count(*) > 2 AS engineered
FROM {nac} n CROSS JOIN (SELECT max(abs(v)) AS most FROM {nac} WHERE i <> j) m WHERE n.i <> n.j AND abs(n.v) = m.most GROUP BY m.most"""

#: Decimals at which two magnitudes are the same, samples beyond which a magnitude is a ceiling.
SAME_PLACES, SHARED_BY, SHARED_PART = 12, 10, 0.001

# each pair counts once; of equally common magnitudes the least
REPEATED = f"""
WITH m AS (SELECT magnitude, count(*) AS n FROM (SELECT round(abs(v), {SAME_PLACES}) AS magnitude FROM {{nac}} WHERE i < j) a WHERE magnitude > 0 GROUP BY magnitude)
SELECT min(m.magnitude) AS magnitude, m.n, m.n > greatest({SHARED_BY}, {SHARED_PART} * t.total) AS is_ceiling
FROM m CROSS JOIN (SELECT max(n) AS most FROM m) x CROSS JOIN (SELECT count(v) AS total FROM {{nac}} WHERE i < j) t WHERE m.n = x.most GROUP BY m.n, t.total"""

CHECKS = """
SELECT max(CASE WHEN a.i = a.j THEN abs(a.v) ELSE 0 END) AS diagonal, max(abs(a.v + b.v)) AS asymmetry, max(abs(a.v)) AS largest,
       max(abs(a.v + b.v)) <= 1e-6 * max(abs(a.v)) AS antisymmetric, count(DISTINCT a.frame) AS n_frames
FROM {nac} a JOIN {nac} b ON a.frame = b.frame AND a.i = b.j AND a.j = b.i"""

ENERGY_STATS = "SELECT state, avg(e) AS mean, stddev_samp(e) AS std, min(e) AS least, max(e) AS most FROM {energies} GROUP BY state"

COUPLINGS = """
SELECT e.frame, e.state AS i, n.j, e.e, abs(n.v) AS nac_ev FROM {energies} e LEFT JOIN {nac} n ON n.frame = e.frame AND n.i = e.state AND n.j = e.state + 1"""

DEPHASING = """
SELECT min(v) AS least, PCT(v, 0.5) AS median, max(v) AS most FROM (SELECT i, j, avg(abs(v)) AS v FROM {nac} WHERE i < j GROUP BY i, j) a"""


def pair_statistics(nac, energies, **params):
    """One row for each pair i < j. Couplings meet energies on the frame twice, both sides keyed
    alike, so the second join reuses the first one's partitioning on frame."""
    return bind(PAIRS, params=params, nac=nac, energies=energies)


def ceiling_claim(nac, policy=None, **params):
    """The largest coupling and what it says: a magnitude that over two samples share is an imposed
    ceiling. Statistics are lower bounds only where the declared policy clips valid values; without a
    policy nothing is claimed of how they were changed."""
    found = bind(CEILING, params=params, nac=nac)
    imposed = "ceiling_without_policy" if policy is None else "ceiling_clipped" if policy.action == "clip" else "ceiling_not_clipped"
    claim = F.when(F.col("engineered"), F.lit(imposed)).otherwise("no_ceiling")
    return found.withColumn("claim", claim).withColumn("lower_bound", F.col("claim") == "ceiling_clipped")


def checked(nac, **params):
    """nac, or an error when it is not antisymmetric."""
    row = bind(CHECKS, params=params, nac=nac).first()
    if row["n_frames"] and not row["antisymmetric"]:
        raise ValueError(f"couplings are not antisymmetric: {row['asymmetry']}")
    return nac
