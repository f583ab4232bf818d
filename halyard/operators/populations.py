"""Populations on a shared grid: ensemble means, group series, windows, conservation.

A population is (h, t, state, p): history, row of the shared grid, state, share. Sums over
states happen inside a history before any mean over histories, so that the error of
a group keeps the covariance of its states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.template import bind
from . import ordered

ENSEMBLE = """
SELECT t, state, avg(p) AS mean, stddev_samp(p) / sqrt(count(*)) AS sem, count(*) AS n
FROM {pop} GROUP BY t, state"""

FILE_GROUPS = """
SELECT p.h, p.t, g.grp, sum(p.p) AS value
FROM {pop} p JOIN {state_groups} g ON p.state = g.state GROUP BY p.h, p.t, g.grp"""

GROUP_SERIES = f"""
SELECT t, grp, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS sem
FROM ({FILE_GROUPS}) f GROUP BY t, grp"""

UNGROUPED = """
SELECT DISTINCT p.state FROM {pop} p
WHERE NOT EXISTS (SELECT 1 FROM {state_groups} g WHERE g.state = p.state)"""

COVERAGE = """
SELECT c.h, c.n_cells, c.n_rows, c.n_cells = m.longest * m.n_states AND c.n_rows = m.longest AS complete
FROM (SELECT h, count(*) AS n_cells, count(DISTINCT t) AS n_rows FROM {pop} GROUP BY h) c
CROSS JOIN (SELECT count(DISTINCT t) AS longest, count(DISTINCT state) AS n_states FROM {pop}) m"""

SURVIVAL = """
SELECT t, avg(alive) AS survival, stddev_samp(alive) / sqrt(count(*)) AS sem
FROM (SELECT h, t, 1 - sum(CASE WHEN state = :recombined THEN p ELSE 0 END) AS alive FROM {pop} GROUP BY h, t) a GROUP BY t"""

TRAPEZOID = """
SELECT grp, sum(0.5 * (y + y0) * (t - t0)) AS integral
FROM (SELECT grp, t, mean AS y, lag(mean) OVER (PARTITION BY grp ORDER BY t) AS y0, lag(t) OVER (PARTITION BY grp ORDER BY t) AS t0
      FROM {series}) a GROUP BY grp"""

# argmax and argmin take the first of equal values, as ordered by (value, time)
WINDOW_METRICS = """
SELECT grp, name,
       max(CASE WHEN first_row = 1 THEN y END) AS initial, max(CASE WHEN last_row = 1 THEN y END) AS final,
       max(y) AS peak, max(CASE WHEN top_row = 1 THEN t END) AS peak_time,
       min(y) AS least, max(CASE WHEN low_row = 1 THEN t END) AS least_time,
       max(CASE WHEN last_row = 1 THEN y END) - max(CASE WHEN first_row = 1 THEN y END) AS net,
       sum(coalesce(0.5 * (y + y0) * (t - t0), 0)) AS integral,
       sum(coalesce(0.5 * (y + y0) * (t - t0), 0)) / (max(t) - min(t)) AS mean
FROM (SELECT s.grp, w.name, s.t, s.mean AS y,
             lag(s.mean) OVER (PARTITION BY s.grp, w.name ORDER BY s.t) AS y0, lag(s.t) OVER (PARTITION BY s.grp, w.name ORDER BY s.t) AS t0,
             row_number() OVER (PARTITION BY s.grp, w.name ORDER BY s.t) AS first_row,
             row_number() OVER (PARTITION BY s.grp, w.name ORDER BY s.t DESC) AS last_row,
             row_number() OVER (PARTITION BY s.grp, w.name ORDER BY s.mean DESC, s.t) AS top_row,
             row_number() OVER (PARTITION BY s.grp, w.name ORDER BY s.mean, s.t) AS low_row
      FROM {series} s JOIN {windows} w ON s.t BETWEEN w.lo AND w.hi) a
GROUP BY grp, name HAVING count(*) >= 2"""

REGIMES = """
SELECT e.grp, e.mean AS early_mean, l.mean AS late_mean, e.peak AS early_peak, l.peak AS late_peak,
       CASE WHEN l.peak > 0 THEN e.peak / l.peak END AS peak_ratio, e.net AS early_net, l.net AS late_net,
       coalesce(e.peak / nullif(l.peak, 0) > :peak_ratio AND abs(l.net) < :still, false) AS transient_only
FROM {metrics} e JOIN {metrics} l ON e.grp = l.grp WHERE e.name = :early AND l.name = :late"""

CONSERVATION = """
SELECT min(total) AS least, max(total) AS most, avg(total) AS mean, max(abs(1 - total)) AS deviation, max(abs(1 - total)) <= :conserved AS conserved
FROM (SELECT h, t, sum(p) AS total FROM {pop} GROUP BY h, t) a"""

TALLY = """
SELECT h, min(low) AS least, max(high) AS most, min(total) AS least_total, max(total) AS most_total,
       min(low) >= -:conserved AND max(high) <= 1 + :conserved AND max(abs(1 - total)) <= :conserved AS valid
FROM (SELECT h, t, min(p) AS low, max(p) AS high, sum(p) AS total FROM {pop} GROUP BY h, t) a GROUP BY h"""

UNIFORMITY = """
SELECT h, avg(step) AS mean_step, min(step) AS least_step, max(step) AS most_step,
       (max(step) - min(step)) / avg(step) AS spread, (max(step) - min(step)) / avg(step) <= :uniform AS is_uniform
FROM (SELECT h, CAST(t - lag(t) OVER (PARTITION BY h ORDER BY t) AS DOUBLE) AS step FROM (SELECT DISTINCT h, t FROM {pop}) g) a
GROUP BY h"""

INCREASING = """
SELECT h, count_if(t <= t0) AS n_not_increasing, count(*) AS n_rows
FROM (SELECT h, t, lag(t) OVER (PARTITION BY h ORDER BY t) AS t0 FROM (SELECT DISTINCT h, t FROM {pop}) g) a GROUP BY h"""

UNIFORM_STEPS = """
SELECT h, avg(step) AS mean_step, min(step) AS least_step, max(step) AS most_step, (max(step) - min(step)) / avg(step) AS spread, (max(step) - min(step)) / avg(step) <= :uniform AS is_uniform
FROM (SELECT h, CAST(t - t0 AS DOUBLE) AS step FROM {steps}) a GROUP BY h"""

NOT_INCREASING = "SELECT h, count_if(t <= t0) AS n_not_increasing, count(*) AS n_rows FROM {steps} GROUP BY h"

SAME_GRID = """
SELECT t, count(DISTINCT h) AS n_histories, count(DISTINCT h) = (SELECT count(DISTINCT h) FROM {pop}) AS shared FROM {pop} GROUP BY t"""

MASTER = """
SELECT t, state, CASE WHEN min(p) = max(p) THEN 'copied' ELSE 'averaged' END AS policy, avg(p) AS value, max(p) - min(p) AS spread
FROM {pop} GROUP BY t, state"""

TIME_UNITS = "SELECT DISTINCT t, t / 1e6 AS from_fs, t / 1e3 AS from_ps, t / 1e0 AS from_ns FROM {pop}"

RESOLVED = """
SELECT name, coalesce(lo, first_t) AS lo, coalesce(hi, last_t) AS hi, count(*) AS n_rows
FROM {windows} w
CROSS JOIN (SELECT min(t) AS first_t, max(t) AS last_t FROM {pop}) e
JOIN (SELECT DISTINCT t FROM {pop}) g ON g.t BETWEEN coalesce(lo, first_t) AND coalesce(hi, last_t)
GROUP BY name, coalesce(lo, first_t), coalesce(hi, last_t)"""

FIRST_WINDOW = """
SELECT t, coalesce(name, 'outside') AS name
FROM (SELECT g.t, w.name, row_number() OVER (PARTITION BY g.t ORDER BY w.ord) AS place
      FROM (SELECT DISTINCT t FROM {pop}) g LEFT JOIN {windows} w ON g.t BETWEEN w.lo AND w.hi) a
WHERE place = 1"""

SWEEP = """
SELECT k, :low_rate * pow(:high_rate / :low_rate, k / CAST(:n_rates - 1 AS DOUBLE)) AS rate FROM {counts} WHERE k < :n_rates"""


def ensemble(pop: DataFrame, **params) -> DataFrame:
    """t, state, mean, sem, n: equal weight for each history; sem is null for one history."""
    return bind(ENSEMBLE, params=params, pop=pop)


def file_groups(pop: DataFrame, state_groups: DataFrame, **params) -> DataFrame:
    return bind(FILE_GROUPS, params=params, pop=pop, state_groups=F.broadcast(state_groups))


def group_series(pop: DataFrame, state_groups: DataFrame, **params) -> DataFrame:
    return bind(GROUP_SERIES, params=params, pop=pop, state_groups=F.broadcast(state_groups))


def trapezoid(series: DataFrame, width: float = ordered.WIDTH) -> DataFrame:
    """grp, integral of series(grp, t, mean)."""
    out = ordered.summary(ordered.dealt(series.select("grp", "t", "mean"), ["grp"], "t", width), ["grp"], "t", "mean")
    # as a sum over steps: null where there is none
    return out.select("grp", F.when(F.col("n") > 1, F.col("integral")).alias("integral"))


def window_metrics(series: DataFrame, windows: DataFrame, width: float = ordered.WIDTH) -> DataFrame:
    """Nine metrics of each group in each window; the window is cut before any difference.

    windows is a list of a few ranges and is broadcast."""
    cut = series.select("grp", "t", "mean").join(F.broadcast(windows.select("name", "lo", "hi")), F.col("t").between(F.col("lo"), F.col("hi"))).select("grp", "name", "t", "mean")
    keys = ["grp", "name"]
    state = ordered.summary(ordered.dealt(cut, keys, "t", width), keys, "t", "mean").filter("n >= 2")
    time = series.schema["t"].dataType
    return state.select(
        *keys,
        F.col("first.y").alias("initial"), F.col("last.y").alias("final"),
        F.col("peak.y").alias("peak"), F.col("peak.at").cast(time).alias("peak_time"), F.col("least.y").alias("least"), F.col("least.at").cast(time).alias("least_time"),
        (F.col("last.y") - F.col("first.y")).alias("net"), "integral", (F.col("integral") / (F.col("last.at") - F.col("first.at"))).alias("mean"),
    )


def uniformity(pop: DataFrame, width: float = ordered.WIDTH, **params) -> DataFrame:
    """Of each history's grid: h, mean_step, least_step, most_step, spread, is_uniform."""
    return bind(UNIFORM_STEPS, params=params, steps=_steps(pop, width))


def strict_increase(pop: DataFrame, width: float = ordered.WIDTH) -> DataFrame:
    """h, n_not_increasing, n_rows of each history's grid."""
    return bind(NOT_INCREASING, steps=_steps(pop, width))


def _steps(pop: DataFrame, width: float) -> DataFrame:
    """h, t, t0: each point of a history's grid and the one before."""
    blocks = ordered.dealt(pop.select("h", "t"), ["h"], "t", width).distinct()
    return ordered.with_previous(blocks, ["h"], "t", ["t"]).select("h", "t", F.col("previous.t").alias("t0"))


def flat_metrics(metrics: DataFrame, groups: list[str], fields: list[str]) -> DataFrame:
    """One row for each window with <group>_<field> columns."""
    return metrics.groupBy("name").pivot("grp", groups).agg(*[F.first(f).alias(f) for f in fields])


def regimes(metrics: DataFrame, **params) -> DataFrame:
    return bind(REGIMES, params=params, metrics=metrics)


def check_population(pop: DataFrame, **params) -> DataFrame:
    """pop, or an error that names what is wrong: shares outside [0, 1], totals that are not
    conserved, grids that differ."""
    bad = bind(TALLY, params=params, pop=pop).filter("not valid").count()
    if bad:
        raise ValueError(f"{bad} histories hold shares outside [0, 1] or totals other than 1")
    odd = bind(SAME_GRID, params=params, pop=pop).filter("not shared").count()
    if odd:
        raise ValueError(f"{odd} rows of the grid are not in every history")
    return pop
