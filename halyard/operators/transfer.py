"""Transfer between a donor and an acceptor: continuous change and counted threshold events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered

# as windows over whole histories: what the block-wise forms below must equal
CONTINUOUS = """
SELECT h, max_by(d, t) - min_by(d, t) AS donor_net, max_by(a, t) - min_by(a, t) AS acceptor_net, max(greatest(abs(d - d0), abs(a - a0))) AS max_step,
       sum(least(greatest(d0 - d, 0), greatest(a - a0, 0))) AS concomitant
FROM (SELECT h, t, d, a, lag(d) OVER (PARTITION BY h ORDER BY t) AS d0, lag(a) OVER (PARTITION BY h ORDER BY t) AS a0 FROM {pairs}) x GROUP BY h"""

# Arming while armed changes nothing, so each donor >= high row may open a block; a block's first row
# with the donor low and the acceptor up is its event.
THRESHOLDS = """
SELECT g.h, g.high, g.low, coalesce(e.n, 0) AS n_events
FROM (SELECT DISTINCT p.h, k.high, k.low FROM {pairs} p CROSS JOIN {levels} k) g
LEFT JOIN (SELECT h, high, low, count(DISTINCT block) AS n
           FROM (SELECT p.h, p.t, p.d, p.a, k.high, k.low, sum(CASE WHEN p.d >= k.high THEN 1 ELSE 0 END) OVER (PARTITION BY p.h, k.high, k.low ORDER BY p.t) AS block
                 FROM {pairs} p CROSS JOIN {levels} k) x
           WHERE block > 0 AND d <= low AND a >= low GROUP BY h, high, low) e ON e.h = g.h AND e.high = g.high AND e.low = g.low"""


def continuous_change(pairs: DataFrame, width: float = ordered.WIDTH) -> DataFrame:
    """h, donor_net, acceptor_net, max_step, concomitant of pairs(h, t, d, a): donor and acceptor shares."""
    rows = ordered.with_previous(ordered.dealt(pairs.select("h", "t", "d", "a"), ["h"], "t", width), ["h"], "t", ["d", "a"])
    gained, lost = F.col("a") - F.col("previous.a"), F.col("previous.d") - F.col("d")
    return rows.groupBy("h").agg(
        (F.max_by("d", "t") - F.min_by("d", "t")).alias("donor_net"),
        (F.max_by("a", "t") - F.min_by("a", "t")).alias("acceptor_net"),
        F.max(F.greatest(F.abs(lost), F.abs(gained))).alias("max_step"),
        F.sum(F.least(F.greatest(lost, F.lit(0.0)), F.greatest(gained, F.lit(0.0)))).alias("concomitant"),
    )


def threshold_events(pairs: DataFrame, levels: DataFrame, width: float = ordered.WIDTH) -> DataFrame:
    """h, high, low, n_events of a re-arming counter: armed at d >= high, counted at d <= low with a >= low.
    levels is a list of thresholds and is broadcast."""
    if levels.filter("low >= high").count():
        raise ValueError("a low threshold must be below its high threshold")
    each = pairs.select("h", "t", "d", "a").crossJoin(F.broadcast(levels.select("high", "low").distinct()))
    keys = ["h", "high", "low"]
    blocks = ordered.dealt(each, keys, "t", width)
    return ordered.counted_transitions(blocks, keys, "t", F.col("d") >= F.col("high"), (F.col("d") <= F.col("low")) & (F.col("a") >= F.col("low")))
