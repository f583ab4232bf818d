"""Block-wise ordered operations against windows over whole series, for any block size and any gaps."""

import random
import re

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from halyard.operators import character, ensemble, ordered, populations, transfer
from halyard.plans import oracles
from halyard.plans.template import bind

WIDTHS = [1, 3, 10, 1000]


def near(found, wanted):
    def shaped(rows):
        return sorted([tuple("null" if x is None else x for x in r) for r in rows], key=lambda r: [(str(type(x)), round(x, 6) if isinstance(x, float) else x) for x in r])

    found, wanted = shaped(found), shaped(wanted)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert a == pytest.approx(b, abs=1e-9)


def times(rnd, n):
    """A grid with gaps that are longer than most blocks."""
    out, t = [], rnd.randrange(5)
    for _ in range(n):
        out.append(t)
        t += rnd.choice((1, 1, 1, 1, 2, 7, 40))
    return out


@pytest.fixture(scope="module")
def pairs(spark):
    rnd, rows = random.Random(4), []
    for h in range(5):
        d = 0.5
        for t in times(rnd, 1 if h == 4 else 70):
            d = min(1.0, max(0.0, d + rnd.choice((-0.5, -0.2, 0.0, 0.2, 0.5))))
            rows.append((h, t, d, rnd.choice((1 - d, 0.0, 0.3))))
    return spark.createDataFrame(rows, "h int, t int, d double, a double").repartition(3).persist()


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(5)
    rows = [(t, g, float(rnd.randrange(6))) for g in ("a", "b", "c") for t in times(rnd, 60)] + [(3, "one", 1.0)]
    return spark.createDataFrame(rows, "t int, grp string, mean double").persist()


@pytest.mark.parametrize("width", WIDTHS)
def test_previous_and_running_sum(spark, pairs, width):
    blocks = ordered.dealt(pairs, ["h"], "t", width)
    found = ordered.with_previous(blocks, ["h"], "t", ["d", "t"]).select("h", "t", "previous.d", F.col("previous.t").alias("t0"))
    near(found.collect(), spark.sql("SELECT h, t, lag(d) OVER (PARTITION BY h ORDER BY t) d, lag(t) OVER (PARTITION BY h ORDER BY t) t0 FROM {pairs}", pairs=pairs).collect())
    found = ordered.running_sum(blocks, ["h"], "t", "d", "s").select("h", "t", "s")
    near(found.collect(), spark.sql("SELECT h, t, sum(d) OVER (PARTITION BY h ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) s FROM {pairs}", pairs=pairs).collect())


@pytest.mark.parametrize("width", WIDTHS)
def test_transfer_equals_window_forms(spark, pairs, width):
    near(transfer.continuous_change(pairs, width).collect(), bind(transfer.CONTINUOUS, pairs=pairs).collect())
    levels = spark.createDataFrame([(0.9, 0.1), (0.8, 0.2), (0.5, 0.45), (2.0, 1.0)], "high double, low double")
    found = transfer.threshold_events(pairs, levels, width).collect()
    near(found, bind(transfer.THRESHOLDS, pairs=pairs, levels=levels).collect())
    assert any(r["n_events"] > 2 for r in found)


@pytest.mark.parametrize("seed", range(4))
def test_counter_equals_the_walk_for_any_block_size(spark, seed):
    """The counter, one row after the other."""
    rnd = random.Random(seed)
    rows, wanted = [], {}
    for h in range(12):
        armed = n = 0
        for t in times(rnd, rnd.choice((0, 1, 5, 80))):
            d, a = rnd.choice((0.0, 0.1, 0.5, 0.9, 1.0)), rnd.choice((0.0, 0.1, 0.9))
            rows.append((h, t, d, a))
            if d >= 0.9:
                armed = 1
            elif armed and d <= 0.1 and a >= 0.1:
                armed, n = 0, n + 1
            wanted[h] = n
    table = spark.createDataFrame(rows, "h int, t int, d double, a double")
    levels = spark.createDataFrame([(0.9, 0.1)], "high double, low double")
    found = transfer.threshold_events(table, levels, rnd.choice((1, 2, 5, 13, 60))).collect()
    assert {r["h"]: r["n_events"] for r in found} == wanted


@pytest.mark.parametrize("width", WIDTHS)
def test_series_summaries_equal_window_forms(spark, series, width):
    near(populations.trapezoid(series, width).collect(), bind(populations.TRAPEZOID, series=series).collect())
    windows = spark.createDataFrame([("all", 0, 10_000), ("early", 0, 40), ("one", 3, 3), ("none", -9, -1)], "name string, lo int, hi int")
    near(populations.window_metrics(series, windows, width).collect(), bind(populations.WINDOW_METRICS, series=series, windows=windows).collect())
    other = series.withColumn("mean", 3.0 - F.col("mean") * F.col("t") % 5)
    near(character.fixed_vs_projected(series, other, width).collect(), bind(character.FIXED_VS_PROJECTED, projected=series, fixed=other).collect())


@pytest.mark.parametrize("width", WIDTHS)
def test_runs_and_grids_equal_window_forms(spark, series, width):
    runs = series.selectExpr("grp AS state", "t", "mean AS p", "0 AS h").crossJoin(spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", -1.0)], "run string, f double"))
    runs = runs.selectExpr("run", "h", "t", "state", "p * f + t % 3 * f AS p")
    near(ensemble.differences(runs, "A", width).collect(), bind(ensemble.DIFFERENCES, runs=runs).collect())
    pop = series.selectExpr("grp AS h", "t", "'x' AS state", "mean AS p")
    near(populations.uniformity(pop, width).collect(), bind(populations.UNIFORMITY, pop=pop).collect())
    near(populations.strict_increase(pop, width).collect(), bind(populations.INCREASING, pop=pop).collect())


# the split -------------------------------------------------------------------------------------------


def split_inputs(spark, drop_weight=None, drop_share=None):
    rnd = random.Random(6)
    pop, walk = [], []
    for h in range(3):
        for k, t in enumerate(times(rnd, 40)):
            shares = [rnd.random() for _ in range(3)]
            walk.append((h, t, k % 7 + 1))
            pop += [(h, t, f"s{b}", b, p / sum(shares)) for b, p in enumerate(shares) if (h, k, b) != drop_share]
    weights = [(f, b, g, o, rnd.random(), 1.0, 1.0) for f in range(1, 8) for b in range(3) for o, g in enumerate("uv") if (f, b, g) not in (drop_weight or ())]
    return (
        spark.createDataFrame(pop, "h int, t int, state string, band int, p double"),
        spark.createDataFrame(walk, "h int, t int, frame int"),
        spark.createDataFrame(weights, "frame int, band int, grp string, ord int, w double, captured double, total double"),
    )


@pytest.mark.parametrize("width", WIDTHS)
def test_split_equals_window_form(spark, width):
    pop, walk, weights = split_inputs(spark)
    parts = character.split_blocks(character.packed(pop), walk, weights, width).persist()
    near(parts.select("h", "t", "grp", "pg", "occ", "chr").collect(), bind(character.SPLIT, pop=pop, rows_frames=walk, weights=weights).collect())
    assert max(r["residual"] for r in bind(character.RESIDUAL, split=parts).collect()) < 1e-12
    near(character.walk(walk, width).collect(), spark.sql("SELECT h, t, frame, lag(frame) OVER (PARTITION BY h ORDER BY t) f0 FROM {w}", w=walk).collect())
    wanted = spark.sql("SELECT h, t, grp, first_value(pg) OVER w + sum(occ) OVER w AS driven FROM {p} WINDOW w AS (PARTITION BY h, grp ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", p=parts)
    near(character.driven(parts, width).collect(), wanted.collect())
    arrays = character.split_arrays(character.packed(pop), walk, weights, width)
    from halyard.operators import events

    near(bind(events.HISTORY_STEPS, arrays=arrays).select("h", "t", "frame", "frame0", "grp", "occ", "chr", "dp").collect(), bind(oracles.STEPS, split=parts.select("h", "t", "grp", "pg", "occ", "chr"), rows_frames=walk).collect())


def test_sums_written_out_equal_sums_over_arrays(spark, monkeypatch):
    pop, walk, weights = split_inputs(spark)
    rows = character.packed(pop).join(walk, ["h", "t"]).drop("bands")
    both = []
    for most in (character.WRITTEN_OUT, 0):
        monkeypatch.setattr(character, "WRITTEN_OUT", most)
        both.append(character.split_blocks(rows, None, weights, 10).select("h", "t", "grp", "pg", "occ", "chr", "pg0").collect())
    near(*both)
    # the checks hold whatever columns are read
    monkeypatch.undo()
    short = rows.withColumn("p", F.expr("slice(p, 1, 2)"))
    with pytest.raises(SparkRuntimeException, match="bands are not those"):
        character.split_blocks(short, None, weights, 10).agg(F.count(F.lit(1))).collect()


@pytest.mark.parametrize(
    "missing, told",
    [
        ({"drop_weight": {(3, 1, "u"), (3, 1, "v")}}, "bands"),
        ({"drop_weight": {(3, 1, "u")}}, "different bands"),
        ({"drop_weight": {(3, b, "u") for b in range(3)}}, "bands or groups"),
        ({"drop_weight": {(3, b, g) for b in range(3) for g in "uv"}}, "frame 3 has no weights"),
        ({"drop_share": (1, 5, 2)}, "bands are not those"),
        # a band missing on both sides leaves arrays of one length
        ({"drop_weight": {(6, 1, "u"), (6, 1, "v")}, "drop_share": (1, 5, 2)}, "bands"),
    ],
)
def test_split_refuses_what_it_cannot_pair(spark, missing, told):
    pop, walk, weights = split_inputs(spark, **missing)
    with pytest.raises(SparkRuntimeException, match=told):
        character.split_blocks(character.packed(pop), walk, weights, 10).collect()


def test_split_refuses_a_missing_share(spark):
    pop, walk, weights = split_inputs(spark)
    with pytest.raises(SparkRuntimeException, match="share is missing"):
        character.split_blocks(character.packed(pop.withColumn("p", F.expr("if(band = 1 AND t > 30, null, p)"))), walk, weights).collect()
    rows = character.packed(pop).drop("bands").withColumn("p", F.slice("p", 1, 2))
    with pytest.raises(SparkRuntimeException, match="bands are not those"):
        character.split_blocks(rows, walk, weights).collect()


# plans -----------------------------------------------------------------------------------------------


def test_no_window_holds_a_series(spark, pairs, series):
    pop, walk, weights = split_inputs(spark)
    levels = spark.createDataFrame([(0.9, 0.1)], "high double, low double")
    windows = spark.createDataFrame([("all", 0, 10_000)], "name string, lo int, hi int")
    parts = character.split_blocks(character.packed(pop), walk, weights)
    for df in (
        parts, character.driven(parts), transfer.continuous_change(pairs), transfer.threshold_events(pairs, levels), populations.window_metrics(series, windows),
        populations.trapezoid(series), character.fixed_vs_projected(series, series), character.walk(walk), ensemble.differences(pop.withColumn("run", F.lit("A")), "A"),
    ):
        specs = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", df._jdf.queryExecution().optimizedPlan().toString())
        assert all("block#" in spec for spec in specs), specs


def test_few_series_fill_many_tasks(spark):
    rows = spark.range(300_000).selectExpr("cast(id % 3 as int) AS grp", "cast(floor(id / 3) as int) AS t", "sin(id) AS mean")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        blocks = ordered.dealt(rows, ["grp"], "t", 1000)
        sizes = [r["count"] for r in blocks.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 40_000
        found = populations.trapezoid(rows, 1000).orderBy("grp").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    near(found, bind(populations.TRAPEZOID, series=rows).collect())


def test_a_block_needs_a_width(pairs):
    with pytest.raises(ValueError):
        ordered.dealt(pairs, ["h"], "t", 0)
