"""Bootstraps over whole histories, against resampling on one machine."""

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from halyard.functions import kinetics as K
from halyard.functions import numerics as N
from halyard.operators import resampling as R

GROUPS = ["a", "b"]


def table_of(spark, cells, groups=GROUPS, first=0):
    """cells: histories by rows by groups."""
    rows = [(h, first + t, g, float(cells[h, t, k])) for h in range(cells.shape[0]) for t in range(cells.shape[1]) for k, g in enumerate(groups)]
    return spark.createDataFrame(rows, "h int, t int, grp string, value double").repartition(5)


@pytest.fixture(scope="module")
def noisy():
    rnd = np.random.default_rng(1)
    exact = N.propagate(K.rate_matrix([0.4], [(0, 1)], 2), np.array([1.0, 0.0]), np.arange(12.0))
    noise = rnd.normal(0, 0.01, (6, 12)) * (np.arange(12) > 0)
    return exact[None] + np.stack([noise, -noise], 2)


@pytest.mark.parametrize("width", [1, 5, None])
def test_resampled_means(spark, noisy, width):
    found = R.resampled_means(R.resampled_series(table_of(spark, noisy), GROUPS, 30, 7, width), GROUPS).collect()
    wanted = {(b, float(t), g): noisy[p, t, k].mean() for b, p in enumerate(K.picks(6, 30, 7)) for t in range(12) for k, g in enumerate(GROUPS)}
    assert {(r["resample"], r["t"], r["grp"]): r["value"] for r in found} == pytest.approx(wanted)


def test_rows_do_not_grow_with_resamples(spark, noisy):
    table = table_of(spark, noisy)
    plans = [R.resampled_series(table, GROUPS, n, width=4) for n in (2, 200)]
    for packed, n in zip(plans, (2, 200)):
        assert packed.count() == 3 * n
    # one exchange, of the histories' own rows
    text = plans[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and "Generate" not in text


def test_missing_cells_are_refused(spark, noisy):
    with pytest.raises(PythonException, match="same rows and groups"):
        R.resampled_series(table_of(spark, noisy).filter("NOT (h = 2 AND t = 3)"), GROUPS, 20).collect()


def test_rate_intervals(spark, noisy):
    table = table_of(spark, noisy)
    samples = R.bootstrap_rates(table, GROUPS, "a->b", n_resamples=24).persist()
    alone = [K.fit_rates(np.arange(12.0), noisy[p].mean(0), GROUPS, [(0, 1)], n_starts=2).rates[0] for p in K.picks(6, 24)]
    assert [r["rate"] for r in samples.orderBy("resample").collect()] == pytest.approx(alone, rel=1e-6)
    (r,) = R.interval(samples).collect()
    assert (r["low"], r["high"]) == pytest.approx(tuple(np.percentile(alone, [2.5, 97.5]))) and r["status"] == "reported" and r["n"] == 24
    (few,) = R.interval(samples.filter("resample < 5")).collect()
    assert few["status"] == "insufficient_successful_resamples" and few["low"] is None
    (some,) = R.interval(samples.withColumn("identified", F.col("resample") < 10)).collect()
    assert some["status"] == "suppressed_low_identified_fraction" and some["n_identified"] == 10
    (never,) = R.interval(samples.withColumn("identified", F.lit(False))).collect()
    assert never["status"] == "suppressed_never_identified"


def test_lifetimes(spark, noisy):
    time, picks = np.arange(12.0), K.picks(6, 30)
    found = {r["grp"]: r for r in R.bootstrap_lifetimes(table_of(spark, noisy), GROUPS, n_resamples=30).collect()}
    taus = [K.fit_exponential(time, noisy[p, :, 0].mean(0))["tau"] for p in picks]
    assert found["a"]["status"] == "estimated" and (found["a"]["low"], found["a"]["high"]) == pytest.approx(tuple(np.quantile(taus, [0.025, 0.975])))
    # the other group rises: nothing to fit
    assert found["b"]["status"] == "insufficient_successful_resamples" and found["b"]["failed"] == 30 and found["b"]["low"] is None
    same = np.stack([noisy[0]] * 3)
    assert {r["status"] for r in R.bootstrap_lifetimes(table_of(spark, same), GROUPS, n_resamples=20).collect()} == {"unavailable_identical_files"}
    assert {r["status"] for r in R.bootstrap_lifetimes(table_of(spark, noisy[:1]), GROUPS, n_resamples=20).collect()} == {"unavailable_single_file"}
    for bad in ({"n_resamples": 5}, {"confidence": 1.0}):
        with pytest.raises(ValueError):
            R.bootstrap_lifetimes(table_of(spark, noisy), GROUPS, **bad)


def test_branches(spark):
    rnd = np.random.default_rng(2)
    groups, edges = ["s", "win", "lose"], [(0, 1), (0, 2)]
    exact = N.propagate(K.rate_matrix([0.3, 0.1], edges, 3), np.array([1.0, 0.0, 0.0]), np.arange(15.0))
    noise = rnd.normal(0, 0.003, (5, 15, 3)) * (np.arange(15) > 0)[None, :, None]
    cells = exact[None] + noise - noise.mean(2, keepdims=True)
    (r,) = R.bootstrap_branch(table_of(spark, cells, groups), groups, "s->win,s->lose", "s", ["win"], ["lose"], n_resamples=25).collect()
    alone = [K.branch(K.fit_rates(np.arange(15.0), cells[p].mean(0), groups, edges, n_starts=2), 0, {1}, {2})["value"] for p in K.picks(5, 25)]
    assert r["status"] == "reported" and r["usable"] == 25 and (r["low"], r["high"]) == pytest.approx(tuple(np.percentile(alone, [2.5, 97.5])), abs=1e-6)
    (few,) = R.bootstrap_branch(table_of(spark, cells, groups), groups, "s->win,s->lose", "s", ["win"], ["lose"], n_resamples=10).collect()
    assert few["status"] == "suppressed_too_few" and few["low"] is None
