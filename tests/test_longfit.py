"""The fit by blocks of time against the fit of one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.functions import kinetics as K
from halyard.functions import numerics as N
from halyard.operators import longfit as L

GROUPS, EDGES = ["a", "b", "c"], [(0, 1), (1, 2)]


def noisy(n=31, rates=(0.3, 0.1), noise=0.01, edges=EDGES):
    rnd = np.random.default_rng(2)
    time = np.arange(n) * 0.5
    p = N.propagate(K.rate_matrix(list(rates), edges, 3), np.array([1.0, 0.0, 0.0]), time)
    e = rnd.normal(0, noise, p.shape) * (time > 0)[:, None]
    return time, p + e - e.mean(1, keepdims=True)


def table_of(spark, time, p):
    return spark.createDataFrame([(float(t), g, float(p[i, j])) for i, t in enumerate(time) for j, g in enumerate(GROUPS)], "t double, grp string, value double").repartition(4)


def same_fit(a, b):
    assert a.rates == pytest.approx(b.rates, rel=1e-5) and a.status == b.status
    assert a.std == pytest.approx(b.std, rel=1e-3) and a.r_squared == pytest.approx(b.r_squared, rel=1e-8) and a.cost == pytest.approx(b.cost, rel=1e-8)


@pytest.mark.parametrize("width", [1, 4, 31, 1000])
def test_equals_the_fit_of_one_task(spark, width):
    time, p = noisy()
    same_fit(L.fit_series(table_of(spark, time, p), GROUPS, EDGES, width=width), K.fit_rates(time, p, GROUPS, EDGES))


def test_what_is_not_identified_is_told_alike(spark):
    # nothing reaches c, so the rate out of it moves nothing
    time, p = noisy(rates=(0.4, 0.0))
    p[:, 0], p[:, 1], p[:, 2] = p[:, 0] + p[:, 2] / 2, p[:, 1] + p[:, 2] / 2, 0
    edges = [(0, 1), (2, 1)]
    a, b = L.fit_series(table_of(spark, time, p), GROUPS, edges, width=6), K.fit_rates(time, p, GROUPS, edges)
    assert a.status == b.status and a.status[1] == "blind" and np.isinf(a.std[1])
    assert a.rates[0] == pytest.approx(b.rates[0], rel=1e-5)


def test_a_long_series_in_many_blocks(spark):
    rates = (2e-5, 1e-5)
    a, b = rates
    rows = spark.range(200_000).selectExpr("cast(id as double) AS t", "id % 7 / 1000.0D - 0.003D AS e")
    rows = rows.selectExpr("t", f"exp(-{a} * t) + if(t > 0, e, 0D) AS a", f"{a} / ({b} - {a}) * (exp(-{a} * t) - exp(-{b} * t)) - if(t > 0, e, 0D) AS b").withColumn("c", 1 - F.col("a") - F.col("b"))
    series = rows.selectExpr("t", "stack(3, 'a', a, 'b', b, 'c', c) AS (grp, value)")
    fit = L.fit_series(series, GROUPS, EDGES, width=10_000)
    assert fit.rates == pytest.approx(rates, rel=1e-2) and fit.status == ["identified"] * 2


def test_bad_series_are_refused(spark):
    time, p = noisy()
    whole = table_of(spark, time, p)
    for bad, told in ((whole.filter("NOT (t = 4.0 AND grp = 'b')"), "lacks a group"), (whole.filter("t <> 4.0"), "not uniform"), (whole.unionAll(whole.limit(1)), "twice"), (whole.filter("t < 1"), "three rows")):
        with pytest.raises(ValueError, match=told):
            L.fit_series(bad, GROUPS, EDGES)


def test_propagated_rows():
    k = K.rate_matrix([0.3, 0.2], EDGES, 3)
    for n in (1, 2, 3, 17):
        assert np.allclose(N.propagated(N.expm(k), np.array([1.0, 0, 0]), n), N.propagate(k, np.array([1.0, 0, 0]), np.arange(float(n))))
