"""Bootstraps over whole histories: every resample's mean in one pass, then one fit a resample.

A resample draws as many histories as there are, with replacement; its series is the mean of the
drawn ones. Rows are dealt once by blocks of the grid, so that a block has all histories of its rows; there the
means of all resamples are one product of the matrix of draws with the block's shares. So
what is shuffled of the histories doesn't grow with the number of resamples; what leaves a block is the
resampled series themselves, packed, one row for each resample and block. Histories must share one grid
and groups: a missing cell is an error.

The driver holds the histories' names and the draws (resamples by histories small numbers).
The spread is that between the histories given, which may share a trajectory; it says nothing of the model.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinetics as K
from ..session import ship_code

#: Shares of all histories in one block of the grid.
BLOCK_CELLS = 2_000_000
#: A lifetime's fit below this is a poor one.
LEAST_R2 = 0.9
_PACKED = pa.schema([("resample", pa.int32()), ("block", pa.int64()), ("t", pa.list_(pa.float64())), ("p", pa.list_(pa.float64()))])


def draws(per_history: DataFrame, n_resamples: int, seed: int) -> tuple[list, np.ndarray]:
    """The histories in order, and how often each resample has each."""
    ids = sorted(r[0] for r in per_history.select("h").distinct().collect())
    counts = np.zeros((n_resamples, len(ids)), np.int32)
    for row, drawn in zip(counts, K.picks(len(ids), n_resamples, seed) if ids else ()):
        np.add.at(row, drawn, 1)
    return ids, counts


def resampled_series(per_history: DataFrame, groups: list[str], n_resamples: int = 200, seed: int = 0, width: float | None = None) -> DataFrame:
    """resample, block, t, p: of per_history(h, t, grp, value) each resample's mean series, a block of the grid in a
    row; p has the groups of the first t, then those of the second, and so on."""
    spark = per_history.sparkSession
    ship_code(spark)
    ids, counts = draws(per_history, n_resamples, seed)
    width = width or max(1, BLOCK_CELLS // max(1, len(ids) * len(groups)))
    sent = spark.sparkContext.broadcast((ids, counts))
    names = list(groups)

    def one(table: pa.Table) -> pa.Table:
        ids, counts = sent.value
        place = {h: k for k, h in enumerate(ids)}
        column = {g: k for k, g in enumerate(names)}
        h, g = (np.array([at[x] for x in table.column(c).to_pylist()], np.int64) for c, at in (("h", place), ("grp", column)))
        times, t = np.unique(table.column("t").to_numpy(), return_inverse=True)
        cells = np.full((len(ids), len(times) * len(names)), np.nan)
        cells[h, t * len(names) + g] = table.column("value").to_numpy()
        if np.isnan(cells).any():
            raise ValueError("the histories don't have the same rows and groups")
        means = counts @ cells / len(ids)
        n, block = len(counts), table.column("block")[0].as_py()
        return pa.Table.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array([block] * n, pa.int64()), pa.array([times] * n, _PACKED.field("t").type), pa.array(list(means), _PACKED.field("p").type)], schema=_PACKED)

    rows = per_history.filter(F.col("grp").isin(names)).select(
        "h", F.col("t").cast("double").alias("t"), "grp", F.col("value").cast("double").alias("value"), F.floor(F.col("t") / width).cast("long").alias("block")
    )
    return rows.groupBy("block").applyInArrow(one, "resample int, block long, t array<double>, p array<double>")


def resampled_means(packed: DataFrame, groups: list[str]) -> DataFrame:
    """resample, t, grp, value of packed series."""
    n = len(groups)
    listed = F.array(*(F.lit(g) for g in groups))
    cells = packed.select("resample", "t", F.posexplode("p").alias("k", "value"))
    return cells.select("resample", F.col("t")[F.floor(F.col("k") / n).cast("int")].alias("t"), listed[F.col("k") % n].alias("grp"), "value")


def _each(packed: DataFrame, groups: list[str], measure, schema: str) -> DataFrame:
    """measure(resample, time, shares) of every resample, each by a task of its own: a list of rows."""
    n = len(groups)

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame(measure(int(key[0]), np.concatenate(list(pdf["t"])), np.concatenate(list(pdf["p"])).reshape(-1, n)))

    return packed.groupBy("resample").applyInPandas(one, schema)


def bootstrap_rates(per_history: DataFrame, groups: list[str], scheme: str, n_resamples: int = 200, seed: int = 0) -> DataFrame:
    """resample, edge, rate, identified: each resample refit; rate is null where the fit failed."""
    edges = K.parse_edges(scheme, groups)
    names = K.edge_names(edges, groups)

    def measure(resample, time, observed):
        try:
            fit = K.fit_rates(time, observed, groups, edges, n_starts=2)
        except (ValueError, np.linalg.LinAlgError):
            return {"resample": resample, "edge": names, "rate": [None] * len(names), "identified": [False] * len(names)}
        return {"resample": resample, "edge": names, "rate": fit.rates, "identified": [s == "identified" for s in fit.status]}

    return _each(resampled_series(per_history, groups, n_resamples, seed), groups, measure, "resample int, edge string, rate double, identified boolean")


def _percentile(column: str, q: float, rule: str) -> Column:
    return F.expr(f"percentile({column}, {q!r}) FILTER (WHERE {rule})")


def interval(samples: DataFrame, confidence: float = 0.95) -> DataFrame:
    """edge, n (fits that converged), n_identified, low, high, status: an interval only where enough resamples
    converged and enough of them identify the rate, and then over those alone."""
    tail = (1 - confidence) / 2
    n, known = F.col("n"), F.col("n_identified")
    status = (
        F.when(n < K.LEAST_SUCCESSES, "insufficient_successful_resamples").when(known == 0, "suppressed_never_identified")
        .when(known < K.LEAST_SHARE * n, "suppressed_low_identified_fraction").otherwise("reported")
    )
    counted = samples.groupBy("edge").agg(
        F.count("rate").alias("n"), F.count_if("identified").alias("n_identified"), _percentile("rate", tail, "identified").alias("low"), _percentile("rate", 1 - tail, "identified").alias("high")
    )
    told = counted.withColumn("status", status)
    shown = F.col("status") == "reported"
    return told.select("edge", "n", "n_identified", F.when(shown, F.col("low")).alias("low"), F.when(shown, F.col("high")).alias("high"), "status")


def bootstrap_lifetimes(per_history: DataFrame, groups: list[str], n_resamples: int = 200, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """grp, successful, failed, poor, low, high, status: the interval of a single-exponential lifetime of each
    group's series, from resampled whole histories with their noisy first rows."""
    if n_resamples < K.LEAST_SUCCESSES:
        raise ValueError(f"at least {K.LEAST_SUCCESSES} resamples")
    if not 0 < confidence < 1:
        raise ValueError("a confidence lies between 0 and 1")

    def measure(resample, time, observed):
        fits = [K.fit_exponential(time, observed[:, k].copy()) for k in range(len(groups))]
        good = [f["tau"] is not None and np.isfinite(f["tau"]) for f in fits]
        return {"grp": groups, "tau": [f["tau"] if ok else None for f, ok in zip(fits, good)], "poor": [ok and not (f["r_squared"] or 0) >= LEAST_R2 for f, ok in zip(fits, good)]}

    fitted = _each(resampled_series(per_history, groups, n_resamples, seed), groups, measure, "grp string, tau double, poor boolean")
    # histories that don't differ at any row give no spread
    spread = per_history.groupBy("grp", "t").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count("value").alias("n"))
    spread = spread.groupBy("grp").agg(F.max("n").alias("n_histories"), F.max(F.col("a") < F.col("b")).alias("differ"))
    tail = (1 - confidence) / 2
    counted = fitted.groupBy("grp").agg(
        F.count("tau").alias("successful"), F.count_if(F.col("tau").isNull()).alias("failed"), F.count_if("poor").alias("poor"),
        _percentile("tau", tail, "tau IS NOT NULL").alias("low"), _percentile("tau", 1 - tail, "tau IS NOT NULL").alias("high"),
    ).join(F.broadcast(spread), "grp")
    status = (
        F.when(F.col("n_histories") < 2, "unavailable_single_file").when(~F.col("differ"), "unavailable_identical_files")
        .when(F.col("successful") < max(K.LEAST_SUCCESSES, K.LEAST_SHARE * n_resamples), "insufficient_successful_resamples")
        .when(F.col("poor") > 0, "model_mismatch_warning").otherwise("estimated")
    )
    told = counted.withColumn("status", status)
    shown = F.col("status").isin("estimated", "model_mismatch_warning")
    return told.select("grp", "successful", "failed", "poor", F.when(shown, F.col("low")).alias("low"), F.when(shown, F.col("high")).alias("high"), "status")


def bootstrap_branch(
    per_history: DataFrame, groups: list[str], scheme: str, source: str, success: list[str], failure: list[str], n_resamples: int = 200, seed: int = 0, confidence: float = 0.95,
    accepted: tuple[str, ...] = ("identified", "weakly_identified"),
) -> DataFrame:
    """One row: fits (converged), usable (of an accepted grade), low, high, status. The branch itself is
    resampled, not put together from intervals of rates; a resample whose fit doesn't support it counts against the interval."""
    edges = K.parse_edges(scheme, groups)
    at = groups.index

    def measure(resample, time, observed):
        try:
            fit = K.fit_rates(time, observed, groups, edges, n_starts=2)
        except (ValueError, np.linalg.LinAlgError):
            return {"grade": ["failed"], "value": [None]}
        b = K.branch(fit, at(source), {at(g) for g in success}, {at(g) for g in failure})
        return {"grade": [b["grade"]], "value": [b["value"]]}

    fitted = _each(resampled_series(per_history, groups, n_resamples, seed), groups, measure, "grade string, value double")
    names = ", ".join(f"'{g}'" for g in accepted)
    rule, tail = f"grade IN ({names})", (1 - confidence) / 2
    counted = fitted.agg(
        F.count_if(F.col("grade") != "failed").alias("fits"), F.count_if(F.expr(rule)).alias("usable"), _percentile("value", tail, rule).alias("low"), _percentile("value", 1 - tail, rule).alias("high")
    )
    status = F.when(F.col("usable") < K.LEAST_SUCCESSES, "suppressed_too_few").when(F.col("usable") < K.LEAST_SHARE * F.col("fits"), "suppressed_low_identified_fraction").otherwise("reported")
    told = counted.withColumn("status", status)
    return told.select("fits", "usable", *(F.when(F.col("status") == "reported", F.col(c)).alias(c) for c in ("low", "high")), "status")
