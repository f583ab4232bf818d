"""A master equation fitted to a series of any length: residuals and Jacobians by blocks of time.

A block of the grid starts from the initial state propagated to its first time, so it needs no other block. It
gives the triangular factor of its rows of [Jacobian | directions of the initial state | residual];
factors of blocks are stacked and factored again, which is the factor of all rows, and everything that a
Gauss-Newton step, the errors and the identifiability need. A round is one job over the settled blocks; the driver
sees a few numbers of each block, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kinetics as K
from ..functions.numerics import expm, propagated
from ..session import settle, ship_code
from . import ordered

#: Rows of the thinned series on which starts are tried; it only chooses where the full fit begins.
START_ROWS = 2_000
#: Rounds of the full fit.
ROUNDS = 60
#: Differences of shares that the exponentials' rounding makes.
_ROUNDING = 64 * np.finfo(float).eps


def packed_blocks(series: DataFrame, groups: list[str], width: int) -> tuple[DataFrame, dict]:
    """(block, first, p) settled, p the groups' shares of the block's rows in order; and what is known of the whole.
    series(t, grp, value). A row without one of the groups, and a grid that isn't uniform, are errors."""
    shares = F.array(*(F.max(F.when(F.col("grp") == g, F.col("value"))) for g in groups))
    rows = series.filter(F.col("grp").isin(list(groups))).groupBy("t").agg(shares.alias("p"), F.count(F.lit(1)).alias("n"))
    edge = series.agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count_distinct("t").alias("n")).first()
    if not edge["n"] or edge["n"] < 3:
        raise ValueError("a fit needs three rows at least")
    step = (edge["b"] - edge["a"]) / (edge["n"] - 1)
    place = F.round((F.col("t") - F.lit(edge["a"])) / F.lit(step)).cast("long")
    blocks = rows.select(place.alias("k"), F.floor(place / width).cast("long").alias("block"), ((F.col("t") - F.lit(edge["a"])) / F.lit(step)).alias("exact"), "p", "n")
    packed = settle(
        blocks.groupBy("block").agg(
            F.array_sort(F.collect_list(F.struct("k", "p"))).alias("rows"), F.max(F.abs(F.col("exact") - F.col("k"))).alias("off"), F.min("n").alias("least"), F.max("n").alias("most"),
            F.max(F.aggregate("p", F.lit(0.0), lambda s, x: s + x)).alias("high"), F.min(F.aggregate("p", F.lit(0.0), lambda s, x: s + x)).alias("low"),
        ).select("block", F.col("rows")[0]["k"].alias("first"), F.flatten(F.col("rows.p")).alias("p"), F.size("rows").alias("size"), F.col("rows")[F.size("rows") - 1]["k"].alias("last"), "off", "least", "most", "high", "low")
    )
    r = packed.agg(*(F.max(c).alias(c) for c in ("off", "most", "high")), F.min("least").alias("least"), F.min("low").alias("low"), F.max(F.col("last") - F.col("first") + 1 - F.col("size")).alias("holes")).first()
    if r["least"] != len(groups) or r["most"] != len(groups):
        raise ValueError("a row lacks a group or has one twice")
    if r["off"] > 1e-6 * edge["n"] or r["holes"]:
        raise ValueError("the time grid is not uniform")
    spread = rows.agg(*(F.var_pop(F.col("p")[i]).alias(str(i)) for i in range(len(groups)))).first()
    known = {
        "n": edge["n"], "span": float(edge["b"] - edge["a"]), "step": float(step), "conserved": r["high"] - r["low"] <= 1e-5, "spread": edge["n"] * sum(spread),
        "p0": np.array(packed.orderBy("block").select(F.slice("p", 1, len(groups)).alias("p")).first()["p"]),
    }
    return packed, known


def _factor(p: np.ndarray, first: int, x: np.ndarray, high: np.ndarray, edges, p0: np.ndarray, step: float) -> np.ndarray:
    """The triangular factor of one block's rows."""
    n, size = len(p0), len(p)

    def model(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        k = K.rate_matrix(np.exp(x), edges, n)
        begin, move = expm(k * (first * step)), expm(k * step)
        return np.stack([propagated(move, begin @ s, size).ravel() for s in starts], 1)

    now = model(x, np.vstack([p0, np.eye(n)[1:] - np.eye(n)[0]]))
    columns = []
    for i in range(len(x)):
        h = 1e-6 * max(1.0, abs(x[i]))
        h = -h if x[i] + h > high[i] else h
        y = x.copy()
        y[i] += h
        moved = model(y, p0[None])[:, 0] - now[:, 0]
        # what rounding alone moves is no sensitivity
        columns.append(np.where(np.abs(moved) > _ROUNDING, moved, 0.0) / h)
    return np.linalg.qr(np.column_stack([*columns, now[:, 1:], now[:, 0] - p.ravel()]), mode="r")


def _whole_factor(packed: DataFrame, x: np.ndarray, high: np.ndarray, edges, known: dict) -> np.ndarray:
    p0, step, width = known["p0"], known["step"], len(x) + len(known["p0"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, width))
        for pdf in batches:
            for first, p in zip(pdf["first"], pdf["p"]):
                held = np.linalg.qr(np.vstack([held, _factor(np.asarray(p).reshape(-1, len(p0)), int(first), x, high, edges, p0, step)]), mode="r")
        yield pd.DataFrame({"r": [held.ravel().tolist()]})

    rows = packed.select("first", "p").mapInPandas(run, "r array<double>").collect()
    return np.linalg.qr(np.vstack([np.zeros((width, width)), *(np.array(r["r"]).reshape(-1, width) for r in rows)]), mode="r")


def _thinned(series: DataFrame, groups: list[str], known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Every so many rows, START_ROWS or so: a uniform grid too."""
    every = max(1, -(-known["n"] // START_ROWS))
    first = series.agg(F.min("t")).first()[0]
    place = F.round((F.col("t") - F.lit(first)) / F.lit(known["step"])).cast("long")
    pdf = series.filter(F.col("grp").isin(list(groups)) & (place % every == 0)).select("t", "grp", "value").toPandas()
    return K._wide(pdf, groups)


def fit_series(series: DataFrame, groups: list[str], edges, *, width: int = ordered.WIDTH, n_starts: int = 5) -> K.Fit:
    """`kinetics.fit_rates` of a series(t, grp, value) that no task holds."""
    ship_code(series.sparkSession)
    packed, known = packed_blocks(series, groups, width)
    low, high = K.rate_bounds(known["span"], len(edges))
    x = np.log(K.fit_rates(*_thinned(series, groups, known), groups, edges, n_starts).rates)
    x, e = np.clip(x, low, high), len(edges)
    factor, damping = _whole_factor(packed, x, high, edges, known), 1e-3
    for _ in range(ROUNDS):
        j, r = factor[:, :e], factor[:, -1]
        cost, grad, curve = 0.5 * r @ r, j.T @ r, j.T @ j
        free = ~(((x <= low) & (grad > 0)) | ((x >= high) & (grad < 0)))
        if not free.any() or np.abs(grad[free]).max() < 1e-14:
            break
        inner, step = curve[np.ix_(free, free)], np.zeros(e)
        step[free] = -np.linalg.solve(inner + damping * np.diag(np.diag(inner) + 1e-12), grad[free])
        y = np.clip(x + step, low, high)
        other = _whole_factor(packed, y, high, edges, known)
        new = 0.5 * other[:, -1] @ other[:, -1]
        if np.isfinite(new) and new < cost:
            done = cost - new <= 1e-14 * max(cost, 1e-300) or np.abs(y - x).max() < 1e-10
            x, factor, damping = y, other, max(damping / 5, 1e-12)
            if done:
                break
        elif np.abs(y - x).max() < 1e-9:
            break
        else:
            damping *= 10
    cost = 0.5 * float(factor[:, -1] @ factor[:, -1])
    independent = (known["n"] - 1) * (len(groups) - (1 if known["conserved"] else 0))
    augmented = factor[:, :-1]
    dof = max(1, independent - augmented.shape[1])
    error, status, correlation = K.graded(x, low, high, factor[:, :e], augmented, cost, dof, (known["n"] - 1) * len(groups))
    r_squared = 1 - 2 * cost / known["spread"] if known["spread"] > 0 else float("nan")
    none = np.zeros((0, len(groups)))
    return K.Fit(list(groups), list(edges), np.exp(x), np.exp(x) * error, status, float(r_squared), cost, none, none, correlation)


def rate_rows(fit: K.Fit) -> list[tuple]:
    """(edge, rate, std, status, r_squared) of a fit."""
    return [(n, float(k), float(s), z, fit.r_squared) for n, k, s, z in zip(K.edge_names(fit.edges, fit.groups), fit.rates, fit.std, fit.status)]
