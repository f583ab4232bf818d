"""Ordered operations on series of any length: rows are dealt in blocks of the order, and
blocks are joined by what is at their edges.

A window over a whole history or group is one task's sort. Here each series is cut into
blocks of `width` along its order; windows run inside blocks, and what crosses a block's edge (the row
before, the sum so far, the state so far) is carried by a table of one row a block. All of a step's
branches read one exchange by (keys, block).

`width` is in units of the order column: of a grid of rows 0, 1, 2, ... the rows of a block. Results don't depend on
it. Gaps may be longer than a block: the row before is that of the last block that has rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block. A table of block edges is this much smaller than its rows.
WIDTH = 65_536
BLOCK = "block"


def dealt(rows: DataFrame, keys: list[str], order: str, width: float = WIDTH) -> DataFrame:
    """rows with their block, one exchange by (keys, block)."""
    if width <= 0:
        raise ValueError("a block needs a width above 0")
    blocked = rows.withColumn(BLOCK, F.floor(F.col(order) / width).cast("long"))
    return blocked.repartition(*keys, BLOCK)


def _inside(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(order)


def _across(keys: list[str]) -> Window:
    """One row a block, in order."""
    return Window.partitionBy(*keys).orderBy(BLOCK)


def with_previous(blocks: DataFrame, keys: list[str], order: str, columns: list[str], name: str = "previous") -> DataFrame:
    """blocks (of `dealt`) with a struct of the columns of the row before; null at a series' first row."""
    row = F.struct(*columns)
    edges = blocks.groupBy(*keys, BLOCK).agg(F.max_by(row, order).alias("last"))
    edges = edges.select(*keys, BLOCK, F.lag("last").over(_across(keys)).alias("edge"))
    inside = F.lag(row).over(_inside(keys, order))
    return blocks.join(edges, [*keys, BLOCK]).withColumn(name, F.coalesce(inside, "edge")).drop("edge")


def last_seen(blocks: DataFrame, keys: list[str], order: str, column: str, name: str) -> DataFrame:
    """blocks with the column's last value that isn't null, of this row or one before."""
    known = F.when(F.col(column).isNotNull(), F.col(order))
    edges = blocks.groupBy(*keys, BLOCK).agg(F.max_by(column, known).alias("last"))
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*keys, BLOCK, F.last("last", ignorenulls=True).over(before).alias("carried"))
    inside = F.last(column, ignorenulls=True).over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.join(edges, [*keys, BLOCK]).withColumn(name, F.coalesce(inside, "carried")).drop("carried")


def running_sum(blocks: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """blocks with the sum of value from the series' first row to this one: the sum inside the
    block on top of the sums of the blocks before."""
    totals = blocks.groupBy(*keys, BLOCK).agg(F.sum(value).alias("total"))
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, BLOCK, F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("carried"))
    inside = F.sum(value).over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.join(carried, [*keys, BLOCK]).withColumn(name, F.col("carried") + inside).drop("carried")


def summary(blocks: DataFrame, keys: list[str], order: str, value: str, *, carry: list[str] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """keys, n, first, last, peak, least, integral and the named sums of each series.

    first and last are structs (at, y) of the order's ends; peak and least are structs of the greatest and the
    least value and the first place that has it (`peak`: y, at, and the carried columns; `least`: y, at); integral is by
    trapezoids. Each block has such a state of its own, and states of neighbouring blocks merge: the integral gains the
    trapezoid between the last row of one and the first row of the next.
    """
    at, y = F.col(order).cast("double"), F.col(value)
    sums = sums or {}
    kept = [F.struct(*(F.col(c) for c in carry or [])).alias("carried")] if carry else []
    rows = blocks.select(*keys, BLOCK, at.alias("at"), y.alias("y"), *kept, *(e.alias(n) for n, e in sums.items()))
    window = _inside(keys, "at")
    rows = rows.withColumn("area", 0.5 * (F.col("y") + F.lag("y").over(window)) * (F.col("at") - F.lag("at").over(window)))
    # of equal values the first place: the greatest of (value, minus place)
    top = F.struct("y", (-F.col("at")).alias("back"), *(["carried"] if carry else []))
    states = rows.groupBy(*keys, BLOCK).agg(
        F.count("y").alias("n"),
        F.min(F.struct("at", "y")).alias("first"),
        F.max(F.struct("at", "y")).alias("last"),
        F.max(top).alias("peak"),
        F.min(F.struct("y", "at")).alias("least"),
        F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"),
        *(F.sum(n).alias(n) for n in sums),
    )
    before = F.lag("last").over(_across(keys))
    seam = F.coalesce(0.5 * (F.col("first.y") + before["y"]) * (F.col("first.at") - before["at"]), F.lit(0.0))
    merged = states.withColumn("area", F.col("area") + seam).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("peak").alias("peak"), F.min("least").alias("least"), F.sum("area").alias("integral"),
        *(F.sum(n).alias(n) for n in sums),
    )
    peak = [F.col("peak.y").alias("y"), (-F.col("peak.back")).alias("at"), *(F.col(f"peak.carried.{c}").alias(c) for c in carry or [])]
    return merged.select(*keys, "n", "first", "last", F.struct(*peak).alias("peak"), "least", "integral", *sums)


def counted_transitions(blocks: DataFrame, keys: list[str], order: str, armed_by: Column, fires: Column) -> DataFrame:
    """keys, n_events of a counter that `armed_by` arms and that counts and disarms at `fires`, if armed.

    Each block is one transition function: what state it ends in and how many events it counts, for either
    state it may begin in. Rows from one arming row to the next are a run, and a run's first firing row is its event;
    the rows before a block's first arming row are a run only if the block begins armed. A series folds its blocks'
    functions in order; a function is a few numbers, however long the block.
    """
    run = F.sum(F.when(armed_by, 1).otherwise(0)).over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    runs = blocks.select(*keys, BLOCK, run.alias("run"), (~F.coalesce(armed_by, F.lit(False)) & F.coalesce(fires, F.lit(False))).alias("hit"))
    runs = runs.groupBy(*keys, BLOCK, "run").agg(F.max("hit").alias("hit"))
    functions = runs.groupBy(*keys, BLOCK).agg(
        F.max("run").alias("arms"), F.max_by("hit", "run").alias("last_hit"), F.coalesce(F.max(F.when(F.col("run") == 0, F.col("hit"))), F.lit(False)).alias("open_hit"),
        F.count_if(F.col("hit") & (F.col("run") > 0)).alias("n"),
    )
    # ends armed: by its last arming row unless that run fired; without one, as it began unless it fired
    armed_after = F.when(F.col("arms") > 0, ~F.col("last_hit"))
    functions = functions.select(
        *keys,
        F.struct(
            BLOCK, F.coalesce(armed_after, F.lit(False)).alias("off_ends"), F.col("n").alias("off_n"),
            F.coalesce(armed_after, ~F.col("open_hit")).alias("on_ends"), (F.col("n") + F.col("open_hit").cast("long")).alias("on_n"),
        ).alias("f"),
    )
    start = F.struct(F.lit(False).alias("armed"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, f: Column) -> Column:
        return F.struct(F.when(state["armed"], f["on_ends"]).otherwise(f["off_ends"]).alias("armed"), (state["n"] + F.when(state["armed"], f["on_n"]).otherwise(f["off_n"])).alias("n"))

    folded = functions.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list("f")), start, step).alias("state"))
    return folded.select(*keys, F.col("state.n").alias("n_events"))
