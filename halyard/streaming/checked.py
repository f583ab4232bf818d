"""An ensemble that refuses what doesn't belong to it, while histories arrive.

Histories come in batches, each history whole in one batch (a file is read by one micro-batch).
A store is a folder of Parquet that all executors reach:

    grid      t, time, states: the grid that the first sound history set
    accepted  h, fingerprint, n_points of each history in the ensemble, by batch
    refused   h, reason of each history kept out, by batch
    state     t, state, n, mean, m2: the merged state, one version a batch

A batch reads the state of the batch before and writes the next one; the state is written last, and only batches whose
state is complete count. So a batch that is run again after a lost driver writes the same rows again and nothing is
counted twice. A state is as large as the grid, whatever the number of histories; the two newest are kept.

A history is refused, for the first reason that holds, if
    value       a share, a state, a time or a place is null, NaN or infinite
    duplicate   its name or its very rows have been accepted before, or come twice in the batch (the least name stays)
    shape       a state is missing or repeated at a point, or it has another number of points than the grid
    time grid   its times or states differ from the grid anywhere, or don't increase; nothing is interpolated
    range       a share is below 0 or above 1 by more than the tolerance
    sum         the shares of a point don't sum to one within the tolerance; nothing is renormalised
Rows without a history name are one refused history of a null name. An empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered

TOLERANCE = 1e-6
_SCHEMA = {
    "accepted": "h {name}, fingerprint decimal(38,0), n_points long, batch long",
    "refused": "h {name}, reason string, batch long",
}


class RefusedHistories(ValueError):
    """Raised in strict mode, with nothing of the batch taken."""


def judged(rows: DataFrame, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(points, histories): one row a point with its states in order, and one row a history with what its own rows say.

    rows: h, t, time, state, p."""
    unknown = F.col("p").isNull() | F.isnan("p") | (F.abs("p") == float("inf")) | F.col("time").isNull() | F.isnan("time") | F.col("t").isNull() | F.col("state").isNull() | F.col("h").isNull()
    points = rows.groupBy("h", "t").agg(
        F.min("time").alias("time"), F.max("time").alias("latest"), F.array_sort(F.collect_list("state")).alias("states"), F.count_if(unknown).alias("n_unknown"),
        F.min("p").alias("least"), F.max("p").alias("most"), F.sum("p").alias("total"),
        F.sum(F.xxhash64("t", "time", "state", "p").cast("decimal(38,0)")).alias("hash"),
    )
    histories = points.groupBy("h").agg(
        F.count(F.lit(1)).alias("n_points"), F.sum("hash").alias("fingerprint"), (F.sum("n_unknown") > 0).alias("unknown"),
        F.max((F.size("states") != F.size(F.array_distinct("states"))) | (F.size("states") == 0)).alias("repeated"), (F.min("states") != F.max("states")).alias("ragged"),
        ((F.min("least") < -tolerance) | (F.max("most") > 1 + tolerance)).alias("outside"),
        ((F.min("total") < 1 - tolerance) | (F.max("total") > 1 + tolerance)).alias("unconserved"),
        (F.max(F.col("time") != F.col("latest"))).alias("two_times"),
    )
    return points, histories


def _falling(points: DataFrame) -> DataFrame:
    """h of histories whose time doesn't increase from point to point."""
    walked = ordered.with_previous(ordered.dealt(points.select("h", "t", "time"), ["h"], "t"), ["h"], "t", ["time"])
    return walked.filter(F.col("time") <= F.col("previous.time")).select("h").distinct()


class EnsembleStore:
    """The ensemble of all sound histories so far, kept in a folder."""

    def __init__(self, spark: SparkSession, folder: str, *, tolerance: float = TOLERANCE, strict: bool = False):
        self.spark, self.folder, self.tolerance, self.strict = spark, folder.rstrip("/"), tolerance, strict

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        """Batches whose state is complete, in order."""
        path, files = self._path("state")
        if not files.exists(path):
            return []
        names = [int(s.getPath().getName().removeprefix("batch=")) for s in files.listStatus(path)]
        return sorted(n for n in names if files.exists(self._path("state", f"batch={n}", "_SUCCESS")[0]))

    def _ledger(self, table: str, before: int, name: str) -> DataFrame:
        path, files = self._path(table)
        if not files.exists(path):
            return self.spark.createDataFrame([], _SCHEMA[table].format(name=name))
        return self.spark.read.schema(_SCHEMA[table].format(name=name)).parquet(path.toString()).filter(F.col("batch") <= before)

    def fold(self, rows: DataFrame, batch: int) -> None:
        """Take the sound histories of a batch. batch: a number that grows; an old one is passed over."""
        done = self._batches()
        if batch in done or (done and batch < done[-1]):
            return
        last = done[-1] if done else None
        name = rows.schema["h"].dataType.simpleString()
        rows = rows.select("h", "t", F.col("time").cast("double").alias("time"), "state", F.col("p").cast("double").alias("p")).persist(StorageLevel.DISK_ONLY)
        try:
            self._fold(rows, batch, last, name)
        finally:
            rows.unpersist()

    def _fold(self, rows: DataFrame, batch: int, last: int | None, name: str) -> None:
        points, histories = judged(rows, self.tolerance)
        accepted = self._ledger("accepted", last if last is not None else -1, name)
        by_name = accepted.select("h", F.lit(True).alias("name_known")).distinct()
        by_rows = accepted.select("fingerprint", F.lit(True).alias("rows_known")).distinct()
        first = histories.filter(~F.col("unknown")).groupBy("fingerprint").agg(F.min("h").alias("first_h"))
        histories = histories.join(by_name, "h", "left").join(by_rows, "fingerprint", "left").join(first, "fingerprint", "left")
        duplicate = F.coalesce(F.col("name_known") | F.col("rows_known"), F.col("name_known"), F.col("rows_known"), F.lit(False)) | (F.col("h") != F.col("first_h"))
        own = (
            F.when(F.col("unknown"), "value").when(duplicate, "duplicate").when(F.col("repeated") | F.col("ragged"), "shape")
            .when(F.col("two_times"), "time grid").when(F.col("outside"), "range").when(F.col("unconserved"), "sum")
        )
        histories = histories.withColumn("own", own)
        if last is None:
            grid = self._first_grid(points, histories)
        else:
            grid = self.spark.read.parquet(f"{self.folder}/grid")
        n_grid = grid.count()
        like = F.when((F.col("time") == F.col("grid_time")) & (F.col("states") == F.col("grid_states")), 1).otherwise(0)
        met = points.join(grid.select("t", F.col("time").alias("grid_time"), F.col("states").alias("grid_states")), "t", "left").groupBy("h").agg(F.sum(like).alias("n_like"))
        # a null name is refused for its value already
        told = histories.join(met, "h", "left").withColumn("n_like", F.coalesce("n_like", F.lit(0)))
        reason = (
            F.when(F.col("own").isin("value", "duplicate", "shape"), F.col("own")).when(F.col("n_points") != n_grid, "shape")
            .when(F.col("n_like") != n_grid, "time grid").otherwise(F.col("own"))
        )
        if last is None and n_grid == 0:
            reason = F.coalesce(F.col("own"), F.lit("time grid"))
        told = told.withColumn("reason", reason).select("h", "fingerprint", "n_points", "reason").persist(StorageLevel.DISK_ONLY)
        try:
            refused = told.filter("reason IS NOT NULL")
            if self.strict and not refused.isEmpty():
                some = ", ".join(f"{r['h']}: {r['reason']}" for r in refused.orderBy("h").limit(10).collect())
                raise RefusedHistories(f"batch {batch} is refused: {some}")
            good = told.filter("reason IS NULL")
            refused.select("h", "reason").write.mode("overwrite").parquet(f"{self.folder}/refused/batch={batch}")
            good.select("h", "fingerprint", "n_points").write.mode("overwrite").parquet(f"{self.folder}/accepted/batch={batch}")
            if good.isEmpty() and last is None:
                return
            if last is None:
                grid.write.mode("overwrite").parquet(f"{self.folder}/grid")
            taken = rows.join(good.select("h"), "h", "left_semi")
            self._merged(taken, last).write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch}")
        finally:
            told.unpersist()
        for old in self._batches()[:-2]:
            path, files = self._path("state", f"batch={old}")
            files.delete(path, True)

    def _first_grid(self, points: DataFrame, histories: DataFrame) -> DataFrame:
        """The grid of the least name among the histories that are sound by themselves."""
        sound = histories.filter(F.col("own").isNull()).select("h").join(_falling(points), "h", "left_anti")
        least = sound.agg(F.min("h").alias("h"))
        return points.join(F.broadcast(least), "h").select("t", "time", "states")

    def _merged(self, taken: DataFrame, last: int | None) -> DataFrame:
        """The state with the histories taken now: counts, means and squared deviations of two parts merge."""
        new = taken.groupBy("t", "state").agg(F.count("p").alias("n"), F.avg("p").alias("mean"), (F.var_pop("p") * F.count("p")).alias("m2"))
        if last is None:
            return new
        held = self.spark.read.parquet(f"{self.folder}/state/batch={last}")
        both = held.join(new.select("t", "state", F.col("n").alias("k"), F.col("mean").alias("mean1"), F.col("m2").alias("m21")), ["t", "state"], "left")
        k, n = F.coalesce("k", F.lit(0)), F.col("n") + F.coalesce("k", F.lit(0))
        apart = F.coalesce(F.col("mean1") - F.col("mean"), F.lit(0.0))
        return both.select(
            "t", "state", n.alias("n"), (F.col("mean") + apart * k / n).alias("mean"), (F.col("m2") + F.coalesce("m21", F.lit(0.0)) + apart * apart * F.col("n") * k / n).alias("m2")
        )

    def result(self) -> DataFrame:
        """t, state, n, mean, sem (null for one history) of all histories accepted so far."""
        done = self._batches()
        if not done:
            raise ValueError(f"{self.folder} holds no ensemble: no history was accepted")
        held = self.spark.read.parquet(f"{self.folder}/state/batch={done[-1]}")
        sem = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)) / F.sqrt("n"))
        return held.select("t", "state", "n", "mean", sem.alias("sem"))

    def refused(self) -> DataFrame:
        """h, reason, batch of what was kept out, of all batches, those without any sound history included."""
        path, files = self._path("refused")
        return self.spark.read.parquet(path.toString()).select("h", "reason", F.col("batch").cast("long").alias("batch"))

    def on_batch(self) -> Callable[[DataFrame, int], None]:
        """For `writeStream.foreachBatch`."""
        return lambda rows, batch: None if rows.isEmpty() else self.fold(rows, batch)
