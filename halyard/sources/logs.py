"""Logs of electronic-structure runs: convergence, final energies, a verdict for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import numbered_lines

NUMBER = r"([-+]?[0-9.]+(?:[EeDd][-+]?[0-9]+)?)"


def electronic_steps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, cycle, line_no, step, energy, de of `DAV:`, `RMM:` and `CG :` lines; a cycle ends
    with its `F=` line."""
    lines = numbered_lines(spark, paths).filter(F.col("value").rlike(r"^\s*(DAV|RMM|CG)\s*:|F=|nelm|NELM"))
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = lines.withColumn("cycle", F.coalesce(F.sum(F.col("value").contains("F=").cast("int")).over(before), F.lit(0)))
    pattern = rf"^\s*(?:DAV|RMM|CG)\s*:\s*(\d+)\s+{NUMBER}\s+{NUMBER}"
    return numbered.filter(F.col("value").rlike(pattern)).select(
        "path", "cycle", "line_no",
        F.regexp_extract("value", pattern, 1).cast("int").alias("step"),
        F.regexp_replace(F.regexp_extract("value", pattern, 2), "[dD]", "E").cast("double").alias("energy"),
        F.regexp_replace(F.regexp_extract("value", pattern, 3), "[dD]", "E").cast("double").alias("de"),
    )


def classify_steps(steps: DataFrame, nelm: int, ediff: float) -> DataFrame:
    """path, n_steps, last_de, verdict of each file's last cycle."""
    last = Window.partitionBy("path").orderBy(F.desc("cycle"), F.desc("line_no"))
    end = steps.withColumn("place", F.row_number().over(last)).filter("place = 1")
    return end.select(
        "path", F.col("step").alias("n_steps"), F.col("de").alias("last_de"),
        F.when((F.col("step") >= nelm) & (F.abs("de") > ediff), "FAIL").when((F.col("step") >= nelm) | (F.abs("de") > ediff), "WARN").otherwise("PASS").alias("verdict"),
    )


def run_summary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, last TOTEN and E-fermi, iterations, whether the footer is there, verdict."""
    lines = numbered_lines(spark, paths)
    toten, fermi = rf"free\s+energy\s+TOTEN\s*=\s*{NUMBER}", rf"E-fermi\s*:\s*{NUMBER}"

    def last(pattern: str):
        found = F.regexp_extract("value", pattern, 1)
        return F.max_by(F.when(found != "", found.cast("double")), F.when(found != "", F.col("line_no")))

    out = lines.groupBy("path").agg(
        last(toten).alias("toten"),
        last(fermi).alias("e_fermi"),
        F.count_if(F.col("value").rlike(r"Iteration\s+\d+\(\s*\d+\)")).alias("n_iterations"),
        F.bool_or(F.col("value").contains("General timing and accounting")).alias("footer"),
        F.bool_or(F.col("value").contains("aborting loop because EDIFF is reached")).alias("converged"),
    )
    return out.withColumn(
        "verdict", F.when(~F.col("footer") | F.col("toten").isNull(), "FAIL").when(~F.col("converged"), "WARN").otherwise("PASS")
    )


def settings(spark: SparkSession, root_file: str, frame_files: list[str], given: dict[str, str]) -> DataFrame:
    """path, key, value: what is given wins over the root's file, that over the frame's."""
    from .tables import namelist

    parts = [namelist(spark, f).select(F.lit(f).alias("path"), "key", "value") for f in frame_files]
    frames = parts[0]
    for p in parts[1:]:
        frames = frames.union(p)
    root = namelist(spark, root_file).select("key", F.col("value").alias("root_value"))
    said = spark.createDataFrame(list(given.items()) or [("", "")], "key string, given_value string")
    return frames.join(F.broadcast(root), "key", "left").join(F.broadcast(said), "key", "left").select(
        "path", "key", F.coalesce("given_value", "root_value", "value").alias("value")
    )
