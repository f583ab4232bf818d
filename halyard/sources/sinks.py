"""Sinks: CSV with empty cells for nulls, strict JSON, the averaged master table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as null: strict JSON has neither."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(F.col(c)) for c in doubles})


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, nullValue="")


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    finite(df).write.mode("overwrite" if overwrite else "errorifexists").json(path, ignoreNullFields=False)


def write_master(master: DataFrame, path: str, states: list[str], overwrite: bool = False) -> None:
    """Rows `t p p ...` in order of t; doubles at their shortest exact text; read back and compared."""
    wide = master.groupBy("t").pivot("state", states).agg(F.first("value"))
    text = wide.repartitionByRange("t").sortWithinPartitions("t").select(F.concat_ws(" ", F.col("t").cast("string"), *[F.col(s).cast("string") for s in states]).alias("value"))
    text.write.mode("overwrite" if overwrite else "errorifexists").text(path)
    back = master.sparkSession.read.text(path)
    if back.exceptAll(text).limit(1).count() or text.exceptAll(back).limit(1).count():
        raise ValueError(f"{path} does not read back as written")
