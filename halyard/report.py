"""Reports as text: a title, tables of rows, notes. What is null reads "not evaluated"."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame


def prepare_output(path: str, overwrite: bool = False) -> str:
    if os.path.isdir(path) and os.listdir(path) and not overwrite:
        raise FileExistsError(f"{path} is not empty")
    os.makedirs(path, exist_ok=True)
    return path


def cell(v) -> str:
    if v is None or (isinstance(v, float) and v != v):
        return "not evaluated"
    return f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")


def markdown(title: str, tables: dict[str, DataFrame], notes: list[str] = (), limit: int = 200) -> str:
    """A report of summary tables; each shows at most `limit` rows and says when it has more."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(limit + 1).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:limit]]
        out += ["", f"Shown: the first {limit} rows."] if len(rows) > limit else [""]
    return "\n".join(out + [f"* {n}" for n in notes]) + "\n"


def envelope(df: DataFrame, x: str, y: str, buckets: int = 4000, by: list[str] = ()) -> DataFrame:
    """Min and max of each of `buckets` slices of the rows' range: what a figure can show."""
    from pyspark.sql import functions as F

    span = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    a, b = span["a"], span["b"]
    if a is None:
        return df.limit(0).select(*by, F.lit(0).alias("bucket"), F.col(x).alias("centre"), F.col(y).alias("low"), F.col(y).alias("high"))
    step = (b - a) / buckets or 1
    bucket = F.least(F.floor((F.col(x) - F.lit(a)) / F.lit(step)), F.lit(buckets - 1)).cast("int")
    return df.groupBy(*by, bucket.alias("bucket")).agg(F.avg(x).alias("centre"), F.min(y).alias("low"), F.max(y).alias("high"))
