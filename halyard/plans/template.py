"""One relational plan, bound to DataFrames.

A plan is SQL whose inputs stand in braces and whose parameters stand after a colon.
`PCT(x, q)` is the exact, linearly interpolated percentile; `EVEN(x)` rounds halves to even.
Catalyst sees one plan: filters and column choices reach the scans of whatever is bound.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a parameter is where the caller says nothing. Thresholds and tolerances are fixed values.
DEFAULTS: dict[str, str | int | float] = {
    # names
    "donor": "ga", "acceptor": "gb", "early": "early", "late": "late", "recombined": "view", "target_state": "click",
    "reference_run": "A", "reference_label": 0,
    # the pair of bands, and frames to look at
    "band_a": 0, "band_b": 1, "first": 10, "last": 40, "reference_frame": 1, "period": 20, "late_from": 10,
    # thresholds
    "gap": 0.05, "coupling": 0.01, "exchange": 0.25, "moved": 1e-3, "sign": 1e-3, "step_tolerance": 1e-5, "conserved": 1e-5, "uniform": 1e-6,
    "dominance": 0.6, "mostly": 0.7, "hardly": 0.3, "least_captured": 40.0, "peak_ratio": 1.5, "still": 0.02, "pad": 3, "overlap": 16,
    "nac_threshold": 0.5, "dt": 1.0, "jump": 0.3, "common_shift": 0.1, "common_share": 0.8, "grid": 1e-6,
    # sizes
    "worst": 10, "top": 4, "buckets": 7, "points": 30, "stride": 4, "max_lag": 9, "segment": 100, "low": 5, "high": 40, "rel_height": 0.1,
    "max_peaks": 8, "length": 64, "low_rate": 0.01, "high_rate": 100.0, "n_rates": 4, "target": 3, "other": 4, "source": 0,
}
_PERCENTILE = re.compile(r"\bPCT\(")
_PARAMETER = re.compile(r"(?<![:\w]):([a-z_]+)\b")


def parameters(sql: str) -> list[str]:
    return list(dict.fromkeys(_PARAMETER.findall(sql)))


def bind(sql: str, spark: SparkSession | None = None, params: dict | None = None, **inputs: DataFrame) -> DataFrame:
    """The plan over the given inputs; params replaces defaults."""
    spark = spark or next(iter(inputs.values())).sparkSession
    unknown = set(params or {}) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    values = {n: (DEFAULTS | (params or {}))[n] for n in parameters(sql)}
    text = _PERCENTILE.sub("percentile(", sql).replace("EVEN(", "bround(")
    return spark.sql(text, args=values, **inputs) if values else spark.sql(text, **inputs)


def with_literals(sql: str, params: dict | None = None) -> str:
    """The text with its parameters written out."""

    def literal(m: re.Match) -> str:
        v = (DEFAULTS | (params or {}))[m[1]]
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)

    return _PARAMETER.sub(literal, sql)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at `places` decimals and without a negative zero, for comparison."""
    return df.withColumns(
        {f.name: F.round(f.name, places) + F.lit(0.0) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    )
