"""Queries by name: an operator over the adapter views, and independent SQL for its result."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..adapters import Views, duck_ctes
from .template import rounded

_PERCENTILE = re.compile(r"\bPCT\(")


@dataclass
class Query:
    run: Callable[[Views], DataFrame]
    #: input views of the SQL text
    views: list[str]
    sql: str | None
    #: double columns that are rounded before comparison
    doubles: list[str]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(self.run(Views(spark, sf_dir)))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = re.sub(r"\{(\w+)\}", r"\1", _PERCENTILE.sub("quantile_cont(", self.sql))
        ctes = duck_ctes(self.views)
        head = "WITH " + ",".join(ctes) + "\n" if ctes else ""
        if not self.doubles:
            return f"{head}SELECT * FROM (\n{body}\n)"
        fixed = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in self.doubles)
        return f"{head}SELECT * REPLACE ({fixed}) FROM (\n{body}\n)"


REGISTRY: dict[str, Query] = {}


def register(name: str, run: Callable[[Views], DataFrame], views: str = "", sql: str | None = None, doubles: str = "") -> None:
    if name in REGISTRY:
        raise ValueError(f"{name} is registered twice")
    REGISTRY[name] = Query(run, views.split(), sql, doubles.split())
