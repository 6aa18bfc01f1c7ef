"""Hotspots: churn by complexity, or complexity and nesting where there is no history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_maxima(df: DataFrame, *columns: str) -> DataFrame:
    """The rows with ``max_<column>``: one aggregate row, broadcast, rather than all rows in one window."""
    return df.crossJoin(F.broadcast(df.agg(*[F.max(c).alias(f"max_{c}") for c in columns])))


def _share(column: str):
    return F.coalesce(F.try_divide(F.col(column), F.col(f"max_{column}")), F.lit(0.0))


def churn_hotspots(files: DataFrame, churn: DataFrame) -> DataFrame:
    """Files (path, complexity) with their commits and ``score`` = 100 (c / max c) (n / max n); best first, then path."""
    joined = files.join(churn, "path", "left").withColumn("commits", F.coalesce("commits", F.lit(0)))
    scored = _with_maxima(joined, "complexity", "commits").withColumn("score", _share("complexity") * _share("commits") * 100)
    return scored.drop("max_complexity", "max_commits").orderBy(F.desc("score"), "path")


def structural_hotspots(files: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best files of complexity above 1 by the mean of normalised complexity and nesting, times 100."""
    some = _with_maxima(files.filter("complexity > 1"), "complexity", "nesting")
    scored = some.withColumn("score", (_share("complexity") + _share("nesting")) / 2 * 100).drop("max_complexity", "max_nesting")
    return scored.orderBy(F.desc("score"), F.desc("complexity"), F.desc("nesting"), "path").limit(k)
