"""Intervals: unions and covered lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 1) -> DataFrame:
    """(keys, start, end, n): intervals of one key that overlap or lie within ``gap`` are united."""
    before = W.partitionBy(*keys).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    island = W.partitionBy(*keys).orderBy(start, end).rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(end).over(before)
    opened = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    return opened.withColumn("_island", F.sum("_new").over(island)).groupBy(*keys, "_island").agg(
        F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")
    ).drop("_island")


def covered_length(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, covered): how many whole numbers the closed intervals of a key cover."""
    merged = merge_intervals(df, keys, start, end)
    return merged.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"))
