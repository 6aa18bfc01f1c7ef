"""Scan history, previous scans, running feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cap_history(df: DataFrame, user: str, at: str, tie: str, keep: int = 5) -> DataFrame:
    """The latest ``keep`` rows of each user."""
    latest = F.row_number().over(W.partitionBy(user).orderBy(F.desc_nulls_last(at), F.desc(tie)))
    return df.withColumn("_k", latest).filter(F.col("_k") <= keep).drop("_k")


def previous_scan(df: DataFrame, project: str, at: str, scan: str) -> DataFrame:
    """Each scan with the one of its project before it, null for the first."""
    return df.withColumn("previous", F.lag(scan).over(W.partitionBy(project).orderBy(at, scan)))


def rating_stats(df: DataFrame, key: str, rating: str) -> DataFrame:
    """Number, sum and mean (one decimal, half up) of the ratings by key."""
    stats = df.groupBy(key).agg(F.count(rating).alias("ratings"), F.sum(rating).alias("total"))
    return stats.withColumn("average", F.floor(F.try_divide(F.col("total"), F.col("ratings")) * 10 + 0.5) / 10)
