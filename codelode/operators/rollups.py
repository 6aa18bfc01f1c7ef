"""Project and language totals, health scores, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import HEALTH_RAMPS, grade, ramp


def rollup_totals(df: DataFrame, language: Column, sums: dict[str, Column], maxima: dict[str, Column], longest: Column, longest_name: Column, order: Column) -> DataFrame:
    """One row a language and one for all (``scope`` 'project'): sums, maxima, and the first longest item by ``order``.

    An empty or null language counts as 'unknown'. One pass: a rollup, not two aggregations.
    """
    keyed = df.select(
        F.coalesce(F.nullif(language, F.lit("")), F.lit("unknown")).alias("language"),
        *[c.alias(f"s_{n}") for n, c in sums.items()], *[c.alias(f"m_{n}") for n, c in maxima.items()],
        F.struct(longest.alias("size"), (-order).alias("order"), longest_name.alias("name")).alias("l"),
    )
    return keyed.rollup("language").agg(
        F.grouping("language").alias("_all"), F.count("*").alias("files"),
        *[F.sum(f"s_{n}").alias(n) for n in sums], *[F.max(f"m_{n}").alias(n) for n in maxima],
        F.max("l").alias("_l"),
    ).select(
        F.when(F.col("_all") == 1, "project").otherwise(F.col("language")).alias("scope"), "language", "files", *sums, *maxima,
        F.col("_l.size").alias("longest_size"), F.col("_l.name").alias("longest_name"),
    )


def with_health(df: DataFrame, code: str, complexity: str, avg_function: str, comments: str, todos: str, nesting: str) -> DataFrame:
    """The five parts (0 to 100), ``health_score`` and ``health_grade``; code lines count as 1 at least."""
    lines = F.greatest(F.col(code).cast("double"), F.lit(1.0))
    value = {
        "complexity_density": F.col(complexity) / lines, "avg_function_length": F.col(avg_function).cast("double"),
        "comment_coverage": F.col(comments) / lines, "todo_density": F.col(todos) / lines, "nesting_depth": F.col(nesting).cast("double"),
    }
    parts = {n: ramp(value[n], good, bad) for n, (good, bad, _) in HEALTH_RAMPS.items()}
    score = sum((F.col(n) * weight for n, (_, _, weight) in HEALTH_RAMPS.items()), F.lit(0.0))
    scored = df.withColumns(parts).withColumn("health_score", score)
    return scored.withColumn("health_grade", grade(F.col("health_score")))


def weakest_component(df: DataFrame, keys: list[str]) -> DataFrame:
    """The part that costs each row the most points (first of equals in ramp order); null where all are 100."""
    parts = F.array(*[
        F.struct(((100 - F.col(n)) * w).alias("loss"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, (n, (_, _, w)) in enumerate(HEALTH_RAMPS.items())
    ])
    worst = F.array_max(F.filter(parts, lambda p: p["loss"] > 0))
    return df.select(*keys, worst["name"].alias("component"), worst["loss"].alias("points_lost"))


def group_lines(df: DataFrame, key: Column, lines: Column) -> DataFrame:
    """Files and lines by ``key``; a group with an unknown line count has none. Most lines first, then most files, then key."""
    grouped = df.groupBy(key.alias("name")).agg(F.count("*").alias("files"), F.sum(lines).alias("_sum"), F.count(lines).alias("_known"))
    total = F.when(F.col("_known") == F.col("files"), F.col("_sum"))
    return grouped.select("name", "files", total.alias("lines")).orderBy(F.coalesce("lines", F.lit(-1)).desc(), F.desc("files"), "name")


def share_of_total(df: DataFrame, key: str, amount: Column) -> DataFrame:
    """(key, amount, share): groups of no amount are left out; the share is of all groups."""
    grouped = df.groupBy(key).agg(F.sum(amount).alias("amount")).filter("amount > 0")
    return grouped.withColumn("share", F.col("amount") / F.sum("amount").over(W.partitionBy()))


def line_metrics(df: DataFrame, text: Column) -> DataFrame:
    """The input with total, blank and other lines and the longest line; a final newline adds a blank line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    blank = F.size(F.filter(lines, lambda x: F.trim(F.translate(x, "\t\r", "  ")) == ""))
    return df.withColumns({
        "total_lines": F.size(lines), "blank_lines": blank, "text_lines": F.size(lines) - blank,
        "longest_line": F.array_max(F.transform(lines, F.length)),
    })
