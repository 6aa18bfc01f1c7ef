"""Findings against diffs, and scans against earlier scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_by_diff(findings: DataFrame, diff_files: DataFrame, added: DataFrame) -> DataFrame:
    """Findings in files of the diff with ``introduced``: on an added line, or for the whole of a new file (line 0)."""
    lines = added.select("path", "line", F.lit(True).alias("_added")).distinct()
    joined = findings.join(diff_files.select("path", "is_new"), "path").join(lines, ["path", "line"], "left")
    introduced = F.when(F.col("line") == 0, F.col("is_new")).otherwise(F.coalesce("_added", F.lit(False)))
    return joined.withColumn("introduced", introduced).drop("_added", "is_new")


def diff_summary(split: DataFrame, diff_files: DataFrame, added: DataFrame, tiers: list[str]) -> DataFrame:
    """One row: files_in_diff, added_lines (different ones), introduced, preexisting, and introduced findings by tier.

    ``split`` is what ``split_by_diff`` gives for findings with a tier. Each part is one row before they are joined.
    """
    new = F.col("introduced")
    counts = split.agg(
        F.count_if(new).alias("introduced"), F.count_if(~new).alias("preexisting"), *[F.count_if(new & (F.col("tier") == t)).alias(t) for t in tiers],
    )
    files = diff_files.agg(F.count_distinct("path").alias("files_in_diff"))
    lines = added.select("path", "line").distinct().agg(F.count("*").alias("added_lines"))
    return files.crossJoin(lines).crossJoin(counts)


def reconcile(diff_files: DataFrame, supplied: DataFrame) -> DataFrame:
    """(path, status): analysed, unsupported, content not supplied, or not in diff."""
    left = diff_files.select("path", "language", F.lit(1).alias("_d"))
    right = supplied.select("path", F.lit(1).alias("_s"))
    status = (
        F.when(F.col("_d").isNull(), "not in diff").when(F.col("language").isNull(), "unsupported")
        .when(F.col("_s").isNull(), "content not supplied").otherwise("analysed")
    )
    return left.join(right, "path", "full").select("path", status.alias("status"))


def finding_delta(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """(added, resolved): the multiset difference of two sets of findings over ``keys``, either way."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    both = count(current, "now").join(count(previous, "then"), keys, "full")
    gain = F.coalesce("now", F.lit(0)) - F.coalesce("then", F.lit(0))
    return both.agg(F.coalesce(F.sum(F.greatest(gain, F.lit(0))), F.lit(0)).alias("added"), F.coalesce(F.sum(F.greatest(-gain, F.lit(0))), F.lit(0)).alias("resolved"))


def complexity_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(simpler, more_complex, worst_path, worst_increase) over files (path, complexity) in both scans; first path of equals."""
    both = current.select("path", F.col("complexity").alias("now")).join(previous.select("path", F.col("complexity").alias("then")), "path")
    change = F.col("now") - F.col("then")
    worst = F.min(F.when(change > 0, F.struct((-change).alias("less"), F.col("path").alias("path"))))
    return both.agg(F.count_if(change < 0).alias("simpler"), F.count_if(change > 0).alias("more_complex"), worst.alias("w")).select(
        "simpler", "more_complex", F.col("w.path").alias("worst_path"), (-F.col("w.less")).alias("worst_increase")
    )
