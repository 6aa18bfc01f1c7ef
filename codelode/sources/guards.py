"""Limits on what is submitted, inside the plan: no job runs while it is built, and reading what is too much fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import extension, language_of, safe_relative_path

# What a submission may have.
MAX_FILES, MAX_TOTAL_BYTES, MAX_DIFF_BYTES, MAX_FILE_BYTES, MAX_COVERAGE_BYTES = 100, 4 << 20, 1 << 20, 2 << 20, 5 << 20


def refuse(df: DataFrame, bad: Column, message: Column | str) -> DataFrame:
    """The rows; the query fails with the message at a row where ``bad`` is true."""
    said = F.lit(message) if isinstance(message, str) else message
    # What raises has no rows of its own: the condition is a filter, which the optimiser keeps.
    return df.filter(F.when(bad, F.raise_error(said).cast("boolean")).otherwise(True))


def checked_submission(df: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_TOTAL_BYTES) -> DataFrame:
    """Submitted (path, content) rows, if there are not too many or too large ones and all paths are safe and of a known language."""
    total = df.agg(F.count("*").alias("_n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("_b"))
    with_total = df.crossJoin(F.broadcast(total))  # one row
    text = F.concat(F.col("_n").cast("string"), F.lit(" files of "), F.col("_b").cast("string"), F.lit(f" bytes; at most {max_files} and {max_bytes} are taken"))
    sized = refuse(with_total, (F.col("_n") > max_files) | (F.col("_b") > max_bytes), text)
    unsafe = safe_relative_path(F.col("path")).isNull()
    safe = refuse(sized, unsafe, F.concat(F.lit("no safe relative path: "), F.coalesce(F.col("path"), F.lit("null"))))
    return refuse(safe, language_of(F.col("path")).isNull(), F.concat(F.lit("not a supported type: "), extension(F.col("path")))).select(*df.columns)


def checked_text(df: DataFrame, text: str, max_bytes: int, what: str) -> DataFrame:
    """Rows with a text that is not blank and not too large, else an error when they are read."""
    some = refuse(df, F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) == 0, f"the {what} is empty")
    return refuse(some, F.octet_length(text) > max_bytes, f"the {what} has more than {max_bytes} bytes")


def checked_diff(df: DataFrame, text: str = "text") -> DataFrame:
    return checked_text(df, text, MAX_DIFF_BYTES, "diff")


def checked_file(df: DataFrame, text: str = "content") -> DataFrame:
    return checked_text(df, text, MAX_FILE_BYTES, "file")


def checked_coverage(entries: DataFrame, reports: DataFrame, file: str) -> DataFrame:
    """LCOV entries (file, ...) of the reports, of which each must have a record at least."""
    without = reports.select(F.col(file).alias("file")).distinct().join(entries.select("file").distinct(), "file", "left_anti")
    first = without.agg(F.min("file").cast("string").alias("_without"))
    checked = refuse(first, F.col("_without").isNotNull(), F.concat(F.lit("no SF: and end_of_record records in "), F.col("_without")))
    # The check is one row, and the entries are read only with it.
    return entries.crossJoin(F.broadcast(checked)).drop("_without")
