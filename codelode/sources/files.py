"""Source files as DataFrames: trees on disk, tables with a text column, stored reports, study tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tree
from ..functions.scalars import extension, in_pruned_directory, language_of, lookup, relative_path

# Display names of extensions that are counted but not analysed.
OTHER_NAMES = {
    ".js": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".cs": "C#",
    ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".swift": "Swift", ".kt": "Kotlin", ".kts": "Kotlin", ".m": "Objective-C", ".scala": "Scala", ".dart": "Dart",
}

STUDY = T.StructType([
    T.StructField("repo", T.StringType()), T.StructField("commit_scanned", T.StringType()), T.StructField("primary_language", T.StringType()),
    T.StructField("share_of_code", T.DoubleType()), T.StructField("first_commit_date", T.DateType()), T.StructField("files", T.IntegerType()),
    T.StructField("code_lines", T.IntegerType()), T.StructField("comment_lines", T.IntegerType()), T.StructField("functions", T.IntegerType()),
    T.StructField("avg_function_lines", T.DoubleType()), T.StructField("cyclomatic_total", T.IntegerType()), T.StructField("complexity_density", T.DoubleType()),
    T.StructField("max_nesting", T.IntegerType()), T.StructField("todo_fixme_markers", T.IntegerType()), T.StructField("health_score", T.DoubleType()),
    T.StructField("grade", T.StringType()), T.StructField("findings", T.IntegerType()), T.StructField("findings_in_nonproduction_paths", T.IntegerType()),
    T.StructField("security_findings", T.IntegerType()), T.StructField("security_findings_in_nonproduction_paths", T.IntegerType()),
])


def files_from_tree(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, others) below ``root`` (or the one file): path, language, content; and path, extension, lines.

    Pruned directories are left out; unreadable files are skipped. Only analysed files carry their content. A local or
    mounted folder is read by the ``source_tree`` data source, which opens nothing that it leaves out; a store with a
    scheme of its own by Spark's binary files, which prunes after it has listed.
    """
    if "://" in root and not root.startswith("file://"):
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
        rows = read.select(relative_path(F.col("path"), F.lit(root)).alias("path"), F.col("content").cast("string").alias("content")).filter(~in_pruned_directory(F.col("path")))
        lines = F.size(F.split("content", "\n", -1)).cast("bigint")
        known = rows.select("path", language_of(F.col("path")).alias("language"), extension(F.col("path")).alias("extension"), lines.alias("lines"), "content").filter("extension <> ''")
    else:
        tree.register(spark)
        known = spark.read.format("source_tree").load(root.removeprefix("file://").removeprefix("file:"))
    return known.filter("language is not null").select("path", "language", "content"), known.filter("language is null").select("path", "extension", "lines")


def files_from_table(df: DataFrame, path: Column, text: Column, language: Column | None = None) -> DataFrame:
    """Rows of a table as files; the language from the path unless given."""
    return df.select(path.alias("path"), (language if language is not None else language_of(path)).alias("language"), text.alias("content"))


def other_language_name(ext: Column) -> Column:
    return F.coalesce(lookup(ext, OTHER_NAMES), ext)


def study_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STUDY).option("header", True).csv(path)


def stored_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored JSON reports, one document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
