"""Streaming forms of operators that grow with events: rating statistics and metrics of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import in_pruned_directory, language_of
from ..operators.history import rating_stats
from ..operators.structure import file_metrics
from ..operators.tokens import tokens


def rating_stream(events: DataFrame, key: str, rating: str) -> DataFrame:
    """Running number, sum and mean of ratings by key; write it in update or complete mode."""
    return rating_stats(events, key, rating)


def windowed_ratings(events: DataFrame, at: str, rating: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Ratings by event-time window; rows later than the watermark are left out, as an append sink needs."""
    marked = events.withWatermark(at, late).groupBy(F.window(at, window))
    return marked.agg(F.count(rating).alias("ratings"), F.sum(rating).alias("total"))


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """New source files of a folder as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    rows = read.filter(~in_pruned_directory(F.col("path"))).withColumn("language", language_of(F.col("path")))
    return rows.filter("language is not null").select("path", "language", F.col("content").cast("string").alias("content"))


def metrics_stream(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Metrics of each batch of arriving files, appended to a Parquet table; a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        own = batch.dropDuplicates(["path"]).persist()
        file_metrics(tokens(own), own).write.mode("overwrite").parquet(f"{target}/batch={number}")
        own.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
