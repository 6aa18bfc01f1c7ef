"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BATCH_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local one only where Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codelode-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` from here on, whatever the number and length of their rows.

    A batch exists in the JVM and in the Python worker at once, and a task may feed two workers; the default is 64 MB.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(function):
    """An Arrow function over batches whose freed memory goes back to the system at its end, since workers stay for later tasks."""

    @functools.wraps(function)
    def tidied(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return tidied


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder; it survives the loss of executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that an operator needs for a while."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table_ in tables:
            _, path = self.paths.pop(id(table_))
            delete(self.spark, path)

    def drop_all_but(self, *kept: DataFrame) -> None:
        self.drop(*[t for t, _ in list(self.paths.values()) if all(t is not k for k in kept)])


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table from the shared folder, through the file system that its path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeded_digest(seed: int, *cols: Column) -> Column:
    """Hex md5 of the seed and the given integers; the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def digest_unit(digest: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits (52 bits) of a digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def bucket_offsets(counts: DataFrame, groups: list[str], bucket: str, n: str, width: int = 4096) -> DataFrame:
    """Exclusive running sums of ``n`` over ``bucket`` within ``groups``, column ``offset``.

    Two levels, so that no window partition holds more than ``width`` buckets or than the number of blocks.
    """
    blocks = counts.withColumn("_block", F.floor(F.col(bucket) / width))
    per_block = blocks.groupBy(*groups, "_block").agg(F.sum(n).alias("_n"))
    before = W.partitionBy(*groups).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    per_block = per_block.select(*groups, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = W.partitionBy(*groups, "_block").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_within", F.coalesce(F.sum(n).over(inner), F.lit(0)))
    return (
        blocks.join(per_block, [*groups, "_block"])
        .select(*groups, bucket, (F.col("_start") + F.col("_within")).cast("long").alias("offset"))
    )
