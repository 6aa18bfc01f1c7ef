"""Cutting a long lineage by a reliable checkpoint in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint: what is built on it is planned without what made it, and survives lost executors.

    The folder is the session's ``spark.checkpoint.dir``; where none is set, a folder of its own, in one process only.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="codelode-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
