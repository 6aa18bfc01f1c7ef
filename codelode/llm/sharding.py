"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded digest and ranked; all rows are then ordered by their fractional rank
``(rank - 1/2) / rows of the source`` and cut into equal runs, so that each shard has every source's share. Ranks come
from counts of small digest buckets and a ``row_number`` inside each, so neither a source nor the whole table is ever
sorted in one task. Rows of equal fractional rank (all one-row sources have 1/2) are counted and ranked by digest bucket too.

Nulls: a null source is a stratum of its own; a null text has no bytes; rows without an id are dealt by their text. Equal rows get different slots. An empty table
gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bucket_offsets, seeded_digest

ROWS_IN_BUCKET = 512


def shard_interleaved(
    docs: DataFrame, n_shards: int = 8, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """``id_col``, size, text_crc32, shard, slot; shard sizes differ by one row at most."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string"))).alias("_stratum"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.when(F.col(id_col).isNull(), seeded_digest(seed, F.crc32(data), F.octet_length(data))).otherwise(seeded_digest(seed, F.col(id_col))).alias("_key"),
    )
    total = docs.count()
    n_buckets = max(1, -(-total // ROWS_IN_BUCKET))
    ties = ["_key", F.col("_id").asc_nulls_first(), "text_crc32", "size"]

    rows = rows.withColumn("_b", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * n_buckets / float(1 << 32)).cast("long"))
    counts = rows.groupBy("_stratum", "_b").agg(F.count("*").alias("_n"))
    sizes = counts.groupBy("_stratum").agg(F.sum("_n").alias("_size"))
    starts = bucket_offsets(counts, ["_stratum"], "_b", "_n").join(sizes, "_stratum")
    ranked = (
        rows.join(starts, ["_stratum", "_b"])
        .withColumn("_rank", F.col("offset") + F.row_number().over(W.partitionBy("_stratum", "_b").orderBy(*ties)))
        .withColumnRenamed("_b", "_d").drop("offset")
        .withColumn("_fraction", (F.col("_rank") - 0.5) / F.col("_size"))
        .withColumn("_f", F.floor(F.col("_fraction") * n_buckets).cast("long"))
    )
    tied = ranked.groupBy("_f", "_fraction", "_d").agg(F.count("*").alias("_n"))
    equal = tied.groupBy("_f", "_fraction").agg(F.sum("_n").alias("_m"))
    smaller = F.sum("_m").over(W.partitionBy("_f").orderBy("_fraction").rowsBetween(W.unboundedPreceding, -1))
    equal = equal.withColumn("_smaller", F.coalesce(smaller, F.lit(0)))
    bases = bucket_offsets(equal.groupBy("_f").agg(F.sum("_m").alias("_n")), [], "_f", "_n").withColumnRenamed("offset", "_base")
    # A row's place: all of the runs of fractions before its own, the smaller fractions of its run, and the digest buckets before its own.
    at = bucket_offsets(tied, ["_f", "_fraction"], "_d", "_n").join(equal, ["_f", "_fraction"]).join(bases, "_f")
    at = at.select("_f", "_fraction", "_d", (F.col("_base") + F.col("_smaller") + F.col("offset")).alias("_at"))
    inside = W.partitionBy("_f", "_fraction", "_d").orderBy(*ties)
    placed = ranked.join(at, ["_f", "_fraction", "_d"]).withColumn("_place", F.col("_at") + F.row_number().over(inside) - 1)
    n = max(total, 1)
    return placed.withColumn("_shard", F.expr(f"_place * {n_shards} div {n}")).select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.col("_shard").cast("int").alias("shard"),
        F.expr(f"_place - (_shard * {n} + {n_shards - 1}) div {n_shards}").alias("slot"),
    )
