"""Joins that are not equi-joins by nature, written as equi-joins: path suffixes, best suffix, innermost interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def path_suffixes(path: Column) -> Column:
    """Every suffix of a path that starts at a component, the whole path first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("suffix"), (F.size(parts) - i + 1).alias("parts")))


def resolve_suffixes(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) edges: each (src, target, rank) goes to the file that ends with the target's components.

    Candidates of lower rank come first, then the first path; no edge to itself, equal edges once. ``files`` is
    exploded into its suffixes, so the join is on equality.
    """
    suffixes = files.select(F.col("path").alias("dst"), F.explode(path_suffixes(F.col("path"))).alias("s")).select("dst", F.col("s.suffix").alias("candidate"))
    best = targets.join(suffixes, "candidate").groupBy("src", "target").agg(F.min(F.struct("rank", "dst")).alias("b"))
    return best.select("src", F.col("b.dst").alias("dst")).filter("src <> dst").distinct()


def coupling(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Fan-out, fan-in and both sorted neighbour lists of every file."""
    out = edges.groupBy("src").agg(F.count("*").alias("fan_out"), F.sort_array(F.collect_list("dst")).alias("depends_on")).withColumnRenamed("src", "path")
    into = edges.groupBy("dst").agg(F.count("*").alias("fan_in"), F.sort_array(F.collect_list("src")).alias("depended_on_by")).withColumnRenamed("dst", "path")
    none = F.array().cast("array<string>")
    return files.select("path").join(out, "path", "left").join(into, "path", "left").select(
        "path", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"),
        F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("depended_on_by", none).alias("depended_on_by"),
    )


def match_by_suffix(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(entry, path, parts): the file that shares the longest suffix with each entry; path is null if none or several do; ``\\`` counts as ``/``."""
    own = lambda df, c: df.select(F.col(c), F.explode(path_suffixes(F.replace(F.col(c), F.lit("\\"), F.lit("/")))).alias("s")).select(c, "s.suffix", "s.parts")
    pairs = own(entries.select("entry").distinct(), "entry").join(own(files.select("path").distinct(), "path").drop("parts"), "suffix")
    longest = pairs.groupBy("entry", "path").agg(F.max("parts").alias("parts"))
    by_length = longest.groupBy("entry", "parts").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    best = by_length.groupBy("entry").agg(F.max(F.struct("parts", "n", "path")).alias("b"))
    return entries.select("entry").distinct().join(best, "entry", "left").select(
        "entry", F.when(F.col("b.n") == 1, F.col("b.path")).alias("path"), F.when(F.col("b.n") == 1, F.col("b.parts")).alias("parts")
    )


def dyadic_blocks(start: Column, end: Column) -> Column:
    """The closed interval of whole numbers as aligned blocks (level, block): at most two a level, none that overlap.

    Block b of level l has b * 2^l to (b + 1) * 2^l - 1. From the finest level up, an odd first block and an odd end are
    taken and the rest is halved, so the bounds at a level follow from the interval's own by shifts.
    """
    shift = lambda x, level: F.call_function("shiftright", x, level)
    odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
    block = lambda level, at: F.struct(level.alias("level"), at.alias("block"))

    def at_level(level: Column) -> Column:
        low, high = -shift(-start.cast("bigint"), level), shift(end.cast("bigint") + 1, level)
        first = F.when(odd(low) & (low < high), block(level, low))
        return F.array_compact(F.array(first, F.when(odd(high) & (low + low.bitwiseAND(F.lit(1)) < high), block(level, high - 1))))

    levels = F.length(F.bin((end - start + 1).cast("bigint")))
    return F.when(end >= start, F.flatten(F.transform(F.sequence(F.lit(0), levels), at_level)))


def innermost_interval(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each point (keys, point, at) with the shortest span (keys, span, start, end) that holds it; ties to the later start, then the larger span id.

    Spans are cut into ``dyadic_blocks``, and each block keeps its best span; a point looks up the block of each level that
    its key has. So a point meets at most one row a level, however many spans hold it. Points and bounds are whole numbers.
    """
    rank = F.struct((F.col("start") - F.col("end")).alias("size"), "start", "span")
    blocks = spans.select(*keys, rank.alias("_best"), F.explode(dyadic_blocks(F.col("start"), F.col("end"))).alias("_b"))
    best = blocks.groupBy(*keys, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).agg(F.max("_best").alias("_best"))
    levels = best.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    leveled = points.join(levels, keys, "left").select(*points.columns, F.explode_outer("_levels").alias("_level"))
    leveled = leveled.withColumn("_block", F.call_function("shiftright", F.col("at").cast("bigint"), F.col("_level")))
    held = leveled.join(best, [*keys, "_level", "_block"], "left").groupBy(*keys, "point", "at").agg(F.max("_best").alias("_best"))
    return held.select(*keys, "point", "at", F.col("_best.span").alias("span"))


def supersede(findings: DataFrame, general: Column, specific: Column, keys: list[str]) -> DataFrame:
    """Without the general findings that have a specific one at the same keys; one window, no join."""
    w = W.partitionBy(*keys)
    return findings.withColumn("_s", F.max(specific.cast("int")).over(w)).filter(~(general & (F.col("_s") == 1))).drop("_s")
