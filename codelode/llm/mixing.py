"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the output; a document's mean repetition rate is
``target rows of its source / rows of its source``. A uniform number from the document's seeded digest is inverted
through the Poisson distribution of that mean, the row is exploded by the count, and the copies are shuffled globally by
another seeded digest. Counts depend on seed, doc_id and rate alone, so a rerun after a lost executor gives the same rows.

Nulls: a null source is a source of its own (weight by its size, as the others); null texts are replicated as they are.
Repeated rows with one doc_id get the same count. A source without a target keeps the default weight. Empty tables give
empty results. Columns of the input are kept as they are, whatever their names, but for ``mix_copy``
and ``mix_key``, which the results replace.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest_unit, seeded_digest

#: Rates are broadcast up to this many sources; beyond it they are joined by shuffle.
MAX_BROADCAST_SOURCES = 10_000


def poisson_count(u: Column, rate: Column) -> Column:
    """The least k with ``P(X <= k) > u`` for X ~ Poisson(rate), at most rate + 12 sqrt(rate) + 24 steps of a fold."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(
        F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf")
    )
    folded = F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda s, i: F.when(
            s["cdf"] <= u,
            F.struct(i.alias("k"), (s["p"] * rate / i).alias("p"), (s["cdf"] + s["p"] * rate / i).alias("cdf")),
        ).otherwise(s),
    )
    return folded["k"]


def repetition_rates(
    docs: DataFrame, source_col: str = "source", weights: Mapping[str, float] | None = None, temperature: float = 0.7, growth: float = 1.0
) -> DataFrame:
    """One row a source: source, n_docs, rate. Default weights are row counts to the power ``temperature``.

    ``weights`` are relative target shares by source name; sources that it leaves out get their default weight. The
    output has ``growth`` times as many rows as the input on average. Rates above 700 would underflow and raise.
    """
    total = docs.select(F.col(f"`{source_col}`").alias("_source")).groupBy("_source").agg(F.count("*").alias("n_docs"))
    weight = F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature)))
    if weights:
        listed = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        weight = F.coalesce(listed[F.col("_source")], weight)
    weighed = total.withColumn("_w", weight)
    sum_w, sum_n = weighed.agg(F.coalesce(F.sum("_w"), F.lit(1.0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    rate = F.col("_w") * (float(growth) * sum_n / sum_w) / F.col("n_docs")
    return weighed.select(
        "_source", "n_docs", F.when(rate > 700, F.raise_error(F.lit("a repetition rate is above 700"))).otherwise(rate).alias("rate")
    )


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.7,
    growth: float = 1.0,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    shuffle: bool = True,
) -> DataFrame:
    """The input's columns plus ``mix_copy`` (0, 1, ...) and ``mix_key`` (the global order), shuffled by ``mix_key``."""
    rates = repetition_rates(docs, source_col, weights, temperature, growth).select("_source", F.col("rate").alias("_rate"))
    if rates.count() <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    own = [c for c in docs.columns if c not in ("mix_copy", "mix_key")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    u = digest_unit(seeded_digest(seed, F.col("row")[id_col]))
    counted = (
        rows.join(rates, rows["row"][source_col].eqNullSafe(rates["_source"]))
        .withColumn("count", poisson_count(u, F.col("_rate")))
        .filter("count > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    )
    out = counted.select(
        *[F.col("row")[c].alias(c) for c in own], F.col("copy").cast("int").alias("mix_copy"), seeded_digest(seed + 1, F.col("row")[id_col], F.col("copy")).alias("mix_key")
    )
    return out.repartition("mix_key").sortWithinPartitions("mix_key") if shuffle else out
