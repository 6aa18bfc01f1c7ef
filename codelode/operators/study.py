"""Statistics of a study table: totals, ranks, quantiles, correlations, buckets, grades, outliers.

Ranks come from counts of different values, dealt by a sketch's cut points into ``RANGES`` ranges: what lies below a range
is one sum over the ranges, and only a range's own values are sorted together. No window sorts all values, and exact
quantiles are read from the ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import grade

#: Ranges of values that are sorted apart, and the sketch's accuracy; either changes the work's shape, never a result.
RANGES, ACCURACY = 256, 10_000
# Years from which the next age group begins.
AGE_EDGES = [10.0, 15.0, 20.0]


def value_ranks(values: DataFrame, column: str) -> DataFrame:
    """(column, n, below): each different value, how often it occurs and how many values are smaller; nulls have no rank."""
    own = values.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    cuts = own.agg(F.percentile_approx(column, [k / RANGES for k in range(1, RANGES)], ACCURACY).alias("_cuts"))
    dealt = own.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col(column)))).drop("_cuts")  # one row
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # At most RANGES rows in one window.
    starts = dealt.groupBy("_range").agg(F.sum("n").alias("n")).select("_range", before(W.orderBy("_range")).alias("_start"))
    within = before(W.partitionBy("_range").orderBy(column))
    return dealt.withColumn("_within", within).join(F.broadcast(starts), "_range").select(column, "n", (F.col("_start") + F.col("_within")).alias("below"))


def exact_quantiles(ranks: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: a quantile by name, between the two nearest values as they lie, of what ``value_ranks`` gives."""
    total = ranks.agg(F.sum("n").alias("_total"))
    placed = ranks.crossJoin(F.broadcast(total))  # one row
    at = lambda place: F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col(column)))
    out = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("_total") - 1)
        out += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high"), F.max(place - F.floor(place)).alias(f"{name}_share")]
    low = lambda n: F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_share")
    return placed.agg(*out).select(*[low(n).alias(n) for n in shares])


def exact_sum(value: Column) -> Column:
    """The sum of doubles with at most six decimals, free of rounding and of the rows' order; a plain sum if one is none of these."""
    amount = value.try_cast("decimal(24,6)")
    plain = F.count_if(F.coalesce(amount.cast("double") != value, value.isNotNull())) > 0
    return F.when(plain, F.sum(value)).otherwise(F.sum(amount).cast("double"))


def summary(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: count, medians, 90th percentile, Pearson and rank correlation (ties by mean rank) of rows with both values.

    The rows are read more than once and joined with their ranks by value, so they must come out the same each time: sums
    of doubles, whose last digits hang on the order of rows, have to be cut before (``sources.store.cut``).
    """
    v = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).filter("x is not null and y is not null")
    ranks = {c: value_ranks(v, c) for c in ("x", "y")}
    for c, own in ranks.items():
        # A tie's mean rank: its first rank and half of its size less one.
        v = v.join(own.select(c, (F.col("below") + (F.col("n") + 1) / 2).alias(f"r{c}")), c)
    counted = v.agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))
    of_x = exact_quantiles(ranks["x"], "x", {"median_x": 0.5, "p90_x": 0.9})
    of_y = exact_quantiles(ranks["y"], "y", {"median_y": 0.5})
    return counted.crossJoin(of_x).crossJoin(of_y).select("n", "median_x", "median_y", "p90_x", "pearson", "spearman")  # one row each


def bucket_of(value: Column, edges: list[float]) -> Column:
    """The first edge that the value is below, by its place; the last bucket is open."""
    bucket = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        bucket = F.when(value < edges[i], i).otherwise(bucket)
    return bucket


def bucket_counts(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """(bucket, n): rows by bucket."""
    return df.groupBy(bucket_of(value, edges).alias("bucket")).agg(F.count("*").alias("n"))


def age_in_years(first: Column, at: Column) -> Column:
    """Years between two dates, of 365.25 days."""
    return F.datediff(at, first) / F.lit(365.25)


def age_groups(df: DataFrame, age: Column, value: Column, edges: list[float] | None = None) -> DataFrame:
    """(age_group, n, median, total) of a value by age group, 0 the youngest; the median is exact, from the ranks of each group."""
    rows = df.select(bucket_of(age, AGE_EDGES if edges is None else edges).alias("age_group"), value.cast("double").alias("v"), age.alias("_age")).filter("_age is not null and v is not null")
    own = rows.groupBy("age_group", "v").agg(F.count("*").alias("n"))
    group = W.partitionBy("age_group")
    ranked = own.withColumns({"below": F.coalesce(F.sum("n").over(group.orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("n").over(group)})
    at = lambda place: F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col("v")))
    low, high = F.floor((F.col("_total") - 1) / 2), F.ceil((F.col("_total") - 1) / 2)
    return ranked.groupBy("age_group").agg(F.sum("n").alias("n"), ((at(low) + at(high)) / 2).alias("median"), F.sum(F.col("v") * F.col("n")).alias("total"))


def grade_counts(df: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """(keys, A, B, C, D, F, n, average): how many have each grade, and the mean score."""
    graded = df.withColumn("_score", score).filter("_score is not null")
    return graded.groupBy(*keys).agg(*[F.count_if(grade(F.col("_score")) == g).alias(g) for g in "ABCDF"], F.count("*").alias("n"), F.avg("_score").alias("average"))


def near_boundary(df: DataFrame, score: Column, within: float = 1.0) -> DataFrame:
    """One row (n, near): scores, and those that lie within so much of a grade's bound."""
    gap = F.least(*[F.abs(score - F.lit(float(b))) for b in (60, 70, 80, 90)])
    return df.agg(F.count(score).alias("n"), F.count_if(gap <= within).alias("near"))


def without_outliers(df: DataFrame, key: str, value: Column, k: int = 1) -> DataFrame:
    """The rows but for the ``k`` with the greatest value, ties by key."""
    top = df.select(F.col(key), value.alias("_v")).orderBy(F.desc_nulls_last("_v"), key).limit(k).select(key)
    return df.join(F.broadcast(top), key, "left_anti")  # k rows


def outlier_shares(df: DataFrame, key: str, value: Column, k: int = 5) -> DataFrame:
    """(key, value, share): the ``k`` greatest values and their share of the sum."""
    rows = df.select(F.col(key), value.alias("value"))
    total = rows.agg(F.sum("value").alias("_total"))
    top = rows.orderBy(F.desc_nulls_last("value"), key).limit(k)
    return top.crossJoin(F.broadcast(total)).select(key, "value", F.try_divide(F.col("value"), F.col("_total")).alias("share"))  # one row
