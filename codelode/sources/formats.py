"""Text formats as tables: churn by ``git log --numstat``, LCOV coverage, unified diffs.

Inputs are lines (file, n, text), n counting from 1 within the file. Records are told apart by running counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def lines_of(df: DataFrame, file: str, text: str) -> DataFrame:
    """(file, n, text) of whole texts."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n", "\n"), "\n", -1)
    return df.select(F.col(file).alias("file"), F.posexplode(parts).alias("_n", "text")).select("file", (F.col("_n") + 1).alias("n"), "text")


def renamed_target(path):
    """The new path of ``a => b`` and ``p/{a => b}/q``; quotes around go."""
    plain = F.regexp_replace(path, '^"|"$', "")
    braces = F.regexp_replace(F.regexp_replace(plain, r"\{[^{}]* => ([^{}]*)\}", "$1"), "//", "/")
    return F.regexp_replace(braces, "^.* => ", "")


def numstat_churn(lines: DataFrame) -> DataFrame:
    """(path, commits, added, deleted) of numstat lines; ``-`` (binary) counts 0, other lines are left out."""
    row = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    part = lambda k: F.regexp_extract("text", row, k)
    number = lambda k: F.coalesce(F.expr(f"try_cast(regexp_extract(text, '^(\\\\d+|-)\\\\t(\\\\d+|-)\\\\t(.+)$', {k}) as long)"), F.lit(0))
    some = lines.filter(F.col("text").rlike(row)).select(renamed_target(part(3)).alias("path"), number(1).alias("a"), number(2).alias("d"))
    return some.groupBy("path").agg(F.count("*").alias("commits"), F.sum("a").alias("added"), F.sum("d").alias("deleted"))


def lcov_entries(lines: DataFrame) -> DataFrame:
    """(file, source, lines_found, lines_hit, coverage_pct, uncovered) of LCOV records.

    A record starts at ``SF:`` and ends at the next one or ``end_of_record``. Of several ``DA:`` of a line the last
    counts; the last ``LF:`` and ``LH:`` override what the ``DA:`` lines say. White space around lines doesn't count.
    """
    order = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    marked = lines.withColumn("record", F.sum(F.col("text").startswith("SF:").cast("int")).over(order))
    marked = marked.withColumn("_over", F.sum(F.trim("text").eqNullSafe("end_of_record").cast("int")).over(W.partitionBy("file", "record").orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    inside = marked.filter("record > 0 and _over = 0")
    field = lambda p: F.expr(f"try_cast(regexp_extract(text, '{p}', 1) as long)")
    last_of = lambda c: F.max(F.when(c.isNotNull(), F.struct("n", c.alias("value"))))["value"]
    da = inside.filter(F.col("text").rlike(r"^DA:\d+,-?\d+")).select("file", "record", "n", field("^DA:([0-9]+)").alias("line"), F.expr("try_cast(regexp_extract(text, '^DA:[0-9]+,(-?[0-9]+)', 1) as long)").alias("hits"))
    last = da.groupBy("file", "record", "line").agg(F.max(F.struct("n", "hits"))["hits"].alias("hits"))
    per = last.groupBy("file", "record").agg(F.count("*").alias("_lf"), F.count_if(F.col("hits") > 0).alias("_lh"), F.sort_array(F.collect_list(F.when(F.col("hits") <= 0, F.col("line")))).alias("uncovered"))
    head = inside.groupBy("file", "record").agg(
        F.min(F.when(F.col("text").startswith("SF:"), F.trim(F.expr("substring(text, 4)")))).alias("source"),
        last_of(field("^LF:([0-9]+)")).alias("lf"), last_of(field("^LH:([0-9]+)")).alias("lh"),
    )
    out = head.join(per, ["file", "record"], "left").withColumns({
        "lines_found": F.coalesce("lf", "_lf", F.lit(0)), "lines_hit": F.coalesce("lh", "_lh", F.lit(0)), "uncovered": F.coalesce("uncovered", F.array().cast("array<bigint>")),
    })
    pct = F.floor(F.try_divide(F.col("lines_hit"), F.col("lines_found")) * 10000 + 0.5) / 100
    return out.select("file", "source", "lines_found", "lines_hit", F.coalesce(pct, F.lit(0.0)).alias("coverage_pct"), "uncovered")


def coverage_summary(entries: DataFrame) -> DataFrame:
    total = entries.agg(F.count("*").alias("files_in_report"), F.sum("lines_found").alias("lines_found"), F.sum("lines_hit").alias("lines_hit"))
    return total.withColumn("overall_pct", F.floor(F.try_divide(F.col("lines_hit"), F.col("lines_found")) * 10000 + 0.5) / 100)


def diff_lines(lines: DataFrame) -> DataFrame:
    """(file, n, kind, path, is_new, line): the parts of unified diffs.

    kind is added, binary or deleted. A hunk's lines are those that its declared counts take in, so a removed line that
    reads ``-- a`` is no header. Added lines have their new line number.
    """
    order = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    hunk = r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    size = lambda k: F.expr(f"coalesce(try_cast(regexp_extract(text, '^@@ -[0-9]+(?:,([0-9]+))? [+]([0-9]+)(?:,([0-9]+))? @@', {k}) as int), 1)")
    head = F.col("text").rlike(hunk)
    own = lines.withColumn("_hunk", F.sum(head.cast("int")).over(order)).withColumns({"_old": F.when(head, size(1)), "_start": F.when(head, size(2)), "_new": F.when(head, size(3))})
    inside = W.partitionBy("file", "_hunk").orderBy("n")
    first = inside.rowsBetween(W.unboundedPreceding, 0)
    own = own.withColumns({c: F.first(c, True).over(first) for c in ("_old", "_start", "_new")})
    sign = F.substring("text", 1, 1)
    takes_old, takes_new = sign.isin("-", " ") | (F.col("text") == ""), sign.isin("+", " ") | (F.col("text") == "")
    body = (F.col("_hunk") > 0) & ~head
    past = inside.rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumns({"_o": F.coalesce(F.sum((body & takes_old).cast("int")).over(past), F.lit(0)), "_k": F.coalesce(F.sum((body & takes_new).cast("int")).over(past), F.lit(0))})
    content = body & ((takes_old & takes_new & (F.col("_o") < F.col("_old")) & (F.col("_k") < F.col("_new"))) | (sign.eqNullSafe("-") & (F.col("_o") < F.col("_old"))) | (sign.eqNullSafe("+") & (F.col("_k") < F.col("_new"))))
    own = own.withColumn("_content", content)
    path = lambda p: F.when(~F.col("_content") & F.col("text").startswith(p), F.regexp_replace(F.regexp_replace(F.expr("substring(text, 5)"), '^"|"$|\t.*$', ""), "^[ab]/", ""))
    own = own.withColumns({"_from": F.last(path("--- "), True).over(order), "_to": F.last(path("+++ "), True).over(order)})
    kind = (
        F.when(F.col("_content") & (sign == "+"), "added").when(~F.col("_content") & F.col("text").startswith("Binary files "), "binary")
        .when(~F.col("_content") & (F.col("text") == "+++ /dev/null"), "deleted")
    )
    binary = F.regexp_extract("text", r" and b/(.*) differ$", 1)
    return own.withColumn("kind", kind).filter("kind is not null").select(
        "file", "n", "kind", F.when(F.col("kind") == "binary", binary).when(F.col("kind") == "deleted", F.col("_from")).otherwise(F.col("_to")).alias("path"),
        (F.col("_from") == "/dev/null").alias("is_new"), F.when(F.col("kind") == "added", F.col("_start") + F.col("_k")).alias("line"),
    )
