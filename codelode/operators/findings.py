"""Findings: ranking, grouping, counting, and the scans that make them from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import rank_score

TIERS = ["critical", "high", "medium", "low"]
TIER_PLACE = {t: i for i, t in enumerate(TIERS)}


def tier_place(tier: Column) -> Column:
    out = F.lit(len(TIERS))
    for name, place in TIER_PLACE.items():
        out = F.when(tier == name, place).otherwise(out)
    return out


def enrich(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tier and confidence from the catalog (rule_id, tier, confidence); unknown rules: by severity, confidence low.

    Columns of that name that the findings already have are kept where they are set, so a second call changes nothing.
    """
    for c in ("tier", "confidence"):
        if c not in findings.columns:
            findings = findings.withColumn(c, F.lit(None).cast("string"))
    known = catalog.select("rule_id", F.col("tier").alias("_t"), F.col("confidence").alias("_c"))
    fallback = F.when(F.col("severity") == "warning", "medium").otherwise("low")
    return findings.join(known, "rule_id", "left").withColumns(
        {"tier": F.coalesce("tier", "_t", fallback), "confidence": F.coalesce("confidence", "_c", F.lit("low"))}
    ).drop("_t", "_c")


def tier_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One column a tier, 0 where it has no finding."""
    return findings.groupBy(*keys).pivot("tier", TIERS).count().fillna(0, TIERS)


def fix_first(findings: DataFrame, k: int = 5, locations: int = 5) -> DataFrame:
    """The ``k`` most urgent groups of (title, tier, confidence), each with its first ``locations`` in input order.

    ``findings`` has title, tier, confidence, path, line, rule_id, language and ord (the input order).
    """
    first = W.partitionBy("title", "tier", "confidence").orderBy("ord")
    groups = findings.withColumn("_k", F.row_number().over(first)).groupBy("title", "tier", "confidence").agg(
        F.count("*").alias("count"), F.count_distinct("path").alias("affected_files"),
        F.sort_array(F.collect_set("rule_id")).alias("rule_ids"), F.sort_array(F.collect_set("language")).alias("languages"),
        F.array_sort(F.collect_list(F.when(F.col("_k") <= locations, F.struct("ord", "path", "line")))).alias("_l"),
    )
    scored = groups.withColumn("score", rank_score(F.col("tier"), F.col("confidence"))).withColumn("_tier", tier_place(F.col("tier")))
    order = [F.desc("score"), "_tier", F.desc("count"), "title"]
    top = scored.orderBy(*order).limit(k)
    place = F.row_number().over(W.orderBy(*order))
    spots = F.transform("_l", lambda x: F.concat(x["path"], F.lit(":"), x["line"].cast("string")))
    return top.select(place.alias("rank"), "title", "tier", "confidence", "score", "count", "affected_files", "rule_ids", "languages", spots.alias("locations"))


def security_groups(findings: DataFrame, k: int = 10, locations: int = 5) -> DataFrame:
    """Rules by severest tier, count and id: files, first message, first sorted locations and how many remain."""
    seen = W.partitionBy("rule_id").orderBy("path", "line", "ord")
    some = findings.withColumn("_k", F.row_number().over(seen))
    groups = some.groupBy("rule_id").agg(
        F.min(tier_place(F.col("tier"))).alias("tier_place"), F.count("*").alias("count"), F.count_distinct("path").alias("files"),
        F.min(F.struct("ord", "message"))["message"].alias("message"),
        F.array_sort(F.collect_list(F.when(F.col("_k") <= locations, F.struct("path", "line", "ord")))).alias("_l"),
    )
    spots = F.transform("_l", lambda x: F.concat(x["path"], F.lit(":"), x["line"].cast("string")))
    return groups.select("rule_id", "tier_place", "count", "files", "message", spots.alias("locations"), F.greatest(F.col("count") - locations, F.lit(0)).alias("remaining")).orderBy(
        "tier_place", F.desc("count"), "rule_id"
    ).limit(k)


def ranked_findings(findings: DataFrame, cap: int = 500) -> DataFrame:
    """The report's list: best score first, then path and line, at most ``cap`` rows."""
    scored = findings.withColumn("score", rank_score(F.col("tier"), F.col("confidence")))
    return scored.orderBy(F.desc("score"), "path", "line", "ord").limit(cap)


def introduced_list(split: DataFrame, cap: int = 500) -> DataFrame:
    """The introduced findings of ``diffs.split_by_diff`` as ``ranked_findings``, with ``truncated``: whether there are more."""
    new = split.filter("introduced")
    more = new.agg((F.count("*") > cap).alias("truncated"))
    return ranked_findings(new, cap).crossJoin(F.broadcast(more))  # one row


def severest_files(findings: DataFrame, files: DataFrame, k: int = 10) -> DataFrame:
    """Files (path, complexity) by severe findings (critical or high), all findings, complexity and path."""
    per = findings.groupBy("path").agg(F.count("*").alias("findings"), F.count_if(F.col("tier").isin("critical", "high")).alias("severe"))
    joined = files.join(per, "path", "left").fillna(0, ["findings", "severe"]).filter("findings > 0")
    return joined.orderBy(F.desc("severe"), F.desc("findings"), F.desc("complexity"), "path").limit(k)


def fix_now(findings: DataFrame) -> DataFrame:
    """(rule_id, count, files) of the findings that are severe and certain and not of security, most first, then by rule."""
    urgent = (F.coalesce("category", F.lit("style")) != "security") & F.col("tier").isin("critical", "high") & (F.col("confidence") == "high")
    return findings.filter(urgent).groupBy("rule_id").agg(F.count("*").alias("count"), F.count_distinct("path").alias("files")).orderBy(F.desc("count"), "rule_id")


#: What a list of files can be sorted by.
SORT_KEYS = ("issues", "complexity", "nesting", "lines")


def search_files(files: DataFrame, findings: DataFrame, text: str = "", sort: str = "issues") -> DataFrame:
    """Files (path, complexity, nesting, lines) whose path holds ``text`` in any case, with their ``issues``.

    Greatest ``sort`` first, then complexity, then path. A blank text takes all; an unknown key raises ValueError.
    """
    if sort not in SORT_KEYS:
        raise ValueError(f"sort is one of {', '.join(SORT_KEYS)}")
    issues = findings.groupBy("path").agg(F.count("*").alias("issues"))
    some = files.filter(F.contains(F.lower("path"), F.lit(text.strip().lower())))
    return some.join(issues, "path", "left").fillna(0, ["issues"]).orderBy(F.desc(sort), F.desc("complexity"), "path")


def findings_of_files(findings: DataFrame, k: int = 50) -> DataFrame:
    """Each file's first ``k`` findings by tier, line and input order, with their ``place``; a report's list of a file."""
    order = W.partitionBy("path").orderBy(tier_place(F.col("tier")), "line", "ord")
    return findings.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


# Token formats and the words that mark a placeholder.
SECRET_FORMATS = {
    "sk-ant-": r"sk-ant-[A-Za-z0-9_-]{32,}",
    "sk-": r"sk-(?!ant-)[A-Za-z0-9_-]{40,}",
    "AKIA": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "gh": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "github_pat_": r"github_pat_[A-Za-z0-9_]{59,}",
}
PLACEHOLDER_WORDS = ["example", "your", "placeholder", "dummy", "sample", "redacted", "changeme", "123456"]


def secret_hits(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, format, token) of provider tokens in ``text``: left boundary, length, no placeholder; several a text count each."""
    found = F.array(*[F.struct(F.lit(n).alias("format"), F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9])({p})"), F.lit(1)).alias("tokens")) for n, p in SECRET_FORMATS.items()])
    long_enough = df.filter(F.octet_length(text) >= 20)
    hits = long_enough.select(*keys, F.explode(found).alias("f")).select(*keys, "f.format", F.explode("f.tokens").alias("token"))
    body = F.regexp_replace("token", r"^(sk-ant-|sk-|AKIA|ASIA|gh[pousr]_|github_pat_)", "")
    placeholder = body.rlike(r"(.)\1{5}") | F.lower(body).rlike("|".join(PLACEHOLDER_WORDS))
    mixed = (F.col("format") != "sk-") | (body.rlike("[0-9]") & body.rlike("[A-Z]") & body.rlike("[a-z]"))
    return hits.filter(~placeholder & mixed)
