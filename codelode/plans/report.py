"""A scan as one plan: files to tokens, metrics, findings, graph, hotspots, clones, health and the report.

A report is one row of bounded size (totals, languages, what to fix first, hot spots) beside tables of its files, findings,
clones and edges, which are written as JSON rows by visibility and scan: no list of them is ever gathered in one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clones, findings, hotspots, joins, rollups, rules, scopes, structure, tokens
from ..functions.scalars import badge_svg

COUNTERS = ["total_lines", "code_lines", "comment_lines", "blank_lines", "functions", "classes", "variables", "loops", "conditions", "tries", "imports", "todos", "complexity"]
#: The lines of a text summary: what it says and the column.
SUMMARY = [
    ("Files Analyzed", "files"), ("Total Lines", "total_lines"), ("Blank Lines", "blank_lines"), ("Comments", "comment_lines"), ("Functions", "functions"), ("Classes", "classes"),
    ("Variables", "variables"), ("Loops", "loops"), ("Conditions", "conditions"), ("Maximum Nesting", "max_nesting"), ("Cyclomatic Complexity", "complexity"),
]
#: The tables of a report.
PARTS = ("files", "findings", "clones", "edges")


@dataclass
class Scan:
    """The frames of one scan, all lazy over the same token table."""

    files: DataFrame
    tokens: DataFrame
    metrics: DataFrame
    findings: DataFrame
    edges: DataFrame
    clones: DataFrame

    def close(self) -> None:
        """Give back what the token table holds."""
        self.tokens.unpersist()


def with_declarations(metrics: DataFrame, found: DataFrame) -> DataFrame:
    """File metrics with classes, variables, loops, conditions and tries."""
    classes = scopes.type_declarations(found).groupBy("path").agg(F.count("*").alias("classes"))
    joined = metrics.join(scopes.declaration_counts(found), "path", "left").join(classes, "path", "left")
    return joined.fillna(0, ["classes", "variables", "loops", "conditions", "tries"])


def scan(files: DataFrame) -> Scan:
    """``files`` has path, language, content. Tokens are persisted: metrics, rules, imports and clones all read them."""
    found = tokens.tokens(files).persist()
    imports = structure.import_targets(found).filter("target <> ''")
    plain = F.regexp_replace("target", r"^\./", "")
    dotted = F.replace(plain, F.lit("."), F.lit("/"))
    names = F.array(plain, F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit(".java")))
    targets = imports.select(F.col("path").alias("src"), "target", F.posexplode(names).alias("rank", "candidate")).filter(F.contains("candidate", F.lit("/")) | F.contains("candidate", F.lit(".")))
    matches = clones.clone_matches(clones.token_chunks(clones.token_rows(found)))
    metrics = with_declarations(structure.file_metrics(found, files), found)
    return Scan(files, found, metrics, rules.findings(found, files), joins.resolve_suffixes(targets, files.select("path")), matches)


def totals(s: Scan) -> DataFrame:
    """Project and language totals with health: one row a language and one for the project."""
    sums = {c: F.col(c) for c in [*COUNTERS, "function_lines"]}
    rolled = rollups.rollup_totals(s.metrics, F.col("language"), sums, {"max_nesting": F.col("max_nesting")}, F.col("longest_function"), F.col("longest_name"), F.lit(0))
    rolled = rolled.withColumn("avg_function", F.coalesce(F.try_divide("function_lines", "functions"), F.lit(0.0)))
    return rollups.with_health(rolled, "code_lines", "complexity", "avg_function", "comment_lines", "todos", "max_nesting")


def summary(s: Scan, churn: DataFrame | None = None) -> DataFrame:
    """One row of bounded size: the project's totals, a struct a language, what to fix first, hot spots, clones and edges by number."""
    rows = totals(s)
    spots = s.metrics.select("path", "complexity", F.col("max_nesting").alias("nesting"))
    hot = hotspots.structural_hotspots(spots) if churn is None else hotspots.churn_hotspots(spots, churn).filter("score > 0").limit(10)
    ordered = s.findings.withColumn("ord", F.struct("path", "line", "rule_id")).withColumns({"title": F.col("rule_id"), "message": F.col("rule_id")})
    few = lambda df, name, *order: df.agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order]))).alias(name))
    parts = [
        rows.filter("scope = 'project'").drop("scope", "language"), few(rows.filter("scope <> 'project'"), "by_language", "language"), few(findings.fix_first(ordered), "fix_first", "rank"),
        few(hot, "hotspots", "path"), clones.duplication(s.clones, s.metrics), s.findings.agg(F.count("*").alias("violations")), s.edges.agg(F.count("*").alias("edges")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each, of a few languages, findings and files
    return out


def report_json(s: Scan, churn: DataFrame | None = None) -> DataFrame:
    """The summary as JSON, and the badge."""
    own = summary(s, churn)
    return own.select(F.to_json(F.struct(F.lit(3).alias("schema_version"), *own.columns)).alias("json"), badge_svg(F.lit("health"), F.col("health_score")).alias("badge"))


def write_report(s: Scan, target: str, scan_id: str, visibility: str = "public", churn: DataFrame | None = None) -> None:
    """The report's tables and its summary below ``target``, each a folder by visibility and scan.

    Only a scan's own folders are replaced, so a report that is written again is there once; a scan has one visibility.
    """
    if visibility not in ("public", "private"):
        raise ValueError("a report is public or private")
    files = s.metrics.join(joins.coupling(s.files, s.edges), "path")
    tables = dict(zip(PARTS, (files, s.findings, s.clones, s.edges), strict=True)) | {"summary": report_json(s, churn)}
    for name, df in tables.items():
        keyed = df.withColumns({"visibility": F.lit(visibility), "scan_id": F.lit(scan_id)})
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("visibility", "scan_id").json(f"{target}/{name}")


def read_report(spark: SparkSession, target: str, part: str, scan_id: str, private: bool = False) -> DataFrame:
    """A part of a stored report; private ones only where they are asked for."""
    rows = spark.read.option("basePath", f"{target}/{part}").json(f"{target}/{part}/visibility={'private' if private else 'public'}")
    return rows.filter(F.col("scan_id") == scan_id).drop("visibility", "scan_id")


def summary_text(s: Scan) -> DataFrame:
    """The project's totals as text, in fixed order; a project without functions has no longest one."""
    project = totals(s).filter("scope = 'project'")
    rule = F.lit("=" * 34)
    longest = F.when(F.col("longest_size") > 0, F.concat(F.lit("Longest Function : "), "longest_name", F.lit("\nLength : "), F.col("longest_size").cast("string"), F.lit(" lines"))).otherwise("Longest Function : (none)")
    lines = [
        rule, F.lit("CODE METRICS REPORT"), rule, *[F.concat(F.lit(f"{said} : "), F.col(c).cast("string")) for said, c in SUMMARY],
        F.concat(F.lit("Average Function Length : "), F.format_string("%.1f", "avg_function")), longest, F.concat(F.lit("TODO Comments : "), F.col("todos").cast("string")), rule,
    ]
    return project.select(F.concat(F.array_join(F.array(*lines), "\n"), F.lit("\n")).alias("text"))
