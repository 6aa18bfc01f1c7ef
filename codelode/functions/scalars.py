"""Column functions: paths, languages, scores, text forms. All run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by language.
LANGUAGE_OF_EXTENSION = {
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c++": "cpp", "h": "cpp", "hpp": "cpp", "hxx": "cpp", "h++": "cpp",
    "py": "python", "java": "java", "ts": "typescript", "tsx": "typescript",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "cs": "csharp",
}
# Directories that a scan leaves out.
PRUNED_DIRECTORIES = (
    ".git .idea .vscode node_modules .next venv .venv __pycache__ .pytest_cache .mypy_cache .tox .eggs vendor target "
    ".gradle bin obj Pods .build build dist out coverage .cache"
).split()
# Health ramps as (good, bad, weight).
HEALTH_RAMPS = {
    "complexity_density": (0.15, 0.50, 0.35),
    "avg_function_length": (15.0, 60.0, 0.25),
    "comment_coverage": (0.20, 0.02, 0.20),
    "todo_density": (0.01, 0.05, 0.10),
    "nesting_depth": (3.0, 8.0, 0.10),
}
IMPACT = {"critical": 100.0, "high": 60.0, "medium": 30.0, "low": 10.0}
CONFIDENCE = {"high": 1.0, "medium": 0.7, "low": 0.4}


def lookup(key: Column, table: dict, default=None) -> Column:
    """The value of ``key`` in a small literal table."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    found = F.create_map(*pairs)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Extension with its dot; empty for dot files and names without one."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1)


def language_of(path: Column) -> Column:
    """Language by extension, case-sensitive; null where none is known."""
    return lookup(F.regexp_replace(extension(path), "^[.]", ""), LANGUAGE_OF_EXTENSION)


def in_pruned_directory(path: Column) -> Column:
    """Whether a directory of the path (not its last part) is one that scans leave out."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, PRUNED_DIRECTORIES)))


def relative_path(path: Column, root: Column) -> Column:
    """The path below ``root`` where it starts with it, else the path itself."""
    root = F.regexp_replace(root, "/+$", "")
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)


def safe_relative_path(path: Column) -> Column:
    """The path, or null if it is empty, absolute, longer than 512, or has backslashes, control characters or ``..``."""
    bad = (
        (F.length(path) == 0) | (F.length(path) > 512) | path.rlike(r"^/|^[A-Za-z]:|\\|[\x00-\x1f\x7f]")
        | F.array_contains(F.split(path, "/"), "..")
    )
    return F.when(~bad, path)


# Directories outside production, and file names of tests.
NON_PRODUCTION = ["test", "tests", "testing", "spec", "docs", "examples", "samples", "benchmark", "fuzz", "fixtures", "third_party", "vendor"]
TEST_FILE = r"^(test_.*\.py|.*_test\.py|.*Test\.java|.*\.(spec|test)\.(ts|js|tsx|jsx))$"


def non_production(path: Column) -> Column:
    """Whether the path lies among tests, examples, docs and the like, or is named as a test."""
    parts = F.split(F.lower(path), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*map(F.lit, NON_PRODUCTION))) | file_name(path).rlike(TEST_FILE)


def has_ticket(text: Column) -> Column:
    return text.rlike(r"#[0-9]|[A-Z]+-[0-9]")


def ramp(value: Column, good: float, bad: float) -> Column:
    """100 at ``good`` and beyond, 0 at ``bad`` and beyond, linear between."""
    return F.least(F.greatest((value - bad) / (good - bad) * 100.0, F.lit(0.0)), F.lit(100.0))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def rank_score(tier: Column, confidence: Column) -> Column:
    """Impact times confidence, one decimal; 0 for unknown names."""
    return F.floor(lookup(tier, IMPACT, 0.0) * lookup(confidence, CONFIDENCE, 0.0) * 10 + 0.5) / 10


def collapse_space(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", " "))


def first_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """The first of ``phrases`` that the text has, letter case and runs of white space aside; null if none."""
    plain = collapse_space(text)
    return F.get(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(plain, p)), F.lit(0))


def escape_markup(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def badge_svg(label: Column, score: Column) -> Column:
    """A small SVG badge: label, score rounded half up, colour by grade."""
    colour = lookup(grade(score), {"A": "#4c1", "B": "#97ca00", "C": "#dfb317", "D": "#fe7d37", "F": "#e05d44"})
    value = F.concat(F.floor(score + 0.5).cast("string"), F.lit("/100"))
    return F.format_string(
        '<svg xmlns="http://www.w3.org/2000/svg" width="160" height="20"><rect width="160" height="20" fill="%s"/><text x="6" y="14">%s: %s</text></svg>',
        colour, escape_markup(label), value,
    )


def can_view(visibility: Column, owner: Column, user: Column) -> Column:
    """Public scans and those without a visibility are open, private ones open to their owner, others closed."""
    return F.when(visibility.isNull() | (visibility == "public"), True).when(visibility == "private", owner.isNotNull() & owner.eqNullSafe(user)).otherwise(False)


def share_text(share: Column) -> Column:
    """A share of 1 as a percentage, one decimal, or <0.1%."""
    return F.when(share < 0.001, "<0.1%").otherwise(F.concat(F.format_string("%.1f", F.floor(share * 1000 + 0.5) / 10), F.lit("%")))


def snippet(content: Column, line: Column, around: int = 8) -> Column:
    """The lines around ``line`` (from 1), each with its number, the line itself marked by ``>``."""
    lines = F.split(content, "\n", -1)
    start = F.greatest(line - around, F.lit(1))
    some = F.slice(lines, start, F.least(line + around, F.size(lines)) - start + 1)
    return F.array_join(F.transform(some, lambda x, i: F.concat(F.when(i + start == line, "> ").otherwise("  "), (i + start).cast("string"), F.lit(" | "), x)), "\n")


def repository_of(url: Column) -> Column:
    """(owner, name) of a repository URL of the usual form; nulls otherwise."""
    form = r"^(?:https?://)?(?:www\.)?github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,38}))/([A-Za-z0-9._-]{1,100}?)(?:\.git)?/?$"
    part = lambda k: F.nullif(F.regexp_extract(url, form, k), F.lit(""))
    return F.struct(part(1).alias("owner"), part(2).alias("name"))


def is_uuid4(text: Column) -> Column:
    return text.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
