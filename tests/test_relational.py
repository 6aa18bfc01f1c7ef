"""Relational operators, formats, plans and streams on small tables."""

import json

from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.operators import clones, diffs, findings, history, hotspots, intervals, joins, rollups
from codelode.plans.report import read_report, report_json, scan, summary_text, write_report
from codelode.sources import formats
from codelode.sources.files import files_from_tree
from codelode.streaming.live import arriving_files, metrics_stream


def test_health_boundaries(spark):
    df = spark.createDataFrame([("a", 13, 4, 5.5, 1, 1, 2), ("empty", 0, 0, 0.0, 0, 0, 0)], "n string, code int, complexity int, avg double, comments int, todos int, nesting int")
    rows = {r.n: r for r in rollups.with_health(df, "code", "complexity", "avg", "comments", "todos", "nesting").collect()}
    assert round(rows["a"].health_score, 4) == 60.5556 and rows["a"].health_grade == "D"
    assert rows["empty"].health_score == 80.0 and rows["empty"].health_grade == "B"


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 4, 5), ("a", 7, 9), ("a", 2, 2), ("b", 1, 1)], "k string, start long, end long")
    assert sorted(tuple(r) for r in intervals.merge_intervals(df, ["k"]).collect()) == [("a", 1, 5, 3), ("a", 7, 9, 1), ("b", 1, 1, 1)]
    assert dict(intervals.covered_length(df, ["k"]).collect()) == {"a": 8, "b": 1}


def test_suffix_joins(spark):
    files = spark.createDataFrame([("src/a.h",), ("lib/a.h",), ("src/myfoo.h",), ("pkg/util.py",)], "path string")
    targets = spark.createDataFrame([("x.c", "a.h", 0, "a.h"), ("x.c", "foo.h", 0, "foo.h"), ("lib/a.h", "a.h", 0, "a.h"), ("y.py", "pkg.util", 1, "pkg/util.py")], "src string, target string, rank int, candidate string")
    edges = joins.resolve_suffixes(targets, files)
    assert sorted(map(tuple, edges.collect())) == [("x.c", "lib/a.h"), ("y.py", "pkg/util.py")]
    got = {r.path: (r.fan_out, r.fan_in) for r in joins.coupling(files, edges).collect()}
    assert got["lib/a.h"] == (0, 1) and sum(x for x, _ in got.values()) <= 2
    entries = spark.createDataFrame([("/b/src/a.h",), ("q/a.h",), ("none.c",)], "entry string")
    assert {r.entry: r.path for r in joins.match_by_suffix(entries, files).collect()} == {"/b/src/a.h": "src/a.h", "q/a.h": None, "none.c": None}


def test_clone_window_boundary(spark):
    tokens = [f"t{i}" for i in range(40)]
    rows = [("py", "a", tokens), ("py", "b", tokens), ("py", "c", tokens[:39]), ("js", "d", tokens), ("py", "e", tokens * 2)]
    seeds = clones.seed_windows(spark.createDataFrame(rows, "l string, f string, t array<string>"), "l", "f", F.col("t"))
    pairs = sorted(tuple(r) for r in clones.clone_pairs(seeds).select("file_a", "chunk_a", "file_b", "chunk_b", "chunks").collect())
    assert ("a", 0, "b", 0, 1) in pairs and not any("c" in p or "d" in p for p in pairs)
    assert dict(clones.clone_coverage(clones.clone_pairs(seeds)).collect()) == {"a": 40, "b": 40, "e": 80}
    assert clones.clone_pairs(seeds, cap=2).count() == 1


def test_hotspots(spark):
    rows = [("a", 40, 6), ("b", 10, 2), ("c", 25, 5), ("d", 30, 1), ("e", 2, 1)]
    top = hotspots.structural_hotspots(spark.createDataFrame(rows, "path string, complexity int, nesting int")).collect()
    assert [r.path for r in top] == ["a", "c", "d"] and top[0].score == 100.0


def test_fix_first_and_enrich(spark):
    known = spark.createDataFrame([("r", "high", "medium")], "rule_id string, tier string, confidence string")
    rows = [(i, f"p{i % 3}", i, "r" if i % 4 else "new", "warning", "T", "py") for i in range(12)]
    found = findings.enrich(spark.createDataFrame(rows, "ord int, path string, line int, rule_id string, severity string, title string, language string"), known)
    assert sorted(map(tuple, findings.enrich(found, known).select("ord", "tier").collect())) == sorted(map(tuple, found.select("ord", "tier").collect()))
    top = findings.fix_first(found).collect()
    assert [(r["rank"], r["count"], r.affected_files, len(r.locations)) for r in top] == [(1, 9, 3, 5), (2, 3, 3, 3)]
    assert top[0].score == 42.0 and top[0].locations[0] == "p1:1"


def test_diff_and_delta(spark):
    v = spark.createDataFrame([("a", 1), ("a", 2), ("a", 0), ("n", 0), ("x", 1)], "path string, line int")
    files = spark.createDataFrame([("a", False), ("n", True)], "path string, is_new boolean")
    added = spark.createDataFrame([("a", 1), ("a", 1)], "path string, line int")
    assert sorted(tuple(r) for r in diffs.split_by_diff(v, files, added).select("path", "line", "introduced").collect()) == [("a", 0, False), ("a", 1, True), ("a", 2, False), ("n", 0, True)]
    one = lambda rows: spark.createDataFrame(rows, "path string, rule_id string")
    assert tuple(diffs.finding_delta(one([("a", "r"), ("a", "r"), ("b", "s")]), one([("a", "r"), ("c", "s")]), ["path", "rule_id"]).first()) == (2, 1)


def test_formats(spark):
    stat = spark.createDataFrame([("3\t0\ta.py",), ("1\t1\ta.py",), ("-\t-\tb.png",), ("0\t2\tsrc/{old => new}/c.py",), ("5\t5\tx => y",), ("commit",)], "text string")
    assert {tuple(r) for r in formats.numstat_churn(stat).collect()} == {("a.py", 2, 4, 1), ("b.png", 1, 0, 0), ("src/new/c.py", 1, 0, 2), ("y", 1, 5, 5)}
    lcov = "TN:\nSF:a.py\nDA:1,1\nDA:2,0\nDA:2,3\nDA:3,0\nend_of_record\nSF:b.py\nDA:1,0\nLF:4\nLH:1\n"
    rows = formats.lcov_entries(formats.lines_of(spark.createDataFrame([("f", lcov)], "f string, t string"), "f", "t")).collect()
    assert {r.source: (r.lines_found, r.lines_hit, r.coverage_pct, r.uncovered) for r in rows} == {"a.py": (3, 2, 66.67, [3]), "b.py": (4, 1, 25.0, [1])}
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n a\n--- b\n+++ c\n d\n@@ -9 +9,2 @@\n e\n+f\ndiff --git a/n b/n\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1 @@\n+one\n--- a/gone.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\nBinary files a/i.png and b/i.png differ\n"
    got = [tuple(r) for r in formats.diff_lines(formats.lines_of(spark.createDataFrame([("f", diff)], "f string, t string"), "f", "t")).orderBy("n").select("kind", "path", "line", "is_new").collect()]
    assert got == [("added", "x.py", 2, False), ("added", "x.py", 10, False), ("added", "n.py", 1, True), ("deleted", "gone.py", None, False), ("binary", "i.png", None, False)]


def test_scalars(spark):
    df = spark.createDataFrame([("a/b.py",), ("node_modules/x.js",), (".gitignore",), ("../x.c",), ("src/tests/t.H",)], "p string")
    rows = {r.p: r for r in df.select("p", S.language_of(F.col("p")).alias("l"), S.in_pruned_directory(F.col("p")).alias("d"), S.safe_relative_path(F.col("p")).alias("s"), S.extension(F.col("p")).alias("e"), S.non_production(F.col("p")).alias("n")).collect()}
    assert rows["a/b.py"].l == "python" and rows["node_modules/x.js"].d and rows[".gitignore"].e == "" and rows["../x.c"].s is None and rows["src/tests/t.H"].n and rows["src/tests/t.H"].l is None
    r = spark.range(1).select(S.rank_score(F.lit("high"), F.lit("medium")).alias("a"), S.rank_score(F.lit("?"), F.lit("low")).alias("b"), S.share_text(F.lit(0.0004)).alias("c"), S.snippet(F.lit("a\nb\nc"), F.lit(2), 1).alias("d"), S.can_view(F.lit("private"), F.lit("u"), F.lit("v")).alias("e")).first()
    assert tuple(r) == (42.0, 0.0, "<0.1%", "  1 | a\n> 2 | b\n  3 | c", False)


def test_history(spark):
    rows = [("u", i, i) for i in range(7)] + [("v", None, 1)]
    kept = history.cap_history(spark.createDataFrame(rows, "u string, at int, id int"), "u", "at", "id").collect()
    assert sorted((r.u, r.id) for r in kept) == [("u", 2), ("u", 3), ("u", 4), ("u", 5), ("u", 6), ("v", 1)]


def test_scan_of_a_tree(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg" / "util.py").write_text("def f(a):\n    if a:\n        return 1\n")
    (tmp_path / "main.py").write_text("import pkg.util\neval('1')\n")
    (tmp_path / "node_modules" / "x.js").write_text("var a = 1;")
    (tmp_path / "notes.txt").write_text("a\nb")
    files, others = files_from_tree(spark, str(tmp_path))
    assert sorted(r.path for r in files.collect()) == ["main.py", "pkg/util.py"]
    assert [tuple(r) for r in others.collect()] == [("notes.txt", ".txt", 2)]
    s = scan(files)
    assert [tuple(r) for r in s.edges.collect()] == [("main.py", "pkg/util.py")]
    out = report_json(s).first()
    body = json.loads(out.json)
    assert body["files"] == 2 and body["violations"] == 1 and body["fix_first"][0]["rule_ids"] == ["py-sec-eval-exec"] and body["edges"] == 1 and "<svg" in out.badge
    text = summary_text(s).first().text
    assert "Functions : 1\nClasses : 0\n" in text and "Longest Function : f\nLength : 3 lines\n" in text and text.endswith("=\n") and text.count("\n") == 19
    for _ in range(2):
        write_report(s, str(tmp_path / "report"), "one")
    write_report(s, str(tmp_path / "report"), "two", "private")
    read = lambda part, *k: read_report(spark, str(tmp_path / "report"), part, *k)
    assert [(r.rule_id, r.line) for r in read("findings", "one").collect()] == [("py-sec-eval-exec", 2)] and read("files", "one").count() == 2
    assert read("files", "two").count() == 0 and read("files", "two", True).count() == 2
    assert json.loads(read("summary", "one").first().json)["health_grade"] and read("edges", "one").first().dst == "pkg/util.py"
    s.close()
    query = metrics_stream(arriving_files(spark, str(tmp_path)), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 2


def test_untrimmed_lcov_lines(spark):
    lines = [" SF: src/" + "x" * 5000 + ".py ", "\tDA:1,2", "DA:2,0 ", "LF:9", "LH:3", "LF:4", "LH:2", "  end_of_record"]
    frame = spark.createDataFrame([("r", i + 1, x) for i, x in enumerate(lines)], "file string, n int, text string")
    (r,) = formats.lcov_entries(frame).collect()
    assert (r.source, r.lines_found, r.lines_hit, r.coverage_pct, list(r.uncovered)) == ("src/" + "x" * 5000 + ".py", 4, 2, 50.0, [2])


def test_backslashes_and_names(spark):
    entries, own = spark.createDataFrame([("src\\b.py",)], "entry string"), spark.createDataFrame([("lib/src/b.py",), ("b.py",)], "path string")
    assert [(r.entry, r.path, r.parts) for r in joins.match_by_suffix(entries, own).collect()] == [("src\\b.py", "lib/src/b.py", 2)]
    paths = ["a/fuzz/x.py", "demo/x.py", "src/test_a.py", "src/AbcTest.java", "src/a.spec.tsx", "src/Test.py", "Docs/a.py", "docs"]
    got = [r.n for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string").orderBy("i").select(S.non_production(F.col("path")).alias("n")).collect()]
    assert got == [True, False, True, True, True, False, True, False]


def test_innermost_interval_by_blocks(spark):
    import random

    rng = random.Random(4)
    spans = [(k, i, a, a + rng.choice([-1, 0, 1, 3, 17, 200, 5000])) for k in ("a", "b", None) for i, a in enumerate(rng.randint(-300, 300) for _ in range(40))]
    points = [(k, i, rng.randint(-400, 5400) if i % 4 == 0 else rng.randint(-320, 330)) for k in ("a", "b", "c") for i in range(60)]
    got = joins.innermost_interval(
        spark.createDataFrame(points, "k string, point int, at int"), spark.createDataFrame(spans, "k string, span int, start int, end int"), ["k"]
    ).collect()
    best = lambda k, at: max(((a - b, a, s) for key, s, a, b in spans if key == k and a <= at <= b), default=(None,))[-1]
    assert len(got) == len(points) and {(r.k, r.point, r.at, r.span) for r in got} == {(k, p, at, best(k, at)) for k, p, at in points}


def test_dyadic_blocks_cover_once(spark):
    rows = [(a, b) for a in range(-9, 9, 2) for b in range(a - 1, a + 20, 3)]
    df = spark.createDataFrame(rows, "a int, b int").withColumn("blocks", joins.dyadic_blocks(F.col("a"), F.col("b")))
    for r in df.collect():
        covered = sorted(x for k in r.blocks or [] for x in range(k.block << k.level, (k.block + 1) << k.level))
        assert covered == list(range(r.a, r.b + 1)) and len(r.blocks or []) <= 10
