"""The tree source, limits on submissions, table functions in SQL, study statistics, state of streams."""

import datetime as dt
import os
import random
import statistics

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from codelode import queries
from codelode.operators import diffs, findings, history, study
from codelode.operators.tokens import tokens
from codelode.sources import formats, guards, table_functions, tree
from codelode.streaming import state


def test_tree_opens_nothing_below_a_pruned_directory(spark, tmp_path, monkeypatch):
    for name in ("src/a.py", "src/.git/b.py", "src/node_modules/deep/c.js", "src/lib/d.ts", "src/notes.md", "src/lib/.hidden", "src/lib/Makefile", "src/build"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\ny")
    os.mkfifo(tmp_path / "src" / "lib" / "pipe.py")
    entered = []
    scan = os.scandir
    monkeypatch.setattr(tree.os, "scandir", lambda path: entered.append(str(path)) or scan(path))
    parts = tree.TreeReader(str(tmp_path / "src"), 1).partitions()
    assert sorted(p for part in parts for _, p in part.files) == ["a.py", "build", "lib/.hidden", "lib/Makefile", "lib/d.ts", "notes.md"] and len(parts) == 7
    assert sorted(entered) == [str(tmp_path / "src"), str(tmp_path / "src" / "lib")]
    monkeypatch.undo()
    tree.register(spark)
    found = spark.read.format("source_tree").load(str(tmp_path / "src")).collect()
    assert sorted(tuple(r) for r in found) == [("a.py", "python", ".py", 2, "x\ny"), ("lib/d.ts", "typescript", ".ts", 2, "x\ny"), ("notes.md", None, ".md", 2, None)]
    assert [r.path for r in spark.read.format("source_tree").load(str(tmp_path / "src" / "a.py")).collect()] == ["a.py"]
    assert spark.read.format("source_tree").load(str(tmp_path / "nothing")).count() == 0


def test_a_file_that_goes_between_listing_and_reading(tmp_path):
    (tmp_path / "a.py").write_bytes(b"\xff\n")
    (tmp_path / "b.py").write_text("z")
    reader = tree.TreeReader(str(tmp_path), 1 << 20)
    (part,) = reader.partitions()
    (tmp_path / "b.py").unlink()
    assert [(r[0], r[3], r[4]) for r in reader.read(part)] == [("a.py", 2, "�\n")]


@pytest.mark.parametrize("rows,said", [
    ([("a.py", "x")] * 3, "3 files of 3 bytes; at most 2 and 10 are taken"), ([("a.py", "x" * 11)], "1 files of 11 bytes"), ([("../a.py", "x")], "no safe relative path: ../a.py"),
    ([(None, "x")], "no safe relative path: null"), ([("a.go", "x")], "not a supported type: .go"),
])
def test_submissions_are_refused_when_they_are_read(spark, rows, said):
    checked = guards.checked_submission(spark.createDataFrame(rows, "path string, content string"), 2, 10)  # no job, no error yet
    with pytest.raises(PySparkException, match=said):
        checked.collect()


def test_what_is_taken(spark):
    rows = [("a.py", "x" * 5), ("b/c.ts", None)]
    assert sorted(tuple(r) for r in guards.checked_submission(spark.createDataFrame(rows, "path string, content string"), 2, 5).collect()) == rows
    assert guards.checked_submission(spark.createDataFrame([], "path string, content string")).collect() == []
    text = spark.createDataFrame([("  ",)], "text string")
    for bad, said in ((text, "diff is empty"), (text.withColumn("text", F.repeat(F.lit("é"), (1 << 19) + 1)), "more than 1048576 bytes")):
        with pytest.raises(PySparkException, match=said):
            guards.checked_diff(bad).collect()
    assert guards.checked_diff(text.withColumn("text", F.lit("x"))).count() == 1


def test_coverage_without_records(spark):
    reports = spark.createDataFrame([("a", "SF:x\nDA:1,1\nend_of_record"), ("b", "TN:\n"), ("c", None)], "file string, text string")
    entries = formats.lcov_entries(formats.lines_of(reports, "file", "text"))
    assert guards.checked_coverage(entries, reports.filter("file = 'a'"), "file").count() == 1
    with pytest.raises(PySparkException, match="no SF: and end_of_record records in b"):
        guards.checked_coverage(entries, reports, "file").collect()


def test_truncated_list_of_introduced_findings(spark):
    rows = [("p", i, True, "high", "high", i) for i in range(4)] + [("p", 9, False, "critical", "high", 9)]
    split = spark.createDataFrame(rows, "path string, line int, introduced boolean, tier string, confidence string, ord int")
    assert [(r.line, r.truncated) for r in findings.introduced_list(split, 3).collect()] == [(0, True), (1, True), (2, True)]
    assert {r.truncated for r in findings.introduced_list(split, 4).collect()} == {False}


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py\t2024
@@ -1,3 +1,4 @@ def
 same
-old
--- dashes
+new
+++ plus
 same
@@ -9 +10 @@
+ten
diff --git a/n.py b/n.py
--- /dev/null
+++ "b/n.py"
@@ -0,0 +1,2 @@
+one
+
"""


def test_sql_alone_parses_diffs_and_lexes(spark):
    table_functions.register(spark)
    texts = spark.createDataFrame([("1", DIFF), ("2", DIFF.replace("\n", "\r\n")), ("3", None), ("4", "no diff")], "file string, text string")
    texts.createOrReplaceTempView("some_diffs")
    own = formats.diff_lines(formats.lines_of(texts.filter("text is not null"), "file", "text")).filter("kind = 'added'").select("file", "path", "is_new", "line")
    got = spark.sql("SELECT * FROM parse_diff(TABLE(SELECT file, text FROM some_diffs))")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, own.collect())) and got.count() == 10
    sources = [
        ("a", "python", "def f(x):  # no\n\treturn r'a\\'b' + \"\"\"t\nu\"\"\" ** 2e-3\n"), ("b", "cpp", '#include <a>\n  # define B\nint é = 0x1F; /* c\n */ "s\\"t" \'c\' // end'), ("c", "java", 'char c = \'"\'; String t = """\nx""";'),
        ("d", "typescript", "const a = `x ${ {b: 1} }` ?? 'q';"), ("e", "csharp", '#if A\nvar @class = $"{Foo("{}")}" + @"v""w";'), ("f", "javascript", "var $x_1 = 5 . toFixed(2)"), ("g", "cobol", "x"), ("h", "java", None),
    ]
    spark.createDataFrame(sources, "path string, language string, content string").createOrReplaceTempView("some_files")
    lexed = spark.sql("SELECT path, language, idx, type, value, line FROM lex_source(TABLE(SELECT path, language, content FROM some_files))")
    assert sorted(map(tuple, lexed.collect())) == sorted(map(tuple, tokens(spark.table("some_files")).collect())) and lexed.count() > 60


def test_table_functions_give_back_bounded_pieces(monkeypatch):
    monkeypatch.setattr(table_functions, "PIECE", 50)
    files = pa.RecordBatch.from_pydict({"path": ["a", "b", "c"], "language": ["java", "java", "cobol"], "content": ["x = 1;\n" * 40, None, "x"]})
    pieces = list(table_functions.LexSource.func().eval(files))
    assert [p.num_rows for p in pieces] == [50, 50, 50, 50] and pieces[-1]["line"].to_pylist()[-1] == 40
    diffs_ = pa.RecordBatch.from_pydict({"file": ["1", "2"], "text": ["+++ b/x\n@@ -0,0 +1,60 @@\n" + "+a\n" * 60, None]})
    pieces = list(table_functions.ParseDiff.func().eval(diffs_))
    assert [p.num_rows for p in pieces] == [50, 10] and pieces[1]["line"].to_pylist()[-1] == 60
    assert [p.num_rows for p in table_functions.ParseDiff.func().eval(diffs_.slice(1))] == [0]


@pytest.mark.parametrize("seed,ranges", [(1, 256), (2, 3)])
def test_study_summary(spark, monkeypatch, seed, ranges):
    monkeypatch.setattr(study, "RANGES", ranges)
    rng = random.Random(seed)
    rows = [(rng.choice([0.0, 1.0, 1.0, 2.0, rng.random()]), rng.gauss(0, 5) if rng.random() < 0.7 else 1.5) for _ in range(101)]
    got = study.summary(spark.createDataFrame([*rows, (None, 1.0), (2.0, None)], "x double, y double"), F.col("x"), F.col("y")).first()
    xs, ys = [float(a) for a, _ in rows], [b for _, b in rows]
    mean_rank = lambda v: [sum(w < x for w in v) + (v.count(x) + 1) / 2 for x in v]
    assert (got.n, got.median_x, got.median_y) == (101, statistics.median(xs), statistics.median(ys))
    assert got.p90_x == pytest.approx(statistics.quantiles(xs, n=10, method="inclusive")[8])
    assert got.pearson == pytest.approx(statistics.correlation(xs, ys)) and got.spearman == pytest.approx(statistics.correlation(mean_rank(xs), mean_rank(ys)))
    assert tuple(study.summary(spark.createDataFrame([], "x double, y double"), F.col("x"), F.col("y")).first())[:2] == (0, None)


def test_sums_that_are_ranked_are_exact_and_made_once(spark, tmp_path):
    numbers = spark.createDataFrame([(1, [0.1] * 10), (2, [1e12] + [0.01] * 100 + [-1e12]), (3, [0.1, 1e-9]), (4, [float("inf"), 1.0]), (5, [None, 2.5]), (6, [None])], "k int, v array<double>")
    sums = numbers.select("k", F.explode("v").alias("v")).groupBy("k").agg(study.exact_sum(F.col("v")).alias("s"))
    assert {r.k: r.s for r in sums.collect()} == {1: 1.0, 2: 1.0, 3: 0.1 + 1e-9, 4: float("inf"), 5: 2.5, 6: None}
    prices = [(nation, price) for nation in range(3) for price in [1e12 + nation] + [0.01] * 100 * (nation + 1)]
    spark.createDataFrame([(k, k) for k in range(3)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(prices, "o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    found = queries.study_correlations(spark, str(tmp_path))
    assert (found.first().n, found.first().median_y) == (3, 1e12 + 3.0)
    assert "parquet" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_study_groups(spark):
    day = dt.date(2026, 10, 15)
    rows = [("a", day - dt.timedelta(days=3000), 1.0, 95.0), ("b", day - dt.timedelta(days=3653), 5.0, 69.5), ("c", day - dt.timedelta(days=5000), 7.0, 71.0), ("d", day - dt.timedelta(days=9000), 100.0, 40.0), ("e", None, 3.0, None), ("f", day - dt.timedelta(days=5100), 9.0, 84.0)]
    df = spark.createDataFrame(rows, "repo string, first date, markers double, score double")
    groups = study.age_groups(df, study.age_in_years(F.col("first"), F.lit(day)), F.col("markers")).collect()
    assert sorted(tuple(r) for r in groups) == [(0, 1, 1.0, 1.0), (1, 3, 7.0, 21.0), (3, 1, 100.0, 100.0)]
    (all_,) = study.grade_counts(df, [], F.col("score")).collect()
    assert (all_.A, all_.B, all_.C, all_.D, all_.F, all_.n) == (1, 1, 1, 1, 1, 5) and all_.average == pytest.approx(71.9)
    assert tuple(study.near_boundary(df, F.col("score")).first()) == (5, 2)
    assert sorted(r.repo for r in study.without_outliers(df, "repo", F.col("markers"), 2).collect()) == ["a", "b", "c", "e"]
    assert [(r.repo, r.share) for r in study.outlier_shares(df, "repo", F.col("markers"), 1).collect()] == [("d", 0.8)]


def test_history_as_state_goes_on_after_a_restart(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKS)
    try:
        rng = random.Random(3)
        at = lambda k: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=k)
        rows = [(rng.choice("uvw"), f"s{i:02d}", at(rng.randint(0, 30))) for i in range(30)] + [(None, "x", at(1)), ("u", None, at(1))]
        again = [("v", "s00", at(99)), ("u", "s99", at(100))]
        for part in (rows[:9], rows[9:20], rows[20:] + again):
            spark.createDataFrame(part, "user string, scan string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            read = spark.readStream.schema("user string, scan string, at timestamp").parquet(str(tmp_path / "in"))
            # Each run is a query of its own that goes on from the checkpoint.
            state.write_history(state.scan_history(read), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(240)
        latest = {}
        for user, scan, time in [*rows[:30], *again]:
            latest[user, scan] = max(time, latest.get((user, scan), time))
        expected = spark.createDataFrame([(*k, v) for k, v in latest.items()], "user string, scan string, at timestamp")
        kept = history.cap_history(expected, "user", "at", "scan", 5)
        assert sorted(map(tuple, state.history_table(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, kept.collect()))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_feedback_is_appended_once(spark, tmp_path):
    uid = "3f2b8c1e-1111-4abc-8def-0123456789ab"
    rows = [("a", 5.0, " good " + "x" * 2000, uid, "p" * 300, None, 1), ("b", 6.0, "", uid, "", "", 2), ("c", 2.5, "", uid, "", "", 3), ("d", 1.0, None, "nonsense", None, " ", 4), ("e", 3.0, "spam", uid, "p", "ACME", 5), ("f", None, "", uid, "", "", 6)]
    shape = "id string, rating double, message string, scan_id string, project string, company string, at long"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        read = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        state.append_feedback(read, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {"a", "d"} and (got["a"].rating, len(got["a"].message), got["a"].scan_id, len(got["a"].project)) == (5, 1000, uid, 200)
    assert (got["d"].message, got["d"].scan_id, got["d"].project) == ("", None, None)
