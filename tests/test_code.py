"""Tokens, structure and rules on small sources of our own."""

import random

import pytest
from pyspark.sql import functions as F

from codelode.operators import rules, structure
from codelode.operators import tokens as tokens_module
from codelode.operators.rules import CATALOG, catalog, findings
from codelode.operators.structure import file_metrics, function_complexity, functions_of, import_targets
from codelode.operators.tokens import tokens

SOURCES = {
    "a.py": ("python", 'import os\nfrom pkg.sub import x\n\ndef f(a, b=[], c={}):\n    """doc\n    more"""\n    if a and b:\n        os.system("ls")  # TODO later\n    return a\n\nclass C:\n    items = []\n    LIMIT = []\n    def g(self):\n        try:\n            eval("1")\n        except:\n            pass\n\npassword = "hunter22222"\nsubprocess.run(cmd, shell=True)\nyaml.load(s)\nyaml.load(s, Loader=L)\nhashlib.md5(x, usedforsecurity=False)\n'),
    "b.h": ("cpp", '#include "foo/bar.h"\n#include <vector>\nusing namespace std;\n/* your code\n   here */\nint main(int a) {\n  if (a > 42 && a != 1) { int* p = new int; }\n  try { x(); } catch (...) { }\n  system("x");\n  return 0;\n}\nvoid* operator new(int);\n'),
    "C.java": ("java", 'import static java.util.List.of;\nclass A {\n  public int x;\n  public static final int Y = 1;\n  public void m(String q) {\n    try { s.executeQuery("a" + q); } catch (Exception e) {\n    }\n    try { } catch (Exception e) { /* no */ }\n    e.printStackTrace();\n    List l = new ArrayList();\n    MessageDigest.getInstance("MD5");\n  }\n}\n'),
    "d.ts": ("typescript", 'import {a} from "./x";\nvar y: any = 1;\nif (y == 2 || y != 3) { el.innerHTML = z; }\nfunction h(b) { return a === b ? 1 : 2; }\ncp.exec("ls"); re.exec("s");\nconst key = "ghp_aZ3bY4cX5dW6eV7fU8gT9hS0iR1jQ2kP3lO4";\nconst apiKey = "ghp_aZ3bY4cX5dW6eV7fU8gT9hS0iR1jQ2kP3lO4";\ntry { a() } catch { }\n'),
    "E.cs": ("csharp", 'using System.IO;\nusing X = A.B;\nclass E {\n  public int Field;\n  public int Prop { get; set; }\n  async void M() { Console.WriteLine(@"a""b"); var c = new SqlCommand("x" + y); }\n}\n'),
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, *v) for p, v in SOURCES.items()] + [("empty.py", "python", None), ("x.txt", None, "words")]
    return spark.createDataFrame(rows, "path string, language string, content string")


@pytest.fixture(scope="module")
def table(files):
    return tokens(files).cache()


def test_tokens_cover_the_source(table, files):
    rows = table.filter("path = 'a.py'").orderBy("idx").collect()
    assert [r.value for r in rows if r.type == "STRING"][0].startswith('"""doc')
    assert {r.line for r in rows if r.value == "os"} == {1, 8}
    assert [r.value for r in rows if r.type == "LINE_COMMENT"] == ["# TODO later"]
    assert [r.value for r in table.filter("path = 'E.cs' and type = 'STRING'").orderBy("idx").collect()] == ['@"a""b"', '"x"']


def test_functions_and_complexity(table, files):
    own = {(r.path, r.name): (r.start_line, r.end_line) for r in functions_of(table, files).collect()}
    assert own[("a.py", "f")] == (4, 9) and own[("a.py", "g")] == (14, 18)
    assert own[("b.h", "main")] == (6, 11) and own[("C.java", "m")] == (5, 12) and own[("d.ts", "h")] == (4, 4) and own[("E.cs", "M")] == (6, 6)
    paths = {(r.path, r.name): r.complexity for r in function_complexity(table, files).collect()}
    assert paths[("a.py", "f")] == 3 and paths[("b.h", "main")] == 4 and paths[("d.ts", "h")] == 2


def test_metrics_add_up(table, files):
    rows = {r.path: r for r in file_metrics(table, files).collect()}
    assert all(r.code_lines + r.comment_lines + r.blank_lines == r.total_lines for r in rows.values())
    assert rows["a.py"].max_nesting == 3 and rows["b.h"].max_nesting == 2 and rows["empty.py"].total_lines == 1
    assert rows["b.h"].comment_lines == 2


def test_long_imports(spark):
    names = "".join(f"  name{i},\n" for i in range(200))
    rows = [(f"a.{x}", language, f'import {{\n{names}}} from "./far";\nimport b from "./near"\nimport c;\nlet d = "no module";\n') for x, language in (("js", "javascript"), ("ts", "typescript"))]
    got = sorted((r.path, r.target) for r in import_targets(tokens(spark.createDataFrame(rows, "path string, language string, content string"))).collect())
    assert got == [(p, t) for p in ("a.js", "a.ts") for t in ("", "./far", "./near")]


def test_imports(table):
    found = {}
    for r in import_targets(table).collect():
        found.setdefault(r.path, set()).add(r.target)
    assert found == {"a.py": {"os", "pkg.sub"}, "b.h": {"foo/bar.h", ""}, "C.java": {"java.util.List.of"}, "d.ts": {"./x"}, "E.cs": {"System.IO", "A.B"}}


def test_findings(table, files):
    got = sorted((r.path, r.line, r.rule_id) for r in findings(table, files).collect())
    want = [
        ("a.py", 4, "py-mutable-default-arg"), ("a.py", 4, "py-mutable-default-arg"), ("a.py", 8, "py-sec-os-system"), ("a.py", 8, "py-todo-without-ticket"),
        ("a.py", 12, "py-mutable-class-attribute"), ("a.py", 16, "py-sec-eval-exec"), ("a.py", 17, "py-bare-except"), ("a.py", 20, "py-sec-hardcoded-secret"),
        ("a.py", 21, "py-sec-subprocess-shell-true"), ("a.py", 22, "py-sec-yaml-unsafe-load"),
        ("b.h", 3, "cpp-using-namespace-std-header"), ("b.h", 4, "cpp-unreviewed-placeholder"), ("b.h", 7, "cpp-magic-number-literal"), ("b.h", 7, "cpp-raw-new-delete"),
        ("b.h", 8, "cpp-catch-all-ellipsis"), ("b.h", 9, "cpp-sec-system-call"),
        ("C.java", 3, "java-public-field"), ("C.java", 6, "java-sec-sql-string-concat"), ("C.java", 6, "java-empty-catch-block"), ("C.java", 9, "java-printstacktrace"),
        ("C.java", 10, "java-raw-type-usage"), ("C.java", 10, "java-raw-type-usage"), ("C.java", 11, "java-sec-weak-hash"),
        ("d.ts", 2, "ts-explicit-any"), ("d.ts", 2, "ts-var-usage"), ("d.ts", 3, "ts-loose-equality"), ("d.ts", 3, "ts-loose-equality"), ("d.ts", 3, "ts-sec-inner-html"),
        ("d.ts", 5, "ts-sec-child-process-exec"), ("d.ts", 6, "ts-sec-secret-token"), ("d.ts", 7, "ts-sec-secret-token"), ("d.ts", 8, "ts-empty-catch-block"),
        ("E.cs", 4, "csharp-public-field"), ("E.cs", 6, "csharp-async-void"), ("E.cs", 6, "csharp-console-writeline"), ("E.cs", 6, "csharp-sec-sql-string-concat"),
    ]
    assert got == sorted(want)


def test_thresholds(spark):
    body = "\n".join(f"    if a{i}:\n        pass" for i in range(10))
    deep = "\n".join("    " * i + "if x:" for i in range(7)) + "\n" + "    " * 7 + "y = 1\n"
    rows = [("nine.py", "def f():\n" + "\n".join(body.split("\n")[:18]) + "\n"), ("ten.py", "def f():\n" + body + "\n"), ("deep.py", deep), ("long.py", "def f():\n" + "    x = 1\n" * 100)]
    files = spark.createDataFrame([(p, "python", c) for p, c in rows], "path string, language string, content string")
    got = sorted((r.path, r.rule_id) for r in findings(tokens(files), files).collect())
    assert got == [("deep.py", "py-deep-nesting"), ("long.py", "py-long-function"), ("ten.py", "py-complex-function")]


def test_catalog(spark):
    assert catalog(spark).count() == 98 == len(set(x.split()[0] for x in CATALOG.strip().splitlines()))
    assert catalog(spark, category="security").count() == 45
    with pytest.raises(ValueError):
        catalog(spark, language="cobol")


def functions_in(spark, *files):
    frame = spark.createDataFrame([(f"{i}", language, text) for i, (language, text) in enumerate(files)], "path string, language string, content string")
    toks = tokens(frame)
    return frame, toks, {(r.path, r.name, r.start_line, r.end_line) for r in structure.functions_of(toks, frame).collect()}


def test_function_forms(spark):
    _, _, got = functions_in(
        spark, ("cpp", "int A::m() const noexcept {\n}\nint f(int x);\nauto g() -> int {\n}\n"), ("java", "class A { void m() throws X, Y {\n}\n void n();\n int k() {}\n}"),
        ("typescript", "const h = (x: number) => {\n};\nfunction t(a: A): Promise<B> {\n}\nrun(() => {\n});\n"), ("csharp", "class A { void M(T x) where T : B {\n} }"),
        ("javascript", "const k = function (a) {\n}\n"),
    )
    assert got == {
        ("0", "m", 1, 2), ("0", "g", 4, 5), ("1", "m", 1, 2), ("1", "k", 4, 4), ("2", "h", 1, 2), ("2", "t", 3, 4), ("2", "<anonymous>", 5, 6), ("3", "M", 1, 2), ("4", "k", 1, 2),
    }


def test_question_marks_and_matches(spark):
    frame, toks, _ = functions_in(
        spark, ("typescript", "function f(x?: T) { return x?.a?.b ?? c; }"), ("csharp", "class A { int F() { int? a = 1; int? b = 2; return a ?? b; } }"),
        ("python", "def f(x):\n    match x:\n        case 1: pass\n        case 2: pass\n"), ("java", "class A { int f(int a) { return a > 1 ? 2 : 3; } }"),
    )
    got = {r.path: r.complexity for r in structure.function_complexity(toks, frame).collect()}
    assert got == {"0": 2, "1": 2, "2": 1, "3": 2}


def test_imports_and_fields_of_any_length(spark):
    names = ",\n".join(f"name{i}" for i in range(60))
    dotted = ".".join(f"part{i}" for i in range(80))
    wide = "Map<" + ", ".join(f"A{i}" for i in range(30)) + ">"
    frame = spark.createDataFrame([
        ("a.ts", "typescript", f"import {{ {names} }} from './z';\n"), ("a.java", "java", f"import {dotted};\npublic class A {{\n public {wide} field;\n public {wide} get() {{ return null; }}\n}}"),
        ("a.py", "python", f"import {dotted} as x, y\nfrom . import z\n"), ("a.cs", "csharp", "using A.B;\nusing X = C.D;\nusing (var f = g()) { }"),
    ], "path string, language string, content string")
    toks = tokens(frame)
    got = sorted((r.path, r.target) for r in structure.import_targets(toks).collect())
    assert got == sorted([("a.ts", "./z"), ("a.java", dotted), ("a.py", dotted), ("a.py", "."), ("a.cs", "A.B"), ("a.cs", "C.D")])
    found = [(r.path, r.line) for r in rules.findings(toks, frame).filter("rule_id = 'java-public-field'").collect()]
    assert found == [("a.java", 3)]


WORDS = "( ) { } ; = => == . ? ?. , < > + & && | || : [ ] name other catch try function throws where const noexcept new class def if while for case match eval exec any as var let 42 0 1.5 'a' \"b\" `c` /*d*/ //e\n #f\n \n \n Runtime . getRuntime ( ) . exec ( shell = True Loader usedforsecurity = False subprocess . run yaml . load hashlib . md5 MessageDigest . getInstance   é \x1c X509TrustManager do when foreach and or".split(" ")


def soup(seed, n, length):
    rng = random.Random(seed)
    words = lambda: [rng.choice(WORDS) if rng.random() < 0.5 else rng.choice("(){};=") for _ in range(rng.randint(0, length))]
    return [(f"{i}", tokens_module.LANGUAGES[i % 6], " ".join(words())) for i in range(n)] + [("none", "java", None)]


def test_reading_finds_what_the_windows_find(spark):
    files = spark.createDataFrame(soup(7, 600, 60), "path string, language string, content string")
    events = rules.code_events(files, besides=False)
    columns = ["path", "language", "line", "idx", "close", "f_name", "f_start", "f_end", "rule_id"]
    rows = [sorted(map(str, x.select(*columns).collect())) for x in (events, rules.table_events(structure.significant(tokens(files))))]
    assert rows[0] == rows[1] and len({r.rule_id for r in events.select("rule_id").distinct().collect()}) > 10
    # Fields, in bodies of types that may hold data.
    heads = ["public int x;", "public static final int y = 1;", "public static int z,", "public Map<A, B[]> m =", "public void run() {", "void go() { }", "A() { a.b(); }", "class B { }", "public", "public", "static", "final", "class A {", "enum B {", "int x", "void run()", "A()", "getX()", "toString()", "Map<A, B[]> m", "@ T(1)", "record", "interface", "= f()", "const", "readonly", "}", "{", ";", ";", ","]
    rng = random.Random(11)
    some = spark.createDataFrame([(f"{i}", ("java", "csharp")[i % 2], "class A {\n" + "\n".join(rng.choice(heads) for _ in range(rng.randint(0, 40)))) for i in range(400)], "path string, language string, content string")
    code = structure.significant(tokens(some))
    windows = rules.public_fields(code.filter("language = 'java'"), code.filter("language = 'csharp'")).collect()
    fields = rules.code_events(some).filter("rule_id like '%-public-field'").select("path", "language", "line", "rule_id").collect()
    assert sorted(fields) == sorted(windows) and len(fields) > 50
    assert "Window" not in events._jdf.queryExecution().executedPlan().toString()


def test_metrics_of_files_are_never_broadcast(spark):
    files = spark.range(3).selectExpr("cast(id as string) path", "'python' language", "'def f():\n  if a: b()\n' content")
    plan = file_metrics(tokens(files), files)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
