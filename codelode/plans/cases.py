"""Source files with stated findings, built from a table's rows: every rule fires a number of times that SQL can count.

A file holds each case of its language as often as its row says; ``@`` in a case is the row's key. A case states its
findings as ``rule:line`` (line from 1 within the case; a rule of the whole file is ``rule!line``, line 0 for none),
and how many functions and decision points it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = "ghp_aZ3bY4cX5dW6eV7fU8gT9hS0iR1jQ2kP3lO4"
_BLANK = "\n" * 99
SUFFIX = {"cpp": ".h", "python": ".py", "java": ".java", "typescript": ".ts", "javascript": ".js", "csharp": ".cs"}


def _braces(prefix: str, size: str, head: str, tail: str = "}") -> list[tuple[str, str, int, int]]:
    """Long, complex and deep code of a brace language; each once just below its limit."""
    return [
        (f"{head}\n{_BLANK}{tail}", f"{prefix}-{size}:1", 1, 0), (f"{head}\n{_BLANK[1:]}{tail}", "", 1, 0),
        (f"{head}\n" + "if (a@) b();\n" * 10 + tail, f"{prefix}-complex-function:1", 1, 10), (f"{head}\n" + "if (a@) b();\n" * 9 + tail, "", 1, 9),
        ("{" * 7 + "}" * 7, f"{prefix}-deep-nesting!0", 0, 0), ("{" * 6 + "}" * 6, "", 0, 0),
        ("// TODO later @", f"{prefix}-todo-without-ticket:1", 0, 0), ("/* first\n FIXME @ */", f"{prefix}-todo-without-ticket:1", 0, 0), ("// TODO PROJ-12 later", "", 0, 0),
        ("// your code here", f"{prefix}-unreviewed-placeholder:1", 0, 0), ("// your code is here", "", 0, 0),
    ]


def _secrets(prefix: str, declare: str, end: str = ";") -> list[tuple[str, str, int, int]]:
    return [
        (f'{declare}password = "hunter2222@"{end}', f"{prefix}-sec-hardcoded-secret:1", 0, 0), (f'{declare}password = "short"{end}', "", 0, 0),
        (f'{declare}k = "{_TOKEN}"{end}', f"{prefix}-sec-secret-token:1", 0, 0), (f'{declare}apiKey = "{_TOKEN}"{end}', f"{prefix}-sec-secret-token:1", 0, 0),
        (f'{declare}k = "x{_TOKEN}"{end}', "", 0, 0),
    ]


def _script(prefix: str) -> list[tuple[str, str, int, int]]:
    return [
        ("try { f@(); } catch (e) { }", f"{prefix}-empty-catch-block:1", 0, 1), ("try {\n f(); } catch {\n }", f"{prefix}-empty-catch-block:2", 0, 1), ("try { f(); } catch (e) { g@(e); }", "", 0, 1),
        ("var a@;", f"{prefix}-var-usage:1", 0, 0), ("let a@;", "", 0, 0),
        ("if (a == b@) { f(); }", f"{prefix}-loose-equality:1", 0, 1), ("if (a != b@) { f(); }", f"{prefix}-loose-equality:1", 0, 1), ("if (a === b || a !== c) { f(); }", "", 0, 2),
        ("eval(a@);", f"{prefix}-sec-eval:1", 0, 0), ("cp.exec(a@);", f"{prefix}-sec-child-process-exec:1", 0, 0), ("execSync(a@);", f"{prefix}-sec-child-process-exec:1", 0, 0), ("re.exec(a@);", "", 0, 0),
        ("el.innerHTML = a@;", f"{prefix}-sec-inner-html:1", 0, 0), ("el.textContent = a@;", "", 0, 0),
        ("createHash('md5');", f"{prefix}-sec-weak-hash:1", 0, 0), ("createHash('sha256');", "", 0, 0),
        ("const o@ = { rejectUnauthorized: false };", f"{prefix}-sec-disabled-tls:1", 0, 0), ("const o@ = { rejectUnauthorized: true };", "", 0, 0),
        ("db.query('a' + b@);", f"{prefix}-sec-sql-string-concat:1", 0, 0), ("db.query('a + b');", "", 0, 0),
        ("const h@ = (x) => {\n return x ? 1 : 2;\n};", "", 1, 1),
        *_braces(prefix, "long-method", "function f@() {"), *_secrets(prefix, "const "),
    ]


_STEPS = "\n".join(" " * i + "if a@:" for i in range(7)) + "\n       f()"
CASES: dict[str, list[tuple[str, str, int, int]]] = {
    "cpp": [
        ("int* p@ = new int;", "cpp-raw-new-delete:1", 0, 0), ("delete p@;", "cpp-raw-new-delete:1", 0, 0), ("A& operator=(const A&) = delete;", "", 0, 0), ("void* operator new(int);", "", 0, 0),
        ("using namespace std;", "cpp-using-namespace-std-header:1", 0, 0), ("using namespace std@;", "", 0, 0),
        ("try { f(); }\ncatch (...) { }", "cpp-catch-all-ellipsis:2", 0, 1), ("try { f(); } catch (...) { g@(); }", "", 0, 1), ("try { f(); } catch (E& e) { }", "", 0, 1),
        ("if (a@ > 42) { f(); }", "cpp-magic-number-literal:1", 0, 1), ("while (g(a,\n 7)) { f(); }", "cpp-magic-number-literal:2", 0, 1), ("if (a@ > 1) { f(42); }", "", 0, 1),
        ('system("ls @");', "cpp-sec-system-call:1", 0, 0), ("popen(c@, m);", "cpp-sec-popen-call:1", 0, 0), ("strcpy(a@, b);", "cpp-sec-unsafe-buffer-fn:1", 0, 0), ("gets(a@);", "cpp-sec-unsafe-buffer-fn:1", 0, 0),
        ("strncpy(a@, b, n);", "", 0, 0), ("srand(a@);", "cpp-sec-weak-random:1", 0, 0), ("MD5(a@);", "cpp-sec-weak-hash:1", 0, 0), ('"system(a)";', "", 0, 0),
        *_braces("cpp", "long-function", "void f@() {"), *_secrets("cpp", "const char* "),
    ],
    "python": [
        ("try:\n    f@()\nexcept:\n    pass", "py-bare-except:3", 0, 1), ("try:\n    f@()\nexcept E:\n    pass", "", 0, 1),
        ("from a@ import *", "py-wildcard-import:1", 0, 0), ("from a@ import b", "", 0, 0),
        ("def f@(a=[], b={}):\n    pass", "py-mutable-default-arg:1 py-mutable-default-arg:1", 1, 0), ("def f@(a=None, b=()):\n    pass", "", 1, 0),
        ("class A@:\n    items = []", "py-mutable-class-attribute:2", 0, 0), ("class A@:\n    LIMIT = []", "", 0, 0),
        (f"def f@():\n{_BLANK}    pass", "py-long-function:1", 1, 0), (f"def f@():\n{_BLANK[1:]}    pass", "", 1, 0),
        ("def g@():\n" + "    if a: b()\n" * 9 + "    if a: b()", "py-complex-function:1", 1, 10), ("def g@():\n" + "    if a: b()\n" * 8 + "    if a: b()", "", 1, 9),
        (_STEPS, "py-deep-nesting!0", 0, 7), ("# TODO later @", "py-todo-without-ticket:1", 0, 0), ("# TODO PROJ-12 later", "", 0, 0), ("# your code here", "py-unreviewed-placeholder:1", 0, 0),
        ("eval(x@)", "py-sec-eval-exec:1", 0, 0), ("exec(x@)", "py-sec-eval-exec:1", 0, 0), ("a.eval(x@)", "", 0, 0), ("os.system(c@)", "py-sec-os-system:1", 0, 0), ("os.path(c@)", "", 0, 0),
        ("subprocess.run(c@, shell=True)", "py-sec-subprocess-shell-true:1", 0, 0), ("subprocess.run(c@, shell=False)", "", 0, 0), ("pickle.loads(b@)", "py-sec-pickle-load:1", 0, 0), ("pickle.dumps(b@)", "", 0, 0),
        ("yaml.load(s@)", "py-sec-yaml-unsafe-load:1", 0, 0), ("yaml.load(s@, Loader=L)", "", 0, 0), ("hashlib.md5(b@)", "py-sec-weak-hash:1", 0, 0), ("hashlib.sha1(b@, usedforsecurity=False)", "", 0, 0),
        ('password_field = "hunter2222@"', "", 0, 0), *_secrets("py", "", ""),
    ],
    "java": [
        ("class A@ { A@() { try { f(); } catch (E e) { } } }", "java-empty-catch-block:1", 1, 1), ("class A@ { A@() { try { f(); } catch (E e) { /* no */ } } }", "", 1, 1),
        ("class B@ {\n public int x;\n void run() { }\n}", "java-public-field:2", 1, 0), ("class B@ {\n public static final int Y = 1;\n public int get() { return 1; }\n}", "", 1, 0),
        ("class D@ {\n public int x = f();\n public D@(int a) { x = a; }\n public int getX() { return x; }\n}", "", 2, 0), ("class E@ {\n public\n  Map<A, B[]> m;\n class F@ {\n  public int y;\n }\n void run() { }\n}", "java-public-field:3", 1, 0),
        ("public class G@ extends A, B { }", "", 0, 0),
        ("e@.printStackTrace();", "java-printstacktrace:1", 0, 0), ("List l@ = f();", "java-raw-type-usage:1", 0, 0), ("List<A> l@ = f();", "", 0, 0),
        ("Runtime.getRuntime().exec(c@);", "java-sec-runtime-exec:1", 0, 0), ("new ProcessBuilder(c@);", "java-sec-runtime-exec:1", 0, 0), ("pool.exec(c@);", "", 0, 0),
        ('MessageDigest.getInstance("MD5");', "java-sec-weak-hash:1", 0, 0), ('MessageDigest.getInstance("SHA-256");', "", 0, 0),
        ('Cipher.getInstance("DES");', "java-sec-weak-cipher:1", 0, 0), ('Cipher.getInstance("AES");', "", 0, 0),
        ('s.executeQuery("a" + q@);', "java-sec-sql-string-concat:1", 0, 0), ('s.executeQuery("a");', "", 0, 0), ("X509TrustManager t@;", "java-sec-trust-manager-review!1", 0, 0),
        *_braces("java", "long-method", "class C@ { void m() throws X {", "} }"), *_secrets("java", "String "),
    ],
    "typescript": [("let a@: any;", "ts-explicit-any:1", 0, 0), ("let a@ = b as any;", "ts-explicit-any:1", 0, 0), ("let any@: string;", "", 0, 0), *_script("ts")],
    "javascript": _script("js"),
    "csharp": [
        ("class A@ { void M() { try { F(); } catch (E e) { } } }", "csharp-empty-catch-block:1", 1, 1), ("class A@ { void M() { try { F(); } catch { } } }", "csharp-empty-catch-block:1", 1, 1),
        ("class B@ {\n public int F;\n}", "csharp-public-field:2", 0, 0), ("class B@ {\n public const int G = 1;\n public int P { get; set; }\n}", "", 0, 0),
        ("class B@ {\n public event\n  Handler Done;\n public static readonly int[,] H = f;\n}", "csharp-public-field:3", 0, 0),
        ("Console.WriteLine(a@);", "csharp-console-writeline:1", 0, 0), ("Log.WriteLine(a@);", "", 0, 0),
        ("class D@ { async void N() { F(); } }", "csharp-async-void:1", 1, 0), ("class D@ { async Task N() { F(); } }", "", 1, 0),
        ("Process.Start(a@);", "csharp-sec-process-start:1", 0, 0), ("MD5.Create();", "csharp-sec-weak-hash:1", 0, 0), ("SHA256.Create();", "", 0, 0), ("DES.Create();", "csharp-sec-weak-cipher:1", 0, 0), ("Aes.Create();", "", 0, 0),
        ('new SqlCommand("a" + b@);', "csharp-sec-sql-string-concat:1", 0, 0), ('new SqlCommand("a");', "", 0, 0), ("ServerCertificateValidationCallback = f@;", "csharp-sec-cert-validation-disabled!1", 0, 0),
        *_braces("csharp", "long-method", "class C@ { void M() {", "} }"), *_secrets("csharp", "var "),
    ],
}


def _built(df: DataFrame, key: Column, times: Column, texts: dict[str, list[str]]) -> DataFrame:
    built = [
        F.struct(F.lit(language).alias("language"), F.lit(SUFFIX[language]).alias("suffix"), F.replace(F.concat(*[F.repeat(F.lit(text + "\n"), times) for text in own]), F.lit("@"), key.cast("string")).alias("content"))
        for language, own in texts.items()
    ]
    files = df.select(key.cast("string").alias("_key"), F.explode(F.array(*built)).alias("_f"))
    return files.select(F.concat("_key", "_f.suffix").alias("path"), "_f.language", "_f.content")


def case_files(df: DataFrame, key: Column, times: Column) -> DataFrame:
    """(path, language, content): a file of each language for each row, its cases repeated ``times``."""
    return _built(df, key, times, {language: [text for text, *_ in cases] for language, cases in CASES.items()})


def expected_findings() -> list[tuple[str, int, int, int, int]]:
    """(rule_id, line, lines before the case, lines of the case, 1 if once a file) of every stated finding."""
    rows = []
    for cases in CASES.values():
        before = 0
        for text, stated, *_ in cases:
            height = text.count("\n") + 1
            for one in stated.split():
                rule, line = one.replace("!", ":").split(":")
                rows.append((rule, int(line), before, height, int("!" in one)))
            before += height
    return rows


def expected_structure() -> list[tuple[str, int, int, int]]:
    """(language, lines, functions, decision points) of every case."""
    return [(language, text.count("\n") + 1, functions, points) for language, cases in CASES.items() for text, _, functions, points in cases]


#: Declarations: a text, the types that it declares as ``kind:line``, and how many variables, loops, conditions and tries.
DECLARATIONS: dict[str, list[tuple[str, str, int, int, int, int]]] = {
    "cpp": [
        ("namespace n@ {\nclass A@ { int x; };\nstruct B@ { }; }", "namespace:1 class:2 struct:3", 1, 0, 0, 0), ("enum class C@ { };\nclass\nD@ { };", "class:1", 0, 0, 0, 0), ("enum E@ { };", "enum:1", 0, 0, 0, 0),
        ("unsigned const int** p@ = 0;\nint const q@;\nMyType r@;\nint f@(int a);", "", 3, 0, 0, 0), ("for (int i@ = 0; i < 3; ++i) { if (a) { do { } while (b); } }\ntry { } catch (...) { }", "", 1, 3, 1, 1),
    ],
    "python": [
        ("class A@:\n    x = 1\n    y: int = 2", "class:1", 2, 0, 0, 0), ("f(a@=1)\na.b = 1\nc@ == 1\nd@ = e = 2\ng@: int", "", 3, 0, 0, 0),
        ("for i@ in b:\n    while c:\n        pass\nif d:\n    pass\nelif e:\n    pass\ntry:\n    pass\nexcept E:\n    pass", "", 0, 2, 2, 1), ("match(a@):\n    case 1:\n        z = [k for k in m]", "", 1, 1, 1, 0),
    ],
    "java": [
        ("interface A@ { }\nenum B@ { X }\nrecord C@(int a) { }\nclass\nD@ { }", "class:1 enum:2 struct:3", 1, 0, 0, 0), ("Object o@ = A.class;\nfinal int x@ = 1; var y@ = 2;\nint f@() { return 1; }\nint[] z@;", "", 2, 0, 0, 0),
        ("do { for (;;) { } } while (a@);\nswitch (b) { case 1: }\ntry { } finally { }", "", 0, 3, 1, 1),
    ],
    "typescript": [
        ("interface A@ { }\nmodule B@ { }\ndeclare module 'x@' { }\nnamespace C@ { }\nenum D@ { }", "class:1 namespace:2 namespace:4 enum:5", 0, 0, 0, 0), ("let a@ = 1; const b@: number = 2;\nvar f@(1); const { c } = d;", "", 2, 0, 0, 0),
        ("while (a@) { if (b) { } }\ntry { } catch { }", "", 0, 1, 1, 1),
    ],
    "javascript": [("class A@ { }\ninterface B@ { }", "class:1", 0, 0, 0, 0), ("let a@ = 1, b = 2; for (const c of d) { }", "", 2, 1, 0, 0), ("switch (a@) { }\ntry { } catch { }", "", 0, 0, 1, 1)],
    "csharp": [
        ("namespace N@ { class A@ { } }\nrecord struct B@(int a);\nrecord C@;\ninterface D@ { }\nenum E@ { }\nstruct F@ { }", "namespace:1 class:1 struct:2 struct:3 class:4 enum:5 struct:6", 1, 0, 0, 0),
        ("int x@ = 1; string y@; dynamic z@;\nint f@<T, U<V>>(T a);\nint g@ < 3;\nvoid h@<T>();", "", 4, 0, 0, 0), ("foreach (var a@ in b) { if (c) { } }\ntry { } catch { }", "", 1, 1, 1, 1),
    ],
}


def declaration_files(df: DataFrame, key: Column, times: Column) -> DataFrame:
    """``case_files`` of the declarations."""
    return _built(df, key, times, {language: [text for text, *_ in cases] for language, cases in DECLARATIONS.items()})


def expected_types() -> list[tuple[str, str, int, int, int]]:
    """(language, kind, line, lines before the case, lines of the case) of every stated type."""
    rows = []
    for language, cases in DECLARATIONS.items():
        before = 0
        for text, stated, *_ in cases:
            rows += [(language, kind, int(line), before, text.count("\n") + 1) for kind, line in (x.split(":") for x in stated.split())]
            before += text.count("\n") + 1
    return rows


def expected_declarations() -> list[tuple[str, int, int, int, int, int]]:
    """(language, types, variables, loops, conditions, tries) of every case."""
    return [(language, len(stated.split()), *counts) for language, cases in DECLARATIONS.items() for _, stated, *counts in cases]
