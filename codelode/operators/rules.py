"""The rule catalog and the findings of token tables: sequences, bracketed calls, comments, functions, files.

Every rule is a condition on neighbouring tokens (``lead`` and ``lag``), on the tokens between matched brackets, or on
structure, evaluated by Spark over all files at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import first_phrase, has_ticket
from ..sources.store import cut
from .findings import SECRET_FORMATS, secret_hits
from .joins import supersede
from .scopes import with_data_holder
from .reading import COUNTED, FIELD, MODIFIERS, NESTING, candidates
from .structure import CODE_COMMENTS, DECISIONS, ahead, by_rows, complexity_at, decides, ended_functions, functions_at, in_file, is_value, python_nesting, significant, structured

# Rules as id, severity, category, tier, confidence.
CATALOG = """
cpp-raw-new-delete info style medium medium
cpp-using-namespace-std-header warning style medium high
cpp-catch-all-ellipsis warning style medium high
cpp-magic-number-literal info style low low
cpp-long-function info style medium high
cpp-deep-nesting info style medium high
cpp-todo-without-ticket info style low high
cpp-complex-function warning style medium high
cpp-unreviewed-placeholder warning style medium medium
cpp-sec-system-call warning security high medium
cpp-sec-popen-call warning security high medium
cpp-sec-unsafe-buffer-fn warning security high medium
cpp-sec-weak-random info security medium low
cpp-sec-weak-hash info security medium low
cpp-sec-hardcoded-secret warning security critical medium
cpp-sec-secret-token warning security critical high
py-bare-except warning style medium high
py-wildcard-import warning style low high
py-mutable-default-arg warning style medium high
py-mutable-class-attribute warning style medium medium
py-long-function info style medium high
py-deep-nesting info style medium high
py-todo-without-ticket info style low high
py-complex-function warning style medium high
py-unreviewed-placeholder warning style medium medium
py-sec-eval-exec warning security high medium
py-sec-os-system warning security high medium
py-sec-subprocess-shell-true warning security high high
py-sec-pickle-load warning security high medium
py-sec-yaml-unsafe-load warning security high high
py-sec-weak-hash info security medium low
py-sec-hardcoded-secret warning security critical medium
py-sec-secret-token warning security critical high
java-empty-catch-block warning style high high
java-public-field info style low medium
java-printstacktrace info style low high
java-raw-type-usage info style low medium
java-long-method info style medium high
java-deep-nesting info style medium high
java-todo-without-ticket info style low high
java-complex-function warning style medium high
java-unreviewed-placeholder warning style medium medium
java-sec-runtime-exec warning security high medium
java-sec-weak-hash info security medium low
java-sec-weak-cipher warning security high high
java-sec-sql-string-concat warning security high medium
java-sec-trust-manager-review info security medium low
java-sec-hardcoded-secret warning security critical medium
java-sec-secret-token warning security critical high
ts-complex-function warning style medium high
ts-unreviewed-placeholder warning style medium medium
ts-empty-catch-block warning style high high
ts-explicit-any info style low medium
ts-var-usage info style low high
ts-loose-equality info style low medium
ts-long-method info style medium high
ts-deep-nesting info style medium high
ts-todo-without-ticket info style low high
ts-sec-secret-token warning security critical high
ts-sec-eval warning security high medium
ts-sec-child-process-exec warning security high medium
ts-sec-inner-html warning security high low
ts-sec-weak-hash info security medium low
ts-sec-disabled-tls warning security high high
ts-sec-sql-string-concat warning security high medium
ts-sec-hardcoded-secret warning security critical medium
js-empty-catch-block warning style high high
js-var-usage info style low high
js-loose-equality info style low medium
js-long-method info style medium high
js-deep-nesting info style medium high
js-todo-without-ticket info style low high
js-complex-function warning style medium high
js-unreviewed-placeholder warning style medium medium
js-sec-eval warning security high medium
js-sec-child-process-exec warning security high medium
js-sec-inner-html warning security high low
js-sec-weak-hash info security medium low
js-sec-disabled-tls warning security high high
js-sec-sql-string-concat warning security high medium
js-sec-hardcoded-secret warning security critical medium
js-sec-secret-token warning security critical high
csharp-empty-catch-block warning style high high
csharp-public-field info style low medium
csharp-console-writeline info style low high
csharp-async-void warning style medium high
csharp-long-method info style medium high
csharp-deep-nesting info style medium high
csharp-todo-without-ticket info style low high
csharp-complex-function warning style medium high
csharp-unreviewed-placeholder warning style medium medium
csharp-sec-process-start warning security medium medium
csharp-sec-weak-hash info security medium low
csharp-sec-weak-cipher warning security high high
csharp-sec-sql-string-concat warning security high medium
csharp-sec-cert-validation-disabled info security medium low
csharp-sec-hardcoded-secret warning security critical medium
csharp-sec-secret-token warning security critical high
"""
PREFIX = {"cpp": "cpp", "python": "py", "java": "java", "typescript": "ts", "javascript": "js", "csharp": "csharp"}
LANGUAGE = {v: k for k, v in PREFIX.items()}
METHOD = {"cpp": "function", "python": "function"}
# Phrases of unfinished or pasted comments.
PLACEHOLDER_PHRASES = [
    "as an ai language model", "as an ai assistant", "as a large language model", "i cannot assist with", "i can't assist with",
    "here's the updated", "here is the updated", "here's the complete", "here is the complete", "here's the full", "here is the full",
    "... rest of", "rest of the code remains", "rest of the code is unchanged", "rest of the file remains", "rest of the file is unchanged",
    "rest of the implementation remains", "rest of the function remains", "rest of the class remains", "rest of your code",
    "existing code remains", "existing code here", "... existing code", "existing code ...", "... unchanged", "unchanged ...", "(unchanged)",
    "other methods remain", "remaining code remains", "your code here", "your implementation here", "your logic here",
    "implementation goes here", "code goes here", "logic goes here", "add your code here", "add your logic here", "insert your code here",
    "placeholder implementation", "lorem ipsum",
]
# Parts of a secret's name, and ends of a name in Python that tell of no secret.
SECRET_NAMES = ["password", "passwd", "secret", "apikey", "api_key", "accesskey", "access_key", "authtoken"]
NO_SECRET_ENDS = ["field", "name", "label", "hint", "help", "text", "title", "url", "path", "file", "length", "policy"]
# Collections that take type arguments.
RAW_TYPES = ["List", "Map", "Set", "ArrayList", "HashMap", "HashSet", "LinkedList", "Collection", "Iterator"]
LONG_FUNCTION, DEEP_NESTING, COMPLEX_FUNCTION = 100, 6, 10

#: Neighbouring tokens by rule: alternatives with ``/``, ``~`` and a pattern for a string literal, ``!`` for "none of".
SEQUENCES = """
cpp-sec-system-call            system (
cpp-sec-popen-call             popen (
cpp-sec-unsafe-buffer-fn       strcpy/strcat/sprintf/gets (
cpp-sec-weak-random            rand/srand (
cpp-sec-weak-hash              MD5/SHA1/EVP_md5/EVP_sha1 (
py-bare-except                 except :
py-wildcard-import             import *
py-sec-os-system               os . system (
py-sec-pickle-load             pickle . load/loads (
java-printstacktrace           . printStackTrace (
java-sec-runtime-exec          Runtime . getRuntime ( ) . exec (
java-sec-runtime-exec          new ProcessBuilder (
java-sec-weak-hash             MessageDigest . getInstance ( ~MD5|SHA1|SHA-1
java-sec-weak-cipher           Cipher . getInstance ( ~DES
ts-explicit-any                :/as any
ts-var-usage                   var
ts-sec-eval                    eval (
ts-sec-inner-html              . innerHTML = !=
ts-sec-weak-hash               createHash ( ~(?i)md5|sha1
ts-sec-disabled-tls            rejectUnauthorized : false
js-var-usage                   var
js-sec-eval                    eval (
js-sec-inner-html              . innerHTML = !=
js-sec-weak-hash               createHash ( ~(?i)md5|sha1
js-sec-disabled-tls            rejectUnauthorized : false
csharp-console-writeline       Console . WriteLine/Write (
csharp-async-void              async void
csharp-sec-process-start       Process . Start (
csharp-sec-weak-hash           MD5/SHA1 . Create (
csharp-sec-weak-cipher         DES/TripleDES . Create (
"""
#: Calls by rule: the tokens before the bracket, whether what follows must be inside, and what it is.
CALLS = [
    ("py-sec-subprocess-shell-true", ["subprocess", ".", "call/run/Popen"], True, "shell_true"),
    ("py-sec-yaml-unsafe-load", ["yaml", ".", "load"], False, "loader"),
    ("py-sec-weak-hash", ["hashlib", ".", "md5/sha1"], False, "not_for_security"),
    ("java-sec-sql-string-concat", ["executeQuery/executeUpdate"], True, "plus"),
    ("ts-sec-sql-string-concat", ["query"], True, "plus"),
    ("js-sec-sql-string-concat", ["query"], True, "plus"),
    ("csharp-sec-sql-string-concat", ["new", "SqlCommand"], True, "plus"),
]


def catalog(spark: SparkSession, language: str | None = None, category: str | None = None) -> DataFrame:
    """(rule_id, language, severity, category, tier, confidence), of one language or category if asked for."""
    rows = [(x.split()[0], LANGUAGE[x.split("-")[0]], *x.split()[1:]) for x in CATALOG.strip().splitlines()]
    if language is not None and language not in PREFIX or category not in (None, "style", "security"):
        raise ValueError("unknown language or category")
    df = spark.createDataFrame(rows, "rule_id string, language string, severity string, category string, tier string, confidence string")
    df = df if language is None else df.filter(F.col("language") == language)
    return df if category is None else df.filter(F.col("category") == category)


def _prefixed(suffix: str) -> Column:
    """The rule id of a suffix in the row's language."""
    out = F.lit(None).cast("string")
    for language, prefix in PREFIX.items():
        out = F.when(F.col("language") == language, f"{prefix}-{suffix}").otherwise(out)
    return out


def _listed(words: list[str]) -> str:
    return ", ".join(f"r'{w}'" for w in words)


def _step(step: str, k: int) -> str:
    """A step of a sequence as a SQL condition on the token ``k`` places ahead."""
    value, kind = (f"v{k}", f"t{k}") if k else ("value", "type")
    literal = f"{kind} IN ('STRING', 'CHAR')"
    if step.startswith("~"):
        return f"({literal} AND {value} RLIKE r'{step[1:]}')"
    if step.startswith("!") and len(step) > 1:
        return f"({value} IS NULL OR {value} NOT IN ({_listed(step[1:].split('/'))}))"
    return f"(NOT {literal} AND {value} IN ({_listed(step.split('/') if step != '/' else ['/'])}))"


def sequence_hits() -> list[Column]:
    """Rules of neighbouring tokens, each the rule's id or null, on the columns of ``structured``."""
    hits = []
    for rule, *steps in (x.split() for x in SEQUENCES.strip().splitlines()):
        met = " AND ".join(_step(s, k) for k, s in enumerate(steps))
        hits.append(F.expr(f"CASE WHEN language = '{LANGUAGE[rule.split('-')[0]]}' AND {met} THEN '{rule}' END"))
    name = (F.col("type") == "IDENTIFIER") & F.lower("value").rlike("|".join(SECRET_NAMES)) & (F.col("v1") == "=") & (F.col("t2") == "STRING") & (F.length("v2") >= 8)
    name = name & ((F.col("language") != "python") | ~F.lower("value").rlike(f"_({'|'.join(NO_SECRET_ENDS)})$"))
    hits.append(F.when(name, _prefixed("sec-hardcoded-secret")))
    script = F.col("language").isin("javascript", "typescript")
    bare = F.col("vm1").isNull() | (F.col("vm1") != ".")
    hits.append(F.when((F.col("language") == "python") & F.col("value").isin("eval", "exec") & (F.col("v1") == "(") & bare, "py-sec-eval-exec"))
    shell = bare | F.col("vm2").isin("child_process", "childProcess", "cp", "proc", "shell")
    hits.append(F.when(script & (F.col("type") == "IDENTIFIER") & F.col("value").isin("exec", "execSync") & (F.col("v1") == "(") & shell, _prefixed("sec-child-process-exec")))
    equal = (is_value("value", "=") & (F.col("v1") == "=") & ~F.coalesce(F.col("v2") == "=", F.lit(False)) & ~F.coalesce(F.col("vm1").isin("=", "!"), F.lit(False))) | (
        is_value("value", "!") & (F.col("v1") == "=") & ~F.coalesce(F.col("v2") == "=", F.lit(False))
    )
    hits.append(F.when(script & equal, _prefixed("loose-equality")))
    fresh = (F.col("language") == "cpp") & (F.col("type") == "KEYWORD") & F.col("value").isin("new", "delete") & ~F.coalesce(F.col("vm1") == "operator", F.lit(False))
    hits.append(F.when(fresh & ~((F.col("value") == "delete") & F.coalesce(F.col("vm1") == "=", F.lit(False))), "cpp-raw-new-delete"))
    header = F.col("path").rlike(r"\.(h|hpp|hxx|h\+\+)$") & (F.col("value") == "using") & (F.col("v1") == "namespace") & (F.col("v2") == "std")
    hits.append(F.when((F.col("language") == "cpp") & header, "cpp-using-namespace-std-header"))
    raw = F.col("value").isin(*RAW_TYPES) & (F.col("type") == "IDENTIFIER")
    typed = ((F.col("vm1") == "new") & (F.col("v1") == "(")) | (F.col("t1") == "IDENTIFIER")
    hits.append(F.when((F.col("language") == "java") & raw & typed, "java-raw-type-usage"))
    return hits


#: Tokens at which a sequence's or a call's finding can begin, but for those before ``=``.
HITS = {w for x in SEQUENCES.strip().splitlines() for w in x.split()[1].split("/")} | {"eval", "exec", "execSync", "new", "delete", "using", "(", *RAW_TYPES}
#: Names that are assigned a secret.
SECRET_NAME = "|".join(SECRET_NAMES)
#: What the rules of sequences and calls read of a token's surroundings.
NEAR = ["idx", "type", "value", "line", *[f"v{k}" for k in range(1, 8)], *[f"t{k}" for k in range(1, 8)], "vm1", "vm2", "vm3", "tm1"]


def may_hit() -> Column:
    """A cheap condition that every token with a sequence's or a call's finding meets, so that few tokens try all rules."""
    return F.col("value").isin(sorted(HITS)) | F.coalesce(F.col("v1") == "=", F.lit(False))


ONCE = {"X509TrustManager", "ServerCertificateValidationCallback"}
ONCE_RULES = ["java-sec-trust-manager-review", "csharp-sec-cert-validation-disabled"]


def once_rules() -> list[Column]:
    """Rules with one finding a file, at every place."""
    at = lambda language, name: (F.col("language") == language) & (F.col("type") == "IDENTIFIER") & (F.col("value") == name)
    return [F.when(at("java", "X509TrustManager"), ONCE_RULES[0]), F.when(at("csharp", "ServerCertificateValidationCallback"), ONCE_RULES[1])]


def once_findings(places: DataFrame) -> DataFrame:
    """The first place of each file and rule (path, language, idx, line, rule_id)."""
    return places.groupBy("path", "language", "rule_id").agg(F.min(F.struct("idx", "line")).alias("m")).select("path", "language", "m.line", "rule_id")


def sequence_findings(files: DataFrame) -> DataFrame:
    """Rules of neighbouring tokens in files (path, language, content)."""
    some = candidates(files, (HITS - {"("}) | ONCE, NEAR, SECRET_NAME)
    found = some.filter(may_hit()).select("path", "language", "line", F.explode(F.array_compact(F.array(*sequence_hits()))).alias("rule_id"))
    once = some.select("path", "language", "idx", "line", F.explode(F.array_compact(F.array(*once_rules()))).alias("rule_id"))
    return found.unionByName(once_findings(once))


def call_counts() -> dict[str, Column]:
    """What the rules count in a call's brackets, on the columns of ``structured``."""
    follows = lambda *texts: reduce(lambda a, b: a & b, [F.col(f"v{k}" if k else "value") == t for k, t in enumerate(texts)])
    return {
        "plus": is_value("value", "+"), "loader": F.col("value").isin("Loader"), "shell_true": follows("shell", "=", "True"),
        "not_for_security": follows("usedforsecurity", "=", "False"), "mutable": is_value("value", "=") & F.col("v1").isin("[", "{"), "dots": is_value("value", "."),
    }


def call_hits() -> list[Column]:
    """Rules about what a call's brackets hold, each the rule's id or null."""
    call = is_value("value", "(") & F.col("close").isNotNull()
    hits = []
    for rule, names, inside, what in CALLS:
        own = call & (F.col("language") == LANGUAGE[rule.split("-")[0]])
        own = reduce(lambda a, b: a & b, [F.col(f"vm{len(names) - i}").isin(n.split("/")) for i, n in enumerate(names)], own)
        hits.append(F.when(own & ((F.col(f"_n_{what}") > 0) if inside else (F.col(f"_n_{what}") == 0)), rule))
    return hits


#: Events of the one pass that are no findings yet.
FUNCTION, POINT, LIMIT, MAGIC = "function", "decision point", "limit", "cpp-magic-number-literal"
SECRET, HEAD = "secret", "def"


def code_events(files: DataFrame, besides: bool = True) -> DataFrame:
    """``events_of`` the texts of files, read token by token in their tasks.

    With ``besides`` also comments' findings, public fields, the depth of a file's braces (``line``), Python's functions, mutable attributes
    and rules of one finding a file; ``note`` has a function's name and a string that holds a provider's token.
    """
    around = ["i1", "linem1", "scope", "comments", "comments1", "_quiet", "close", "_void1", "_dots1", *[f"_n_{name}" for name in COUNTED], "f_name", "f_start", "f_end"]
    called = {n for _, names, _, _ in CALLS for n in names[-1].split("/")} | {"if", "while"}
    some = candidates(files, (HITS - {"("}) | DECISIONS | ONCE | {"def"}, [*NEAR, *around], SECRET_NAME, numbers=True, remarks=besides, called=called)
    if not besides:
        return events_of(some)
    of = lambda *types: F.col("type").isin(*types)
    python = F.col("language") == "python"
    secret = of("STRING") & F.col("value").rlike("|".join(SECRET_FORMATS.values()))
    head = python & of("KEYWORD") & (F.col("value") == "def")
    more = [F.when(of(NESTING), NESTING), F.when(of(FIELD), _prefixed("public-field")), F.when(secret, SECRET), F.when(head, HEAD), F.when(python & (F.col("scope") == "class") & mutable_attribute(), "py-mutable-class-attribute"), *comment_rules(), *once_rules()]
    return events_of(some, more, of(NESTING, FIELD, "STRING", *CODE_COMMENTS) | F.col("value").isin("def", *ONCE), F.when(head, F.col("v1")).when(secret, F.col("value")))


def table_events(code: DataFrame) -> DataFrame:
    """``events_of`` a table of significant tokens, by windows."""
    wide = structured(code, call_counts())
    return events_of(wide.withColumns({"_void1": ahead("_void", 1), "comments1": ahead("comments", 1), "_dots1": ahead("_n_dots", 1)}))


def events_of(wide: DataFrame, besides: list[Column] | None = None, at: Column | None = None, note: Column | None = None) -> DataFrame:
    """(path, language, line, idx, close, f_name, f_start, f_end, note, rule_id): all that one pass over the code finds.

    Besides findings: functions, decision points, and the brackets of C++ conditions with the numbers that may be in them.
    """
    call = is_value("value", "(") & F.col("close").isNotNull()
    cpp = F.col("language") == "cpp"
    # A catch's bracket, or its block where it has none; a comment in either counts as content.
    caught = (F.col("type") == "KEYWORD") & (F.col("value") == "catch")
    nothing = caught & ((F.col("v1") == "(") & F.coalesce(F.col("_void1"), F.lit(False)) & (F.col("comments1") == F.col("comments")))
    bare = caught & F.col("language").isin("typescript", "javascript", "csharp") & (F.col("v1") == "{") & (F.col("v2") == "}") & F.coalesce("_quiet", F.lit(False))
    silent = F.when(cpp, F.when(nothing & (F.col("_dots1") > 0), "cpp-catch-all-ellipsis")).when(nothing | bare, _prefixed("empty-catch-block"))
    number = cpp & (F.col("type") == "NUMBER") & ~F.col("value").isin("0", "1")
    more = [
        F.when(F.col("f_end").isNotNull(), FUNCTION), F.when(decides(True), POINT),
        F.when(cpp & call & F.col("vm1").isin("if", "while"), LIMIT), F.when(number, MAGIC), silent,
    ]
    default = (F.col("language") == "python") & call & (F.col("vm2") == "def") & (F.col("_n_mutable") > 0)
    defaults = F.array_repeat(F.lit("py-mutable-default-arg"), F.when(default, F.col("_n_mutable").cast("int")).otherwise(0))
    found = F.concat(F.array_compact(F.array(*sequence_hits(), *call_hits(), *more, *(besides or []))), defaults)
    some = wide.filter(may_hit() | F.col("f_end").isNotNull() | decides(True) | number | caught | (F.lit(False) if at is None else at))
    note = F.lit(None).cast("string") if note is None else note
    return some.select("path", "language", "line", "idx", "close", "f_name", "f_start", "f_end", note.alias("note"), F.explode(found).alias("rule_id"))


def magic_numbers(events: DataFrame) -> DataFrame:
    """Numbers inside the brackets of a condition: the farthest end of a bracket before them lies behind them."""
    far = F.max(F.when(F.col("rule_id") == LIMIT, F.col("close"))).over(in_file().rowsBetween(W.unboundedPreceding, -1))
    return events.filter(F.col("rule_id").isin(LIMIT, MAGIC)).withColumn("_far", far).filter((F.col("rule_id") == MAGIC) & (F.col("_far") > F.col("idx")))


def public_fields(java: DataFrame, csharp: DataFrame) -> DataFrame:
    """Fields, of significant tokens of Java and of C#, after ``public``, on the line of their name: no constants, and in Java none of data holders.

    A declaration's head ends before its first ``; = ( {`` or comma outside angle and square brackets, however far that
    is; its name is the last name before that. Java's type declarations are none; what ends at ``(`` or ``{`` is none.
    """
    owned = with_data_holder(java)
    plain = csharp.withColumn("data_holder", F.lit(False))
    some = owned.select(*plain.columns).unionByName(plain)
    starts = (F.col("type") == "KEYWORD") & (F.col("value") == "public")
    some = some.withColumn("_starts", starts).withColumn("_no", F.sum(starts.cast("int")).over(in_file().rowsBetween(W.unboundedPreceding, 0))).filter("_no > 0")
    part = W.partitionBy("path", "_no").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    some = some.withColumn("_s", F.sum(F.when(is_value("value", "<", "["), 1).when(is_value("value", ">", "]"), -1).otherwise(0)).over(part))
    some = some.withColumn("_depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(part)))
    end = (F.col("_depth") == 0) & is_value("value", ";", "=", "(", "{", ",")
    some = some.withColumn("_end", end).withColumn("_past", F.sum(F.col("_end").cast("int")).over(part))
    held = some.filter((F.col("_past") == 0) | ((F.col("_past") == 1) & F.col("_end"))).groupBy("path", "language", "_no").agg(
        F.max(F.when(F.col("_starts"), F.col("data_holder"))).alias("_holder"), F.max(F.when(F.col("_end"), F.col("value"))).alias("_stop"),
        F.max(F.when((F.col("_depth") == 0) & (F.col("type") == "IDENTIFIER"), F.struct("idx", "line"))).alias("_name"),
        F.array_sort(F.collect_list(F.when(~F.col("_starts") & ~F.col("_end"), F.struct("idx", "type", "value")))).alias("_head"),
    )
    allowed = F.when(F.col("language") == "java", F.array(*map(F.lit, MODIFIERS["java"]))).otherwise(F.array(*map(F.lit, MODIFIERS["csharp"])))
    other = F.array_position(F.transform("_head", lambda x: (x["type"] == "KEYWORD") & F.array_contains(allowed, x["value"])), False)
    first = F.when(other == 0, F.size("_head") + 1).otherwise(other).cast("int")
    words = F.transform(F.slice("_head", 1, first - 1), lambda x: x["value"])
    held = held.withColumns({"_words": words, "_next": F.get("_head", first - 1)})
    has = lambda *w: reduce(lambda a, b: a & b, [F.array_contains("_words", x) for x in w])
    java = F.col("language") == "java"
    constant = F.when(java, has("static", "final")).otherwise(has("const") | has("static", "readonly"))
    declares = java & F.coalesce((F.col("_next.type") == "KEYWORD") & F.col("_next.value").isin("class", "interface", "enum"), F.lit(False))
    field = F.col("_name").isNotNull() & F.col("_stop").isin(";", "=", ",") & ~constant & ~declares & ~F.col("_holder")
    return held.filter(field).select("path", "language", F.col("_name.line").alias("line"), _prefixed("public-field").alias("rule_id"))


def mutable_attribute() -> Column:
    """Whether a name that begins a line is assigned a list or a dict, and is none of a constant."""
    return (F.col("type") == "IDENTIFIER") & (F.col("v1") == "=") & F.col("v2").isin("[", "{") & (F.col("line") != F.col("linem1")) & ~F.col("value").rlike("^_.*_$|^[A-Z0-9_]+$")


def comment_rules() -> list[Column]:
    """Marks without a ticket, and placeholder phrases; one finding a comment and rule."""
    comment = F.col("type").isin(*CODE_COMMENTS)
    return [
        F.when(comment & F.col("value").rlike("TODO|FIXME") & ~has_ticket(F.col("value")), _prefixed("todo-without-ticket")),
        F.when(comment & first_phrase(F.col("value"), PLACEHOLDER_PHRASES).isNotNull(), _prefixed("unreviewed-placeholder")),
    ]


def structure_findings(events: DataFrame, files: DataFrame) -> DataFrame:
    """Long and complex functions, deep files (line 0)."""
    language = by_rows(files.select("path", "language"))
    size = F.when(F.col("language").isin("cpp", "python"), _prefixed("long-function")).otherwise(_prefixed("long-method"))
    functions = functions_at(events.filter(F.col("rule_id") == FUNCTION)).unionByName(ended_functions(events.filter(F.col("rule_id") == HEAD).select("path", F.col("note").alias("name"), "line"), files))
    long = functions.filter(F.col("line_count") > LONG_FUNCTION).join(language, "path").select("path", "language", F.col("start_line").alias("line"), size.alias("rule_id"))
    braces = events.filter(F.col("rule_id") == NESTING).select("path", "language", F.col("line").alias("_depth"))
    depths = braces.unionByName(python_nesting(files).select("path", F.lit("python").alias("language"), F.col("_indents").alias("_depth")))
    deep = depths.filter(F.col("_depth") > DEEP_NESTING).select("path", "language", F.lit(0).alias("line"), _prefixed("deep-nesting").alias("rule_id"))
    hard = complexity_at(events.filter(F.col("rule_id") == POINT), functions).filter(F.col("complexity") > COMPLEX_FUNCTION)
    hard = hard.join(language, "path").select("path", "language", F.col("start_line").alias("line"), _prefixed("complex-function").alias("rule_id"))
    return long.unionByName(deep).unionByName(hard)


def findings(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, rule_id, language, severity, category, tier, confidence) of all 98 rules.

    A hard-coded secret by name gives way to a provider token on the same line. Equal findings are all kept. The texts are
    read once, in their tasks, and what that finds is a checkpoint; ``tokens``, the table of the same files, is not read.
    """
    # Few rows of a long plan: cut, so that the parts below are planned on them alone.
    events = cut(code_events(files))
    secrets = secret_hits(events.filter(F.col("rule_id") == SECRET), ["path", "language", "line"], F.col("note"))
    plain = ["path", "language", "line", "rule_id"]
    parts = [
        events.filter(~F.col("rule_id").isin(FUNCTION, POINT, LIMIT, MAGIC, NESTING, SECRET, HEAD, *ONCE_RULES)).select(*plain), magic_numbers(events).select(*plain),
        once_findings(events.filter(F.col("rule_id").isin(ONCE_RULES))).select(*plain), structure_findings(events, files),
        secrets.select("path", "language", "line", _prefixed("sec-secret-token").alias("rule_id")),
    ]
    found = reduce(DataFrame.unionByName, parts)
    found = supersede(found, F.col("rule_id").endswith("-sec-hardcoded-secret"), F.col("rule_id").endswith("-sec-secret-token"), ["path", "line"])
    # 98 rows of literals.
    return found.join(F.broadcast(catalog(tokens.sparkSession).drop("language")), "rule_id").select("path", "line", "rule_id", "language", "severity", "category", "tier", "confidence")
