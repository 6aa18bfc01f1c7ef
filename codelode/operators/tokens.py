"""Token tables of source text in six languages, by one regular expression a language, inside the JVM.

The expression of a language matches everything (blanks too), so a token's line follows from the newlines before it.
Tokens are rows: (path, language, idx, type, value, line). White space is dropped, newlines are kept.

Bytes outside ASCII are punctuation, a character each. A template literal is one token with all that its ``${ }`` hold, and
so is an interpolated string with its holes, the strings in them and doubled braces: braces nest ``NESTED`` deep, which the
expression spells out, level in level, and which costs only what a text uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Keywords by language.
KEYWORDS = {
    "cpp": """alignas alignof auto bool break case catch char char8_t char16_t char32_t class const constexpr consteval
        constinit const_cast continue decltype default delete do double dynamic_cast else enum explicit export extern
        false final float for friend goto if inline int long mutable namespace new noexcept nullptr operator override
        private protected public register reinterpret_cast requires return short signed sizeof static static_assert
        static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using
        virtual void volatile wchar_t while""",
    "python": """False None True and as assert async await break class continue def del elif else except finally for from
        global if import in is lambda nonlocal not or pass raise return try while with yield match case""",
    "java": """abstract assert boolean break byte case catch char class const continue default do double else enum extends
        final finally float for goto if implements import instanceof int interface long native new package private
        protected public return short static strictfp super switch synchronized this throw throws transient try void
        volatile while true false null var record yield sealed permits""",
    "javascript": """break case catch class const continue debugger default delete do else export extends finally for
        function if import in instanceof new return super switch this throw try typeof var void while with yield let
        async await of static get set true false null undefined""",
    "typescript": """break case catch class const continue debugger default delete do else export extends finally for
        function if import in instanceof new return super switch this throw try typeof var void while with yield let
        async await of static get set true false null undefined as from declare module namespace readonly abstract
        override satisfies keyof infer is out unique asserts type interface enum implements private protected public""",
    "csharp": """abstract as base bool break byte case catch char checked class const continue decimal default delegate do
        double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface
        internal is lock long namespace new null object operator out override params private protected public readonly
        ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong
        unchecked unsafe ushort using virtual void volatile while var dynamic async await yield partial get set value add
        remove nameof record init required global with when unmanaged notnull alias where""",
}
KEYWORDS = {k: v.split() for k, v in KEYWORDS.items()}
LANGUAGES = list(KEYWORDS)
#: Partitions of token tables for each of the session's shuffle partitions.
SPREAD = 8

_QUOTED = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+(?:"|\n|\z)'
_TICKED = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+(?:'|\n|\z)"
#: How deep braces nest inside a template literal or an interpolated string.
NESTED = 16


def _nested(plain: str, others: str) -> str:
    """What lies between a brace and its partner: runs of ``plain``, ``others`` and nested braces; the end of the text closes all."""
    body = rf"[^{{}}{plain}]*+(?:(?:{others})[^{{}}{plain}]*+)*+"
    for _ in range(NESTED):
        body = rf"[^{{}}{plain}]*+(?:(?:{others}|\{{{body}(?:\}}|\z))[^{{}}{plain}]*+)*+"
    return body


_TEMPLATE = r"`[^`\\$]*+(?:(?:\\[\s\S]|\$\{" + _nested(r"\\", r"\\[\s\S]") + r"(?:\}|\z)|\$)[^`\\$]*+)*+(?:`|\z)"
_HOLE = r"\{" + _nested('"', r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\z)') + r"(?:\}|\z)"
_FILLED = r'\$"[^"\\{}\n]*+(?:(?:\\[\s\S]|\{\{|\}\}?|' + _HOLE + r')[^"\\{}\n]*+)*+(?:"|(?=\n)|\z)'
_FILLED_VERBATIM = r'(?:@\$|\$@)"[^"{}]*+(?:(?:""|\{\{|\}\}?|' + _HOLE + r')[^"{}]*+)*+(?:"|\z)'
_LINE, _BLOCK = r"//[^\n]*+", r"/\*[\s\S]*?(?:\*/|\z)"
_NUMBER = r"[0-9](?:[0-9A-Za-z_.]|(?<=[eE])[+-])*+"
_REST = r"\n|[^\S\n]++|[\s\S]"
_TRIPLE = r'(?:[rRbBuUfF]{0,2})(?:"""[\s\S]*?(?:"""|\z)|' + r"'''[\s\S]*?(?:'''|\z))"
PATTERNS = {
    "cpp": "|".join([r"#[^\n]*+", _LINE, _BLOCK, _QUOTED, _TICKED, _NUMBER, r"[A-Za-z_][A-Za-z0-9_]*+", _REST]),
    "python": "|".join([r"#[^\n]*+", _TRIPLE, f"[rRbBuUfF]{{0,2}}(?:{_QUOTED}|{_TICKED})", _NUMBER, r"[A-Za-z_][A-Za-z0-9_]*+", r"\*\*|//|[=!<>+\-*/%&|^:]=|->|<<|>>", _REST]),
    "java": "|".join([_LINE, _BLOCK, r'"""[\s\S]*?(?:"""|\z)', _QUOTED, _TICKED, _NUMBER, r"[A-Za-z_$][A-Za-z0-9_$]*+", _REST]),
    "javascript": "|".join([_LINE, _BLOCK, _TEMPLATE, _QUOTED, _TICKED, _NUMBER, r"[A-Za-z_$][A-Za-z0-9_$]*+", _REST]),
    "csharp": "|".join([r"(?m:^[^\S\n]*#[^\n]*+)", _LINE, _BLOCK, _FILLED_VERBATIM, r'@"[^"]*+(?:""[^"]*+)*+(?:"|\z)', _FILLED, _QUOTED, _TICKED, _NUMBER, r"@?[A-Za-z_][A-Za-z0-9_]*+", _REST]),
}
PATTERNS["typescript"] = PATTERNS["javascript"]


def token_type(language: Column, value: Column) -> Column:
    """The type of a token from its first characters; an expression is tried only where its first character can occur."""
    python = language == "python"
    first = F.substring(value, 1, 1)
    keyword = F.lit(False)
    for name, words in KEYWORDS.items():
        keyword = keyword | ((language == name) & value.isin(words))
    quoted = F.contains(value, F.lit('"')) & value.rlike(r'^(?:[rRbBuUfF]{0,2}|@\$?|\$@?)"')
    string = (first == "`") | quoted | (python & F.contains(value, F.lit("'")) & value.rlike(r"^[rRbBuUfF]{0,2}'")) | ((first == "'") & language.isin("javascript", "typescript"))
    letter = first.between("a", "z") | first.between("A", "Z") | first.isin("_", "$")
    return (
        F.when(value == "\n", "NEWLINE")
        .when(python & (first == "#"), "LINE_COMMENT")
        .when(F.contains(value, F.lit("#")) & (value.rlike(r"^\s*#.") | (value == "#")), "PREPROCESSOR")
        .when(~python & (first == "/") & value.startswith("//"), "LINE_COMMENT")
        .when((first == "/") & value.startswith("/*"), "BLOCK_COMMENT")
        .when(string, "STRING")
        .when(first == "'", "CHAR")
        .when(first.between("0", "9"), "NUMBER")
        .when(letter & keyword, "KEYWORD")
        .when(letter | ((first == "@") & value.rlike("^@[A-Za-z_$]")), "IDENTIFIER")
        .when(first.isin(*"-+*/%=<>!&|^~?:.@"), "OPERATOR")
        .otherwise("PUNCTUATION")
    )


def tokens(files: DataFrame) -> DataFrame:
    """(path, language, idx, type, value, line) of files (path, language, content) in a known language.

    Null contents are empty; rows that repeat a path count as one file each only if their paths differ. The rows come
    clustered by path, as every window over a file's tokens needs them: one shuffle, of the texts, serves them all.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    found = F.lit(None).cast("array<string>")
    for name, pattern in PATTERNS.items():
        found = F.when(F.col("language") == name, F.regexp_extract_all(content, F.lit(f"({pattern})"), F.lit(1))).otherwise(found)
    # Dealt by path before the texts are taken apart: one shuffle of texts, none of tokens. Tokens take many times their
    # text's memory, so there are ``SPREAD`` times the session's partitions, which are not put together: sorts stay in memory.
    parts = SPREAD * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = files.filter(F.col("language").isin(LANGUAGES)).select("path", "language", "content").repartition(parts, "path")
    rows = own.select("path", "language", F.posexplode(found).alias("idx", "value"))
    # Blanks hold no newline, so they go before the lines are counted.
    rows = rows.filter(~F.substring("value", 1, 1).isin(" ", "\t", "\r", "\f", "\v") | ~F.col("value").rlike(r"^[^\S\n]+$"))
    newlines = F.when(F.contains("value", F.lit("\n")), F.length(F.regexp_replace("value", r"[^\n]", ""))).otherwise(0)
    before = W.partitionBy("path").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("line", (F.coalesce(F.sum(newlines).over(before), F.lit(0)) + 1).cast("int"))
    return placed.select("path", "language", "idx", token_type(F.col("language"), F.col("value")).alias("type"), "value", "line")


def normalized(tokens_: DataFrame) -> DataFrame:
    """(language, path, codes): tokens as clones see them; names, strings, characters and numbers by kind, the rest by text."""
    some = tokens_.filter(~F.col("type").isin("NEWLINE", "LINE_COMMENT", "BLOCK_COMMENT"))
    code = F.when(F.col("type").isin("IDENTIFIER", "STRING", "CHAR", "NUMBER"), F.concat(F.lit("$"), "type")).otherwise(F.col("value"))
    return some.groupBy("language", "path").agg(F.array_sort(F.collect_list(F.struct("idx", code.alias("code")))).alias("_t")).select("language", "path", F.col("_t.code").alias("codes"))
