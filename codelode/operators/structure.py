"""Structure of token tables: matched brackets, functions, line classes, nesting and complexity, as windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tokens import tokens as lexed

CODE_COMMENTS = ("LINE_COMMENT", "BLOCK_COMMENT")


def by_rows(df: DataFrame) -> DataFrame:
    """For a join that is never a broadcast: the planner takes files for as small as the table that their texts are made of."""
    return df.hint("shuffle_merge")


def in_file() -> W:
    """A file's tokens in order."""
    return W.partitionBy("path").orderBy("idx")


def significant(tokens: DataFrame) -> DataFrame:
    """Tokens without comments and newlines, with ``comments``, how many comments of the file come before."""
    counted = tokens.filter("type <> 'NEWLINE'").withColumn("comments", F.sum(F.col("type").isin(*CODE_COMMENTS).cast("int")).over(in_file().rowsBetween(W.unboundedPreceding, 0)))
    return counted.filter(~F.col("type").isin(*CODE_COMMENTS))


def is_value(value: Column | str, *texts: str) -> Column:
    """Whether the token is one of ``texts``, not a literal that reads like it."""
    return ~F.col("type").isin("STRING", "CHAR") & F.col("value").isin(*texts)


def ahead(column: str, k: int) -> Column:
    return F.lead(column, k).over(in_file()) if k > 0 else F.lag(column, -k).over(in_file()) if k < 0 else F.col(column)


def bracket_pairs(tokens: DataFrame, open_: str, close: str, counted: dict[str, Column] | None = None) -> DataFrame:
    """(path, open, close, open_line, close_line, next_value, next_idx, counted...) of matched brackets.

    A bracket's level is the running depth, floored at 0; its partner is the next bracket of that level. ``counted`` are
    conditions on tokens: the result has how many tokens between the two meet each. No stack and no loop, two windows.
    """
    counted = counted or {}
    running = in_file().rowsBetween(W.unboundedPreceding, 0)
    step = F.when(is_value("value", open_), 1).when(is_value("value", close), -1).otherwise(0)
    marked = tokens.withColumn("_s", F.sum(step).over(running)).withColumns(
        {"next_value": ahead("value", 1), "next_idx": ahead("idx", 1), **{f"_c_{n}": F.sum(c.cast("int")).over(running) for n, c in counted.items()}}
    )
    floor = F.least(F.lit(0), F.min("_s").over(running))
    leveled = marked.withColumn("_depth", F.col("_s") - floor).filter(is_value("value", open_, close))
    opening = F.col("value") == open_
    leveled = leveled.withColumn("_level", F.when(opening, F.col("_depth")).otherwise(F.col("_depth") + 1))
    partner = W.partitionBy("path", "_level").orderBy("idx")
    out = leveled.withColumns({f"_p_{c}": F.lead(c).over(partner) for c in ["value", "idx", "line", "next_value", "next_idx", *[f"_c_{n}" for n in counted]]})
    return out.filter(opening & (F.col("_p_value") == close)).select(
        "path", F.col("idx").alias("open"), F.col("_p_idx").alias("close"), F.col("line").alias("open_line"), F.col("_p_line").alias("close_line"),
        F.col("_p_next_value").alias("next_value"), F.col("_p_next_idx").alias("next_idx"), *[(F.col(f"_p__c_{n}") - F.col(f"_c_{n}")).alias(n) for n in counted],
    )


#: A name before these is no function's.
NOT_BEFORE = ("new", "class", "interface", "enum", "record")


#: What may come between a function's parameters and its brace, by language: the first word of it, and what ends it.
SPECIFIERS = {
    "cpp": (["const", "noexcept", "override", "final", "volatile", "&", "-", "try"], ["{", ";", "}", "="]),
    "java": (["throws"], ["{", ";", "}", "=", "("]),
    "typescript": ([":"], ["{", ";", "}", "="]),
    "csharp": (["where"], ["{", ";", "}", "="]),
}


def next_stop(tokens: DataFrame, column: str, condition: Column, what: Column) -> DataFrame:
    """With ``column``: ``what`` of the next token in the file that meets the condition, however far.

    The window runs backwards, so that no row reads the rest of its file again.
    """
    backwards = W.partitionBy("path").orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, -1)
    return tokens.withColumn(column, F.last(F.when(condition, what), True).over(backwards))


def structured(code: DataFrame, counted: dict[str, Column] | None = None) -> DataFrame:
    """Significant tokens with their neighbours, their brackets' partners and the functions that start at them.

    ``v1`` ... ``v7``, ``t1`` ... are the next values and types, ``vm1`` ... ``vm3``, ``tm1`` those before, ``i1`` the
    next index. On an opening bracket that is closed, ``close`` and ``close_line`` say where, ``_void`` whether an empty block
    follows, and ``_n_<name>`` how many tokens between the two meet each condition of ``counted`` (on these columns). ``f_name``, ``f_start`` and ``f_end``
    are not null where a function of a brace language has its parenthesis or arrow. Windows only, all by path: a table
    that is clustered by path is sorted, never shuffled, and nothing is joined.

    A bracket's level is the running depth, floored at 0; its partner is the next bracket of that level.
    """
    counted = counted or {}
    running, level = in_file().rowsBetween(W.unboundedPreceding, 0), W.partitionBy("path", "_kind", "_level").orderBy("idx")
    backwards = W.partitionBy("path").orderBy(F.desc("idx"))
    script, brace = F.col("language").isin("javascript", "typescript"), F.col("language") != "python"
    steps = {k: F.when(is_value("value", o), 1).when(is_value("value", c), -1).otherwise(0) for k, o, c in (("p", "(", ")"), ("b", "{", "}"))}
    # No comment lies between a token and the second one after it.
    quiet = ahead("comments", 2) == F.col("comments")
    near = {"_quiet": quiet, "v1": ahead("value", 1), "v2": ahead("value", 2), "t1": ahead("type", 1), "vm1": ahead("value", -1), "vm2": ahead("value", -2), "tm1": ahead("type", -1)}
    far = {f"v{k}": ahead("value", k) for k in range(3, 8)} | {f"t{k}": ahead("type", k) for k in range(2, 8)} | {"vm3": ahead("value", -3)}
    wide = code.withColumns(near | {"i1": ahead("idx", 1), "_linem1": ahead("line", -1)} | {f"_s{k}": F.sum(s).over(running) for k, s in steps.items()})
    name = F.when(is_value("value", ";", "{", "}"), "<anonymous>").when((F.col("type") == "IDENTIFIER") & (F.col("v1") == "=") & (F.col("v2") != ">"), F.col("value"))
    wide = wide.withColumns(
        {f"_d{k}": F.col(f"_s{k}") - F.least(F.lit(0), F.min(f"_s{k}").over(running)) for k in steps}
        | {f"_c_{n}": F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(running) for n, c in counted.items()}
        | {"_name": F.coalesce(F.last(name, True).over(running), F.lit("<anonymous>"))}
    )
    opening = is_value("value", "(", "{")
    kind = F.when(is_value("value", "(", ")"), "p").when(is_value("value", "{", "}"), "b")
    depth = F.when(F.col("_kind") == "p", F.col("_dp")).when(F.col("_kind") == "b", F.col("_db"))
    wide = wide.withColumn("_kind", kind).withColumn("_level", F.when(opening, depth).otherwise(depth + 1))
    partner = F.lead(F.struct("value", "idx", "line", "v1", "v2", "_quiet", *[f"_c_{n}" for n in counted])).over(level)
    wide = wide.withColumn("_partner", F.when(opening, partner)).withColumn("_closed", F.col("_partner.value").isin(")", "}"))
    wide = wide.withColumns(
        {"close": F.when(F.col("_closed"), F.col("_partner.idx")), "close_line": F.when(F.col("_closed"), F.col("_partner.line"))}
        # Behind the closing bracket: two braces and nothing between, not even a comment.
        | {"_void": F.col("_closed") & (F.col("_partner.v1") == "{") & (F.col("_partner.v2") == "}") & F.col("_partner._quiet")}
        | {f"_n_{n}": F.when(F.col("_closed"), F.col(f"_partner._c_{n}") - F.col(f"_c_{n}")) for n in counted}
    )
    stops, starts = F.lit(False), F.lit(False)
    for language, (first, ends) in SPECIFIERS.items():
        stops = stops | ((F.col("language") == language) & is_value("value", *ends))
        starts = starts | ((F.col("language") == language) & ~F.col("t1").isin("STRING", "CHAR") & F.col("v1").isin(*first))
    # Read backwards, so that no row reads the rest of its file again.
    stop = F.last(F.when(stops, F.struct("value", "close_line")), True).over(backwards.rowsBetween(W.unboundedPreceding, -1))
    wide = wide.withColumns({"_stop": stop, "_line1": F.lag("close_line", 1).over(backwards), "_line2": F.lag("close_line", 2).over(backwards)})
    body = F.when(F.col("v1") == "{", F.col("_line1")).when(starts & (F.col("_stop.value") == "{"), F.col("_stop.close_line"))
    wide = wide.withColumn("_body", F.lead(F.when(is_value("value", ")"), body)).over(level))
    named = (F.col("tm1") == "IDENTIFIER") & (F.col("vm2").isNull() | ~F.col("vm2").isin(*NOT_BEFORE))
    nameless = script & (F.col("tm1") == "KEYWORD") & (F.col("vm1") == "function")
    call = brace & is_value("value", "(") & F.col("_closed") & (named | nameless)
    arrow = script & is_value("value", "=") & (F.col("v1") == ">") & (F.col("v2") == "{")
    end = F.when(call, F.col("_body")).when(arrow, F.col("_line2"))
    # The rules' farther neighbours come last, so that the sorts between carry narrow rows.
    return wide.withColumn("f_end", end).withColumns(far).withColumns({
        "f_name": F.when(F.col("f_end").isNotNull(), F.when(call & named, F.col("vm1")).otherwise(F.col("_name"))),
        "f_start": F.when(F.col("f_end").isNotNull(), F.when(call, F.col("_linem1")).otherwise(F.col("line"))),
    })


def functions_at(wide: DataFrame) -> DataFrame:
    """(path, name, start_line, end_line, line_count) of a structured table's functions."""
    return wide.filter("f_end is not null").select("path", F.col("f_name").alias("name"), F.col("f_start").alias("start_line"), F.col("f_end").alias("end_line"), (F.col("f_end") - F.col("f_start") + 1).alias("line_count"))


def brace_functions(tokens: DataFrame) -> DataFrame:
    """(path, name, start_line, end_line, line_count) of ``name ( ... ) {`` ... ``}`` in brace languages.

    Specifiers, thrown types, return types and constraints between the parenthesis and the brace are passed over
    (``SPECIFIERS``); in scripts also ``function (...) {`` and ``=> {``, under the name that they are assigned to or
    ``<anonymous>``. Nested functions are found each.
    """
    return functions_at(structured(significant(tokens.filter("language <> 'python'"))))


def code_lines(files: DataFrame) -> DataFrame:
    """(path, line, indent) of the Python lines that are neither blank nor a comment."""
    lines = files.filter("language = 'python'").select("path", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n", -1)).alias("_at", "_text")).filter(F.trim("_text").rlike("^[^#]"))
    return lines.select("path", (F.col("_at") + 1).alias("line"), F.length(F.regexp_extract("_text", r"^([ \t]*)", 1)).alias("indent"))


def block_ends(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """(path, line, end_line) of the blocks that begin at ``heads`` (path, line): up to the next line not indented more.

    The next smaller value, by levels: a file's levels are the indents of its heads, and a line takes part in those that
    it would end. Within a level the next row is the end of the one before, so each line is read once a level.
    """
    file = W.partitionBy("path")
    placed = lines.withColumns({"_prev": F.lag("line").over(file.orderBy("line")), "_last": F.max("line").over(file)})
    levels = lines.join(by_rows(heads.select("path", "line").distinct()), ["path", "line"]).groupBy("path").agg(F.collect_set("indent").alias("_levels"))
    leveled = placed.join(by_rows(levels), "path").withColumn("_level", F.explode(F.filter("_levels", lambda x: x >= F.col("indent"))))
    end = F.coalesce(F.lead("_prev").over(W.partitionBy("path", "_level").orderBy("line")), F.col("_last"))
    return leveled.withColumn("end_line", end).filter("_level = indent").select("path", "line", "end_line")


def python_functions(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, start_line, end_line, line_count): a def ends before the next code line that is not indented more."""
    code = significant(tokens.filter("language = 'python'"))
    defs = code.withColumn("name", ahead("value", 1)).filter((F.col("type") == "KEYWORD") & (F.col("value") == "def")).select("path", "name", "line")
    return ended_functions(defs, files)


def ended_functions(defs: DataFrame, files: DataFrame) -> DataFrame:
    """``python_functions`` of given heads (path, name, line)."""
    ended = defs.join(by_rows(block_ends(code_lines(files), defs)), ["path", "line"])
    return ended.select("path", "name", F.col("line").alias("start_line"), "end_line", (F.col("end_line") - F.col("line") + 1).alias("line_count"))


def functions_of(tokens: DataFrame, files: DataFrame) -> DataFrame:
    return brace_functions(tokens).unionByName(python_functions(tokens, files))


# Tokens that ``decides`` looks at, and types that ``?`` makes nullable.
DECISIONS = {"if", "for", "while", "case", "catch", "switch", "do", "foreach", "when", "elif", "except", "and", "or", "match", "&", "|", "?"}
VALUE_TYPES = ["int", "uint", "long", "ulong", "short", "ushort", "byte", "sbyte", "char", "bool", "decimal", "double", "float"]


def decides(in_functions: bool = False) -> Column:
    """Whether a token of a structured table adds a path: see ``decision_points``."""
    brace, language = F.col("language") != "python", F.col("language")
    words = (F.col("type") == "KEYWORD") & (
        F.col("value").isin("if", "for", "while") | (brace & F.col("value").isin("case", "catch", "switch", "do")) | ((language == "csharp") & F.col("value").isin("foreach", "when"))
        | (~brace & F.col("value").isin("elif", "except", "and", "or")) | (~brace & F.col("value").isin("match", "case") & F.lit(not in_functions))
    )
    twin = brace & is_value("value", "&", "|") & (F.col("v1") == F.col("value")) & (F.col("i1") == F.col("idx") + 1)
    follows, comes = F.coalesce("v1", F.lit("")), F.coalesce("vm1", F.lit(""))
    plain = (
        F.when(language.isin("java", "cpp"), True).when(comes == "?", False).when(follows == "?", True).when(follows == ".", False)
        .when(language == "typescript", follows != ":")
        .when(language == "csharp", (follows != "[") & ~((F.col("tm1") == "KEYWORD") & comes.isin(VALUE_TYPES))).otherwise(True)
    )
    return F.coalesce(words | twin | (brace & is_value("value", "?") & plain), F.lit(False))


def decision_points(tokens: DataFrame, in_functions: bool = False) -> DataFrame:
    """Tokens that add a path: loops, conditions, cases, catches, ternaries, ``??`` and the two-sided logical operators.

    ``?.``, optional parameters and nullable types add none. Python's ``match`` and ``case`` count for a file, not
    ``in_functions``.
    """
    code = significant(tokens)
    near = code.withColumns({"v1": ahead("value", 1), "i1": ahead("idx", 1), "vm1": ahead("value", -1), "tm1": ahead("type", -1)})
    return near.filter(decides(in_functions)).select(*code.columns)


def nesting(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """(path, max_nesting): braces by a floored running sum, Python by the indents of its code lines."""
    running = in_file().rowsBetween(W.unboundedPreceding, 0)
    braces = tokens.filter("language <> 'python'").filter(is_value("value", "{", "}"))
    brace = braces.withColumn("_s", F.sum(F.when(F.col("value") == "{", 1).otherwise(-1)).over(running))
    brace = brace.withColumn("_d", F.col("_s") - F.least(F.lit(0), F.min("_s").over(running))).groupBy("path").agg(F.max("_d").cast("int").alias("max_nesting"))
    return brace.unionByName(python_nesting(files).withColumnRenamed("_indents", "max_nesting"))


def python_nesting(files: DataFrame) -> DataFrame:
    """(path, _indents): the most indents that are open at once, by a fold over the indents of a file's code lines."""
    lines = F.filter(F.split(F.coalesce("content", F.lit("")), "\n", -1), lambda x: F.trim(x).rlike("^[^#]"))
    indents = F.transform(lines, lambda x: F.length(F.regexp_extract(x, r"^([ \t]*)", 1)))
    start = F.struct(F.array().cast("array<int>").alias("stack"), F.lit(0).alias("deepest"))

    def push(s: Column, indent: Column) -> Column:
        stack = F.concat(F.filter(s["stack"], lambda x: x < indent), F.when(indent > 0, F.array(indent)).otherwise(F.array().cast("array<int>")))
        return F.struct(stack.alias("stack"), F.greatest(s["deepest"], F.size(stack)).alias("deepest"))

    return files.filter("language = 'python'").select("path", F.aggregate(indents, start, push, lambda s: s["deepest"]).alias("_indents"))


def raw_counts(tokens: DataFrame) -> DataFrame:
    """(path, code_lines, comment_lines, todos, imports, depth): one pass over all tokens in order.

    A token covers the lines that its text has; code wins over comment. Lines never go back, so a token adds those of its
    lines that lie behind the farthest end before it. ``depth`` is the deepest brace, null in Python.
    """
    past, running = in_file().rowsBetween(W.unboundedPreceding, -1), in_file().rowsBetween(W.unboundedPreceding, 0)
    comment, shown = F.col("type").isin(*CODE_COMMENTS), F.col("type") != "NEWLINE"
    height = F.when(F.col("type").isin("STRING", "BLOCK_COMMENT") & F.contains("value", F.lit("\n")), F.length(F.regexp_replace("value", r"[^\n]", ""))).otherwise(0)
    step = F.when(is_value("value", "{"), 1).when(is_value("value", "}"), -1).otherwise(0)
    wide = tokens.withColumns({"_end": F.when(shown, F.col("line") + height), "_code": F.when(shown & ~comment, F.col("line") + height)}).withColumns({
        "_past": F.max("_end").over(past), "_past_code": F.max("_code").over(past), "_s": F.sum(step).over(running), "_before": F.lag("type", 1, "NEWLINE").over(in_file()), "_next": ahead("value", 1),
    })
    wide = wide.withColumn("_depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(running)))
    new = lambda end, before: F.greatest(F.col(end) - F.greatest(F.coalesce(before, F.lit(0)), F.col("line") - 1), F.lit(0))
    marks = F.when(comment, F.size(F.regexp_extract_all("value", F.lit("(TODO|FIXME)"), F.lit(1)))).otherwise(0)
    return wide.groupBy("path").agg(
        F.coalesce(F.sum(new("_code", "_past_code")), F.lit(0)).alias("code_lines"), (F.coalesce(F.sum(new("_end", "_past")), F.lit(0)) - F.coalesce(F.sum(new("_code", "_past_code")), F.lit(0))).alias("comment_lines"),
        F.sum(marks).alias("todos"), F.count_if(starts_import()).alias("imports"), F.max(F.when(F.col("language") != "python", F.col("_depth"))).cast("int").alias("depth"),
    )


def line_classes(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """(path, language, total_lines, code_lines, comment_lines, blank_lines): code wins over comment, comment over blank."""
    return with_lines(raw_counts(tokens).select("path", "code_lines", "comment_lines"), files)


def with_lines(counts: DataFrame, files: DataFrame) -> DataFrame:
    """Every file with its counts (path, code_lines, comment_lines, ...) and its total and blank lines."""
    content = F.coalesce("content", F.lit(""))
    total = files.select("path", "language", (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).alias("total_lines"))
    return total.join(by_rows(counts), "path", "left").fillna(0, ["code_lines", "comment_lines"]).withColumn("blank_lines", F.col("total_lines") - F.col("code_lines") - F.col("comment_lines"))


def file_metrics(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """One row a file: lines by class, functions, complexity (from 1), nesting, imports, TODO marks.

    One pass over the token table, one that reads the texts for decisions and functions (``reading``), and the indents of
    Python's lines. Nothing is persisted here, and a caller may persist.
    """
    size = F.col("f_end") - F.col("f_start") + 1
    from .reading import decision_candidates

    wide = decision_candidates(files).groupBy("path").agg(
        F.count_if(decides()).alias("decisions"), F.count("f_end").alias("functions"), F.sum(size).alias("function_lines"), F.max(F.when(size.isNotNull(), F.struct(size.alias("size"), (-F.col("f_start")).alias("at"), F.col("f_name").alias("name")))).alias("_longest"),
    )
    # A filter by language does not pass the windows of a token table: Python's files alone are lexed for their blocks.
    own = tokens if tokens.is_cached else lexed(files.filter("language = 'python'"))
    python = python_functions(own, files).groupBy("path").agg(F.count("*").alias("_f"), F.sum("line_count").alias("_l"), F.max(F.struct(F.col("line_count").alias("size"), (-F.col("start_line")).alias("at"), "name")).alias("_m"))
    out = with_lines(raw_counts(tokens), files)
    for part in (wide, python, python_nesting(files)):
        out = out.join(by_rows(part), "path", "left")
    out = out.withColumn("max_nesting", F.coalesce("_indents", "depth", F.lit(0))).drop("_indents", "depth")
    out = out.fillna(0, ["todos", "decisions", "imports", "functions", "function_lines", "_f", "_l"])
    both = {"functions": F.col("functions") + F.col("_f"), "function_lines": F.col("function_lines") + F.col("_l"), "_longest": F.coalesce("_longest", "_m")}
    out = out.withColumns(both).withColumns({"longest_function": F.coalesce("_longest.size", F.lit(0)), "longest_name": F.col("_longest.name")}).drop("_f", "_l", "_m", "_longest")
    return out.withColumn("complexity", F.col("decisions") + 1).withColumn("avg_function", F.coalesce(F.try_divide("function_lines", "functions"), F.lit(0.0)))


def starts_import() -> Column:
    """Whether a token, with ``_before`` (the type before it) and ``_next`` (the value after it), begins an import."""
    language, keyword = F.col("language"), F.col("type") == "KEYWORD"
    named = (
        ((language == "python") & F.col("value").isin("import", "from") & (F.col("_before") == "NEWLINE"))
        | ((language == "java") & (F.col("value") == "import")) | ((language == "csharp") & keyword & (F.col("value") == "using") & F.coalesce(F.col("_next") != "(", F.lit(True)))
    )
    at_once = ((language == "cpp") & F.col("value").startswith("#include")) | (language.isin("javascript", "typescript") & keyword & (F.col("value") == "import"))
    return named | at_once


def import_targets(tokens: DataFrame) -> DataFrame:
    """(path, target): what each import, include or using names; empty for an include in angle brackets.

    A script's import waits for the next string or semicolon, however far; other names are the tokens between a start and
    the first end after it. Both are looked up among the few tokens that can matter.
    """
    code = tokens.filter(~F.col("type").isin(*CODE_COMMENTS))
    language = F.col("language")
    cpp = code.filter((language == "cpp") & F.col("value").startswith("#include")).select("path", F.regexp_extract("value", r'^#include\s*"([^"]*)"', 1).alias("target"))
    script = code.filter(language.isin("javascript", "typescript") & (((F.col("type") == "KEYWORD") & (F.col("value") == "import")) | (F.col("type") == "STRING") | is_value("value", ";")))
    module = F.when(F.col("type") == "STRING", F.regexp_replace("value", "^['\"`]|['\"`]$", "")).otherwise(F.lit(""))
    waits = (F.col("type") == "KEYWORD") & (F.col("value") == "import")
    script = next_stop(script, "_module", ~waits, module).filter(waits).select("path", F.coalesce("_module", F.lit("")).alias("target"))
    running = in_file().rowsBetween(W.unboundedPreceding, 0)
    some = code.filter(language.isin("python", "java", "csharp")).withColumns({"_before": F.lag("type", 1, "NEWLINE").over(in_file()), "_next": ahead("value", 1)})
    starts = F.col("_starts")
    ends = ((language == "python") & ((F.col("type") == "NEWLINE") | F.col("value").isin("import", "as", ","))) | (language.isin("java", "csharp") & (F.col("value") == ";"))
    some = some.withColumn("_starts", starts_import())
    some = some.withColumns({"_no": F.sum(starts.cast("int")).over(running), "_open": F.last(F.when(starts | ends, starts), True).over(running)}).filter("_open")
    named = some.groupBy("path", "language", "_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~starts, F.struct("idx", "value")))), lambda x: x["value"]), "").alias("_name")
    )
    named = named.select("path", F.when(language == "java", F.regexp_replace("_name", "^static", "")).when(language == "csharp", F.regexp_replace("_name", "^static|^.*=", "")).otherwise(F.col("_name")).alias("target"))
    return cpp.unionByName(script).unionByName(named)


def function_complexity(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, start_line, complexity): decision points count for the innermost function that holds their line."""
    wide = structured(significant(tokens))
    return complexity_at(wide.filter(decides(True)), functions_at(wide).unionByName(python_functions(tokens, files)))


def complexity_at(points: DataFrame, functions: DataFrame) -> DataFrame:
    """``function_complexity`` of given decision points (path, idx, line) and functions."""
    from .joins import innermost_interval

    spans = functions.withColumn("span", F.struct("start_line", "end_line", "name"))
    points = points.select("path", F.col("idx").alias("point"), F.col("line").alias("at"))
    held = innermost_interval(points, spans.select("path", "span", F.col("start_line").alias("start"), F.col("end_line").alias("end")), ["path"])
    counts = held.filter("span is not null").groupBy("path", "span").agg(F.count("*").alias("_n"))
    return spans.join(by_rows(counts), ["path", "span"], "left").select("path", "name", "start_line", (F.coalesce("_n", F.lit(0)) + 1).alias("complexity"))
