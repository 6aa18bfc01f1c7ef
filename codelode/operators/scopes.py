"""Types, variables and control statements of token tables, and which type body a token stands in: windows by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .structure import ahead, in_file, is_value

# Keywords that declare a type or a namespace, by language, and what each declares.
TYPE_KEYWORDS = {
    "cpp": {"class": "class", "struct": "struct", "enum": "enum", "namespace": "namespace"},
    "python": {"class": "class"},
    "java": {"class": "class", "interface": "class", "enum": "enum", "record": "struct"},
    "javascript": {"class": "class"},
    "typescript": {"class": "class", "interface": "class", "enum": "enum", "namespace": "namespace", "module": "namespace"},
    "csharp": {"class": "class", "interface": "class", "enum": "enum", "namespace": "namespace", "struct": "struct", "record": "struct"},
}
# Words before a variable's name, by language.
VARIABLE_WORDS = {
    "cpp": ["int", "long", "short", "char", "bool", "float", "double", "unsigned", "signed", "auto", "wchar_t", "size_t", "void"],
    "java": ["byte", "short", "int", "long", "float", "double", "boolean", "char", "var"],
    "javascript": ["let", "const", "var"],
    "typescript": ["let", "const", "var"],
    "csharp": ["byte", "sbyte", "short", "ushort", "int", "uint", "long", "ulong", "char", "float", "double", "decimal", "bool", "string", "object", "var", "dynamic"],
}
# Words of loops and of conditions; Python's, then the others'.
LOOPS, CONDITIONS = ["for", "while"], ["if", "elif", "match"]
BRACE_LOOPS, BRACE_CONDITIONS = ["for", "while", "do"], ["if", "switch"]


def _neighbours(tokens: DataFrame) -> DataFrame:
    """Tokens with the one before and the one after, newlines and comments included."""
    return tokens.withColumns({"v1": ahead("value", 1), "t1": ahead("type", 1), "vm1": ahead("value", -1), "tm1": ahead("type", -1)})


def type_declarations(tokens: DataFrame) -> DataFrame:
    """(path, language, name, kind, line) of types and namespaces: a keyword and the name right after it.

    Interfaces are classes, records are structs, modules are namespaces. C#'s ``record class`` and ``record struct``
    declare once, at ``record``.
    """
    record = (F.col("language") == "csharp") & (F.col("value") == "record") & (F.col("t1") == "KEYWORD") & F.col("v1").isin("class", "struct")
    tail = (F.col("language") == "csharp") & F.col("value").isin("class", "struct") & (F.col("tm1") == "KEYWORD") & (F.col("vm1") == "record")
    kind = F.lit(None).cast("string")
    for language, words in TYPE_KEYWORDS.items():
        for word, what in words.items():
            kind = F.when((F.col("language") == language) & (F.col("value") == word), what).otherwise(kind)
    near = _neighbours(tokens).withColumns({"_v2": ahead("value", 2), "_t2": ahead("type", 2)})
    name = F.when(record, F.when(F.col("_t2") == "IDENTIFIER", F.col("_v2"))).when(F.col("t1") == "IDENTIFIER", F.col("v1"))
    found = near.filter("type = 'KEYWORD'").filter(~F.coalesce(tail, F.lit(False))).withColumns({"kind": kind, "name": name})
    return found.filter("kind is not null and name is not null").select("path", "language", "name", "kind", "line")


def _generic_call(tokens: DataFrame) -> DataFrame:
    """With ``_call``: whether the ``<`` after a name closes before a bracket opens, as in ``name<A, B>(``.

    Angle brackets are levelled like any bracket; the partner of the opening one must come before the next of ``; { } ( )``.
    """
    running = in_file().rowsBetween(W.unboundedPreceding, 0)
    backwards = W.partitionBy("path").orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, -1)
    step = F.when(is_value("value", "<"), 1).when(is_value("value", ">"), -1).otherwise(0)
    stop = F.last(F.when(is_value("value", ";", "{", "}", "(", ")"), F.struct("idx", "value")), True).over(backwards)
    some = tokens.withColumns({"_s": F.sum(step).over(running), "_stop": stop, "_code": F.when(F.col("type") != "NEWLINE", F.col("value"))})
    some = some.withColumn("_next", F.last("_code", True).over(backwards))
    some = some.withColumn("_d", F.col("_s") - F.least(F.lit(0), F.min("_s").over(running))).withColumn("_level", F.when(is_value("value", "<"), F.col("_d")).when(is_value("value", ">"), F.col("_d") + 1))
    level = W.partitionBy("path", "_level").orderBy("idx")
    partner = F.lead(F.struct("value", "idx", "_next")).over(level)
    some = some.withColumn("_partner", F.when(is_value("value", "<"), partner))
    closes = (F.col("_partner.value") == ">") & (F.col("_partner.idx") < F.col("_stop.idx")) & (F.col("_partner._next") == "(")
    return some.withColumn("_closes", F.coalesce(closes, F.lit(False))).withColumn("_call", ahead("_closes", 1))


def _variables() -> Column:
    """Whether a token of ``_neighbours`` with ``_left``, ``_depth`` and ``_call`` is the name in a declaration."""
    language, name = F.col("language"), F.col("type") == "IDENTIFIER"
    plain = name & ~F.coalesce(F.col("v1") == "(", F.lit(False))
    word = lambda v, t, own: (t == "KEYWORD") & v.isin(VARIABLE_WORDS[own])
    script = word(F.col("vm1"), F.col("tm1"), "javascript")
    final = (F.col("tm1") == "KEYWORD") & (F.col("vm1") == "final")
    java = F.when(final, word(F.col("_vm2"), F.col("_tm2"), "java")).otherwise(word(F.col("vm1"), F.col("tm1"), "java"))
    const = (F.col("_left.type") == "KEYWORD") & (F.col("_left.value") == "const")
    cpp = F.when(const, word(F.col("_left.vm1"), F.col("_left.tm1"), "cpp")).otherwise(word(F.col("_left.value"), F.col("_left.type"), "cpp"))
    sharp = word(F.col("vm1"), F.col("tm1"), "csharp") & ~((F.col("v1") == "<") & F.coalesce("_call", F.lit(False)))
    after = (F.col("tm1") == "OPERATOR") & F.col("vm1").isin(".", ":")
    starts = F.col("tm1").isNull() | (F.col("tm1") == "NEWLINE")
    assigned = (F.col("t1") == "OPERATOR") & ((F.col("v1") == "=") | (starts & (F.col("v1") == ":")))
    python = name & (F.col("_depth") == 0) & ~F.coalesce(after, F.lit(False)) & assigned
    braces = F.when(language == "java", java).when(language == "cpp", cpp).when(language == "csharp", sharp).otherwise(script)
    return F.coalesce(F.when(language == "python", python).otherwise(plain & braces), F.lit(False))


def declaration_counts(tokens: DataFrame) -> DataFrame:
    """(path, variables, loops, conditions, tries): a declared name after its type's word, ``let``, ``const`` or ``var``; in
    Python a name that is assigned or, at a statement's start, annotated, outside brackets; and the words of statements."""
    running = in_file().rowsBetween(W.unboundedPreceding, 0)
    python, word = F.col("language") == "python", F.col("type") == "KEYWORD"
    step = F.when(is_value("value", "(", "[", "{"), 1).when(is_value("value", ")", "]", "}"), -1).otherwise(0)
    near = _generic_call(_neighbours(tokens).withColumns({"_vm2": ahead("value", -2), "_tm2": ahead("type", -2), "_b": F.sum(step).over(running)}))
    star = (F.col("type") == "OPERATOR") & F.col("value").isin("*", "&")
    left = F.last(F.when(~star, F.struct("value", "type", "vm1", "tm1")), True).over(in_file().rowsBetween(W.unboundedPreceding, -1))
    near = near.withColumns({"_left": left, "_depth": F.col("_b") - F.least(F.lit(0), F.min("_b").over(running))})
    loop = F.when(python, F.col("value").isin(LOOPS)).otherwise(F.col("value").isin(BRACE_LOOPS) | ((F.col("language") == "csharp") & (F.col("value") == "foreach")))
    condition = F.when(python, F.col("value").isin(CONDITIONS)).otherwise(F.col("value").isin(BRACE_CONDITIONS))
    return near.groupBy("path").agg(
        F.count_if(_variables()).alias("variables"), F.count_if(word & loop).alias("loops"), F.count_if(word & condition).alias("conditions"), F.count_if(word & (F.col("value") == "try")).alias("tries"),
    )


def with_owner(code: DataFrame) -> DataFrame:
    """Significant tokens of Java with ``owner``: (open, name, level) of the innermost type body that they stand in, or null.

    A type's word (``x.class`` is none) waits for the next brace, unless a semicolon comes first. Braces are levelled and
    matched; bodies of types are levelled once more among themselves, so that the last body that was opened at a token's
    own type level is the one around it. ``level`` is the depth of braces and parentheses in the body.
    """
    running, before = in_file().rowsBetween(W.unboundedPreceding, 0), in_file().rowsBetween(W.unboundedPreceding, -1)
    word = (F.col("type") == "KEYWORD") & F.col("value").isin("class", "interface", "enum") & ~F.coalesce(ahead("value", -1) == ".", F.lit(False))
    event = F.when(word, F.struct(F.lit(True).alias("waits"), F.when(ahead("type", 1) == "IDENTIFIER", ahead("value", 1)).alias("name"))).when(
        is_value("value", ";", "{"), F.struct(F.lit(False).alias("waits"), F.lit(None).cast("string").alias("name"))
    )
    step = lambda opens, closes: F.when(is_value("value", *opens), 1).when(is_value("value", *closes), -1).otherwise(0)
    some = code.withColumns({"_event": event, "_sb": F.sum(step("{", "}")).over(running), "_sa": F.sum(step("{(", "})")).over(running)})
    floored = lambda s: F.col(s) - F.least(F.lit(0), F.min(s).over(running))
    some = some.withColumns({"_type": F.last("_event", True).over(before), "_db": floored("_sb"), "member_level": floored("_sa")})
    brace = is_value("value", "{")
    some = some.withColumn("_body", brace & F.coalesce("_type.waits", F.lit(False))).withColumn("_level", F.when(brace, F.col("_db")).when(is_value("value", "}"), F.col("_db") + 1))
    ends = F.lag("_body").over(W.partitionBy("path", "_level").orderBy("idx"))
    some = some.withColumn("_ends", is_value("value", "}") & F.coalesce(ends, F.lit(False)))
    some = some.withColumn("_t", F.sum(F.col("_body").cast("int") - F.col("_ends").cast("int")).over(running))
    opened = F.when(F.col("_body"), F.struct(F.col("idx").alias("open"), F.col("_type.name").alias("name"), F.col("member_level").alias("level")))
    own = W.partitionBy("path", "_t").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    some = some.withColumn("owner", F.when((F.col("_t") > 0) & ~F.col("_body"), F.last(opened, True).over(own)))
    return some.drop("_event", "_sb", "_sa", "_type", "_db", "_body", "_level", "_ends", "_t")


def with_data_holder(code: DataFrame) -> DataFrame:
    """``with_owner`` and ``data_holder``: whether the type around a token only holds data.

    Such a type's own members are fields, constructors and methods that read like accessors (``toString``, ``equals``,
    ``hashCode``, ``get``, ``set`` or ``is`` and a capital); initialisers and nested brackets don't count.
    """
    owned = with_owner(code).withColumns({"_n1": ahead("value", 1), "_nm1": ahead("value", -1)})
    member = F.col("owner").isNotNull() & (F.col("member_level") == F.col("owner.level")) & ~is_value("value", "{", "}", "(", ")")
    owned = owned.withColumns({"_member": member, "_open": F.col("owner.open")})
    body = W.partitionBy("path", "_open")
    initial = F.last(F.when(F.col("_member") & is_value("value", "=", ";"), F.col("value")), True).over(body.orderBy("idx").rowsBetween(W.unboundedPreceding, -1))
    accessor = F.col("value").rlike("^(toString|equals|hashCode)$|^(get|set|is)[A-Z]")
    own = (F.col("type") == "IDENTIFIER") & (F.col("_n1") == "(") & ~F.coalesce(F.col("_nm1") == "@", F.lit(False))
    acts = F.col("_member") & own & ~F.coalesce(initial == "=", F.lit(False)) & ~accessor & ~F.coalesce(F.col("value") == F.col("owner.name"), F.lit(False))
    owned = owned.withColumn("_acts", F.coalesce(acts, F.lit(False)))
    holds = F.col("owner").isNotNull() & ~F.max("_acts").over(body)
    return owned.withColumn("data_holder", F.coalesce(holds, F.lit(False))).drop("_n1", "_nm1", "_member", "_open", "_acts")
