"""Table functions for queries written in SQL alone: ``parse_diff`` and ``lex_source``.

    SELECT * FROM parse_diff(TABLE(SELECT id AS file, text FROM diffs))
    SELECT * FROM lex_source(TABLE(SELECT path, language, content FROM files))

They read Arrow batches and give back pieces of bounded length; a row is a whole text, so they need no shuffle. In DataFrame code ``formats.diff_lines`` and
``tokens.tokens`` do the same inside the JVM. Null texts give no rows.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from ..operators.tokens import KEYWORDS, PATTERNS

_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_WORD, _STRING = re.compile(r"[A-Za-z_$]|@[A-Za-z_$]"), re.compile(r"(?:[rRbBuUfF]{0,2}|@\$?|\$@?)\"")
_PYTHON_STRING, _DIRECTIVE = re.compile(r"[rRbBuUfF]{0,2}'"), re.compile(r"\s*#.", re.A)
_COMPILED = {k: re.compile(v.replace(r"\z", r"\Z"), re.A) for k, v in PATTERNS.items()}


def _named(line: str) -> str:
    return re.sub(r"^[ab]/", "", re.sub(r'^"|"$|\t.*$', "", line[4:]))


def added_lines(text: str):
    """(path, is_new, line) of the added lines of a unified diff."""
    source = target = None
    old = new = at = 0
    for line in text.replace("\r\n", "\n").split("\n"):
        if head := _HUNK.match(line):
            old, new, at = int(head[1] or 1), int(head[3] or 1), int(head[2])
            continue
        both = line == "" or line[0] == " "
        if (both and old > 0 and new > 0) or (line[:1] == "-" and old > 0) or (line[:1] == "+" and new > 0):
            if line[:1] == "+":
                yield target, source == "/dev/null", at
            old, new, at = old - (both or line[0] == "-"), new - (both or line[0] == "+"), at + (both or line[0] == "+")
        elif line.startswith("--- "):
            source = _named(line)
        elif line.startswith("+++ "):
            target = _named(line)


def token_kind(language: str, value: str) -> str:
    first, python = value[0], language == "python"
    if value == "\n":
        return "NEWLINE"
    if python and first == "#":
        return "LINE_COMMENT"
    if "#" in value and (value == "#" or _DIRECTIVE.match(value)):
        return "PREPROCESSOR"
    if not python and value.startswith("//"):
        return "LINE_COMMENT"
    if value.startswith("/*"):
        return "BLOCK_COMMENT"
    if first == "`" or _STRING.match(value) or (python and _PYTHON_STRING.match(value)) or (first == "'" and language in ("javascript", "typescript")):
        return "STRING"
    if first == "'":
        return "CHAR"
    if "0" <= first <= "9":
        return "NUMBER"
    if _WORD.match(value):
        return "KEYWORD" if value in KEYWORDS[language] else "IDENTIFIER"
    return "OPERATOR" if first in "-+*/%=<>!&|^~?:.@" else "PUNCTUATION"


#: Rows of a table that a function gives back at once: what a task holds hangs on this and one text, not on its batch.
PIECE = 1 << 14
#: Bytes of texts in a batch.
BATCH_BYTES = 1 << 20


def _pieces(rows, names: list[str], types: list[pa.DataType]):
    """Tables of at most ``PIECE`` rows; one without rows where there are none."""
    rows, first = iter(rows), True
    while (some := list(islice(rows, PIECE))) or first:
        columns = list(zip(*some, strict=True)) or [[]] * len(names)
        yield pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        first = False


def _cells(batch: pa.RecordBatch, *names: str):
    """The rows of a batch, one after the other."""
    for i in range(batch.num_rows):
        yield tuple(batch[n][i].as_py() for n in names)


#: Types of short tokens that were met, by language; empty for white space.
_KINDS: dict[str, dict[str, str]] = {k: {} for k in _COMPILED}


def lexed(path: str, language: str, content: str | None):
    """(path, language, idx, type, value, line) of a text's tokens; ``idx`` counts white space too."""
    if content is None or language not in _COMPILED:
        return
    line, known = 1, _KINDS[language]
    for idx, found in enumerate(_COMPILED[language].finditer(content)):
        value = found[0]
        kind = known.get(value)
        if kind is None:
            kind = "" if value != "\n" and not value.strip(" \t\r\f\v") else token_kind(language, value)
            if len(value) <= 32:
                if len(known) >= PIECE:
                    known.clear()
                known[value] = kind
        if kind:
            yield path, language, idx, kind, value, line
        if "\n" in value:
            line += value.count("\n")


@arrow_udtf(returnType="file string, path string, is_new boolean, line int")
class ParseDiff:
    """(file, path, is_new, line) of the added lines of the table's (file, text)."""

    def eval(self, batch: pa.RecordBatch):
        rows = ((str(file), *row) for file, text in _cells(batch, "file", "text") if text is not None for row in added_lines(text))
        yield from _pieces(rows, ["file", "path", "is_new", "line"], [pa.string(), pa.string(), pa.bool_(), pa.int32()])


@arrow_udtf(returnType="path string, language string, idx int, type string, value string, line int")
class LexSource:
    """The token table of the table's (path, language, content); ``idx`` counts white space too."""

    def eval(self, batch: pa.RecordBatch):
        rows = (token for file in _cells(batch, "path", "language", "content") for token in lexed(*file))
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]
        yield from _pieces(rows, ["path", "language", "idx", "type", "value", "line"], types)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL; batches of texts are about 1 MB from here on, and one text at least."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.udtf.register("parse_diff", ParseDiff)
    spark.udtf.register("lex_source", LexSource)
