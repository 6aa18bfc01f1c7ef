"""Files read token by token in their own task: the few tokens that a rule or a count may want, with what surrounds them.

``structure.structured`` says the same of every token of a token table by windows, which sort and carry all tokens many
times over. Here a text is lexed and its brackets are matched in one small Arrow function, and only the tokens that are
asked for leave it, so neither a token nor a window is shuffled or sorted.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.table_functions import BATCH_BYTES, PIECE, lexed
from .findings import SECRET_FORMATS
from .structure import CODE_COMMENTS, DECISIONS, NOT_BEFORE, SPECIFIERS
from .tokens import LANGUAGES, SPREAD

#: The types of rows that tell a file's depth and a public field, and what a string with a provider's token has.
NESTING, FIELD, SECRET = "NESTING", "FIELD", re.compile("|".join(SECRET_FORMATS.values()))
# Words between ``public`` and a field's type, and names of methods that data holders have.
MODIFIERS = {
    "java": ["static", "final", "volatile", "transient", "abstract", "synchronized"],
    "csharp": ["static", "readonly", "const", "volatile", "virtual", "override", "abstract", "sealed", "async"],
}
ACCESSOR = re.compile(r"^(toString|equals|hashCode)\Z|^(get|set|is)[A-Z]")
_TEXT, _INT, _YES = ("string", pa.string()), ("int", pa.int32()), ("boolean", pa.bool_())
#: What is counted between a call's brackets, as in ``rules.call_counts``: the token, and what must follow it.
COUNTED = {"plus": ("+", ()), "loader": ("Loader", ()), "shell_true": ("shell", (("=",), ("True",))), "not_for_security": ("usedforsecurity", (("=",), ("False",))), "mutable": ("=", (("[", "{"),)), "dots": (".", ())}
_STARTS = {first: (name, rest) for name, (first, rest) in COUNTED.items()}
#: The columns that can be asked for, as in ``structure.structured``; ``_void1``, ``comments1`` and ``_dots1`` are the next token's.
COLUMNS = {
    "idx": _INT, "type": _TEXT, "value": _TEXT, "line": _INT, "linem1": _INT, "scope": _TEXT, **{f"v{k}": _TEXT for k in range(1, 8)}, **{f"t{k}": _TEXT for k in range(1, 8)}, **{f"vm{k}": _TEXT for k in range(1, 4)}, "tm1": _TEXT,
    "i1": _INT, "comments": _INT, "comments1": _INT, "_quiet": _YES, "close": _INT, "_void1": _YES, "_dots1": _INT, **{f"_n_{name}": _INT for name in COUNTED}, "f_name": _TEXT, "f_start": _INT, "f_end": _INT,
}


class Reading:
    """The significant tokens of a text, their brackets' partners and the functions that start at them; see ``structure.structured``."""

    def __init__(self, language: str, content: str | None):
        self.language = language
        self.values, self.types, self.lines, self.idx, self.comments, self.remarks = [], [], [], [], [], []
        comments = 0
        for _, _, idx, kind, value, line in lexed("", language, content):
            if kind in CODE_COMMENTS:
                comments += 1
                self.remarks.append({"idx": idx, "type": kind, "value": value, "line": line})
            elif kind != "NEWLINE":
                self.values.append(value)
                self.types.append(kind)
                self.lines.append(line)
                self.idx.append(idx)
                self.comments.append(comments)
        self.size = len(self.values)
        self.close, self.counted, self.functions = {}, {}, {}

    def structure(self) -> None:
        self._match()
        self._functions()

    def at(self, own: list, j: int):
        return own[j] if 0 <= j < self.size else None

    def _match(self) -> None:
        values, self.counted = self.values, {name: [] for name in COUNTED}
        stacks, deepest = {"(": [], "{": []}, 0
        for j, value in enumerate(values):
            if value in stacks:
                stacks[value].append(j)
                deepest = max(deepest, len(stacks["{"]))
            elif value == ")" or value == "}":
                if own := stacks["(" if value == ")" else "{"]:
                    self.close[own.pop()] = j
            if value in _STARTS:
                name, rest = _STARTS[value]
                if all(self.at(values, j + k) in some for k, some in enumerate(rest, 1)):
                    self.counted[name].append(j)
        if self.language in MODIFIERS:
            self.remarks += [{"type": FIELD, "line": line} for line in self.public_fields()]
        if deepest and self.language != "python":
            self.remarks.append({"type": NESTING, "line": deepest})

    def between(self, name: str, j: int) -> int | None:
        """How many tokens of a kind lie between a bracket and its partner."""
        if (end := self.close.get(j)) is None:
            return None
        own = self.counted[name]
        return bisect_right(own, end) - bisect_right(own, j)

    def quiet(self, j: int) -> bool | None:
        return self.comments[j + 2] == self.comments[j] if j + 2 < self.size else None

    def void(self, j: int) -> bool | None:
        """Whether an empty block follows the closed bracket, without a comment."""
        if (end := self.close.get(j)) is None:
            return None
        return self.at(self.values, end + 1) == "{" and self.at(self.values, end + 2) == "}" and bool(self.quiet(end))

    def close_line(self, j: int | None) -> int | None:
        return self.lines[self.close[j]] if j in self.close else None

    def _functions(self) -> None:
        """``functions``: name, first and last line by the place of the parenthesis or arrow."""
        values, types, language = self.values, self.types, self.language
        if language == "python":
            return
        script = language in ("javascript", "typescript")
        first, ends = SPECIFIERS.get(language, ((), ()))
        stops, stop = {}, None
        for j in range(self.size - 1, -1, -1):
            if values[j] == ")":
                stops[j] = stop
            if values[j] in ends:
                stop = j
        name = "<anonymous>"
        for j, value in enumerate(values):
            if value == ";" or value == "{" or value == "}":
                name = "<anonymous>"
            elif types[j] == "IDENTIFIER" and self.at(values, j + 1) == "=" and j + 2 < self.size and values[j + 2] != ">":
                name = value
            if value == "(" and j in self.close and j > 0:
                named = types[j - 1] == "IDENTIFIER" and self.at(values, j - 2) not in NOT_BEFORE
                if named or (script and types[j - 1] == "KEYWORD" and values[j - 1] == "function"):
                    k = self.close[j]
                    after, end = self.at(values, k + 1), None
                    if after == "{":
                        end = self.close_line(k + 1)
                    elif after in first and types[k + 1] not in ("STRING", "CHAR") and stops[k] is not None and values[stops[k]] == "{":
                        end = self.close_line(stops[k])
                    if end is not None:
                        self.functions[j] = (values[j - 1] if named else name, self.lines[j - 1], end)
            elif script and value == "=" and self.at(values, j + 1) == ">" and self.at(values, j + 2) == "{" and (end := self.close_line(j + 2)) is not None:
                self.functions[j] = (name, self.lines[j], end)

    def data_holders(self) -> list[bool]:
        """Whether the innermost Java type around each token only holds data; see ``scopes.with_data_holder``."""
        values, types = self.values, self.types
        ends = {self.close[j] for j in self.close if values[j] == "{"}
        opened: list[tuple[int, str | None, int, bool]] = []
        bodies, waits, name, level = [], False, None, 0
        owners, acting, initial = [None] * self.size, set(), {}
        for j, value in enumerate(values):
            level = level + 1 if value in ("{", "(") else max(level - 1, 0) if value in ("}", ")") else level
            body = value == "{" and waits
            if value == "{":
                bodies.append(body)
                if body:
                    opened.append((j, name, level))
            elif value == "}" and j in ends and bodies.pop():
                opened.pop()
            if opened and not body:
                owners[j] = open_ = opened[-1][0]
                if level == opened[-1][2] and value not in ("{", "}", "(", ")"):
                    own = types[j] == "IDENTIFIER" and self.at(values, j + 1) == "(" and self.at(values, j - 1) != "@"
                    if own and initial.get(open_) != "=" and not ACCESSOR.search(value) and value != opened[-1][1]:
                        acting.add(open_)
                    if value == "=" or value == ";":
                        initial[open_] = value
            if types[j] == "KEYWORD" and value in ("class", "interface", "enum") and self.at(values, j - 1) != ".":
                waits, name = True, values[j + 1] if self.at(types, j + 1) == "IDENTIFIER" else None
            elif value == ";" or value == "{":
                waits, name = False, None
        return [open_ is not None and open_ not in acting for open_ in owners]

    def public_fields(self) -> list[int]:
        """Lines of the names of public fields; see ``rules.public_fields``."""
        values, types, java = self.values, self.types, self.language == "java"
        starts = [j for j, value in enumerate(values) if value == "public" and types[j] == "KEYWORD"]
        if not starts:
            return []
        holders, lines, allowed = self.data_holders() if java else [False] * self.size, [], MODIFIERS[self.language]
        for start, end in zip(starts, [*starts[1:], self.size], strict=True):
            depth, name, stop, words, following = 0, None, None, [], None
            for j in range(start + 1, end):
                value = values[j]
                depth = depth + 1 if value in ("<", "[") else max(depth - 1, 0) if value in (">", "]") else depth
                if depth == 0 and value in (";", "=", "(", "{", ","):
                    stop = value
                    break
                if depth == 0 and types[j] == "IDENTIFIER":
                    name = j
                if following is None:
                    if types[j] == "KEYWORD" and value in allowed:
                        words.append(value)
                    else:
                        following = j
            constant = ("static" in words and "final" in words) if java else "const" in words or ("static" in words and "readonly" in words)
            declares = java and following is not None and types[following] == "KEYWORD" and values[following] in ("class", "interface", "enum")
            if name is not None and stop in (";", "=", ",") and not constant and not declares and not holders[start]:
                lines.append(self.lines[name])
        return lines

    def wanted(self, words: frozenset[str], assigned: re.Pattern | None, numbers: bool, called: frozenset[str] = frozenset()) -> list[int]:
        """The places of ``words``, of the parenthesis of what is ``called`` or defined, of what is assigned or compared as ``candidates`` says, of C++'s numbers and of functions."""
        numbers = numbers and self.language == "cpp"
        after, types = [*self.values[1:], None], self.types
        return [
            j for j, value in enumerate(self.values)
            if value in words or j in self.functions or (value == "(" and called and (self.at(self.values, j - 1) in called or self.at(self.values, j - 2) == "def")) or (types[j] == "STRING" and len(value) > 6 and SECRET.search(value))
            or (assigned is not None and after[j] == "=" and (value == "=" or value == "!" or self.at(self.values, j + 2) in ("[", "{") or assigned.search(value.lower())))
            or (numbers and types[j] == "NUMBER" and value != "0" and value != "1")
        ]

    def scopes(self) -> list[str | None]:
        """The last of the words ``class`` and ``def`` at each token."""
        out, last = [], None
        for kind, value in zip(self.types, self.values, strict=True):
            if kind == "KEYWORD" and (value == "class" or value == "def"):
                last = value
            out.append(last)
        return out

    def column(self, name: str, some: list[int]) -> list:
        if name in ("value", "type", "line", "comments", "idx"):
            own = {"value": self.values, "type": self.types, "line": self.lines, "comments": self.comments, "idx": self.idx}[name]
            return [own[j] for j in some]
        if name in ("f_name", "f_start", "f_end"):
            place = ("f_name", "f_start", "f_end").index(name)
            return [self.functions[j][place] if j in self.functions else None for j in some]
        if name == "close":
            return [self.idx[self.close[j]] if j in self.close else None for j in some]
        if name == "_quiet":
            return [self.quiet(j) for j in some]
        if name == "_void1":
            return [self.void(j + 1) for j in some]
        if name == "_dots1":
            return [self.between("dots", j + 1) for j in some]
        if name.startswith("_n_"):
            return [self.between(name[3:], j) for j in some]
        if name == "scope":
            own = self.scopes() if self.language == "python" else [None] * self.size
            return [own[j] for j in some]
        own = {"v": self.values, "t": self.types, "i": self.idx, "c": self.comments, "l": self.lines}[name[0]]
        step = -int(name[-1]) if name[-2] == "m" else int(name[-1])
        last = self.size - step
        return [own[j + step] if 0 <= j + step and j < last else None for j in some]


def candidates(files: DataFrame, words: set[str], columns: list[str], assigned: str | None = None, numbers: bool = False, remarks: bool = False, called: set[str] | None = None) -> DataFrame:
    """(path, language, ``columns``) of some tokens of files (path, language, content): ``words``, strings that may hold a
    provider's token, and, where their columns are asked for, those where a function has its parenthesis or arrow.

    With ``called`` also the parenthesis after such a word and after a Python function's name. With ``assigned``, an expression for names in lower case, also what stands before ``=`` and is such a name, ``=`` or
    ``!``, or has a bracket behind; with ``numbers`` C++'s; with ``remarks`` the comments, a row of type ``NESTING`` whose
    line is the depth of a file's braces, and one of type ``FIELD`` for each public field of Java and C#.
    """
    spark = files.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    types, words_, names = [COLUMNS[c][1] for c in columns], frozenset(words), assigned and re.compile(assigned)
    calls = frozenset(called or ())
    structured = remarks or any(c in ("close", "_void1", "_dots1", "f_name", "f_start", "f_end") or c.startswith("_n_") for c in columns)
    # Files may come from few rows of a table: dealt by path, so that all tasks read.
    parts = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = files.filter(F.col("language").isin(LANGUAGES)).select("path", "language", "content").repartition(parts, "path")

    def read(batches):
        for batch in batches:
            rows, held = [], [[] for _ in columns]

            def piece(batch=batch):
                at = pa.array(rows, "int64")
                return pa.record_batch([batch["path"].take(at), batch["language"].take(at), *[pa.array(x, kind) for x, kind in zip(held, types, strict=True)]], names=["path", "language", *columns])

            for i in range(batch.num_rows):
                text = Reading(batch["language"][i].as_py(), batch["content"][i].as_py())
                if structured:
                    text.structure()
                some, besides = text.wanted(words_, names, numbers, calls), text.remarks if remarks else []
                rows += [i] * (len(some) + len(besides))
                for x, c in zip(held, columns, strict=True):
                    x += text.column(c, some)
                    x += [r.get(c) for r in besides]
                if len(rows) >= PIECE:
                    yield piece()
                    rows, held = [], [[] for _ in columns]
            yield piece()

    return own.mapInArrow(read, "path string, language string, " + ", ".join(f"{c} {COLUMNS[c][0]}" for c in columns))


def decision_candidates(files: DataFrame) -> DataFrame:
    """The tokens that ``structure.decides`` may count and those where a function starts."""
    return candidates(files, DECISIONS, ["idx", "type", "value", "line", "v1", "i1", "vm1", "tm1", "f_name", "f_start", "f_end"])
