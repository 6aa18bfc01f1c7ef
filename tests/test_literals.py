"""Literals that nest: one token each."""

import pytest

from codelode.operators.tokens import NESTED, tokens


def values(spark, language, text):
    df = spark.createDataFrame([("f", language, text)], "path string, language string, content string")
    return [(r.type, r.value, r.line) for r in tokens(df).orderBy("idx").collect()]


DEEP = "{" * (NESTED - 1) + "x" + "}" * (NESTED - 1)
ONE = {
    "typescript": [
        "`a ${b} c`", "`${ {a: {b: 1}} }`", "`${f(`inner`)} and ${g}`", "`\\` $ $x \\${ }`", "`${a ? `x${1}` : '}'`", "`line\n${\n{}\n}\n`", "`${" + DEEP + "}`", "`open ${ never", "``",
    ],
    "csharp": [
        '$"a {b} c"', '$"{Foo("{}")}"', '$"{{not a hole}} {x:N2} }}"', '$@"a ""q"" {d["k"]} \\"', '@$"line\n{ new { A = 1 } }"', '@"a""b\\"', '$"\\" {x}"', '$"{' + DEEP + '}"', '$"{"\\"}"}"', '$""',
    ],
}


@pytest.mark.parametrize("language", ["typescript", "javascript", "csharp"])
def test_one_token(spark, language):
    own = ONE["csharp" if language == "csharp" else "typescript"]
    files = spark.createDataFrame([(str(i), language, text if "never" in text else text + ";\nz") for i, text in enumerate(own)], "path string, language string, content string")
    found = {}
    for r in tokens(files).orderBy("path", "idx").collect():
        found.setdefault(int(r.path), []).append((r.type, r.value, r.line))
    for i, text in enumerate(own):
        after = 1 + text.count("\n")
        rest = [] if "never" in text else [("PUNCTUATION", ";", after), ("NEWLINE", "\n", after), ("IDENTIFIER", "z", after + 1)]
        assert found[i] == [("STRING", text, 1), *rest], text


def test_an_interpolated_string_ends_before_its_line(spark):
    assert [v for _, v, _ in values(spark, "csharp", '$"open\nx')] == ['$"open', "\n", "x"]
    assert [v for _, v, _ in values(spark, "csharp", '$"a" + $"b"')] == ['$"a"', "+", '$"b"']
