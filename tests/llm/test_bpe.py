"""Ids and texts against the tokenizers library itself."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codelode.llm.bpe import Bpe, decode_ids, encode_texts
from pyspark.sql import functions as F

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b", "re", "'", "'re", "ing", " ", "  ", "\n", "\t", "1", "23", "!", "?!", "é", "ß", "日本", "́", "\U0001f600", "<|endoftext|>", "<|", "\xa0", "the", " the", "tion"]


@pytest.fixture(scope="module")
def bpe():
    return Bpe(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed, n, length):
    rng = random.Random(seed)
    for _ in range(n):
        some = rng.sample(BITS, rng.randint(1, 6))
        yield "".join(rng.choice(some) for _ in range(rng.randint(0, length)))


def test_joins_are_exact(bpe, library):
    rng = random.Random(1)
    for text in texts(2, 1500, 120):
        cut = rng.randint(0, len(text))
        joined = bpe.join(bpe.encode(text[:cut]), bpe.encode(text[cut:]), width=rng.choice([1, 2, 4]))
        ids = library.encode(text, add_special_tokens=False).ids
        assert joined == ids, text
        assert bpe.decode(joined) == library.decode(ids, skip_special_tokens=False)


def test_partial_characters_decode_as_the_library_does(bpe, library):
    for ids in ([160], [160, 160, 65], list(range(100, 256)), [50256, 220]):
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_unsplit_and_odd_rows(spark, library):
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "a" * 5000), (3, "".join(rng.choice("abcdxyz") for _ in range(3001))), (4, "é" * 999 + "<|endoftext|>" + "1" * 700), (5, " " * 1500 + "x"), (5, " " * 1500 + "x"), (6, "short"), (None, "日本語" * 400)]
    rows += [(10 + i, t) for i, t in enumerate(texts(4, 60, 900))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids_col", F.lit(1))
    out = encode_texts(docs, PATH, leaf_chars=64).withColumn("back", decode_ids(F.col("ids"), PATH)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in out) == sorted((str(i), t or "") for i, t in rows)
    for r in out:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(memoryview(r.ids).cast("I")) == want
        assert r.back == library.decode(want, skip_special_tokens=False)


def test_empty_table(spark):
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_an_input_column_named_as_the_ids(spark):
    docs = spark.createDataFrame([(1, "some text", 5), (2, "long " * 50, 6)], "doc_id long, text string, ids int")
    out = encode_texts(docs, PATH, leaf_chars=64)
    assert sorted(out.columns) == ["doc_id", "ids", "text"] and {r.doc_id: bytes(r.ids) for r in out.collect()} == {
        r.doc_id: bytes(r.ids) for r in encode_texts(docs.drop("ids"), PATH, leaf_chars=64).collect()}
