"""Sharding and mixing against plain Python."""

import hashlib
import math
import zlib
from collections import Counter

from codelode.llm import sharding
from codelode.llm.mixing import mix_sources, repetition_rates
from codelode.llm.sharding import shard_interleaved

ROWS = [(i, f"text {i % 7}", "big" if i % 3 else None if i % 2 else "small") for i in range(1500)] + [(2000, None, "small"), (2001, "", "small"), (2002, "é", ""), (None, "x", "big")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def unit(seed, doc):
    return int(hashlib.md5(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:13], 16) / 2**52


def shuffle_key(doc, text):
    data = (text or "").encode()
    return hashlib.md5(f"42:{f'{zlib.crc32(data)}:{len(data)}' if doc is None else doc}".encode()).hexdigest()


def test_many_sources_of_one_row(spark, monkeypatch):
    """All rows have the fraction 1/2; they are placed by digest, bucket by bucket."""
    monkeypatch.setattr(sharding, "ROWS_IN_BUCKET", 16)
    rows = [(i, "x", f"s{i}") for i in range(400)] + [(1000 + i, "y", f"pair{i // 2}") for i in range(200)] + [(None, f"t{i}", f"n{i}") for i in range(40)]
    keys = {}
    for i, t, s in rows:
        keys.setdefault(s, []).append((shuffle_key(i, t), i, t))
    order = sorted(((k + 0.5) / len(own), *x) for own in keys.values() for k, x in enumerate(sorted(own)))
    got = {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in shard_interleaved(docs(spark, rows)).collect()}
    n = len(rows)
    assert len(got) == n
    for place, (_, _, doc, text) in enumerate(order):
        shard = place * 8 // n
        assert got[doc, zlib.crc32(text.encode())] == (shard, place - (shard * n + 7) // 8)


def test_shards_interleave_every_source(spark):
    got = {r.doc_id: r for r in shard_interleaved(docs(spark)).collect()}
    assert len(got) == len(ROWS)
    order = []
    for source in {r[2] for r in ROWS}:
        own = sorted((shuffle_key(i, t), -1 if i is None else i) for i, t, s in ROWS if s == source)
        order += [((k + 0.5) / len(own), h, i) for k, (h, i) in enumerate(own)]
    order = [None if i == -1 else i for _, _, i in sorted(order)]
    n = len(order)
    for place, doc in enumerate(order):
        shard = place * 8 // n
        assert (got[doc].shard, got[doc].slot) == (shard, place - (shard * n + 7) // 8)
    for i, text, _ in ROWS:
        data = (text or "").encode()
        assert (got[i].size, got[i].text_crc32) == (len(data) + 1, zlib.crc32(data))


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a", "s")] * 5
    assert sorted(r.shard for r in shard_interleaved(docs(spark, rows), n_shards=5).collect()) == [0, 1, 2, 3, 4]
    assert shard_interleaved(docs(spark, [])).count() == 0
    assert mix_sources(docs(spark, [])).count() == 0


def poisson(u, rate):
    k, p, cdf = 0, math.exp(-rate), math.exp(-rate)
    while cdf <= u:
        k += 1
        p *= rate / k
        cdf += p
    return k


def test_mixing_inverts_the_poisson_distribution(spark):
    rates = {r._source: r.rate for r in repetition_rates(docs(spark), weights={"small": 900.0}, growth=2.0).collect()}
    want = Counter()
    for i, _, source in ROWS:
        for copy in range(poisson(unit(7, i), rates[source])):
            want[(i, copy)] += 1
    out = mix_sources(docs(spark), weights={"small": 900.0}, growth=2.0)
    assert Counter((r.doc_id, r.mix_copy) for r in out.collect()) == want
    assert out.columns == ["doc_id", "text", "source", "mix_copy", "mix_key"]
    assert abs(sum(want.values()) - 2 * len(ROWS)) < 6 * math.sqrt(2 * len(ROWS))


def test_mixing_keeps_columns_of_any_name(spark):
    plain = docs(spark)
    clash = plain.selectExpr("*", "1 as _count", "2 as _rate", "3 as row", "4 as copy", "5 as mix_copy", "6 as `a.b`", "7 as _source")
    out = mix_sources(clash)
    assert out.columns == [*plain.columns, "_count", "_rate", "row", "copy", "a.b", "_source", "mix_copy", "mix_key"]
    got = [(r.doc_id, r.mix_copy, r._count, r._rate, r.row, r.copy, r["a.b"], r._source) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(r.doc_id, r.mix_copy, 1, 2, 3, 4, 6, 7) for r in mix_sources(plain).collect()], key=str)
