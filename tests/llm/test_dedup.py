"""Near-duplicates and repeated passages against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from codelode.llm import minhash, repeats
from codelode.llm.components import components


def make_docs(seed=5, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            rows.append((i, rng.choice(rows)[1]))
        elif rows and kind < 0.6:
            own = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(1, 4)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((i, " ".join(own)))
        else:
            rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))))
    return rows + [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "one two"), (n + 4, "ONE\ttwo"), (n + 5, "a b " * 300), (n + 6, "a b " * 280), (None, "one two")]


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            s = len(sets[a] & sets[b])
            if s and 100 * s >= percent * (len(sets[a]) + len(sets[b]) - s):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width,percent,hubs", [(4, 80, 64), (5, 80, 2)])
def test_near_duplicates(spark, monkeypatch, width, percent, hubs):
    monkeypatch.setattr(minhash, "HUBS", hubs)
    monkeypatch.setattr(minhash, "SALT_ROWS", 3)
    rows = make_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width, percent).collect()}
    assert got.pop(None) == (1, None)
    assert got == brute_components(rows, width, percent)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(180):
        own = list(base)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(150)] = f"x{rng.randrange(9999)}"
        rows.append((i * 3 % 180 + i // 60, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 4, 80).collect()}
    assert got == brute_components(rows, 4, 80)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 4), (20, 20), (None, 3), (3, 2)] + [(100, 100 + i) for i in range(50)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 1 for i in (1, 2, 3)}, **{i: 4 for i in range(4, 10)}, **{i: 100 for i in range(100, 150)}}


def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted({(i, t) for i, t in rows if i is not None}, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = [False] * len(data)
        for j in range(len(data) - 99):
            w = data[j : j + 100]
            if w in seen:
                gone[j : j + 100] = [True] * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [4096, 2])
def test_repeats(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh éß") for _ in range(333))
    rows = [(i, "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 300))) + passage[rng.randint(0, 150) : rng.randint(180, 333)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 150)))) for i in range(50)]
    rows += [(60, None), (61, ""), (62, "z" * 99), (63, "z" * 100), (64, "z" * 700), (65, "ab" * 300), (66, rows[3][1]), (67, rows[3][1] + "tail"), (67, rows[3][1] + "tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in repeats.remove_repeats(docs).collect()}
    assert got == brute_repeats(rows)


def test_texts_over_a_chunk(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghij") for _ in range((1 << 20) + 5000))
    rows = [(1, long), (2, long[1 << 19 :][: 1 << 19]), (3, long[(1 << 20) - 300 : (1 << 20) + 300])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (len(long), 0, 0), 2: (1 << 19, 1 << 19, 1), 3: (600, 600, 1)}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == 0 and repeats.remove_repeats(none).count() == 0
