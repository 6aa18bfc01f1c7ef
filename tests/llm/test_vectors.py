"""Vector near-duplicates and vector codes against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from codelode.llm import vector_codes, vector_dedup
from codelode.llm.vector_codes import assign, codebook_digest, compress_vectors, entry_levels, grown, leaf_starts, tree_order
from codelode.llm.vector_dedup import near_vectors

SHAPE = "vec_id long, embedding array<float>, label int, n_links long, digest string, v string"


def make_vectors(n=90, d=24, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.15:
            v = rng.choice(rows)[1]
        elif rows and kind < 0.6:
            v = [x + rng.gauss(0, 0.03) for x in rng.choice(rows)[1]]
        elif rows and kind < 0.65:
            v = [3 * x for x in rng.choice(rows)[1]]
        else:
            v = [rng.gauss(0, 1) for _ in range(d)]
        rows.append((i, [float(np.float32(x)) for x in v], rng.choice([1, 2, None])))
    odd = [None, [], [0.0] * d, [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0] * 8, [1.0, 1.0001] * 4]
    rows += [(n + i, v, 5) for i, v in enumerate(odd)]
    return rows + [(None, rows[0][1], 1), (4, rows[4][1], 1), (n + 50, [-0.0, 1.0] * (d // 2), 7), (n + 51, [0.0, 1.0] * (d // 2), 7)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", "y") for r in rows], SHAPE).repartition(3)


def brute_links(rows, threshold):
    good = [i for i, (k, v, _) in enumerate(rows) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            x, y = rows[a][1], rows[b][1]
            if a < b and len(x) == len(y) and sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y)) >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i in good:
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return sorted(((r[0], links[i], least[find(i)] if i in set(good) else r[0]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("tile,rows_at_once", [(4096, 256), (7, 3)])
def test_near_vectors(spark, monkeypatch, tile, rows_at_once):
    monkeypatch.setattr(vector_dedup, "TILE_ROWS", tile)
    monkeypatch.setattr(vector_dedup, "ROWS_AT_ONCE", rows_at_once)
    monkeypatch.setattr(vector_dedup, "BOXES", 5)
    rows = make_vectors()
    got = sorted((tuple(r) for r in near_vectors(frame(spark, rows), "vec_id", "embedding", 0.95).collect()), key=str)
    assert got == brute_links(rows, 0.95)
    assert sum(r[1] for r in got) > 50


def test_near_vectors_of_nothing(spark):
    assert near_vectors(frame(spark, []), "vec_id", "embedding").collect() == []
    only = near_vectors(frame(spark, [(1, None, 1), (2, [0.0, 0.0], 1)]), "vec_id", "embedding").collect()
    assert sorted(tuple(r) for r in only) == [(1, 0, 1), (2, 0, 2)]


def test_pair_of_tiles_drops_no_link():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 40))
    b = np.concatenate([a[:20] + rng.normal(size=(20, 40)) * 0.33, rng.normal(size=(10, 40))])
    axes = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    ua, ub = vector_dedup.unit(a), vector_dedup.unit(b)
    x, y, labels = vector_dedup.compare(a, b, False, 0.95, axes, np.ones(40, np.int64), np.full(30, 2))
    close = ua @ ub.T >= 0.95
    assert (x == 2 * close.sum(1)).all() and (y == close.sum(0)).all() and 0 < close.sum() < 20
    for i, j in zip(*np.nonzero(close)):
        assert labels[i] == labels[40 + j]


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, v, x) for i, v, x in rows if v and all(c is not None and math.isfinite(c) for c in v) and len(v) == 24]
    ints = [[math.floor(4096 * c) for c in v] for _, v, _ in kept]
    w = 24 // parts
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, ints[k]))
    books = [[ints[k][p * w : (p + 1) * w] for k in order[:entries]] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v[p * w : (p + 1) * w], e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        chosen = [[near(p, v)[1] for p in range(parts)] for v in ints]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * w : (p + 1) * w] for v, c in zip(ints, chosen) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out, by = [], {}
    for (i, _, label), v in zip(kept, ints):
        best = [near(p, v) for p in range(parts)]
        out.append((i, label, "".join(f"{c:02x}" for _, c in best), sum(d for d, _ in best)))
        by[label] = by.get(label, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((*r, by[r[1]]) for r in out), key=str), digest


@pytest.mark.parametrize("entries,block,leaf,labels", [(16, 4096, 32, 1 << 16), (5, 20, 4, 1)])
def test_codes(spark, monkeypatch, entries, block, leaf, labels):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block)
    monkeypatch.setattr(vector_codes, "LEAF_ROWS", leaf)
    monkeypatch.setattr(vector_codes, "MAX_BROADCAST_LABELS", labels)
    rows = make_vectors()
    codes, books = compress_vectors(frame(spark, rows), "vec_id", "embedding", "label", entries=entries, rounds=3)
    expected, digest = brute_codes(rows, 8, entries, 3)
    assert sorted((tuple(r) for r in codes.collect()), key=str) == expected
    assert codebook_digest(books) == digest


def test_codes_of_few_and_of_large_vectors(spark):
    none, books = compress_vectors(frame(spark, [(1, None, 1), (2, [1.0] * 7, 1)]), "vec_id", "embedding", "label")
    assert none.collect() == [] and books.size == 0
    few, books = compress_vectors(frame(spark, [(1, [1e30] * 8, 1), (2, [-1e30] * 8, None), (3, [0.5] * 8, None)]), "vec_id", "embedding", "label")
    got = {r["id"]: r for r in few.collect()}
    assert books.shape == (8, 3, 1) and {got[k].code for k in got} == {"00" * 8, "01" * 8, "02" * 8} and got[1].error == 0


@pytest.mark.parametrize("n,entries", [(1, 1), (37, 7), (500, 16), (300, 3)])
def test_dual_tree_finds_the_nearest(n, entries):
    rng = np.random.default_rng(n)
    points = rng.integers(-60, 60, (n, 4)).astype(np.int32)
    points[: n // 3] = points[0]
    books = np.concatenate([points[rng.integers(0, n, entries - entries // 3)], np.repeat(points[:1], entries // 3, 0)]).astype(np.int64)
    order = tree_order(points)
    own, starts = points[order], leaf_starts(n)
    leaves = [f.reduceat(own.astype(np.int64), starts[:-1]) for f in (np.minimum, np.maximum, np.add)]
    nearest, sums, counts = assign(own, grown(*leaves, starts), books, entry_levels(books))
    expected = ((own[:, None] - books[None]) ** 2).sum(2).argmin(1)
    assert sorted(order) == list(range(n)) and (nearest == expected).all()
    assert (counts == np.bincount(expected, minlength=entries)).all()
    assert all((sums[e] == own[expected == e].sum(0)).all() for e in range(entries))
