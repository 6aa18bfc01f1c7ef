"""Phrases against brute force."""

import random
import re
from collections import Counter

import pytest

from codelode.llm import phrases
from codelode.llm.phrases import collocations, frequent_phrases


def make_docs(seed=2, n=80):
    rng = random.Random(seed)
    words = ["Red", "fox", "runs", "é", "über", "x y", "b'c", "\\n", "fast"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "?!"]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "de", None]), text, i))
    return rows + [(None, None, 1), ("en", "", 2), ("und", "red fox runs fast", 3), ("de", "only " * 60, 4), ("en", "red fox", None)] * 3


def brute_counts(rows, longest):
    counts, totals = Counter(), Counter()
    for lang, text, _ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang or "und", tuple(w[i : i + k])] += 1
    return counts, totals


def brute(rows, longest, least, top):
    counts, totals = brute_counts(rows, longest)
    frequent = {k: n for k, n in counts.items() if n >= least}
    found = {}
    for (lang, p), a in frequent.items():
        holds = any(x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 100 * a for (x, q), b in frequent.items())
        if len(p) > 1 and not holds:
            score, cut = min((1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:cut]], counts[lang, p[cut:]]))
    return [(lang, i + 1, p.decode(), -a, x, y, totals[lang], -s) for lang in sorted(found) for i, (s, a, p, x, y) in enumerate(sorted(found[lang])[:top])]


@pytest.mark.parametrize("lowered,flush,top", [(0.35, 4 << 20, 2000), (40.0, 50, 5)])
def test_collocations(spark, monkeypatch, lowered, flush, top):
    """With the second set nothing is proposed that is not very frequent, so the expansion has to find the rest."""
    monkeypatch.setattr(phrases, "LOWERED", lowered)
    monkeypatch.setattr(phrases, "FLUSH_BYTES", flush)
    rows = make_docs()
    docs = spark.createDataFrame(rows, "lang string, text string, phrase long").repartition(3)
    got = [tuple(r) for r in collocations(docs, "text", "lang", 5, 6, top).orderBy("lang", "rank").collect()]
    assert got == brute(rows, 5, 6, top) and len(got) > 10


def test_all_frequent_phrases_whatever_was_proposed(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SAMPLE", 0.0)
    rows = make_docs(seed=5, n=40)
    docs = spark.createDataFrame(rows, "lang string, text string, n long")
    got = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in frequent_phrases(docs, "text", "lang", 4, 5).filter("phrase <> ''").collect()}
    assert got == {k: n for k, n in brute_counts(rows, 4)[0].items() if n >= 5}


def test_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations(docs, "text", "lang").collect() == []
    assert collocations(spark.createDataFrame([("en", None), (None, " ")], docs.schema), "text", "lang").collect() == []


def test_filter_has_what_it_was_given():
    hashes = phrases.read_words("a b é c".encode(), "en").one
    words, bits = phrases.filter_words(phrases._keys(hashes))
    bloom = phrases.np.zeros(1 << (phrases.BLOOM_BITS - 6), phrases.np.int64)
    bloom[words] = bits
    bloom = bloom.view(phrases.np.uint64)
    assert len(hashes) == 4 and phrases.known(bloom, hashes).all() and not phrases.known(bloom, ~hashes).any()
    assert not phrases.known(bloom, phrases.read_words(b"a b", "de").one).any()


def test_words_of_a_folded_text():
    words = phrases.read_words(b" ab  c\nab c\x00 c", "en")
    assert [words.phrase(i, 1) for i in range(5)] == [b"ab", b"c", b"ab", b"c\x00", b"c"] and words.piece.tolist() == [0, 0, 1, 1, 1]
    assert words.one[0] == words.one[2] and words.one[1] == words.one[4] and len(set(words.one.tolist())) == len(set(words.two.tolist())) == 3
    assert len(phrases.read_words(b"", "en").one) == len(phrases.read_words(b" \n ", "en").one) == 0


def test_words_of_a_phrase_are_sent_once(spark, monkeypatch):
    """However many texts, runs and tasks have it: rows of words do not grow with tasks times phrases."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    rows = [("en" if i % 3 else "de", " ".join(rng.choice(words) for _ in range(200)) + f" {i}.", i) for i in range(160)]
    sent, tidy = spark.sparkContext.accumulator(0), phrases.tidy

    def counting(function):
        def counted(batches):
            for batch in function(batches):
                if "phrase" in batch.schema.names:
                    sent.add(batch.num_rows)
                yield batch

        return tidy(counted)

    monkeypatch.setattr(phrases, "tidy", counting)
    monkeypatch.setattr(phrases, "FLUSH_BYTES", 2000)
    monkeypatch.setattr(phrases, "SAMPLE", 1.0)
    monkeypatch.setattr(phrases, "LOWERED", 1.0)
    docs = spark.createDataFrame(rows, "lang string, text string, n long").repartition(8)
    got = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in frequent_phrases(docs, "text", "lang", 3, 5).filter("phrase <> ''").collect()}
    assert got == {k: n for k, n in brute_counts(rows, 3)[0].items() if n >= 5} and len(got) > 2000
    assert sent.value < 1.5 * len(got)


def test_copies_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FLUSH_BYTES", 50)
    rows = [("en", "one two three, four five six seven", 1)] * 60 + make_docs(seed=9, n=20)
    docs = spark.createDataFrame(rows, "lang string, text string, n long").repartition(6)
    got = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in frequent_phrases(docs, "text", "lang", 4, 5).filter("phrase <> ''").collect()}
    assert got == {k: n for k, n in brute_counts(rows, 4)[0].items() if n >= 5}


def test_long_words_are_told_apart():
    """Sums of bytes times powers of any odd base take these two words for equal."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    words = phrases.read_words(f"{a} {b} {a}".encode(), "en")
    assert words.one[0] != words.one[1] and words.two[0] != words.two[1] and words.one[0] == words.one[2] and words.two[0] == words.two[2]
    assert phrases.read_words(a.encode(), "de").one[0] != words.one[0]


def test_phrases_of_one_hash_are_told_apart_by_the_other():
    n = lambda *x: phrases.np.array(x, phrases.np.uint64)
    held = [(n(5, 5, 1 << 63), n(9, 8, 7), phrases.np.array([1, 2, 3]), n(4, 6, 5)), (n(5, 5), n(8, 9), phrases.np.array([10, 20]), n(3, 7))]
    assert [x.tolist() for x in phrases._summed_pairs(held, whole=True)] == [[5, 5, 1 << 63], [8, 9, 7], [12, 21, 3], [3, 4, 5]]


def test_what_an_earlier_filter_has_by_mistake_is_counted_later():
    words, np = phrases.read_words(b"a b c", "en"), phrases.np
    by_length = {k: h for k, _, h in phrases.phrases_of(words, 3, None, False)}

    def bloom(*hashes):
        out = np.zeros(1 << (phrases.BLOOM_BITS - 6), np.int64)
        at, bits = phrases.filter_words(phrases._keys(np.concatenate(hashes)))
        out[at] = bits
        return out.view(np.uint64)

    before = bloom(words.one[1:], by_length[2])  # "a b" without "a"
    now = before | bloom(words.one)
    counted = [(k, i) for filters in ((before, False), (now, before)) for k, at, _ in phrases.phrases_of(words, 3, *filters) for i in at.tolist()]
    assert sorted(counted) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0)]
