"""Phrases of words that go together, by Toivonen mining: a sample proposes, full passes count, until nothing is missing.

1. A sample of pieces of text (``SAMPLE`` of those of every document) counts all phrases of up to ``longest`` words; those
   at ``LOWERED`` of the share of ``least`` are proposed.
2. A full pass over every document is about the proposed phrases and their negative border: every phrase of which the part
   without the last and the part without the first word are proposed (every word is). It first counts them by 42 bits of
   their hash, which rules out nearly all that are rare: a hash never counts less than a phrase that has it.
3. A second one counts what is left by 128 bits, which are taken to tell phrases apart, and finds a document's digest for
   each phrase (the least of those that have it).
4. A phrase that is frequent but was not proposed is a failure of the border: longer phrases may have been left out. The
   failures are added, and the last pass counts what the grown set adds, and only that. It also goes on from every
   phrase that it is the first to count, so that it closes the set: any part of a frequent phrase is frequent, hence
   proposed, a failure, or counted first in this pass. The same pass spells each phrase of step 3, where its document or
   a copy of it is read and nowhere else: no row of words travels once for every task or text that has a phrase.

What is proposed, which hashes are frequent and what a document is to spell, tasks are told by Bloom filters of
``2 ** BLOOM_BITS`` bits, a fixed size at any scale; what they say too often is counted or spelled in vain and changes
nothing. Counts by hash travel as arrays, dealt over ``BUCKETS`` by the hash's first bits; words as rows (lang, phrase,
hash, n). Tasks sum what they have read before they send it. The driver gets the filters' bits alone.

Null texts are empty, a null language is ``und``. Languages are counted apart. Texts of any length are read whole, in runs
that end at a break; a phrase never crosses a break or a document. Repeated rows count as often as they stand. Tables
without words give no row. Columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, tidy

SAMPLE, LOWERED = 1 / 8, 0.35
BLOOM_BITS, PROBES, BUCKETS = 26, 4, 1024
#: Text that is counted at once, and counts by hash that a task holds before it sends them.
FLUSH_BYTES, HELD = 2 << 20, 1 << 22

#: What separates words, and what separates the pieces that phrases stay within.
LONG = 255  # bytes of a word from which on sums of powers would not do: they take some words of 1,024 bytes for equal
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + BLANKS + BREAKS, bytes(range(97, 123)) + b" " * len(BLANKS) + b"\n" * len(BREAKS))
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), base)], dtype=np.uint64)


@dataclass
class Words:
    """The words of a folded text: where they are, which piece they are in, two hashes of each, and a digest of its run."""

    text: bytes
    starts: np.ndarray
    ends: np.ndarray
    piece: np.ndarray
    one: np.ndarray
    two: np.ndarray
    source: np.ndarray | None = None

    def phrase(self, at: int, k: int) -> bytes:
        return b" ".join([self.text[s:e] for s, e in zip(self.starts[at : at + k].tolist(), self.ends[at : at + k].tolist(), strict=True)])


def read_words(text: bytes, lang: str) -> Words:
    raw = np.frombuffer(text, np.uint8)
    inside = (raw != 32) & (raw != 10)
    edges = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    size = ends - starts
    first = np.cumsum(size) - size
    own = raw[inside].astype(np.uint64) + np.uint64(1)
    within = np.arange(len(own)) - first.repeat(size)
    seed = np.array([xxhash.xxh64_intdigest(lang.encode())], np.uint64)
    longest = int(size.max()) if len(size) else 0
    hashes = [_mixed(np.add.reduceat(own * _powers(base, longest)[within], first) + seed * base) if len(size) else own for base in (_ONE, _TWO)]
    for i in np.nonzero(size > LONG)[0]:
        both = xxhash.xxh3_128_intdigest(text[starts[i] : ends[i]], int(seed[0]))
        hashes[0][i], hashes[1][i] = both & (1 << 64) - 1, both >> 64
    return Words(text, starts, ends, np.searchsorted(np.nonzero(raw == 10)[0], starts), *hashes)


def _keys(hashes: np.ndarray) -> np.ndarray:
    """The 42 bits by which phrases are counted and filtered."""
    return hashes >> np.uint64(22)


def _probes(keys: np.ndarray) -> list[np.ndarray]:
    spread = _mixed(keys * _TWO)
    step = (spread >> np.uint64(32)) | np.uint64(1)
    return [(spread + np.uint64(k) * step) & np.uint64((1 << BLOOM_BITS) - 1) for k in range(PROBES)]


def known(bloom: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter has each hash; no filter has all."""
    out = np.ones(len(hashes), bool)
    if bloom is not None:
        for at in _probes(_keys(hashes)):
            out &= (bloom[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).view(np.int64) == 1
    return out


def filter_words(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bits) of a filter that has the keys."""
    at = np.unique(np.concatenate(_probes(keys)))
    words, first = np.unique(at >> np.uint64(6), return_index=True)
    bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
    return words.view(np.int64), bits.view(np.int64)


def phrases_of(words: Words, longest: int, now: np.ndarray | None, before: np.ndarray | bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, first words, hashes) of the phrases whose two parts the filter ``now`` has, by their length k.

    ``before`` is the filter of an earlier pass: what that pass counted is left out, and what it did not is gone on from.
    False is no earlier pass.
    """
    hashes, n = words.one, len(words.one)
    there = fresh = np.ones(n, bool)
    if before is False:
        yield 1, np.arange(n), hashes
    else:
        fresh = np.zeros(n, bool)
    for k in range(2, min(longest, n) + 1):
        new = there & known(now, hashes)
        if before is not False:
            old = there & ~fresh & known(before, hashes)  # the earlier pass did not get to what is fresh, even if its filter has it
            new |= there & fresh
        n -= 1
        there = new[:n] & new[1 : n + 1] & (words.piece[:n] == words.piece[k - 1 :])
        hashes = _mixed(hashes[:n] * _ONE + words.one[k - 1 :])
        fresh = there if before is False else there & ~(old[:n] & old[1 : n + 1])
        at = np.nonzero(fresh)[0]
        if len(at):
            yield k, at, hashes[at]


def second_hash(words: Words, at: np.ndarray, k: int) -> np.ndarray:
    """Of the phrases of k words from the words ``at`` on."""
    return sum((words.two[at + j] * power for j, power in enumerate(_powers(_TWO, k))), np.zeros(len(at), np.uint64))


def _spelling(hashes: np.ndarray, source: np.ndarray) -> np.ndarray:
    """The hash by which a filter says that the run of a digest spells a phrase."""
    return _mixed(hashes + source * _TWO)


def _folded(text: bytes) -> Iterator[bytes]:
    """The folded text in runs that end at a break, of about ``FLUSH_BYTES`` where it has breaks."""
    text, start = text.translate(_FOLD), 0
    while len(text) - start > FLUSH_BYTES and (cut := text.find(b"\n", start + FLUSH_BYTES)) >= 0:
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def _block(runs: list[bytes], lang: str) -> Words:
    words = read_words(b"\n".join(runs), lang)
    starts = np.cumsum([0, *(len(r) + 1 for r in runs)])
    digests = np.array([xxhash.xxh64_intdigest(r) >> 32 for r in runs], np.uint64)
    words.source = digests.repeat(np.diff(np.searchsorted(words.starts, starts)))
    return words


def _read(batches: Iterator[pa.RecordBatch], share: float = 1) -> Iterator[tuple[str, Words]]:
    """Words of about ``FLUSH_BYTES`` of one language's texts at once; of ``share`` of their pieces."""
    chosen = np.random.default_rng(TaskContext.get().partitionId())
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for run in _folded((text or "").encode()):
                if share < 1:
                    pieces = run.split(b"\n")
                    run = b"\n".join([pieces[i] for i in np.nonzero(chosen.random(len(pieces)) < share)[0]])
                held.setdefault(lang, []).append(run)
                size += len(run)
                if size >= FLUSH_BYTES:
                    yield from ((x, _block(y, x)) for x, y in held.items())
                    held, size = {}, 0
    yield from ((x, _block(y, x)) for x, y in held.items())


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0] if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _summed_pairs(held: list[tuple[np.ndarray, ...]], whole: bool = False) -> tuple[np.ndarray, ...]:
    """(one, two, counts, least source); unless ``whole``, phrases that share ``one`` may stand more than once."""
    one, two, counts, source = (np.concatenate(x) for x in zip(*held, strict=True))
    if not len(one):
        return one, two, counts, source
    order = np.lexsort((two, one)) if whole else np.argsort(one)
    one, two = one[order], two[order]
    first = np.nonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])[0]
    return one[first], two[first], np.add.reduceat(counts[order], first), np.minimum.reduceat(source[order], first)


def _by_bucket(buckets: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row a bucket, with its values of each column as bytes; the buckets come sorted."""
    ends = np.searchsorted(buckets, np.arange(BUCKETS + 1))
    some = np.nonzero(np.diff(ends))[0]
    arrays = [pa.array([x[ends[b] : ends[b + 1]].tobytes() for b in some], pa.binary()) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(some), *arrays], ["bucket", *columns])


def _of_buckets(batches: Iterator[pa.RecordBatch], summed: Callable, **kinds: tuple[type, type]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(bucket, its summed columns), sent as the first of ``kinds`` and summed as the second; the rows come sorted by bucket."""
    bucket, held, size = None, [], 0
    for batch in batches:
        for b, *sent in zip(*(batch[c] for c in ("bucket", *kinds)), strict=True):
            if b.as_py() != bucket and held:
                yield bucket, summed(held)
                held, size = [], 0
            bucket = b.as_py()
            held.append(tuple(np.frombuffer(x.as_buffer(), kind).astype(wide) for x, (kind, wide) in zip(sent, kinds.values(), strict=True)))
            size += len(held[-1][0])
            if size > HELD:
                held = [summed(held)]
                size = len(held[0][0]) // 2
    if held:
        yield bucket, summed(held)


def _counts_by_hash(batches: Iterator[pa.RecordBatch], longest: int, now, share: float) -> Iterator[pa.RecordBatch]:
    """(bucket, keys, counts): counts of phrases by their hash."""
    now = now.value if now is not None else None
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def sent() -> pa.RecordBatch:
        keys, counts = _summed(held)
        return _by_bucket((keys >> np.uint64(32)).view(np.int64), keys=keys.astype(np.uint32), counts=np.minimum(counts, (1 << 32) - 1).astype(np.uint32))

    for _, words in _read(batches, share):
        for _, _, hashes in phrases_of(words, longest, now, False):
            keys, counts = np.unique(_keys(hashes), return_counts=True)
            held.append((keys, counts))
        if sum(len(k) for k, _ in held) > HELD:
            held = [_summed(held)]
            if len(held[0][0]) > HELD // 2:
                yield sent()
                held = []
    if held:
        yield sent()


def _frequent_words(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(word, bits) of a filter of the hashes counted ``least`` times or more."""
    for bucket, (keys, counts) in _of_buckets(batches, _summed, keys=(np.uint32, np.uint64), counts=(np.uint32, np.int64)):
        words, bits = filter_words((np.uint64(bucket) << np.uint64(32)) | keys[counts >= least])
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits)], ["word", "bits"])


def _counts_by_both(batches: Iterator[pa.RecordBatch], longest: int, now, frequent) -> Iterator[pa.RecordBatch]:
    """(bucket, one, two, counts, source): counts of the phrases whose hash ``frequent`` has, by both hashes."""
    held: list[tuple[np.ndarray, ...]] = []

    def sent() -> pa.RecordBatch:
        one, two, counts, source = _summed_pairs(held)
        return _by_bucket((one >> np.uint64(54)).view(np.int64), one=one, two=two, counts=counts, source=source.astype(np.uint32))

    for _, words in _read(batches):
        for k, at, hashes in phrases_of(words, longest, now.value, False):
            some = known(frequent.value, hashes)
            at = at[some]
            held.append(_summed_pairs([(hashes[some], second_hash(words, at, k), np.ones(len(at), np.int64), words.source[at])]))
        if sum(len(x[0]) for x in held) > HELD // 4:
            held = [_summed_pairs(held)]
            if len(held[0][0]) > HELD // 8:
                yield sent()
                held = []
    if held:
        yield sent()


def _frequent_counts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(one, two, n, source) of the phrases counted ``least`` times or more."""
    kinds = {"one": (np.uint64, np.uint64), "two": (np.uint64, np.uint64), "counts": (np.int64, np.int64), "source": (np.uint32, np.int64)}
    for _, columns in _of_buckets(batches, lambda held: _summed_pairs(held, whole=True), **kinds):
        some = columns[2] >= least
        yield pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)) for x in columns], ["one", "two", "n", "source"])


def _words_of_filter(batches: Iterator[pa.RecordBatch], before=None) -> Iterator[pa.RecordBatch]:
    """(word, bits) of counted phrases (one, source): of those that ``before`` lacks, or else of where they are spelled."""
    for batch in batches:
        one, source = (batch[c].to_numpy().view(np.uint64) for c in ("one", "source"))
        words, bits = filter_words(_keys(_spelling(one, source) if before is None else one[~known(before.value, one)]))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits)], ["word", "bits"])


def _spelled(batches: Iterator[pa.RecordBatch], longest: int, before, chosen, now) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, one, two, n): phrases that ``chosen`` has for their run, without n, and counts of what ``now`` adds.

    The empty phrase counts all words.
    """
    before, chosen, now = (b.value if b is not None else None for b in (before, chosen, now))
    held: dict[tuple[str, bytes], list] = {}
    size = 0

    def sent() -> pa.RecordBatch:
        langs, phrases = zip(*held, strict=True)
        one, two, n = zip(*held.values(), strict=True)
        arrays = [pa.array(langs), pa.array(phrases, pa.binary()).cast(pa.string()), *(pa.array(x, pa.int64()) for x in (one, two, n))]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "phrase", "one", "two", "n"])

    def found(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        for k, at, hashes in phrases_of(words, longest, before, False):
            some = known(chosen, _spelling(hashes, words.source[at]))
            yield k, at[some], hashes[some], False
        if now is not None:
            yield from ((*x, True) for x in phrases_of(words, longest, now, before))

    for lang, words in _read(batches):
        if len(words.one):
            held.setdefault((lang, b""), [None, None, 0])[2] += len(words.one)
        for k, at, hashes, counted in found(words):
            if not len(at):
                continue
            second = second_hash(words, at, k)
            order = np.argsort(hashes)
            # Two phrases of one hash are told apart by the second; should they alternate, each is met more than once.
            first = np.nonzero(np.r_[True, (np.diff(hashes[order]) != 0) | (np.diff(second[order]) != 0)])[0]
            own = order[first]
            for i, one, two, n in zip(at[own].tolist(), hashes[own].view(np.int64).tolist(), second[own].view(np.int64).tolist(), np.diff(np.r_[first, len(at)]).tolist(), strict=True):
                phrase = words.phrase(i, k)
                if (row := held.get((lang, phrase))) is None:
                    held[lang, phrase] = [one, two, n if counted else None]
                    size += len(phrase)
                elif counted:
                    row[2] += n
        if size > FLUSH_BYTES:
            yield sent()
            held, size = {}, 0
    if held:
        yield sent()


def _bits(words: DataFrame) -> np.ndarray:
    """A filter's bits, of its words (word, bits): at most ``2 ** (BLOOM_BITS - 6)`` rows reach the driver."""
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits.view(np.uint64)


def frequent_phrases(docs: DataFrame, text: str, lang: str, longest: int = 5, least: int = 100) -> DataFrame:
    """(lang, phrase, n) of all phrases of 1 to ``longest`` words that occur ``least`` times or more in their language.

    The phrase is space-joined; the empty phrase counts all words.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))

    def by_hash(now, share: float, at_least: int) -> np.ndarray:
        counted = rows.mapInArrow(tidy(lambda b: _counts_by_hash(b, longest, now, share)), "bucket bigint, keys binary, counts binary")
        dealt = counted.repartition("bucket").sortWithinPartitions("bucket")
        return _bits(dealt.mapInArrow(tidy(lambda b: _frequent_words(b, at_least)), "word bigint, bits bigint"))

    def filtered(counts: DataFrame, before=None) -> np.ndarray:
        return _bits(counts.select("one", "source").mapInArrow(tidy(lambda b: _words_of_filter(b, before)), "word bigint, bits bigint"))

    bits = by_hash(None, SAMPLE, max(2, int(SAMPLE * least * LOWERED)))
    before = spark.sparkContext.broadcast(bits)
    frequent = spark.sparkContext.broadcast(by_hash(before, 1, least))
    by_both = rows.mapInArrow(tidy(lambda b: _counts_by_both(b, longest, before, frequent)), "bucket bigint, one binary, two binary, counts binary, source binary")
    dealt = by_both.repartition("bucket").sortWithinPartitions("bucket")
    counts = scratch.write(dealt.mapInArrow(tidy(lambda b: _frequent_counts(b, least)), "one bigint, two bigint, n bigint, source bigint"), "counts")
    frequent.destroy()
    chosen = spark.sparkContext.broadcast(filtered(counts))
    more = filtered(counts, before)
    now = spark.sparkContext.broadcast(bits | more) if more.any() else None
    spelled = rows.mapInArrow(tidy(lambda b: _spelled(b, longest, before, chosen, now)), "lang string, phrase string, one bigint, two bigint, n bigint")
    spelled = spelled.groupBy("lang", "phrase").agg(F.first("one").alias("one"), F.first("two").alias("two"), F.sum("n").alias("more"))
    both = spelled.join(counts.select("one", "two", "n"), ["one", "two"], "full")
    phrase = F.coalesce("phrase", F.raise_error(F.lit("a counted phrase was not found again: the texts changed between two passes")))
    found = scratch.write(both.select("lang", phrase.alias("phrase"), F.coalesce("more", "n").alias("n")).filter(F.col("n") >= least), "phrases")
    scratch.drop(counts)
    for told in (before, chosen, now):
        if told is not None:
            told.destroy()
    return found


def _words(count: str) -> Column:
    """The first words of the column ``phrase``, or the last ones where the count is negative."""
    return F.expr(f"substring_index(phrase, ' ', {count})")


def collocations(docs: DataFrame, text: str, lang: str, longest: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words.

    ``a`` counts the phrase. Cut after its first k words, it has l and r occurrences of both parts and the score
    floor(1000 a n / (l r)), ``n`` words of the language in all; the cut with the lowest score counts, ties to the
    smallest k. A phrase goes if a longer frequent one that holds it occurs as often. Sorted by score and a, both
    descending, and the phrase's bytes.
    """
    counts = frequent_phrases(docs, text, lang, longest, least)
    words = F.split("phrase", " ")
    all_words = counts.filter("phrase = ''").select("lang", F.col("n").alias("total"))
    frequent = counts.filter("phrase <> ''").withColumn("k", F.size(words))
    # A longer phrase as frequent has one of one more word between: its parts without the last and the first word go.
    whole = frequent.filter("k > 2").select("lang", F.explode(F.array(_words("k - 1"), _words("1 - k"))).alias("phrase"), F.col("n").alias("a"))
    candidates = frequent.filter("k > 1").withColumnRenamed("n", "a").join(whole.distinct(), ["lang", "phrase", "a"], "left_anti")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k")
    cuts = cuts.withColumns({"left": _words("cut"), "right": _words("cut - k")})
    side = lambda name, n: frequent.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(all_words, "lang")
    score = F.expr("(cast(a as decimal(15,0)) * cast(total as decimal(18,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = scored.withColumn("score", score).groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = best.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("total").alias("n"), F.col("b.score").alias("score"))
    return flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
