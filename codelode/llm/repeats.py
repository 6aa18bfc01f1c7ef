"""Removal of repeated 100-byte strings by blockwise suffix comparison over a cover sample.

Every byte covered by a ``LENGTH``-byte window that also starts earlier (smaller doc_id, or the same document, earlier
start) is removed. A full suffix array of the corpus would be one row a byte; instead positions are sampled so that any
two equal windows hold a sampled position at the same offset, which is what a difference cover is for. The sample is
chosen by content, the least hash of ``GRAM`` bytes in each window, so it holds 2 in 70 positions whatever the shift:

1. ``Scan`` samples each text. A sampled position owns the run of windows whose least hash it is; its *key* hashes its
   gram, its *context* the bytes of all windows it owns.
2. Sampled positions meet by key, one bucket at a time. Equal contexts are long ties: all but the first lose their
   windows whole, without a look at bytes. A key with one context needs no more.
3. The first of each context under a key with several sends its bytes to that bucket, where the suffixes that start in it
   are ordered by their windows and positions, and all but the first of equal windows are marked. A bucket holds one
   context a passage and alignment, not one a copy. Keys with more than ``CROWD`` contexts send one row a window
   instead, which spreads by the window's hash.
4. Marked windows meet their text by document, where runs are united and cut.

Within a batch equal contexts (and windows of crowded keys) are settled before they are shuffled, so that a passage that
a third of all documents share costs one row a batch. Hashes have 64 bits.

Nulls and empty texts have no bytes. A null id takes no part and keeps its text. Rows that repeat one doc_id and text are
one document, each row gets its result; rows with one doc_id and different texts are not supported: an id is a place in the
corpus. Empty tables give empty results. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import materialize, small_batches, tidy

LENGTH = L = 100
GRAM = 32
SPAN = L - GRAM + 1
BITS = 20
CROWD = 4096
BATCH_BYTES = 4 << 20
#: Documents that need their text are told apart by this many hash buckets of ids at most (a broadcast of bounded size).
ID_BUCKETS = 1 << 20

_rng = np.random.default_rng(20240307)
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
P = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Scan:
    """The cover sample of one text: for each sampled position ``at`` the starts ``lo..hi`` of the windows it covers."""

    def __init__(self, data: bytes):
        self.n, self.size = 0, len(data)
        if len(data) < L:
            return
        h = BYTE[np.frombuffer(data, np.uint8)]
        for k in range(4):
            h = h[: -(1 << k)] * P[k] + h[1 << k :]
        self.h16 = h
        v = mixed(self._gram(len(data) - GRAM + 1))
        mask = np.uint64((1 << BITS) - 1)
        owners = []
        for start in range(0, len(data) - L + 1, (1 << BITS) - L):
            part = v[start : start + (1 << BITS) - L + SPAN - 1]
            u = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
            k = 1
            while 2 * k <= SPAN:
                u = np.minimum(u[:-k], u[k:])
                k *= 2
            owners.append((np.minimum(u[: len(part) - SPAN + 1], u[SPAN - k :]) & mask).astype(np.int64) + start)
        owner = np.concatenate(owners)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        self.lo, self.at = first, owner[first]
        self.hi = np.append(first[1:], len(owner)) - 1
        self.n = len(first)
        self.key = v[self.at]
        end = self.hi + L
        out = (self.at - self.lo).astype(np.uint64) * P[8] + (end - self.lo).astype(np.uint64) * P[9]
        for piece in (self.lo, (self.lo + end - 64) // 2, end - 64):
            for k in range(4):
                out = out * P[10 + k % 2] + self.h16[piece + 16 * k]
        self.ctx = mixed(out)

    def _gram(self, n: int) -> np.ndarray:
        """Hashes of the first ``n`` grams."""
        h, out = self.h16, None
        for at in [*range(0, GRAM - 16, 16), GRAM - 16]:
            out = h[at : at + n] * P[4] if out is None else (out + h[at : at + n]) * P[5]
        return out


def window_hashes(h16: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ``L`` bytes from each start, from hashes of 16 bytes."""
    out = np.zeros(len(starts), np.uint64)
    for k in (*range(0, L - 16, 16), L - 16):
        out = out * P[12] + h16[starts + k]
    return mixed(out)


def packed(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A sampled position with the starts it owns, in one integer."""
    return (lo.astype(np.int64) << 16) | ((at - lo).astype(np.int64) << 8) | (hi - lo).astype(np.int64)


def unpacked(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last start owned."""
    return where >> 16, (where >> 16) + (where & 0xFF)


def _pieces(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[tuple]]:
    """Rows in lists of about ``BATCH_BYTES`` of the second column."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(columns)), strict=True):
            values = tuple(x.as_py() for x in row)
            held.append(values)
            size += len(values[1] or b"")
            if size >= BATCH_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


_SAMPLED = "key long, context long, doc long, place long, settled boolean"


@tidy
def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _pieces(batches, 2):
        keys, contexts, docs, places = [], [], [], []
        for doc, data in rows:
            s = Scan(data or b"")
            if s.n:
                keys.append(s.key), contexts.append(s.ctx), docs.append(np.full(s.n, doc, np.int64)), places.append(packed(s.at, s.lo, s.hi))
        if not keys:
            continue
        key, context, doc, place = map(np.concatenate, (keys, contexts, docs, places))
        order = np.lexsort((place, doc, context, key))
        key, context, doc, place = key[order], context[order], doc[order], place[order]
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (context[1:] == context[:-1])])
        again = same & np.concatenate([[False], (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])])
        # What equals an earlier context of this batch is settled; it travels under a key of its own.
        key = np.where(same, mixed(doc.astype(np.uint64) * P[6] + place.astype(np.uint64)), key)
        kept = ~again
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[kept].astype(np.int64)), pa.array(context[kept].astype(np.int64)), pa.array(doc[kept]), pa.array(place[kept]), pa.array(same[kept])],
            ["key", "context", "doc", "place", "settled"],
        )


def sampled_positions(docs: DataFrame) -> DataFrame:
    """(doc, place, state) of the sampled positions of ``docs`` (doc, data) that matter.

    state 0: not the first of its context; 1: first, under a key with several contexts; 2: the same, and crowded.
    """
    sampled = docs.mapInArrow(_sample, _SAMPLED)
    by_context = W.partitionBy("key", "settled", "context")
    by_key = W.partitionBy("key", "settled").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seen = (
        sampled.repartition("key")
        .withColumn("first", F.first(F.struct("doc", "place")).over(by_context.orderBy("doc", "place")))
        .withColumn("leads", F.col("first") == F.struct("doc", "place"))
        .withColumn("one", F.min("context").over(by_key) == F.max("context").over(by_key))
        .withColumn("size", F.count("*").over(by_key))
    )
    state = F.when(F.col("settled") | ~F.col("leads"), 0).when(~F.col("one"), F.when(F.col("size") > CROWD, 2).otherwise(1))
    return seen.select("doc", "place", state.alias("state")).filter("state is not null").distinct()


def _with_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` that may be in ``ids`` (doc), and those that are not for certain."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS))
    # At most ID_BUCKETS numbers, whatever the number of documents.
    some = ids.select(bucket("doc").alias("_bucket")).distinct()
    keyed = docs.withColumn("_bucket", bucket("doc"))
    return tuple(keyed.join(F.broadcast(some), "_bucket", how).drop("_bucket") for how in ("left_semi", "left_anti"))


def _emit(docs, starts, ends, names=("doc", "start", "end")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (docs, starts, ends)], list(names))


def contexts_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(key, doc, start, data) of the given places (doc, place)."""
    listed = places.groupBy("doc").agg(F.collect_list("place").alias("places"))
    some, _ = _with_ids(docs, listed)

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches, 3):
            keys, own, starts, parts = [], [], [], []
            for doc, data, wanted in rows:
                s = Scan(data or b"")
                if s.n:
                    chosen = np.flatnonzero(np.isin(packed(s.at, s.lo, s.hi), np.array(wanted, np.int64)))
                    keys.append(s.key[chosen].astype(np.int64)), own.append(np.full(len(chosen), doc, np.int64)), starts.append(s.lo[chosen])
                    parts += [data[a : b + L] for a, b in zip(s.lo[chosen].tolist(), s.hi[chosen].tolist(), strict=True)]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(own)), pa.array(np.concatenate(starts).astype(np.int64)), pa.array(parts, pa.binary())],
                    ["key", "doc", "start", "data"],
                )

    return some.join(listed, "doc").select("doc", "data", "places").mapInArrow(cut, "key long, doc long, start long, data binary")


def _window_rows(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and start of each window of (doc, start, data) contexts."""
    h = BYTE[np.frombuffer(b"".join(r[2] for r in rows), np.uint8)]
    for k in range(4):
        h = h[: -(1 << k)] * P[k] + h[1 << k :]
    sizes = np.array([len(r[2]) for r in rows])
    n = sizes - L + 1
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(np.cumsum(sizes) - sizes, n) + within
    return window_hashes(h, starts), np.repeat(np.array([r[0] for r in rows]), n), np.repeat(np.array([r[1] for r in rows]), n) + within


def ordered(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows by hash and place, a document's repeated rows once, and which equal the one before."""
    order = np.lexsort((starts, docs, hashes))
    hashes, docs, starts = hashes[order], docs[order], starts[order]
    same = hashes[1:] == hashes[:-1]
    new = np.concatenate([[True], ~(same & (docs[1:] == docs[:-1]) & (starts[1:] == starts[:-1]))])
    hashes, docs, starts = hashes[new], docs[new], starts[new]
    return hashes, docs, starts, np.concatenate([[False], hashes[1:] == hashes[:-1]])


def later_windows(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (doc, start, end of the bytes covered) of the windows that equal an earlier one."""
    hashes, docs, starts, later = ordered(hashes, docs, starts)
    docs, starts = docs[later], starts[later]
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    if not len(docs):
        return docs, starts, starts
    cut = np.flatnonzero((np.diff(starts) > 1) | (np.diff(docs) != 0))
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(docs) - 1]])
    return docs[first], starts[first], starts[last] + L


@tidy
def _order_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; whole keys are taken, one bucket after the other, about ``BATCH_BYTES`` at a time."""
    held, size, last = [], 0, None
    for batch in batches:
        for key, doc, start, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if size >= BATCH_BYTES // 4 and key != last:
                yield _emit(*later_windows(*_window_rows(held)))
                held, size = [], 0
            held.append((doc, start, data))
            size += len(data)
            last = key
    if held:
        yield _emit(*later_windows(*_window_rows(held)))


@tidy
def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of crowded keys, the first of a batch with its hash, later ones settled (hash null)."""
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True))
        if not rows:
            continue
        hashes, docs, starts, later = ordered(*_window_rows(rows))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64), mask=later), pa.array(docs), pa.array(starts)], ["hash", "doc", "start"])


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """(doc, start, end) of bytes to remove, from ``docs`` (doc long, data binary); stretches may overlap."""
    places = materialize(sampled_positions(docs), "places")
    own = places.filter("state = 0").select("doc", F.expr("shiftright(place, 16)").alias("start"), F.expr(f"shiftright(place, 16) + (place & 255) + {L}").alias("end"))
    ordered = contexts_of(docs, places.filter("state = 1")).repartition("key").sortWithinPartitions("key")
    found = own.unionByName(ordered.mapInArrow(_order_buckets, "doc long, start long, end long"))
    crowd = places.filter("state = 2")
    if not crowd.isEmpty():
        windows = contexts_of(docs, crowd).mapInArrow(_crowded, "hash long, doc long, start long")
        spread = windows.withColumn("route", F.coalesce("hash", F.xxhash64("doc", "start")))
        first = F.first(F.struct("doc", "start")).over(W.partitionBy("route", "hash").orderBy("doc", "start"))
        later = spread.withColumn("first", first).filter(F.col("hash").isNull() | (F.col("first") != F.struct("doc", "start")))
        found = found.unionByName(later.select("doc", "start", (F.col("start") + L).alias("end")))
    return found


def cut_stretches(data: bytes, starts, ends) -> tuple[bytes, int]:
    """What is left of ``data``, and the number of maximal removed runs."""
    gone = np.zeros(len(data) + 1, np.int32)
    np.add.at(gone, np.minimum(np.asarray(starts, np.int64), len(data)), 1)
    np.add.at(gone, np.minimum(np.asarray(ends, np.int64), len(data)), -1)
    inside = np.cumsum(gone)[:-1] > 0
    spans = int(inside[:1].sum() + (np.diff(inside.astype(np.int8)) == 1).sum())
    return np.frombuffer(data, np.uint8)[~inside].tobytes(), spans


def _cut_udf(as_text: bool):
    kind = pa.string() if as_text else pa.binary()

    @F.arrow_udf(T.StructType([T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())]))
    @tidy
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for data, starts, ends in batches:
            kept, removed, spans = [], [], []
            for d, a, b in zip(data, starts, ends, strict=True):
                whole = d.as_py()
                left, n = cut_stretches(whole, a.values.to_numpy(), b.values.to_numpy()) if a.is_valid else (whole, 0)
                kept.append(left.decode("utf-8", "ignore") if as_text else left), removed.append(len(whole) - len(left)), spans.append(n)
            yield pa.StructArray.from_arrays([pa.array(kept, kind), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], ["kept", "n_removed", "n_spans"])

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """The input without the text, and n_bytes, n_removed, n_spans and kept: what is left of the text's bytes.

    ``as_text``: kept is a text, without the parts of characters that a cut has split. Columns of the input with the
    names of the results are replaced.
    """
    small_batches(docs.sparkSession)
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    results = {"n_bytes", "n_removed", "n_spans", "kept"}
    own = [c for c in docs.columns if c != text_col and c not in results]
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), data.alias("data"), F.struct(*[F.col(f"`{c}`") for c in own], F.lit(0).alias("_cut_none")).alias("_row"))
    found = materialize(repeated_stretches(rows.filter("doc is not null").select("doc", "data")).distinct(), "stretches")
    listed = found.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list(F.col("end")).alias("ends"))
    some, rest = _with_ids(rows, found.select("doc"))
    changed = some.join(listed, "doc", "left").withColumn("_cut", _cut_udf(as_text)(F.col("data"), F.col("starts"), F.col("ends")))
    size, zero = F.octet_length("data").cast("long").alias("n_bytes"), F.lit(0).cast("long")
    columns = [F.col("_row")[c].alias(c) for c in own]
    whole = F.col("data").cast("string") if as_text else F.col("data")
    return changed.select(*columns, size, "_cut.n_removed", "_cut.n_spans", "_cut.kept").unionByName(
        rest.select(*columns, size, zero.alias("n_removed"), zero.alias("n_spans"), whole.alias("kept"))
    )
