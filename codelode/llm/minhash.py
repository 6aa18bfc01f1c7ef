"""Near-duplicates by MinHash, banding, verification and connected components.

1. Words and ``width``-word shingles of whole texts, ``bands * rows`` universal hash minima and a digest of the shingle
   set, in one Arrow pass. Documents with one set are one class, and only classes are compared.
2. The minima's bands deal the classes into buckets. A class of which less than ``percent`` of the shingles occur in any
   other class of the buckets can be linked with nothing (the intersection is too small already) and leaves them.
3. Within a bucket no pairs are listed. One hub, the class that meets most others in its buckets, is compared with the
   rest. Then, as long as a bucket holds classes of different components, more and more of those outside its largest
   component (``HUBS``, then ``MORE`` times as many each round, up to ``MOST_HUBS``) are compared with all outside their
   own, and leave the bucket. So every two of a bucket are compared or end in one component, whatever the bucket's size.
   A bucket's rows are dealt over tasks by ``SALT_ROWS``; its hubs go to each of them once, before the rows.
4. A comparison first takes a bound from both profiles (how many shingles that any other class has fall into each of
   ``2 ** SEGMENT_BITS`` segments of the hash range), which is never below the similarity, then a signature estimate
   (``SIGMAS`` deviations below the threshold). What passes is confirmed on the full sets.
5. Components of the confirmed links by alternating large-star and small-star.

A pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^32 = 5e-8 and fails the estimate with 4e-6.

Texts without words have an empty set and are linked with nothing. Null ids keep a row of their own with a null
component. Repeated rows get the same answer each; where one id has several texts, each is compared, and each row gets
the least id that its own text reaches. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import Scratch, tidy
from .components import components

BANDS, ROWS = 32, 4
HUBS, MORE, MOST_HUBS = 256, 4, 16_384
#: Rows of a bucket in one task (at least four times the hubs, which each of its tasks gets), and comparisons made at once.
SALT_ROWS, PAIRS = 1_024, 16_384
SEGMENT_BITS = 6
#: A segment's count that stands for "so many or more".
FULL = 65_535
SIGMAS = 4.5
#: Ids of documents whose sets are needed are broadcast up to this many (8 bytes each), else joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240229)
A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
P = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.array([], np.uint64)
    own = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(own.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = out * P + h[i : len(h) - k + 1 + i]
    return np.unique(mixed(out))


def minima(shingles: np.ndarray) -> np.ndarray:
    """For each hash function the least upper half of ``A x + B`` modulo 2^64."""
    out = np.full(len(A), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(out, (shingles[None, at : at + 1024] * A[:, None] + B[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(minima_: np.ndarray) -> np.ndarray:
    rows = minima_.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * P + rows[:, k])
    return key.astype(np.int64)


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key, sig (the last byte of each minimum), bands; the last three null for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                if len(s):
                    m = minima(s)
                    out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), (m & np.uint32(255)).astype(np.uint8).tobytes(), band_keys(m)))
                else:
                    out.append((0, None, None, None))
            if ids:
                n, keys, sigs, bands = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>")


@F.arrow_udf(T.LongType())
@tidy
def shared_size(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Size of the intersection of two sets of 64-bit integers."""
    for a, b in batches:
        sets = ((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(a, b, strict=True))
        yield pa.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets], pa.int64())


def histogram(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall into each segment of the hash range."""
    return np.bincount((shingles >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64), minlength=1 << SEGMENT_BITS)


def full_sets(docs: DataFrame, classes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, n, shingles) of ``classes`` (doc, set_key, node), one row each."""

    @F.arrow_udf(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("shingles", T.BinaryType())]))
    @tidy
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets = [shingle_set(t.as_py(), width).tobytes() for t in texts]
            yield pa.StructArray.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["key", "shingles"])

    wanted = classes.select(F.col("doc").alias("_doc"), F.col("set_key").alias("_key"), "node")
    if wanted.count() <= MAX_BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text")).join(wanted, "_doc")
    sets = rows.withColumn("_set", of(F.col("_text"))).filter("_set.key = _key").select("node", "_set.shingles")
    # A class's document has one row, unless the input repeats it; then the rows are equal.
    one = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    return one.select("node", (F.octet_length("shingles") / 8).cast("long").alias("n"), "shingles")


def profiles(sets: DataFrame, percent: int) -> DataFrame:
    """(node, size, profile) of the sets that may have links.

    The profile has, by segment of the hash range, how many shingles some other of ``sets`` has too. Two sets share no
    more than the sum over segments of the smaller count, and only what is in both profiles; a set of which less than
    ``percent`` is in its profile has no link and no row.
    """

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            own = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, [len(x) for x in own])), pa.array(np.concatenate(own))], ["node", "shingle"])

    @F.arrow_udf("binary")
    @tidy
    def profile(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for shingles, alone in batches:
            out = []
            for own, not_shared in zip(shingles, alone, strict=True):
                n = histogram(np.frombuffer(own.as_buffer(), np.uint64))
                if not_shared.is_valid:
                    n = n - histogram(not_shared.values.to_numpy().view(np.uint64))
                out.append(np.minimum(n, FULL).astype("<u2").tobytes())
            yield pa.array(out, pa.binary())

    each = sets.select("node", "shingles").mapInArrow(rows, "node long, shingle long")
    single = each.groupBy("shingle").agg(F.count("*").alias("_n"), F.min("node").alias("node")).filter("_n = 1")
    alone = single.groupBy("node").agg(F.collect_list("shingle").alias("alone"))
    shared = F.col("n") - F.coalesce(F.size("alone"), F.lit(0))
    some = sets.join(alone, "node", "left").filter(100 * F.when(F.col("alone").isNull(), F.col("n")).otherwise(shared) >= percent * F.col("n"))
    return some.select("node", F.col("n").alias("size"), profile(F.col("shingles"), F.col("alone")).alias("profile"))


_COMPARED = ["bucket", "salt", "is_row", "node", "component", "size", "profile", "sig"]


def _matcher(percent: int, least: int):
    """Over rows sorted by bucket, salt and hubs first: (u, v) of a row and a hub that may be similar enough."""

    def possible(i: np.ndarray, j: np.ndarray, ids, comps, sizes, prof, sigs) -> np.ndarray:
        ok = (comps[i] != comps[j]) & (ids[i] != ids[j]) & (100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j]))
        i, j = i[ok], j[ok]
        low = np.minimum(prof[i], prof[j])
        most = np.where((low == FULL).any(axis=1), np.minimum(sizes[i], sizes[j]), low.sum(axis=1, dtype=np.int64))
        ok = 100 * most >= percent * (sizes[i] + sizes[j] - most)
        i, j = i[ok], j[ok]
        ok = (sigs[i] == sigs[j]).sum(axis=1) >= least
        return np.stack([ids[i[ok]], ids[j[ok]]])

    @tidy
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if hubs is not None:
                batch = pa.Table.from_batches([hubs, batch]).combine_chunks().to_batches()[0]
            bucket, salt, is_row, ids, comps, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            prof, sigs = (np.frombuffer(b"".join(batch.column(k).to_pylist()), kind).reshape(len(ids), -1) for k, kind in ((6, "<u2"), (7, np.uint8)))
            cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(ids)]])
            n_hubs = np.add.reduceat(1 - is_row.astype(np.int64), starts)
            found, left, right, size = [], [], [], 0
            for a, b, h in zip(starts.tolist(), ends.tolist(), n_hubs.tolist(), strict=True):
                step = max(1, PAIRS // max(1, h))
                for k in range(a + h, b, step):
                    r = np.arange(k, min(b, k + step))
                    left.append(np.repeat(r, h)), right.append(np.tile(np.arange(a, a + h), len(r)))
                    size += len(r) * h
                    if size >= PAIRS:
                        found.append(possible(np.concatenate(left), np.concatenate(right), ids, comps, sizes, prof, sigs))
                        left, right, size = [], [], 0
            if left:
                found.append(possible(np.concatenate(left), np.concatenate(right), ids, comps, sizes, prof, sigs))
            hubs = batch.slice(int(starts[-1]), int(n_hubs[-1]))
            if found:
                pairs = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=0)), pa.array(pairs.max(axis=0))], ["u", "v"])

    return match


def possible_pairs(rows: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """(u, v) of rows and hubs of one bucket, in different components, that bound and signature allow.

    Both have bucket, node, component, size, profile and sig, ``rows`` also salt and salts: a bucket's rows are dealt by
    their salt, and its hubs go to each of the salts.
    """
    s = percent / 100
    s += (1 - s) / 256  # two different minima share their last byte
    n = BANDS * ROWS
    least = int(n * s - SIGMAS * (n * s * (1 - s)) ** 0.5)
    first = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("is_row", F.lit(0).cast("byte"))
    met = first.select(*_COMPARED).unionByName(rows.withColumn("is_row", F.lit(1).cast("byte")).select(*_COMPARED))
    met = met.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "is_row")
    return met.mapInArrow(_matcher(percent, least), "u long, v long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if needed.count() <= MAX_BROADCAST_IDS:
        sets = sets.join(F.broadcast(needed), "node", "left_semi")
    of = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"s_{c}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").withColumn("shared", shared_size(F.col("s_u"), F.col("s_v")))
    return both.filter(100 * F.col("shared") >= percent * (F.col("n_u") + F.col("n_v") - F.col("shared"))).select("u", "v")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; links are pairs with ``100 * shared >= percent * united``."""
    scratch = Scratch(docs.sparkSession)
    signed = scratch.write(signatures(docs, width, id_col, text_col), "signed")
    classes = (
        signed.filter("set_key is not null and doc_id is not null").groupBy("set_key")
        .agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = scratch.write(classes, "classes")
    every = classes.select(F.explode("bands").alias("bucket"), "node")
    shared = every.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = scratch.write(every.join(shared, "bucket"), "buckets")
    # How many a class meets in its buckets: an original meets more than its altered copies do, and is the better hub.
    ids = scratch.write(buckets.groupBy("node").agg(F.sum("n").alias("met")), "ids")
    sets = scratch.write(full_sets(docs, classes.join(ids, "node", "left_semi").select("doc", "set_key", "node"), width, id_col, text_col), "sets")
    bounds = profiles(sets, percent).join(classes.select("node", "sig"), "node").join(ids, "node")
    bounds = scratch.write(bounds, "bounds")
    rows = buckets.select("bucket", "node").join(bounds.select("node", "met"), "node")
    state = rows.withColumn("component", F.col("node"))
    comps, most = docs.sparkSession.createDataFrame([], "node long, component long"), 1
    while True:
        state = scratch.write(_dealt(state, most), "state")
        if most == 1:
            hub = state.groupBy("bucket").agg(F.min(F.struct(-F.col("met"), F.col("node").alias("node")))["node"].alias("node"))
        else:
            # The first in this order that fit into the round; the order within a salt first, so that no task sorts a bucket.
            order = [F.desc("met"), F.col("node")]
            own = F.row_number().over(W.partitionBy("bucket", "salt").orderBy(*order))
            some = state.filter("component <> largest").withColumn("_k", own).filter(F.col("_k") <= most)
            hub = some.withColumn("_k", F.row_number().over(W.partitionBy("bucket").orderBy(*order))).filter(F.col("_k") <= most).select("bucket", "node")
        hub = scratch.write(hub, "hubs")
        if hub.isEmpty():
            break
        profiled = state.join(bounds.drop("met"), "node")
        pairs = scratch.write(possible_pairs(profiled, profiled.join(hub, ["bucket", "node"], "left_semi"), percent), "pairs")
        if not pairs.isEmpty():
            # The stars found so far stand for the links that made them.
            stars = comps.select(F.col("node").alias("u"), F.col("component").alias("v"))
            comps = components(stars.unionByName(confirmed(pairs, sets, percent)), scratch)
        left = state.select("bucket", "node", "met").join(hub, ["bucket", "node"], "left_anti").join(comps, "node", "left")
        state = left.withColumn("component", F.coalesce("component", "node"))
        most = HUBS if most == 1 else min(most * MORE, MOST_HUBS)

    named = classes.select("set_key", "doc", "node").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = scratch.write(named.join(least, "component").select("set_key", "component_id"), "named")
    scratch.drop_all_but(signed, named)
    return signed.join(named, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def _dealt(rows: DataFrame, hubs: int) -> DataFrame:
    """The rows (bucket, node, met, component) of buckets with several components, with their largest, and salts by their size."""
    size = max(SALT_ROWS, 4 * hubs)
    kinds = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed_ = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.min(F.struct(-F.col("n"), F.col("component").alias("component"))).alias("_top")).filter("kinds > 1")
    sized = mixed_.select("bucket", F.col("_top.component").alias("largest"), F.ceil(F.col("n") / size).cast("int").alias("salts"))
    out = rows.select("bucket", "node", "met", "component").join(sized, "bucket")
    return out.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
