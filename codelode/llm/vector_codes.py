"""Vector codes: each vector as one codebook entry a part, codebooks by dual-tree Lloyd rounds in whole numbers.

1. Components become ``floor(scale * x)``, and vectors are cut into ``parts`` equal consecutive parts.
2. Blocks of ``BLOCK_ROWS`` vectors carry, for each part position, a tree over their parts: halves along the widest
   component down to leaves of ``LEAF_ROWS``, with the box, the sum and the count of every leaf cached; the boxes and sums
   of the nodes above follow from two children each. The blocks are written once and read by every round.
3. In a round, this tree and a tree over the part position's entries go down together. A pair of nodes is dropped where
   its least distance exceeds the largest distance of another entry node that the same parts still have. A node with one
   entry left is assigned whole, by its cached sum; in the leaves that stay uncertain, every part is measured in whole
   numbers against the entries left. Only a strictly farther entry is ever dropped, so ties stay and go to the lower index.
4. Tasks send sums and counts by part, entry and component, which Spark adds; the driver gets
   ``parts * entries * (width + 1)`` numbers a round, whatever the number of vectors.

Left out: null vectors, vectors with null or non-finite components, and those not of the commonest length that ``parts``
divides (ties to the shorter). Fewer vectors than entries give fewer entries; no vector gives no row. Rows that repeat an
id are rows of their own; ties of ids are ordered by components, null ids last. Components saturate at the magnitude at
which squared distances would leave 63 bits (32,768 before scaling for 64 components), sums of errors at 2^63 - 1. Columns
of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

BLOCK_ROWS, LEAF_ROWS = 4096, 32
#: Labels up to this number of rows are sent to every task; more are joined with salted keys.
MAX_BROADCAST_LABELS, LABEL_SALTS = 1 << 16, 16


@dataclass
class Tree:
    """Nodes of one part position, leaves last: ``lo``, ``hi`` and ``sums`` by level, ``starts`` of the leaves."""

    lo: list[np.ndarray]
    hi: list[np.ndarray]
    sums: list[np.ndarray]
    starts: np.ndarray


def leaf_starts(rows: int) -> np.ndarray:
    """Ends of the ``2 ** k`` leaves of at most about ``LEAF_ROWS`` rows, the first start before them."""
    depth = max(0, (-(-rows // LEAF_ROWS) - 1).bit_length())
    return np.arange((1 << depth) + 1) * rows >> depth


def tree_order(points: np.ndarray) -> np.ndarray:
    """The order of rows in which every node of the tree is a run: halves by the widest component."""
    order, bounds = np.arange(len(points)), leaf_starts(len(points))
    width = len(bounds) - 1
    while width > 1:
        for k in range(0, len(bounds) - 1, width):
            start, middle, end = bounds[k], bounds[k + width // 2], bounds[k + width]
            own = points[order[start:end]]
            along = own[:, np.argmax(own.max(0) - own.min(0))]
            order[start:end] = order[start:end][np.argpartition(along, middle - start)]
        width //= 2
    return order


def grown(lo: np.ndarray, hi: np.ndarray, sums: np.ndarray, starts: np.ndarray) -> Tree:
    """The tree above its leaves."""
    tree = Tree([lo], [hi], [sums], starts)
    while len(tree.lo[0]) > 1:
        tree.lo.insert(0, np.minimum(tree.lo[0][::2], tree.lo[0][1::2]))
        tree.hi.insert(0, np.maximum(tree.hi[0][::2], tree.hi[0][1::2]))
        tree.sums.insert(0, tree.sums[0][::2] + tree.sums[0][1::2])
    return tree


def entry_levels(entries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The entries' tree as (lo, hi, parent) by level; the last level has one entry a node, in index order."""
    levels, groups = [], [(np.arange(len(entries)), 0)]
    while True:
        levels.append(([g for g, _ in groups], np.array([p for _, p in groups])))
        if all(len(g) == 1 for g, _ in groups):
            break
        halves = []
        for parent, (g, _) in enumerate(groups):
            own = entries[g]
            g = g[np.argsort(own[:, np.argmax(own.max(0) - own.min(0))], kind="stable")]
            halves += [(part, parent) for part in (g[: len(g) // 2], g[len(g) // 2 :]) if len(part)]
        groups = halves
    out = [(np.array([entries[g].min(0) for g in gs]), np.array([entries[g].max(0) for g in gs]), parent) for gs, parent in levels]
    place = np.argsort([g[0] for g in levels[-1][0]])
    out[-1] = tuple(x[place] for x in out[-1])
    return out


def assign(points: np.ndarray, tree: Tree, entries: np.ndarray, levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest entry by row in tree order, sums and counts by entry)."""
    n_leaves = len(tree.starts) - 1
    nearest, sums, counts = np.full(len(points), -1), np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    nodes, left = np.array([0]), np.ones((1, 1), bool)
    for depth in range(max(len(tree.lo), len(levels))):
        at, to = min(depth, len(tree.lo) - 1), min(depth, len(levels) - 1)
        if 0 < depth < len(tree.lo):
            nodes, left = (nodes[:, None] * 2 + [0, 1]).ravel(), left.repeat(2, 0)
        lo, hi, parent = levels[to]
        if 0 < depth < len(levels):
            left = left[:, parent]
        below, above = lo[None] - tree.hi[at][nodes, None], tree.lo[at][nodes, None] - hi[None]
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
        most = (np.maximum(hi[None] - tree.lo[at][nodes, None], tree.hi[at][nodes, None] - lo[None]) ** 2).sum(2)
        left &= least <= np.where(left, most, np.iinfo(np.int64).max).min(1)[:, None]
        if to == len(levels) - 1:
            sure = left.sum(1) == 1
            for node, entry in zip(nodes[sure], left[sure].argmax(1), strict=True):
                span = n_leaves >> at
                start, end = tree.starts[node * span], tree.starts[(node + 1) * span]
                nearest[start:end] = entry
                sums[entry] += tree.sums[at][node]
                counts[entry] += end - start
            nodes, left = nodes[~sure], left[~sure]
            if not len(nodes):
                break
    if len(nodes):
        rows = np.concatenate([np.arange(tree.starts[k], tree.starts[k + 1]) for k in nodes])
        own = points[rows].astype(np.int64)
        far = ((own[:, None] - entries[None]) ** 2).sum(2)
        far[~left.repeat(tree.starts[nodes + 1] - tree.starts[nodes], 0)] = np.iinfo(np.int64).max
        nearest[rows] = best = far.argmin(1)
        np.add.at(sums, best, own)
        counts += np.bincount(best, minlength=len(entries))
    return nearest, sums, counts


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, width: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, v) as blocks with their trees' orders and leaves."""

    def block(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        cut = _matrix(table["v"].combine_chunks(), parts * width).reshape(-1, parts, width).astype(np.int32)
        orders, points, leaves = [], [], []
        for k in range(parts):
            order = tree_order(cut[:, k])
            own, starts = cut[order, k], leaf_starts(len(order))[:-1]
            orders.append(order.astype(np.int16))
            points.append(own)
            leaves.append(np.stack([np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts), np.add.reduceat(own.astype(np.int64), starts)]).astype(np.int64))
        row = [[table["id"].to_pylist()], [table["label"].to_pylist()], *[[np.stack(x).tobytes()] for x in (orders, points, leaves)]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, BLOCK_ROWS - sum(b.num_rows for b in held)))
            batch = batch.slice(held[-1].num_rows)
            if sum(b.num_rows for b in held) == BLOCK_ROWS:
                yield block(pa.Table.from_batches(held))
                held = []
    if held:
        yield block(pa.Table.from_batches(held))


def _trees(batches: Iterator[pa.RecordBatch], parts: int, width: int):
    """(ids, labels, [(order, points, tree) by part]) of stored blocks."""
    for batch in batches:
        for ids, labels, orders, points, leaves in zip(*batch.columns, strict=True):
            n = len(ids)
            order = np.frombuffer(orders.as_py(), np.int16).reshape(parts, n)
            point = np.frombuffer(points.as_py(), np.int32).reshape(parts, n, width)
            leaf = np.frombuffer(leaves.as_py(), np.int64).reshape(parts, 3, -1, width)
            yield ids, labels, [(order[k], point[k], grown(*leaf[k], leaf_starts(n))) for k in range(parts)]


def codebook_digest(books: np.ndarray) -> str:
    """Hex SHA-256 of all entries' components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(df: DataFrame, id_: str, vector: str, label: str, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error, label_error), codebooks) as the module says; a code has two hex digits a part.

    The codebooks start from the vectors with the smallest ids, ascending; an entry that no part chooses stays.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    id_type, label_type = df.schema[id_].dataType.simpleString(), df.schema[label].dataType.simpleString()
    out_schema = f"id {id_type}, label {label_type}, code string, error bigint"
    v = F.col(vector)
    finite = df.filter(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    lengths = [r for r in finite.groupBy(F.size(v).alias("d")).count().filter(F.col("d") > 0).filter(F.col("d") % parts == 0).orderBy(F.desc("count"), "d").limit(1).collect()]
    if not lengths:
        return spark.createDataFrame([], out_schema + ", label_error bigint"), np.zeros((parts, 0, 0), np.int64)
    width = lengths[0].d // parts
    most = isqrt((1 << 62) // (parts * width)) // 2
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-most))), F.lit(float(most)))).cast("int"))
    rows = finite.filter(F.size(v) == parts * width).select(F.col(id_).alias("id"), F.col(label).alias("label"), whole.alias("v"))
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    block_schema = f"ids array<{id_type}>, labels array<{label_type}>, orders binary, points binary, leaves binary"
    arrow = pa.schema([("ids", pa.list_(_arrow(rows, "id"))), ("labels", pa.list_(_arrow(rows, "label"))), ("orders", pa.binary()), ("points", pa.binary()), ("leaves", pa.binary())])
    blocks = scratch.write(rows.mapInArrow(tidy(lambda batches: _blocks(batches, parts, width, arrow)), block_schema), "blocks")

    def tallied(books: np.ndarray):
        def tally(batches):
            levels = [entry_levels(b) for b in books]
            total = np.zeros((*books.shape[:2], width + 1), np.int64)
            for _, _, trees in _trees(batches, parts, width):
                for k, (_, points, tree) in enumerate(trees):
                    _, sums, counts = assign(points, tree, books[k], levels[k])
                    total[k, :, :width] += sums
                    total[k, :, width] += counts
            at = np.nonzero(total.any(2))
            if len(at[0]):
                where = np.ravel_multi_index(at, total.shape[:2]).repeat(width + 1)
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.tile(np.arange(width + 1), len(at[0]))), pa.array(total[at].ravel())], ["entry", "place", "n"])

        return blocks.mapInArrow(tidy(tally), "entry bigint, place bigint, n bigint").groupBy("entry", "place").agg(F.sum("n").alias("n"))

    for _ in range(rounds):
        total = np.zeros((books.shape[0] * books.shape[1], width + 1), np.int64)
        for r in tallied(books).collect():  # parts * entries * (width + 1) numbers
            total[r.entry, r.place] = r.n
        used = total[:, width] > 0
        flat = books.reshape(-1, width).copy()
        flat[used] = total[used, :width] // total[used, width:]
        books = flat.reshape(books.shape)

    def coded(batches):
        levels = [entry_levels(b) for b in books]
        for ids, labels, trees in _trees(batches, parts, width):
            codes, errors = np.empty((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
            for k, (order, points, tree) in enumerate(trees):
                nearest, _, _ = assign(points, tree, books[k], levels[k])
                codes[order, k] = nearest
                errors[order] += ((points.astype(np.int64) - books[k][nearest]) ** 2).sum(1)
            texts = codes.tobytes().hex()
            code = pa.array([texts[i : i + 2 * parts] for i in range(0, len(texts), 2 * parts)])
            yield pa.RecordBatch.from_arrays([ids.values, labels.values, code, pa.array(errors)], ["id", "label", "code", "error"])

    codes = scratch.write(blocks.mapInArrow(tidy(coded), out_schema), "codes")
    scratch.drop(blocks)
    most_sum = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by_label = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most_sum).cast("bigint").alias("label_error"))
    by_label = scratch.write(by_label.withColumnRenamed("label", "_label"), "labels")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if by_label.count() <= MAX_BROADCAST_LABELS:
        joined = codes.join(F.broadcast(by_label), same)
    else:
        salted = by_label.withColumn("_salt", F.explode(F.array(*map(F.lit, range(LABEL_SALTS)))))
        joined = codes.withColumn("_own", F.pmod(F.xxhash64("id", "code"), F.lit(LABEL_SALTS)).cast("int")).join(salted, same & (F.col("_own") == F.col("_salt")))
    return joined.select("id", "label", "code", "error", "label_error"), books


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
