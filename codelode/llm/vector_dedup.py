"""Near-duplicates of vectors by cosine: tiles in the order of principal components, compared dimension block by block.

1. Equal vectors are one class; only one vector of each is compared.
2. The second moments of all unit vectors give the principal axes. Along the leading ones, ``LEAD`` of them, a bounded
   sample (``SAMPLE_ROWS`` projections, the least digests) sets median cuts; the rows of each cell lie in one order and
   become tiles of ``TILE_ROWS``.
3. Two tiles meet only where the boxes of their leading coordinates and residual norms come closer than two vectors at
   the threshold can be. Boxes are sent to the tasks in blocks of at most ``BOXES`` tiles.
4. In a pair of tiles, the leading products and the product of the residual norms are summed first: where they stay below
   the threshold, the cosine cannot reach it. What is left adds the next dimensions, with the bound taken again after
   each block of them, to the end. A sum within ``MARGIN`` of the threshold is decided by the plain double-precision
   cosine of the given components. The leading sums are single precision with ``SLACK`` allowed for their rounding.
5. A tile pair sends the number of links of each of its vectors, and a spanning forest of its links, never the links.
   Components by large-star and small-star.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows with a null id
(their component is null). Vectors of different lengths link with nothing. Rows that repeat an id are vectors of their
own. An empty table gives no row. Columns of other names are not read.

Work on vectors without any close structure stays n^2 / 2 leading sums, in tile pairs: that is the method's, the boxes
and bounds only lower it; the shuffle of tiles is n^2 / TILE_ROWS rows then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy
from .components import components

TILE_ROWS, LEAD, STRIDE = 4096, 12, 16
SAMPLE_ROWS, MAX_DEPTH, BOXES = 1 << 14, 10, 1 << 16
MARGIN, SLACK, ROWS_AT_ONCE = 1e-9, 1e-5, 256
#: Rows of one class are dealt over so many tasks when results are joined to them.
SALTS = 16


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; powers of two first, so that squares neither vanish nor overflow."""
    wide = vectors.astype(np.float64)
    wide = np.ldexp(wide, -np.frexp(np.abs(wide).max(1))[1][:, None])
    return wide / np.sqrt((wide * wide).sum(1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def principal_axes(reps: DataFrame, size: int) -> np.ndarray:
    """Columns are the axes of the unit vectors' second moments, the largest first; ``size ** 2`` numbers reach the driver."""

    def moments(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                u = unit(_matrix(batch["v"]))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["at", "m"])

    total = np.zeros(size * size)
    for r in reps.select("v").mapInArrow(tidy(moments), "at bigint, m double").groupBy("at").agg(F.sum("m").alias("m")).collect():
        total[r["at"]] = r.m
    values, axes = np.linalg.eigh(total.reshape(size, size))
    return axes[:, np.argsort(-values)]


def cell_cuts(sample: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(axis, cut) of each node by level: medians along the axis of the widest spread."""
    nodes, levels = [sample], []
    for _ in range(depth):
        axes = [int(np.argmax(x.std(0))) if len(x) else 0 for x in nodes]
        cuts = [float(np.median(x[:, a])) if len(x) else 0.0 for x, a in zip(nodes, axes, strict=True)]
        levels.append((np.array(axes), np.array(cuts)))
        nodes = [part for x, a, c in zip(nodes, axes, cuts, strict=True) for part in (x[x[:, a] < c], x[x[:, a] >= c])]
    return levels


def cell_of(lead: np.ndarray, levels) -> np.ndarray:
    cell = np.zeros(len(lead), np.int64)
    for axes, cuts in levels:
        cell = cell * 2 + (lead[np.arange(len(lead)), axes[cell]] >= cuts[cell])
    return cell


def joined_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (least index) after the links a-b are added."""
    while True:
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]
        if not len(a):
            return labels
        least = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], least)
        np.minimum.at(labels, labels[b], least)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def compare(a: np.ndarray, b: np.ndarray, same: bool, threshold: float, axes: np.ndarray, weights_a: np.ndarray, weights_b: np.ndarray):
    """(links of a, links of b, component labels over a and b) of two tiles' given vectors; ``same`` is a tile with itself."""
    ua, ub = unit(a), unit(b)
    qa, qb = ua @ axes, ub @ axes
    size = qa.shape[1]
    ends = list(range(min(LEAD, size), size, STRIDE)) + [size]
    rest = [(np.sqrt((qa[:, e:] ** 2).sum(1)), np.sqrt((qb[:, e:] ** 2).sum(1))) for e in ends]
    first = np.float32(threshold - SLACK)
    # The residual norms are one more coordinate, so that sum and bound are one product.
    left = np.concatenate([qa[:, : ends[0]], rest[0][0][:, None]], 1).astype(np.float32)
    right = np.ascontiguousarray(np.concatenate([qb[:, : ends[0]], rest[0][1][:, None]], 1).astype(np.float32).T)
    links_a, links_b, labels = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), np.arange(len(a) + (0 if same else len(b)))
    for start in range(0, len(a), ROWS_AT_ONCE):
        reach = (left[start : start + ROWS_AT_ONCE] @ right) >= first
        many = np.count_nonzero(reach) * 8 > reach.size
        if many:  # most pairs go on: the remaining products as one
            product = qa[start : start + ROWS_AT_ONCE] @ qb.T
            i, j = np.nonzero(product >= threshold - MARGIN)
            total = product[i, j]
            i += start
            if same:
                up = i < j
                total, i, j = total[up], i[up], j[up]
        else:
            i, j = np.nonzero(reach)
            i += start
            if same:
                i, j = i[i < j], j[i < j]
            total = np.einsum("ij,ij->i", qa[i, : ends[0]], qb[j, : ends[0]])
            for k in range(1, len(ends)):
                total = total + np.einsum("ij,ij->i", qa[i, ends[k - 1] : ends[k]], qb[j, ends[k - 1] : ends[k]])
                on = total + rest[k][0][i] * rest[k][1][j] >= threshold - MARGIN
                i, j, total = i[on], j[on], total[on]
        close = np.abs(total - threshold) <= MARGIN
        if close.any():
            x, y = a[i[close]].astype(np.float64), b[j[close]].astype(np.float64)
            total[close] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
        sure = total >= threshold
        i, j = i[sure], j[sure]
        np.add.at(links_a, i, weights_b[j])
        np.add.at(links_a if same else links_b, j, weights_a[i])
        labels = joined_labels(labels, i, j + (0 if same else len(a)))
    return links_a, links_b, labels


def _tiled(batches: Iterator[pa.RecordBatch], axes: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows (cell, lead, digest, n, v) as tiles of one cell each."""
    task, made = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []

    def tile() -> pa.RecordBatch:
        nonlocal made
        table = pa.Table.from_batches(held).combine_chunks()
        v = _matrix(table["v"].combine_chunks())
        q = unit(v) @ axes
        lead, rest = q[:, :LEAD], np.sqrt((q[:, LEAD:] ** 2).sum(1))[:, None]
        box = np.concatenate([lead, rest], 1)
        row = [[(task << 20) + made], [len(v)], [v.astype(np.float64 if v.dtype == np.float64 else np.float32).tobytes()], [table["n"].to_numpy().astype(np.int64).tobytes()], [table["digest"].to_pylist()], [np.stack([box.min(0), box.max(0)]).tobytes()]]
        made += 1
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        cells = batch["cell"].to_numpy()
        for start, end in zip(*(lambda c: (c[:-1], c[1:]))(np.r_[0, np.nonzero(np.diff(cells))[0] + 1, len(cells)]), strict=True):
            part = batch.slice(start, end - start)
            while part.num_rows:
                if held and (held[0]["cell"][0] != part["cell"][0] or sum(b.num_rows for b in held) == TILE_ROWS):
                    yield tile()
                    held = []
                held.append(part.slice(0, TILE_ROWS - sum(b.num_rows for b in held)))
                part = part.slice(held[-1].num_rows)
    if held:
        yield tile()


def _meeting(box: np.ndarray, boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Whether vectors in the boxes can reach the threshold: their squared distance would be at most 2 - 2 threshold."""
    gap = np.maximum(np.maximum(boxes[:, 0] - box[1], box[0] - boxes[:, 1]), 0)
    return (gap * gap).sum(1) <= 2 - 2 * threshold + SLACK


def _links_of_length(reps: DataFrame, size: int, threshold: float, scratch: Scratch, dtype: np.dtype) -> tuple[DataFrame, DataFrame]:
    """(node, digest, links) and forest (u, v) of the vectors of one length; ``reps`` has digest, n, v."""
    spark = reps.sparkSession
    axes = principal_axes(reps, size)
    shape = "digest binary, n bigint, v array<" + reps.schema["v"].dataType.elementType.simpleString() + ">"

    def projected(batches):
        for batch in batches:
            if batch.num_rows:
                q = unit(_matrix(batch["v"])) @ axes[:, :LEAD]
                yield pa.RecordBatch.from_arrays([batch["digest"], pa.array(list(q))], ["digest", "lead"])

    n = reps.count()
    depth = min(MAX_DEPTH, max(0, (-(-n // TILE_ROWS) - 1).bit_length()))
    sample = reps.select("digest", "v").orderBy("digest").limit(SAMPLE_ROWS).mapInArrow(tidy(projected), "digest binary, lead array<double>").collect() if depth else []
    levels = cell_cuts(np.array([r.lead for r in sample]), depth) if depth else []

    def celled(batches):
        for batch in batches:
            if batch.num_rows:
                lead = unit(_matrix(batch["v"])) @ axes[:, :LEAD]
                yield pa.RecordBatch.from_arrays([pa.array(cell_of(lead, levels)), pa.array(lead[:, 0]), batch["digest"], batch["n"], batch["v"]], ["cell", "lead", "digest", "n", "v"])

    arrow = pa.schema([("tile", pa.int64()), ("rows", pa.int64()), ("vectors", pa.binary()), ("weights", pa.binary()), ("digests", pa.list_(pa.binary())), ("box", pa.binary())])
    cells = reps.select("digest", "n", "v").mapInArrow(tidy(celled), "cell bigint, lead double, " + shape).repartition(max(1, 1 << depth), "cell").sortWithinPartitions("cell", "lead", "digest")
    tiles = scratch.write(cells.mapInArrow(tidy(lambda b: _tiled(b, axes, arrow)), "tile bigint, rows bigint, vectors binary, weights binary, digests array<binary>, box binary"), "tiles")
    n_tiles = tiles.count()
    blocks = -(-n_tiles // BOXES)
    pairs = None
    for block in range(blocks):
        own = tiles.select("tile", "box")
        some = own.filter(F.pmod(F.xxhash64("tile"), F.lit(blocks)) == block).collect()  # about BOXES boxes
        ids, boxes = np.array([r.tile for r in some]), np.array([np.frombuffer(r.box) for r in some]).reshape(len(some), 2, -1)

        def met(batches, ids=ids, boxes=boxes):
            for batch in batches:
                for tile, box in zip(*batch.columns, strict=True):
                    tile, box = tile.as_py(), np.frombuffer(box.as_py()).reshape(2, -1)
                    other = ids[_meeting(box, boxes, threshold) & (ids >= tile)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), tile)), pa.array(other)], ["a", "b"])

        part = own.mapInArrow(tidy(met), "a bigint, b bigint")
        pairs = part if pairs is None else pairs.unionByName(part)
    tasks = min(max(n_tiles, spark.sparkContext.defaultParallelism), 2048)
    side = lambda s: tiles.select(F.col("tile").alias(s), F.col("vectors").alias(f"v{s}"), F.col("weights").alias(f"w{s}"))
    facing = pairs.join(side("a"), "a").repartition(tasks, "b").join(side("b").repartition(tasks, "b"), "b")

    def linked(batches):
        for batch in batches:
            for a, b, va, wa, vb, wb in zip(*(batch[c] for c in ("a", "b", "va", "wa", "vb", "wb")), strict=True):
                a, b = a.as_py(), b.as_py()
                x, y = (np.frombuffer(v.as_py(), dtype).reshape(-1, size) for v in (va, vb))
                links_x, links_y, labels = compare(x, y, a == b, threshold, axes, *(np.frombuffer(w.as_py(), np.int64) for w in (wa, wb)))
                nodes = (a << 20) + np.arange(len(x))
                links = links_x
                if a != b:
                    nodes, links = np.r_[nodes, (b << 20) + np.arange(len(y))], np.r_[links, links_y]
                some = np.nonzero(links)[0]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[labels[some]])], ["node", "links", "root"])

    found = scratch.write(facing.select("a", "b", "va", "wa", "vb", "wb").mapInArrow(tidy(linked), "node bigint, links bigint, root bigint"), "found")
    nodes = tiles.select("tile", F.posexplode("digests").alias("_at", "digest")).select((F.shiftleft("tile", 20) + F.col("_at")).alias("node"), "digest")
    links = found.groupBy("node").agg(F.sum("links").alias("links")).join(nodes, "node")
    return links, found.select(F.col("node").alias("u"), F.col("root").alias("v"))


def near_vectors(df: DataFrame, id_: str, vector: str, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id) of every row, as the module says; links are pairs with a cosine of ``threshold`` or more.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id reachable by links.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    v = F.col(vector)
    dtype = np.dtype(np.float32 if df.schema[vector].dataType.elementType.simpleString() == "float" else np.float64)
    good = F.coalesce(F.col(id_).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    # The digest of the components' exact texts; a negative zero is a zero.
    digest = F.unhex(F.md5(F.concat_ws(",", F.transform(v, lambda x: F.when(x == 0, "0").otherwise(x.cast("string"))))))
    rows = scratch.write(df.select(F.col(id_).alias("vec_id"), F.when(good, digest).alias("digest")), "rows")
    classes = scratch.write(rows.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")), "classes")
    one = df.select(F.col(id_).alias("first"), F.when(good, digest).alias("digest"), v.alias("v")).join(classes, ["digest", "first"]).dropDuplicates(["digest"])
    reps = scratch.write(one.select("digest", "n", "v"), "reps")
    links, forest = None, None
    for r in reps.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():  # as many as there are lengths
        own, edges = _links_of_length(reps.filter(F.size("v") == r.d), r.d, threshold, scratch, dtype)
        shift = lambda c, d=r.d: F.struct(F.lit(d).alias("d"), F.col(c).alias("at"))
        own, edges = own.withColumn("node", shift("node")), edges.select(shift("u").alias("u"), shift("v").alias("v"))
        links, forest = (own, edges) if links is None else (links.unionByName(own), forest.unionByName(edges))
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    links = scratch.write(links.join(classes, "digest"), "links")
    nodes = scratch.write(components(forest, scratch), "nodes")
    grouped = links.select("node", "digest", "links", "first").join(nodes, "node").select("component", "digest", "links", "first")
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = grouped.join(least, "component").select("digest", "links", "component_id")
    # Only classes with a link or a copy have anything to tell; the others' rows keep their own ids.
    told = classes.join(linked, "digest", "left").filter("n > 1 or links is not null").select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    salted = told.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    out = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "_salt"], "left")
    out = scratch.write(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")), "vectors")
    scratch.drop_all_but(out)
    return out

