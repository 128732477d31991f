"""Hard negatives by exact inner-product search in cover trees.

Every vector ``x`` is lifted onto a sphere: one more component brings its norm to the largest norm, while a query gets a zero
there, so inner products stay and a large inner product is a small distance. The tree over the lifted vectors has one upper level
for the whole table, whose centres are a bounded sample: a vector belongs to the cell of its nearest centre, and a cell's covering
radius is measured over all its vectors. A cell is cut into blocks of bounded size; each block has a cover tree of its own,
whose covering radii shrink from level to level. With the distance to a centre, a covering radius bounds all inner products below
that node from both sides.

A query asks for its first ``k`` vectors of the same (or of another) label with a score in a window. Queries first visit the few
cells of the highest bounds, which gives a score that their ``k``-th answer has at least; then they visit exactly those other cells
whose bounds reach it. Inside a block, queries descend together, best node first, and a node is
skipped once it lies outside every remaining window. Leaves are verified with exact integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Scratch, session_setting

SCALE = 256.0
POSITIVES = 5
NEGATIVES = 10
# The upper level has one centre for about this many vectors, at most this many centres and bytes of them.
BLOCK_VECTORS = 2048
MAX_CENTRES = 1024
CENTRE_BYTES = 32 * 1024 * 1024
# Queries of one task; cells that a query visits first.
CHUNK_QUERIES = 1024
FIRST_CELLS = 3
# A node of at most this many vectors is a leaf; radii shrink by this factor from level to level.
LEAF_VECTORS = 48
SHRINK = 1.3
# Integer vectors beyond this squared length could have scores that a long doesn't hold.
MAX_SQUARE = float(2**58)
EXACT_SQUARE = float(2**52)
LOWEST, HIGHEST = -(2**62), 2**62


# Vectors


def integer_vectors(vectors: DataFrame, columns: list[str], vector_col: str, scale: float) -> DataFrame:
    """``columns`` with ``v`` (floor(scale * x), 32-bit integers as bytes), ``dim`` and ``square``; unusable vectors are left out."""
    at = len(columns)
    kept = [T.StructField(f.name, f.dataType) for f in vectors.select(*columns).schema]
    schema = T.StructType([*kept, T.StructField("v", T.BinaryType()), T.StructField("dim", T.IntegerType()), T.StructField("square", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            starts = np.concatenate([[0], np.maximum(sizes, 0).cumsum()])
            for dim in np.unique(sizes[sizes >= 0]).tolist():
                rows = np.flatnonzero(sizes == dim)
                x = flat[starts[rows][:, None] + np.arange(dim)].reshape(len(rows), dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    x_ok = np.isfinite(x).all(axis=1)
                    whole = np.floor(scale * x)
                    square = np.where(x_ok, (whole * whole).sum(axis=1), np.inf)
                usable = np.flatnonzero(x_ok & (square < MAX_SQUARE))
                if len(usable):
                    data = whole[usable].astype("<i4")
                    arrays = [batch.column(c).take(pa.array(rows[usable])) for c in range(at)]
                    extra = [pa.array([r.tobytes() for r in data], pa.binary()), pa.array(np.full(len(usable), dim, np.int32)), pa.array(square[usable])]
                    yield pa.RecordBatch.from_arrays([*arrays, *extra], names=[*columns, "v", "dim", "square"])

    return vectors.select(*columns, vector_col).mapInArrow(run, schema)


def _matrix(column, dim: int) -> np.ndarray:
    """Vectors in bytes as rows of whole numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dim).astype(np.int64)


def lifted(x: np.ndarray, square: float) -> np.ndarray:
    """Rows with one more component that brings their squared length to ``square``."""
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0.0))])


def exact_scores(q: np.ndarray, x: np.ndarray, square: float) -> np.ndarray:
    """Integer inner products; below 2 ** 52 sums of doubles are exact and fast."""
    if square < EXACT_SQUARE:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q @ x.T


def score_bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query (rows of ``q``, not lifted) with any vector covered by each centre.

    Two bounds hold: by length, ``|q| r`` about the centre's own product, and by distance, since ``q.x = (|q|^2 + M^2 - d^2) / 2``
    and ``d`` differs from the distance to the centre (which needn't lie on the sphere) by at most ``r``.
    """
    product = q @ centres[:, :-1].T
    own = (q * q).sum(axis=1)[:, None]
    apart = np.sqrt(np.maximum(own + (centres * centres).sum(axis=1) - 2 * product, 0.0))
    by_length = np.sqrt(own) * radii
    least = np.maximum(product - by_length, (own + square - (apart + radii) ** 2) / 2)
    greatest = np.minimum(product + by_length, (own + square - np.maximum(apart - radii, 0.0) ** 2) / 2)
    # Distances near zero are off by up to 1e-8 of the lengths.
    slack = 1e-7 * (own + square) + 1e-6
    return least - slack, greatest + slack


# Trees


@dataclass
class CoverTree:
    """Nodes in one list, the root first: lifted centre, covering radius, children (``first`` to ``first + n``) or, for a
    leaf, vectors ``start`` to ``stop`` of ``order``."""

    centres: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    n: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    order: np.ndarray


def cover_tree(points: np.ndarray) -> CoverTree:
    """A cover tree of lifted points.

    A node covers its points within its radius. Its children's centres are chosen among its points, each the farthest from those
    chosen before, until every point is within the radius of the next level of a centre; a point goes to its nearest centre.
    Points that would be children of their own share a leaf.
    """
    nodes: list[list] = []
    order: list[np.ndarray] = []
    filled = 0

    def leaf(rows: np.ndarray) -> list:
        nonlocal filled
        centre = points[rows].mean(axis=0)
        radius = float(np.sqrt(((points[rows] - centre) ** 2).sum(axis=1).max()))
        order.append(rows)
        filled += len(rows)
        return [centre, radius, 0, 0, filled - len(rows), filled]

    everything = np.arange(len(points))
    centre = points.mean(axis=0)
    away = np.sqrt(((points - centre) ** 2).sum(axis=1))
    nodes.append([centre, float(away.max()), 0, 0, 0, 0])
    waiting = [(0, everything, float(away.max()))]
    while waiting:
        at, rows, radius = waiting.pop()
        reach = radius / SHRINK
        own = points[rows]
        chosen = [int(((own - nodes[at][0]) ** 2).sum(axis=1).argmin())]
        nearest = np.sqrt(((own - own[chosen[0]]) ** 2).sum(axis=1))
        home = np.zeros(len(rows), int)
        # Where even many centres leave points uncovered, the points are spread evenly and smaller balls don't exist.
        most = max(2, len(rows) // 8)
        while nearest.max() > reach and len(chosen) < most:
            far = int(nearest.argmax())
            away = np.sqrt(((own - own[far]) ** 2).sum(axis=1))
            closer = away < nearest
            home[closer], nearest[closer] = len(chosen), away[closer]
            chosen.append(far)
        children, alone = [], []
        for k in range(len(chosen)):
            members = rows[home == k]
            if len(members) <= 2:
                alone.append(members)
            elif len(members) <= LEAF_VECTORS or len(members) == len(rows) or nearest[home == k].max() == 0:
                children.extend((leaf(part), None, 0.0) for part in np.array_split(members, -(-len(members) // LEAF_VECTORS)))
            else:
                covering = float(nearest[home == k].max())
                children.append(([points[rows[chosen[k]]], covering, 0, 0, 0, 0], members, covering))
        if alone:
            single = np.concatenate(alone)
            children.extend((leaf(part), None, 0.0) for part in np.array_split(single, -(-len(single) // LEAF_VECTORS)))
        nodes[at][2:4] = [len(nodes), len(children)]
        for node, members, covering in children:
            if members is not None:
                waiting.append((len(nodes), members, covering))
            nodes.append(node)
    columns = list(zip(*nodes))
    return CoverTree(np.array(columns[0]), np.array(columns[1]), *[np.array(c, int) for c in columns[2:]], np.concatenate(order))


@dataclass
class Queries:
    """Queries of one task: vectors, wanted labels (coded), rows never to return, windows of scores."""

    vectors: np.ndarray
    label: np.ndarray
    row: np.ndarray
    low: np.ndarray
    high: np.ndarray


def search_tree(
    tree: CoverTree, x: np.ndarray, label: np.ndarray, row: np.ndarray, square: float, asked: Queries, k: int, same: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, position, score``: at least the first ``k`` of each query in the block, exactly those within its window.

    The queries that still need a node travel with it. ``floor`` is the least score a query still wants: the low end of its window
    or, if higher, its ``k``-th score so far; equal scores stay wanted, since ids decide among them.
    """
    vectors = asked.vectors.astype(float)
    floor = asked.low.copy()
    best = np.full((len(floor), k), LOWEST, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    coded = label[tree.order]

    def open_(nodes: np.ndarray, queries: np.ndarray) -> None:
        least, greatest = score_bounds(vectors[queries], tree.centres[nodes], tree.radii[nodes], square)
        wanted = (greatest >= floor[queries][:, None]) & (least <= asked.high[queries][:, None])
        for at, node in enumerate(nodes.tolist()):
            mask = wanted[:, at]
            if mask.any():
                heapq.heappush(heap, (-float(greatest[mask, at].max()), node, queries[mask], greatest[mask, at]))

    heap: list[tuple] = []
    open_(np.zeros(1, int), np.flatnonzero(asked.low <= asked.high))
    while heap:
        _, node, queries, greatest = heapq.heappop(heap)
        queries = queries[greatest >= floor[queries]]
        if not len(queries):
            continue
        if tree.n[node]:
            open_(np.arange(tree.first[node], tree.first[node] + tree.n[node]), queries)
            continue
        span = slice(tree.start[node], tree.stop[node])
        rows = tree.order[span]
        score = exact_scores(asked.vectors[queries], x[rows], square)
        fits = (coded[span][None, :] == asked.label[queries][:, None]) == same
        fits &= row[rows][None, :] != asked.row[queries][:, None]
        fits &= (score >= floor[queries][:, None]) & (score <= asked.high[queries][:, None])
        a, b = np.nonzero(fits)
        if len(a):
            found.append((queries[a], rows[b], score[a, b]))
            kept = np.where(fits, score, LOWEST)
            merged = np.concatenate([best[queries], kept], axis=1)
            best[queries] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
            floor[queries] = np.maximum(floor[queries], best[queries].min(axis=1))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    query, position, score = (np.concatenate(c) for c in zip(*found))
    last = score >= floor[query]
    return query[last], position[last], score[last]


# Index and search


@dataclass
class Index:
    """Centres by vector size with their largest squared length, cells (bounded by the centres) and the table of blocks."""

    centres: dict[int, tuple[np.ndarray, float]]
    cells: dict[int, tuple[np.ndarray, np.ndarray]]
    blocks: DataFrame


def build_index(vectors: DataFrame, scratch: Scratch, k: int) -> Index:
    """Index ``vectors`` (``_row, id, label, v, dim, square``), every row of it.

    Of rows equal in vector and label only the ``k`` of the smallest ids can be among anyone's first ``k``; a crowd of
    copies beyond them is left out by that, and by nothing else.
    """
    order = Window.partitionBy("dim", "label", "v").orderBy(F.col("id").asc_nulls_last(), "_row")
    entries = scratch.table(vectors.withColumn("_copy", F.row_number().over(order)).filter(F.col("_copy") <= k).drop("_copy"), "entries")
    sizes = {r["dim"]: (r["n"], r["square"]) for r in entries.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square")).collect()}
    total = sum(n for n, _ in sizes.values())
    share = min(1.0, MAX_CENTRES * BLOCK_VECTORS / max(1, total), *[CENTRE_BYTES * BLOCK_VECTORS / (8 * (dim + 1) * total) for dim in sizes])
    # Drawn by the vector's hash: about n / BLOCK_VECTORS of each size. Results don't depend on the draw.
    drawn = entries.filter(F.pmod(F.xxhash64("v"), F.lit(2**40)) < int(2**40 * share / BLOCK_VECTORS)).select("dim", "v").distinct()
    samples: dict[int, list] = {dim: [] for dim in sizes}
    for r in sorted(drawn.collect(), key=lambda r: (r["dim"], bytes(r["v"]))):
        samples[r["dim"]].append(np.frombuffer(r["v"], "<i4").astype(np.int64))
    centres = {dim: (lifted(np.stack(own) if own else np.zeros((1, dim)), sizes[dim][1]), sizes[dim][1]) for dim, own in samples.items()}

    schema = T.StructType([*entries.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
    at_dim, at_v = entries.columns.index("dim"), entries.columns.index("v")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(at_dim).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                points = lifted(_matrix(part.column(at_v), dim), centres[dim][1])
                nearest = _squared(points, centres[dim][0]).argmin(axis=1)
                away = np.sqrt(((points - centres[dim][0][nearest]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nearest.astype(np.int32)), pa.array(away)], names=schema.names)

    placed = scratch.table(entries.mapInArrow(place, schema), "placed")
    found = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    found = scratch.table(found.withColumn("blocks", F.ceil(F.col("n") / BLOCK_VECTORS).cast("int")), "cells")
    cells: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in sizes:
        own = sorted((r["cell"], r["radius"]) for r in found.filter(F.col("dim") == dim).collect())
        cells[dim] = np.array([c for c, _ in own], int), np.array([r for _, r in own])
    blocked = placed.join(F.broadcast(found.select("dim", "cell", "blocks")), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("_row"), F.col("blocks")).cast("int"))
    return Index(centres, cells, scratch.table(block_trees(blocked, centres), "trees"))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


_TREE = ["centres", "radii", "first", "n", "start", "stop", "order"]


def block_trees(blocked: DataFrame, centres: dict[int, tuple[np.ndarray, float]]) -> DataFrame:
    """One row per block: its vectors, ids, labels and rows, and its cover tree as bytes; about a megabyte for 64 components."""
    kinds = {f.name: f.dataType for f in blocked.schema.fields}
    fields = [
        T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("ids", T.ArrayType(kinds["id"])), T.StructField("labels", T.ArrayType(kinds["label"])), T.StructField("rows", T.BinaryType()),
        T.StructField("v", T.BinaryType()), *[T.StructField(f"tree_{name}", T.BinaryType()) for name in _TREE],
    ]

    def build(table: pa.Table) -> pa.Table:
        dim, cell, block = (table[c][0].as_py() for c in ("dim", "cell", "block"))
        x = _matrix(table["v"], dim)
        tree = cover_tree(lifted(x, centres[dim][1]))
        values = [dim, cell, block, table["id"].to_pylist(), table["label"].to_pylist(), table["_row"].to_numpy().astype(np.int64).tobytes(), x.astype("<i4").tobytes()]
        values += [getattr(tree, name).tobytes() for name in _TREE]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(table["id"].type), pa.list_(table["label"].type), *[pa.binary()] * (2 + len(_TREE))]
        return pa.table([pa.array([v], t) for v, t in zip(values, types)], names=[f.name for f in fields])

    needed = blocked.select("dim", "cell", "block", "_row", "id", "label", "v")
    return needed.groupBy("dim", "cell", "block").applyInArrow(build, T.StructType(fields))


def visits(index: Index, queries: DataFrame, first: bool) -> DataFrame:
    """``queries`` with ``cells``: the ``FIRST_CELLS`` of the highest bounds, or all others that the query's window reaches.

    Queries have ``q, label, own, v, dim, low, high`` and, for the second time, ``seen``, the cells visited first.
    """
    schema = T.StructType([*queries.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    at = {c: queries.columns.index(c) for c in ("v", "dim", "low", "high")}
    centres, cells = index.centres, index.cells

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(at["dim"]).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in cells:
                    continue
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                numbers, radii = cells[dim]
                least, greatest = score_bounds(_matrix(part.column(at["v"]), dim).astype(float), centres[dim][0][numbers], radii, centres[dim][1])
                wanted = (greatest >= part.column(at["low"]).to_numpy()[:, None]) & (least <= part.column(at["high"]).to_numpy()[:, None])
                if first:
                    best = np.argsort(np.where(wanted, -greatest, np.inf), axis=1)[:, :FIRST_CELLS]
                    lists = [b[w[b]] for b, w in zip(best, wanted)]
                else:
                    lists = [np.flatnonzero(w) for w in wanted]
                lists = [numbers[own].tolist() for own in lists]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.list_(pa.int32()))], names=schema.names)

    found = queries.mapInArrow(run, schema)
    return found if first else found.withColumn("cells", F.array_except("cells", "seen"))


def search_cells(index: Index, asked: DataFrame, k: int, same: bool, scratch: Scratch) -> DataFrame:
    """``q, id, row, score`` from the cells that ``asked`` (see ``visits``) names; per block at least a query's first ``k``."""
    met = scratch.table(asked.select("q", "label", "own", "v", "dim", "low", "high", F.explode("cells").alias("cell")), "met")
    # At most one row per cell, so as many as there are centres.
    loads = F.broadcast(met.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK_QUERIES).cast("int").alias("chunks")))
    counted = F.broadcast(index.blocks.groupBy("dim", "cell").agg((F.max("block") + 1).alias("blocks")))
    keys = ["dim", "cell", "block", "chunk"]
    left = met.join(loads, ["dim", "cell"]).join(counted, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*keys, "q", "label", "own", "v", "low", "high")
    right = index.blocks.join(loads, ["dim", "cell"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    id_type = index.blocks.schema["ids"].dataType.elementType
    centres = index.centres
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", id_type), T.StructField("row", T.LongType()), T.StructField("score", T.LongType())])

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        kind = blocks.schema.field("ids").type.value_type
        empty = pa.table([pa.array([], t) for t in (pa.int64(), kind, pa.int64(), pa.int64())], names=["q", "id", "row", "score"])
        if not queries.num_rows or not blocks.num_rows:
            return empty
        block = blocks.slice(0, 1).to_pylist()[0]
        dim = block["dim"]
        square = centres[dim][1]
        x = np.frombuffer(block["v"], "<i4").reshape(-1, dim).astype(np.int64) if dim else np.zeros((len(block["ids"]), 0), np.int64)
        numbers = {value: i for i, value in enumerate(dict.fromkeys(block["labels"]))}
        tree = CoverTree(
            np.frombuffer(block["tree_centres"], float).reshape(-1, dim + 1), np.frombuffer(block["tree_radii"], float),
            *[np.frombuffer(block[f"tree_{name}"], int) for name in _TREE[2:]],
        )
        asked = Queries(
            _matrix(queries["v"], dim), np.array([numbers.get(value, -1) for value in queries["label"].to_pylist()]),
            *[queries[c].to_numpy() for c in ("own", "low", "high")],
        )
        rows = np.frombuffer(block["rows"], np.int64)
        query, position, score = search_tree(tree, x, np.array([numbers[value] for value in block["labels"]]), rows, square, asked, k, same)
        ids = pa.array(block["ids"], kind).take(pa.array(position))
        return pa.table([queries["q"].to_numpy()[query], ids, rows[position], score], names=["q", "id", "row", "score"])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def first_answers(index: Index, queries: DataFrame, k: int, same: bool, scratch: Scratch) -> DataFrame:
    """``q, rank, id, row, score``: the first ``k`` answers of each query, higher scores first, ties by smaller id (null last)."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    start = scratch.table(visits(index, queries, True), "asked")
    early = scratch.table(ranked(search_cells(index, start, k, same, scratch)).drop("rank"), "early")
    reached = early.groupBy("q").agg(F.min("score").alias("_floor"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).drop("_n")
    following = start.withColumnRenamed("cells", "seen").join(reached, "q", "left")
    following = following.withColumn("low", F.greatest("low", F.coalesce("_floor", "low"))).drop("_floor")
    late = search_cells(index, visits(index, following, False), k, same, scratch)
    return scratch.table(ranked(early.union(late)), "answers")


def hard_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (30, 90), scale: float = SCALE, scratch: Scratch | None = None,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``anchors`` (a condition) names.

    Components become ``floor(scale * x)``; a score is the integer inner product. An anchor's positives are its first other rows of the
    same label; for each, the negatives are the first rows of another label whose score is ``window`` per cent of the
    positive's (null labels and vectors, and vectors with a null or infinite component, take no part; nor do integer vectors of a squared
    length of 2 ** 58 or more, whose scores a long needn't hold). Only vectors of one size are compared; an empty vector
    scores 0. Rows are told apart by position, so repeated rows and ids are rows of their own; null ids come last among ties. A
    pair without negatives gives no row, an empty table an empty result; further columns are ignored.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    with session_setting(vectors.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch="2000"):
        taken = vectors.filter(F.col(label_col).isNotNull()).select(
            F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).alias("_vector"),
        )
        rows = scratch.table(integer_vectors(taken, ["_row", "id", "label", "anchor"], "_vector", scale), "vectors")
        index = build_index(rows.drop("anchor"), scratch, max(positives + 1, negatives))
        own = rows.filter("anchor").select(F.col("_row").alias("q"), "id", "label", F.col("_row").alias("own"), "v", "dim")
        wanted = own.drop("id").withColumns({"low": F.lit(LOWEST).cast("bigint"), "high": F.lit(HIGHEST).cast("bigint")})
        near = first_answers(index, wanted, positives, True, scratch)
        pairs = near.select("q", F.col("id").alias("positive_id"), F.col("rank").alias("place"), F.col("score").alias("positive_score")).join(own, "q")
        # 100 * negative lies between window[0] and window[1] times positive: the least and the greatest such integer.
        asked = pairs.withColumns({
            "low": F.expr(f"CAST((positive_score * {window[0]} + pmod(-positive_score * {window[0]}, 100)) div 100 AS bigint)"),
            "high": F.expr(f"CAST((positive_score * {window[1]} - pmod(positive_score * {window[1]}, 100)) div 100 AS bigint)"),
        })
        # Positives of one score share a window, which the first of them names.
        asked = asked.withColumn("first", F.min("place").over(Window.partitionBy("q", "positive_score")))
        asked = scratch.table(asked.filter("low <= high").withColumn("w", F.col("q") * positives + F.col("first") - 1), "windows")
        wanted = asked.filter("place = first").select(F.col("w").alias("q"), "label", "own", "v", "dim", "low", "high")
        far = first_answers(index, wanted, negatives, False, scratch)
    far = far.select(F.col("q").alias("w"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = asked.select("w", F.col("id").alias("anchor_id"), "positive_id", "positive_score")
    return named.join(far, "w").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
