"""Tree ensembles grown level by level from one binned table, all folds and parameter draws of a search together.

Features become bin numbers once. A level of all trees, whatever fold, draw or repeat they belong to, is one aggregate over the
rows: per tree, open node, feature and bin the weight and the weighted target, from which every split of the level follows. Rows are
read, never moved or copied per fit: which rows a tree is fitted on follows from the fold numbers a row carries, its
weight in a tree from hashes of row and tree. Trees that are the same so far share one sum, told apart by inner fold. Tasks add up histograms of bounded size, so a level of many nodes takes several passes.

Targets are whole multiples of a small unit. Sums of them are exact in any order, so a tree doesn't depend on the layout of
the table, and a fit inside a search equals the same fit alone.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import hash32, poisson64
from ..functions.draws import mix64 as _mix
from ..functions.draws import uniform64 as _uniform
from ..functions.text import finite
from ..runtime import BROADCAST_MAX_BYTES, Scratch, local_table
from .selection import quantile_edges

BINS = 32
# Histograms that a task holds at once; a level that needs more takes several passes over the table.
HISTOGRAM_BYTES = 48 * 1024 * 1024
# Boosting writes the predictions so far after this many rounds; in between they follow from the trees since.
STATE_ROUNDS = 8
# What such a table of predictions may hold; more fits than that are boosted in groups, one after the other.
STATE_BYTES = 4 * 1024**3
# A binned table up to this size is sent to all tasks, and every boosted fit grows in a task of its own.
LOCAL_BYTES = BROADCAST_MAX_BYTES
# Tables below this size are dealt to all cores.
SMALL_ROWS = 4_000_000
MAX_DEPTH = 8
ALL = -1

@dataclass(frozen=True)
class TreeParams:
    """How an ensemble is grown.

    ``node_features`` and ``tree_features``: share of the features (or ``"sqrt"``) that a node may split on, and that a tree sees.
    ``sampling``: ``"bootstrap"`` (Poisson weights) or the share of the rows a tree sees. ``random_cuts``: one random threshold per node
    and feature instead of the best one. ``l2`` shrinks leaves and gains. With a ``learning_rate`` the trees are boosted, otherwise averaged.
    ``columns`` restricts a fit to some of the table's features, by position.
    """

    n_trees: int = 100
    max_depth: int = 6
    min_leaf: float = 1
    node_features: float | str = 1.0
    tree_features: float | str = 1.0
    sampling: float | str = 1.0
    random_cuts: bool = False
    l2: float = 0.0
    learning_rate: float | None = None
    columns: tuple[int, ...] | None = None

    def __post_init__(self):
        if not 1 <= self.max_depth <= MAX_DEPTH:
            raise ValueError(f"max_depth must be between 1 and {MAX_DEPTH}")


@dataclass(frozen=True)
class Part:
    """The rows of a fit: those of one repeat (or ``ALL``), less those of a test fold and of an inner fold."""

    repeat: int = ALL
    fold: int = ALL
    inner: int = ALL

    def train(self, repeat: np.ndarray, fold: np.ndarray, inner: np.ndarray) -> np.ndarray:
        return self._own(repeat) & ((fold != self.fold) | (self.fold == ALL)) & ((inner != self.inner) | (self.inner == ALL))

    def test(self, repeat: np.ndarray, fold: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """The inner fold's rows if the part leaves one out, else the rows of the test fold."""
        if self.inner != ALL:
            return self._own(repeat) & ((fold != self.fold) | (self.fold == ALL)) & (inner == self.inner)
        return self._own(repeat) & (fold == self.fold)

    def _own(self, repeat: np.ndarray) -> np.ndarray:
        return np.ones(len(repeat), bool) if self.repeat == ALL else repeat == self.repeat


@dataclass(frozen=True)
class Fit:
    part: Part
    params: TreeParams
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order: the children of ``i`` are ``2 i + 1`` and ``2 i + 2``. A node without a split has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    total: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n), np.zeros(n), np.zeros(n))

    def slim(self) -> "Tree":
        """Only what predictions need."""
        none = np.zeros(0)
        return Tree(self.feature, self.cut, self.value, none, none)

    def nodes(self, x: np.ndarray, depth: int) -> np.ndarray:
        return _nodes(self.feature, self.cut, x, depth)


def _nodes(feature: np.ndarray, cut: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """The node each row reaches within ``depth`` splits."""
    node = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for _ in range(depth):
        own = feature[node]
        inner = own >= 0
        if not inner.any():
            break
        node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(own, 0)] > cut[node]), node)
    return node


# Levels that one 64-bit mask of leaves covers, and rows that are worth the lookups of a tree that are used once.
_MASK_DEPTH, _MASK_ROWS = 6, 4096
_RIGHT_OF: dict[int, np.ndarray] = {}


def _right_of(depth: int) -> np.ndarray:
    """For each node above ``depth`` the leaves that rows going right can still reach, by its own split, as bits."""
    if depth not in _RIGHT_OF:
        masks = []
        for node in range(2**depth - 1):
            level = (node + 1).bit_length() - 1
            span = 2 ** (depth - level)
            masks.append(~(((1 << span // 2) - 1) << (node + 1 - 2**level) * span) & (2**64 - 1))
        _RIGHT_OF[depth] = np.array(masks, np.uint64).view(np.int64)
    return _RIGHT_OF[depth]


def _reachable(feature: np.ndarray, cut: np.ndarray, depth: int, n_features: int, n_bins: int) -> np.ndarray:
    """``[feature, bin]``: the leaves at ``depth`` that the splits on the feature leave to rows of the bin, as bits; a row's leaf is the first that all leave."""
    own = feature[: 2**depth - 1]
    left = np.full((n_features, n_bins), -1, np.int64)
    right = _right_of(depth)
    for node in np.flatnonzero(own >= 0).tolist():
        left[own[node], int(cut[node]) + 1 :] &= right[node]
    return left


class _Bins:
    """Binned rows, laid out for routing down many trees: a lookup per pair of features takes the place of a step per level."""

    def __init__(self, x: np.ndarray, n_bins: int):
        self.x, self.n_bins, self.n_features = x, n_bins, x.shape[1]
        self._columns: dict[int, np.ndarray] = {}
        self._codes: dict[int, np.ndarray] = {}
        self._flat: tuple | None = None

    @property
    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All bins in one array, and where each row starts."""
        if self._flat is None:
            self._flat = np.ascontiguousarray(self.x).ravel(), np.arange(len(self.x)) * self.n_features
        return self._flat

    def column(self, f: int) -> np.ndarray:
        if f not in self._columns:
            self._columns[f] = self.x[:, f].astype(np.intp)
        return self._columns[f]

    def _code(self, f: int, width: int) -> np.ndarray:
        if width == 1:
            return self.column(f)
        if f not in self._codes:
            self._codes[f] = self.column(f) * self.n_bins + self.column(f + 1)
        return self._codes[f]

    def leaves(self, feature: np.ndarray, cut: np.ndarray, depth: int, reachable: np.ndarray | None = None) -> np.ndarray:
        """The place of each row among the nodes at ``depth``; rows of a leaf above that level go on to its left descendants."""
        first = min(depth, _MASK_DEPTH)
        if reachable is None and len(self.x) < _MASK_ROWS:
            first = 0
        if reachable is None:
            reachable = _reachable(feature, cut, first, self.n_features, self.n_bins)
        used = (reachable != -1).any(axis=1)
        pairs = self.n_bins <= BINS
        mask = None
        for f in range(0, self.n_features, 2 if pairs else 1):
            width = min(2, self.n_features - f) if pairs else 1
            if not used[f : f + width].any():
                continue
            own = reachable[f] if width == 1 else (reachable[f][:, None] & reachable[f + 1]).ravel()
            own = own.take(self._code(f, width))
            mask = own if mask is None else np.bitwise_and(mask, own, out=mask)
        if mask is None:
            leaf = np.zeros(len(self.x), np.int64)
        else:
            # The lowest bit is a power of two: its number is the exponent.
            low = -mask
            low &= mask
            leaf = low.astype(float).view(np.int64)
            leaf >>= 52
            leaf &= 0x7FF
            leaf -= 1023
        if depth > first:
            flat, start = self.flat
            inner = feature[: 2**depth - 1] >= 0
            own, threshold = np.where(inner, feature[: len(inner)], 0).astype(np.int64), np.where(inner, cut[: len(inner)], 255).astype(np.uint8)
            node = leaf + (2**first - 1)
            for _ in range(depth - first):
                right = flat.take(start + own.take(node)) > threshold.take(node)
                node += node
                node += 1
                node += right
            leaf = node - (2**depth - 1)
        return leaf


def _reached(feature: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    """Values by node at ``depth``, where those of leaves above are passed down to all descendants."""
    size = 2 ** (depth + 1) - 1
    passed, ends = value[:size].copy(), feature[:size] < 0
    for i in range(2**depth - 1):
        if ends[i]:
            passed[2 * i + 1 : 2 * i + 3], ends[2 * i + 1 : 2 * i + 3] = passed[i], True
    return passed


@dataclass
class Ensemble:
    """Fitted trees with what they need to score new rows."""

    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    unit: float
    base: float
    params: TreeParams
    trees: list[Tree]

    def predicted(self, x: np.ndarray, n_trees: int | None = None, depth: int | None = None) -> np.ndarray:
        """Predictions of binned rows by the first ``n_trees`` trees, cut at ``depth``."""
        variant = len(self.trees) if n_trees is None else n_trees, self.params.max_depth if depth is None else depth
        return next(p for _, p in self.staged(x, [variant]))

    def staged(self, x: np.ndarray, variants: Sequence[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
        """Place and predictions of each (number of trees, depth); variants of one depth share the work of their first trees."""
        bins, boosted = _Bins(x, int(x.max(initial=0)) + 1), self.params.learning_rate is not None
        most = {d: max(n for n, depth in variants if depth == d) for _, d in variants}
        totals = {d: np.zeros(len(x)) for d in most}
        wanted = sorted(range(len(variants)), key=lambda k: variants[k][0])
        for done in range(max(most.values(), default=0) + 1):
            while wanted and (variants[wanted[0]][0] <= done or done >= len(self.trees)):
                k = wanted.pop(0)
                total = totals[variants[k][1]]
                yield k, (self.base + total if boosted else total / max(1, done)) * self.unit
            if not wanted or done >= len(self.trees):
                break
            tree = self.trees[done]
            # A leaf's place says which nodes lie above it.
            deepest = min(max(d for d, n in most.items() if n > done), int(math.log2(len(tree.feature) + 1)) - 1)
            leaf = bins.leaves(tree.feature, tree.cut, deepest)
            for d, n in most.items():
                if n > done:
                    own = min(d, deepest)
                    totals[d] += _reached(tree.feature, tree.value, own)[2**own - 1 :].take(leaf >> (deepest - own))

    def slim(self) -> "Ensemble":
        return replace(self, trees=[t.slim() for t in self.trees])

    def score(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """``df`` with the prediction of each row; null and non-finite features count as zero."""
        schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
        n, edges, slim = len(df.columns), self.edges, self.slim()
        ready = df.select(*df.columns, *[F.coalesce(finite(c), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(self.features)])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _binned([batch.column(n + i).to_numpy() for i in range(len(edges))], edges)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(slim.predicted(x))], names=schema.names)

        return ready.mapInArrow(run, schema)

    def nodes(self, spark) -> DataFrame:
        """One row per node: ``tree, node`` (heap order), ``feature`` and ``cut`` (null for a leaf), ``weight`` and ``value``."""
        rows = []
        for number, tree in enumerate(self.trees):
            for i in np.flatnonzero(tree.weight > 0).tolist():
                inner = tree.feature[i] >= 0
                rows.append((number, i, self.features[tree.feature[i]] if inner else None, int(tree.cut[i]) if inner else None, float(tree.weight[i]), float(tree.value[i] * self.unit)))
        return local_table(spark, rows, "tree int, node int, feature string, cut int, weight double, value double")

    def importances(self) -> dict[str, float]:
        """Share of each feature in the squared error that the splits remove."""
        gains = np.zeros(len(self.features))
        for tree in self.trees:
            for i in np.flatnonzero(tree.feature >= 0):
                parts = [tree.total[c] ** 2 / (tree.weight[c] + self.params.l2) if tree.weight[c] else 0.0 for c in (2 * i + 1, 2 * i + 2)]
                gains[tree.feature[i]] += sum(parts) - tree.total[i] ** 2 / (tree.weight[i] + self.params.l2)
        return dict(zip(self.features, (gains / gains.sum() if gains.sum() > 0 else gains).tolist()))


def _binned(columns: Sequence[np.ndarray], edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin numbers: how many edges lie below the value."""
    return np.column_stack([np.searchsorted(np.asarray(e, float), c, side="left") for c, e in zip(columns, edges)]).astype(np.uint8) if columns else np.zeros((0, 0), np.uint8)


@dataclass
class BinnedTable:
    """``rows``: ``key, h, repeat, fold, inner, y, actual, x`` (bins as bytes), one row per row and repeat."""

    rows: DataFrame
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    unit: float
    scratch: Scratch

    @property
    def n_bins(self) -> int:
        return max([2, *[len(e) + 1 for e in self.edges]])


def bin_table(
    df: DataFrame, features: Sequence[str], target: str, key: str, group: str, *, fold: str | None = "fold_id", repeat: str | None = "repeat_id",
    inner_folds: int = 4, seed: int = 42, bins: int = BINS, edges: Mapping[str, Sequence[float]] | None = None, scratch: Scratch | None = None,
) -> BinnedTable:
    """Bin the features by quantiles of the whole table (they don't depend on the target) and number folds and inner folds.

    Inner folds follow from the hash of ``group``, so a group never crosses them. Rows without a finite target are left out; null and
    non-finite features count as zero. ``key`` tells rows apart in draws.
    """
    if not 2 <= bins <= 256:
        raise ValueError("between 2 and 256 bins")
    scratch = scratch or Scratch(df.sparkSession)
    numbers = [F.coalesce(finite(c), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(features)]
    whole = lambda c: F.lit(0) if c is None or c not in df.columns else F.col(c).cast("int")
    taken = df.where(finite(target).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.xxhash64(F.col(key).cast("string")).alias("h"), whole(repeat).alias("repeat"), whole(fold).alias("fold"),
        F.pmod(hash32(F.col(group), "inner", seed), F.lit(inner_folds)).cast("int").alias("inner"), F.col(target).cast("double").alias("actual"), *numbers,
    )
    ready = scratch.table(taken, "features")
    size = ready.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("actual")).alias("top")).first()
    # Sums of n targets stay below 2 ** 50 units, with room for weights.
    unit = 2.0 ** math.ceil(math.log2(size["top"]) + math.log2(size["n"]) - 50) if size["top"] else 1.0
    if edges is None:
        first = ready.where(F.col("repeat") == (ready.agg(F.min("repeat")).first()[0] or 0))
        found = quantile_edges(first, [f"_x{i}" for i in range(len(features))], "key", bins, stable=True) if size["n"] else {}
        cuts = tuple(tuple(found.get(f"_x{i}", ())) for i in range(len(features)))
    else:
        cuts = tuple(tuple(edges[c]) for c in features)
    if size["n"] < SMALL_ROWS:
        # A small table would be read by one task, and every level is work for all of them.
        tasks = min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(max(1, size["n"]) / 1000))
        ready = ready.repartition(tasks, "h")
    kept = ["key", "h", "repeat", "fold", "inner", "actual"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _binned([batch.column(len(kept) + i).to_numpy() for i in range(len(cuts))], cuts)
            y = np.rint(batch.column(5).to_numpy() / unit).astype(np.int64)
            data = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(y), data], names=[*kept, "y", "x"])

    rows = ready.mapInArrow(run, "key string, h bigint, repeat int, fold int, inner int, actual double, y bigint, x binary")
    return BinnedTable(scratch.table(rows, "binned"), tuple(features), cuts, unit, scratch)


# Draws


def tree_seed(seed: int, number: int) -> int:
    return int(_mix(_mix(seed) ^ np.uint64(number + 1)))


def row_weights(h: np.ndarray, seed: int, sampling: float | str) -> np.ndarray:
    """Weight of each row in a tree: Poisson with mean one, or drawn without replacement."""
    if sampling == 1.0:
        return np.ones(len(h))
    drawn = h.view(np.uint64) ^ np.uint64(seed)
    return poisson64(drawn).astype(float) if sampling == "bootstrap" else (_uniform(drawn) < sampling).astype(float)


def _share(n: int, share: float | str) -> int:
    return max(1, min(n, int(math.sqrt(n)) if share == "sqrt" else int(share * n + 1e-9)))


def drawn_features(n: int, seed: int, node: int, params: TreeParams) -> np.ndarray:
    """The features a node may split on, in ascending order."""
    own = np.arange(n) if params.columns is None else np.sort(np.array(params.columns, int))
    m = _share(len(own), params.tree_features)
    if m < len(own):
        own = np.sort(own[np.argsort(_mix(np.uint64(seed) ^ _mix(own + 7_000_003)), kind="stable")[:m]])
    k = _share(len(own), params.node_features)
    if k < len(own):
        own = np.sort(own[np.argsort(_mix(np.uint64(seed) ^ _mix(node * 1_000_003 + own)), kind="stable")[:k]])
    return own


def random_cut(edges: np.ndarray, low: int, high: int, seed: int, node: int, feature: int) -> int:
    """The edge nearest to a uniform draw between the outermost edges that part bins ``low`` and ``high``."""
    u = float(_uniform(np.uint64(seed) ^ _mix(node * 1_000_003 + feature + 500_009)))
    x = edges[low] + u * (edges[high - 1] - edges[low])
    return low + int(np.abs(edges[low:high] - x).argmin())


def best_split(histogram: np.ndarray, features: np.ndarray, params: TreeParams, edges: Sequence[np.ndarray], seed: int, node: int) -> tuple:
    """``feature, cut, weight and total on the left, gain`` of the best split (feature -1: none) of ``histogram[feature, bin, (weight, total)]``.

    The gain is the drop of the (penalised) squared error. Equal gains fall to the first feature and the lowest cut.
    """
    left = histogram.cumsum(axis=1)[:, :-1]
    weight, total = histogram[0].sum(axis=0)
    right_weight, right_total = weight - left[:, :, 0], total - left[:, :, 1]
    fits = (left[:, :, 0] >= max(params.min_leaf, 1e-9)) & (right_weight >= max(params.min_leaf, 1e-9))
    if params.random_cuts:
        chosen = np.zeros_like(fits)
        for i, f in enumerate(features.tolist()):
            held = np.flatnonzero(histogram[i, :, 0] > 0)
            if len(held) > 1:
                chosen[i, random_cut(edges[f], int(held[0]), int(held[-1]), seed, node, f)] = True
        fits &= chosen
    if not fits.any():
        return -1, 0, 0.0, 0.0, 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[:, :, 1] ** 2 / (left[:, :, 0] + params.l2) + right_total**2 / (right_weight + params.l2) - total**2 / (weight + params.l2)
    gain = np.where(fits, gain, -np.inf)
    i, c = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[i, c] > 0:
        return -1, 0, 0.0, 0.0, 0.0
    return int(features[i]), int(c), float(left[i, c, 0]), float(left[i, c, 1]), float(gain[i, c])


# Growing


@dataclass
class _Job:
    """A tree in the making: its rows, draws and open nodes. ``shift`` is what its targets lie above those of the table."""

    fit: int
    part: Part
    params: TreeParams
    seed: int
    feature: np.ndarray
    cut: np.ndarray
    depth: int
    open: np.ndarray
    shift: float = 0.0


@dataclass
class _Unit:
    """Trees that need the same sums: rows, draws, splits so far and open nodes with their features are the same.

    They may leave out different inner folds; sums are then kept for each of these, and a tree's are all but its own.
    """

    jobs: list[tuple[int, _Job]]
    part: Part
    inners: list[int]
    open: np.ndarray
    features: np.ndarray

    @property
    def cells(self) -> int:
        return 1 if len(self.inners) == 1 else len(self.inners) + 1

    def shape(self, n_bins: int) -> tuple[int, ...]:
        return 2, self.features.shape[1], self.cells, len(self.open), n_bins

    @property
    def draw(self) -> tuple:
        """What the rows and their weights follow from, but for the inner fold that is left out."""
        return replace(self.part, inner=ALL), self.jobs[0][1].seed, self.jobs[0][1].params.sampling

    def histogram(self, sums: np.ndarray, job: _Job) -> np.ndarray:
        """``[node, feature, bin, (weight, total)]`` of one of the trees."""
        own = sums.sum(axis=2)
        if self.cells > 1 and job.part.inner != ALL:
            own = own - sums[:, :, self.inners.index(job.part.inner)]
        histogram = own.transpose(2, 1, 3, 0)
        if job.shift:
            histogram = np.stack([histogram[..., 0], histogram[..., 1] - job.shift * histogram[..., 0]], axis=-1)
        return histogram


def _units(jobs: Sequence[tuple[int, _Job]], n_features: int, apart: bool, drawn: dict) -> list[_Unit]:
    """Jobs with open nodes, those that need the same sums together; ``apart``: every fit has targets of its own."""
    groups: dict[tuple, list[tuple[int, _Job]]] = {}
    choices: dict[tuple, np.ndarray] = {}
    for t, job in jobs:
        p = job.params
        rows = []
        for node in job.open.tolist():
            name = (job.seed, node, p.tree_features, p.node_features, p.columns)
            if name not in drawn:
                drawn[name] = drawn_features(n_features, job.seed, node, p)
            rows.append(drawn[name])
        features = np.stack(rows)
        above = 2**job.depth - 1
        name = (
            job.part.repeat, job.part.fold, job.seed, p.sampling, job.depth, job.feature[:above].tobytes(), job.cut[:above].tobytes(),
            job.open.tobytes(), features.shape[1], features.tobytes(), (t, job.fit) if apart else None,
        )
        groups.setdefault(name, []).append((t, job))
        choices[name] = features
    found = []
    for name, members in groups.items():
        inners = sorted({job.part.inner for _, job in members})
        part = members[0][1].part if len(inners) == 1 else replace(members[0][1].part, inner=ALL)
        found.append(_Unit(members, part, inners, members[0][1].open, choices[name]))
    # Units with the same rows and weights follow each other.
    return sorted(found, key=lambda u: (u.part.repeat, u.part.fold, u.draw[1], str(u.draw[2]), u.part.inner))


@dataclass
class _State:
    """What boosted fits predict: ``column`` of the table's state, plus the trees since."""

    bases: np.ndarray
    since: list[list[tuple]]
    depths: list[int]
    rates: bool = True


def _joined(batches: Iterable[pa.RecordBatch], rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """Fewer, larger batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _columns(batch: pa.RecordBatch, n_features: int) -> tuple:
    names = batch.schema.names
    get = lambda c: batch.column(names.index(c)).to_numpy()
    x = _bytes(batch.column(names.index("x"))).reshape(batch.num_rows, n_features)
    return get("h"), get("repeat"), get("fold"), get("inner"), get("y"), x


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of all values of a column without nulls, one after the other, not copied."""
    if not len(column):
        return np.zeros(0, np.uint8)
    _, offsets, data = column.cast(pa.binary()).buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]


def _known(batch: pa.RecordBatch, bins: _Bins, fit: int, state: _State) -> np.ndarray:
    """Prediction so far of one boosted fit, in units."""
    total = np.full(batch.num_rows, state.bases[fit])
    if "state" in batch.schema.names:
        total += np.frombuffer(b"".join(batch.column(batch.schema.names.index("state")).to_pylist()), float).reshape(batch.num_rows, -1)[:, fit]
    depth = state.depths[fit]
    for feature, cut, value in state.since[fit]:
        total += _reached(feature, value, depth)[2**depth - 1 :].take(bins.leaves(feature, cut, depth))
    return total


def _histograms(table: BinnedTable, units: Sequence[_Unit], state: _State | None):
    """Per task one row per unit with the sums of its open nodes."""
    n_features, n_bins = len(table.features), table.n_bins

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(unit.shape(n_bins)) for unit in units]
        reachable: list = [None] * len(units)
        seen = False
        for batch in _joined(batches):
            seen = True
            h, repeat, fold, inner, y, x = _columns(batch, n_features)
            targets: dict[int, np.ndarray] = {}
            drawn, whole = None, _Bins(x, n_bins)
            for u, (unit, total) in enumerate(zip(units, sums)):
                job = unit.jobs[0][1]
                if unit.draw != drawn:
                    drawn = unit.draw
                    rows = np.flatnonzero(drawn[0].train(repeat, fold, inner))
                    weight = None
                    if job.params.sampling != 1.0:
                        weight = row_weights(h[rows], job.seed, job.params.sampling)
                        held = np.flatnonzero(weight)
                        rows, weight = rows[held], weight[held]
                    bins, apart = _Bins(x[rows], n_bins), inner[rows]
                    plain = y[rows].astype(float)
                if not len(rows):
                    continue
                if state is None:
                    target = plain
                else:
                    if job.fit not in targets:
                        targets = {job.fit: y - _known(batch, whole, job.fit, state)}
                    target = targets[job.fit][rows]
                n_open = len(unit.open)
                slot_of = np.full(2**job.depth, -1)
                slot_of[unit.open - (2**job.depth - 1)] = np.arange(n_open)
                if reachable[u] is None:
                    reachable[u] = _reachable(job.feature, job.cut, min(job.depth, _MASK_DEPTH), n_features, n_bins)
                slot = slot_of.take(bins.leaves(job.feature, job.cut, job.depth, reachable[u]))
                # Rows of closed nodes and of the inner fold that is left out.
                out = slot < 0
                if unit.part.inner != ALL:
                    out |= apart == unit.part.inner
                n_out = np.count_nonzero(out)
                w, code, held = weight, apart, None
                if n_out * 2 > len(out):
                    held = np.flatnonzero(~out)
                    slot, target, code, n_out = slot[held], target[held], code[held], 0
                    w = None if w is None else w[held]
                if not len(slot):
                    continue
                summed = target if w is None else w * target
                if unit.cells > 1:
                    cell_of = np.full(max(int(code.max()), *unit.inners) + 1, len(unit.inners))
                    for i, own in enumerate(unit.inners):
                        if own != ALL:
                            cell_of[own] = i
                    place = (cell_of.take(code) * n_open + slot) * n_bins
                else:
                    place = slot * n_bins
                size = unit.cells * n_open * n_bins
                room = size
                if n_out:
                    # A few are summed behind the others, which is less work than to leave them out.
                    place[out] = size
                    room = size + n_bins
                first = None
                for j in range(unit.features.shape[1]):
                    own = unit.features[:, j]
                    if (own == own[0]).all():
                        column = bins.column(int(own[0]))
                        at = place + (column if held is None else column.take(held))
                    else:
                        flat, start = bins.flat
                        first = start if held is None else start[held] if first is None else first
                        at = place + flat.take(first + own.take(slot))
                    total[0, j] += np.bincount(at, w, room)[:size].reshape(total.shape[2:])
                    total[1, j] += np.bincount(at, summed, room)[:size].reshape(total.shape[2:])
        if seen:
            for u, value in enumerate(sums):
                yield pa.RecordBatch.from_arrays([pa.array([u], pa.int32()), pa.array([value.tobytes()], pa.binary())], names=["unit", "sums"])

    return run


def _splits(table: BinnedTable, units: Sequence[_Unit], state: _State | None) -> list:
    """The best split of every open node of some trees: one pass over the table."""
    run, n_bins = _histograms(table, units, state), table.n_bins
    edges = [np.asarray(e, float) for e in table.edges]

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for u, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(sums.as_buffer(), float)
                total[u] = total[u] + own if u in total else own
        for u, sums in total.items():
            unit = units[u]
            sums = sums.reshape(unit.shape(n_bins))
            for t, job in unit.jobs:
                histogram = unit.histogram(sums, job)
                found = [
                    (t, int(node), *histogram[k, 0].sum(axis=0).tolist(), *best_split(histogram[k], unit.features[k], job.params, edges, job.seed, int(node)))
                    for k, node in enumerate(unit.open)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=_SPLIT)

    wanted = ["h", "repeat", "fold", "inner", "y", "x", *(["state"] if "state" in table.rows.columns else [])]
    partial = table.rows.select(*wanted).mapInArrow(run, "unit int, sums binary")
    chosen = partial.repartition("unit").mapInArrow(choose, "tree bigint, node bigint, weight double, total double, feature bigint, cut bigint, left_weight double, left_total double, gain double")
    return chosen.collect()


_SPLIT = ["tree", "node", "weight", "total", "feature", "cut", "left_weight", "left_total", "gain"]


def _grow(table: BinnedTable, fits: Sequence[tuple[int, Fit, int]], state: _State | None = None) -> list[Tree]:
    """One tree for every (fit number, fit, tree number), all levels of all trees together. Values are means, in units."""
    trees = [Tree.empty(fit.params.max_depth) for _, fit, _ in fits]
    n_features = len(table.features)
    # Before the first boosted tree the targets of all fits differ by constants only.
    fresh = state is not None and not any(state.since) and "state" not in table.rows.columns
    shifts = state.bases if fresh else np.zeros(1 + max((number for number, _, _ in fits), default=0))
    state = None if fresh else state
    jobs = [
        _Job(number, fit.part, fit.params, tree_seed(fit.seed, k), tree.feature, tree.cut, 0, np.zeros(1, int), float(shifts[number]))
        for (number, fit, k), tree in zip(fits, trees)
    ]
    drawn: dict[tuple, np.ndarray] = {}
    while any(len(job.open) for job in jobs):
        following: list[list[int]] = [[] for _ in jobs]

        def flush(waiting: list[_Unit]) -> None:
            for row in _splits(table, waiting, state):
                tree, job, i = trees[row["tree"]], jobs[row["tree"]], row["node"]
                tree.weight[i], tree.total[i] = row["weight"], row["total"]
                if row["feature"] < 0:
                    continue
                split[row["tree"]].append((i, row["feature"], row["cut"]))
                for child, weight, total in (
                    (2 * i + 1, row["left_weight"], row["left_total"]), (2 * i + 2, row["weight"] - row["left_weight"], row["total"] - row["left_total"]),
                ):
                    tree.weight[child], tree.total[child] = weight, total
                    if job.depth + 1 < job.params.max_depth and weight >= 2 * max(job.params.min_leaf, 1):
                        following[row["tree"]].append(child)

        split: list[list[tuple]] = [[] for _ in jobs]
        waiting: list[_Unit] = []
        room = 0
        for unit in _units([(t, job) for t, job in enumerate(jobs) if len(job.open)], n_features, state is not None, drawn):
            per_node = unit.features.shape[1] * table.n_bins * 16 * unit.cells
            for part in np.array_split(np.arange(len(unit.open)), -(-len(unit.open) * per_node // HISTOGRAM_BYTES)):
                if waiting and room + len(part) * per_node > HISTOGRAM_BYTES:
                    flush(waiting)
                    waiting, room = [], 0
                waiting.append(replace(unit, open=unit.open[part], features=unit.features[part]))
                room += len(part) * per_node
        flush(waiting)
        for job, tree, nodes, found in zip(jobs, trees, following, split):
            for i, feature, cut in found:
                tree.feature[i], tree.cut[i] = feature, cut
            job.depth, job.open = job.depth + 1, np.array(sorted(nodes), int)
    for tree, (_, fit, _) in zip(trees, fits):
        rate = 1.0 if fit.params.learning_rate is None else fit.params.learning_rate
        held = tree.weight > 0
        # Boosted values are whole units, so later sums are exact too.
        value = rate * tree.total[held] / (tree.weight[held] + fit.params.l2)
        tree.value[held] = value if fit.params.learning_rate is None else np.rint(value)
    return trees


def _bases(table: BinnedTable, fits: Sequence[Fit]) -> np.ndarray:
    """Mean target of each fit's rows, in whole units: every fit's sum follows from sums per fold and inner fold."""
    cells = table.rows.groupBy("repeat", "fold", "inner").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).toPandas()
    own = []
    for fit in fits:
        mask = fit.part.train(cells["repeat"].to_numpy(), cells["fold"].to_numpy(), cells["inner"].to_numpy())
        n = cells["n"][mask].sum()
        own.append(np.rint(cells["s"][mask].sum() / n) if n else 0.0)
    return np.array(own, float)


def fit_ensembles(table: BinnedTable, fits: Sequence[Fit]) -> list[Ensemble]:
    """Grow many ensembles together: forests in one go, boosted ones round by round."""
    found: dict[int, Ensemble] = {}
    averaged = [i for i, fit in enumerate(fits) if fit.params.learning_rate is None]
    if averaged:
        wanted = [(i, fits[i], k) for i in averaged for k in range(fits[i].params.n_trees)]
        trees = iter(_grow(table, wanted))
        for i in averaged:
            found[i] = Ensemble(table.features, table.edges, table.unit, 0.0, fits[i].params, list(itertools.islice(trees, fits[i].params.n_trees)))
    boosted = [i for i, fit in enumerate(fits) if fit.params.learning_rate is not None]
    if boosted:
        own = [fits[i] for i in boosted]
        for i, ensemble in zip(boosted, _boost(table, own)):
            found[i] = ensemble
    return [found[i] for i in range(len(fits))]


def _boost(table: BinnedTable, fits: Sequence[Fit]) -> list[Ensemble]:
    n = table.rows.count()
    if n * (len(table.features) + 28) <= LOCAL_BYTES:
        return _boost_apart(table, fits)
    if max(fit.params.n_trees for fit in fits) <= STATE_ROUNDS:
        return _boost_together(table, fits)
    step = max(1, STATE_BYTES // (8 * n))
    return [e for at in range(0, len(fits), step) for e in _boost_together(table, fits[at : at + step])]


def _boost_apart(table: BinnedTable, fits: Sequence[Fit]) -> list[Ensemble]:
    """Every fit in a task of its own, on a table that was measured and found small: no pass over the table per level."""
    spark, bases = table.rows.sparkSession, _bases(table, fits)
    held = table.rows.select("h", "repeat", "fold", "inner", "y", "x").toArrow()
    h, repeat, fold, inner, y = (held.column(c).to_numpy() for c in ("h", "repeat", "fold", "inner", "y"))
    x = np.frombuffer(b"".join(held.column("x").to_pylist()), np.uint8).reshape(held.num_rows, len(table.features))
    shared = spark.sparkContext.broadcast((h, repeat, fold, inner, y, x))
    edges, n_bins = [np.asarray(e, float) for e in table.edges], table.n_bins
    # Long fits first, so that no task is left alone at the end.
    order = sorted(range(len(fits)), key=lambda i: -fits[i].params.n_trees * fits[i].params.max_depth)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, repeat, fold, inner, y, x = shared.value
        for batch in batches:
            for i in (order[place] for place in batch.column(0).to_pylist()):
                rows = np.flatnonzero(fits[i].part.train(repeat, fold, inner))
                trees = _boosted_here(h[rows], y[rows] - bases[i], x[rows], fits[i], edges, n_bins)
                parts = [np.stack([getattr(t, c) for t in trees]).tobytes() for c in _TREE]
                yield pa.RecordBatch.from_arrays([pa.array([i]), *[pa.array([p], pa.binary()) for p in parts]], names=["fit", *_TREE])

    schema = "fit bigint, " + ", ".join(f"{c} binary" for c in _TREE)
    found: dict[int, list[Tree]] = {}
    try:
        for row in spark.range(0, len(fits), 1, len(fits)).mapInArrow(run, schema).collect():
            n_trees = fits[row["fit"]].params.n_trees
            parts = [np.frombuffer(row[c], kind).reshape(n_trees, -1) for c, kind in _TREE.items()]
            found[row["fit"]] = [Tree(*own) for own in zip(*parts)]
    finally:
        shared.unpersist()
    return [Ensemble(table.features, table.edges, table.unit, float(b), fit.params, found[i]) for i, (b, fit) in enumerate(zip(bases, fits))]


_TREE = {"feature": np.int16, "cut": np.uint8, "value": float, "weight": float, "total": float}


def _boosted_here(h: np.ndarray, target: np.ndarray, x: np.ndarray, fit: Fit, edges: Sequence[np.ndarray], n_bins: int) -> list[Tree]:
    """The trees of one boosted fit from its rows; sums are exact, so they are those of ``_grow``."""
    params, depth = fit.params, fit.params.max_depth
    bins = _Bins(x, n_bins)
    columns = [bins.column(f) for f in range(x.shape[1])]
    trees = []
    for number in range(params.n_trees):
        tree, seed = Tree.empty(depth), tree_seed(fit.seed, number)
        weight = row_weights(h, seed, params.sampling)
        rows = np.flatnonzero(weight)
        weight = weight[rows] if params.sampling == "bootstrap" else None
        # Children of a node that may split on the same features: the smaller one is summed, the other is the rest.
        alike = params.node_features == 1.0
        open_: list[tuple] = [(0, rows, weight, None)]
        while open_:
            node, rows, weight, histogram = open_.pop()
            features = drawn_features(x.shape[1], seed, node, params)
            if histogram is None:
                histogram = _sums(columns, features, rows, weight, target, n_bins)
            tree.weight[node], tree.total[node] = histogram[0].sum(axis=0)
            feature, cut, left_weight, left_total, _ = best_split(histogram, features, params, edges, seed, node)
            if feature < 0:
                continue
            tree.feature[node], tree.cut[node] = feature, cut
            sides = (left_weight, left_total), (tree.weight[node] - left_weight, tree.total[node] - left_total)
            going = []
            for side, (own, total) in enumerate(sides):
                child = 2 * node + 1 + side
                tree.weight[child], tree.total[child] = own, total
                if (child + 1).bit_length() <= depth and own >= 2 * max(params.min_leaf, 1):
                    going.append(side)
            if not going:
                continue
            right = columns[feature][rows] > cut
            parts = [(rows[~right], None if weight is None else weight[~right]), (rows[right], None if weight is None else weight[right])]
            own_sums: list = [None, None]
            if alike and len(going) == 2:
                small = int(len(parts[1][0]) < len(parts[0][0]))
                own_sums[small] = _sums(columns, features, *parts[small], target, n_bins)
                own_sums[1 - small] = histogram - own_sums[small]
            open_ += [(2 * node + 1 + side, *parts[side], own_sums[side]) for side in going]
        held = tree.weight > 0
        tree.value[held] = np.rint(params.learning_rate * tree.total[held] / (tree.weight[held] + params.l2))
        if number + 1 < params.n_trees:
            target = target - _reached(tree.feature, tree.value, depth)[2**depth - 1 :].take(bins.leaves(tree.feature, tree.cut, depth))
        trees.append(tree)
    return trees


def _sums(columns: Sequence[np.ndarray], features: np.ndarray, rows: np.ndarray, weight: np.ndarray | None, target: np.ndarray, n_bins: int) -> np.ndarray:
    """``[feature, bin, (weight, total)]`` of some rows."""
    own = target[rows] if weight is None else weight * target[rows]
    out = np.empty((len(features), n_bins, 2))
    for j, f in enumerate(features.tolist()):
        at = columns[f][rows]
        out[j, :, 0] = np.bincount(at, weight, n_bins)
        out[j, :, 1] = np.bincount(at, own, n_bins)
    return out


def _boost_together(table: BinnedTable, fits: Sequence[Fit]) -> list[Ensemble]:
    """All fits round by round, a pass over the table for every level."""
    bases = _bases(table, fits)
    grown: list[list[Tree]] = [[] for _ in fits]
    state = _State(bases, [[] for _ in fits], [fit.params.max_depth for fit in fits])
    current, written = table, None
    for number in range(max(fit.params.n_trees for fit in fits)):
        going = [(i, fit, number) for i, fit in enumerate(fits) if number < fit.params.n_trees]
        for (i, _, _), tree in zip(going, _grow(current, going, state)):
            grown[i].append(tree)
            state.since[i].append((tree.feature, tree.cut, tree.value))
        if (number + 1) % STATE_ROUNDS == 0 and number + 1 < max(fit.params.n_trees for fit in fits):
            following = table.scratch.table(_with_state(current.rows, len(table.features), state), "state")
            if written is not None:
                table.scratch.drop(written)
            current, written = replace(table, rows=following), following
            state = _State(bases, [[] for _ in fits], state.depths)
    if written is not None:
        table.scratch.drop(written)
    return [Ensemble(table.features, table.edges, table.unit, float(b), fit.params, trees) for b, fit, trees in zip(bases, fits, grown)]


def _with_state(rows: DataFrame, n_features: int, state: _State) -> DataFrame:
    """Rows with what each fit predicts above its base."""
    kept = [c for c in rows.columns if c != "state"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _columns(batch, n_features)[-1]
            bins = _Bins(x, int(x.max(initial=0)) + 1)
            known = np.column_stack([_known(batch, bins, i, state) - state.bases[i] for i in range(len(state.bases))])
            columns = [batch.column(batch.schema.names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in known], pa.binary())], names=[*kept, "state"])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], T.StructField("state", T.BinaryType())]))


# Scores and predictions


def test_scores(table: BinnedTable, fits: Sequence[Fit], ensembles: Sequence[Ensemble], variants: Sequence[Sequence[tuple[int, int]]]) -> list[list[float]]:
    """R2 on each fit's held-out rows, for each (number of trees, depth) of its variants: one pass for all fits."""
    n_features = len(table.features)
    ensembles = [e.slim() for e in ensembles]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in _joined(batches):
            _, repeat, fold, inner, _, x = _columns(batch, n_features)
            actual = batch.column(batch.schema.names.index("actual")).to_numpy()
            for i, (fit, ensemble) in enumerate(zip(fits, ensembles)):
                rows = np.flatnonzero(fit.part.test(repeat, fold, inner))
                if not len(rows):
                    continue
                for k, predicted in ensemble.staged(x[rows], variants[i]):
                    error = actual[rows] - predicted
                    own = np.array([len(rows), actual[rows].sum(), (actual[rows] ** 2).sum(), (error**2).sum()])
                    sums[i, k] = sums.get((i, k), 0.0) + own
        for (i, k), own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([k]), *[pa.array([v]) for v in own]], names=["fit", "variant", "n", "s", "ss", "e"])

    wanted = table.rows.select("h", "repeat", "fold", "inner", "y", "x", "actual")
    summed = wanted.mapInArrow(run, "fit bigint, variant bigint, n double, s double, ss double, e double").groupBy("fit", "variant").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "e")])
    scores = [[float("nan")] * len(v) for v in variants]
    for r in summed.collect():
        spread = r["ss"] - r["s"] ** 2 / r["n"]
        scores[r["fit"]][r["variant"]] = 1.0 - r["e"] / spread if spread > 0 else float("nan")
    return scores


test_scores.__test__ = False


def fold_predictions(table: BinnedTable, named: Sequence[tuple[str, Fit, Ensemble, str]], roles: Sequence[str] = ("test", "train")) -> DataFrame:
    """Long predictions of the roles asked for: ``model, repeat_id, fold_id, sample_id, role, actual, predicted, best_params``.

    ``fold_id`` is the fold that the model left out; one pass for all models.
    """
    n_features = len(table.features)
    named = [(model, fit, ensemble.slim(), best) for model, fit, ensemble, best in named]
    schema = "model string, repeat_id int, fold_id int, sample_id string, role string, actual double, predicted double, best_params string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches):
            _, repeat, fold, inner, _, x = _columns(batch, n_features)
            names = batch.schema.names
            key, actual = batch.column(names.index("key")), batch.column(names.index("actual"))
            for model, fit, ensemble, best in named:
                tested = fit.part.test(repeat, fold, inner)
                own = np.flatnonzero(fit.part._own(repeat) & np.where(tested, "test" in roles, "train" in roles))
                if not len(own):
                    continue
                role = np.where(tested[own], "test", "train")
                n, take = len(own), pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([model] * n), pa.array(repeat[own]), pa.array(np.full(n, fit.part.fold, np.int32)), key.take(take), pa.array(role.tolist()), actual.take(take), pa.array(ensemble.predicted(x[own])), pa.array([best] * n)],
                    names=["model", "repeat_id", "fold_id", "sample_id", "role", "actual", "predicted", "best_params"],
                )

    return table.rows.mapInArrow(run, schema)


# Search


@dataclass(frozen=True)
class SearchSpace:
    """Parameters common to all draws, and the values a search may draw from."""

    name: str
    fixed: TreeParams
    grid: Mapping[str, Sequence]

    def draws(self, n: int, seed: int) -> list[TreeParams]:
        combinations = [dict(zip(self.grid, values)) for values in itertools.product(*self.grid.values())]
        taken = combinations if len(combinations) <= n else random.Random(seed).sample(combinations, n)
        return [replace(self.fixed, **d) for d in taken]


def search_spaces(trees: int | None = None) -> dict[str, SearchSpace]:
    """Search spaces by the names users know; ``trees`` scales the numbers of trees (largest of each grid) down for large tables."""

    def counts(values: Sequence[int]) -> list[int]:
        return list(values) if trees is None else sorted({max(1, round(v * trees / max(values))) for v in values})

    forest = {"n_trees": counts([300, 500, 700, 900]), "node_features": [0.35, 0.5, 0.7, "sqrt"], "min_leaf": [1, 2, 3, 4], "max_depth": [3, 4, 5, 6, MAX_DEPTH]}
    rates = [0.01, 0.02, 0.03, 0.05] if trees is None else [min(0.5, r * 300 / trees) for r in (0.01, 0.02, 0.03, 0.05)]
    boosted = {"n_trees": counts([120, 200, 300, 500]), "learning_rate": rates, "max_depth": [2, 3], "min_leaf": [2, 3, 4, 5], "sampling": [0.7, 0.85, 1.0]}
    binned = {"n_trees": counts([150, 250, 350, 500]), "learning_rate": rates, "max_depth": [3, 4, 5], "min_leaf": [5, 8, 10, 12], "l2": [0.0, 0.5, 1.0, 2.0, 5.0]}
    regularised = {
        "n_trees": counts([150, 300, 500]), "learning_rate": rates, "max_depth": [2, 3, 4], "sampling": [0.7, 0.85, 1.0], "tree_features": [0.7, 0.85, 1.0],
        "l2": [0.5, 1.0, 2.0, 5.0], "min_leaf": [1, 2, 3, 5],
    }
    return {
        "RandomForest": SearchSpace("RandomForest", TreeParams(sampling="bootstrap"), forest),
        "ExtraTrees": SearchSpace("ExtraTrees", TreeParams(random_cuts=True), forest),
        "GradientBoosting": SearchSpace("GradientBoosting", TreeParams(learning_rate=0.1), boosted),
        "HistGradientBoosting": SearchSpace("HistGradientBoosting", TreeParams(learning_rate=0.1), binned),
        "RegularizedBoosting": SearchSpace("RegularizedBoosting", TreeParams(learning_rate=0.1), regularised),
    }


@dataclass
class SearchResult:
    """``predictions``: see ``fold_predictions``. ``scores``: mean inner R2 of every draw. ``fits``: how many training sets times draws were scored.
    ``models``: name, fit and ensemble of the best draw per repeat and fold."""

    predictions: DataFrame
    scores: DataFrame
    fits: int
    models: list[tuple[str, Fit, Ensemble]]


def inner_scores(
    table: BinnedTable, space: SearchSpace, parts: Sequence[Part], draws: Sequence[Sequence[TreeParams]], seeds: Sequence[int], inner_folds: int
) -> list[list[list[float]]]:
    """R2 on each inner fold for every draw of every part; all fits grow together.

    Draws that differ in the number of trees only (for forests also in depth) share trees: the first trees of a larger ensemble are
    the smaller one, and a forest's tree cut at a depth is the tree of that depth.
    """
    fits: list[Fit] = []
    variants: list[list[tuple[int, int]]] = []
    members: list[list[tuple[int, int]]] = []
    for p, (part, own, seed) in enumerate(zip(parts, draws, seeds)):
        shared: dict[TreeParams, list[int]] = {}
        for d, params in enumerate(own):
            alike = replace(params, n_trees=1) if params.learning_rate is not None else replace(params, n_trees=1, max_depth=1)
            shared.setdefault(alike, []).append(d)
        for group in shared.values():
            largest = replace(own[group[0]], n_trees=max(own[d].n_trees for d in group), max_depth=max(own[d].max_depth for d in group))
            for inner in range(inner_folds):
                fits.append(Fit(replace(part, inner=inner), largest, seed))
                variants.append([(own[d].n_trees, own[d].max_depth) for d in group])
                members.append([(p, d) for d in group])
    found: list[list[list[float]]] = [[[] for _ in own] for own in draws]
    for own, scores in zip(members, test_scores(table, fits, fit_ensembles(table, fits), variants)):
        for (p, d), score in zip(own, scores):
            found[p][d].append(score)
    return found


def _mean(scores: Sequence[float]) -> float:
    """Mean of the valid scores; rounded, since sums of errors may differ in their last digits and equal draws must tie."""
    valid = [s for s in scores if not math.isnan(s)]
    return round(sum(valid) / len(valid), 10) if valid else float("-inf")


def fit_tuned_ensemble(table: BinnedTable, space: SearchSpace, tune_iter: int = 12, inner_folds: int = 4, seed: int = 42, columns: Sequence[int] | None = None) -> Ensemble:
    """The best of the drawn parameters by inner folds of the whole table, fitted on all of it."""
    draws = [replace(d, columns=None if columns is None else tuple(columns)) for d in space.draws(tune_iter, seed)]
    if len(draws) > 1:
        means = [_mean(scores) for scores in inner_scores(table, space, [Part()], [draws], [seed], inner_folds)[0]]
        draws = [draws[int(np.argmax(means))]]
    return fit_ensembles(table, [Fit(Part(), draws[0], seed)])[0]


def nested_search(
    table: BinnedTable, spaces: Sequence[SearchSpace], tune_iter: int = 12, inner_folds: int = 4, seed: int = 42,
    columns: Mapping[tuple[int, int], Sequence[int]] | None = None, roles: Sequence[str] = ("test", "train"),
) -> SearchResult:
    """Nested cross-validation: in every repeat and fold, each draw is scored on inner folds and the best is fitted on all training rows.

    All inner fits of a space grow together, over all repeats and folds. ``columns`` gives the features of each repeat and fold, by position;
    ``roles`` names the predictions that are written: of held-out rows, of training rows or of both.
    """
    outer = [(r["repeat"], r["fold"]) for r in table.rows.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()]
    named: list[tuple[str, Fit, Ensemble, str]] = []
    rows: list[tuple] = []
    tried = 0
    for space in spaces:
        seeds = [seed + 1000 * repeat + fold for repeat, fold in outer]
        draws = [[replace(d, columns=None if columns is None else tuple(columns[o])) for d in space.draws(tune_iter, s)] for o, s in zip(outer, seeds)]
        if not outer:
            continue
        single = all(len(own) == 1 for own in draws)
        found = [[[]] for _ in outer] if single else inner_scores(table, space, [Part(*o) for o in outer], draws, seeds, inner_folds)
        finals = []
        for (repeat, fold), own, scores, own_seed in zip(outer, draws, found, seeds):
            means = [_mean(s) for s in scores]
            tried += sum(len(s) for s in scores)
            for d, (params, mean) in enumerate(zip(own, means)):
                rows.append((space.name, repeat, fold, d + 1, _text(params, space), mean if math.isfinite(mean) else None))
            finals.append(Fit(Part(repeat, fold), own[int(np.argmax(means))], own_seed))
        for fit, ensemble in zip(finals, fit_ensembles(table, finals)):
            named.append((space.name, fit, ensemble, _text(fit.params, space)))
    scores = local_table(table.rows.sparkSession, rows, "model string, repeat_id int, fold_id int, draw int, params string, inner_r2 double")
    predictions = table.scratch.table(fold_predictions(table, named, roles), "predictions")
    return SearchResult(predictions, scores, tried, [(name, fit, ensemble) for name, fit, ensemble, _ in named])


def _text(params: TreeParams, space: SearchSpace) -> str:
    return json.dumps({k: asdict(params)[k] for k in space.grid}, sort_keys=True)
