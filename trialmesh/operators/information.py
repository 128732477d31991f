"""Mutual information by nearest neighbours (Kraskov, Stoegbauer and Grassberger), per training fold and feature.

For every training row: the distance to its k-th neighbour in the plane of feature and target (the larger of the two differences),
then how many rows lie nearer than that in the feature alone and in the target alone. The plane is cut into cells of bounded size,
strips by the feature and bands by the target inside a strip. A row is searched in its own cell first; the distance found there says
which other cells can hold a nearer row, and only those are visited. Counts in a margin come from sorted strips with offsets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.text import finite
from ..runtime import Scratch, local_table

NEIGHBOURS = 3
CELL_ROWS = 4096
MAX_CELLS = 20_000
NOISE = 1e-10
CONSTANT_SD = 1e-12
_GROUP = ["train", "feature"]


def digamma(n: Column) -> Column:
    """The digamma function of a positive whole number."""
    small = [-0.5772156649015329]
    for i in range(1, 8):
        small.append(small[-1] + 1.0 / i)
    x = n.cast("double")
    far = F.log(x) - 0.5 / x - 1.0 / (12 * x**2) + 1.0 / (120 * x**4) - 1.0 / (252 * x**6) + 1.0 / (240 * x**8)
    return F.when(n <= len(small), F.element_at(F.array(*[F.lit(v) for v in small]), F.greatest(F.least(n.cast("int"), F.lit(len(small))), F.lit(1)))).otherwise(far)


def training_points(df: DataFrame, features: Sequence[str], target: str, key: str, fold: str, seed: int, scratch: Scratch) -> tuple[DataFrame, dict]:
    """``train, feature, key, raw, x, y`` for each training row of each fold and feature, and the rows per (fold, feature).

    Both sides are divided by their deviation in the training rows; a noise of ``NOISE`` by hash of the key tells equal values
    apart. Features that are constant in a training set are left out. Null and non-finite values of a feature count as zero, rows
    without a target are left out.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().collect() if r[0] is not None)
    others = F.filter(F.array(*[F.lit(f).cast("int") for f in folds]), lambda f: f != F.col(fold))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(finite(c), F.lit(0.0)).alias("v")) for c in features])
    long = df.where(finite(target).isNotNull() & F.col(fold).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(target).cast("double").alias("t"), others.alias("trains"), F.inline(pairs)
    )
    long = scratch.table(long.select("key", "t", "feature", "v", F.explode("trains").alias("train")), "long")
    stats = long.groupBy(*_GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("v").alias("sv"), F.stddev_pop("t").alias("st"), F.avg(F.abs("v")).alias("mv"), F.avg(F.abs("t")).alias("mt")
    )
    rows = [r for r in stats.collect() if r["sv"] > CONSTANT_SD]
    # One row per fold and feature.
    scales = local_table(df.sparkSession, [(r["train"], r["feature"], r["sv"], r["st"] or 1.0, max(1.0, r["mv"] / r["sv"]), max(1.0, r["mt"] / (r["st"] or 1.0))) for r in rows], "train int, feature string, sv double, st double, nv double, nt double")
    noise = lambda side, size: NOISE * F.col(size) * (uniform(F.col("key"), F.col("feature"), side, seed) - 0.5)
    points = long.join(F.broadcast(scales), _GROUP).select(
        *_GROUP, "key", (F.col("v") / F.col("sv")).alias("raw"), (F.col("v") / F.col("sv") + noise("x", "nv")).alias("x"), (F.col("t") / F.col("st") + noise("y", "nt")).alias("y")
    )
    return scratch.table(points, "points"), {(r["train"], r["feature"]): r["n"] for r in rows}


def _edges(df: DataFrame, by: Sequence[str], column: str, parts: int) -> dict[tuple, np.ndarray]:
    """Approximate quantiles that cut each group into about ``parts``; equal edges are one."""
    if parts <= 1:
        return {}
    steps = [i / parts for i in range(1, parts)]
    found = df.groupBy(*by).agg(F.percentile_approx(column, steps, max(1000, 20 * parts)).alias("e")).collect()
    return {tuple(r[c] for c in by): np.unique(np.array(r["e"], dtype=float)) for r in found}


def smallest_distances(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """The ``k`` smallest of max(|dx|, |dy|) from each query to the points, ascending, infinite where there are fewer.

    Points are ordered by ``py``. A window around the query's place is doubled until what lies outside is too far in ``y``.
    ``own``: each query's position among the points, which is left out.
    """
    n = len(px)
    out = np.full((len(qx), k), np.inf)
    waiting = np.arange(len(qx)) if n else np.zeros(0, int)
    place = np.searchsorted(py, qy)
    width = 4 * k
    while len(waiting):
        step = max(1, 2_000_000 // (2 * width))
        undone = []
        for start in range(0, len(waiting), step):
            rows = waiting[start : start + step]
            at = place[rows][:, None] + np.arange(-width, width)
            inside = (at >= 0) & (at < n)
            at = np.clip(at, 0, n - 1)
            d = np.maximum(np.abs(px[at] - qx[rows][:, None]), np.abs(py[at] - qy[rows][:, None]))
            d[~inside] = np.inf
            if own is not None:
                d[at == own[rows][:, None]] = np.inf
            m = min(k, d.shape[1])
            near = np.sort(np.partition(d, m - 1, axis=1)[:, :m], axis=1)
            low, high = place[rows] - width, place[rows] + width - 1
            ahead = np.where(low > 0, qy[rows] - py[np.clip(low, 0, n - 1)], np.inf)
            behind = np.where(high < n - 1, py[np.clip(high, 0, n - 1)] - qy[rows], np.inf)
            done = near[:, -1] <= np.minimum(ahead, behind)
            out[rows[done], :m] = near[done]
            undone.append(rows[~done])
        waiting = np.concatenate(undone)
        width *= 2
    return out


def neighbour_distances(points: DataFrame, sizes: dict, k: int, scratch: Scratch, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``points`` with ``r``, the distance to the ``k``-th nearest other row of the same fold and feature."""
    rows_per_cell = max(cell_rows, math.ceil(max(sizes.values(), default=0) / MAX_CELLS), 2 * k)
    parts = math.ceil(math.sqrt(max(sizes.values(), default=0) / rows_per_cell))
    # Strips end between different values, so a frequent value stays in one strip and is cut into bands.
    strips = _edges(points, _GROUP, "raw", parts)

    def stripped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            strip = np.zeros(len(batch), np.int64)
            for (train, feature), edges in strips.items():
                own = ((batch["train"] == train) & (batch["feature"] == feature)).to_numpy()
                strip[own] = np.searchsorted(edges, batch["raw"].to_numpy()[own], side="left")
            yield batch.assign(strip=strip)

    fields = "train int, feature string, key string, raw double, x double, y double, strip bigint"
    placed = scratch.table(points.mapInPandas(stripped, fields), "strips")
    loads = {(r["train"], r["feature"], r["strip"]): r["n"] for r in placed.groupBy(*_GROUP, "strip").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max([1, *[math.ceil(n / rows_per_cell) for n in loads.values()]])
    bands = {}
    for group, edges in _edges(placed, [*_GROUP, "strip"], "y", most).items():
        wanted = math.ceil(loads[group] / rows_per_cell)
        bands[group] = edges[np.unique(np.linspace(0, len(edges) - 1, wanted + 1).astype(int)[1:-1])] if wanted > 1 else edges[:0]

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            band = np.zeros(len(batch), np.int64)
            for group, rows in batch.groupby([*_GROUP, "strip"]).indices.items():
                if group in bands:
                    band[rows] = np.searchsorted(bands[group], batch["y"].to_numpy()[rows], side="left")
            yield batch.assign(band=band)

    celled = scratch.table(placed.mapInPandas(banded, fields + ", band bigint").drop("raw"), "cells")
    cell = [*_GROUP, "strip", "band"]
    boxes: dict[tuple, list[tuple]] = {}
    for r in celled.groupBy(*cell).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).collect():
        boxes.setdefault((r["train"], r["feature"]), []).append((r["strip"], r["band"], r["x0"], r["x1"], r["y0"], r["y1"]))
    boxed = {g: np.array(sorted(b)) for g, b in boxes.items()}

    def at_home(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("y", kind="stable")
        x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
        near = smallest_distances(x, y, x, y, k, np.arange(len(x)))
        box = boxed[frame["train"].iloc[0], frame["feature"].iloc[0]]
        r = near[:, -1]
        home = (box[:, 0] == frame["strip"].iloc[0]) & (box[:, 1] == frame["band"].iloc[0])
        others = box[~home]
        found = [[] for _ in r]
        for start in range(0, len(r), 1024):
            rows = slice(start, start + 1024)
            apart = np.maximum(
                np.maximum(others[None, :, 2] - x[rows, None], x[rows, None] - others[None, :, 3]), np.maximum(others[None, :, 4] - y[rows, None], y[rows, None] - others[None, :, 5])
            )
            for i, c in zip(*np.nonzero(apart < r[rows, None])):
                found[start + i].append((int(others[c, 0]), int(others[c, 1])))
        return frame.assign(near=list(near), others=[[{"strip": s, "band": b} for s, b in f] for f in found])

    schema = "train int, feature string, key string, x double, y double, strip bigint, band bigint, near array<double>, others array<struct<strip: bigint, band: bigint>>"
    first = scratch.table(celled.groupBy(*cell).applyInPandas(at_home, schema), "first")
    asked = first.select(*_GROUP, "key", "x", "y", F.explode("others").alias("o")).select(*_GROUP, "key", "x", "y", "o.strip", "o.band")

    def elsewhere(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return queries.iloc[:0][["train", "feature", "key"]].assign(near=pd.Series(dtype=object))
        rows = rows.sort_values("y", kind="stable")
        near = smallest_distances(rows["x"].to_numpy(), rows["y"].to_numpy(), queries["x"].to_numpy(), queries["y"].to_numpy(), k)
        return queries[["train", "feature", "key"]].assign(near=list(near))

    second = asked.groupBy(*cell).cogroup(celled.groupBy(*cell)).applyInPandas(elsewhere, "train int, feature string, key string, near array<double>")
    merged = first.select(*_GROUP, "key", "near").unionByName(second).groupBy(*_GROUP, "key").agg(F.element_at(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k), k).alias("r"))
    return scratch.table(first.select(*_GROUP, "key", "x", "y").join(merged, [*_GROUP, "key"]), "distances")


def margin_counts(points: DataFrame, sizes: dict, scratch: Scratch, cell_rows: int = 32 * CELL_ROWS) -> DataFrame:
    """``train, feature, side, key, c``: rows (itself included) nearer than ``r`` in ``x`` alone and in ``y`` alone."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("v")) for s in ("x", "y")])
    long = points.select(*_GROUP, "key", "r", F.inline(sides))
    group = [*_GROUP, "side"]
    edges = _edges(long, group, "v", math.ceil(max(sizes.values(), default=0) / max(cell_rows, math.ceil(max(sizes.values(), default=0) / MAX_CELLS))))
    # What is exactly r away doesn't count, whatever the sums below round to.
    reach = F.col("r") - 2e-15 * (F.abs("v") + F.col("r"))
    ends = F.array(F.struct(F.lit(0).alias("kind"), F.col("v").alias("w")), F.struct(F.lit(1).alias("kind"), (F.col("v") + reach).alias("w")), F.struct(F.lit(-1).alias("kind"), (F.col("v") - reach).alias("w")))
    events = long.select(*group, "key", F.inline(ends))

    def stripped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            strip = np.zeros(len(batch), np.int64)
            for own, rows in batch.groupby(group).indices.items():
                if own in edges:
                    strip[rows] = np.searchsorted(edges[own], batch["w"].to_numpy()[rows], side="left")
            yield batch.assign(strip=strip)

    fields = "train int, feature string, side string, key string, kind int, w double"
    placed = scratch.table(events.mapInPandas(stripped, fields + ", strip bigint"), "events")
    counts = placed.groupBy(*group, "strip").agg(F.count_if(F.col("kind") == 0).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most MAX_CELLS strips per group.
    offsets = F.broadcast(counts.select(*group, "strip", before.alias("before")))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(frame["w"].to_numpy()[(frame["kind"] == 0).to_numpy()])
        asked = frame[frame["kind"] != 0]
        w, upper = asked["w"].to_numpy(), (asked["kind"] > 0).to_numpy()
        below = np.where(upper, np.searchsorted(values, w, side="right"), np.searchsorted(values, w, side="left"))
        return asked[[*group, "key", "kind", "strip"]].assign(below=below.astype(np.int64))

    found = placed.groupBy(*group, "strip").applyInPandas(count, "train int, feature string, side string, key string, kind int, strip bigint, below bigint")
    return found.join(offsets, [*group, "strip"]).groupBy(*group, "key").agg(F.sum(F.col("kind") * (F.col("below") + F.col("before"))).alias("c"))


def neighbour_mutual_information(
    df: DataFrame, features: Sequence[str], target: str, key: str, fold: str = "fold_id", k: int = NEIGHBOURS, seed: int = 42,
    cell_rows: int = CELL_ROWS, scratch: Scratch | None = None,
) -> DataFrame:
    """``fold, feature, relevance``: mutual information (nats, at least 0) of each feature and the target in the training rows of each fold.

    ``key`` tells rows apart. Features that are constant in a training set have no row, as have training sets of ``k`` rows or fewer.
    """
    scratch = scratch or Scratch(df.sparkSession)
    points, sizes = training_points(df, features, target, key, fold, seed, scratch)
    sizes = {g: n for g, n in sizes.items() if n > k}
    distances = neighbour_distances(points, sizes, k, scratch, cell_rows)
    counted = margin_counts(distances.where(~F.isnan("r") & (F.col("r") < float("inf"))), sizes, scratch, 32 * cell_rows)
    means = counted.groupBy(*_GROUP).agg(F.sum(digamma(F.col("c"))).alias("s"), (F.count(F.lit(1)) / 2).cast("bigint").alias("n"))
    information = digamma(F.col("n")) + digamma(F.lit(k)) - F.col("s") / F.col("n")
    return means.select(F.col("train").alias(fold), "feature", F.greatest(information, F.lit(0.0)).alias("relevance"))
