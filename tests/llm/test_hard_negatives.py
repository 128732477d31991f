"""Hard negatives from cover trees, against brute force."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmesh.llm import hard_negatives as module
from trialmesh.llm.hard_negatives import CoverTree, Queries, cover_tree, hard_negatives, lifted, score_bounds, search_tree

SCHEMA = "vec_id bigint, embedding array<double>, label int, q bigint, v string, cell int, `rank` int"


def vector_rows(n: int, dim: int, seed: int) -> list[tuple]:
    """Clusters, a crowd of exact copies with a third of all rows, near copies, ties and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) / math.sqrt(dim)
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=dim) * rng.choice([0.002, 0.05, 0.3]) / math.sqrt(dim)
        if i % 3 == 0:
            v = centres[0] + (rng.normal(size=dim) * 0.001 if i % 2 else 0)
        rows.append((i, [float(x) for x in v * rng.choice([1.0, 1.0, 3.0])], int(rng.integers(0, 4)) if i % 17 else None))
    nan, inf = float("nan"), float("inf")
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [nan] + [1.0] * (dim - 1), 1), (n + 3, [None] + [1.0] * (dim - 1), 1), (n + 4, [-inf] * dim, 2)]
    rows += [(500, [0.25, 0.5], 1), (501, [0.5, 0.25], 1), (502, [0.25, 0.125], 2), (700, [], 1), (701, [], 1), (702, [], 2), (503, [1e18] * dim, 1)]
    rows += [rows[100], rows[100], (100, rows[7][1], rows[7][2]), (None, rows[100][1], rows[100][2]), (None, rows[1][1], 3), (600, [9.0] * dim, 1), (601, [8.0] * dim, 2)]
    return [(*r, 1, "x", 2, 3) for r in rows]


def expected(rows: list[tuple], positives: int, negatives: int) -> Counter:
    usable = []
    for i, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * x) for x in v]
        if sum(x * x for x in whole) < 2**58:
            usable.append((i, whole, label))
    found: Counter = Counter()
    for a, (anchor, v, label) in enumerate(usable):
        if anchor is None or anchor % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i is None, i or 0, i, other) for b, (i, w, other) in enumerate(usable) if b != a and len(w) == len(v)]
        scored.sort(key=lambda s: s[:3])
        for minus, _, _, positive, _ in [s for s in scored if s[4] == label][:positives]:
            fitting = [s for s in scored if s[4] != label and 30 * -minus <= 100 * -s[0] <= 90 * -minus][:negatives]
            for rank, s in enumerate(fitting, 1):
                found[(anchor, positive, rank, s[3], -minus, -s[0])] += 1
    return found


@pytest.mark.parametrize("n, block, counts", [(620, 60, (5, 10)), (420, 2048, (3, 4))])
def test_equal_to_brute_force(spark, monkeypatch, n, block, counts):
    monkeypatch.setattr(module, "BLOCK_VECTORS", block)
    monkeypatch.setattr(module, "CHUNK_QUERIES", 8)
    monkeypatch.setattr(module, "FIRST_CELLS", 2)
    rows = vector_rows(n, 6, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hard_negatives(df, F.col("vec_id") % 100 == 0, positives=counts[0], negatives=counts[1])
    want = expected(rows, *counts)
    assert sum(want.values()) > 50
    assert Counter(tuple(r) for r in got.collect()) == want


def test_other_types_and_empty_tables(spark):
    rows = [("b", [1.0, 0.5], "x"), ("a", [1.0, 0.25], "x"), ("c", [0.5, 0.5], "y"), ("d", [0.25, 0.5], "z")]
    df = spark.createDataFrame(rows, "id string, e array<float>, kind string")
    got = hard_negatives(df, F.col("id") == "a", "id", "kind", "e").collect()
    assert [tuple(r)[:4] for r in sorted(got, key=lambda r: r["rank"])] == [("a", "b", 1, "c"), ("a", "b", 2, "d")]
    assert hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives(df, F.col("id") == "none", "id", "kind", "e").count() == 0


def checked_cover(tree: CoverTree, points: np.ndarray) -> None:
    """Every point is in one leaf, and every node covers all points below it."""
    assert sorted(tree.order.tolist()) == list(range(len(points)))

    def below(node: int) -> np.ndarray:
        if not tree.n[node]:
            found = tree.order[tree.start[node] : tree.stop[node]]
        else:
            found = np.concatenate([below(c) for c in range(tree.first[node], tree.first[node] + tree.n[node])])
        away = np.sqrt(((points[found] - tree.centres[node]) ** 2).sum(axis=1))
        assert away.max() <= tree.radii[node] * (1 + 1e-9) + 1e-9
        return found

    assert len(below(0)) == len(points)


@pytest.mark.parametrize("kind", ["clusters", "even", "equal", "one", "line"])
def test_trees_cover(kind):
    rng = np.random.default_rng(2)
    x = {
        "clusters": rng.normal(size=(10, 8))[rng.integers(0, 10, 1500)] * 300 + rng.normal(size=(1500, 8)) * 5,
        "even": rng.normal(size=(1000, 24)) * 100,
        "equal": np.ones((700, 5)),
        "one": np.ones((1, 3)),
        "line": np.arange(900)[:, None] * np.ones((900, 2)),
    }[kind].astype(np.int64)
    square = float((x * x).sum(axis=1).max())
    points = lifted(x, square)
    tree = cover_tree(points)
    checked_cover(tree, points)
    q = x[:: max(1, len(x) // 20)]
    least, greatest = score_bounds(q.astype(float), tree.centres, tree.radii, square)
    score = q @ x.T
    assert (least[:, 0] <= score.min(axis=1)).all() and (greatest[:, 0] >= score.max(axis=1)).all()
    label, row = rng.integers(0, 3, len(x)), np.arange(len(x))
    low, high = np.full(len(q), score.min()), np.sort(score, axis=1)[:, max(-2, -len(x))]
    asked = Queries(q, np.arange(len(q)) % 3, row[:: max(1, len(x) // 20)], low, high)
    for same in (True, False):
        query, position, found = search_tree(tree, x, label, row, square, asked, 4, same)
        for i in range(len(q)):
            fits = np.flatnonzero(((label == i % 3) == same) & (row != asked.row[i]) & (score[i] >= low[i]) & (score[i] <= high[i]))
            limit = np.sort(score[i, fits])[-4:].min() if len(fits) >= 4 else low[i]
            assert sorted(position[query == i]) == fits[score[i, fits] >= limit].tolist()
            assert (found[query == i] == score[i, position[query == i]]).all()


def test_clusters_are_skipped():
    rng = np.random.default_rng(5)
    x = (np.repeat(rng.normal(size=(32, 16)), 64, axis=0) * 250 + rng.normal(size=(2048, 16)) * 2).astype(np.int64)
    square = float((x * x).sum(axis=1).max())
    tree = cover_tree(lifted(x, square))
    greatest = score_bounds(x[:1].astype(float), tree.centres, tree.radii, square)[1][0]
    fifth = np.sort(x @ x[0])[-5]
    leaves = tree.n == 0
    assert (greatest[leaves] >= fifth).sum() < 0.2 * leaves.sum()


def test_query_matches_its_sql(spark):
    from tests.oracle import connect, differences
    from trialmesh.llm.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    assert differences(QUERIES["op11_hard_negatives"](spark, folder), connect(folder), ORACLES["op11_hard_negatives"]) is None
