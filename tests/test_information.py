"""Nearest-neighbour mutual information against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmesh.operators import information
from trialmesh.operators.information import digamma, neighbour_mutual_information, smallest_distances


def psi(n: int) -> float:
    return sum(1.0 / i for i in range(1, n)) - 0.5772156649015329


def brute(x: np.ndarray, y: np.ndarray, k: int) -> float:
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, k - 1]
    nx, ny = (dx < r[:, None]).sum(axis=1), (dy < r[:, None]).sum(axis=1)
    return max(0.0, psi(len(x)) + psi(k) - float(np.mean([psi(a) + psi(b) for a, b in zip(nx, ny)])))


@pytest.mark.parametrize("cell_rows", [40, 4096])
def test_equal_to_brute_force(spark, cell_rows):
    """Dependent, independent and constant features, and one with two values, whose ties only the noise tells apart."""
    rng = np.random.default_rng(3)
    n = 700
    t = rng.normal(size=n)
    rows = [(f"k{i}", int(i % 3 + 1), float(t[i]), float(t[i] + 0.3 * rng.normal()), float(rng.random() ** 4), float(t[i] > 0.2), 5.0, float(i % 3 == 0)) for i in range(n)]
    rows += [("null", 1, None, 1.0, 1.0, 1.0, 5.0, 0.0), ("gap", 1, 0.1, None, float("nan"), None, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "id string, fold_id int, t double, near double, far double, two double, same double, one_fold double").repartition(4)
    features = ["near", "far", "two", "same", "one_fold"]
    got = {(r["fold_id"], r["feature"]): r["relevance"] for r in neighbour_mutual_information(df, features, "t", "id", cell_rows=cell_rows).collect()}
    from trialmesh.runtime import Scratch

    points, sizes = information.training_points(df, features, "t", "id", "fold_id", 42, Scratch(spark))
    frame = points.toPandas()
    want = {g: brute(own["x"].to_numpy(), own["y"].to_numpy(), 3) for g, own in frame.groupby(["train", "feature"])}
    assert set(got) == set(want) == set(sizes) and (1, "same") not in got and (2, "one_fold") in got
    for g, value in want.items():
        assert abs(got[g] - value) < 1e-9, g
    assert got[1, "near"] > 0.8 and got[1, "far"] < 0.1 and got[1, "two"] > 0.4


def test_distances_in_a_cell():
    rng = np.random.default_rng(1)
    y = np.sort(np.concatenate([rng.random(300), np.full(50, 0.5)]))
    x = rng.random(350) * 0.01
    d = np.maximum(np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :]))
    np.fill_diagonal(d, np.inf)
    np.testing.assert_array_equal(smallest_distances(x, y, x, y, 4, np.arange(350)), np.sort(d, axis=1)[:, :4])
    assert np.isinf(smallest_distances(x[:2], y[:2], x[:1], y[:1], 4)[:, 2:]).all()
    assert smallest_distances(x[:0], y[:0], x[:3], y[:3], 2).shape == (3, 2)


def test_digamma(spark):
    got = spark.range(1, 400).select("id", digamma(F.col("id")).alias("p")).collect()
    assert all(math.isclose(r["p"], psi(r["id"]), rel_tol=0, abs_tol=1e-10) for r in got)


def test_too_few_rows(spark):
    df = spark.createDataFrame([(f"k{i}", i % 2, float(i), float(i)) for i in range(5)], "id string, fold_id int, t double, a double")
    assert neighbour_mutual_information(df, ["a"], "t", "id").count() == 0
    assert neighbour_mutual_information(df.limit(0), ["a"], "t", "id").count() == 0


def test_products_block_by_block(spark):
    from trialmesh.operators.selection import abs_correlation_matrices, fold_products

    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=(60, 9)), np.ones(60)])
    x[:, 3] = x[:, 2] * 2
    names = [f"c{i}" for i in range(10)]
    df = spark.createDataFrame([(int(i % 3), *map(float, row)) for i, row in enumerate(x)], ", ".join(["fold_id int", *[f"{c} double" for c in names]])).repartition(3)
    whole, blocked = fold_products(df, names), fold_products(df, names, block=4)
    ones = np.column_stack([np.ones(60), x])
    for fold in range(3):
        own = ones[np.arange(60) % 3 == fold]
        np.testing.assert_allclose(blocked[fold], own.T @ own, rtol=1e-9)
        np.testing.assert_allclose(whole[fold], blocked[fold], rtol=1e-9)
    matrix = abs_correlation_matrices(df, names)[0]
    assert abs(matrix[2, 3] - 1) < 1e-9 and (matrix[9] == 0).all()
