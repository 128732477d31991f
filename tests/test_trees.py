"""Tree ensembles grown together: against brute force, and alone against inside a search."""

from __future__ import annotations

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmesh.operators import trees
from trialmesh.operators.trees import Fit, Part, TreeParams, bin_table, fit_ensembles, nested_search, search_spaces

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 900
    a, b, c = rng.integers(0, 12, n), rng.random(n).round(2), rng.integers(0, 2, n)
    y = np.where(a > 5, 2.0, 0.0) + b * (1 + c) + rng.normal(size=n) * 0.1
    rows = [(f"k{i}", int(i // 3), float(a[i]) if i % 50 else None, float(b[i]), float(c[i]), float(y[i]), i % 2 + 1, int(i // 3 * 7919 % 3) + 1) for i in range(n)]
    rows += [("none", 5, 1.0, 1.0, 1.0, None, 1, 1), ("nan", 5, 1.0, 1.0, 1.0, float("nan"), 1, 1)]
    df = spark.createDataFrame(rows, "id string, g int, a double, b double, c double, y double, repeat_id int, fold_id int")
    return df.repartition(5)


@pytest.fixture(scope="module")
def table(data):
    return bin_table(data, FEATURES, "y", "id", "g", inner_folds=2, bins=16)


def local(table):
    rows = sorted(table.rows.collect(), key=lambda r: (r["repeat"], r["key"]))
    x = np.array([list(bytes(r["x"])) for r in rows], np.uint8)
    return {c: np.array([r[c] for r in rows]) for c in ("h", "repeat", "fold", "inner", "y", "actual")} | {"x": x}


def brute_tree(x, y, w, params, edges, seed, node=0, depth=0):
    """``{node: (feature, cut)}, {node: mean}`` by looking at every split of every node."""
    weight, total = w.sum(), (w * y).sum()
    values = {node: total / (weight + params.l2)}
    best = (0.0, -1, -1)
    if depth < params.max_depth:
        for f in trees.drawn_features(x.shape[1], seed, node, params).tolist():
            held = np.unique(x[w > 0, f])
            cuts = range(int(x[:, f].max(initial=0)))
            if params.random_cuts:
                cuts = [trees.random_cut(np.asarray(edges[f]), int(held[0]), int(held[-1]), seed, node, f)] if len(held) > 1 else []
            for cut in cuts:
                left = x[:, f] <= cut
                wl, wr = w[left].sum(), w[~left].sum()
                if min(wl, wr) < max(params.min_leaf, 1e-9):
                    continue
                sl = (w * y)[left].sum()
                gain = sl**2 / (wl + params.l2) + (total - sl) ** 2 / (wr + params.l2) - total**2 / (weight + params.l2)
                if gain > best[0]:
                    best = (gain, f, cut)
    splits = {}
    if best[1] >= 0 and weight >= 2 * max(params.min_leaf, 1):
        splits[node] = best[1:]
        left = x[:, best[1]] <= best[2]
        for child, rows in ((2 * node + 1, left), (2 * node + 2, ~left)):
            own = brute_tree(x[rows], y[rows], w[rows], params, edges, seed, child, depth + 1)
            splits |= own[0]
            values |= own[1]
    return splits, values


@pytest.mark.parametrize(
    "params",
    [
        TreeParams(n_trees=2, max_depth=4),
        TreeParams(n_trees=3, max_depth=5, sampling="bootstrap", node_features=0.7, min_leaf=3),
        TreeParams(n_trees=3, max_depth=4, random_cuts=True, node_features="sqrt"),
        TreeParams(n_trees=2, max_depth=3, sampling=0.7, tree_features=0.7, l2=5.0),
    ],
)
@pytest.mark.parametrize("room", [48 * 1024 * 1024, 3000])
def test_forests_equal_brute_force(table, params, room, monkeypatch):
    monkeypatch.setattr(trees, "HISTOGRAM_BYTES", room)
    d = local(table)
    part = Part(1, 2, 0)
    ensemble = fit_ensembles(table, [Fit(part, params, 7)])[0]
    own = part.train(d["repeat"], d["fold"], d["inner"])
    assert 0 < own.sum() < len(own)
    grown = 0
    for number, tree in enumerate(ensemble.trees):
        seed = trees.tree_seed(7, number)
        w = trees.row_weights(d["h"][own], seed, params.sampling)
        splits, values = brute_tree(d["x"][own], d["y"][own].astype(float), w, params, table.edges, seed)
        assert {int(i): (int(tree.feature[i]), int(tree.cut[i])) for i in np.flatnonzero(tree.feature >= 0)} == splits
        grown += len(splits)
        assert all(abs(tree.value[i] - v) <= 1e-9 * abs(v) for i, v in values.items())
    assert grown >= 2 * len(ensemble.trees)


def test_boosting_equals_brute_force(table, monkeypatch):
    """Also across rounds that write the predictions so far."""
    monkeypatch.setattr(trees, "STATE_ROUNDS", 2)
    params = TreeParams(n_trees=5, max_depth=2, min_leaf=2, learning_rate=0.3, l2=1.0, sampling=0.85, tree_features=0.7)
    d = local(table)
    part, other = Part(2, 1), Part(1, 3, 1)
    ensemble, _ = fit_ensembles(table, [Fit(part, params, 3), Fit(other, replace(params, n_trees=3), 3)])
    own = part.train(d["repeat"], d["fold"], d["inner"])
    x, y = d["x"][own], d["y"][own].astype(float)
    known = np.full(len(y), np.rint(y.mean()))
    assert ensemble.base == known[0]
    for number, tree in enumerate(ensemble.trees):
        seed = trees.tree_seed(3, number)
        splits, values = brute_tree(x, y - known, trees.row_weights(d["h"][own], seed, params.sampling), params, table.edges, seed)
        assert {int(i): (int(tree.feature[i]), int(tree.cut[i])) for i in np.flatnonzero(tree.feature >= 0)} == splits
        assert all(abs(tree.value[i] - np.rint(0.3 * v)) <= 1 for i, v in values.items())
        known += tree.value[tree.nodes(x, 2)]
    residual = d["actual"][own] - ensemble.predicted(x)
    assert np.abs(known * table.unit - ensemble.predicted(x)).max() < 1e-9 and (residual**2).mean() < 0.5 * d["actual"][own].var()


def test_search_equals_separate_fits(data, table):
    spaces = [search_spaces(4)["RandomForest"], search_spaces(4)["ExtraTrees"], search_spaces(4)["GradientBoosting"]]
    found = nested_search(table, spaces, tune_iter=5, inner_folds=2)
    outer = sorted({(r["repeat_id"], r["fold_id"]) for r in data.select("repeat_id", "fold_id").collect()})
    assert found.fits == 3 * len(outer) * 5 * 2
    d = local(table)
    scores = found.scores.collect()
    assert len(scores) == 3 * len(outer) * 5
    # A few draws fitted alone, without sharing trees or passes with any other.
    for r in scores[3::31]:
        space = next(s for s in spaces if s.name == r["model"])
        params = replace(space.fixed, **json.loads(r["params"]))
        r2 = []
        for inner in range(2):
            part = Part(r["repeat_id"], r["fold_id"], inner)
            alone = fit_ensembles(table, [Fit(part, params, 42 + 1000 * r["repeat_id"] + r["fold_id"])])[0]
            own = part.test(d["repeat"], d["fold"], d["inner"])
            error = d["actual"][own] - alone.predicted(d["x"][own])
            r2.append(1 - (error**2).sum() / ((d["actual"][own] - d["actual"][own].mean()) ** 2).sum())
        assert abs(np.mean(r2) - r["inner_r2"]) < 1e-9
    best = {}
    for r in scores:
        k = (r["model"], r["repeat_id"], r["fold_id"])
        best[k] = max(best.get(k, (-9.0, "")), (r["inner_r2"], r["params"]))
    rows = found.predictions.collect()
    assert {(r["model"], r["repeat_id"], r["fold_id"], r["best_params"]) for r in rows} == {(*k, v[1]) for k, v in best.items()}
    tested = [r for r in rows if r["role"] == "test"]
    assert len(tested) == 3 * 900
    for model in ("RandomForest", "ExtraTrees", "GradientBoosting"):
        pairs = np.array([(r["actual"], r["predicted"]) for r in tested if r["model"] == model])
        assert 1 - ((pairs[:, 0] - pairs[:, 1]) ** 2).sum() / ((pairs[:, 0] - pairs[:, 0].mean()) ** 2).sum() > 0.5


def test_scoring_new_rows(spark, data, table):
    ensemble = fit_ensembles(table, [Fit(Part(), TreeParams(n_trees=3, max_depth=3, sampling="bootstrap"))])[0]
    scored = ensemble.score(data.where("y IS NOT NULL AND NOT isnan(y)"))
    d = local(table)
    assert np.allclose(sorted(r["predicted"] for r in scored.collect()), sorted(ensemble.predicted(d["x"])))
    shares = ensemble.importances()
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["a"] > 0.5
    assert ensemble.score(data.limit(0)).count() == 0
    constant = spark.createDataFrame([("a", 1, 1.0, 1, 1), ("b", 2, 1.0, 1, 2)], "id string, g int, y double, repeat_id int, fold_id int").withColumn("a", F.lit(2.0))
    flat = bin_table(constant, ["a"], "y", "id", "g")
    assert fit_ensembles(flat, [Fit(Part(1, 1), TreeParams(n_trees=1))])[0].trees[0].feature[0] == -1
    empty = bin_table(data.where("y > 1e9"), FEATURES, "y", "id", "g")
    assert nested_search(empty, [search_spaces(2)["RandomForest"]]).predictions.count() == 0


def _root_jobs(params, inners=range(4), **part):
    fits = [trees.Fit(trees.Part(inner=i, **part), p) for p in params for i in inners]
    made = [trees.Tree.empty(f.params.max_depth) for f in fits]
    return [(t, trees._Job(t, f.part, f.params, trees.tree_seed(f.seed, 0), m.feature, m.cut, 0, np.zeros(1, int))) for t, (f, m) in enumerate(zip(fits, made))]


def test_trees_that_are_the_same_so_far_share_their_sums():
    params = [trees.TreeParams(min_leaf=leaf, max_depth=depth, sampling="bootstrap") for leaf, depth in ((1, 3), (2, 3), (4, 5))]
    units = trees._units(_root_jobs(params), 5, False, {})
    assert len(units) == 1 and len(units[0].jobs) == 12 and units[0].cells == 5
    # Own targets, other draws or other rows keep trees apart.
    assert len(trees._units(_root_jobs(params), 5, True, {})) == 12
    assert len(trees._units(_root_jobs(params) + _root_jobs([trees.TreeParams(sampling=0.7)]), 5, False, {})) == 2
    sums = np.random.default_rng(1).integers(0, 9, units[0].shape(6)).astype(float)
    for _, job in units[0].jobs:
        rest = np.delete(sums, job.part.inner, axis=2).sum(axis=2).transpose(2, 1, 3, 0)
        assert (units[0].histogram(sums, job) == rest).all()


def test_routes_pass_values_of_early_leaves_down():
    tree = trees.Tree.empty(3)
    tree.feature[[0, 2, 6]], tree.cut[[0, 2, 6]] = [1, 0, 1], [3, 5, 200]
    tree.value[:] = np.arange(15) * 1.5
    x = np.random.default_rng(2).integers(0, 256, (500, 2)).astype(np.uint8)
    for depth in (1, 2, 3):
        ensemble = trees.Ensemble(("a", "b"), ((), ()), 1.0, 0.0, trees.TreeParams(max_depth=3), [tree])
        assert (ensemble.predicted(x, depth=depth) == tree.value[tree.nodes(x, depth)]).all()


def test_boosted_fits_grow_alike_in_one_task_and_by_passes(table, monkeypatch):
    fits = [
        Fit(Part(2, 1), TreeParams(n_trees=5, max_depth=3, min_leaf=2, learning_rate=0.3, l2=1.0, sampling=0.85, tree_features=0.7), 3),
        Fit(Part(1, 3, 1), TreeParams(n_trees=3, max_depth=2, learning_rate=0.1, sampling="bootstrap"), 5),
        Fit(Part(1, 2, 0), TreeParams(n_trees=4, max_depth=4, learning_rate=0.5, node_features=0.7), 5),
    ]
    alone = fit_ensembles(table, fits)
    monkeypatch.setattr(trees, "LOCAL_BYTES", 0)
    monkeypatch.setattr(trees, "STATE_ROUNDS", 2)
    for room in (trees.STATE_BYTES, 20_000):
        monkeypatch.setattr(trees, "STATE_BYTES", room)
        for a, b in zip(alone, fit_ensembles(table, fits)):
            assert a.base == b.base and len(a.trees) == len(b.trees) == a.params.n_trees
            for one, other in zip(a.trees, b.trees):
                assert all((getattr(one, c) == getattr(other, c)).all() for c in ("feature", "cut", "value", "weight", "total"))
    d = local(table)
    for k, predicted in alone[0].staged(d["x"], [(4, 3), (2, 3), (2, 1), (5, 3)]):
        n_trees, depth = [(4, 3), (2, 3), (2, 1), (5, 3)][k]
        assert (predicted == alone[0].predicted(d["x"], n_trees, depth)).all()


def test_boosted_cv_searches_the_whole_space(monkeypatch):
    from trialmesh.plans import modelling

    class Seen(Exception):
        pass

    def search(table, spaces, **options):
        raise Seen(spaces)

    for name, value in (("training_rows", lambda *a: None), ("binned", lambda *a: None)):
        monkeypatch.setattr(modelling, name, value)
    monkeypatch.setattr(trees, "nested_search", search)
    with pytest.raises(Seen) as seen:
        modelling.boosted_cv(None, "")
    (space,) = seen.value.args[0]
    assert space.grid["n_trees"] == [120, 200, 300, 500] and space.grid["learning_rate"] == [0.01, 0.02, 0.03, 0.05]


@pytest.mark.parametrize("n_bins", [2, 12, 32, 200])
@pytest.mark.parametrize("depth", range(1, 9))
def test_lookups_route_rows_as_steps_do(n_bins, depth):
    rng = np.random.default_rng(depth)
    x = rng.integers(0, n_bins, (400, 5)).astype(np.uint8)
    tree = trees.Tree.empty(8)
    tree.feature[:], tree.cut[:] = rng.integers(-1, 5, 511), rng.integers(0, n_bins - 1, 511)
    tree.feature[0] = 2
    want = np.zeros(len(x), int)
    for _ in range(depth):
        own = tree.feature[want]
        want = 2 * want + 1 + ((own >= 0) & (x[np.arange(len(x)), np.maximum(own, 0)] > tree.cut[want]))
    bins = trees._Bins(x, n_bins)
    lookups = trees._reachable(tree.feature, tree.cut, min(depth, 6), 5, n_bins)
    for own in (lookups, None):
        assert (bins.leaves(tree.feature, tree.cut, depth, own) + 2**depth - 1 == want).all()
        assert (trees._Bins(x[:0], n_bins).leaves(tree.feature, tree.cut, depth, own) == []).all()


def test_inner_fits_share_the_draws_of_their_rows():
    units = trees._units(_root_jobs([trees.TreeParams(sampling="bootstrap"), trees.TreeParams(sampling="bootstrap", node_features=0.4)], inners=[0]), 5, False, {})
    units += trees._units(_root_jobs([trees.TreeParams(sampling="bootstrap")], inners=[1]), 5, False, {})
    assert len(units) == 3 and len({u.part for u in units}) == 2 and len({u.draw for u in units}) == 1
