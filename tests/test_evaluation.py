import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialmesh.functions.draws import key_hash
from trialmesh.operators import metrics, models, resampling, selection, splits


def preds_frame(seed=3, n=400):
    rng = np.random.default_rng(seed)
    actual = np.round(rng.normal(size=n), 2)
    parts = []
    for model, noise in (("a", 0.3), ("b", 1.0)):
        parts.append(pd.DataFrame({"model": model, "sample_id": [f"s{i}" for i in range(n)], "g": np.arange(n) % 37, "actual": actual, "predicted": np.round(actual + noise * rng.normal(size=n), 2)}))
    frame = pd.concat(parts, ignore_index=True)
    frame.loc[5, "predicted"] = np.nan
    frame.loc[6, "predicted"] = np.inf
    return frame


def closed_form(a, p):
    ra, rp = pd.Series(a).rank(), pd.Series(p).rank()
    return {
        "R2": 1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum(), "RMSE": np.sqrt(((a - p) ** 2).mean()), "MAE": np.abs(a - p).mean(),
        "Pearson": np.corrcoef(a, p)[0, 1], "Spearman": np.corrcoef(ra, rp)[0, 1], "Mean_bias": (p - a).mean(),
    }


@pytest.mark.parametrize("cell", [40, 10**6])
def test_metric_table(spark, cell):
    frame = preds_frame()
    table = metrics.metric_table(spark.createDataFrame(frame), ["model"], rows_per_cell=cell).toPandas().set_index("model")
    for model, part in frame[np.isfinite(frame["predicted"])].groupby("model"):
        for name, value in closed_form(part["actual"].to_numpy(), part["predicted"].to_numpy()).items():
            assert table.loc[model, name] == pytest.approx(value, abs=1e-9), name
        assert table.loc[model, "n"] == len(part)


def test_degenerate_groups(spark):
    rows = [("one", "x", 1.0, 1.0), ("two", "x", 1.0, 1.5), ("two", "y", 2.0, 2.0)]
    rows += [("same_y_exact", k, 1.0, 1.0) for k in "xyz"] + [("same_y", k, 1.0, v) for k, v in zip("xyz", (1.0, 2.0, 3.0))]
    rows += [("same_p", k, v, 1.0) for k, v in zip("xyz", (1.0, 2.0, 3.0))] + [("empty", "x", None, 1.0)]
    table = metrics.metric_table(spark.createDataFrame(rows, "model string, sample_id string, actual double, predicted double"), ["model"])
    found = {r["model"]: r for r in table.collect()}
    assert "empty" not in found
    assert found["one"]["R2"] is None and found["two"]["R2"] == pytest.approx(0.5)
    assert found["two"]["Spearman"] is None and found["two"]["Top20_recall"] is None and found["two"]["Pearson"] is None
    assert found["same_y_exact"]["R2"] == 1.0 and found["same_y"]["R2"] == 0.0
    assert found["same_y"]["Spearman"] is None and found["same_p"]["Pearson"] is None and found["same_y"]["Calibration_slope"] is None


def test_bootstrap_weights_equal_copies(spark):
    frame = preds_frame()
    frame = frame[np.isfinite(frame["predicted"])]
    df = spark.createDataFrame(frame)
    weights = resampling.bootstrap_weights(resampling.group_index(df, "g"), "g", 8).toPandas()
    assert (weights.groupby("bootstrap_id")["w"].sum() == frame["g"].nunique()).all()
    moments = resampling.cluster_bootstrap(df, "g", 8).toPandas().set_index(["model", "bootstrap_id"])
    ranks = resampling.bootstrap_rank_metrics(df, "g", 8, rows_per_cell=60).toPandas().set_index(["model", "bootstrap_id"])
    merged = frame.merge(weights, on="g")
    for key, part in merged.groupby(["model", "bootstrap_id"]):
        copies = part.loc[part.index.repeat(part["w"])]
        want = closed_form(copies["actual"].to_numpy(), copies["predicted"].to_numpy())
        for name in ("R2", "RMSE", "MAE", "Pearson", "Mean_bias"):
            assert moments.loc[key, name] == pytest.approx(want[name], abs=1e-9)
        assert ranks.loc[key, "Spearman"] == pytest.approx(want["Spearman"], abs=1e-9)


def test_paired_bootstrap_with_ranks(spark):
    frame = preds_frame()
    out = resampling.paired_bootstrap(spark.createDataFrame(frame), "g", 120, rank_iterations=10).toPandas().set_index("metric")
    assert set(out.index) == {"R2", "RMSE", "MAE", "Spearman", "Top20_recall"}
    assert out.loc["R2", "difference_a_minus_b"] > 0 and bool(out.loc["R2", "interval_excludes_zero"])
    assert (out["CI_low"] <= out["CI_high"]).all() and out.loc["R2", "bootstrap_iterations"] == 120


@pytest.mark.parametrize("cell", [20, 10**6])
def test_grouped_folds(spark, cell):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 101).alias("g"))
    out = splits.grouped_kfold(df, "g", k=5, repeats=2, rows_per_cell=cell).toPandas()
    assert len(out) == 1800
    assert (out.groupby(["repeat_id", "g"])["fold_id"].nunique() == 1).all()
    sizes = out.drop_duplicates(["repeat_id", "g"]).groupby(["repeat_id", "fold_id"]).size().unstack()
    assert ((sizes.max(axis=1) - sizes.min(axis=1)) <= 1).all()
    assert not (out[out.repeat_id == 1].set_index("id")["fold_id"].sort_index() == out[out.repeat_id == 2].set_index("id")["fold_id"].sort_index()).all()


def test_assignments_cover_and_do_not_leak(spark):
    df = spark.range(300).select("id", (F.col("id") % 40).alias("g"))
    long = splits.split_assignments(splits.grouped_kfold(df, "g", k=4, repeats=2), 4)
    assert [tuple(r) for r in splits.split_coverage(long, "id").orderBy("repeat_id").collect()] == [(1, 300, 0), (2, 300, 0)]
    assert splits.split_leakage(long, "g").agg(F.sum("n_leaking_groups")).first()[0] == 0


def test_tasks_drop_remainders(spark):
    sizes = {"a": 19, "b": 20, "c": 41, "d": 60}
    rows = [(g, f"{g}{i}", float(i % 7)) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id string, y double")
    tasks = splits.chunk_tasks(df, "g", "id", 20, rows_per_cell=15)
    assert {r["g"]: r["n"] for r in tasks.groupBy("g").agg(F.count_distinct("task_id").alias("n")).collect()} == {"b": 1, "c": 2, "d": 3}
    dealt = splits.alternate_by_response(tasks, "y", "id", 12, 8)
    assert {tuple(r) for r in dealt.groupBy("task_id", "role").count().select("role", "count").distinct().collect()} == {("support", 12), ("query", 8)}


def test_rounds(spark):
    df = spark.createDataFrame([(f"s{i}", r) for r, n in (("R1", 12), ("R2", 8), ("R10", 5), ("UNKNOWN", 3)) for i in range(n)], "id string, Round string")
    assert splits.rounds_in_order(df, "Round") == ["R1", "R2", "R10"]
    stages = {r["stage"]: r["count"] for r in splits.cumulative_stages(df, "Round").groupBy("stage").count().collect()}
    assert stages == {"R1+R2": 20, "R1+R2+R10": 25}
    assert {r["role"]: r["count"] for r in splits.latest_round_query(df, "Round").groupBy("role").count().collect()} == {"query": 5, "support": 20}
    with pytest.raises(ValueError):
        splits.latest_round_query(df, "Round", ["9"], ["R10"])
    held = splits.leave_one_round_out(df, "Round").groupBy("test_round", "role").count().collect()
    assert {(r["test_round"], r["role"]): r["count"] for r in held}[("R10", "train")] == 23


def test_ensemble_and_metadata(spark):
    df = spark.createDataFrame(preds_frame()).dropna()
    with pytest.raises(ValueError):
        metrics.ensemble_predictions(df, ["a", "missing"])
    old = df.where("model = 'a'").select(F.col("sample_id").alias("candidate_id"), "actual", "predicted").dropDuplicates(["candidate_id"])
    ref = old.select("candidate_id", F.lit(1).alias("formulation_group"), F.lit("x").alias("formulation_signature"), F.hash("candidate_id").alias("sample_index"))
    assert metrics.attach_metadata(old, ref).count() == old.count()
    assert metrics.attach_metadata(old, ref.limit(3)) is None
    assert metrics.attach_metadata(old.drop("actual"), ref) is None
    doubled = ref.unionByName(ref)
    assert metrics.attach_metadata(old, doubled) is None


def test_frozen_panel_needs_six(spark):
    panel = spark.createDataFrame([(f"c{i}", "H1_HighConsensus" if i < 6 else "L1_LowControl", i / 12, i / 12, i / 10) for i in range(12)], "code string, selection_role string, consensus_rank double, all_model_raw_mean double, pred_m double")
    measured = spark.createDataFrame([(f"c{i}", float(i)) for i in range(11)] + [("zz", 1.0)], "code string, actual double")
    out = metrics.evaluate_frozen(panel, measured, "code")
    row = out["summary"].first()
    assert row["n"] == 11 and row["Spearman_actual_vs_frozen_consensus_rank"] == pytest.approx(1.0) and row["Top3_overlap"] == 1.0
    assert out["per_model"].first()["Spearman"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        metrics.evaluate_frozen(panel, measured.limit(5), "code")


def training(spark, n=600):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 4))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=n) + 5
    frame = pd.DataFrame(x, columns=list("abcd")).assign(y=y, id=[f"s{i}" for i in range(n)], g=np.arange(n) % 60, fold_id=np.arange(n) % 60 % 3 + 1, one=1.0)
    return frame, spark.createDataFrame(frame)


def test_ridge_closed_form(spark):
    frame, df = training(spark)
    oof, fitted = models.ridge_cross_validate(df, list("abcd") + ["one"], "y", "id", "g", alphas=[3.0])
    got = oof.toPandas().set_index("sample_id")["predicted"]
    for fold in (1, 2, 3):
        train, test = frame[frame.fold_id != fold], frame[frame.fold_id == fold]
        mean, sd = train[list("abcd")].mean(), train[list("abcd")].std(ddof=0)
        z = ((train[list("abcd")] - mean) / sd).to_numpy()
        beta = np.linalg.solve(z.T @ z + 3.0 * np.eye(4), z.T @ (train.y - train.y.mean()).to_numpy())
        want = ((test[list("abcd")] - mean) / sd).to_numpy() @ beta + train.y.mean()
        np.testing.assert_allclose(got.loc[test.id].to_numpy(), want, rtol=1e-9)
    _, tuned = models.ridge_cross_validate(df, list("abcd"), "y", "id", "g")
    assert all(m.alpha < 10 for m in tuned.values())


def test_selection_prefers_signal(spark):
    _, df = training(spark)
    chosen = selection.mrmr_select(df, list("abcd") + ["one"], "y", "id", k=2).toPandas()
    assert set(chosen[chosen.aux_rank == 1].feature) == {"a"} and "one" not in set(chosen.feature)
    matrix = selection.abs_correlation_matrices(df, ["a", "b", "one"])[1]
    assert matrix[0, 2] == 0.0 and 0 <= matrix[0, 1] < 0.3


def test_cross_validation_of_trees(spark):
    _, df = training(spark, 300)
    spec = models.model_specs(small=True)["RandomForest"]
    spec = models.ModelSpec(spec.name, spec.build, {"numTrees": [5], "maxDepth": [2, 5]})
    preds, chosen = models.cross_validate(df, [spec], ["a"], "y", "id", "g", ["b", "c", "one"], k_aux=1, tune_iter=2)
    assert set(chosen.toPandas()["feature"]) == {"b"}
    oof = models.out_of_fold(preds)
    assert oof.count() == 300 and oof.select("sample_id").distinct().count() == 300
    assert metrics.regression_metrics(oof, ["model"]).first()["R2"] > 0.5
    folds = metrics.fold_metrics(preds, ["model", "fold_id"])
    assert folds.count() == 3 and folds.where("R2_overfit_gap is null").count() == 0


def test_hash_is_plain_md5(spark):
    import hashlib

    got = spark.range(1).select(key_hash(F.lit("k"), 7)).first()[0]
    assert got == hashlib.md5(b"k|7").hexdigest()


def test_transfer_counts_rows_without_a_target(spark):
    _, rows = training(spark, 200)
    rows = rows.withColumn("task", F.lit("t"))
    gaps = rows.withColumn("y", F.when(F.col("g") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("y")))
    runs = models.transfer_evaluation(rows, gaps, list("abcd"), "y", "y", "task", "id", repeats=1).collect()
    assert all(r["n_test"] == r["n_query"] and r["valid_prediction"] for r in runs)
    assert any(r["n_finite"] < r["n_test"] for r in runs)


def test_registered_bootstraps_draw_two_thousand_times(spark):
    from trialmesh.plans import evaluation

    drawn = evaluation.cluster_bootstrap(spark, "/root/testdata/sf0.001").groupBy("model").count().collect()
    assert drawn and all(r["count"] == 2000 for r in drawn)
    assert evaluation.RANK_REPLICATES == 2000


def test_many_groups_get_poisson_weights(spark):
    """Beyond the size that is broadcast: the sums are those of rows copied by the same weights, and spread like group draws."""
    from trialmesh.functions.draws import mix64, poisson64

    rng = np.random.default_rng(12)
    n = 3000
    y = rng.normal(size=n)
    frame = pd.DataFrame({"model": rng.choice(["a", "b"], n), "g": rng.integers(0, 400, n), "actual": y, "predicted": y + rng.normal(size=n) * 0.5})
    df = spark.createDataFrame(frame).repartition(4)
    got = resampling.cluster_bootstrap(df, "g", 300, max_groups=10).toPandas().set_index(["model", "bootstrap_id"])
    hashes = {r["g"]: r["h"] for r in df.select("g", F.xxhash64("g").alias("h")).distinct().collect()}
    replicate = mix64(np.arange(1, 301) + (42 << 32))
    for b in (1, 17, 300):
        w = frame["g"].map({g: int(poisson64(np.array([h]).view(np.uint64) ^ replicate[b - 1])[0]) for g, h in hashes.items()})
        for model in ("a", "b"):
            part = frame[frame["model"] == model].loc[lambda f: f.index.repeat(w[f.index])]
            error = part["predicted"] - part["actual"]
            row = got.loc[(model, b)]
            assert row["n"] == len(part) and abs(row["RMSE"] - np.sqrt((error**2).mean())) < 1e-9
            assert abs(row["R2"] - (1 - (error**2).mean() / part["actual"].var(ddof=0))) < 1e-9
    exact = resampling.cluster_bootstrap(df, "g", 300).toPandas().set_index(["model", "bootstrap_id"])
    for metric in ("R2", "RMSE", "Pearson"):
        assert abs(got[metric].mean() - exact[metric].mean()) < 0.01
        assert 0.8 < got[metric].std() / exact[metric].std() < 1.25


def test_written_predictions_are_not_written_again(spark, monkeypatch):
    """Predictions stay one row per sample on disk; metrics of a written table and of a frozen panel write no copies of it."""
    from trialmesh.operators import metrics as m
    from trialmesh.operators.models import long_predictions
    from trialmesh.runtime import materialize

    wide = materialize(spark.range(60).selectExpr("cast(id as string) as sample_id", "id * 1.0D as actual", "id * 0.5D + id % 7 as a", "70.0D - id as b"))
    long = long_predictions(wide, ["sample_id", "actual"], ["a", "b"])
    plain = {r["model"]: r for r in m.metric_table(long, ["model"]).collect()}
    writes = []
    monkeypatch.setattr(m, "materialize", lambda df: writes.append(df.columns) or materialize(df))
    assert {r["model"]: r for r in m.metric_table(long, ["model"], stable=True).collect()} == plain and not writes
    panel = wide.selectExpr("sample_id", "a as consensus_rank", "a as pred_a", "b as pred_b", "(a + b) / 2 as all_model_raw_mean", "'H1_High' as selection_role")
    found = m.evaluate_frozen(panel, wide.select("sample_id", "actual"), "sample_id")
    assert len(writes) == 1
    by_model = {r["model"]: r for r in found["per_model"].collect()}
    for name in ("a", "b"):
        for c in ("n", "R2", "RMSE", "MAE", "Spearman"):
            assert abs(by_model[name][c] - plain[name][c]) < 1e-12


def test_rank_bootstrap_keeps_one_row_per_row(spark, monkeypatch):
    """Both metrics equal those of copied rows, ties and heavy values included, and no table has a row per replicate and row."""
    rng = np.random.default_rng(5)
    n, replicates = 1500, 300
    y = np.round(rng.normal(size=n), 1)
    y[:500] = 0.5
    p = np.round(y + rng.normal(size=n), 1)
    p[100:700] = -0.2
    frame = pd.DataFrame({"model": rng.choice(["a", "b"], n), "g": rng.integers(0, 40, n), "sample_id": [f"s{i}" for i in range(n)], "actual": y, "predicted": p})
    df = spark.createDataFrame(frame).repartition(3)
    weights = resampling.bootstrap_weights(resampling.group_index(df, "g"), "g", replicates).toPandas()
    written = []
    keep = resampling.materialize
    monkeypatch.setattr(resampling, "materialize", lambda t: written.append(keep(t)) or written[-1])
    ranks = resampling.bootstrap_rank_metrics(df, "g", replicates, rows_per_cell=70).toPandas().set_index(["model", "bootstrap_id"])
    assert len(ranks) == 2 * replicates
    assert max(t.count() for t in written) < 20 * n
    hashes = frame["sample_id"].map(lambda s: hashlib.md5(s.encode()).hexdigest())
    for b in (1, 250, 251, 300):
        drawn = weights[weights["bootstrap_id"] == b].set_index("g")["w"]
        w = frame["g"].map(drawn).fillna(0).astype(int)
        for model in ("a", "b"):
            at = np.flatnonzero(frame["model"] == model)
            part = frame.assign(h=hashes).iloc[np.repeat(at, w.iloc[at])].reset_index()
            assert ranks.loc[(model, b), "Spearman"] == pytest.approx(part["actual"].rank().corr(part["predicted"].rank()), abs=1e-9)
            part["copy"] = part.groupby("sample_id").cumcount()
            k = int(np.ceil(len(part) * 0.2))
            best = [set(part.sort_values([c, "h", "copy"], ascending=[False, True, True]).head(k).index) for c in ("actual", "predicted")]
            assert ranks.loc[(model, b), "Top20_recall"] == pytest.approx(len(best[0] & best[1]) / k, abs=1e-9)


def test_transfer_fits_all_repeats_from_one_pass(spark, monkeypatch):
    """The rows are read for cross products once, whatever the repeats, and each run equals a model fitted on its own rows."""
    _, rows = training(spark, 240)
    rows = rows.withColumn("task", F.lit("t"))
    calls = []
    product = models.fold_products
    monkeypatch.setattr(models, "fold_products", lambda *a, **kw: calls.append(a) or product(*a, **kw))
    runs = models.transfer_evaluation(rows, rows, list("abcd"), "y", "y", "task", "id", repeats=4).collect()
    assert len(runs) == 9 and len(calls) == 1
    source = splits.within_group_percentile(rows, "y", "task", "id", out="_y").select(*"abcd", "_y")
    roles = splits.random_support_query(rows, "id", 0.8, 4, 42).where("repeat_id = 2")
    fitted = models.fit_ridge(source.unionByName(roles.where("role = 'support'").select(*"abcd", F.col("y").alias("_y"))), list("abcd"), "_y")
    query = roles.where("role = 'query'").select(F.lit("m").alias("model"), F.col("id").alias("sample_id"), F.col("y").alias("actual"), fitted.expression().alias("predicted"))
    want = metrics.metric_table(query, ["model"]).first()
    got = next(r for r in runs if r["repeat"] == 2 and r["target_scale"] == "raw")
    for c in ("R2", "RMSE", "Spearman"):
        assert got[c] == pytest.approx(want[c], abs=1e-9)


def test_contingency_counts_are_made_once(spark, monkeypatch):
    """Counts equal those of plain bins, also for missing, infinite and edge values, and the rows are counted once."""
    rng = np.random.default_rng(4)
    n = 500
    frame = pd.DataFrame({"sample_id": [f"s{i}" for i in range(n)], "fold_id": rng.integers(1, 4, n), "a": np.round(rng.normal(size=n), 1), "b": rng.normal(size=n), "y": np.round(rng.normal(size=n), 1)})
    frame.loc[:5, "a"], frame.loc[6:9, "b"] = np.nan, np.inf
    df = spark.createDataFrame(frame).withColumn("fold_id", F.col("fold_id").cast("int")).repartition(3)
    edges = {"a": [-0.5, 0.0, 0.3], "b": [0.1], "y": [-1.0, 0.2]}
    got = {(r["fold_id"], r["feature"], r["xb"], r["yb"]): r["c"] for r in selection.contingency_counts(df, ["a", "b"], "y", edges).collect()}
    want: dict = {}
    for row in frame.itertuples():
        bins = {c: sum((v if np.isfinite(v) else 0.0) > e for e in edges[c]) for c, v in (("a", row.a), ("b", row.b), ("y", row.y))}
        for c in ("a", "b"):
            key = (row.fold_id, c, bins[c], bins["y"])
            want[key] = want.get(key, 0) + 1
    assert got == want
    written = []
    keep = selection.materialize
    monkeypatch.setattr(selection, "materialize", lambda t: written.append(t.columns) or keep(t))
    relevance = selection.binned_mutual_information(df, ["a", "b"], "y", "sample_id")
    assert written.count(["fold_id", "feature", "xb", "yb", "c"]) == 1 and relevance.count() == 6


@pytest.mark.parametrize("repeated", [False, True])
def test_columns_of_a_row_are_averaged_without_grouping_long_rows(spark, repeated, monkeypatch):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"sample_id": [f"s{i}" for i in range(300)], "actual": rng.random(300), **{c: rng.random(300) for c in ("a", "b", "a2", "b2")}})
    if repeated:
        frame.loc[7:9, "sample_id"] = "s6"
    wide = spark.createDataFrame(frame).repartition(4).withColumn("b", F.when(F.col("sample_id") != "s11", F.col("b")))
    long = metrics._long(wide, {"a": ["a"], "b": ["b"]}, "sample_id")
    want = [metrics.ensemble_predictions(long, ["a", "b"]), metrics.mean_over_repeats(metrics._long(wide, {"a": ["a", "a2"], "b": ["b", "b2"]}, "sample_id"))]
    grouped = []
    for name in ("ensemble_predictions", "mean_over_repeats"):
        monkeypatch.setattr(metrics, name, lambda rows, *args, _own=getattr(metrics, name): grouped.append(rows.count()) or _own(rows, *args))
    got = [metrics.ensemble_columns(wide, ["a", "b"]), metrics.mean_over_repeat_columns(wide, {"a": ["a", "a2"], "b": ["b", "b2"]})]
    assert grouped == ([8, 16] if repeated else [])
    for one, other in zip(want, got):
        assert sorted(one.columns) == sorted(other.columns)
        order = ["model", "sample_id"]
        frames = [t.select(*one.columns).toPandas().sort_values(order).reset_index(drop=True) for t in (one, other)]
        pd.testing.assert_frame_equal(*frames)
    with pytest.raises(ValueError):
        metrics.ensemble_columns(wide, ["a", "c"])


def test_rank_correlation_moves_no_keys(spark, monkeypatch):
    seen = []
    rank = metrics.average_rank
    monkeypatch.setattr(metrics, "average_rank", lambda df, *args, **kw: seen.append(df.columns) or rank(df, *args, **kw))
    frame = preds_frame()
    got = {r["model"]: r["Spearman"] for r in metrics.spearman(spark.createDataFrame(frame), ["model"], rows_per_cell=20).collect()}
    for model, own in frame[np.isfinite(frame["predicted"])].groupby("model"):
        assert abs(got[model] - closed_form(own["actual"], own["predicted"])["Spearman"]) < 1e-9
    assert len(seen) == 2 and all("sample_id" not in columns for columns in seen)
