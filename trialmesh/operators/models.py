"""Regression models with leakage-safe tuning: Spark ML trees and a closed-form ridge."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Iterable, Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import hash32
from ..functions.text import finite
from ..runtime import BROADCAST_MAX_ROWS, join_dimension, local_table, materialize
from .features import assemble
from .metrics import ensemble_predictions, metric_table, residuals
from .quality import Rule, flag_rows, split_rows, union_removed
from .selection import fold_products, marked_products, mrmr_select
from .splits import cumulative_stages, grouped_kfold, leave_one_round_out, support_flags, within_group_percentile


@dataclass(frozen=True)
class ModelSpec:
    """A Spark ML regressor and the parameter values a search may draw from."""

    name: str
    build: Callable[[], object]
    grid: Mapping[str, Sequence] = field(default_factory=dict)


def model_specs(seed: int = 42, small: bool = False) -> dict[str, ModelSpec]:
    """Forest and boosted-tree regressors by the names users know; ``small`` keeps trees few and shallow."""
    forest = {
        "numTrees": [10, 20] if small else [300, 500, 700, 900],
        "featureSubsetStrategy": ["0.35", "0.5", "0.7", "sqrt"],
        "minInstancesPerNode": [1, 2, 3, 4],
        "maxDepth": [3, 4, 5, 6] if small else [3, 4, 5, 6, 20],
    }
    boosted = {
        "maxIter": [5, 10] if small else [120, 200, 300, 500],
        "stepSize": [0.1, 0.2] if small else [0.01, 0.02, 0.03, 0.05],
        "maxDepth": [2, 3],
        "minInstancesPerNode": [2, 3, 4, 5],
        "subsamplingRate": [0.7, 0.85, 1.0],
    }
    binned = boosted | {"maxDepth": [3, 4, 5], "minInstancesPerNode": [5, 8, 10, 12], "subsamplingRate": [1.0]}
    trees = {"featuresCol": "features", "labelCol": "label", "seed": seed}
    return {
        "RandomForest": ModelSpec("RandomForest", lambda: RandomForestRegressor(**trees), forest),
        "ExtraTrees": ModelSpec("ExtraTrees", lambda: RandomForestRegressor(**trees, bootstrap=False, maxBins=64), forest),
        "GradientBoosting": ModelSpec("GradientBoosting", lambda: GBTRegressor(**trees), boosted),
        "HistGradientBoosting": ModelSpec("HistGradientBoosting", lambda: GBTRegressor(**trees, maxBins=64), binned),
    }


def primary_members(names: Sequence[str]) -> list[str]:
    """The pre-specified ensemble: the first three available tree models."""
    return [n for n in ("RandomForest", "ExtraTrees", "GradientBoosting", "HistGradientBoosting") if n in names][:3]


def sampled_params(grid: Mapping[str, Sequence], n: int, seed: int) -> list[dict]:
    """Up to ``n`` distinct parameter combinations."""
    combinations = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return combinations if len(combinations) <= n else random.Random(seed).sample(combinations, n)


def fit_tuned(train: DataFrame, spec: ModelSpec, group: str, tune_iter: int = 12, inner_folds: int = 4, seed: int = 42, parallelism: int = 4):
    """Fit ``spec`` on ``features``/``label``; parameters are searched by grouped folds inside ``train`` only."""
    estimator = spec.build()
    params = sampled_params(spec.grid, tune_iter, seed) if spec.grid and tune_iter > 0 else [{}]
    if len(params) == 1:
        for name, value in params[0].items():
            estimator = estimator.copy({estimator.getParam(name): value})
        return estimator.fit(train), params[0]
    maps = [{estimator.getParam(name): value for name, value in p.items()} for p in params]
    folded = train.withColumn("_inner", F.pmod(hash32(F.col(group), "inner", seed), F.lit(inner_folds)).cast("int"))
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, evaluator=RegressionEvaluator(metricName="r2", labelCol="label"),
        numFolds=inner_folds, foldCol="_inner", parallelism=parallelism, seed=seed,
    )
    fitted = search.fit(folded)
    best = int(np.argmax(fitted.avgMetrics))
    return fitted.bestModel, params[best]


def cross_validate(
    df: DataFrame,
    specs: Sequence[ModelSpec],
    core: Sequence[str],
    target: str,
    key: str,
    group: str,
    auxiliary: Sequence[str] = (),
    k_aux: int = 8,
    tune_iter: int = 12,
    seed: int = 42,
    fold: str = "fold_id",
    repeat: str = "repeat_id",
) -> tuple[DataFrame, DataFrame | None]:
    """Nested cross-validation of Spark ML models over the test folds of each repeat.

    Returns long predictions of both roles (``model, repeat_id, fold_id, sample_id, role, actual, predicted, best_params``)
    and the extra features selected per fold, which are chosen from training rows only.
    """
    df = materialize(df if repeat in df.columns else df.withColumn(repeat, F.lit(1)))
    parts: list[DataFrame] = []
    selected: list[tuple] = []
    for turn in sorted(row[0] for row in df.select(repeat).distinct().collect()):
        rows = df.where(F.col(repeat) == turn)
        chosen: dict[int, list[str]] = {}
        if auxiliary:
            for row in mrmr_select(rows, auxiliary, target, key, k_aux, fold, stable=True).orderBy(fold, "aux_rank").collect():
                chosen.setdefault(row[fold], []).append(row["feature"])
                selected.append((int(turn), int(row[fold]), int(row["aux_rank"]), row["feature"]))
        for label in sorted(row[0] for row in rows.select(fold).distinct().collect()):
            role = F.when(F.col(fold) == label, "test").otherwise("train")
            labels = {repeat: F.lit(turn), fold: F.lit(label)}
            parts += _fit_and_score(rows, role, specs, core, chosen.get(label, []), target, key, group, labels, tune_iter, seed + 100 * turn + label)
    features = local_table(df.sparkSession, selected, f"{repeat} int, {fold} int, aux_rank int, feature string") if selected else None
    return materialize(_stacked(parts)), features


def _fit_and_score(rows, role, specs, core, extra, target, key, group, labels, tune_iter, seed) -> list[DataFrame]:
    """Fit every model on the training role and score both roles."""
    columns = [F.col(key).cast("string").alias("sample_id"), F.col(group).cast("string").alias("_group"), role.alias("role")]
    ready = materialize(assemble(rows, core, extra).select(*columns, F.col(target).cast("double").alias("label"), "features"))
    train = ready.where(F.col("role") == "train")
    parts = []
    for spec in specs:
        model, best = fit_tuned(train, spec, "_group", tune_iter, seed=seed)
        parts.append(
            model.transform(ready).select(
                F.lit(spec.name).alias("model"), *[c.alias(name) for name, c in labels.items()], "sample_id", "role",
                F.col("label").alias("actual"), F.col("prediction").alias("predicted"), F.lit(json.dumps(best, sort_keys=True)).alias("best_params"),
            )
        )
    return parts


def _stacked(parts: Sequence[DataFrame]) -> DataFrame:
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def out_of_fold(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("role") == "test").drop("role")


RIDGE_ALPHAS = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0)


def _ridge_solution(products: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients on the raw features from cross products of (1, x, y), features scaled by training deviation."""
    n = products[0, 0]
    means = products[0, 1:] / n
    covariance = products[1:, 1:] / n - np.outer(means, means)
    sd = np.sqrt(np.maximum(np.diag(covariance)[:-1], 0.0))
    usable = sd > 1e-9
    sd = np.where(usable, sd, 1.0)
    gram = covariance[:-1, :-1] / np.outer(sd, sd) * n
    moment = covariance[:-1, -1] / sd * n
    gram[~usable, :] = 0.0
    gram[:, ~usable] = 0.0
    moment[~usable] = 0.0
    scaled = np.linalg.solve(gram + alpha * np.eye(len(sd)), moment)
    coefficients = scaled / sd
    return np.concatenate([[means[-1] - coefficients @ means[:-1]], coefficients])


def _r2_from_products(products: np.ndarray, solution: np.ndarray) -> float:
    weights = np.concatenate([-solution, [1.0]])
    squared_error = float(weights @ products @ weights)
    n, total = products[0, 0], products[0, -1]
    spread = float(products[-1, -1] - total * total / n)
    return 1.0 - squared_error / spread if spread > 0 else float("nan")


@dataclass(frozen=True)
class LinearModel:
    columns: tuple[str, ...]
    weights: tuple[float, ...]
    alpha: float

    def expression(self) -> Column:
        value = F.lit(self.weights[0])
        for column, weight in zip(self.columns, self.weights[1:]):
            value = value + F.coalesce(finite(column), F.lit(0.0)) * F.lit(weight)
        return value


def fit_ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> LinearModel:
    """Ridge on z-scored features from one aggregate over the training rows."""
    products = fold_products(train.withColumn("_one", F.lit(0)), [*features, target], "_one")[0]
    return LinearModel(tuple(features), tuple(float(v) for v in _ridge_solution(products, alpha)), alpha)


def ridge_cross_validate(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    key: str,
    group: str,
    fold: str = "fold_id",
    alphas: Sequence[float] = RIDGE_ALPHAS,
    inner_folds: int = 4,
    seed: int = 42,
    model: str = "Ridge",
) -> tuple[DataFrame, dict[int, LinearModel]]:
    """Nested ridge over all folds and alphas from a single pass.

    Cross products are summed per outer and inner fold; every training set is the total minus a few of them, so
    tuning and fitting never read the rows again. Returns out-of-fold predictions and the model of each fold.
    """
    df = materialize(df)
    columns = [*features, target]
    inner = F.pmod(hash32(F.col(group), "inner", seed), F.lit(inner_folds)).cast("int")
    cells = fold_products(df.withColumn("_cell", F.col(fold).cast("int") * 1000 + inner), columns, "_cell")
    total = sum(cells.values())
    models: dict[int, LinearModel] = {}
    for outer in sorted({cell // 1000 for cell in cells}):
        own = {cell: p for cell, p in cells.items() if cell // 1000 != outer}
        train = sum(own.values())
        scores = {}
        for alpha in alphas:
            r2 = []
            for i in range(inner_folds):
                parts = [p for cell, p in own.items() if cell % 1000 == i]
                if parts and len(parts) < len(own):
                    held = sum(parts)
                    r2.append(_r2_from_products(held, _ridge_solution(train - held, alpha)))
            scores[alpha] = np.nanmean(r2) if r2 else 0.0
        best = max(alphas, key=lambda a: scores[a])
        models[outer] = LinearModel(tuple(features), tuple(float(v) for v in _ridge_solution(train, best)), best)
    assert np.isfinite(total).all()
    predicted = F.lit(None).cast("double")
    for outer, fitted in models.items():
        predicted = F.when(F.col(fold) == outer, fitted.expression()).otherwise(predicted)
    oof = df.select(
        F.lit(model).alias("model"), F.col(key).alias("sample_id"), F.col(fold), F.col(target).cast("double").alias("actual"), predicted.alias("predicted")
    )
    return oof, models


def group_mean_predictions(
    df: DataFrame, models: Mapping[str, Sequence[str]], target: str, key: str, keep: Sequence[str] = (), repeat: str = "repeat_id", fold: str = "fold_id"
) -> DataFrame:
    """Long predictions of ``group_mean_columns`` with ``keep``, one row per model, repeat and row."""
    kept = list(dict.fromkeys([key, *keep, repeat, fold]))
    return long_predictions(group_mean_columns(df, models, target, repeat, fold).withColumn("actual", F.col(target)), [*kept, "actual"], models)


def long_predictions(wide: DataFrame, keep: Sequence[str], models: Iterable[str]) -> DataFrame:
    """One row per model from a column per model; a table written wide holds ids and responses once."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in models])
    return wide.select(*keep, F.inline(pairs))


def group_mean_columns(df: DataFrame, models: Mapping[str, Sequence[str]], target: str, repeat: str = "repeat_id", fold: str = "fold_id") -> DataFrame:
    """Baselines, a column per model: the mean training response of rows with the same keys, the overall training mean otherwise.

    A training mean is the total minus the test fold, so all folds share one aggregate per model.
    """
    names = sorted({c for keys in models.values() for c in keys})
    # One pass with a grouping set per model; the last set gives the overall means.
    grouped = df.select(repeat, fold, *names, target).groupingSets(
        [[F.col(c) for c in (repeat, fold, *keys)] for keys in [*models.values(), []]], repeat, fold, *names
    )
    cells = grouped.agg(F.sum(target).alias("_s"), F.count(target).alias("_c"), F.grouping_id().alias("_set"))
    # Folds of one key are a handful of rows, so this window is small for every key.
    over_folds = Window.partitionBy("_set", repeat, *names)
    rest = F.sum("_c").over(over_folds) - F.col("_c")
    mean = F.when(rest > 0, (F.sum("_s").over(over_folds) - F.col("_s")) / rest)
    cells = materialize(cells.select("_set", repeat, fold, *names, mean.alias("_mean")))
    small = cells.count() <= BROADCAST_MAX_ROWS

    def of_set(keys: Sequence[str], out: str) -> DataFrame:
        number = sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in keys)
        return cells.where(F.col("_set") == number).select(repeat, fold, *keys, F.col("_mean").alias(out))

    wide = join_dimension(df, of_set([], "_overall"), [repeat, fold], checked=True)
    for name, keys in models.items():
        wide = join_dimension(wide, of_set(keys, f"_m_{name}"), [repeat, fold, *keys], how="left", checked=small)
    return wide.select(*df.columns, *[F.coalesce(F.col(f"_m_{n}"), F.col("_overall")).alias(n) for n in models])


def fit_final(df: DataFrame, specs: Sequence[ModelSpec], core: Sequence[str], target: str, group: str, selected: Sequence[str] = (), tune_iter: int = 12, seed: int = 42) -> dict:
    """Deployment models fitted on all rows, by name. ``model.write().save(path)`` stores one."""
    ready = assemble(df, core, selected).select(F.col(group).cast("string").alias("_group"), F.col(target).cast("double").alias("label"), "features")
    ready = materialize(ready)
    return {spec.name: fit_tuned(ready, spec, "_group", tune_iter, seed=seed)[0] for spec in specs}


def score_pool(models: Mapping[str, object], pool: DataFrame, core: Sequence[str], key: str, selected: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Long predictions of every fitted model over a pool, in one pass."""
    scored = assemble(pool, core, selected)
    for name, model in models.items():
        scored = model.copy({model.getParam("predictionCol"): f"_p_{name}"}).transform(scored)
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_p_{n}").alias("predicted")) for n in models])
    return scored.select(key, *keep, F.inline(pairs))


def round_holdout(df: DataFrame, specs: Sequence[ModelSpec], core: Sequence[str], target: str, key: str, group: str, round_column: str, tune_iter: int = 0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Hold out each round: ensemble predictions of its rows and metrics per round."""
    roles = materialize(leave_one_round_out(df, round_column))
    parts: list[DataFrame] = []
    for number, row in enumerate(roles.select("test_round").distinct().orderBy("test_round").collect()):
        rows = roles.where(F.col("test_round") == row[0])
        labels = {"test_round": F.lit(row[0])}
        parts += _fit_and_score(rows, F.col("role"), specs, core, [], target, key, group, labels, tune_iter, seed + number)
    tested = out_of_fold(_stacked(parts))
    ensemble = tested.groupBy("test_round", "sample_id").agg(F.min("actual").alias("actual"), F.avg("predicted").alias("predicted"))
    ensemble = materialize(ensemble)
    return ensemble, metric_table(ensemble, ["test_round"])


def learning_curve(df: DataFrame, specs: Sequence[ModelSpec], core: Sequence[str], target: str, key: str, group: str, round_column: str, k: int = 5, tune_iter: int = 0) -> DataFrame:
    """Ensemble metrics for rounds 1, 1–2, …, each stage cross-validated on its own rows."""
    staged = materialize(cumulative_stages(df, round_column))
    parts = None
    for stage in staged.select("stage_order", "stage").distinct().orderBy("stage_order").collect():
        rows = staged.where(F.col("stage_order") == stage["stage_order"]).drop("stage", "stage_order")
        folds = grouped_kfold(rows, group, k=k, repeats=1)
        predictions, _ = cross_validate(folds, specs, core, target, key, group, tune_iter=tune_iter)
        ensemble = ensemble_predictions(out_of_fold(predictions), [s.name for s in specs])
        labels = {"stage_order": F.lit(stage["stage_order"]), "stage": F.lit(stage["stage"])}
        part = metric_table(ensemble.withColumns(labels), ["stage_order", "stage"])
        parts = part if parts is None else parts.unionByName(part)
    return parts


def external_validation(models: Mapping[str, object], external: DataFrame, rules: Mapping[str, Sequence[Rule]], core: Sequence[str], actual: str, key: str, selected: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean an external table, score it, and return rows with residuals, metrics and removed rows."""
    rows, removed = external.where(F.col(actual).isNotNull()), {}
    for stage, checks in rules.items():
        rows, removed[stage] = split_rows(flag_rows(rows, checks))
    long = score_pool(models, rows, core, key, selected, keep=[actual])
    per_row = long.groupBy(F.col(key).alias("sample_id")).agg(
        F.min(actual).alias("actual"),
        F.avg("predicted").alias("predicted"),
        F.coalesce(F.stddev_samp("predicted"), F.lit(0.0)).alias("prediction_sd_across_models"),
    )
    result = materialize(residuals(per_row))
    metrics = metric_table(result.withColumn("validation_set", F.lit("external")), ["validation_set"])
    return result, metrics, union_removed(removed)


def transfer_evaluation(
    source: DataFrame,
    target_rows: DataFrame,
    features: Sequence[str],
    source_target: str,
    target: str,
    task: str,
    key: str,
    repeats: int = 20,
    fraction: float = 0.8,
    alpha: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """Fit on source tasks (within-task percentile target), then score the target table without and with its support rows.

    Rows without a finite target or prediction count in ``n_test`` only; a run is valid with two finite rows.
    Gives ``n_test, n_finite``, the metrics, ``evaluation``, ``target_scale``, ``repeat``, ``n_support``, ``n_query`` per run.
    """
    percentile = within_group_percentile(source, source_target, task, key, out="_y")
    source_rows = materialize(percentile.select(*features, "_y"))
    rows = materialize(within_group_percentile(target_rows.withColumn("_one", F.lit("t")), target, "_one", key, out="_pct"))
    n = rows.count()
    n_support = min(max(3, round(n * fraction)), n - 2)
    flags = support_flags(rows, key, fraction, repeats, seed)
    names = list(dict.fromkeys([*features, target, "_pct"]))
    marked = materialize(rows.select(F.col(key).alias("sample_id"), *names, F.array(*[flags[r] for r in range(repeats)]).alias("_support")))
    given = fold_products(source_rows.withColumn("_zero", F.lit(0)), [*features, "_y"], "_zero")[0]
    support = marked_products(marked, names, "_support", repeats)

    # Every run: its labels, its response, the repeat whose query rows it scores (all rows without one), and its model.
    scales = {"raw": target, "percentile": "_pct"}
    base = _ridge_solution(given, alpha)
    runs = [("A_zero_shot", "percentile", 0, "all_rows", 0, n, "_pct", None, base)]
    for repeat in range(repeats):
        for scale, column in scales.items():
            own = [0, *(1 + names.index(c) for c in (*features, column))]
            adapted = _ridge_solution(given + support[repeat][np.ix_(own, own)], alpha)
            runs.append(("B_adapted_support_to_query", scale, repeat, "random_repeated", n_support, n - n_support, column, repeat, adapted))
    labels = ["model", "evaluation", "target_scale", "repeat", "split_name", "n_support", "n_query"]
    labelled = local_table(
        rows.sparkSession, [(i, "ridge", *run[:6]) for i, run in enumerate(runs)],
        "run int, model string, evaluation string, target_scale string, repeat int, split_name string, n_support int, n_query int",
    )
    stacked = materialize(_scored_runs(marked, features, [run[6:] for run in runs]))
    usable = finite("actual").isNotNull() & finite("predicted").isNotNull()
    counts = stacked.groupBy("run").agg(F.count(F.lit(1)).alias("n_test"), F.count_if(usable).alias("n_finite"))
    measured = metric_table(stacked, ["run"], min_n=2)
    return counts.join(F.broadcast(labelled), on="run").join(measured, on="run", how="left").select(
        *labels, "n_test", "n_finite", "R2", "RMSE", "MAE", "Pearson", "Spearman",
        F.col("Top20_recall").alias("Top20_precision"), (F.col("n_finite") >= 2).alias("valid_prediction"),
    )


def _scored_runs(rows: DataFrame, features: Sequence[str], runs: Sequence[tuple[str, int | None, np.ndarray]]) -> DataFrame:
    """``run, sample_id, actual, predicted`` of every run (response, repeat, solution) over the rows outside its support, in one pass."""
    columns = list(dict.fromkeys(run[0] for run in runs))
    ready = rows.select(
        "sample_id", "_support", *[F.col(c).cast("double").alias(f"_r{i}") for i, c in enumerate(columns)],
        *[F.coalesce(finite(c), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(features)],
    )
    kept = ready.schema["sample_id"].dataType.simpleString()
    schema = f"run int, sample_id {kept}, actual double, predicted double"

    def score(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            values = [batch.column(2 + len(columns) + j).to_numpy(zero_copy_only=False) for j in range(len(features))]
            for number, (column, repeat, solution) in enumerate(runs):
                own = np.arange(batch.num_rows) if repeat is None else np.flatnonzero(~marks[:, repeat].astype(bool))
                # Term by term, so that equal rows get equal predictions.
                predicted = np.full(len(own), float(solution[0]))
                for x, weight in zip(values, solution[1:]):
                    predicted = predicted + x[own] * float(weight)
                places = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), number, np.int32)), batch.column(0).take(places), batch.column(2 + columns.index(column)).take(places), pa.array(predicted)],
                    names=["run", "sample_id", "actual", "predicted"],
                )

    return ready.mapInArrow(score, schema)
