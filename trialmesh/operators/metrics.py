"""Evaluation of long prediction tables: one row per model and sample with ``actual`` and ``predicted``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import ROWS_PER_CELL, average_rank, cut_after, inside_cut
from ..functions.text import finite
from ..runtime import join_dimension, materialize
from .consensus import _added, _by_key

CONSTANT_SD = 1e-12


def finite_pairs(preds: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Rows with two finite numbers; NaN becomes NULL first."""
    clean = preds.withColumns({actual: finite(actual), predicted: finite(predicted)})
    return clean.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation that is NULL when a side is constant."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / spread)


def regression_metrics(
    preds: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted", min_pearson: int = 3
) -> DataFrame:
    """n, R2, RMSE, MAE, Pearson, mean bias and calibration line per group, in one aggregate."""
    y, p = F.col(actual), F.col(predicted)
    error = p - y
    sums = finite_pairs(preds, actual, predicted).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.var_pop(y).alias("_vy"),
        F.avg(y).alias("_my"),
        F.avg(p).alias("_mp"),
        F.covar_pop(y, p).alias("_cyp"),
        correlation(y, p).alias("_r"),
        F.avg(error * error).alias("_mse"),
        F.avg(F.abs(error)).alias("MAE"),
        F.avg(error).alias("Mean_bias"),
    )
    return with_closed_forms(sums, by, min_pearson)


def with_closed_forms(sums: DataFrame, by: Sequence[str], min_pearson: int = 3) -> DataFrame:
    """Metrics from the moments ``n, _vy, _my, _mp, _cyp, _r, _mse, MAE, Mean_bias``."""
    constant = F.col("_vy") <= 0
    r2 = (
        F.when(F.col("n") < 2, F.lit(None))
        .when(constant, F.when(F.col("_mse") <= 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.lit(1.0) - F.col("_mse") / F.col("_vy"))
    )
    slope = F.when((F.col("n") >= 2) & (F.sqrt("_vy") > CONSTANT_SD), F.col("_cyp") / F.col("_vy"))
    return sums.select(
        *by,
        "n",
        r2.alias("R2"),
        F.sqrt("_mse").alias("RMSE"),
        "MAE",
        F.when(F.col("n") >= min_pearson, F.col("_r")).alias("Pearson"),
        slope.alias("Calibration_slope"),
        (F.col("_mp") - slope * F.col("_my")).alias("Calibration_intercept"),
        "Mean_bias",
    )


def calibration(preds: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Line of predicted on actual."""
    return regression_metrics(preds, by, actual, predicted).select(*by, "n", "Calibration_slope", "Calibration_intercept")


def spearman(
    preds: DataFrame,
    by: Sequence[str],
    actual: str = "actual",
    predicted: str = "predicted",
    *,
    key: str = "sample_id",
    min_n: int = 3,
    stable: bool = False,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Rank correlation per group over distributed average ranks."""
    # Average ranks don't depend on the key, it only spreads rows of one value; its hash is a fraction of its bytes in both shuffles.
    narrow = finite_pairs(preds, actual, predicted).select(*by, F.hash(key).alias("_spread"), actual, predicted)
    if not stable:
        narrow = materialize(narrow)
    options = {"tie": "_spread", "stable": True, "rows_per_cell": rows_per_cell}
    ranked = average_rank(narrow, actual, by, out="_ra", **options)
    ranked = average_rank(ranked, predicted, by, out="_rp", **options)
    rho = correlation("_ra", "_rp")
    return ranked.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= min_n, rho).alias("Spearman"))


def top_overlap(
    preds: DataFrame,
    by: Sequence[str],
    size: Column,
    out: str,
    actual: str = "actual",
    predicted: str = "predicted",
    *,
    key: str = "sample_id",
    min_n: int = 3,
    stable: bool = False,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Share of the best ``size`` rows by actual that are also best by predicted; ``size`` is an expression over ``n``."""
    narrow = finite_pairs(preds, actual, predicted).select(*by, key, actual, predicted)
    if not stable:
        narrow = materialize(narrow)
    flagged = narrow
    for name, value in (("a", actual), ("p", predicted)):
        cuts, small = cut_after(narrow, size, by, value=value, tie=key, stable=True, rows_per_cell=rows_per_cell)
        if by:
            cuts = cuts.select(*by, F.col("cut_value").alias("_cv"), F.col("cut_hash").alias("_ch"), F.col("k").alias("_k"), F.col("n").alias("_n"))
            flagged = join_dimension(flagged.drop("_k", "_n"), cuts, by, checked=small)
            inside = inside_cut(F.col(value), F.col(key), F.col("_cv"), F.col("_ch"))
            flagged = flagged.withColumn(f"_in_{name}", inside).drop("_cv", "_ch")
        else:
            cut = cuts.first()
            inside = inside_cut(F.col(value), F.col(key), F.lit(cut["cut_value"]), F.lit(cut["cut_hash"]))
            flagged = flagged.withColumns({f"_in_{name}": inside, "_k": F.lit(cut["k"]), "_n": F.lit(cut["n"])})
    both = F.sum((F.col("_in_a") & F.col("_in_p")).cast("bigint")) / F.max(F.least("_k", "_n"))
    return flagged.groupBy(*by).agg(F.when(F.max("_n") >= min_n, both).alias(out))


def top_fraction_overlap(preds: DataFrame, by: Sequence[str], fraction: float = 0.2, out: str = "Top20_recall", **kw) -> DataFrame:
    size = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(fraction))))
    return top_overlap(preds, by, size, out, **kw)


def top_k_overlap(preds: DataFrame, by: Sequence[str], k: int, **kw) -> DataFrame:
    return top_overlap(preds, by, F.least(F.lit(k), F.col("n")), f"Top{k}_overlap", min_n=1, **kw)


def metric_table(preds: DataFrame, by: Sequence[str], *, key: str = "sample_id", min_n: int = 3, stable: bool = False, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """All metrics per group; the predictions are written once, unless they were (``stable``), and read by each metric."""
    pairs = finite_pairs(preds).select(*by, key, "actual", "predicted")
    if not stable:
        pairs = materialize(pairs)
    options = {"key": key, "min_n": min_n, "stable": True, "rows_per_cell": rows_per_cell}
    table = regression_metrics(pairs, by, min_pearson=min_n)
    for part in (spearman(pairs, by, **options), top_fraction_overlap(pairs, by, **options)):
        table = table.join(part, on=list(by), how="left")
    return table


def fold_metrics(preds: DataFrame, by: Sequence[str] = ("model", "fold"), role: str = "role") -> DataFrame:
    """Train and test metrics per fold side by side, with the R2 gap between them."""
    long = regression_metrics(preds, [*by, role])
    wide = None
    for name in ("train", "test"):
        part = long.where(F.col(role) == name).select(
            *by, F.col("n").alias(f"n_{name}"), *[F.col(m).alias(f"{name}_{m}") for m in ("R2", "RMSE", "MAE", "Pearson")]
        )
        wide = part if wide is None else wide.join(part, on=list(by), how="full")
    return wide.withColumn("R2_overfit_gap", F.col("train_R2") - F.col("test_R2"))


def fold_summary(folds: DataFrame, by: Sequence[str] = ("model",), metrics: Sequence[str] = ("R2", "RMSE", "Spearman"), gap: str | None = "R2_overfit_gap") -> DataFrame:
    """Mean and sample deviation of the test metrics over folds, and the mean overfit gap."""
    parts = []
    for metric in metrics:
        parts.append(F.avg(f"test_{metric}").alias(f"Fold_{metric}_mean"))
        parts.append(F.stddev_samp(f"test_{metric}").alias(f"Fold_{metric}_std"))
    if gap:
        parts.append(F.avg(gap).alias("Mean_overfit_gap"))
    return folds.groupBy(*by).agg(*parts)


def repeat_metrics(preds: DataFrame, **kw) -> DataFrame:
    return metric_table(preds, ["model", "repeat_id"], **kw)


def aggregate_repeats(
    repeats: DataFrame,
    by: Sequence[str] = ("model", "evaluation", "target_scale", "split_name"),
    metrics: Sequence[str] = ("R2", "RMSE", "MAE", "Pearson", "Spearman", "Top20_precision"),
) -> DataFrame:
    """Mean and deviation of each metric over repeats, best first inside an evaluation."""
    parts = [
        F.count_distinct("repeat").alias("n_repeats"),
        F.avg("n_support").alias("n_support_mean"),
        F.avg("n_query").alias("n_query_mean"),
        F.avg("n_finite").alias("n_finite_mean"),
        F.avg(F.col("valid_prediction").cast("double")).alias("valid_prediction_rate"),
    ]
    for metric in metrics:
        value = finite(metric)
        parts += [F.avg(value).alias(f"{metric}_mean"), F.stddev_samp(value).alias(f"{metric}_std")]
    table = repeats.groupBy(*by).agg(*parts)
    return table.orderBy("evaluation", "target_scale", F.desc_nulls_last("R2_mean"), F.desc_nulls_last("Spearman_mean"))


def mean_over_repeats(preds: DataFrame, by: Sequence[str] = ("model", "sample_id")) -> DataFrame:
    """One out-of-fold prediction per model and sample: the mean over repeats with its spread and count."""
    return preds.groupBy(*by).agg(
        F.min("actual").alias("actual"),
        F.avg("predicted").alias("predicted"),
        F.coalesce(F.stddev_samp("predicted"), F.lit(0.0)).alias("prediction_sd_across_repeats"),
        F.count(F.lit(1)).alias("n_predictions"),
    )


def _mean_and_spread(columns: Sequence[str]) -> tuple[Column, Column]:
    """Mean and sample deviation over the columns of a row; missing values are left out."""
    values = [F.col(c) for c in columns]
    n = _added([v.isNotNull().cast("int") for v in values])
    mean = _added([F.coalesce(v, F.lit(0.0)) for v in values]) / F.when(n > 0, n)
    squares = _added([F.coalesce((v - mean) * (v - mean), F.lit(0.0)) for v in values])
    return mean, F.when(n > 1, F.sqrt(squares / (n - 1)))


def _long(rows: DataFrame, columns: Mapping[str, Sequence[str]], key: str) -> DataFrame:
    pairs = [F.struct(F.lit(model).alias("model"), F.col(c).alias("predicted")) for model, own in columns.items() for c in own]
    return rows.select(key, "actual", F.inline(F.array(*pairs)))


def mean_over_repeat_columns(wide: DataFrame, columns: Mapping[str, Sequence[str]], key: str = "sample_id") -> DataFrame:
    """``mean_over_repeats`` of a written table with a column per model and repeat: only rows that share their key with others are grouped."""

    def alone(rows: DataFrame) -> DataFrame:
        parts = []
        for model, own in columns.items():
            mean, spread = _mean_and_spread(own)
            parts.append(F.struct(F.lit(model).alias("model"), mean.alias("predicted"), F.coalesce(spread, F.lit(0.0)).alias("prediction_sd_across_repeats"), F.lit(len(own)).cast("bigint").alias("n_predictions")))
        return rows.select(key, "actual", F.inline(F.array(*parts))).select("model", key, "actual", "predicted", "prediction_sd_across_repeats", "n_predictions")

    return _by_key(wide, wide, key, alone, lambda rows: mean_over_repeats(_long(rows, columns, key), ("model", key)))


def ensemble_columns(wide: DataFrame, members: Sequence[str], name: str = "PrimaryTreeEnsemble", key: str = "sample_id") -> DataFrame:
    """``ensemble_predictions`` of a written table with a column per model: only rows that share their key with others are grouped."""
    members = list(members)
    missing = [m for m in members if m not in wide.columns]
    if missing:
        raise ValueError(f"missing member predictions: {missing}")
    mean, spread = _mean_and_spread(members)

    def alone(rows: DataFrame) -> DataFrame:
        return rows.select(key, "actual", mean.alias("predicted"), spread.alias("prediction_sd_across_models"), F.lit(len(set(members))).cast("bigint").alias("n_models"), F.lit(name).alias("model"))

    return _by_key(wide, wide, key, alone, lambda rows: ensemble_predictions(_long(rows, {m: [m] for m in members}, key), members, name, key))


def ensemble_predictions(preds: DataFrame, members: Sequence[str], name: str = "PrimaryTreeEnsemble", key: str = "sample_id") -> DataFrame:
    """Mean and spread over the member models per sample; every member must be present."""
    members = list(members)
    present = {row[0] for row in preds.where(F.col("model").isin(members)).select("model").distinct().collect()}
    missing = [m for m in members if m not in present]
    if missing:
        raise ValueError(f"missing member predictions: {missing}")
    return (
        preds.where(F.col("model").isin(members))
        .groupBy(key)
        .agg(
            F.min("actual").alias("actual"),
            F.avg("predicted").alias("predicted"),
            F.stddev_samp("predicted").alias("prediction_sd_across_models"),
            F.count_distinct("model").alias("n_models"),
        )
        .withColumn("model", F.lit(name))
    )


def composite_score() -> Column:
    """Weighted blend of R2, Spearman and an error term; a missing metric counts as the worst value."""

    def clipped(name: str) -> Column:
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.col(name), F.lit(-1.0))))

    error = F.lit(1.0) / (F.lit(1.0) + F.greatest(F.col("RMSE"), F.lit(0.0)))
    return F.lit(0.55) * clipped("R2") + F.lit(0.30) * clipped("Spearman") + F.lit(0.15) * error


def rank_models(summary: DataFrame, order_by: str = "r2") -> DataFrame:
    """Order a summary by R2 then Spearman, or by the composite score (added as ``score``)."""
    if order_by == "score":
        return summary.withColumn("score", composite_score()).orderBy(F.desc_nulls_last("score"), "model")
    return summary.orderBy(F.desc_nulls_last("R2"), F.desc_nulls_last("Spearman"), "model")


def residuals(preds: DataFrame) -> DataFrame:
    error = F.col("actual") - F.col("predicted")
    return preds.withColumns({"residual": error, "absolute_error": F.abs(error)})


def combine_summaries(parts: Sequence[tuple[DataFrame, str, str]], required: Sequence[str] = ("model", "R2", "RMSE", "MAE", "Spearman")) -> DataFrame:
    """Stack summaries with different columns, each with a model family and a validation label."""
    stacked = None
    for summary, family, label in parts:
        missing = [c for c in required if c not in summary.columns]
        if missing:
            raise ValueError(f"summary is missing columns: {missing}")
        summary = summary.withColumns({"model_family": F.lit(family), "validation_label": F.lit(label)})
        stacked = summary if stacked is None else stacked.unionByName(summary, allowMissingColumns=True)
    return stacked


def attach_metadata(
    oof: DataFrame,
    reference: DataFrame,
    id_column: str = "candidate_id",
    index_column: str = "sample_index",
    metadata: Sequence[str] = ("formulation_group", "formulation_signature"),
) -> DataFrame | None:
    """Replace the metadata of older predictions by that of the current table.

    Joined by id when the reference ids are unique, else by index. Returns None unless every row matches.
    """
    if "actual" not in oof.columns or "predicted" not in oof.columns:
        return None
    columns = [id_column, index_column, *metadata]
    if any(c not in reference.columns for c in columns):
        return None
    reference = reference.select(*columns)

    def unique(column: str) -> bool:
        repeated = reference.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return repeated.isEmpty()

    by_id = id_column in oof.columns and not oof.where(F.col(id_column).isNotNull()).isEmpty() and unique(id_column)
    if by_id:
        key = id_column
    elif index_column in oof.columns and unique(index_column):
        key = index_column
    else:
        return None
    current = reference.withColumn(key, F.col(key).cast("string"))
    stripped = oof.drop(*[c for c in columns if c != key]).withColumn(key, F.col(key).cast("string"))
    joined = materialize(stripped.join(current, on=key, how="left"))
    if not joined.where(F.col(metadata[0]).isNull()).isEmpty():
        return None
    return joined


def role_group() -> Column:
    role = F.col("selection_role")
    return (
        F.when(role.contains("High"), "High")
        .when(role.contains("Intermediate"), "Intermediate")
        .when(role.contains("Low"), "Low")
        .otherwise("Disagreement")
    )


def role_group_summary(measured: DataFrame) -> DataFrame:
    """Measured response by panel role. A panel has a dozen rows, so the exact median is cheap."""
    return measured.groupBy(role_group().alias("role_group")).agg(
        F.count("actual").alias("n"),
        F.avg("actual").alias("mean_actual"),
        F.median("actual").alias("median_actual"),
        F.avg("consensus_rank").alias("mean_consensus_rank"),
    )


def match_measured(panel: DataFrame, measured: DataFrame, code: str, min_matched: int = 6) -> DataFrame:
    """Panel rows with a measured value; too few of them is an error."""
    values = measured.select(F.col(code), finite("actual").alias("actual"))
    matched = panel.join(values, on=code, how="left").where(F.col("actual").isNotNull() & F.col("consensus_rank").isNotNull())
    matched = materialize(matched)
    n = matched.count()
    if n < min_matched:
        raise ValueError(f"only {n} measured rows could be matched")
    return matched


def evaluate_frozen(panel: DataFrame, measured: DataFrame, code: str, min_matched: int = 6) -> dict[str, DataFrame]:
    """Compare a frozen panel with its measurements: overall, per role group and per model, all from the one table that is written."""
    matched = match_measured(panel, measured, code, min_matched)
    rank_pairs = matched.withColumn("predicted", F.col("consensus_rank"))
    raw_pairs = matched.withColumn("predicted", F.col("all_model_raw_mean"))
    complete = matched.where(F.col("all_model_raw_mean").isNull()).isEmpty()
    overall = spearman(rank_pairs.withColumn("part", F.lit("all")), ["part"], key=code, stable=True).withColumnRenamed(
        "Spearman", "Spearman_actual_vs_frozen_consensus_rank"
    )
    for k in (3, 5):
        overall = overall.join(top_k_overlap(rank_pairs.withColumn("part", F.lit("all")), ["part"], k, key=code, stable=True), on="part")
    raw = regression_metrics(raw_pairs.withColumn("part", F.lit("all")), ["part"])
    raw = raw.select("part", *[F.when(F.lit(complete), F.col(m)).alias(f"{m}_raw_all_model_mean") for m in ("R2", "RMSE", "MAE")])
    overall = overall.join(raw, on="part").join(matched.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("all")), on="part")
    predictions = [
        f.name for f in panel.schema.fields if f.name.startswith("pred_") and isinstance(f.dataType, T.NumericType)
    ]
    per_model = None
    if predictions:
        long = matched.unpivot([code, "actual"], predictions, "model", "predicted")
        long = long.withColumn("model", F.regexp_replace("model", "^pred_", ""))
        gaps = F.sum(finite("predicted").isNull().cast("int")) > 0
        incomplete = [row["model"] for row in long.groupBy("model").agg(gaps.alias("gap")).where("gap").collect()]
        long = long.where(~F.col("model").isin(incomplete)) if incomplete else long
        per_model = regression_metrics(long, ["model"]).join(spearman(long, ["model"], key=code, stable=True), on="model")
        per_model = per_model.select("model", "n", "R2", "RMSE", "MAE", "Spearman")
    return {
        "summary": overall.drop("part"),
        "matched": matched,
        "role_groups": role_group_summary(matched),
        "per_model": per_model,
    }
