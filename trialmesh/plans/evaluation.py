"""Queries over predictions: metrics, summaries, ensembles, resampling and frozen panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, resampling
from ..operators.models import group_mean_predictions
from ..runtime import materialize
from .cleaning import CLEANED_SQL, cleaned
from .registry import query
from .views import BASELINES, EVENT_PREDICTIONS, baseline_columns, baseline_predictions, baseline_sql, event_predictions, fold_sql, hashed, oof_sql, repeat_columns


def metrics_sql(source: str, by: str, top: bool = True, key: str = "sample_id") -> str:
    """All metrics per group of a table with ``actual`` and ``predicted``."""
    return f"""SELECT {by}, count(*) AS n,
        CASE WHEN var_pop(actual) = 0 THEN CASE WHEN max(abs(actual - predicted)) = 0 THEN 1.0 ELSE 0.0 END
             ELSE 1 - avg((actual - predicted) * (actual - predicted)) / var_pop(actual) END AS R2,
        sqrt(avg((actual - predicted) * (actual - predicted))) AS RMSE, avg(abs(actual - predicted)) AS MAE,
        covar_pop(actual, predicted) / nullif(stddev_pop(actual) * stddev_pop(predicted), 0) AS Pearson,
        covar_pop(actual, predicted) / nullif(var_pop(actual), 0) AS Calibration_slope,
        avg(predicted) - covar_pop(actual, predicted) / nullif(var_pop(actual), 0) * avg(actual) AS Calibration_intercept,
        avg(predicted - actual) AS Mean_bias,
        covar_pop(ra, rp) / nullif(stddev_pop(ra) * stddev_pop(rp), 0) AS Spearman,
        count(*) FILTER (pa <= k AND pp <= k) / max(k) AS Top20_recall
      FROM (SELECT *,
        rank() OVER (PARTITION BY {by} ORDER BY actual) + (count(*) OVER (PARTITION BY {by}, actual) - 1) / 2.0 AS ra,
        rank() OVER (PARTITION BY {by} ORDER BY predicted) + (count(*) OVER (PARTITION BY {by}, predicted) - 1) / 2.0 AS rp,
        row_number() OVER (PARTITION BY {by} ORDER BY actual DESC, md5({key}::VARCHAR)) AS pa,
        row_number() OVER (PARTITION BY {by} ORDER BY predicted DESC, md5({key}::VARCHAR)) AS pp,
        greatest(1, ceil(count(*) OVER (PARTITION BY {by}) * 0.2::DOUBLE)) AS k FROM {source}) GROUP BY {by}"""


METRIC_NAMES = ["R2", "RMSE", "MAE", "Pearson", "Calibration_slope", "Calibration_intercept", "Mean_bias", "Spearman", "Top20_recall"]
MOMENTS = METRIC_NAMES[:7]
_OOF = f"WITH {baseline_sql()}"


@query(
    "model_leaderboard",
    f"""WITH {CLEANED_SQL}, folded AS (SELECT *, 1 AS repeat_id, {fold_sql("md5(group_key || '|42|1')", 5)} AS fold_id FROM (SELECT *, md5(concat_ws('|', IL1, IL2, Phospholipid,
          PEG, CAST(IL1_molpct AS INT))) AS group_key FROM cleaned)),
        {oof_sql()}
        SELECT *, row_number() OVER (ORDER BY R2 DESC, Spearman DESC, model) AS place FROM ({metrics_sql('oof', 'model')})""",
    METRIC_NAMES,
)
def model_leaderboard(spark, sf_dir):
    """Clean mixtures, leakage-safe folds, out-of-fold baselines, all metrics, models ranked by R2 then Spearman."""
    from pyspark.sql import Window

    from ..operators.splits import grouped_kfold

    rows = cleaned(spark, sf_dir)
    group = F.md5(F.concat_ws("|", "IL1", "IL2", "Phospholipid", "PEG", F.col("IL1_molpct").cast("int")))
    rows = rows.withColumn("group_key", group).select("sample_id", "group_key", "TE", *sorted({c for keys in BASELINES.values() for c in keys}))
    rows = materialize(grouped_kfold(rows, "group_key", k=5, repeats=1, seed=42, exact=False))
    oof = group_mean_predictions(rows, BASELINES, "TE", "sample_id")
    board = metrics.metric_table(oof.withColumn("predicted", F.round("predicted", 9)), ["model"])
    # One row per model, so this window is tiny.
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("R2"), F.desc_nulls_last("Spearman"), "model"))
    return metrics.rank_models(board.withColumn("place", place.cast("bigint")))


@query("group_mean_oof", f"{_OOF} SELECT model, sample_id, predicted FROM oof", ["predicted"])
def group_mean_oof(spark, sf_dir):
    return baseline_predictions(spark, sf_dir).select("model", "sample_id", "predicted")


@query("metrics_by_model", f"{_OOF} SELECT * EXCLUDE (Spearman, Top20_recall) FROM ({metrics_sql('oof', 'model')})", MOMENTS)
def metrics_by_model(spark, sf_dir):
    return metrics.regression_metrics(baseline_predictions(spark, sf_dir), ["model"])


@query("spearman_by_model", f"{_OOF} SELECT model, Spearman FROM ({metrics_sql('oof', 'model')})", ["Spearman"])
def spearman_by_model(spark, sf_dir):
    return metrics.spearman(baseline_predictions(spark, sf_dir), ["model"], stable=True)


@query("top_fraction_overlap", f"{_OOF} SELECT model, Top20_recall FROM ({metrics_sql('oof', 'model')})", ["Top20_recall"])
def top_fraction_overlap(spark, sf_dir):
    return metrics.top_fraction_overlap(baseline_predictions(spark, sf_dir), ["model"], stable=True)


_TOPK = "count(*) FILTER (pa <= {k} AND pp <= {k}) / least({k}, count(*))"


@query(
    "top_k_overlap",
    f"""{_OOF}, p AS (SELECT model, Round, row_number() OVER (PARTITION BY model, Round ORDER BY actual DESC, md5(sample_id)) AS pa,
        row_number() OVER (PARTITION BY model, Round ORDER BY predicted DESC, md5(sample_id)) AS pp FROM oof)
        SELECT model, Round, {_TOPK.format(k=3)} AS Top3_overlap, {_TOPK.format(k=50)} AS Top50_overlap FROM p GROUP BY ALL""",
    ["Top3_overlap", "Top50_overlap"],
)
def top_k_overlap(spark, sf_dir):
    oof = baseline_predictions(spark, sf_dir, keep=("Round",))
    three = metrics.top_k_overlap(oof, ["model", "Round"], 3, stable=True)
    return three.join(metrics.top_k_overlap(oof, ["model", "Round"], 50, stable=True), on=["model", "Round"])


@query("calibration", f"{_OOF} SELECT model, Round, n, Calibration_slope, Calibration_intercept FROM ({metrics_sql('oof', 'model, Round')})", ["Calibration_slope", "Calibration_intercept"])
def calibration(spark, sf_dir):
    return metrics.calibration(baseline_predictions(spark, sf_dir, keep=("Round",)), ["model", "Round"])


_FOLD_R2 = f"""fm AS (SELECT model, fold_id, count(*) AS n, 1 - avg((actual - predicted) ^ 2) / var_pop(actual) AS R2,
  sqrt(avg((actual - predicted) ^ 2)) AS RMSE FROM oof GROUP BY ALL)"""


def _fold_roles(oof):
    """Every fold as test, and the remaining rows as its (here equally predicted) training rows."""
    each = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("fold")
    rows = oof.select("model", "sample_id", "fold_id", "actual", "predicted", each)
    return rows.withColumn("role", F.when(F.col("fold") == F.col("fold_id"), "test").otherwise("train"))


@query(
    "fold_metrics",
    f"""{_OOF}, k AS (SELECT unnest([1, 2, 3, 4, 5])::INT AS fold), r AS (SELECT model, fold, fold = fold_id AS test, actual, predicted FROM oof, k),
        m AS (SELECT model, fold, test, count(*) AS n, 1 - avg((actual - predicted) * (actual - predicted)) / var_pop(actual) AS R2,
          sqrt(avg((actual - predicted) * (actual - predicted))) AS RMSE, avg(abs(actual - predicted)) AS MAE, corr(actual, predicted) AS Pearson FROM r GROUP BY ALL)
        SELECT a.model, a.fold, a.n AS n_train, a.R2 AS train_R2, a.RMSE AS train_RMSE, a.MAE AS train_MAE, a.Pearson AS train_Pearson, b.n AS n_test,
          b.R2 AS test_R2, b.RMSE AS test_RMSE, b.MAE AS test_MAE, b.Pearson AS test_Pearson, a.R2 - b.R2 AS R2_overfit_gap
        FROM m a JOIN m b ON a.model = b.model AND a.fold = b.fold AND NOT a.test AND b.test""",
    [f"{r}_{m}" for r in ("train", "test") for m in ("R2", "RMSE", "MAE", "Pearson")] + ["R2_overfit_gap"],
)
def fold_metrics(spark, sf_dir):
    return metrics.fold_metrics(_fold_roles(baseline_predictions(spark, sf_dir)))


@query(
    "fold_summary",
    f"""{_OOF}, {_FOLD_R2} SELECT model, avg(R2) AS Fold_R2_mean, stddev_samp(R2) AS Fold_R2_std, avg(RMSE) AS Fold_RMSE_mean, stddev_samp(RMSE) AS Fold_RMSE_std FROM fm GROUP BY 1""",
    ["Fold_R2_mean", "Fold_R2_std", "Fold_RMSE_mean", "Fold_RMSE_std"],
)
def fold_summary(spark, sf_dir):
    folds = metrics.regression_metrics(baseline_predictions(spark, sf_dir), ["model", "fold_id"])
    folds = folds.select("model", "fold_id", F.col("R2").alias("test_R2"), F.col("RMSE").alias("test_RMSE"))
    return metrics.fold_summary(folds, metrics=("R2", "RMSE"), gap=None)


@query("repeat_metrics", f"WITH {baseline_sql(2)} {metrics_sql('oof', 'model, repeat_id')}", METRIC_NAMES)
def repeat_metrics(spark, sf_dir):
    return metrics.repeat_metrics(baseline_predictions(spark, sf_dir, repeats=2), stable=True)


@query(
    "repeat_averages",
    f"""WITH {baseline_sql(2)} SELECT model, sample_id, min(actual) AS actual, avg(predicted) AS predicted, coalesce(stddev_samp(predicted), 0) AS prediction_sd_across_repeats,
        count(*) AS n_predictions FROM oof GROUP BY ALL""",
    ["actual", "predicted", "prediction_sd_across_repeats"],
)
def repeat_averages(spark, sf_dir):
    return metrics.mean_over_repeat_columns(*repeat_columns(spark, sf_dir, 2))


_ROUND_RUNS = f"rr AS (SELECT model, Round, CAST(substr(Round, 2) AS INT) AS repeat, n, R2, RMSE, MAE, Pearson, Spearman, Top20_recall FROM ({metrics_sql('oof', 'model, Round')}))"
_AGG = ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in ("R2", "RMSE", "MAE", "Pearson", "Spearman"))
_AGG_NAMES = [f"{m}_{s}" for m in ("R2", "RMSE", "MAE", "Pearson", "Spearman", "Top20_precision") for s in ("mean", "std")]


@query(
    "aggregate_repeats",
    f"""{_OOF}, {_ROUND_RUNS} SELECT model, 'by_round' AS evaluation, 'raw' AS target_scale, 'rounds' AS split_name, count(DISTINCT repeat) AS n_repeats, avg(n) AS n_support_mean,
        avg(n) AS n_query_mean, avg(n) AS n_finite_mean, 1.0::DOUBLE AS valid_prediction_rate, {_AGG}, avg(Top20_recall) AS Top20_precision_mean,
        stddev_samp(Top20_recall) AS Top20_precision_std FROM rr GROUP BY model""",
    [*_AGG_NAMES, "n_support_mean", "n_query_mean", "n_finite_mean", "valid_prediction_rate"],
)
def aggregate_repeats(spark, sf_dir):
    """Each round as one repeat of an evaluation."""
    runs = metrics.metric_table(baseline_predictions(spark, sf_dir, keep=("Round",)), ["model", "Round"], stable=True)
    labels = {"evaluation": "by_round", "target_scale": "raw", "split_name": "rounds"}
    runs = runs.withColumns({k: F.lit(v) for k, v in labels.items()} | {"repeat": F.substring("Round", 2, 9).cast("int"), "valid_prediction": F.lit(True)})
    runs = runs.withColumns({"n_support": F.col("n"), "n_query": F.col("n"), "n_finite": F.col("n"), "Top20_precision": F.col("Top20_recall")})
    return metrics.aggregate_repeats(runs)


_ENSEMBLE = """ens AS (SELECT sample_id, min(actual) AS actual, avg(predicted) AS predicted, stddev_samp(predicted) AS prediction_sd_across_models,
  count(DISTINCT model) AS n_models, 'PrimaryTreeEnsemble' AS model FROM oof WHERE model IN ('by_percent', 'by_size') GROUP BY sample_id)"""


@query("ensemble_oof", f"{_OOF}, {_ENSEMBLE} SELECT * FROM ens", ["actual", "predicted", "prediction_sd_across_models"])
def ensemble_oof(spark, sf_dir):
    return metrics.ensemble_columns(baseline_columns(spark, sf_dir), ["by_percent", "by_size"])


@query(
    "rank_models",
    f"""{_OOF} SELECT *, 0.55 * greatest(-1, least(1, R2)) + 0.30 * greatest(-1, least(1, Spearman)) + 0.15 * (1.0 / (1.0 + RMSE)) AS score FROM ({metrics_sql('oof', 'model')})""",
    [*METRIC_NAMES, "score"],
)
def rank_models(spark, sf_dir):
    return metrics.rank_models(metrics.metric_table(baseline_predictions(spark, sf_dir), ["model"], stable=True), order_by="score")


@query("residuals", f"{_OOF} SELECT model, sample_id, actual - predicted AS residual, abs(actual - predicted) AS absolute_error FROM oof", ["residual", "absolute_error"])
def residuals(spark, sf_dir):
    return metrics.residuals(baseline_predictions(spark, sf_dir)).select("model", "sample_id", "residual", "absolute_error")


@query(
    "combine_summaries",
    f"""{_OOF}, {_ENSEMBLE}, a AS (SELECT * FROM ({metrics_sql('oof', 'model')})), b AS (SELECT * FROM ({metrics_sql('ens', 'model')}))
        SELECT model, R2, RMSE, MAE, Spearman, Pearson, 'Baselines' AS model_family, 'Grouped CV' AS validation_label FROM a
        UNION ALL SELECT model, R2, RMSE, MAE, Spearman, NULL, 'Ensemble', 'Mean of members' FROM b""",
    ["R2", "RMSE", "MAE", "Spearman", "Pearson"],
)
def combine_summaries(spark, sf_dir):
    oof = baseline_predictions(spark, sf_dir)
    single = metrics.metric_table(oof, ["model"], stable=True).select("model", "R2", "RMSE", "MAE", "Spearman", "Pearson")
    joint = metrics.metric_table(metrics.ensemble_predictions(oof, ["by_percent", "by_size"]), ["model"]).select("model", "R2", "RMSE", "MAE", "Spearman")
    return metrics.combine_summaries([(single, "Baselines", "Grouped CV"), (joint, "Ensemble", "Mean of members")])


@query(
    "attach_metadata",
    f"""{_OOF} SELECT sample_id AS candidate_id, actual, predicted, order_key AS formulation_group, 'S' || order_key AS formulation_signature,
        {hashed('sample_id')} AS sample_index FROM oof WHERE model = 'by_size'""",
    ["actual", "predicted"],
)
def attach_metadata(spark, sf_dir):
    """Older predictions know only the id; group, signature and index come from the current table."""
    from ..functions.draws import hash32

    rows = baseline_predictions(spark, sf_dir, keep=("order_key",)).where(F.col("model") == "by_size")
    old = rows.select(F.col("sample_id").alias("candidate_id"), "actual", "predicted", F.lit(-1).alias("sample_index"))
    current = rows.select(
        F.col("sample_id").alias("candidate_id"), F.col("order_key").alias("formulation_group"),
        F.concat(F.lit("S"), F.col("order_key").cast("string")).alias("formulation_signature"), hash32(F.col("sample_id")).alias("sample_index"),
    )
    return metrics.attach_metadata(old, current)


def _panel_and_measured(spark, sf_dir):
    """A frozen panel over all predicted mixtures; some were never measured."""
    wide = baseline_columns(spark, sf_dir)
    one = wide.select("sample_id", F.col("by_size").alias("consensus_rank"), *[F.col(m).alias(f"pred_{m}") for m in BASELINES])
    role = F.when(F.col("consensus_rank") > 0.55, "H1_HighConsensus").when(F.col("consensus_rank") > 0.45, "M1_Intermediate")
    role = role.when(F.col("consensus_rank") > 0.4, "L1_LowControl").otherwise("D1_ModelDisagreement")
    mean = sum((F.col(f"pred_{m}") for m in BASELINES), F.lit(0.0)) / len(BASELINES)
    panel = one.withColumns({"selection_role": role, "all_model_raw_mean": mean})
    return panel, wide.where(F.substring("sample_id", 1, 1) != "0").select("sample_id", "actual")


_FROZEN_SQL = f"""{baseline_sql()}, w AS (PIVOT oof ON model IN ('by_percent', 'by_size', 'by_component') USING max(predicted) GROUP BY sample_id, actual),
  m AS (SELECT *, by_size AS consensus_rank, (0.0 + by_percent + by_size + by_component) / 3 AS all_model_raw_mean,
    CASE WHEN by_size > 0.55 THEN 'High' WHEN by_size > 0.45 THEN 'Intermediate' WHEN by_size > 0.4 THEN 'Low' ELSE 'Disagreement' END AS role_group
    FROM w WHERE substr(sample_id, 1, 1) <> '0')"""


@query(
    "role_group_summary",
    f"WITH {_FROZEN_SQL} SELECT role_group, count(*) AS n, avg(actual) AS mean_actual, median(actual) AS median_actual, avg(consensus_rank) AS mean_consensus_rank FROM m GROUP BY 1",
    ["mean_actual", "median_actual", "mean_consensus_rank"],
)
def role_group_summary(spark, sf_dir):
    panel, measured = _panel_and_measured(spark, sf_dir)
    return metrics.role_group_summary(metrics.match_measured(panel, measured, "sample_id"))


@query(
    "evaluate_frozen",
    f"""WITH {_FROZEN_SQL}, s AS (SELECT * FROM ({metrics_sql("(SELECT 'all' AS part, sample_id, actual, consensus_rank AS predicted FROM m)", 'part')})),
        t AS (SELECT * FROM ({metrics_sql("(SELECT 'all' AS part, sample_id, actual, all_model_raw_mean AS predicted FROM m)", 'part')})),
        p AS (SELECT row_number() OVER (ORDER BY actual DESC, md5(sample_id)) AS pa, row_number() OVER (ORDER BY consensus_rank DESC, md5(sample_id)) AS pp FROM m)
        SELECT s.n, s.Spearman AS Spearman_actual_vs_frozen_consensus_rank, (SELECT count(*) FILTER (pa <= 3 AND pp <= 3) / 3 FROM p) AS Top3_overlap,
          (SELECT count(*) FILTER (pa <= 5 AND pp <= 5) / 5 FROM p) AS Top5_overlap, t.R2 AS R2_raw_all_model_mean, t.RMSE AS RMSE_raw_all_model_mean,
          t.MAE AS MAE_raw_all_model_mean FROM s, t""",
    ["Spearman_actual_vs_frozen_consensus_rank", "Top3_overlap", "Top5_overlap", "R2_raw_all_model_mean", "RMSE_raw_all_model_mean", "MAE_raw_all_model_mean"],
)
def evaluate_frozen(spark, sf_dir):
    panel, measured = _panel_and_measured(spark, sf_dir)
    return metrics.evaluate_frozen(panel, measured, "sample_id")["summary"]


@query(
    "evaluate_frozen_models",
    f"""WITH {_FROZEN_SQL}, l AS (SELECT o.* FROM oof o JOIN m USING (sample_id)) SELECT model, n, R2, RMSE, MAE, Spearman FROM ({metrics_sql('l', 'model')})""",
    ["R2", "RMSE", "MAE", "Spearman"],
)
def evaluate_frozen_models(spark, sf_dir):
    panel, measured = _panel_and_measured(spark, sf_dir)
    return metrics.evaluate_frozen(panel, measured, "sample_id")["per_model"]


REPLICATES, RANK_REPLICATES = 2000, 2000


def _weights_sql(replicates: int) -> str:
    return f"""{EVENT_PREDICTIONS}, gi AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i FROM (SELECT DISTINCT user_id FROM events)),
  ng AS (SELECT count(*) AS g FROM gi),
  draws AS (SELECT b.b AS bootstrap_id, {hashed("b.b || '|' || d.i || '|42'")} % g AS i FROM (SELECT unnest(range(1, {replicates + 1})) AS b) b, gi d, ng),
  weights AS (SELECT bootstrap_id::INT AS bootstrap_id, user_id, count(*) AS w FROM draws JOIN gi USING (i) GROUP BY ALL)"""


# Copies of the rows, as often as their group was drawn: what the weights must reproduce.
_COPIES_SQL = "copies AS (SELECT p.*, w.bootstrap_id, c.c FROM preds p JOIN weights w USING (user_id), LATERAL (SELECT unnest(range(w.w)) AS c) c)"
_BOOT_SQL = f"""boot AS (SELECT model, bootstrap_id, count(*) AS n, 1 - avg((actual - predicted) ^ 2) / var_pop(actual) AS R2, sqrt(avg((actual - predicted) ^ 2)) AS RMSE,
  avg(abs(actual - predicted)) AS MAE, corr(actual, predicted) AS Pearson, regr_slope(predicted, actual) AS Calibration_slope,
  regr_intercept(predicted, actual) AS Calibration_intercept, avg(predicted - actual) AS Mean_bias FROM copies GROUP BY ALL)"""
_BOOTSTRAP = f"WITH {_weights_sql(REPLICATES)}, {_COPIES_SQL}, {_BOOT_SQL}"


def _bootstrap(spark, sf_dir):
    return resampling.cluster_bootstrap(event_predictions(spark, sf_dir), "user_id", REPLICATES)


@query("cluster_bootstrap", f"{_BOOTSTRAP} SELECT * FROM boot", MOMENTS)
def cluster_bootstrap(spark, sf_dir):
    return _bootstrap(spark, sf_dir)


_INTERVAL_SQL = " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, count({m}) AS n_finite, quantile_cont({m}, 0.025) AS CI_low, quantile_cont({m}, 0.975) AS CI_high FROM boot GROUP BY model" for m in MOMENTS
)


@query("bootstrap_intervals", f"{_BOOTSTRAP} {_INTERVAL_SQL}", ["CI_low", "CI_high"])
def bootstrap_intervals(spark, sf_dir):
    return resampling.percentile_intervals(_bootstrap(spark, sf_dir), MOMENTS, REPLICATES)


@query(
    "attach_intervals",
    f"""{_BOOTSTRAP}, ci AS (SELECT model, quantile_cont(R2, 0.025) AS R2_CI_low, quantile_cont(R2, 0.975) AS R2_CI_high, quantile_cont(RMSE, 0.025) AS RMSE_CI_low,
        quantile_cont(RMSE, 0.975) AS RMSE_CI_high FROM boot GROUP BY 1)
        SELECT s.model, s.n, s.R2, s.RMSE, ci.* EXCLUDE model FROM ({metrics_sql('preds', 'model', key='event_id')}) s JOIN ci USING (model)""",
    ["R2", "RMSE", "R2_CI_low", "R2_CI_high", "RMSE_CI_low", "RMSE_CI_high"],
)
def attach_intervals(spark, sf_dir):
    preds = materialize(event_predictions(spark, sf_dir))
    summary = metrics.regression_metrics(preds, ["model"]).select("model", "n", "R2", "RMSE")
    intervals = resampling.percentile_intervals(_bootstrap(spark, sf_dir), ["R2", "RMSE"], REPLICATES)
    return resampling.attach_intervals(summary, intervals, ["R2", "RMSE"])


_PAIRED = ("R2", "RMSE", "MAE")


@query(
    "paired_bootstrap",
    f"""{_BOOTSTRAP}, p AS (SELECT * FROM ({metrics_sql('preds', 'model', key='event_id')})),
        d AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, a.{m} - b.{m} AS v FROM boot a JOIN boot b USING (bootstrap_id) WHERE a.model = 'close' AND b.model = 'rough'" for m in _PAIRED)}),
        q AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, a.{m} - b.{m} AS v FROM p a, p b WHERE a.model = 'close' AND b.model = 'rough'" for m in _PAIRED)})
        SELECT 'close' AS model_a, 'rough' AS model_b, d.metric, any_value(q.v) AS difference_a_minus_b, quantile_cont(d.v, 0.025) AS CI_low, quantile_cont(d.v, 0.975) AS CI_high,
          count(*) AS bootstrap_iterations, quantile_cont(d.v, 0.025) > 0 OR quantile_cont(d.v, 0.975) < 0 AS interval_excludes_zero FROM d JOIN q USING (metric) GROUP BY d.metric""",
    ["difference_a_minus_b", "CI_low", "CI_high"],
)
def paired_bootstrap(spark, sf_dir):
    return resampling.paired_bootstrap(event_predictions(spark, sf_dir), "user_id", REPLICATES, key="event_id")


@query(
    "bootstrap_rank_metrics",
    f"""WITH {_weights_sql(RANK_REPLICATES)}, {_COPIES_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY model, bootstrap_id ORDER BY actual)
          + (count(*) OVER (PARTITION BY model, bootstrap_id, actual) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY model, bootstrap_id ORDER BY predicted)
          + (count(*) OVER (PARTITION BY model, bootstrap_id, predicted) - 1) / 2.0 AS rp,
          row_number() OVER (PARTITION BY model, bootstrap_id ORDER BY actual DESC, md5(event_id::VARCHAR), c) AS pa,
          row_number() OVER (PARTITION BY model, bootstrap_id ORDER BY predicted DESC, md5(event_id::VARCHAR), c) AS pp,
          ceil(count(*) OVER (PARTITION BY model, bootstrap_id) * 0.2::DOUBLE) AS k FROM copies)
        SELECT model, bootstrap_id, corr(ra, rp) AS Spearman, count(*) FILTER (pa <= k AND pp <= k) / max(k) AS Top20_recall FROM r GROUP BY ALL""",
    ["Spearman", "Top20_recall"],
)
def bootstrap_rank_metrics(spark, sf_dir):
    return resampling.bootstrap_rank_metrics(event_predictions(spark, sf_dir), "user_id", RANK_REPLICATES, key="event_id")
