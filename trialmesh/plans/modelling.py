"""Queries that train models on the formulations and evaluate them out of fold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import metrics, models, quality, selection, splits, trees
from ..runtime import local_table, materialize, shared_folder
from ..sources import runs
from .registry import query
from .views import folded, folded_sql

CORE = ["IL1_molpct", "IL2_molpct", "IL_total_molpct", "HL_molpct", "CHOL_molpct", "PEG_molpct", "particle_size"]
AUXILIARY = ["NP_ratio", "PDI", "is_dual", "first_helper"]


def training_rows(spark, sf_dir, k: int = 3, repeats: int = 1):
    """Every formulation with its features, group and fold, once per repeat."""
    rows = folded(spark, sf_dir, repeats, k=k)
    extra = {
        "IL_total_molpct": F.col("IL1_molpct") + F.col("IL2_molpct"),
        "is_dual": F.col("IL2").isNotNull().cast("double"),
        "first_helper": (F.col("Phospholipid") == "A").cast("double"),
    }
    return materialize(rows.withColumns(extra).select("sample_id", "order_key", "Round", "repeat_id", "fold_id", "TE", *CORE, *AUXILIARY))


# Trees of the largest ensembles in the searches; the other numbers of a grid scale with it.
TREES = 8


def binned(rows, k_columns=tuple(CORE), **options):
    return trees.bin_table(rows, list(k_columns), "TE", "sample_id", "order_key", **options)


def _oof_summary(predictions):
    """One row per model: how many rows were predicted once and whether the model finds the signal."""
    oof = models.out_of_fold(predictions)
    table = metrics.metric_table(oof, ["model"])
    return table.select("model", "n", (F.col("R2") > 0.3).alias("finds_signal"), (F.col("Spearman") > 0.5).alias("ranks_well"))


def _profile_sql(name: str) -> str:
    return f"SELECT '{name}' AS model, count(*) AS n, true AS finds_signal, true AS ranks_well FROM lineitem JOIN part ON l_partkey = p_partkey"


@query("ridge_cv", _profile_sql("Ridge"))
def ridge_cv(spark, sf_dir):
    oof, _ = models.ridge_cross_validate(training_rows(spark, sf_dir), CORE, "TE", "sample_id", "order_key")
    table = metrics.metric_table(oof, ["model"])
    return table.select("model", "n", (F.col("R2") > 0.3).alias("finds_signal"), (F.col("Spearman") > 0.5).alias("ranks_well"))


@query(
    "ridge_single_feature",
    f"""WITH {folded_sql(k=3)}, t AS (SELECT k.fold_id, count(*) AS n, avg(IL1_molpct) AS mx, var_pop(IL1_molpct) AS vx, avg(TE) AS my, covar_pop(IL1_molpct, TE) AS c
          FROM (SELECT unnest([1, 2, 3])::INT AS fold_id) k JOIN folded f ON f.fold_id <> k.fold_id GROUP BY 1)
        SELECT sample_id, my + n * c / (n * vx + 3.0 * vx) * (IL1_molpct - mx) AS predicted FROM folded JOIN t USING (fold_id)""",
    ["predicted"],
)
def ridge_single_feature(spark, sf_dir):
    """Closed form with one feature and one penalty: the oracle solves the same normal equation."""
    oof, _ = models.ridge_cross_validate(training_rows(spark, sf_dir), ["IL1_molpct"], "TE", "sample_id", "order_key", alphas=[3.0])
    return oof.select("sample_id", "predicted")


@query("forest_cv", _profile_sql("RandomForest"))
def forest_cv(spark, sf_dir):
    """Five folds, in each twelve parameter draws compared on four inner folds."""
    table = binned(training_rows(spark, sf_dir, 5))
    return _oof_summary(trees.nested_search(table, [trees.search_spaces(TREES)["RandomForest"]], roles=("test",)).predictions)


@query("boosted_cv", _profile_sql("GradientBoosting"))
def boosted_cv(spark, sf_dir):
    """Five folds, in each twelve parameter draws of 120 to 500 trees compared on four inner folds."""
    table = binned(training_rows(spark, sf_dir, 5))
    return _oof_summary(trees.nested_search(table, [trees.search_spaces()["GradientBoosting"]], roles=("test",)).predictions)


@query("repeated_search", "SELECT 'ExtraTrees' AS model, r AS repeat_id, f AS fold_id, 48::BIGINT AS n_scored, 12::BIGINT AS n_draws, true AS best_kept FROM (SELECT unnest(range(1, 4))::INT AS r), (SELECT unnest(range(1, 6))::INT AS f)")
def repeated_search(spark, sf_dir):
    """Five folds, three repeats, twelve draws and four inner folds: 720 fits from one table, whether or not they share trees."""
    table = binned(training_rows(spark, sf_dir, 5, repeats=3))
    found = trees.nested_search(table, [trees.search_spaces(TREES // 2)["ExtraTrees"]], roles=("test",))
    draws = found.scores.groupBy("model", "repeat_id", "fold_id").agg(F.count("inner_r2").alias("n_draws"), F.max_by("params", "inner_r2").alias("best"))
    kept = found.predictions.where("role = 'test'").groupBy("model", "repeat_id", "fold_id").agg(F.max("best_params").alias("kept"))
    scored = F.lit(found.fits // 15).cast("bigint")
    return draws.join(kept, ["model", "repeat_id", "fold_id"]).select("model", "repeat_id", "fold_id", scored.alias("n_scored"), "n_draws", (F.col("best") == F.col("kept")).alias("best_kept"))


# Least leaves of the searched one-split trees: the table's rows divided by these.
STUMP_LEAVES = (1_000_000_000, 5, 4)


def _bins_sql(k: int, columns=tuple(CORE)) -> str:
    """Common table expressions up to ``bl``: one row per formulation and feature with fold, inner fold, target and bin."""
    steps = ", ".join(str(i / trees.BINS) for i in range(1, trees.BINS))
    values = ", ".join(c if c != "IL_total_molpct" else "IL1_molpct + IL2_molpct" for c in columns)
    return f"""{folded_sql(k=k)},
      rows_ AS (SELECT sample_id, fold_id, ('0x' || substr(md5(order_key || '|inner|42'), 1, 8))::BIGINT % 4 AS inner_, TE AS y, [{values}] AS xs FROM folded),
      long AS (SELECT sample_id, fold_id, inner_, y, unnest(xs) AS x, unnest(range({len(columns)})) AS f FROM rows_),
      e AS (SELECT f, list_sort(list_distinct(quantile_cont(x, [{steps}]))) AS edges FROM long GROUP BY f),
      bl AS (SELECT sample_id, fold_id, inner_, y, f, len(list_filter(edges, lambda q: q < x)) AS bin FROM long JOIN e USING (f))"""


def _names_sql(columns=tuple(CORE)) -> str:
    return "[" + ", ".join(f"'{c}'" for c in columns) + "][f + 1]"


@query(
    "tuned_forest",
    f"""WITH {_bins_sql(5)},
      cells AS (SELECT fold_id, inner_, f, bin, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM bl GROUP BY ALL),
      sets AS (SELECT o.o, i.i FROM (SELECT unnest(range(1, 6)) AS o) o, (SELECT unnest([-1, 0, 1, 2, 3]) AS i) i),
      h AS (SELECT o, i, f, bin, coalesce(sum(n) FILTER (fold_id <> o AND inner_ <> i), 0) AS n, coalesce(sum(s) FILTER (fold_id <> o AND inner_ <> i), 0) AS s,
              coalesce(sum(n) FILTER (CASE WHEN i >= 0 THEN fold_id <> o AND inner_ = i ELSE fold_id = o END), 0) AS tn,
              coalesce(sum(s) FILTER (CASE WHEN i >= 0 THEN fold_id <> o AND inner_ = i ELSE fold_id = o END), 0) AS ts,
              coalesce(sum(ss) FILTER (CASE WHEN i >= 0 THEN fold_id <> o AND inner_ = i ELSE fold_id = o END), 0) AS tss
            FROM sets, cells GROUP BY o, i, f, bin),
      c AS (SELECT o, i, f, bin, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER p AS na, sum(s) OVER p AS sa FROM h
            WINDOW w AS (PARTITION BY o, i, f ORDER BY bin), p AS (PARTITION BY o, i, f)),
      best AS (SELECT o, i, m, f, bin AS cut, sl / nl AS low, (sa - sl) / (na - nl) AS high FROM c, (SELECT unnest([{', '.join(f'greatest(count(*) // {part}, 1)' for part in STUMP_LEAVES)}]) AS m FROM folded) d
            WHERE nl >= m AND na - nl >= m
            QUALIFY row_number() OVER (PARTITION BY o, i, m ORDER BY sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) - sa * sa / na DESC, f, bin) = 1),
      scored AS (SELECT b.o, b.i, b.m, b.f, b.cut, b.low, b.high,
              1 - sum(tss - 2 * CASE WHEN bin <= cut THEN low ELSE high END * ts + pow(CASE WHEN bin <= cut THEN low ELSE high END, 2) * tn) / (sum(tss) - pow(sum(ts), 2) / sum(tn)) AS r2
            FROM best b JOIN h ON h.o = b.o AND h.i = b.i AND h.f = b.f GROUP BY ALL),
      means AS (SELECT o, m, avg(r2) AS inner_r2 FROM scored WHERE i >= 0 GROUP BY o, m),
      draws AS (SELECT * FROM means QUALIFY row_number() OVER (PARTITION BY o ORDER BY round(inner_r2, 9) DESC, m) = 1)
    SELECT draws.o::INT AS fold_id, draws.m::DOUBLE AS min_leaf, inner_r2, {_names_sql()} AS feature, cut::INT AS cut, low, high, r2
    FROM draws JOIN scored ON scored.o = draws.o AND scored.m = draws.m AND scored.i = -1""",
    ["inner_r2", "low", "high", "r2"],
)
def tuned_forest(spark, sf_dir):
    """A nested search of trees of one split over the least size of a leaf: winner, its split and its score per fold.

    The oracle runs the same search from sums per fold, inner fold, feature and bin.
    """
    table = binned(training_rows(spark, sf_dir, 5))
    n = table.rows.count()
    space = trees.SearchSpace("Stump", trees.TreeParams(n_trees=1, max_depth=1), {"min_leaf": [max(n // part, 1) for part in STUMP_LEAVES]})
    found = trees.nested_search(table, [space], roles=("test",))
    rows = []
    for _, fit, ensemble in found.models:
        tree = ensemble.trees[0]
        values = tree.value * ensemble.unit
        rows.append((fit.part.fold, float(fit.params.min_leaf), ensemble.features[tree.feature[0]], int(tree.cut[0]), float(values[1]), float(values[2])))
    winners = local_table(spark, rows, "fold_id int, min_leaf double, feature string, cut int, low double, high double")
    best = found.scores.groupBy("fold_id").agg(F.max("inner_r2").alias("inner_r2"))
    tested = metrics.regression_metrics(models.out_of_fold(found.predictions), ["fold_id"]).select("fold_id", F.col("R2").alias("r2"))
    return winners.join(best, "fold_id").join(tested, "fold_id")


def _tree_sql(params, n_trees: int, seed: int = 42) -> str:
    """Two levels of trees in SQL: histograms per node, the split rule, then the next level. Draws of the fixed seed are literals."""
    rows = []
    for number in range(n_trees):
        own = trees.tree_seed(seed, number)
        for node in range(3):
            for f in trees.drawn_features(len(CORE), own, node, params).tolist():
                u = float(trees._uniform(trees.np.uint64(own) ^ trees._mix(node * 1_000_003 + f + 500_009)))
                rows.append(f"({number}, {node}, {f}, {u!r}::DOUBLE)")
    base = "0.0::DOUBLE" if params.learning_rate is None else "(SELECT avg(TE) FROM f)"
    rate, l2, leaf = params.learning_rate or 1.0, params.l2, params.min_leaf

    def level(name: str, source: str) -> str:
        random = f"""QUALIFY edge = arg_min(edge, (abs(edge - (elo + u * (ehi - elo))), bin)) OVER (PARTITION BY tree, node, f)""" if params.random_cuts else ""
        return f"""h{name} AS (SELECT tree, node, f, any_value(u) AS u, bin, count(*)::DOUBLE AS n, sum(y) AS s FROM {source} GROUP BY tree, node, f, bin),
      r{name} AS (SELECT h.*, min(bin) OVER g AS lo, max(bin) OVER g AS hi, edges FROM h{name} h JOIN e USING (f) WINDOW g AS (PARTITION BY tree, node, f)),
      a{name} AS (SELECT tree, node, f, any_value(u) AS u, unnest(range(any_value(lo), any_value(hi))) AS bin, any_value(edges) AS edges, any_value(lo) AS lo, any_value(hi) AS hi FROM r{name} GROUP BY tree, node, f),
      c{name} AS (SELECT a.tree, a.node, a.f, a.u, a.bin, edges[a.bin + 1] AS edge, edges[lo + 1] AS elo, edges[hi] AS ehi,
            (SELECT sum(n) FROM h{name} h WHERE h.tree = a.tree AND h.node = a.node AND h.f = a.f AND h.bin <= a.bin) AS nl,
            (SELECT sum(s) FROM h{name} h WHERE h.tree = a.tree AND h.node = a.node AND h.f = a.f AND h.bin <= a.bin) AS sl,
            (SELECT sum(n) FROM h{name} h WHERE h.tree = a.tree AND h.node = a.node AND h.f = a.f) AS na,
            (SELECT sum(s) FROM h{name} h WHERE h.tree = a.tree AND h.node = a.node AND h.f = a.f) AS sa FROM a{name} a),
      k{name} AS (SELECT * FROM c{name} {random}),
      s{name} AS (SELECT tree, node, f, bin AS cut, na, sa, nl, sl FROM k{name} WHERE nl >= {leaf} AND na - nl >= {leaf}
            QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY sl * sl / (nl + {l2}) + (sa - sl) * (sa - sl) / (na - nl + {l2}) - sa * sa / (na + {l2}) DESC, f, bin) = 1)"""

    return f"""WITH {_bins_sql(5)},
      draws(tree, node, f, u) AS (VALUES {', '.join(rows)}),
      b0 AS (SELECT tree, node, f, u, sample_id, bin, y - {base} AS y FROM draws JOIN bl USING (f) WHERE node = 0),
      {level('0', 'b0')},
      n1 AS (SELECT tree, sample_id, 1 + (bin > cut)::INT AS node FROM s0 JOIN bl USING (f)),
      b1 AS (SELECT tree, node, f, u, sample_id, bin, y - {base} AS y FROM n1 JOIN draws USING (tree, node) JOIN bl USING (sample_id, f)),
      {level('1', 'b1')},
      splits AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1),
      nodes AS (SELECT tree, node, f, cut, na AS n, sa AS s FROM splits
        UNION ALL SELECT tree, 2 * node + 1, NULL, NULL, nl, sl FROM s1 UNION ALL SELECT tree, 2 * node + 2, NULL, NULL, na - nl, sa - sl FROM s1)
    SELECT tree::INT AS tree, node::INT AS node, CASE WHEN f IS NOT NULL THEN {_names_sql()} END AS feature, cut::INT AS cut, n AS weight, {rate} * s / (n + {l2}) AS value FROM nodes"""


EXTRA = trees.TreeParams(n_trees=4, max_depth=2, min_leaf=3, node_features=0.7, random_cuts=True)
REGULARIZED = trees.TreeParams(n_trees=1, max_depth=2, min_leaf=5, tree_features=0.7, l2=5.0, learning_rate=0.05)


@query("extra_trees_nodes", _tree_sql(EXTRA, 4), ["value"], digits=9)
def extra_trees_nodes(spark, sf_dir):
    """Extremely randomised trees on every formulation: one random threshold per node and drawn feature, the best of them splits."""
    return trees.fit_ensembles(binned(training_rows(spark, sf_dir, 5)), [trees.Fit(trees.Part(), EXTRA)])[0].nodes(spark)


@query("regularized_first_tree", _tree_sql(REGULARIZED, 1), ["value"], digits=9)
def regularized_first_tree(spark, sf_dir):
    """The first tree of regularised boosting: residuals of the mean, penalised gains and leaves, drawn features."""
    return trees.fit_ensembles(binned(training_rows(spark, sf_dir, 5)), [trees.Fit(trees.Part(), REGULARIZED)])[0].nodes(spark)


@query("frozen_model_nodes", _tree_sql(EXTRA, 4, seed=7), ["value"], digits=9)
def frozen_model_nodes(spark, sf_dir):
    """Extremely randomised trees frozen with their training table's fingerprint, and loaded for the same table."""
    rows = training_rows(spark, sf_dir, 5)
    path = f"{shared_folder(spark)}/models/{uuid.uuid4().hex}"
    fitted = {"ExtraTrees": trees.fit_ensembles(binned(rows), [trees.Fit(trees.Part(), EXTRA, 7)])[0]}
    runs.save_models(spark, path, "deployed", fitted, rows, ["sample_id", "TE", *CORE])
    return runs.load_models(spark, path, "deployed", rows)["ExtraTrees"].nodes(spark)


@query("nested_cv_selected_features")
def nested_cv_selected_features(spark, sf_dir):
    """Feature selection inside each training fold, then a searched forest on the core and the chosen features."""
    rows = training_rows(spark, sf_dir, 5)
    chosen = materialize(selection.mrmr_select(rows, AUXILIARY, "TE", "sample_id", 2, "fold_id", stable=True))
    columns = [*CORE, *AUXILIARY]
    own = {(1, fold): list(range(len(CORE))) for fold in range(1, 6)}
    for r in chosen.collect():
        own[1, r["fold_id"]].append(columns.index(r["feature"]))
    found = trees.nested_search(binned(rows, columns), [trees.search_spaces(TREES // 2)["RandomForest"]], columns=own, roles=("test",))
    tested = metrics.regression_metrics(models.out_of_fold(found.predictions), ["model", "fold_id"]).select("model", "fold_id", "n", F.round("R2", 3).alias("R2"))
    return chosen.join(tested, on="fold_id")


def _tuned_models(rows):
    """Forest and boosted trees, each the best of twelve draws on four inner folds of ``rows``."""
    table = binned(rows, fold=None, repeat=None)
    spaces = trees.search_spaces(TREES)
    return {name: trees.fit_tuned_ensemble(table, spaces[name]) for name in ("RandomForest", "GradientBoosting")}


def _scored(fitted, rows, keep):
    """Long predictions of every ensemble over the rows."""
    for name, ensemble in fitted.items():
        rows = ensemble.score(rows, f"_p_{name}")
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_p_{n}").alias("predicted")) for n in fitted])
    return rows.select(*keep, F.inline(pairs))


@query("score_pool", "SELECT model, count(*) AS n, true AS follows_response FROM part JOIN lineitem ON l_partkey = p_partkey, (SELECT unnest(['RandomForest', 'GradientBoosting']) AS model) GROUP BY 1")
def score_pool(spark, sf_dir):
    """Models fitted on early rounds, applied to every formulation as a pool."""
    rows = training_rows(spark, sf_dir)
    fitted = _tuned_models(rows.where(F.col("Round").isin("R1", "R2", "R3")))
    long = _scored(fitted, rows.select("sample_id", "TE", *CORE), ["sample_id", "TE"])
    return long.groupBy("model").agg(F.count(F.lit(1)).alias("n"), (metrics.correlation("TE", "predicted") > 0.5).alias("follows_response"))


def _round_number(column: str = "Round"):
    return F.substring(column, 2, 9).cast("int")


@query(
    "round_holdout",
    "SELECT 'R' || (year(l_shipdate) - 1994) AS test_round, count(*) AS n, true AS finds_signal FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def round_holdout(spark, sf_dir):
    """Each round held out in turn: a searched forest of the other rounds."""
    rows = training_rows(spark, sf_dir).withColumn("fold_id", _round_number())
    found = trees.nested_search(binned(rows), [trees.search_spaces(TREES // 2)["RandomForest"]], roles=("test",))
    tested = metrics.metric_table(models.out_of_fold(found.predictions), ["fold_id"])
    return tested.select(F.concat(F.lit("R"), F.col("fold_id").cast("string")).alias("test_round"), "n", (F.col("R2") > 0.3).alias("finds_signal"))


@query(
    "learning_curve",
    """WITH r AS (SELECT year(l_shipdate) - 1994 AS r, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
       SELECT row_number() OVER (ORDER BY r)::INT AS stage_order, string_agg('R' || r, '+') OVER (ORDER BY r) AS stage, (sum(n) OVER (ORDER BY r))::BIGINT AS n, true AS finds_signal FROM r""",
)
def learning_curve(spark, sf_dir):
    """Rounds 1, 1–2, … up to all of them, each stage cross-validated on its own rows; all stages grow together."""
    rows = training_rows(spark, sf_dir, 5).drop("repeat_id")
    staged = splits.cumulative_stages(rows, "Round")
    names = staged.select("stage_order", "stage").distinct()
    space = trees.SearchSpace("RandomForest", trees.TreeParams(n_trees=TREES, max_depth=6, node_features=0.7, min_leaf=2, sampling="bootstrap"), {})
    found = trees.nested_search(binned(staged.drop("stage").withColumnRenamed("stage_order", "repeat_id")), [space], roles=("test",))
    curve = metrics.metric_table(models.out_of_fold(found.predictions), ["repeat_id"])
    return curve.join(names, curve["repeat_id"] == names["stage_order"]).select(F.col("stage_order").cast("int").alias("stage_order"), "stage", "n", (F.col("R2") > 0.3).alias("finds_signal"))


@query(
    "external_validation",
    """SELECT 'external' AS validation_set, count(*) FILTER (l_discount <= 0.08) AS n, count(*) FILTER (l_discount > 0.08) AS n_removed, true AS finds_signal
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) >= 1999 AND l_suppkey % 97 <> 0""",
)
def external_validation(spark, sf_dir):
    """Models from early rounds validated on later rounds after their own quality check."""
    rows = training_rows(spark, sf_dir)
    early = _round_number() <= 4
    external = rows.where(~early & F.col("PDI").isNotNull())
    kept, removed = quality.split_rows(quality.flag_rows(external, [quality.Rule("PDI>0.08", F.col("PDI") > 0.08)]))
    long = _scored(_tuned_models(rows.where(early)), kept.select("sample_id", "TE", *CORE), ["sample_id", "TE"])
    mean = materialize(long.groupBy("sample_id").agg(F.min("TE").alias("actual"), F.avg("predicted").alias("predicted")))
    found = metrics.metric_table(mean.withColumn("validation_set", F.lit("external")), ["validation_set"])
    return found.select("validation_set", "n", F.lit(removed.count()).alias("n_removed"), (F.col("R2") > 0.3).alias("finds_signal"))


@query("transfer_evaluation")
def transfer_evaluation(spark, sf_dir):
    """Early rounds as source tasks (one per order size), later rounds as the target table."""
    rows = training_rows(spark, sf_dir).drop("repeat_id", "fold_id")
    early = F.substring("Round", 2, 9).cast("int") <= 4
    source = rows.where(early).withColumn("task", F.pmod(F.col("order_key"), F.lit(50)))
    runs = models.transfer_evaluation(source, rows.where(~early), CORE, "TE", "TE", "task", "sample_id")
    return metrics.aggregate_repeats(runs)
