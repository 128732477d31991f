"""Fold-safe feature selection. A training fold is always the total minus its test fold, so one pass serves all folds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.ordering import quantile_values
from ..functions.text import finite
from ..runtime import local_table, materialize

CONSTANT_SD = 1e-12


def _long(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), finite(c).alias("value")) for c in features])
    return df.select(*keep, F.inline(pairs))


def constant_features(df: DataFrame, features: Sequence[str], fold: str = "fold_id") -> DataFrame:
    """Per fold and feature: range of the training rows and whether it is constant there.

    Every fold is aggregated once; the training range is the range over the other folds (a few rows per feature).
    """
    per_fold = _long(df, features, [fold]).groupBy(fold, "feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    others = per_fold.groupBy("feature").agg(F.collect_list(F.struct(F.col(fold).alias("f"), "lo", "hi")).alias("all"))
    each = others.select("feature", "all", F.explode("all.f").alias(fold))
    rest = F.filter("all", lambda s: s["f"] != F.col(fold))
    low = F.array_min(F.transform(rest, lambda s: s["lo"]))
    high = F.array_max(F.transform(rest, lambda s: s["hi"]))
    return each.select(
        fold, "feature", low.alias("train_min"), high.alias("train_max"),
        F.coalesce(high - low <= CONSTANT_SD, F.lit(True)).alias("is_constant"),
    )


def contingency_counts(df: DataFrame, features: Sequence[str], target: str, edges: dict[str, list[float]], fold: str = "fold_id") -> DataFrame:
    """Rows per fold, feature, bin of the feature (``xb``) and bin of the target (``yb``): ``c``. A bin is the number of edges below the value.

    Tasks bin their rows column by column and pass on counts.
    """
    columns = [target, *features]
    cuts = [np.sort(np.array(edges[c], dtype=float)) for c in columns]
    width = max(len(c) for c in cuts) + 1
    schema = T.StructType([df.schema[fold], *T.StructType.fromDDL("feature string, xb int, yb int, c bigint").fields])
    fold_type = to_arrow_type(schema[fold].dataType)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            folds = batch.column(0).dictionary_encode(null_encoding="encode")
            labels, own = folds.dictionary.to_pylist(), folds.indices.to_numpy()
            bins = [np.searchsorted(cut, batch.column(1 + i).to_numpy(zero_copy_only=False), side="left") for i, cut in enumerate(cuts)]
            size = len(labels) * width * width
            for i in range(len(features)):
                counts = np.bincount((own * width + bins[1 + i]) * width + bins[0], minlength=size).reshape(len(labels), width, width)
                for label, part in zip(labels, counts):
                    totals.setdefault(label, np.zeros((len(features), width, width), np.int64))[i] += part
        for label, total in totals.items():
            f, x, y = np.nonzero(total)
            names = pa.array([features[i] for i in f], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(f), fold_type), names, pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(total[f, x, y])], names=schema.names
            )

    narrow = df.select(fold, *[F.coalesce(finite(c), F.lit(0.0)).alias(f"_c{i}") for i, c in enumerate(columns)])
    return narrow.mapInArrow(count, schema).groupBy(fold, "feature", "xb", "yb").agg(F.sum("c").alias("c"))


def quantile_edges(df: DataFrame, columns: Sequence[str], key: str, bins: int, stable: bool = False) -> dict[str, list[float]]:
    """Distinct inner quantiles per column."""
    steps = [i / bins for i in range(1, bins)]
    found = quantile_values(df, columns, steps, tie=key, stable=stable)
    return {c: sorted(set(found[c].values())) for c in columns}


def binned_mutual_information(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    key: str,
    fold: str = "fold_id",
    bins: int = 8,
    stable: bool = False,
) -> DataFrame:
    """Mutual information between quantile bins of each feature and of the target, per training fold (nats).

    Bin edges come from the whole table and do not depend on the target–feature relation; two-valued features
    keep their two values. Contingency counts of a training fold are total minus test counts.
    """
    edges = quantile_edges(df, [*features, target], key, bins, stable)
    # Several steps below read the table of counts, so it is written.
    cells = materialize(contingency_counts(df, features, target, edges, fold))
    # The contingency table is small: folds x features x bins x bins.
    folds = cells.select(fold).distinct()
    total = cells.groupBy("feature", "xb", "yb").agg(F.sum("c").alias("t"), F.map_from_entries(F.collect_list(F.struct(fold, "c"))).alias("by_fold"))
    ids = sorted(row[0] for row in folds.collect())
    train = total.select(
        "feature", "xb", "yb", F.explode(F.array(*[F.lit(i) for i in ids])).alias(fold), "t", "by_fold"
    ).withColumn("n", F.col("t") - F.coalesce(F.try_element_at("by_fold", F.col(fold)), F.lit(0)))
    group = [fold, "feature"]
    train = (
        train.where(F.col("n") > 0)
        .withColumn("nx", F.sum("n").over(Window.partitionBy(*group, "xb")))
        .withColumn("ny", F.sum("n").over(Window.partitionBy(*group, "yb")))
        .withColumn("nn", F.sum("n").over(Window.partitionBy(*group)))
    )
    n, nn = F.col("n").cast("double"), F.col("nn").cast("double")
    term = n / nn * F.log(n * nn / (F.col("nx").cast("double") * F.col("ny").cast("double")))
    return train.groupBy(*group).agg(F.greatest(F.sum(term), F.lit(0.0)).alias("relevance"))


# A task holds the products of two blocks of this many columns, per fold.
BLOCK_COLUMNS = 512


def _partial_products(left: Sequence[str], right: Sequence[str] | None, fold: str):
    """One row per task and fold: products of the columns of two blocks, or of one block with itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict = {}
        for batch in batches:
            labels = batch[fold].to_numpy()
            a = batch[list(left)].to_numpy(dtype=float)
            b = a if right is None else batch[list(right)].to_numpy(dtype=float)
            for label in np.unique(labels):
                own = labels == label
                totals[label] = totals.get(label, 0.0) + a[own].T @ b[own]
        for label, product in totals.items():
            yield pd.DataFrame({fold: [label], "products": [product.ravel().tolist()]})

    return run


def fold_products(df: DataFrame, columns: Sequence[str], fold: str = "fold_id", block: int = BLOCK_COLUMNS) -> dict[int, np.ndarray]:
    """Cross products of (1, columns) per fold, computed in the tasks and summed as vectors.

    More columns than a block are written once and multiplied block by block: a pass reads the columns of two blocks and a task
    holds one block of products per fold. The matrices themselves are as large as the square of the columns.
    """
    names = ["_intercept", *columns]
    narrow = df.select(F.col(fold).cast("int").alias(fold), F.lit(1.0).alias("_intercept"), *[F.coalesce(finite(c), F.lit(0.0)).alias(c) for c in columns])
    if len(names) > block:
        narrow = materialize(narrow)
    blocks = [names[i : i + block] for i in range(0, len(names), block)]
    found: dict[int, np.ndarray] = {}
    for i, left in enumerate(blocks):
        for j in range(i, len(blocks)):
            right = None if i == j else blocks[j]
            partial = narrow.select(fold, *left, *(right or [])).mapInPandas(_partial_products(left, right, fold), f"{fold} int, products array<double>")
            summed = partial.groupBy(fold).agg(vector_to_array(Summarizer.sum(array_to_vector("products"))).alias("products"))
            for row in summed.collect():
                whole = found.setdefault(row[fold], np.zeros((len(names), len(names))))
                part = np.array(row["products"]).reshape(len(left), -1)
                whole[i * block : i * block + len(left), j * block : j * block + part.shape[1]] = part
                whole[j * block : j * block + part.shape[1], i * block : i * block + len(left)] = part.T
    return found


def marked_products(df: DataFrame, columns: Sequence[str], marks: str, n_marks: int) -> dict[int, np.ndarray]:
    """Cross products of (1, columns) of the rows marked for each of several overlapping sets, from one pass.

    ``marks`` is an array of ``n_marks`` booleans per row; sets without rows are missing.
    """
    names = ["_intercept", *columns]
    narrow = df.select(F.lit(1.0).alias("_intercept"), *[F.coalesce(finite(c), F.lit(0.0)).alias(c) for c in columns], F.col(marks).alias("_marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            a = np.column_stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(len(names))])
            marked = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_marks).astype(bool)
            for i in range(n_marks):
                own = a[marked[:, i]]
                if len(own):
                    totals[i] = totals.get(i, 0.0) + own.T @ own
        for i, product in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([product.ravel().tolist()], pa.list_(pa.float64()))], names=["_mark", "products"])

    partial = narrow.mapInArrow(run, "_mark int, products array<double>")
    summed = partial.groupBy("_mark").agg(vector_to_array(Summarizer.sum(array_to_vector("products"))).alias("products"))
    return {row["_mark"]: np.array(row["products"]).reshape(len(names), -1) for row in summed.collect()}


def _centre(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subtract the overall means; correlations do not change and the sums stay well conditioned."""
    row = df.agg(*[F.avg(finite(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    means = {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(columns)}
    return df.withColumns({c: F.coalesce(finite(c), F.lit(0.0)) - F.lit(m) for c, m in means.items()})


def abs_correlation_matrices(df: DataFrame, features: Sequence[str], fold: str = "fold_id") -> dict[int, np.ndarray]:
    """Absolute correlation matrix of the training rows of every fold; 0 where a side is constant."""
    products = fold_products(_centre(df, features), features, fold)
    total = sum(products.values())
    matrices = {}
    for label, test in products.items():
        train = total - test
        n, sums = train[0, 0], train[0, 1:]
        covariance = train[1:, 1:] / n - np.outer(sums / n, sums / n)
        sd = np.sqrt(np.maximum(np.diag(covariance), 0.0))
        scale = np.outer(sd, sd)
        usable = np.outer(sd > 1e-9, sd > 1e-9)
        matrices[label] = np.abs(np.divide(covariance, scale, out=np.zeros_like(scale), where=usable))
    return matrices


def pairwise_abs_correlation(df: DataFrame, features: Sequence[str], fold: str = "fold_id") -> DataFrame:
    """Long form of the matrices: fold, two feature names in order, absolute correlation."""
    rows = []
    for label, matrix in sorted(abs_correlation_matrices(df, features, fold).items()):
        for i, a in enumerate(features):
            for j in range(i + 1, len(features)):
                rows.append((int(label), a, features[j], float(matrix[i, j])))
    return local_table(df.sparkSession, rows, f"{fold} int, feature_a string, feature_b string, abs_correlation double")


def mrmr_select(
    df: DataFrame, features: Sequence[str], target: str, key: str, k: int = 8, fold: str = "fold_id", bins: int = 8, stable: bool = False,
    relevance_of: DataFrame | None = None,
) -> DataFrame:
    """Relevance minus mean redundancy, chosen greedily per fold: ``fold_id``, ``aux_rank``, ``feature``.

    ``relevance_of`` (``fold, feature, relevance``), for example from ``neighbour_mutual_information``, replaces the binned estimate.
    Relevance and correlations are Spark aggregates; the greedy choice runs over at most max(4k, 24) names.
    """
    constant = {(r[fold], r["feature"]) for r in constant_features(df, features, fold).where("is_constant").collect()}
    relevance: dict[int, dict[str, float]] = {}
    scored = binned_mutual_information(df, features, target, key, fold, bins, stable) if relevance_of is None else relevance_of
    for row in scored.select(fold, "feature", "relevance").collect():
        if (row[fold], row["feature"]) not in constant:
            relevance.setdefault(row[fold], {})[row["feature"]] = row["relevance"]
    place = {c: i for i, c in enumerate(features)}
    wanted = {label: min(k, len(scores)) for label, scores in relevance.items()}
    leading = {label: sorted(scores, key=lambda c: (-scores[c], place[c]))[: max(4 * wanted[label], 24)] for label, scores in relevance.items()}
    # Correlations are needed among the leading features of the folds only.
    compared = sorted({c for names in leading.values() for c in names}, key=place.__getitem__)
    matrices = abs_correlation_matrices(df, compared, fold) if compared else {}
    place = {c: i for i, c in enumerate(compared)}
    rows = []
    for label, scores in sorted(relevance.items()):
        ranked = leading[label]
        chosen: list[str] = []
        while ranked and len(chosen) < wanted[label]:
            indices = [place[c] for c in chosen]

            def score(c: str) -> float:
                return scores[c] - (float(np.mean(matrices[label][place[c], indices])) if indices else 0.0)

            best = max(ranked, key=score)
            ranked.remove(best)
            chosen.append(best)
            rows.append((int(label), len(chosen), best))
    return local_table(df.sparkSession, rows, f"{fold} int, aux_rank int, feature string")


def selection_frequency(selected: DataFrame, n_folds: int) -> DataFrame:
    """How often and how early each feature was chosen."""
    return selected.groupBy("model", "feature").agg(
        F.count(F.lit(1)).alias("selection_count"),
        (F.count(F.lit(1)) / F.lit(n_folds)).alias("selection_fraction"),
        F.avg("aux_rank").alias("mean_rank"),
    )
