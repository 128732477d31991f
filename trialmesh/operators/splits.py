"""Leakage-safe split assignment.

Folds come from the md5 order of the keys. Fitting finds the few hash values where one fold ends and the next
begins; assigning a row then compares its own hash with those values, so rows are neither joined nor shuffled
and one key with very many rows does no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import key_hash
from ..functions.ordering import ROWS_PER_CELL, hash_order_cuts, hash_position
from ..functions.text import round_number
from ..runtime import materialize


def _fold_of(order_hash: Column, cuts: Sequence[str]) -> Column:
    fold = F.lit(1)
    for cut in cuts:
        fold = fold + (order_hash > F.lit(cut)).cast("int")
    return fold


def grouped_kfold(
    df: DataFrame,
    group: str,
    k: int = 5,
    repeats: int = 3,
    seed: int = 42,
    *,
    exact: bool = True,
    stable: bool = False,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Repeat every row once per repeat with its ``repeat_id`` and test ``fold_id``; a group never spans folds.

    ``exact`` gives folds whose group counts differ by at most one. Otherwise the fold is a slice of the hash
    range: no pass over the data at all, and near-equal folds when there are many groups.
    """
    groups = df.select(F.col(group).cast("string").alias("_group")).distinct() if exact else None
    return _kfold(df, F.col(group), groups, k, repeats, seed, exact, rows_per_cell)


def random_kfold(df: DataFrame, key: str, k: int = 5, repeats: int = 3, seed: int = 42, *, exact: bool = True, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Row-level folds; ``key`` must be unique."""
    keys = df.select(F.col(key).cast("string").alias("_group")) if exact else None
    return _kfold(df, F.col(key), keys, k, repeats, seed, exact, rows_per_cell)


def _kfold(df, key, keys, k, repeats, seed, exact, rows_per_cell) -> DataFrame:
    ids = list(range(1, repeats + 1))
    if exact:
        keys = materialize(keys)
        n = keys.count()
        k = min(k, n)
        if k < 2:
            raise ValueError("at least two groups are needed")
        repeated = keys.withColumn("repeat_id", F.explode(F.array(*[F.lit(r) for r in ids])))
        ends, size, larger = [], n // k, n % k
        for fold in range(1, k):
            ends.append(fold * size + min(fold, larger))
        cuts = hash_order_cuts(
            repeated, key_hash(F.col("_group"), seed, F.col("repeat_id")), F.array(*[F.lit(e) for e in ends]),
            ["repeat_id"], stable=True, rows_per_cell=rows_per_cell,
        )
        found: dict[int, list[str]] = {r: [] for r in ids}
        for row in cuts.orderBy("repeat_id", "tag").collect():
            found[row["repeat_id"]].append(row["cut_hash"])
    else:
        edges = [f"{(4294967296 * fold) // k:08x}" for fold in range(1, k)]
        found = {r: edges for r in ids}
    pairs = [
        F.struct(F.lit(r).alias("repeat_id"), _fold_of(key_hash(key, seed, r), found[r]).alias("fold_id")) for r in ids
    ]
    return df.select("*", F.inline(F.array(*pairs)))


def split_assignments(folds: DataFrame, k: int) -> DataFrame:
    """Long table: every row once per repeat and fold with its role."""
    return (
        folds.withColumnRenamed("fold_id", "_test_fold")
        .withColumn("fold_id", F.explode(F.sequence(F.lit(1), F.lit(k))))
        .withColumn("global_fold_id", (F.col("repeat_id") - 1) * k + F.col("fold_id"))
        .withColumn("role", F.when(F.col("fold_id") == F.col("_test_fold"), "test").otherwise("train"))
        .drop("_test_fold")
    )


def split_coverage(assignments: DataFrame, key: str) -> DataFrame:
    """Per repeat: samples, and samples that were not tested exactly once."""
    tested = assignments.groupBy("repeat_id", key).agg(F.sum((F.col("role") == "test").cast("bigint")).alias("n_tested"))
    return tested.groupBy("repeat_id").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum((F.col("n_tested") != 1).cast("bigint")).alias("n_not_tested_once"),
    )


def split_leakage(assignments: DataFrame, group: str) -> DataFrame:
    """Per repeat and fold: sizes of both roles and groups that appear in both."""
    test = (F.col("role") == "test").cast("bigint")
    per_group = assignments.groupBy("repeat_id", "fold_id", group).agg(F.sum(test).alias("t"), F.sum(1 - test).alias("r"))
    return per_group.groupBy("repeat_id", "fold_id").agg(
        F.sum("r").alias("n_train"),
        F.sum("t").alias("n_test"),
        F.sum(((F.col("t") > 0) & (F.col("r") > 0)).cast("bigint")).alias("n_leaking_groups"),
    )


def rounds_in_order(df: DataFrame, round_column: str) -> list[str]:
    """Usable round labels in numeric order (a handful of labels)."""
    labels = [row[0] for row in df.select(round_column).distinct().collect()]
    usable = [v for v in labels if v not in (None, "", "UNKNOWN", "nan", "None")]

    def order(label: str):
        digits = "".join(ch if ch.isdigit() else " " for ch in label).split()
        return (int(digits[0]), label) if digits else (10**9, label)

    return sorted(usable, key=order)


def stage_label(rounds: Sequence[str], order: Column) -> Column:
    labels = ["+".join(rounds[: i + 1]) for i in range(len(rounds))]
    return F.element_at(F.array(*[F.lit(v) for v in labels]), order.cast("int"))


def cumulative_stages(df: DataFrame, round_column: str, min_rows: int = 15) -> DataFrame:
    """Repeat each row for every stage R1, R1+R2, … that includes its round; small stages are left out."""
    sizes = {row[round_column]: row["n_rows"] for row in df.groupBy(round_column).agg(F.count(F.lit(1)).alias("n_rows")).collect()}
    rounds = rounds_in_order(df, round_column)
    stages, total = [], 0
    for i, label in enumerate(rounds, start=1):
        total += sizes[label]
        if total >= min_rows:
            stages.append(i)
    place = F.array_position(F.array(*[F.lit(r) for r in rounds]), F.col(round_column))
    kept = F.filter(F.array(*[F.lit(s) for s in stages]), lambda s: s >= place)
    return (
        df.where(F.col(round_column).isin(rounds))
        .withColumn("stage_order", F.explode(kept))
        .withColumn("stage", stage_label(rounds, F.col("stage_order")))
    )


def leave_one_round_out(df: DataFrame, round_column: str, min_test: int = 2, min_train: int = 10) -> DataFrame:
    """Repeat each row for every held-out round that is large enough, with its role."""
    counts = {row[0]: row["n"] for row in df.groupBy(round_column).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    rounds = rounds_in_order(df, round_column)
    if len(rounds) < 2:
        raise ValueError("at least two usable rounds are needed")
    held_out = [r for r in rounds if counts[r] >= min_test and total - counts[r] >= min_train]
    repeated = df.withColumn("test_round", F.explode(F.array(*[F.lit(r) for r in held_out])))
    same = F.coalesce(F.col(round_column) == F.col("test_round"), F.lit(False))
    return repeated.withColumn("role", F.when(same, "test").otherwise("train"))


def random_support_query(df: DataFrame, key: str, fraction: float = 0.8, repeats: int = 20, seed: int = 42, *, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Repeated random support/query roles with clamp(round(n·fraction), 3, n−2) support rows."""
    roles = [
        F.struct(F.lit(r).alias("repeat_id"), F.when(flag, "support").otherwise("query").alias("role"))
        for r, flag in support_flags(df, key, fraction, repeats, seed, rows_per_cell=rows_per_cell).items()
    ]
    return df.select("*", F.inline(F.array(*roles)))


def support_flags(df: DataFrame, key: str, fraction: float = 0.8, repeats: int = 20, seed: int = 42, *, rows_per_cell: int = ROWS_PER_CELL) -> dict[int, Column]:
    """The same roles as one condition per repeat, so that rows need no copies."""
    keys = materialize(df.select(F.col(key).cast("string").alias("_key")))
    n = keys.count()
    n_support = min(max(3, round(n * fraction)), n - 2)
    ids = list(range(repeats))
    repeated = keys.withColumn("repeat_id", F.explode(F.array(*[F.lit(r) for r in ids])))
    cuts = hash_order_cuts(
        repeated, key_hash(F.col("_key"), seed, F.col("repeat_id")), F.array(F.lit(n_support)), ["repeat_id"],
        stable=True, rows_per_cell=rows_per_cell,
    )
    found = {row["repeat_id"]: row["cut_hash"] for row in cuts.collect()}
    return {r: key_hash(F.col(key), seed, r) <= F.lit(found[r]) for r in ids}


def latest_round_query(
    df: DataFrame,
    round_column: str,
    support_rounds: Sequence[str] | None = None,
    query_rounds: Sequence[str] | None = None,
    min_support: int = 3,
    min_query: int = 2,
) -> DataFrame:
    """The latest round is the query, earlier rounds the support; or explicit lists such as ``["1", "R2"]``."""
    number = round_number(F.col(round_column))

    def parsed(labels: Sequence[str]) -> list[int]:
        return [int(label.strip().upper().removeprefix("R")) for label in labels]

    if support_rounds and query_rounds:
        role = F.when(number.isin(parsed(query_rounds)), "query").when(number.isin(parsed(support_rounds)), "support")
    else:
        latest = df.agg(F.max(number)).first()[0]
        role = F.when(number == latest, "query").when(number < latest, "support")
    out = df.withColumn("role", role).where(F.col("role").isNotNull())
    sizes = {row["role"]: row["n"] for row in out.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sizes.get("support", 0) < min_support or sizes.get("query", 0) < min_query:
        raise ValueError(f"support/query split too small: {sizes}")
    return out


def chunk_tasks(df: DataFrame, group: str, key: str, size: int = 20, seed: int = 42, *, stable: bool = False, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Cut each group, in random order, into full chunks of ``size`` rows; the remainder is dropped."""
    placed = hash_position(
        df, key_hash(F.col(key), seed), [group], out="_pos", total="_n", stable=stable, rows_per_cell=rows_per_cell
    )
    chunk = F.floor((F.col("_pos") - 1) / size)
    return (
        placed.withColumn("_chunk", chunk)
        .where(F.col("_chunk") < F.floor(F.col("_n") / size))
        .withColumn("task_id", F.concat(F.col(group).cast("string"), F.format_string("__chunk%03d", F.col("_chunk"))))
        .drop("_pos", "_n", "_chunk")
    )


def chunk_report(df: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows before and after chunking and the number of tasks."""
    after = tasks.agg(F.count(F.lit(1)).alias("n_rows_after"), F.count_distinct("task_id").alias("n_tasks")).first()
    return df.agg(F.count(F.lit(1)).alias("n_rows_before")).withColumns(
        {"n_rows_after": F.lit(after["n_rows_after"]), "n_tasks": F.lit(after["n_tasks"])}
    )


def alternate_by_response(tasks: DataFrame, response: str, key: str, support: int = 10, query: int = 10, task: str = "task_id") -> DataFrame:
    """Sort each task by response and deal its rows alternately to support and query.

    Tasks have ``support + query`` rows by construction, so this window is small.
    """
    i = F.row_number().over(Window.partitionBy(task).orderBy(response, key)) - 1
    ranked = tasks.withColumn("_i", i)
    even = F.col("_i") % 2 == 0
    if support <= query:
        is_support = even & (F.col("_i") < 2 * support)
    else:
        is_support = even | (F.col("_i") >= 2 * query)
    return ranked.withColumn("role", F.when(is_support, "support").otherwise("query")).drop("_i")


def within_group_percentile(df: DataFrame, value: str, group: str, key: str, out: str = "percentile", **kw) -> DataFrame:
    """Average rank divided by the group size."""
    from ..functions.ordering import average_rank

    ranked = average_rank(df, value, [group], tie=key, out="_rank", total="_n", **kw)
    return ranked.withColumn(out, F.col("_rank") / F.col("_n")).drop("_rank", "_n")


