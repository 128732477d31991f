"""Rounds, order-free mixture identity, replicate groups and deduplication."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.ordering import dense_ids
from ..functions.text import normalize_round_label, resolve_round, round_from_id, round_mentions
from ..runtime import join_dimension


@dataclass(frozen=True)
class Mixture:
    """Which columns hold the parts of a mixture. Parts without a name column have a fixed identity."""

    actives: Sequence[tuple[str, str]] = (("IL1", "IL1_molpct"), ("IL2", "IL2_molpct"))
    parts: Sequence[tuple[str, str | None, str]] = (
        ("HL", "Phospholipid", "HL_molpct"),
        ("CHOL", None, "CHOL_molpct"),
        ("PEG", "PEG", "PEG_molpct"),
    )
    ratio: tuple[str, str] | None = ("NP", "NP_ratio")


def fill_rounds(df: DataFrame, id_column: str = "candidate_id", round_column: str = "Round", later: bool = True, prefix_only: bool = False) -> DataFrame:
    """Resolve the explicit round with the round named in the id."""
    explicit = normalize_round_label(F.col(round_column)) if round_column in df.columns else F.lit("UNKNOWN")
    inferred = round_from_id(F.col(id_column), prefix_only)
    return df.withColumns({"Round_inferred_from_ID": inferred, round_column: resolve_round(explicit, inferred, later)})


def multi_round_rows(df: DataFrame, id_column: str = "candidate_id") -> DataFrame:
    """Rows whose id names more than one round."""
    return df.where(F.size(round_mentions(F.col(id_column))) > 1)


def round_counts(df: DataFrame, round_column: str = "Round") -> DataFrame:
    return df.groupBy(round_column).agg(F.count(F.lit(1)).alias("n_rows"))


def _percent(column: str, decimals: int) -> Column:
    return F.round(F.coalesce(F.col(column).cast("double"), F.lit(0.0)), decimals)


def formulation_signature(mixture: Mixture = Mixture(), decimals: int = 4) -> Column:
    """Text identity of a mixture; the order of the active components does not matter."""
    number = f"%.{decimals}f"
    pairs = F.array(
        *[
            F.struct(F.coalesce(F.col(name), F.lit("NONE")).alias("name"), _percent(pct, decimals).alias("pct"))
            for name, pct in mixture.actives
        ]
    )
    present = F.filter(pairs, lambda p: (p["name"] != "NONE") | (F.abs(p["pct"]) > 0))
    texts = [F.transform(F.array_sort(present), lambda p: F.format_string(f"IL:%s:{number}", p["name"], p["pct"]))]
    for label, name, pct in mixture.parts:
        if name is None:
            texts.append(F.format_string(f"{label}:{number}", _percent(pct, decimals)))
        else:
            known = F.coalesce(F.col(name), F.lit("NONE"))
            texts.append(F.format_string(f"{label}:%s:{number}", known, _percent(pct, decimals)))
    if mixture.ratio is not None:
        label, column = mixture.ratio
        ratio = F.round(F.col(column).cast("double"), decimals)
        texts.append(F.when(F.abs(ratio) < float("inf"), F.format_string(f"{label}:{number}", ratio)))
    return F.concat_ws("|", *texts)


def add_signature(df: DataFrame, mixture: Mixture = Mixture(), decimals: int = 4) -> DataFrame:
    """Add the signature and ``group_key``, its md5: a compact group id that needs no shuffle."""
    df = df.withColumn("formulation_signature", formulation_signature(mixture, decimals))
    return df.withColumn("group_key", F.md5("formulation_signature"))


def group_sizes(df: DataFrame) -> DataFrame:
    """One row per signature with its dense id in signature order and its number of rows."""
    sizes = df.groupBy("formulation_signature").agg(F.count(F.lit(1)).alias("n_rows"))
    return dense_ids(sizes, ["formulation_signature"], "formulation_group")


def assign_groups(df: DataFrame, mixture: Mixture = Mixture(), decimals: int = 4) -> DataFrame:
    """Add signature, group key and the dense group id."""
    df = add_signature(df, mixture, decimals)
    ids = group_sizes(df).select("formulation_signature", "formulation_group")
    return join_dimension(df, ids, ["formulation_signature"])


def duplicate_summary(sizes: DataFrame) -> DataFrame:
    """Groups, groups with replicates and rows inside those."""
    repeated = F.col("n_rows") > 1
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum(repeated.cast("bigint")), F.lit(0)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(repeated, F.col("n_rows"))), F.lit(0)).alias("rows_in_duplicate_groups"),
    )


def replicate_profile(df: DataFrame, group: str, target: str, round_column: str) -> DataFrame:
    """Size, spread and rounds of each replicate group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("sd"),
        F.count_distinct(round_column).alias("n_rounds"),
    )


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key; a running minimum, so a frequent key never collects its rows in one place."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def exclude_known(pool: DataFrame, known: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Candidates whose key was not measured before, one row per key."""
    fresh = pool.join(known.select(key).distinct(), on=key, how="left_anti")
    return dedup_keep_first(fresh, [key], order)


def composition_match_key(
    names: Sequence[str] = tuple(fixed.NAME_COLUMNS),
    numbers: Sequence[str] = tuple(fixed.PERCENT_COLUMNS) + (fixed.RATIO_COLUMN,),
) -> Column:
    """Key that matches an older panel to a scored pool: folded names, then numbers with four decimals."""
    texts = [F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in names]
    for column in numbers:
        value = F.col(column).cast("double")
        texts.append(F.coalesce(F.when(F.isnotnull(value) & ~F.isnan(value), F.format_string("%.4f", value)), F.lit("")))
    return F.concat_ws("|", *texts)


def same_component_flag(first: str = "IL1", second: str = "IL2") -> Column:
    """True when a mixture names the same active component twice."""
    a = F.lower(F.trim(F.coalesce(F.col(first), F.lit(""))))
    b = F.lower(F.trim(F.coalesce(F.col(second), F.lit(""))))
    return ~b.isin("", "nan", "none", "na", "-") & (a == b)


