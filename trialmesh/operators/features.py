"""Feature blocks of a mixture and scalers fitted on one table and applied to another."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.ordering import quantile_values
from ..functions.text import finite
from ..functions.vectors import added, scaled
from ..runtime import join_dimension, local_table
from .schema import fit_length


def _number(column: str) -> Column:
    return F.coalesce(finite(column), F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def core_numeric_features() -> dict[str, Column]:
    """Percents, totals, shares and two products."""
    il1, il2, hl = _number("IL1_molpct"), _number("IL2_molpct"), _number("HL_molpct")
    chol, peg = _number("CHOL_molpct"), _number("PEG_molpct")
    active = il1 + il2
    return {
        "IL1_molpct": il1,
        "IL2_molpct": il2,
        "IL_total_molpct": active,
        "IL1_fraction_in_IL": _ratio(il1, active),
        "HL_molpct": hl,
        "CHOL_molpct": chol,
        "PEG_molpct": peg,
        "totalIL_x_PEG": active * peg / 100.0,
        "CHOL_x_HL": chol * hl / 100.0,
        "ILHL_total": active + hl,
        "HL_fraction_in_ILHL": _ratio(hl, active + hl),
    }


def one_hot_fixed(column: str, categories: Sequence[str], prefix: str, none_label: str | None = None) -> dict[str, Column]:
    """Indicator per category of a fixed list; NULL becomes ``none_label`` if given, other names UNKNOWN."""
    value = F.col(column)
    label = F.when(value.isin(list(categories)), value).otherwise(F.lit("UNKNOWN"))
    if none_label is not None:
        label = F.when(value.isNull(), F.lit(none_label)).otherwise(label)
    return {f"{prefix}_{c}": F.when(label == c, F.lit(1.0)).otherwise(F.lit(0.0)) for c in categories}


def core_features(
    actives: Sequence[str] = tuple(fixed.ACTIVE_CATEGORIES),
    second: Sequence[str] = tuple(fixed.SECOND_ACTIVE_CATEGORIES),
    helpers: Sequence[str] = tuple(fixed.HELPER_CATEGORIES),
    pegs: Sequence[str] = tuple(fixed.PEG_CATEGORIES),
) -> dict[str, Column]:
    """Numeric block followed by the four one-hot blocks."""
    return (
        core_numeric_features()
        | one_hot_fixed("IL1", actives, "IL1")
        | one_hot_fixed("IL2", second, "IL2", none_label="NONE")
        | one_hot_fixed("Phospholipid", helpers, "Phospholipid")
        | one_hot_fixed("PEG", pegs, "PEG")
    )


def add_features(df: DataFrame, features: Mapping[str, Column], prefix: str = "") -> DataFrame:
    return df.withColumns({f"{prefix}{name}": column for name, column in features.items()})


def descriptor_table(spark, descriptors: Mapping[str, Sequence[float]] = fixed.COMPONENT_DESCRIPTORS, names: Sequence[str] = tuple(fixed.DESCRIPTOR_NAMES)) -> DataFrame:
    rows = [(component, *[float(v) for v in values]) for component, values in descriptors.items()]
    return local_table(spark, rows, "component string, " + ", ".join(f"{n} double" for n in names))


def _join_parts(df: DataFrame, dimension: DataFrame, parts: Sequence[tuple[str, str]], payload: Column) -> DataFrame:
    """Attach the payload of each active component as ``_d1``, ``_d2`` and its weight as ``_w1``, ``_w2``."""
    dimension = dimension.select(F.col("component"), payload.alias("_payload"))
    for i, (name, weight) in enumerate(parts, start=1):
        side = dimension.select(F.col("component").alias(name), F.col("_payload").alias(f"_d{i}"))
        df = join_dimension(df, side, [name], how="left")
        usable = F.col(f"_d{i}").isNotNull() & (_number(weight) > 0)
        df = df.withColumn(f"_w{i}", F.when(usable, _number(weight)).otherwise(F.lit(0.0)))
    return df


def weighted_descriptor_features(
    df: DataFrame,
    descriptors: DataFrame,
    names: Sequence[str] = tuple(fixed.DESCRIPTOR_NAMES),
    parts: Sequence[tuple[str, str]] = (("IL1", "IL1_molpct"), ("IL2", "IL2_molpct")),
    prefix: str = "ILdesc_",
    unsaturation: tuple[str, str] | None = ("tail_double_bonds", "tail_carbons"),
) -> DataFrame:
    """Percent-weighted mean of each descriptor over the known components with a positive percent.

    The dimension is joined once per component slot, so rows keep their place and are not regrouped.
    """
    kept = df.columns
    joined = _join_parts(df, descriptors, parts, F.struct(*names))
    slots = range(1, len(parts) + 1)
    total = sum((F.col(f"_w{i}") for i in slots), F.lit(0.0))
    means = {}
    for name in names:
        weighted = sum((F.coalesce(F.col(f"_d{i}.{name}"), F.lit(0.0)) * F.col(f"_w{i}") for i in slots), F.lit(0.0))
        means[f"{prefix}{name}"] = _ratio(weighted, total)
    if unsaturation is not None:
        bonds, carbons = (means[f"{prefix}{n}"] for n in unsaturation)
        means[f"{prefix}unsaturation_density"] = _ratio(bonds, carbons)
    return joined.withColumns(means).select(*kept, *means)


def weighted_vector_features(
    df: DataFrame,
    vectors: DataFrame,
    length: int,
    parts: Sequence[tuple[str, str]] = (("IL1", "IL1_molpct"), ("IL2", "IL2_molpct")),
    out: str = "vector",
) -> DataFrame:
    """Percent-weighted mean of component vectors (``component``, ``vector``); zeros when none is known."""
    kept = df.columns
    joined = _join_parts(df, vectors, parts, fit_length(scaled(F.col("vector"), F.lit(1.0)), length))
    zeros = F.array_repeat(F.lit(0.0), length)
    slots = range(1, len(parts) + 1)
    total = sum((F.col(f"_w{i}") for i in slots), F.lit(0.0))
    mixed = zeros
    for i in slots:
        mixed = added(mixed, scaled(F.coalesce(F.col(f"_d{i}"), zeros), F.col(f"_w{i}")))
    mean = F.transform(mixed, lambda v: F.when(total > 0, v / total).otherwise(F.lit(0.0)))
    return joined.withColumn(out, mean).select(*kept, out)


def shared_vector_features(
    df: DataFrame,
    vectors: DataFrame,
    length: int,
    parts: Sequence[tuple[str, str]] = (("IL1", "IL1_molpct"), ("IL2", "IL2_molpct")),
    out: str = "vector",
) -> DataFrame:
    """Variant for two slots: share of the first percent (0.5 without percents), second vector defaults to the first."""
    kept = df.columns
    (first, first_pct), (second, second_pct) = parts
    joined = _join_parts(df, vectors, parts, fit_length(scaled(F.col("vector"), F.lit(1.0)), length))
    zeros = F.array_repeat(F.lit(0.0), length)
    a = F.coalesce(F.col("_d1"), zeros)
    b = F.coalesce(F.col("_d2"), F.col("_d1"), zeros)
    total = _number(first_pct) + _number(second_pct)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(total > 0, _number(first_pct) / total).otherwise(F.lit(0.5))))
    # A column of its own, since an expression inside the lambda is worked out again for every element.
    own = F.col("_share")
    return joined.withColumn("_share", share).withColumn(out, F.zip_with(a, b, lambda x, y: x * own + y * (F.lit(1.0) - own))).select(*kept, out)


def assemble(df: DataFrame, core: Sequence[str], selected: Sequence[str] = (), out: str = "features") -> DataFrame:
    """ML vector of the core block and the selected extra features, in that order; absent or NULL counts as zero."""
    columns = [*core, *selected]
    absent = [c for c in columns if c not in df.columns]
    df = df.withColumns({c: F.lit(0.0) for c in absent}) if absent else df
    df = df.fillna(0.0, subset=columns)
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df)


@dataclass(frozen=True)
class Standardizer:
    """z-scores with the mean and population deviation of the table it was fitted on."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    sd: tuple[float, ...]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str]) -> "Standardizer":
        row = df.agg(
            *[F.avg(finite(c)).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(finite(c)).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        size = range(len(columns))
        return Standardizer(
            tuple(columns), tuple(float(row[f"m{i}"] or 0.0) for i in size), tuple(float(row[f"s{i}"] or 0.0) or 1.0 for i in size)
        )

    def _texts(self) -> list[str]:
        return [f"((`{c}` - {m!r}D) / {s!r}D)" for c, m, s in zip(self.columns, self.mean, self.sd)]

    def scores(self) -> dict[str, Column]:
        return {c: F.expr(text) for c, text in zip(self.columns, self._texts())}

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": z for c, z in self.scores().items()})

    def vector(self) -> Column:
        """All scores as one array; missing values are at the mean."""
        return F.expr("array(" + ", ".join(f"coalesce({text}, 0.0D)" for text in self._texts()) + ")")


def minmax01(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scale to [0, 1] by the observed range; a constant column becomes 0."""
    row = df.agg(F.min(finite(column)).alias("lo"), F.max(finite(column)).alias("hi")).first()
    return df.withColumn(out, scale01(F.col(column), row["lo"], row["hi"]))


def scale01(value: Column, low: float | None, high: float | None) -> Column:
    if low is None or high is None or high <= low:
        return F.lit(0.0)
    return (value - F.lit(low)) / F.lit(high - low)


def diversity_vector(
    df: DataFrame,
    key: str,
    numbers: Sequence[str] = tuple(fixed.PERCENT_COLUMNS) + (fixed.RATIO_COLUMN,),
    names: Sequence[str] = tuple(fixed.NAME_COLUMNS),
    stable: bool = False,
) -> tuple[Column, list[str]]:
    """Standardised vector of a mixture for distances: median-imputed numbers, then one-hot names.

    Returns an expression over the columns of ``df``, so the wide vectors needn't be written, and the list of vector components.
    """
    medians = quantile_values(df, numbers, [0.5], tie=key, stable=stable)
    filled = [f"coalesce(CAST(`{c}` AS DOUBLE), {float(medians[c].get(0.5, 0.0))!r}D)" for c in numbers]
    scaler = Standardizer.fit(df.selectExpr(*[f"{text} AS _z{i}" for i, text in enumerate(filled)]), [f"_z{i}" for i in range(len(numbers))])
    # A filled value can still be NaN or infinite; it is scaled as it is.
    columns, texts = list(numbers), [f"coalesce(({text} - {m!r}D) / {s!r}D, 0.0D)" for text, m, s in zip(filled, scaler.mean, scaler.sd)]
    for name in names:
        label = f"coalesce(CAST(`{name}` AS STRING), '')"
        counts = {r["v"]: r["count"] for r in df.groupBy(F.expr(label).alias("v")).count().collect()}
        n = sum(counts.values())
        for value in sorted(counts):
            # Mean and deviation of a column of zeros and ones follow from its count.
            share = counts[value] / n
            sd = math.sqrt(share * (1.0 - share)) or 1.0
            quoted = value.replace("\\", "\\\\").replace("'", "\\'")
            texts.append(f"CASE WHEN {label} = '{quoted}' THEN {(1.0 - share) / sd!r}D ELSE {(0.0 - share) / sd!r}D END")
            columns.append(f"{name}_{value}")
    return F.expr("array(" + ", ".join(texts) + ")"), columns


def diversity_matrix(
    df: DataFrame,
    key: str,
    numbers: Sequence[str] = tuple(fixed.PERCENT_COLUMNS) + (fixed.RATIO_COLUMN,),
    names: Sequence[str] = tuple(fixed.NAME_COLUMNS),
    out: str = "z",
    stable: bool = False,
) -> tuple[DataFrame, list[str]]:
    """The table with the column of ``diversity_vector``, and the list of vector components."""
    vector, columns = diversity_vector(df, key, numbers, names, stable)
    return df.withColumn(out, vector), columns
