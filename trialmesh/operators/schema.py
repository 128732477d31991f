"""Bring differently labelled tables to one set of typed columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fixed
from ..functions.ordering import dense_ids
from ..functions.text import canonical_name, to_number


def find_column(
    columns: Sequence[str],
    aliases: Sequence[str] = (),
    keywords: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> str | None:
    """First header equal to an alias, then equal ignoring case and outer spaces, then containing a keyword."""
    folded = {}
    for column in columns:
        folded[column.strip().lower()] = column
    for alias in aliases:
        if alias in columns:
            return alias
        if alias.strip().lower() in folded:
            return folded[alias.strip().lower()]
    for column in columns:
        name = re.sub(r"\s+", " ", column.strip()).lower()
        if any(k.lower() in name for k in keywords) and not any(e.lower() in name for e in exclude):
            return column
    return None


def standardize_columns(
    df: DataFrame,
    aliases: Mapping[str, Sequence[str]] = fixed.COLUMN_ALIASES,
    names: Sequence[str] = fixed.NAME_COLUMNS,
    numbers: Mapping[str, float | None] | None = None,
    id_column: str = "candidate_id",
    name_rule=canonical_name,
) -> tuple[DataFrame, dict[str, str]]:
    """Rename by alias, add missing columns with defaults, canonicalise names, convert numbers.

    ``numbers`` maps numeric columns to the default of a column that is absent. Returns the table and the map
    canonical name → source header. An id column that is absent under every alias is looked for by content,
    then numbered in the order of all columns.
    """
    if numbers is None:
        numbers = {c: 0.0 for c in fixed.PERCENT_COLUMNS} | {fixed.RATIO_COLUMN: None}
    sources = {}
    for name, accepted in aliases.items():
        source = find_column(df.columns, accepted)
        if source is not None:
            sources[name] = source
    if id_column in aliases and id_column not in sources:
        unclaimed = [c for c in df.columns if c not in sources.values()]
        detected = detect_id_column(df.select(*[F.col(f"`{c}`") for c in unclaimed])) if unclaimed else None
        if detected is not None:
            sources[id_column] = detected
    by_source = {source: name for name, source in sources.items()}
    df = df.select(*[F.col(f"`{c}`").alias(by_source.get(c, c)) for c in df.columns])
    typed: dict[str, Column] = {}
    for name in names:
        typed[name] = name_rule(F.col(name).cast("string")) if name in df.columns else F.lit(None).cast("string")
    for name, default in numbers.items():
        typed[name] = to_number(F.col(name)) if name in df.columns else F.lit(default).cast("double")
    if "Round" in aliases and "Round" not in df.columns:
        typed["Round"] = F.lit(None).cast("string")
    df = df.withColumns(typed)
    if id_column in aliases and id_column not in df.columns:
        df = dense_ids(df, sorted(df.columns), "_number", start=1)
        label = F.concat(F.lit("sample_"), F.format_string("%03d", F.col("_number")))
        df = df.withColumn(id_column, label).drop("_number")
    return df, sources


def id_column_scores(df: DataFrame) -> DataFrame:
    """Per column: values that look like round labels, integer-like values and the resulting score."""
    text = {c: F.trim(F.col(f"`{c}`").cast("string")) for c in df.columns}
    counted = []
    for i, column in enumerate(df.columns):
        counted.append(F.coalesce(F.sum(text[column].rlike(fixed.ROUND_LABEL_PATTERN).cast("bigint")), F.lit(0)).alias(f"r{i}"))
        counted.append(F.coalesce(F.sum(text[column].rlike(fixed.INTEGER_TEXT_PATTERN).cast("bigint")), F.lit(0)).alias(f"n{i}"))
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"r{i}").alias("round_hits"),
            F.col(f"n{i}").alias("integer_hits"),
            (F.col(f"r{i}") * 10 + F.least(F.col(f"n{i}"), F.lit(40))).alias("score"),
        )
        for i, c in enumerate(df.columns)
    ]
    return df.agg(*counted).select(F.inline(F.array(*rows)))


def detect_id_column(df: DataFrame, minimum: int = 20) -> str | None:
    """Column with the best identifier score, the leftmost one on ties."""
    place = {c: i for i, c in enumerate(df.columns)}
    scores = {row["column_name"]: row["score"] for row in id_column_scores(df).collect()}
    best = min(scores, key=lambda c: (-scores[c], place[c]), default=None)
    return best if best is not None and scores[best] >= minimum else None


def group_column_profile(df: DataFrame) -> DataFrame:
    """Distinct counts of the non-numeric columns and whether each could name repeated groups."""
    columns = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]
    counted = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(columns)]
    )
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").alias("n_distinct"), F.col("n").alias("n_rows")) for i, c in enumerate(columns)]
    limit = F.greatest(F.lit(3), F.floor(F.col("n_rows") / 5))
    return counted.select(F.inline(F.array(*rows))).withColumn("eligible", F.col("n_distinct").between(F.lit(2), limit))


def detect_group_column(df: DataFrame) -> str | None:
    """Eligible column with the fewest distinct values; ties by name."""
    best = group_column_profile(df).where("eligible").orderBy("n_distinct", "column_name").first()
    return best["column_name"] if best else None


def detect_vector_columns(columns: Sequence[str], minimum: int = 8, pattern: str = fixed.VECTOR_COLUMN_PATTERN) -> list[str]:
    """Headers such as ``fp_0`` in the order of their number; empty when there are fewer than ``minimum``."""
    found = []
    for column in columns:
        match = re.fullmatch(pattern, column.strip(), flags=re.IGNORECASE)
        if match:
            found.append((int(match.group(2)), column))
    return [column for _, column in sorted(found)] if len(found) >= minimum else []


def fit_length(vector: Column, length: int) -> Column:
    """Pad with zeros or cut to ``length``."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), length)), 1, length)


def collect_vector(df: DataFrame, columns: Sequence[str], out: str, length: int | None = None) -> DataFrame:
    """One array column from numbered vector columns; missing values count as zero."""
    vector = F.array(*[F.coalesce(to_number(F.col(f"`{c}`")), F.lit(0.0)) for c in columns])
    return df.withColumn(out, fit_length(vector, length) if length else vector).drop(*columns)


def attach_target(df: DataFrame, source: str, out: str, mode: str = "exact") -> DataFrame:
    """Add the locked target column; there is no fallback column. Rows without a target are dropped."""
    column = find_column(df.columns, [source])
    if column is None:
        raise ValueError(f"target column {source!r} not found in {df.columns}")
    value = to_number(F.col(f"`{column}`"))
    if mode == "log10":
        value = F.when(value.isNotNull(), F.log10(F.greatest(value, F.lit(1e-12))))
    elif mode != "exact":
        raise ValueError(f"unknown target mode {mode!r}")
    return df.withColumn(out, value).where(F.col(out).isNotNull())


def align_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack two feature tables over the union of their columns; absent features are zero."""
    stacked = a.unionByName(b, allowMissingColumns=True)
    numeric = [f.name for f in stacked.schema.fields if isinstance(f.dataType, T.NumericType)]
    return stacked.fillna(0.0, subset=numeric)
