"""Column expressions for numbers, names and round labels kept as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..runtime import join_dimension

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def finite(column: Column | str) -> Column:
    """NULL instead of NaN and the infinities. A name is parsed as one expression, which builds wide plans faster."""
    if isinstance(column, str):
        number = f"CAST(`{column}` AS DOUBLE)"
        return F.expr(f"CASE WHEN abs({number}) < DOUBLE('Infinity') THEN {number} END")
    number = column.cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def to_number(column: Column) -> Column:
    """Strict conversion: plain decimal text, anything else is NULL."""
    text = F.trim(column.cast("string"))
    return F.when(text.rlike(_NUMBER), finite(text.try_cast("double")))


def to_number_lenient(column: Column, default: float | None = None) -> Column:
    """Drop every character that cannot belong to a number, then convert."""
    digits = F.regexp_replace(column.cast("string"), r"[^0-9.\-eE]", "")
    return F.coalesce(F.when(digits.rlike(_NUMBER), finite(digits.try_cast("double"))), F.lit(default).cast("double"))


def normalize_token(column: Column) -> Column:
    """Join key of a name: lower case letters and digits only."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(column)), "[^a-z0-9]+", ""), F.lit(""))


def missing_to_null(column: Column) -> Column:
    text = F.trim(column)
    return F.when(~F.lower(text).isin(fixed.MISSING_NAMES), text)


def _name_key(text: Column) -> Column:
    return F.trim(F.replace(F.replace(F.upper(text), F.lit("_"), F.lit("-")), F.lit("  "), F.lit(" ")))


def _name_candidates(text: Column) -> Column:
    """The text, the text without parentheses, then each text inside parentheses."""
    outside = F.trim(F.regexp_replace(text, r"\([^)]*\)", ""))
    inside = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^)]*)\)"), 1), lambda t: F.trim(t))
    return F.filter(F.concat(F.array(text, outside), inside), lambda c: c != "")


def canonical_name(
    column: Column,
    aliases: Mapping[str, str] = fixed.COMPONENT_ALIASES,
    known: Sequence[str] = fixed.KNOWN_COMPONENTS,
) -> Column:
    """Canonical component name by a small literal vocabulary; unknown names stay as they are."""
    text = missing_to_null(column)
    exact = F.create_map(*[F.lit(v) for name in known for v in (name, name)])
    by_key = {name.upper(): name for name in known} | dict(aliases)
    keyed = F.create_map(*[F.lit(v) for pair in by_key.items() for v in pair])
    hits = F.transform(
        _name_candidates(text),
        lambda c: F.coalesce(F.try_element_at(exact, c), F.try_element_at(keyed, _name_key(c))),
    )
    return F.coalesce(F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0)), text)


def canonical_names_by_table(df: DataFrame, column: str, alias_table: DataFrame, out: str) -> DataFrame:
    """Same rule with an alias table (``alias``, ``canonical``) of any size.

    Only distinct names are resolved; the result is joined back to the rows as a dimension.
    """
    names = df.select(F.col(column).alias(column)).where(F.col(column).isNotNull()).distinct()
    tried = names.select(column, F.posexplode(_name_candidates(missing_to_null(F.col(column)))).alias("_rank", "_c"))
    keyed = alias_table.select(_name_key(F.col("alias")).alias("_key"), "canonical")
    found = (
        tried.withColumn("_key", _name_key(F.col("_c")))
        .join(keyed, on="_key")
        .groupBy(column)
        .agg(F.min_by("canonical", F.struct("_rank", "canonical")).alias("_canonical"))
    )
    joined = join_dimension(df, found, [column], how="left")
    return joined.withColumn(out, F.coalesce("_canonical", missing_to_null(F.col(column)))).drop("_canonical")


def round_number(column: Column) -> Column:
    """Number of the first ``R<n>`` in a label."""
    return F.regexp_extract(column, fixed.ROUND_PATTERN, 1).try_cast("int")


def normalize_round_label(column: Column) -> Column:
    text = F.trim(column)
    digits = F.regexp_extract(text, fixed.ROUND_PATTERN, 1)
    return F.coalesce(F.when(digits != "", F.concat(F.lit("R"), digits)).otherwise(text), F.lit("UNKNOWN"))


def round_mentions(column: Column) -> Column:
    """All round numbers named in a label."""
    found = F.regexp_extract_all(F.trim(column), F.lit(fixed.ROUND_PATTERN), 1)
    return F.transform(found, lambda d: d.cast("int"))


def round_from_id(column: Column, prefix_only: bool = False) -> Column:
    """Round of an identifier: the highest round it names, ``R1`` for a bare integer, else UNKNOWN.

    ``prefix_only`` takes a leading ``R<n>`` and ignores later mentions.
    """
    text = F.trim(column.cast("string"))
    if prefix_only:
        number = F.regexp_extract(text, r"(?i)^R\s*(\d+)", 1).try_cast("int")
    else:
        number = F.array_max(round_mentions(text))
    return (
        F.when(number.isNotNull(), F.concat(F.lit("R"), number.cast("string")))
        .when(text.rlike(fixed.INTEGER_TEXT_PATTERN), F.lit("R1"))
        .otherwise(F.lit("UNKNOWN"))
    )


def resolve_round(explicit: Column, inferred: Column, later: bool = True) -> Column:
    """One round from an explicit label and one inferred from the id.

    ``later`` keeps the higher of both; otherwise the inferred round only fills a missing explicit one.
    """
    a, b = round_number(explicit), round_number(inferred)
    number = F.greatest(a, b) if later else F.coalesce(a, b)
    return F.coalesce(F.concat(F.lit("R"), number.cast("string")), F.lit("UNKNOWN"))
