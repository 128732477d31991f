"""Whole rows with a number, for stages that decide about rows by slim columns and then return them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """A written table of ``doc`` (the row as a struct, so no name can clash) and a unique ``_row``."""
    return scratch.table(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row")), "numbered")


def slim(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("_row", *[F.col(f"doc.{c}") for c in columns])


def chosen(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The documents whose ``_row`` is in ``numbers``."""
    return rows.join(numbers.select("_row"), "_row", "left_semi").select("doc.*")
