"""Text conventions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space is space, tab, line feed, vertical tab, form feed and carriage return; words are runs of anything else.
SPACE_PATTERN = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8; ``bytes.split`` cuts at exactly the white space above."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
